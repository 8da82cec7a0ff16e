"""Records that differ only by white space, letter case, punctuation or the order of their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.canon import bare, is_blank
from graphloom.llm.radix import radix_count
from graphloom.operators.skew import salted_join
from graphloom.scratch import drop_table, write_table

#: The namespaces whose identifiers give the order of a statement's ends a meaning.
NAMESPACES = ("hgnc", "uniprot", "chembl", "mondo")

#: Bytes of partial records that a bucket holds about, in a Python worker.
BUCKET_BYTES = 32 << 20


def statement_key(fields: list[Column], namespaces: tuple[str, ...] = NAMESPACES) -> Column:
    """Canonical bytes of a record, null where a field is null or blank.

    The fields' letters and digits, in sorted order, since the columns may have been exchanged. Where
    exactly two of them are identifiers and these are of one namespace, the columns keep their order.
    The bytes run backwards: records differ in their last digits, not in their first letters, and
    so the first bytes split them well.
    """
    bares = [bare(f) for f in fields]
    space = [F.when(b.rlike(r"\d"), F.regexp_extract(b, rf"^({'|'.join(namespaces)})", 1)).otherwise("") for b in bares]
    named = F.filter(F.array(*space), lambda x: x != "")
    ordered = (F.size(named) == 2) & (F.size(F.array_distinct(named)) == 1)
    text = F.concat_ws("\x1f", F.when(ordered, F.array(*bares)).otherwise(F.array_sort(F.array(*bares))))
    stated = F.lit(True)
    for f in fields:
        stated = stated & f.isNotNull() & ~is_blank(f)
    return F.when(stated, F.reverse(text).cast("binary"))


def _keyed(df: DataFrame, fields: list[str], id_column: str) -> DataFrame:
    return df.select(statement_key([F.col(f"`{f}`") for f in fields]).alias("k"), F.col(f"`{id_column}`").cast("long").alias("id")).where("k is not null and id is not null")


def collapse(keyed: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(k, n, first) of each statement of keyed (k, id): its canonical bytes, copies and smallest id.

    Partial counts leave each map task, so that a statement with a third of all rows arrives as one
    record per task. They are split into buckets by further and further bytes until each bucket
    holds about bucket_bytes, and each bucket is counted in a trie.
    """
    return radix_count(keyed.select("k", F.lit(1).cast("long").alias("n"), F.col("id").alias("first")), write_table, drop_table, bucket_bytes)


def copies(df: DataFrame, fields: list[str], id_column: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(first_id, copies) of each statement.

    Rows with a null or blank field state nothing and have no record; nor have rows with a null id.
    Rows with one id each count as a copy. An empty table gives an empty result.
    """
    return collapse(_keyed(df, fields, id_column), bucket_bytes).select(F.col("first").alias("first_id"), F.col("n").alias("copies"))


def members(df: DataFrame, fields: list[str], id_column: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, first_id) of each row whose statement at least two rows hold, with rows left out as in copies().

    The canonical bytes are worked out once and written, for they are read for counting and again
    for the join of rows with their statement.
    """
    rows = write_table(_keyed(df, fields, id_column))
    groups = collapse(rows, bucket_bytes).where("n > 1")
    return salted_join(rows, groups, ["k"], "n", F.xxhash64("id")).select("id", F.col("first").alias("first_id"))
