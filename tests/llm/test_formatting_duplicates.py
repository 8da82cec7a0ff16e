import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import formatting_duplicates as fd
from graphloom.llm import radix

FIELDS = ["subject", "predicate", "object"]
SCHEMA = "row_id long, subject string, predicate string, object string"


def brute(rows):
    """(id, first) by plain Python over characters."""
    groups = {}
    for i, *values in rows:
        if i is None or any(v is None or not v.strip() for v in values):
            continue
        bare = ["".join(c for c in v.upper().lower() if unicodedata.category(c)[0] in "LNM") for v in values]
        spaces = [m.group(1) for b in bare if (m := re.match(r"(hgnc|uniprot|chembl|mondo).*\d", b))]
        ordered = len(spaces) == 2 and spaces[0] == spaces[1]
        groups.setdefault(tuple(bare if ordered else sorted(bare)), []).append(i)
    return {(i, min(g)) for g in groups.values() if len(g) > 1 for i in g}


def run(spark, rows, limit=fd.BUCKET_BYTES):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {tuple(r) for r in fd.members(df, FIELDS, "row_id", limit).collect()}


ROWS = [
    (1, "HGNC:1", "encodes", "UniProt:Z1"), (2, " hgnc-1 ", "Encodes.", "uniprot:z1"), (3, "UniProt|Z1", "HGNC:1", "«encodes»"),
    (4, "HGNC:1", "regulates", "HGNC:2"), (5, "HGNC:2", "regulates", "HGNC:1"), (6, "hgnc:2", "REGULATES", "hgnc:1"),
    (7, None, "x", "y"), (8, " ", "x", "y"), (9, "　", "x", "y"), (10, "HGNC:1", "enc odes", "Uni Prot:Z1"), (11, "--", "x", "y"), (12, "..", "x", "y"),
    (None, "HGNC:1", "encodes", "UniProt:Z1"), (13, "Straße", "x", "y"), (14, "STRASSE", "x", "y"), (13, "Straße", "x", "y"),
]


def test_statements_meet_whatever_their_form(spark):
    found = run(spark, ROWS)
    assert {(1, 1), (2, 1), (3, 1), (10, 1), (5, 5), (6, 5), (11, 11), (12, 11), (13, 13), (14, 13)} == found


def test_columns_count_within_one_namespace(spark):
    assert run(spark, [(1, "MONDO:1", "subtype_of", "MONDO:2"), (2, "MONDO:2", "subtype_of", "MONDO:1")]) == set()
    assert run(spark, [(1, "MONDO:1", "treats", "HGNC:2"), (2, "HGNC:2", "treats", "MONDO:1")]) == {(1, 1), (2, 1)}


def test_many_buckets_and_a_hot_statement(spark):
    rng = random.Random(5)
    rows = [(i, "HGNC:7", "encodes", rng.choice(["UniProt:Z9", "uniprot.z9"])) for i in range(3000)]
    rows += [(i, f"HGNC:{rng.randrange(900)}", rng.choice(["binds", "Binds!"]), f"ChEMBL:{rng.randrange(4)}") for i in range(3000, 9000)]
    assert run(spark, rows, limit=10_000) == brute(rows) == run(spark, rows)


def test_empty_table_and_other_columns(spark):
    assert run(spark, []) == set()
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as k", "'x' as id", "2 as n", "3 as first")
    assert {tuple(r) for r in fd.members(df, FIELDS, "row_id").collect()} == brute(ROWS)
    counted = {tuple(r) for r in fd.copies(df, FIELDS, "row_id").collect()}
    assert (1, 4) in counted and (4, 1) in counted and (13, 3) in counted


def test_long_values(spark):
    long = "Wort " * 40_000
    assert run(spark, [(1, long, "x", "y"), (2, long.upper(), "y", "x"), (3, long + "z", "x", "y")]) == {(1, 1), (2, 1)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abcdé", min_size=0, max_size=9), min_size=1, max_size=60))
def test_trie_counts_like_a_dictionary(words):
    import numpy as np
    import pyarrow as pa

    keys = pa.array([w.encode() for w in words], pa.binary())
    where, count, least = radix.Trie(keys).terminals(np.ones(len(words), np.int64), np.arange(len(words)))
    got = {words[w]: (int(c), int(f)) for w, c, f in zip(where, count, least)}
    assert got == {w: (words.count(w), words.index(w)) for w in set(words)}


def test_plan_splits_until_each_bucket_fits(spark):
    keys = [f"{i % 7}{'x' * 20}{i}" for i in range(2000)]
    sized = spark.createDataFrame([(bytearray(k.encode()), 1) for k in keys], "k binary, size long")
    bounds = radix.radix_plan(sized, 50)
    import bisect

    import pyarrow as pa

    assert radix.places(pa.array([k.encode() for k in keys], pa.binary()), bounds).tolist() == [max(0, bisect.bisect_right(bounds, k.encode()) - 1) for k in keys]

    sizes = {}
    for k in keys:
        at = bisect.bisect_right(bounds, k.encode()) - 1
        sizes[at] = sizes.get(at, 0) + 1
    assert min(sizes) >= 0 and max(sizes.values()) <= 50


def test_plan_returns_few_prefixes_and_splits_by_bytes_held(spark):
    rng = random.Random(3)
    keys = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5000)] + ["q" * 300] * 3
    sized = spark.createDataFrame([(bytearray(k.encode()), len(k)) for k in keys], "k binary, size long")
    bounds = radix.radix_plan(sized, 2000)
    assert len(bounds) <= 5 * (sum(map(len, keys)) // 2000 + 1)
    assert radix.radix_plan(sized.limit(0), 2000) == []
