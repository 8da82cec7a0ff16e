"""Queries pN_ over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import components, encoding, formatting_duplicates, linkage, mixing, survivorship, truncation

STATEMENT = ["subject", "predicate", "object"]
#: Where the public tokenizers' files are.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
ENTITY = ["label", "group_name", "color", "description"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatting_duplicates.members(_table(spark, sf_dir, "drug_repurposing_graph"), STATEMENT, "row_id")
    return found.select(found.id.alias("row_id"), found.first_id.alias("first_row_id"))


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatting_duplicates.copies(_table(spark, sf_dir, "drug_repurposing_graph"), STATEMENT, "row_id")
    return found.select(found.first_id.alias("first_row_id"), "copies")


def _entity_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    trusted = _table(spark, sf_dir, "aligned_source_pairs").where("is_ground_truth").select("canonical_id")
    entities = _table(spark, sf_dir, "canonical_entities")
    return entities, survivorship.unpivot(entities, "canonical_id", ENTITY, "record_id", "updated_at", "source_canonical_id", trusted)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, long = _entity_values(spark, sf_dir)
    records = survivorship.pivot(survivorship.elect(survivorship.ranked(long)), entities, "canonical_id", ENTITY, "record").where("records >= 2")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("record_id")) for f in ENTITY])).alias("c")
    return records.select(F.col("group").alias("canonical_id"), cells).select("canonical_id", "c.*").where("record_id is not null")


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, long = _entity_values(spark, sf_dir)
    latest = entities.agg(F.max("updated_at")).first()[0]
    won = survivorship.elect(survivorship.decaying(long, latest, 180.0), digits=9)
    return survivorship.pivot(won, entities, "canonical_id", ENTITY).withColumnRenamed("group", "canonical_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _table(spark, sf_dir, "match_pairs")
    edges = components.linked(pairs, "left_id", "right_id", pairs.origin.isin("auto_merged_pairs", "alias_map", "source_alias_map"))
    found = components.groups(edges)
    return found.select(found.member.alias("member_id"), found.group.alias("group_id"))


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [_table(spark, sf_dir, f"{name}_sample") for name in ("hgnc", "ensembl", "uniprot", "chembl")]
    return linkage.link(linkage.gene_records(*tables))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_links(spark, sf_dir).select("key_a", "key_b")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(_table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY).withColumnRenamed("id", "doc_id")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = encoding.count(_table(spark, sf_dir, "documents"), ["doc_id", "source"], "text", VOCABULARY)
    return mixing.mix(sizes.withColumnRenamed("doc_id", "id"), _table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_texts(_table(spark, sf_dir, "documents"), "doc_id", "text", "source").withColumnRenamed("id", "doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return truncation.rates(documents, truncation.cut_texts(documents, "doc_id", "text", "source"), "doc_id", "text", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_copies": p1_copies,
    "p2_found": p2_found,
    "p2_survivors": p2_survivors,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_links": p5_links,
    "p6_ids": p6_ids,
    "p7_shares": p7_shares,
    "p7_documents": p7_documents,
    "p8_found": p8_found,
    "p8_rates": p8_rates,
}
