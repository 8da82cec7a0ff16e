"""Orphan references of the projected edges and the release ingestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import orphans
from graphloom.plans.tables import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, ingestions = table(spark, sf_dir, "projected_edges"), table(spark, sf_dir, "release_ingestions")
    refs = orphans.reference_rows(edges, "projected_edges", "source", "nodes", "edge_id", edges.source, edges.projected_at)
    refs = refs.union(orphans.reference_rows(edges, "projected_edges", "target", "nodes", "edge_id", edges.target, edges.projected_at))
    refs = refs.union(orphans.reference_rows(ingestions, "release_ingestions", "artifacts", "artifacts", "ingestion_id", ingestions.artifacts, ingestions.completed_at))
    refs = refs.union(orphans.reference_rows(ingestions, "release_ingestions", "records", "records", "ingestion_id", ingestions.records, ingestions.completed_at))
    parents = orphans.parent_rows(table(spark, sf_dir, "projected_nodes"), "nodes", "node_key", "created_at", "deleted_at")
    parents = parents.union(orphans.parent_rows(table(spark, sf_dir, "artifacts"), "artifacts", "artifact_id", "retrieved_at", "deleted_at"))
    parents = parents.union(orphans.parent_rows(table(spark, sf_dir, "parsed_records"), "records", "record_id", "parsed_at", "deleted_at"))
    return orphans.orphans(refs, parents)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_field", "row_id", F.col("key").alias("ref_key"))


def p4_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).groupBy("ref_table", "ref_field", "month").agg(F.count(F.lit(1)).alias("orphans"))


QUERIES = {"p4_found": p4_found, "p4_monthly": p4_monthly}

_REFS = r"""
with refs as (
  select 'projected_edges' as ref_table, 'source' as ref_field, 'n' as p, edge_id as row_id, source as k, projected_at as t from projected_edges
  union all select 'projected_edges', 'target', 'n', edge_id, target, projected_at from projected_edges
  union all select 'release_ingestions', 'artifacts', 'a', ingestion_id, unnest(artifacts), completed_at from release_ingestions
  union all select 'release_ingestions', 'records', 'r', ingestion_id, unnest(records), completed_at from release_ingestions
), trimmed as (
  select distinct ref_table, ref_field, p, row_id, regexp_replace(k, '^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$', '', 'g') as k, t
  from refs where k is not null and t is not null
), parents as (
  select 'n' as p, node_key as k, created_at as since, deleted_at as until from projected_nodes
  union all select 'a', artifact_id, retrieved_at, deleted_at from artifacts
  union all select 'r', record_id, parsed_at, deleted_at from parsed_records
), clean as (
  select p, regexp_replace(k, '^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$', '', 'g') as k, since, until from parents
), lost as (
  select * from trimmed x where not exists (
    select 1 from clean c where c.p = x.p and c.k = x.k and c.since <= x.t and (c.until is null or c.until > x.t))
)
"""

ORACLES = {
    "p4_found": _REFS + "select ref_table, ref_field, row_id, k as ref_key from lost",
    "p4_monthly": _REFS + "select ref_table, ref_field, cast(year(t) * 100 + month(t) as integer) as month, count(*) as orphans from lost group by all",
}
