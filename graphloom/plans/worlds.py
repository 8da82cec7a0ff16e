"""Graphs made from the test tables, in one form for all queries, and the same graphs in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.tables import table


def _link(df: DataFrame, s: str, s_key: str, predicate: str, o: str, o_key: str) -> DataFrame:
    return df.select(F.concat(F.lit(f"{s}:"), F.col(s_key)).alias("s"), F.lit(predicate).alias("p"), F.concat(F.lit(f"{o}:"), F.col(o_key)).alias("o"))


def assertion_id(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("assertion:"), F.substring(F.sha2(F.concat_ws("|", s, p, o), 256), 1, 16))


def links(spark: SparkSession, d: str) -> DataFrame:
    """(s, p, o): places, customers, suppliers, orders and parts linked by their keys, as often as the tables say so."""
    t = lambda name: table(spark, d, name)
    parts = [
        _link(t("nation"), "nation", "n_nationkey", "partOf", "region", "n_regionkey"),
        _link(t("customer"), "customer", "c_custkey", "locatedIn", "nation", "c_nationkey"),
        _link(t("supplier"), "supplier", "s_suppkey", "locatedIn", "nation", "s_nationkey"),
        _link(t("orders"), "customer", "o_custkey", "placed", "order", "o_orderkey"),
        _link(t("lineitem"), "order", "l_orderkey", "contains", "part", "l_partkey"),
        _link(t("lineitem"), "supplier", "l_suppkey", "supplies", "part", "l_partkey"),
    ]
    return reduce(DataFrame.union, parts)


def relations(spark: SparkSession, d: str) -> DataFrame:
    """(id, s, p, o): the links, each fact once."""
    return links(spark, d).distinct().select(assertion_id(F.col("s"), F.col("p"), F.col("o")).alias("id"), "s", "p", "o")


RELATIONS = """
facts as (
  select distinct s, p, o from (
    select 'nation:' || n_nationkey as s, 'partOf' as p, 'region:' || n_regionkey as o from nation
    union all select 'customer:' || c_custkey, 'locatedIn', 'nation:' || c_nationkey from customer
    union all select 'supplier:' || s_suppkey, 'locatedIn', 'nation:' || s_nationkey from supplier
    union all select 'customer:' || o_custkey, 'placed', 'order:' || o_orderkey from orders
    union all select 'order:' || l_orderkey, 'contains', 'part:' || l_partkey from lineitem
    union all select 'supplier:' || l_suppkey, 'supplies', 'part:' || l_partkey from lineitem
  ) where s is not null and o is not null
), relations as (select 'assertion:' || substring(sha256(s || '|' || p || '|' || o), 1, 16) as id, s, p, o from facts)
"""


def attributes(spark: SparkSession, d: str) -> DataFrame:
    """(s, p, value): names, sizes, dates and statuses as written."""
    t = lambda name: table(spark, d, name)
    one = lambda df, s, key, p, value: df.select(F.concat(F.lit(f"{s}:"), F.col(key)).alias("s"), F.lit(p).alias("p"), value.cast("string").alias("value"))
    parts = [
        one(t("part"), "part", "p_partkey", "name", F.col("p_name")),
        one(t("part"), "part", "p_partkey", "size", F.col("p_size")),
        one(t("part"), "part", "p_partkey", "brandCode", F.col("p_brand")),
        one(t("orders"), "order", "o_orderkey", "orderDate", F.date_format("o_orderdate", "yyyy/MM/dd")),
        one(t("orders"), "order", "o_orderkey", "status", F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"'))),
        one(t("customer"), "customer", "c_custkey", "segment", F.col("c_mktsegment")),
        one(t("customer"), "customer", "c_custkey", "balance", F.concat(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit("^^xsd:decimal"))),
        one(t("supplier"), "supplier", "s_suppkey", "active", F.when(F.col("s_acctbal") > 0, "TRUE").otherwise("no")),
    ]
    return reduce(DataFrame.union, parts)


ATTRIBUTES = """
attributes as (
  select 'part:' || p_partkey as s, 'name' as p, p_name as value from part
  union all select 'part:' || p_partkey, 'size', cast(p_size as varchar) from part
  union all select 'part:' || p_partkey, 'brandCode', p_brand from part
  union all select 'order:' || o_orderkey, 'orderDate', strftime(o_orderdate, '%Y/%m/%d') from orders
  union all select 'order:' || o_orderkey, 'status', '"' || o_orderstatus || '"' from orders
  union all select 'customer:' || c_custkey, 'segment', c_mktsegment from customer
  union all select 'customer:' || c_custkey, 'balance', cast(cast(c_acctbal as decimal(12,2)) as varchar) || '^^xsd:decimal' from customer
  union all select 'supplier:' || s_suppkey, 'active', case when s_acctbal > 0 then 'TRUE' else 'no' end from supplier
)
"""


def statements(spark: SparkSession, d: str) -> DataFrame:
    """(seq, graph, s, p, o, confidence, source, at): the repurposing graph's rows with all three parts, as written but for outer white space."""
    t = table(spark, d, "drug_repurposing_graph")
    trim = lambda c: F.nullif(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))
    rows = t.select(F.col("row_id").alias("seq"), F.col("graph_id").alias("graph"), trim(F.col("subject")).alias("s"), trim(F.col("predicate")).alias("p"), trim(F.col("object")).alias("o"), "confidence", "source", F.col("observed_at").alias("at"))
    return rows.where("s is not null and p is not null and o is not null")


STATEMENTS = r"""
statements as (
  select * from (
    select row_id as seq, graph_id as graph,
      nullif(regexp_replace(subject, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') as s, nullif(regexp_replace(predicate, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') as p,
      nullif(regexp_replace(object, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') as o, confidence, source, observed_at as at
    from drug_repurposing_graph)
  where s is not null and p is not null and o is not null
)
"""


def log(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, assertion_id, to_state, ts): the events as a log of states, most of it against the rules."""
    states = {"signup": "candidate", "view": "verified", "click": "promotion_review", "purchase": "approved", "error": "rejected"}
    state = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])[F.col("event_type")]
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("assertion_id"), state.alias("to_state"), "ts")


LOG = """
log as (
  select event_id, user_id as assertion_id, case event_type when 'signup' then 'candidate' when 'view' then 'verified' when 'click' then 'promotion_review'
    when 'purchase' then 'approved' when 'error' then 'rejected' end as to_state, ts
  from events
)
"""
