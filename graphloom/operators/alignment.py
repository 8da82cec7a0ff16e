"""Predicates and sources of two graphs brought into one vocabulary."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.labels import local_name
from graphloom.operators import components
from graphloom.operators.states import latest_rows
from graphloom.scratch import write_table


def directional(mappings: DataFrame) -> DataFrame:
    """Mappings (predicate, target, kind, confidence) by role: equivalent and canonical ones hold for both ends in both graphs, directed ones for the source."""
    both = F.array(*[F.struct(F.col(c).alias("predicate"), F.lit(r).alias("role")) for c in ("predicate", "target") for r in ("graph_a", "graph_b")])
    one = F.array(F.struct(F.col("predicate"), F.lit("graph_a").alias("role")))
    rows = mappings.select("target", "confidence", F.explode(F.when(F.col("kind").isin("equivalent", "canonical"), both).otherwise(one)).alias("m"))
    return rows.select("m.predicate", "m.role", "target", "confidence")


def best_mappings(mappings: DataFrame) -> DataFrame:
    """The surest target of each (predicate, role), the first name among equals."""
    return latest_rows(mappings.withColumn("predicate", F.lower("predicate")), ["predicate", "role"], [F.desc("confidence"), F.col("target")]).select("predicate", "role", "target")


def align_predicates(facts: DataFrame, mappings: DataFrame) -> DataFrame:
    """facts (with p and graph) with aligned, the mapped predicate or p, and mapped. Mappings are a table of rules and are broadcast."""
    rules = best_mappings(mappings).select(F.col("predicate").alias("_p"), F.col("role").alias("graph"), "target")
    out = facts.withColumn("_p", F.lower(local_name(F.col("p")))).join(F.broadcast(rules), ["_p", "graph"], "left")
    return out.withColumns({"aligned": F.coalesce("target", "p"), "mapped": F.col("target").isNotNull()}).drop("_p", "target")


def unmapped(facts: DataFrame, mappings: DataFrame, standard: tuple[str, ...] = ("rdf:", "rdfs:", "owl:", "skos:", "xsd:")) -> DataFrame:
    """(predicate, graph) of distinct predicates outside the standard vocabularies that no mapping covers."""
    rules = best_mappings(mappings).select("predicate", F.col("role").alias("graph"))
    own = facts.where(~F.col("p").rlike(f"^({'|'.join(standard)})")).select(F.lower(local_name(F.col("p"))).alias("predicate"), "graph").distinct()
    return own.join(F.broadcast(rules), (own.predicate == rules.predicate) & own.graph.eqNullSafe(rules.graph), "left_anti")


def with_inverses(facts: DataFrame, contracts: DataFrame) -> DataFrame:
    """facts (s, p, o) and the inverse of each that a contract (p, inverse) gives one; an inverse gets none itself."""
    inverse = facts.join(F.broadcast(contracts), "p").select(F.col("o").alias("s"), F.col("inverse").alias("p"), F.col("s").alias("o"))
    return facts.select("s", "p", "o").withColumn("derived", F.lit(False)).union(inverse.withColumn("derived", F.lit(True)))


_ALIGNED = "id_a string, id_b string, pass string"


def align_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b, pass): each source of b with at most one of a, by equal URI, else by equal digest.

    a and b have id, uri, digest and seq. The sources of b choose in the order of seq, each the first free one of a with its
    uri, or else with its digest; so one choice can move later ones. Choices depend on each other only through shared URIs and
    digests: each connected component of these is folded by itself, after repeated sources are dropped. A task holds its largest
    component, so a digest that most sources share still brings these together.
    """
    first = lambda x, side: latest_rows(x.where("id is not null"), ["id"], [F.col("seq")]).select(F.lit(side).alias("side"), "id", "uri", "digest", "seq")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", "id"])
        mine, taken, out = rows[rows.side == "a"], set(), []
        index = {c: {} for c in ("uri", "digest")}
        for r in mine.itertuples():
            for c in index:
                if getattr(r, c) is not None:
                    index[c].setdefault(getattr(r, c), deque()).append(r.id)
        for r in rows[rows.side == "b"].itertuples():
            for c in index:
                queue = index[c].get(getattr(r, c), ())
                while queue and queue[0] in taken:
                    queue.popleft()
                if queue:
                    free = queue.popleft()
                    taken.add(free)
                    out.append((free, r.id, c))
                    break
        return pd.DataFrame(out, columns=["id_a", "id_b", "pass"])

    rows = write_table(first(a, "a").union(first(b, "b")).where("uri is not null or digest is not null"))
    key = lambda c: F.concat(F.lit(f"{c}:"), F.col(c))
    links = rows.where("uri is not null and digest is not null").select(key("uri").alias("a"), key("digest").alias("b")).distinct()
    roots = components.components(links).select(F.col("id").alias("_key"), F.col("root").alias("_root"))
    grouped = rows.withColumn("_key", F.coalesce(key("uri"), key("digest"))).join(roots, "_key", "left").withColumn("part", F.coalesce("_root", "_key"))
    return grouped.groupBy("part").applyInPandas(fold, _ALIGNED)
