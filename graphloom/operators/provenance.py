"""Where statements come from: origins of nodes, source artifacts, membership in a graph, pruning, human decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.states import is_allowed, resolve


def node_origins(facts: DataFrame) -> DataFrame:
    """(id, facts, origin): for each end of facts (s, o, graph, source), how many it is in, and the graphs they are from, joined by '+'."""
    ends = facts.select(F.explode(F.array("s", "o")).alias("id"), "graph")
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("facts"), F.array_join(F.sort_array(F.collect_set("graph")), "+").alias("origin"))


def source_artifact(refs: Column) -> Column:
    """The first of the inputs that is an artifact; a bare one gets the prefix."""
    first = F.try_element_at(F.filter(refs, lambda r: r.startswith("artifact:") | r.startswith("artifact_")), F.lit(1))
    return F.when(first.contains(":"), first).otherwise(F.concat(F.lit("artifact:"), first))


def from_graph(graph: Column, artifact: Column, names: Column, target: str) -> Column:
    """Whether a statement is from the target graph: its own graph says so, else its artifact begins with the graph's name, else one of its names has the graph's name as a word."""
    t = target.lower()
    word = F.array_contains(F.split(F.lower(names), r"[:_\-/#.\s]+"), t)
    begins = F.lower(artifact).rlike(rf"^(artifact:)?{t}([:_]|$)")
    return F.when(graph.isNotNull(), F.lower(graph) == t).otherwise(F.coalesce(begins, F.lit(False)) | F.coalesce(word, F.lit(False)))


def missing_references(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Distinct values of the column that known (id) lacks; a release with any isn't saved."""
    wanted = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("id")).distinct()
    return wanted.join(known.select("id").distinct(), "id", "left_anti")


def pruned(provenance: DataFrame, kept: DataFrame) -> DataFrame:
    """Provenance quads (s) of assertions that kept (s) still has."""
    return provenance.join(kept.select("s").distinct(), "s", "left_semi")


def decided(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """The events that human decisions (assertion_id, event_id, accept, ts) add to a log, with allowed: whether the state they meet permits them.

    Accepting approves and declining rejects; what isn't allowed is kept as a row, and callers append only the rest.
    """
    now = resolve(log).select("assertion_id", "state")
    out = decisions.join(now, "assertion_id", "left").withColumn("to_state", F.when(F.col("accept"), "approved").otherwise("rejected"))
    return out.select("event_id", "assertion_id", F.col("state").alias("from_state"), "to_state", "ts", is_allowed(F.col("state"), F.col("to_state")).alias("allowed"))


def verified(pairs: DataFrame, verifier: Column | None = None) -> DataFrame:
    """pairs with verdict: what the verifier says, or ABSTAIN where there is none or it says nothing known."""
    said = F.lit(None).cast("string") if verifier is None else F.upper(verifier)
    return pairs.withColumn("verdict", F.when(said.isin("SAME", "DIFFERENT"), said).otherwise("ABSTAIN"))


def graph_view(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, degree) and edges (s, p, o) of facts, each once."""
    edges = facts.select("s", "p", "o").distinct()
    nodes = edges.select(F.explode(F.array("s", "o")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes, edges
