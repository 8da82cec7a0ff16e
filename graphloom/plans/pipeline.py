"""Fusion from two graphs to a validated snapshot, as one plan with a table of stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import alignment, canonical, components, conflicts, matching, projections, rdf
from graphloom.scratch import write_table


@dataclass
class Fused:
    """What a fusion gives: decided pairs, roots of merged entities, facts, conflicts, quads, and counts by stage."""

    pairs: DataFrame
    roots: DataFrame
    facts: DataFrame
    conflicts: DataFrame
    quads: DataFrame
    stages: DataFrame


def fuse(entities_a: DataFrame, entities_b: DataFrame, facts: DataFrame, opposing: list[tuple[str, str]], functional: list[str], reject: bool = False, identity: DataFrame | None = None, graphs: tuple[str, str] = ("graph_a", "graph_b"), kinds: DataFrame | None = None, disjoint: DataFrame | None = None, mappings: DataFrame | None = None) -> Fused:
    """Matches entities (id, label) of two graphs, merges those that decide to, and holds the redirected facts (seq, graph, s, p, o, confidence, source) once.

    Pairs are those of matching.scored_pairs(): identity has pairs (id_a, id_b) that share an identity key, and the facts of each of
    graphs give its entities their neighbours. Pairs whose kinds (id, kind), one per id, disjoint (x, y) excludes are no pairs, and
    mappings (predicate, role, target, confidence) align predicates before conflicts are looked for; opposing and functional
    name aligned ones. Each is a stage only if it is given. Two graphs are needed: an empty one raises. Nothing is written but intermediate tables, so a dry run is to look at stages only.
    """
    if entities_a.isEmpty() or entities_b.isEmpty():
        raise ValueError("a fusion needs two graphs")
    near_a, near_b = (matching.neighbour_labels(x, facts.where(F.col("graph") == g)) for x, g in zip((entities_a, entities_b), graphs))
    scored = matching.scored_pairs(entities_a, entities_b, near_a, near_b, identity)
    found = pairs = write_table(scored.withColumn("decision", matching.band(F.col("score"))))
    if kinds is not None and disjoint is not None:
        kind = lambda x: kinds.groupBy(F.col("id").alias(f"id_{x}")).agg(F.max("kind").alias(f"type_{x}"))
        pairs = write_table(matching.not_disjoint(found.join(kind("a"), "id_a", "left").join(kind("b"), "id_b", "left"), disjoint).select(*found.columns))
    aligned = facts
    if mappings is not None:
        aligned = write_table(alignment.align_predicates(facts, mappings).withColumn("p", F.col("aligned")))
    roots = write_table(components.components(pairs.where("decision = 'MERGE'").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))))
    moved = write_table(canonical.redirect(aligned.select(*facts.columns), roots))
    folded = write_table(conflicts.fold(moved, opposing, functional, reject))
    once = write_table(canonical.held_once(moved.join(folded.where("kept or reason = 'repetition'").select("seq"), "seq")))
    quads = rdf.relationship_quads(once.select("id", "s", "p", "o", F.lit("candidate").alias("state")))
    count = lambda df, stage: df.select(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("rows"))
    stages = [count(entities_a, "entities_a"), count(entities_b, "entities_b"), count(facts, "facts_in"), count(pairs, "pairs"), count(pairs.where("decision = 'MERGE'"), "merged"), count(roots, "redirected_ids"), count(folded.where("reason in ('contradiction', 'collision')"), "conflicts"), count(once, "facts_out")]
    if pairs is not found:
        stages.append(count(found, "pairs_before_veto"))
    if mappings is not None:
        stages.append(count(aligned.where("mapped"), "aligned_facts"))
    out = stages[0]
    for s in stages[1:]:
        out = out.union(s)
    return Fused(pairs, roots, once, folded, quads, out)


def problems(fused: Fused) -> DataFrame:
    """(kind, key, status) where the quads read back differ from the facts: none in a sound snapshot."""
    back = rdf.from_quads(fused.quads).select(F.lit("fact").alias("kind"), F.col("id").alias("key"), F.sha2(F.concat_ws("|", "subject", "predicate", "object"), 256).alias("digest"))
    want = fused.facts.select(F.lit("fact").alias("kind"), F.col("id").alias("key"), F.sha2(F.concat_ws("|", "s", "p", "o"), 256).alias("digest"))
    return projections.compare(want, back, ["kind", "key"])
