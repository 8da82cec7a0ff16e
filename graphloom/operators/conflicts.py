"""Statements that contradict each other, and which of them wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.labels import local_name


def contradictions(facts: DataFrame, opposing: DataFrame) -> DataFrame:
    """(seq, against): each fact and the first earlier one on the same s and o with an opposing predicate.

    opposing (x, y) holds in both orders; it is a table of rules and is broadcast. Statements of one
    subject, predicate and object meet as one with its first seq, so that a pair of ends with many
    statements isn't multiplied; a repetition contradicts nothing, its first statement did.
    """
    firsts = facts.withColumn("p", F.lower(local_name(F.col("p")))).groupBy("s", "p", "o").agg(F.min("seq").alias("seq"))
    rules = F.broadcast(opposing.select("x", "y").union(opposing.select("y", "x")).distinct())
    earlier = firsts.select("s", "o", F.col("p").alias("x"), F.col("seq").alias("against")).join(rules, "x").select("s", "o", F.col("y").alias("p"), "against")
    return firsts.join(earlier, ["s", "o", "p"]).where("against < seq").groupBy("seq").agg(F.min("against").alias("against"))


def functional_collisions(facts: DataFrame, functional: list[str]) -> DataFrame:
    """(seq, against): each fact with a functional predicate and the first earlier one of its s and p with another object."""
    firsts = facts.withColumn("p", F.lower(local_name(F.col("p")))).where(F.col("p").isin([f.lower() for f in functional])).groupBy("s", "p", "o").agg(F.min("seq").alias("seq"))
    # the first statement of s and p differs from all with another object; only its own object has nothing to collide with before
    first = firsts.groupBy("s", "p").agg(F.min_by("o", "seq").alias("first_o"), F.min("seq").alias("against"))
    return firsts.join(first, ["s", "p"]).where("o <> first_o").select("seq", "against")


def winner(a: str, b: str, authorities: tuple[str, ...] = (), precedence: str | None = None) -> tuple[Column, Column]:
    """Whether the struct column a wins over b, and by which tier: trusted source, confidence, predicate authority, graph, id.

    The structs have trusted, confidence, p, graph and seq. A tier decides where exactly one side has what it asks for.
    """
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    # fixed values: the names of the tiers
    tiers: list[tuple[str, Column, Column]] = [("ULTIMATE_GROUND_TRUTH_AUTHORITY", x("trusted") & ~y("trusted"), y("trusted") & ~x("trusted"))]
    cx, cy = F.coalesce(x("confidence"), F.lit(1.0)), F.coalesce(y("confidence"), F.lit(1.0))
    tiers.append(("HIGHER_EVIDENCE_CONFIDENCE_SCORE", cx > cy, cy > cx))
    if authorities:
        ax, ay = (local_name(c).isin(*authorities) for c in (x("p"), y("p")))
        tiers.append(("PREDICATE_SOURCE_AUTHORITY", ax & ~ay, ay & ~ax))
    if precedence:
        gx, gy = x("graph") == precedence, y("graph") == precedence
        tiers.append((f"{precedence.upper()}_DEFAULT_PRECEDENCE", gx & ~gy, gy & ~gx))
    won, tier = None, None
    for name, first, second in tiers:
        won = F.when(first, True).when(second, False) if won is None else won.when(first, True).when(second, False)
        tier = F.when(first | second, name) if tier is None else tier.when(first | second, name)
    return won.otherwise(x("seq") < y("seq")), tier.otherwise("DETERMINISTIC_ID_ORDER")


_FOLDED = "seq long, kept boolean, reason string, against long"


def fold(facts: DataFrame, opposing: list[tuple[str, str]], functional: list[str], reject: bool) -> DataFrame:
    """(seq, kept, reason, against) of facts in the order of seq, where what was kept before decides about what comes.

    A repeated statement, a contradiction or a collision is noted; with reject, repetitions and the losers of conflicts
    are dropped, an earlier loser in favour of the later winner, which joins the kept ones but is not compared with later ones. Higher
    confidence wins, then the smaller seq. Aggregation settles repetitions, and keeps what can't be in a conflict: statements
    whose ends have no two opposing predicates and whose predicate isn't functional or has one object. The rest runs through the
    tasks subject by subject, sorted, so a task holds one subject's disputed statements at a time.
    """
    rules = {(a.lower(), b.lower()) for a, b in opposing} | {(b.lower(), a.lower()) for a, b in opposing}
    single = sorted({f.lower() for f in functional})
    keyed = facts.withColumn("_p", F.lower(local_name(F.col("p"))))
    first = keyed.groupBy("s", "_p", "o").agg(F.min("seq").alias("seq"), F.min_by("confidence", "seq").alias("confidence"))
    repeats = keyed.join(first.select("s", "_p", "o", F.col("seq").alias("against")), ["s", "_p", "o"]).where("seq <> against")
    repeats = repeats.select("seq", F.lit(not reject).alias("kept"), F.lit("repetition").alias("reason"), "against")

    has = lambda p: F.bool_or(F.col("_p") == p)
    both = F.lit(False)
    for a, b in rules:
        both = both | (has(a) & has(b))
    ends = first.groupBy("s", "o").agg(both.alias("opposed")).where("opposed")
    many = first.where(F.col("_p").isin(single)).groupBy("s", "_p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("collides", F.lit(True)).drop("n")
    marked = first.join(ends, ["s", "o"], "left").join(many, ["s", "_p"], "left")
    disputed = F.coalesce("opposed", F.lit(False)) | F.coalesce("collides", F.lit(False))
    calm = marked.where(~disputed).select("seq", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("against"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, by_so, by_sp, out = None, {}, {}, {}

        def settled() -> pd.DataFrame:
            rows = pd.DataFrame([(k, *v) for k, v in out.items()], columns=["seq", "kept", "reason", "against"])
            return rows.astype({"seq": "int64", "kept": "bool", "against": "Int64"})

        for rows in batches:
            done = []
            for s, p, o, seq, confidence in zip(rows["s"], rows["_p"], rows["o"], rows["seq"], rows["confidence"]):
                if s != subject:
                    done.append(settled())
                    subject, by_so, by_sp, out = s, {}, {}, {}
                now = (p, o, seq, 1.0 if pd.isna(confidence) else confidence)
                other, reason = next((e for e in by_so.get(o, ()) if (e[0], p) in rules), None), "contradiction"
                if other is None and p in single:
                    other, reason = next((e for e in by_sp.get(p, ()) if e[1] != o), None), "collision"
                if other is None:
                    out[seq] = [True, None, None]
                else:
                    wins = now[3] > other[3]
                    out[seq] = [not reject or wins, reason, other[2]]
                    if reject:
                        out[other[2]][0] &= not wins
                        continue
                by_so.setdefault(o, []).append(now)
                by_sp.setdefault(p, []).append(now)
            if any(len(x) for x in done):
                yield pd.concat([x for x in done if len(x)])
        if out:
            yield settled()

    rest = marked.where(disputed).select("s", "_p", "o", "seq", "confidence")
    return rest.repartition("s").sortWithinPartitions("s", "seq").mapInPandas(run, _FOLDED).union(repeats).union(calm)


#: What is done with a repetition and with a conflict in each mode.
ACTIONS = {
    "preserve": ("EXACT_TRIPLE_PRESERVED", "PRESERVED_BOTH_CLAIMS"),
    "review": ("EXACT_TRIPLE_PRESERVED", "FLAGGED_FOR_HUMAN_REVIEW"),
    "reject": ("EXACT_TRIPLE_PURGED", "REJECTED_LOSING_CLAIM"),
    "policy": ("EXACT_TRIPLE_PURGED", "REJECTED_LOSING_CLAIM"),
}


def resolve(facts: DataFrame, opposing: list[tuple[str, str]], functional: list[str], mode: str) -> DataFrame:
    """fold() in one of the modes of ACTIONS, with action, and review: whether a person has to look at it.

    preserve and review keep everything, and then what comes first decides nothing: conflicts come from joins of aggregates alone, however
    many statements a subject has. reject and policy drop repetitions and losers.
    """
    repetition, conflict = ACTIONS[mode]
    if mode in ("reject", "policy"):
        found = fold(facts, opposing, functional, reject=True)
    else:
        keyed = facts.withColumn("_p", F.lower(local_name(F.col("p"))))
        first = keyed.groupBy("s", "_p", "o").agg(F.min("seq").alias("against"))
        repeats = keyed.join(first, ["s", "_p", "o"]).where("seq <> against").select("seq", F.lit("repetition").alias("reason"), "against")
        rules = facts.sparkSession.createDataFrame(opposing, "x string, y string")
        opposed = contradictions(facts, rules).withColumn("reason", F.lit("contradiction")).select("seq", "reason", "against")
        single = functional_collisions(facts, functional).withColumn("reason", F.lit("collision")).select("seq", "reason", "against")
        noted = repeats.union(opposed).union(single.join(opposed.select("seq"), "seq", "left_anti"))
        found = facts.select("seq").join(noted, "seq", "left").select("seq", F.lit(True).alias("kept"), "reason", "against")
    action = F.when(F.col("reason") == "repetition", repetition).when(F.col("reason").isNotNull(), conflict)
    return found.withColumns({"action": action, "review": F.coalesce(F.col("action") == "FLAGGED_FOR_HUMAN_REVIEW", F.lit(False))})


#: The source whose statements with a predicate are preferred.
PREFERRED_SOURCES = {"disease_cross_reference": "mondo", "encodes": "hgnc", "targets": "chembl", "treats": "chembl"}
STRATEGIES = ("preserve_source_specific_assertions", "preserve_conflict_and_review", "preferred_source_wins_with_provenance")


def by_authority(a: str, b: str, strategy: str, preferred: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(winner, review) of a conflict of the struct columns a and b (p, source, seq) by a strategy of STRATEGIES.

    winner is a seq, or null where both are kept. The preferred source of a's predicate wins if exactly one side is of
    it, else a person has to look; without a preferred source a wins. Sources are compared in lower case.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy != STRATEGIES[2]:
        return F.lit(None).cast("long"), F.lit(strategy == STRATEGIES[1])
    rules = PREFERRED_SOURCES if preferred is None else preferred
    first = F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), F.col(f"{a}.p"))
    of = lambda x: F.coalesce(F.lower(F.col(f"{x}.source")), F.lit("")) == first
    won = F.when(first.isNull(), F.col(f"{a}.seq")).when(of(a) & ~of(b), F.col(f"{a}.seq")).when(of(b) & ~of(a), F.col(f"{b}.seq"))
    return won, won.isNull()
