"""Mixes of sources in which each source holds a target share of the tokens."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from graphloom.scratch import write_table

#: Targets that are sampled and joined at once; more of them go in further blocks.
BLOCK_TARGETS = 10_000
#: Bins of a doubling of document size in which tokens are added up.
SIZE_BINS = 64
#: Bins of a ranking's range, and documents of one bin that are ordered one by one.
BINS, BIN_DOCUMENTS = 4096, 50_000

_PLAN = T.StructType([
    T.StructField("stratum", T.IntegerType()), T.StructField("mix_name", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.LongType()), T.StructField("mix_tokens", T.DoubleType()),
    T.StructField("source_tokens", T.LongType()), T.StructField("wanted", T.DoubleType()), T.StructField("whole", T.LongType()), T.StructField("rest", T.DoubleType()),
    T.StructField("odds", T.DoubleType()), T.StructField("last_rank", T.DoubleType()), T.StructField("last_id", T.LongType()),
])


def plan(targets: DataFrame, sizes: DataFrame) -> list[dict]:
    """One record per mix and source: the tokens wanted, the whole copies of all documents, and the tokens left to sample.

    The tokens wanted are the source's share of the mix's size, which is total_factor times the
    tokens of all documents of its listed sources. Copies of the whole source are certain, up to
    max_repeats; the rest is less than one copy. Of a mix and source listed twice the first counts,
    in the order of its numbers; rows with a null name or source are left out, null numbers are 0.
    The targets are control data, a few numbers each, which the driver holds as it holds the report.
    """
    rows = targets.select("mix_name", "source", "target_share", "max_repeats", "total_factor").where("mix_name is not null and source is not null").collect()
    first: dict[tuple[str, str], tuple] = {}
    for r in sorted(rows, key=lambda r: [x or 0 for x in r[2:]]):
        number = lambda x: float(x) if x is not None and x == x and x > 0 else 0.0
        first.setdefault((r["mix_name"], r["source"]), (number(r["target_share"]), int(r["max_repeats"] or 0), number(r["total_factor"])))
    listed = sizes.sparkSession.createDataFrame([(s,) for s in sorted({s for _, s in first})] or [("",)], "source string")
    tokens = dict(sizes.groupBy("source").agg(F.sum("tokens")).join(listed, "source", "left_semi").collect())
    out = []
    for i, ((mix, source), (share, repeats, factor)) in enumerate(sorted(first.items())):
        size = factor * sum(tokens.get(s, 0) for m, s in first if m == mix)
        own, wanted = tokens.get(source, 0), share * size
        whole = min(max(0, repeats), math.floor(wanted / own)) if own else 0
        rest = wanted - whole * own if own and whole < repeats else 0.0
        out.append({"stratum": i, "mix_name": mix, "source": source, "target_share": share, "max_repeats": repeats, "mix_tokens": size, "source_tokens": own, "wanted": wanted, "whole": whole, "rest": rest, "odds": 0.0, "last_rank": -1.0, "last_id": 0})
    return out


def set_odds(sizes: DataFrame, strata: list[dict]) -> None:
    """Sets odds: by how much a document's tokens are multiplied to give its chance of inclusion, 1 at most.

    Chances are in proportion to size, and the tokens expected of them are rest. So the largest documents
    may be certain: they are taken out, and the others share what is left. The tokens, and the squares of
    tokens, of documents of about one size are added up; the driver gets SIZE_BINS sums a doubling of size and source.
    """
    wanting = {s["source"] for s in strata if s["rest"] > 0}
    if not wanting:
        return
    listed = sizes.sparkSession.createDataFrame([(s,) for s in sorted(wanting)], "source string")
    at = F.floor(F.log2("tokens") * SIZE_BINS).cast("int").alias("bin")
    square = F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("squares")
    sums = sizes.groupBy("source", at).agg(F.sum("tokens").cast("double").alias("tokens"), square).join(listed, "source", "left_semi")
    bins: dict[str, list[tuple[int, float, float]]] = {}
    for r in sums.collect():
        bins.setdefault(r["source"], []).append((r["bin"], r["tokens"], r["squares"]))
    for s in strata:
        if s["rest"] <= 0:
            continue
        certain, squares = 0.0, sum(b[2] for b in bins[s["source"]])
        for _, tokens, own in sorted(bins[s["source"]], reverse=True):
            s["odds"] = (s["rest"] - certain) / squares
            if s["odds"] * own / tokens < 1:  # a document of this bin isn't certain, on average
                break
            certain, squares = certain + tokens, max(squares - own, 1e-9)


def _uniform(seed: int) -> Column:
    """A number in (0, 1) that depends on the mix, the source and the document only."""
    return (F.pmod(F.xxhash64(F.lit(seed), "mix_name", "source", "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _rank(seed: int) -> Column:
    """Pareto order: a document's random odds over its odds of inclusion, brought into (0, 1). Certain ones come first."""
    u, p = _uniform(seed), F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("odds") * F.col("tokens")))
    q = (u / (1 - u)) / (p / (1 - p))
    return q / (1 + q)


def _ranked(sizes: DataFrame, strata: list[dict], seed: int) -> DataFrame:
    chosen = sizes.sparkSession.createDataFrame([tuple(s[f.name] for f in _PLAN) for s in strata], _PLAN)
    return sizes.join(F.broadcast(chosen), "source").withColumn("rank", _rank(seed))


def _cut(sizes: DataFrame, strata: list[dict], seed: int) -> None:
    """Sets last_rank and last_id: the last document of each stratum's order that fits into rest, to the nearest document.

    Tokens are added up by bins of the order; the bin in which rest is reached is split into bins
    again until it holds few documents, and these are ordered.
    """
    open_ = {s["stratum"]: (0.0, 1.0, s["rest"]) for s in strata if s["rest"] > 0}
    while open_:
        bounds = sizes.sparkSession.createDataFrame([(k, a, b, need) for k, (a, b, need) in open_.items()], "stratum int, low double, high double, need double")
        inside = _ranked(sizes, [s for s in strata if s["stratum"] in open_], seed).join(F.broadcast(bounds), "stratum").where("rank >= low and rank < high")
        at = F.least(F.lit(BINS - 1), F.floor((F.col("rank") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).cast("int")
        bins = inside.groupBy("stratum", at.alias("bin")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.min("high").alias("high"), F.min("need").alias("need"))
        upto = W.Window.partitionBy("stratum").orderBy("bin")
        added = bins.withColumn("sum", F.sum("tokens").over(upto))
        hit = added.where("sum >= need").groupBy("stratum").agg(F.min_by(F.struct("bin", "n", "tokens", "sum"), "bin").alias("b"), F.min("low").alias("low"), F.min("high").alias("high"), F.min("need").alias("need"))
        found = {r["stratum"]: r for r in hit.collect()}
        few, split = {}, {}
        for k, (a, b, need) in open_.items():
            if k not in found:  # rest is all there is
                strata[k]["last_rank"] = 2.0
                continue
            r = found[k]
            width = (b - a) / BINS
            low, high = a + r["b"]["bin"] * width, b if r["b"]["bin"] == BINS - 1 else a + (r["b"]["bin"] + 1) * width
            left = need - (r["b"]["sum"] - r["b"]["tokens"])
            (few if r["b"]["n"] <= BIN_DOCUMENTS or width < 1e-15 else split)[k] = (low, high, left)
        if few:
            bounds = sizes.sparkSession.createDataFrame([(k, a, b, need) for k, (a, b, need) in few.items()], "stratum int, low double, high double, need double")
            margin = 1e-12  # bins are found by division, bounds by multiplication
            last = _ranked(sizes, [s for s in strata if s["stratum"] in few], seed).join(F.broadcast(bounds), "stratum").where((F.col("rank") >= F.col("low") - margin) & (F.col("rank") < F.col("high") + margin))
            order = W.Window.partitionBy("stratum").orderBy("rank", "id")
            fits = last.withColumn("sum", F.sum("tokens").over(order)).where(F.col("sum") - F.col("tokens") / 2 <= F.col("need"))
            ends = {r["stratum"]: r["e"] for r in fits.groupBy("stratum").agg(F.max(F.struct("rank", "id")).alias("e")).collect()}
            for k, (a, _, _) in few.items():
                strata[k]["last_rank"], strata[k]["last_id"] = (ends[k]["rank"], ends[k]["id"]) if k in ends else (a, -(1 << 63))
        open_ = split


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents, report): how often each mix takes each document, and what each source came to.

    sizes has id (long, unique), source and tokens. The whole copies of plan() are certain. For the
    rest, documents have chances of inclusion in proportion to their tokens, the largest being certain. The documents of a source
    are put in Pareto order, random odds over odds of inclusion, and
    taken from the start until the tokens are nearest to what is wanted; so a share is missed
    by half a document, except where max_repeats doesn't allow it. A run gives the same documents at
    any partitioning. Documents without tokens (null and empty texts) or without a source are in no mix.
    documents: mix_name, id, source, tokens, copies. report: a row for each mix and source of
    targets, also of sources without documents. Targets go in blocks of BLOCK_TARGETS.
    """
    sizes = write_table(sizes.select("id", "source", "tokens").where("tokens > 0 and source is not null and id is not null"))
    spark = sizes.sparkSession
    strata = plan(targets, sizes)
    set_odds(sizes, strata)
    taken = (F.col("rank") < F.col("last_rank")) | ((F.col("rank") == F.col("last_rank")) & (F.col("id") <= F.col("last_id")))
    copies = F.col("whole") + F.when((F.col("rest") > 0) & taken, 1).otherwise(0)
    documents = None
    for at in range(0, max(1, len(strata)), BLOCK_TARGETS):
        block = [s | {"stratum": i} for i, s in enumerate(strata[at : at + BLOCK_TARGETS])]
        _cut(sizes, block, seed)
        part = _ranked(sizes, block, seed).withColumn("copies", copies).where("copies > 0").select("mix_name", "id", "source", "tokens", "copies")
        documents = part if documents is None else documents.union(part)
    sums = documents.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    planned = spark.createDataFrame([tuple(s[f.name] for f in _PLAN) for s in strata], _PLAN)
    report = planned.join(sums, ["mix_name", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
    whole = F.sum("tokens").over(W.Window.partitionBy("mix_name"))  # as many rows as targets
    report = report.select(
        "mix_name", "source", "target_share", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"),
        F.when(F.col("source_tokens") > 0, F.col("tokens") / F.col("source_tokens")).otherwise(0.0).alias("repeats"),
        "tokens", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("actual_share"),
        F.when(F.col("mix_tokens") > 0, F.col("tokens") / F.col("mix_tokens")).otherwise(0.0).alias("share_of_planned"),
    )
    return documents, report
