"""How good scores and rankings are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row for rows (p in [0, 1], y 0 or 1): Brier score, expected calibration error, precision, recall and F1 at 0.5.

    A row is in the bin whose bounds i / bins enclose p, the last bin holding 1 as well. Rows with a null p or y don't count.
    """
    bounds = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    rows = rows.where("p is not null and y is not null").withColumn("bin", F.size(F.filter(bounds, lambda b: F.col("p") >= b)))
    by = rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"), F.sum("y").alias("y"), F.sum((F.col("p") - F.col("y")) ** 2).alias("sq"),
        F.sum(((F.col("p") >= 0.5) & (F.col("y") == 1)).cast("int")).alias("tp"), F.sum(((F.col("p") >= 0.5) & (F.col("y") == 0)).cast("int")).alias("fp"), F.sum(((F.col("p") < 0.5) & (F.col("y") == 1)).cast("int")).alias("fn"),
    )
    all_ = by.agg(F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.sum(F.abs(F.col("p") - F.col("y"))).alias("gap"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return all_.select("n", F.round(F.col("sq") / F.col("n"), 6).alias("brier"), F.round(F.col("gap") / F.col("n"), 6).alias("ece"), F.round(share(tp, tp + fp), 6).alias("precision"), F.round(share(tp, tp + fn), 6).alias("recall"), F.round(share(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def selective(rows: DataFrame) -> DataFrame:
    """One row for rows (decision, y) where MERGE and KEEP are answers and REVIEW is none: coverage, risk, abstention, precision, review yield."""
    answered, merged, review = F.col("decision") != "REVIEW", F.col("decision") == "MERGE", F.col("decision") == "REVIEW"
    wrong = (merged & (F.col("y") == 0)) | ((F.col("decision") == "KEEP") & (F.col("y") == 1))
    count = lambda c: F.sum(c.cast("int"))
    n = F.count(F.lit(1))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return rows.agg(
        n.alias("n"), share(count(answered), n).alias("coverage"), share(count(wrong), count(answered)).alias("risk"), share(count(review), n).alias("abstention"),
        share(count(merged & (F.col("y") == 1)), count(merged)).alias("precision"), share(count(review & (F.col("y") == 1)), count(review)).alias("review_yield"),
    )


def recall_at(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(k, recall): the share of gold pairs (q, item) that are among the first k of ranked (q, item, rank)."""
    found = gold.select("q", "item").distinct().join(ranked, ["q", "item"], "left")
    return found.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "rank").groupBy("k").agg(F.round(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("recall"))


def nearest_rank(rows: DataFrame, value: str, shares: list[float], by: list[str]) -> DataFrame:
    """(by, share, value): the smallest value with at least the share of the rows at or below it."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(W.Window.partitionBy(*by).orderBy(value))).withColumn("all", F.sum("n").over(W.Window.partitionBy(*by)))
    each = upto.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return each.where(F.col("upto") >= F.ceil(F.col("share") * F.col("all"))).groupBy(*by, "share").agg(F.min(value).alias("value"))


def benchmark(rows: DataFrame, ks: tuple[int, ...] = (10, 20, 50), bins: int = 5) -> DataFrame:
    """(metric, value) of scored candidates (q, item, p, y, decision, ms): recall at ks, precision, recall, F1 and false positive rate of MERGE, abstention, Brier score, calibration error and latency.

    y is 1 for true pairs; a candidate's rank in its q is by p, then item. A share of nothing is 0. Percentiles are by nearest rank.
    """
    rank = F.row_number().over(W.Window.partitionBy("q").orderBy(F.desc("p"), "item"))
    gold = rows.where("y = 1").select("q", "item")
    recalls = recall_at(rows.select("q", "item", rank.alias("rank")), gold, list(ks)).select(F.concat(F.lit("recall_at_"), "k").alias("metric"), F.col("recall").alias("value"))
    merged = F.col("decision") == "MERGE"
    count = lambda c: F.sum(c.cast("int"))
    share = lambda a, b: F.round(F.coalesce(F.when(b > 0, a / b), F.lit(0.0)), 6)
    tp, fp, fn, tn = count(merged & (F.col("y") == 1)), count(merged & (F.col("y") == 0)), count(~merged & (F.col("y") == 1)), count(~merged & (F.col("y") == 0))
    sums = {"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "false_positive_rate": share(fp, fp + tn), "abstention": share(count(F.col("decision") == "REVIEW"), F.count(F.lit(1)))}
    one = rows.agg(*[c.alias(n) for n, c in sums.items()]).crossJoin(calibration(rows, bins).select("brier", "ece"))  # one row each
    names = [*sums, "brier", "ece"]
    shares = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")
    times = nearest_rank(rows.select(F.lit(0).alias("all_rows"), "ms"), "ms", [0.5, 0.95, 0.99], ["all_rows"]).select(F.concat(F.lit("p"), (F.col("share") * 100).cast("int"), F.lit("_ms")).alias("metric"), F.col("value").cast("double").alias("value"))
    return recalls.union(shares).union(times)
