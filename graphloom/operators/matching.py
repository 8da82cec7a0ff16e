"""Candidate pairs of two graphs' entities, their scores, and what the scores decide."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphloom.functions import labels, python_exact
from graphloom.operators.skew import mark_members, possible_members, spread_join
from graphloom.scratch import drop_table, write_table

#: Weights of the signals in the composite score.
WEIGHTS = {"exact_id": 1.0, "label": 0.75, "structure": 0.3, "embedding": 0.35}


def blocked_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b) of entities that share a blocking key; a and b have id and keys (an array of strings).

    A key as common as all entities makes as many pairs as there are; callers choose keys that tell
    entities apart.
    """
    x = a.select(F.col("id").alias("id_a"), F.explode(F.array_distinct("keys")).alias("key"))
    y = b.select(F.col("id").alias("id_b"), F.explode(F.array_distinct("keys")).alias("key"))
    return x.join(y, "key").select("id_a", "id_b").distinct()


def similar_sets(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b, similarity) of all pairs of sets with a Jaccard similarity of threshold or more, exactly.

    a and b have id and tokens. Two such sets share one of their rarest tokens, of which a set of n has
    n - ceil(threshold * n) + 1 to look at; so only rare tokens are joined, however common others are. Where they first meet, both
    must have enough tokens left, or the pair is dropped before its sets are compared.
    Equal sets are compared once, whatever the number of ids. Empty sets and null ids are similar to none.
    """
    sets = lambda df, side: df.where("id is not null and size(tokens) > 0").select("id", F.array_sort(F.array_distinct("tokens")).alias("tokens")).withColumn("side", F.lit(side))
    both = sets(a, "a").union(sets(b, "b"))
    distinct = both.select("side", "tokens").distinct()
    counts = distinct.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rated = distinct.select("side", "tokens", F.explode("tokens").alias("token")).join(counts, "token")
    order = rated.groupBy("side", "tokens").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("rare"))
    looked = F.size("tokens") - F.ceil(F.size("tokens") * F.lit(threshold) - 1e-9).cast("int") + 1
    heads = order.select("side", "tokens", F.posexplode(F.slice("rare", F.lit(1), looked)).alias("at", "r")).select("side", "tokens", "r.token", F.size("tokens").alias("n"), (F.size("tokens") - F.col("at")).alias("left"))
    x = heads.where("side = 'a'").select(F.col("tokens").alias("ta"), "token", F.col("n").alias("na"), F.col("left").alias("left_a"))
    y = heads.where("side = 'b'").select(F.col("tokens").alias("tb"), "token", F.col("n").alias("nb"), F.col("left").alias("left_b"))
    size_fits = F.least("left_a", "left_b") >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = x.join(y, "token").where(size_fits).select("ta", "tb", labels.jaccard(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") >= threshold).distinct()
    ids = lambda side, t, name: both.where(F.col("side") == side).select(F.col("tokens").alias(t), F.col("id").alias(name)).distinct()
    return pairs.join(ids("a", "ta", "id_a"), "ta").join(ids("b", "tb", "id_b"), "tb").select("id_a", "id_b", "similarity")


def identity_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b, property) of entities with the same value of an identity property; a and b have id, property, value. Values compare without case and outer white space."""
    norm = F.lower(F.trim("value"))
    x = a.select(F.col("id").alias("id_a"), "property", norm.alias("v")).where("v <> ''").distinct()
    y = b.select(F.col("id").alias("id_b"), "property", norm.alias("v")).where("v <> ''").distinct()
    return x.join(y, ["property", "v"]).select("id_a", "id_b", "property").distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbour) over edges (s, o) in both directions, each once."""
    return edges.select(F.col("s").alias("id"), F.col("o").alias("neighbour")).union(edges.select("o", "s")).distinct()


def shared_neighbours(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs (id_a, id_b) with structure: the Jaccard similarity of their neighbours (id, neighbour), which may be labels."""
    na, nb = (x.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")) for x in (a, b))
    x = pairs.join(a.distinct().select(F.col("id").alias("id_a"), "neighbour"), "id_a")
    common = x.join(b.distinct().select(F.col("id").alias("id_b"), "neighbour"), ["id_b", "neighbour"]).groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("common"))
    out = pairs.join(common, ["id_a", "id_b"], "left").join(na.select(F.col("id").alias("id_a"), F.col("n").alias("na")), "id_a", "left").join(nb.select(F.col("id").alias("id_b"), F.col("n").alias("nb")), "id_b", "left")
    return out.withColumn("structure", F.coalesce(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), F.lit(0.0))).drop("common", "na", "nb")


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, neighbour) over edges (s, o) in both directions, as often as they come."""
    at = lambda x, y: F.struct(F.col(x).alias("id"), F.col(y).alias("neighbour"))
    return edges.select(F.inline(F.array(at("s", "o"), at("o", "s"))))


def neighbour_labels(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, neighbour): the labels of each entity's neighbours over edges (s, o); a neighbour that is no entity has its id's label. Ids compare without case."""
    known = entities.groupBy(F.lower("id").alias("key")).agg(F.max("label").alias("known"))
    near = neighbours(edges.select(F.lower("s").alias("s"), F.lower("o").alias("o"))).join(known.withColumnRenamed("key", "neighbour"), "neighbour", "left")
    named = near.select(F.col("id").alias("key"), F.coalesce("known", labels.label(F.col("neighbour"))).alias("neighbour")).distinct()
    return entities.select("id", F.lower("id").alias("key")).join(named, "key").select("id", "neighbour").distinct()


def _label_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label_a, label_b) of labels that share a token of three letters or more, each pair once: where their first shared token meets."""
    split = lambda x, s: x.select(F.col("label").alias(f"label_{s}")).distinct().withColumn(f"t{s}", F.filter(F.array_distinct(F.split(f"label_{s}", " ")), lambda t: F.length(t) >= 3))
    x, y = (split(df, s).withColumn("token", F.explode(f"t{s}")) for df, s in ((a, "a"), (b, "b")))
    return spread_join(x, y, "token").where(F.array_min(F.array_intersect("ta", "tb")) == F.col("token")).select("label_a", "label_b")


def _label_scores(pairs: DataFrame, threshold: float) -> DataFrame:
    """pairs (label_a, label_b) with label, their score, where it is above 0."""
    la, lb = F.col("label_a"), F.col("label_b")
    inside = (F.least(F.length(la), F.length(lb)) >= 3) & (la.contains(lb) | lb.contains(la))
    far = F.floor((1 - threshold) * (F.length(la) + F.length(lb)) + 1e-9).cast("int")  # the edits of a pair whose ratio reaches the threshold
    near = (la != lb) & (python_exact.ratio_bound(la, lb) >= threshold - 1e-9) & (F.call_function("levenshtein", la, lb, far) >= 0)
    rated = pairs.withColumns({"inside": inside, "jaccard": labels.jaccard(labels.tokens(la), labels.tokens(lb)), "near": near})
    rated = rated.where((la == lb) | F.col("near") | F.col("inside") | (F.col("jaccard") >= threshold))
    plain = rated.where(~F.col("near")).withColumn("ratio", F.lit(0.0))
    matched = rated.where("near").repartition(*[F.col(c) for c in ("label_a", "label_b")]).withColumn("ratio", python_exact.ratio_from(threshold)(la, lb))
    label = label_score(la == lb, F.greatest("ratio", "jaccard"), F.col("inside"), threshold)
    return plain.union(matched).select("label_a", "label_b", label.alias("label")).where("label > 0")


def scored_pairs(a: DataFrame, b: DataFrame, near_a: DataFrame, near_b: DataFrame, identity: DataFrame | None = None, threshold: float = 0.7, small: int = 1000) -> DataFrame:
    """(id_a, id_b, label_a, label_b, exact, label, structure, score, method) of all candidates of two graphs' entities (id, label) with a score above 0.

    Candidates share their id, a row (id_a, id_b) of identity, a label token of three letters or more, or a neighbour's label
    in near_a and near_b (id, neighbour); where there are at most small pairs, all are candidates. Labels are scored once
    per pair of labels, by the larger of matching_ratio and Jaccard similarity from the threshold on, else by containment.
    An empty label shares nothing.
    """
    a, b = (write_table(x.where("id is not null").select("id", F.coalesce("label", F.lit("")).alias("label"))) for x in (a, b))
    near_a, near_b = write_table(near_a), write_table(near_b)
    named = lambda x, s: x.select(F.col("id").alias(f"id_{s}"), F.col("label").alias(f"label_{s}"))
    exact = a.join(b.select("id"), "id").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    if identity is not None:
        exact = exact.union(identity.select("id_a", "id_b").join(a.select(F.col("id").alias("id_a")), "id_a").join(b.select(F.col("id").alias("id_b")), "id_b").select("id_a", "id_b"))
    side = lambda x, s: x.where("neighbour <> ''").select("neighbour", F.col("id").alias(f"id_{s}"))
    common = spread_join(side(near_a, "a"), side(near_b, "b"), "neighbour").groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("common"))
    signals = exact.distinct().select("id_a", "id_b", F.lit(1.0).alias("exact"), F.lit(0).cast("long").alias("common")).union(common.select("id_a", "id_b", F.lit(0.0), "common"))
    signals = write_table(signals.groupBy("id_a", "id_b").agg(F.max("exact").alias("exact"), F.sum("common").alias("common")))
    full = lambda x: x.where("label <> ''")
    if a.count() * b.count() <= small:
        met = full(a).select(F.col("label").alias("label_a")).distinct().crossJoin(full(b).select(F.col("label").alias("label_b")).distinct())
    else:
        met = _label_pairs(full(a), full(b))
    by_token = write_table(_label_scores(met, threshold))
    pairs = signals.join(named(a, "a"), "id_a").join(named(b, "b"), "id_b")
    others = pairs.where("label_a <> '' and label_b <> ''").select("label_a", "label_b").distinct().join(by_token, ["label_a", "label_b"], "left_anti")
    scores = by_token.withColumn("token", F.lit(True)).union(_label_scores(others, threshold).withColumn("token", F.lit(False)))
    scores = write_table(scores)
    wide = scores.where("token").join(named(a, "a"), "label_a").select("id_a", "label_b", "label")
    wide = spread_join(wide, named(b, "b"), "label_b").select("id_a", "id_b", "label", F.lit(0.0).alias("exact"), F.lit(0).cast("long").alias("common"))
    rest = pairs.join(scores.where("not token").drop("token"), ["label_a", "label_b"], "left").select("id_a", "id_b", F.coalesce("label", F.lit(0.0)).alias("label"), "exact", "common")
    all_pairs_ = wide.union(rest).groupBy("id_a", "id_b").agg(*[F.max(c).alias(c) for c in ("label", "exact", "common")])
    degree = lambda x, s: x.groupBy("id").agg(F.count(F.lit(1)).alias(f"n{s}"), F.max(F.when(F.col("neighbour") == "", 1).otherwise(0)).alias(f"e{s}")).withColumnRenamed("id", f"id_{s}")
    out = all_pairs_.join(named(a, "a").join(degree(near_a, "a"), "id_a", "left"), "id_a").join(named(b, "b").join(degree(near_b, "b"), "id_b", "left"), "id_b")
    shared = F.col("common") + F.coalesce(F.col("ea") * F.col("eb"), F.lit(0))
    structure = F.coalesce(shared / (F.col("na") + F.col("nb") - shared), F.lit(0.0))
    out = out.withColumn("structure", structure)
    score = python_exact.round4(composite({"exact_id": F.col("exact"), "label": F.col("label"), "structure": F.col("structure")}))
    return out.select("id_a", "id_b", "label_a", "label_b", "exact", "label", "structure", score.alias("score"), method(F.col("exact"), F.col("label"), F.col("structure")).alias("method"))


@dataclass
class ClassScores:
    """Scores of the pairs with the same id or similar labels, without a row for each: most have no signal but their labels.

    a and b are entities (id, label). classes are the pairs of similar labels (label_a, label_b, score, method), with what their entities score
    by label alone. met are the pairs (id_a, id_b, label_a, label_b, similar, score, method) that share their id or a neighbour; similar says that their labels are a row of classes too.
    """

    a: DataFrame
    b: DataFrame
    classes: DataFrame
    met: DataFrame

    def rows(self) -> DataFrame:
        """(id_a, id_b, score, method) of all pairs. Pairs of a class are made where its entities meet, and are not shuffled."""
        known = self.met.where("similar").groupBy("id_a").agg(F.collect_list("id_b").alias("known"))
        x = self.a.select(F.col("id").alias("id_a"), F.col("label").alias("label_a")).join(self.classes, "label_a").join(known, "id_a", "left")
        plain = spread_join(x, self.b.select(F.col("id").alias("id_b"), F.col("label").alias("label_b")), "label_b")
        plain = plain.where(F.col("known").isNull() | ~F.array_contains("known", F.col("id_b")))
        return self.met.select("id_a", "id_b", "score", "method").union(plain.select("id_a", "id_b", "score", "method"))

    def counts(self) -> DataFrame:
        """(decision, method, pairs): the pairs of classes are counted by their labels' entities."""
        decided = [band(F.col("score")).alias("decision"), "method"]
        count = lambda df, s: df.groupBy(F.col("label").alias(f"label_{s}")).agg(F.count(F.lit(1)).alias(f"n{s}"))
        all_of = self.classes.join(count(self.a, "a"), "label_a").join(count(self.b, "b"), "label_b").select(*decided, (F.col("na") * F.col("nb")).alias("pairs"))
        twice = self.met.where("similar").select("label_a", "label_b").join(self.classes, ["label_a", "label_b"]).select(*decided, F.lit(-1).cast("long").alias("pairs"))
        every = all_of.union(twice).union(self.met.select(*decided, F.lit(1).cast("long").alias("pairs")))
        return every.groupBy("decision", "method").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")

    def merged(self) -> DataFrame:
        """(id_a, id_b) of the pairs that merge. Labels alone score 0.95 of their weight at most, which merges nothing."""
        return self.met.where(band(F.col("score")) == "MERGE").select("id_a", "id_b")

    def best(self, k: int) -> DataFrame:
        """The k best (id_a, id_b, score) of each id_a with their rank, by score, then by id.

        A shared id or neighbour only adds to what a pair's labels score, so the best are among the k best by label and the pairs that share one.
        """
        first = lambda df, by, order: df.withColumn("_n", F.row_number().over(W.Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
        few = first(self.b.select(F.col("label").alias("label_b"), F.col("id").alias("id_b")), "label_b", ["id_b"])
        by_label = first(self.classes.select("label_a", "label_b", "score").join(few, "label_b"), "label_a", [F.desc("score"), "id_b"])
        plain = self.a.select(F.col("id").alias("id_a"), F.col("label").alias("label_a")).join(by_label, "label_a").select("id_a", "id_b", "score")
        return best_candidates(plain.union(self.met.select("id_a", "id_b", "score")).groupBy("id_a", "id_b").agg(F.max("score").alias("score")), k)


def _neighbours_of(a: DataFrame, b: DataFrame, near_a: DataFrame, near_b: DataFrame) -> DataFrame:
    """(id, neighbour, held), each once: held is 1 where near_a has the row, 2 where near_b has it, 3 where both have. Of near_a only the ids of a are kept, and few others, and
    of near_b those of b."""
    kept = lambda near, x, n: possible_members(near, "id", x.select(F.lower("id"))).select("id", "neighbour", F.lit(n).alias("held"))
    return kept(near_a, a, 1).union(kept(near_b, b, 2)).groupBy("id", "neighbour").agg(F.bit_or("held").alias("held"))


def class_scores(a: DataFrame, b: DataFrame, near_a: DataFrame, near_b: DataFrame, threshold: float = 0.7) -> ClassScores:
    """The scores of entities (id, label) with the same id or with labels that are equal or have a Jaccard similarity from the threshold on; near_a and near_b have
    the neighbours (id, neighbour) of lower-cased ids, which may come again. Nulls and empty labels pair with none."""
    a, b = (write_table(x.where("id is not null and label <> ''").select("id", "label")) for x in (a, b))
    near = write_table(_neighbours_of(a, b, near_a, near_b))
    named = lambda x, s: x.select(F.col("id").alias(f"id_{s}"), F.col("label").alias(f"label_{s}"))
    la, lb = F.col("label_a"), F.col("label_b")
    jaccard = labels.jaccard(labels.tokens(la), labels.tokens(lb))
    inside = (F.least(F.length(la), F.length(lb)) >= 3) & (la.contains(lb) | lb.contains(la))

    def scored(df: DataFrame, exact: Column, structure: Column) -> DataFrame:
        df = df.withColumns({"exact": exact, "structure": structure, "label": label_score(la == lb, jaccard, inside, threshold)})
        score = F.round(composite({"exact_id": F.col("exact"), "label": F.col("label"), "structure": F.col("structure")}), 6)
        return df.withColumns({"score": score, "method": method(F.col("exact"), F.col("label"), F.col("structure"))})

    words = lambda x: x.select(F.col("label").alias("id"), labels.tokens(F.col("label")).alias("tokens")).distinct()
    alike = similar_sets(words(a), words(b), threshold).select(F.col("id_a").alias("label_a"), F.col("id_b").alias("label_b"))
    equal = a.select("label").distinct().join(b.select("label").distinct(), "label").select(F.col("label").alias("label_a"), F.col("label").alias("label_b"))
    classes = write_table(scored(alike.union(equal).distinct(), F.lit(0.0), F.lit(0.0)).select("label_a", "label_b", "score", "method"))
    held = lambda n: F.count(F.when(F.col("held").bitwiseAND(n) == n, 1))
    sizes = write_table(near.groupBy("id").agg(held(1).alias("na"), held(2).alias("nb"), F.count(F.when(F.col("held") == 3, F.col("neighbour"))).alias("common")))
    side = lambda x, s, n: x.join(near.where(F.col("held").bitwiseAND(n) == n).select(F.col("id").alias("key"), "neighbour"), F.lower(f"id_{s}") == F.col("key")).drop("key")
    x = side(named(a, "a").join(classes.select("label_a", "label_b"), "label_a"), "a", 1)
    y = side(named(b, "b").join(classes.select("label_b").distinct(), "label_b"), "b", 2)
    pair = ["id_a", "id_b", "label_a", "label_b"]
    met = x.join(y, ["label_b", "neighbour"]).where("id_a <> id_b").groupBy(*pair).agg(F.count(F.lit(1)).alias("common"))
    for s in ("a", "b"):
        met = met.join(sizes.select(F.col("id").alias("key"), f"n{s}"), F.lower(f"id_{s}") == F.col("key")).drop("key")
    same = named(a, "a").join(named(b, "b"), F.col("id_a") == F.col("id_b")).join(sizes.withColumnRenamed("id", "key"), F.lower("id_a") == F.col("key"), "left")
    met = met.union(same.select(*met.columns))
    structure = F.coalesce(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), F.lit(0.0))
    met = scored(met, F.when(F.col("id_a") == F.col("id_b"), 1.0).otherwise(0.0), structure)
    similar = (la == lb) | (jaccard >= threshold)
    met = write_table(met.select(*pair, similar.alias("similar"), "score", "method"))
    drop_table(near)
    drop_table(sizes)
    return ClassScores(a, b, classes, met)


def label_score(same: Column, similarity: Column, contained: Column, threshold: float = 0.7) -> Column:
    """0.95 for equal labels, else the similarity from the threshold on, else 0.75 for a label within the other."""
    return F.when(same, 0.95).when(similarity >= threshold, similarity).when(contained, 0.75).otherwise(0.0)


def composite(signals: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted sum of the signals, at most 1."""
    return F.least(F.lit(1.0), reduce(lambda x, y: x + y, (F.lit(weights[k]) * F.coalesce(v, F.lit(0.0)) for k, v in signals.items())))


def method(exact: Column, label: Column, structure: Column) -> Column:
    return F.when(exact >= 1, "exact_id").when(label >= 0.9, "normalized_label").when(structure >= 0.6, "structural_neighborhood").otherwise("label_similarity")


def band(score: Column, merge: float = 0.88, review: float = 0.65) -> Column:
    """What a score decides."""
    return F.when(score >= merge, "MERGE").when(score >= review, "REVIEW").otherwise("KEEP")


def best_candidates(scored: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each id_a, by score, then by id."""
    rank = F.row_number().over(W.Window.partitionBy("id_a").orderBy(F.desc("score"), "id_b"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def all_pairs(a: DataFrame, b: DataFrame, limit: int = 1000) -> DataFrame:
    """Every pair (id_a, id_b) of two small graphs; raises if there are more than limit, where blocked_pairs() is meant."""
    n, m = a.limit(limit + 1).count(), b.limit(limit + 1).count()
    if n * m > limit:
        raise ValueError(f"more than {limit} pairs; use blocked_pairs")
    return a.select(F.col("id").alias("id_a")).crossJoin(F.broadcast(b.select(F.col("id").alias("id_b"))))


def not_disjoint(pairs: DataFrame, disjoint: DataFrame) -> DataFrame:
    """pairs (with type_a, type_b) whose types no row of disjoint (x, y) excludes in either order. The table of types is counted before it is broadcast."""
    both = disjoint.select("x", "y").union(disjoint.select("y", "x"))
    keyed = pairs.withColumn("_types", F.concat_ws("\x1f", "type_a", "type_b"))
    return mark_members(keyed, "_types", both.select(F.concat_ws("\x1f", "x", "y")), "_out").where(~F.col("_out")).drop("_types", "_out")


def ratio_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """pairs (label_a, label_b) with ratio, their matching_ratio, where it reaches the threshold. Pairs whose lengths exclude that don't reach Python."""
    bound = python_exact.ratio_bound(F.col("label_a"), F.col("label_b"))
    distinct = pairs.where(bound >= threshold).select("label_a", "label_b").distinct()
    rated = distinct.withColumn("ratio", python_exact.matching_ratio("label_a", "label_b")).where(F.col("ratio") >= threshold)
    return pairs.join(rated, ["label_a", "label_b"])


def within(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b) of sets of a that are subsets of sets of b; both have id and tokens. A subset's rarest token leads to its supersets."""
    x = a.where("size(tokens) > 0").select(F.col("id").alias("id_a"), F.array_distinct("tokens").alias("ta"))
    y = b.select(F.col("id").alias("id_b"), F.array_distinct("tokens").alias("tb"))
    counts = y.select(F.explode("tb").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = x.select("id_a", "ta", F.explode("ta").alias("token")).join(counts, "token").groupBy("id_a", "ta").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return rarest.join(y.select("id_b", "tb", F.explode("tb").alias("token")), "token").where(F.size(F.array_except("ta", "tb")) == 0).select("id_a", "id_b")


def tiered_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b, score, method) of entities (id, label) by the first rule that holds: the same id, the same label, the same
    first word or half of the words in common, one label's words within the other's."""
    words = lambda x: x.where("label <> ''").withColumn("tokens", F.array_distinct(F.split("label", " ")))
    wa, wb = words(a), words(b)
    first = lambda x: x.select("id", F.array(F.element_at(F.split("label", " "), 1)).alias("keys"))
    rules = (
        (1.0, "exact_uri", a.join(b.select("id"), "id").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))),
        (0.92, "normalized_label", wa.select(F.col("id").alias("id_a"), "label").join(wb.select(F.col("id").alias("id_b"), "label"), "label").select("id_a", "id_b")),
        (0.88, "domain_symbol_match", blocked_pairs(first(wa), first(wb)).union(similar_sets(wa, wb, 0.5).select("id_a", "id_b"))),
        (0.75, "label_similarity", within(wa, wb).union(within(wb, wa).select("id_b", "id_a"))),
    )
    rated = reduce(DataFrame.union, (pairs.select("id_a", "id_b", F.struct(F.lit(s).alias("score"), F.lit(m).alias("method")).alias("r")) for s, m, pairs in rules))
    return rated.groupBy("id_a", "id_b").agg(F.max("r").alias("r")).select("id_a", "id_b", "r.*")


def overlapping_labels(nodes: DataFrame) -> DataFrame:
    """(a, b, score) of different labels (label) that share a word: 0.88 if one contains the other, else 0.78; each pair once, a before b."""
    x = nodes.select(F.lower(F.trim("label")).alias("label")).where("label <> ''").distinct()
    words = x.select("label", F.explode(F.array_distinct(F.split("label", r"\s+"))).alias("w"))
    pairs = words.select(F.col("label").alias("a"), "w").join(words.select(F.col("label").alias("b"), "w"), "w").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("score", F.when(F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")), 0.88).otherwise(0.78))
