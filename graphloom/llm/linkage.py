"""Probabilistic record linkage across tables that share no key."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import partitions_for, salted_join
from graphloom.scratch import drop_table, write_table

#: Records with one rarest word and number whose symbols agree more rarely than this share aren't named by that word.
NAMING = 0.1
#: A word that another record of the same thing lacks more often than this share is no part of its name.
SHARED = 0.5

_GREEK = ("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa")
_ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")


def _members() -> dict[str, int]:
    """Ways to write the number of a member of a family."""
    out = {chr(ord("a") + i): i + 1 for i in range(8)} | {str(i): i for i in range(1, 100)}
    out |= {w: i + 1 for i, w in enumerate(_ROMAN)} | {w: i + 1 for i, w in enumerate(_GREEK)}
    return out | {c: i + 1 for i, c in enumerate("αβγδεζηθικ")}


def _lookup(words: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])


def name_words(name: Column) -> Column:
    """struct(words, member) of a name in any word order: its words, sorted, and the first number among them, which says which of a family it is."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{M}]+|\p{N}+"), F.lit(0))
    numbers = _lookup(_members())
    member = F.try_element_at(F.filter(F.transform(words, lambda w: F.try_element_at(numbers, w)), lambda x: x.isNotNull()), F.lit(1))
    rest = F.array_sort(F.array_distinct(F.filter(words, lambda w: F.try_element_at(numbers, w).isNull())))
    return F.struct(F.coalesce(rest, F.array().cast("array<string>")).alias("words"), member.alias("member"))


def name_parts(profiles: DataFrame) -> DataFrame:
    """profiles with stem and role in place of words, as the corpus has it: the most telling word of a name, rare and long, and its other words. A word
    that tells most in other names too comes first.

    Profiles with the same stem and member are taken to describe one thing. A word that most others of these
    lack is an abbreviation, or says something of the record only (recombinant, fragment), and is left out. A name whose
    stem profiles with all kinds of symbols share (uncharacterized) is no name, nor is one of several words
    that no other profile has any of. All numbers come from aggregations over all profiles; the list of words is
    joined, not broadcast, with the frequent ones salted.
    """
    n = profiles.count() + 1
    each = profiles.select("profile", "member", F.explode("words").alias("word"))
    counted = write_table(each.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    rated = write_table(salted_join(each, counted, ["word"], "df", F.xxhash64("profile")))
    telling_by = [(-F.length("word") * F.log(n / F.col("df"))).alias("less"), F.col("word")]
    rarest = F.min(F.struct(*telling_by))["word"]
    first = rated.groupBy("profile").agg(rarest.alias("rarest"), F.first("member").alias("member"), F.collect_list("word").alias("words"))
    same = [F.col("rarest"), F.coalesce("member", F.lit(0)).alias("m")]
    sets = write_table(first.select(*same, "words"))
    held = sets.groupBy("rarest", "m").agg(F.count(F.lit(1)).alias("held"))
    within = sets.select("rarest", "m", F.explode("words").alias("word")).groupBy("rarest", "m", "word").agg(F.count(F.lit(1)).alias("having"))
    pairs = within.join(held, ["rarest", "m"]).where("held > 1 and word <> rarest")
    shared = pairs.groupBy("word").agg(F.sum(F.col("having") * (F.col("having") - 1)).alias("both"), F.sum(F.col("having") * (F.col("held") - 1)).alias("asked"))
    empty = shared.where((F.col("asked") >= 2) & (F.col("both") < SHARED * F.col("asked"))).select("word", F.lit(True).alias("empty"))
    stems = first.groupBy(F.col("rarest").alias("word")).agg((F.count(F.lit(1)) < 2).alias("alone"))
    kept = write_table(counted.join(empty, "word", "left").where("empty is null").join(stems, "word", "left").select("word", "df", F.coalesce("alone", F.lit(True)).alias("alone")))
    whole = salted_join(each, kept, ["word"], "df", F.xxhash64("profile"))
    parts = whole.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("alone", *telling_by))).alias("w"), F.max("df").alias("most")).where("most > 1 or size(w) = 1")
    parts = parts.select("profile", F.col("w")[0]["word"].alias("stem"), F.when(F.size("w") > 1, F.array_sort(F.transform(F.slice("w", 2, 1000000), lambda x: x["word"]))).alias("role"))
    parted = write_table(profiles.drop("words").join(parts.hint("merge"), "profile", "left"))
    brief = F.coalesce("entry", short_form(F.col("own")), "own").alias("brief")
    of = parted.where("stem is not null").select("stem", F.coalesce("member", F.lit(0)).alias("m"), brief).where("brief is not null").groupBy("stem", "m", "brief").agg(F.count(F.lit(1)).cast("double").alias("n"))
    groups = of.groupBy("stem", "m").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    stems = groups.groupBy("stem").agg(F.sum("same").alias("same"), F.sum(F.col("n") * (F.col("n") - 1)).alias("all"))
    weights = parted.where("stem is not null").groupBy("stem").agg(F.count(F.lit(1)).alias("held"))
    no_names = write_table(stems.where((F.col("all") >= 12) & (F.col("same") < NAMING * F.col("all"))).join(weights, "stem").select("stem", "held"))
    unnamed = salted_join(parted.select("profile", "stem"), no_names, ["stem"], "held", F.xxhash64("profile")).select("profile", F.lit(True).alias("unnamed"))
    out = parted.join(unnamed.hint("merge"), "profile", "left")
    out = write_table(out.withColumns({c: F.when(F.col("unnamed").isNull(), F.col(c)) for c in ("stem", "role")}).drop("unnamed"))
    for t in (counted, rated, sets, kept, parted, no_names):
        drop_table(t)
    return out


def symbol(c: Column) -> Column:
    """A gene symbol's letters and digits in upper case, without a version behind a full stop, null where there are none."""
    return F.nullif(F.regexp_replace(F.upper(c), r"\.\d+\s*$|[^\p{L}\p{N}]+", ""), F.lit(""))


def short_form(s: Column) -> Column:
    """The entry name that a symbol gives: four letters of the family and the member."""
    return F.when(F.length(s) > 5, F.concat(F.substring(s, 1, 4), F.substring(s, -1, 1)))


def record(key: Column, src: str, species: Column, own: Column | None, aliases: Column | None, entry: Column | None, name: Column) -> list[Column]:
    """The columns that records of all tables have in common."""
    strings = "array<string>"
    return [
        key.cast("string").alias("key"), F.lit(src).alias("src"), species.alias("species"),
        (F.lit(None) if own is None else own).cast("string").alias("own"), (F.array().cast(strings) if aliases is None else F.coalesce(aliases, F.array().cast(strings))).alias("aliases"),
        (F.lit(None) if entry is None else entry).cast("string").alias("entry"), name_words(name).alias("n"),
    ]


def unambiguous(records: DataFrame) -> DataFrame:
    """records without the aliases that are another record's own symbol in the same table or several records' alias."""
    place = ["src", "species", "token"]
    own = records.where("own is not null").select("src", "species", F.col("own").alias("token")).distinct()
    tokens = records.select("src", "species", "key", F.explode("aliases").alias("token")).distinct()
    shared = tokens.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*place)
    bad = own.union(shared).distinct()
    kept = tokens.join(bad, place, "left_anti").groupBy("species", "key").agg(F.sort_array(F.collect_set("token")).alias("kept"))
    out = records.join(kept, ["species", "key"], "left")
    return out.withColumn("aliases", F.coalesce(F.array_intersect("aliases", "kept"), F.array().cast("array<string>"))).select(*records.columns)


def _keys(p: str = "") -> Column:
    """Blocking keys of several passes: symbols and aliases, entry names, names with any one letter left out, and either end of a name."""
    own, aliases, entry, stem, member, role = (F.col(p + c) for c in ("own", "aliases", "entry", "stem", "member", "role"))
    tokens = F.filter(F.concat(F.array(own), aliases), lambda t: t.isNotNull())
    tag = lambda kind, c: F.concat(F.lit(kind), c)
    by_symbol = F.transform(tokens, lambda t: tag("S:", t))
    by_entry = F.filter(F.concat(F.transform(tokens, lambda t: tag("M:", t)), F.transform(tokens, lambda t: tag("M:", short_form(t))), F.array(tag("M:", entry))), lambda t: t.isNotNull())
    left_out = F.when(stem.isNotNull() & member.isNotNull(), F.transform(F.sequence(F.lit(0), F.length(stem)), lambda i: F.concat(F.lit("N:"), member.cast("string"), F.lit(":"), F.when(i == 0, stem).otherwise(F.concat(stem.substr(F.lit(1), i - 1), stem.substr(i + 1, F.length(stem)))))))
    part = F.concat(member.cast("string"), F.lit(":"), F.array_join(role, " "), F.lit(":"))
    ends = F.filter(F.array(F.concat(F.lit("P:"), part, F.substring(stem, 1, 4)), F.concat(F.lit("Q:"), part, F.substring(stem, -8, 8))), lambda t: t.isNotNull())
    return F.array_distinct(F.concat(by_symbol, by_entry, F.coalesce(left_out, F.array().cast("array<string>")), ends))


def _abbreviates(short: Column, word: Column) -> Column:
    """Whether short is word with letters left out behind the first."""
    return (F.length(short) < F.length(word)) & (F.substring(short, 1, 1) == F.substring(word, 1, 1)) & F.regexp_like(word, F.concat(F.lit("^"), F.regexp_replace(short, r"(.)", r"$1.*")))


#: Levels of agreement by attribute; level 0, a value missing, says nothing.
LEVELS = {"symbol": 5, "name": 6, "role": 3}


def agreement() -> list[Column]:
    """How far the records a and b of a pair agree: 0 missing, 1 not at all, then better up to the best level."""
    a = lambda c: F.col(f"a.{c}")
    b = lambda c: F.col(f"b.{c}")
    full = lambda x: F.coalesce(x("own"), x("entry"))
    short = lambda x: F.coalesce(x("entry"), short_form(x("own")))
    also = lambda x, y: F.concat(x("aliases"), F.when(y("entry").isNotNull(), F.transform(x("aliases"), short_form)).otherwise(F.array().cast("array<string>")))
    by_entry = (a("entry").isNotNull() | b("entry").isNotNull()) & (short(a) == short(b))
    by_alias = F.array_contains(also(a, b), full(b)) | F.array_contains(also(b, a), full(a)) | F.arrays_overlap(also(a, a), also(b, b))
    sym = F.when(full(a).isNull() | full(b).isNull(), 0).when(full(a) == full(b), 4).when(by_entry, 3).when(by_alias, 2).otherwise(1)
    letters = lambda x: F.array_sort(F.split(x("stem"), ""))
    distance = F.levenshtein(a("stem"), b("stem"))
    near = (distance <= 1) | ((distance == 2) & (F.length(a("stem")) == F.length(b("stem"))) & (letters(a) == letters(b)))
    # two mistakes: four changes only where letters have swapped places
    twice = (distance <= 2) | ((distance <= 4) & (F.levenshtein(F.array_join(letters(a), ""), F.array_join(letters(b), "")) <= 1))
    stem = F.when(a("stem").isNull() | b("stem").isNull(), 0).when(a("stem") == b("stem"), 4).when(near, 3).when(twice & (distance * 3 <= F.length(a("stem"))), 2).otherwise(1)
    fewer = F.least(F.size(a("role")), F.size(b("role")))
    both = F.size(F.array_intersect(a("role"), b("role")))
    found = lambda x, y: F.size(F.filter(x("role"), lambda v: F.exists(y("role"), lambda w: (v == w) | _abbreviates(v, w) | _abbreviates(w, v))))
    role = F.when(a("role").isNull() | b("role").isNull(), 0).when(both == fewer, 2).when((found(a, b) >= fewer) | (found(b, a) >= fewer), 2).otherwise(1)
    # whether names with one stem are of one member depends on each other, so both are one attribute
    name = F.when(stem <= 1, stem).when(a("member").isNull() | b("member").isNull(), 0).when(a("member") == b("member"), stem + 1).otherwise(2)
    return [sym.alias("symbol"), name.alias("name"), role.alias("role")]


class Model:
    """What expectation-maximisation found: the share of matches, and of each attribute how often matches (m) and others (u) have each level."""

    def __init__(self, prior: float, m: list[np.ndarray], u: list[np.ndarray]):
        self.prior, self.m, self.u = prior, m, u

    def ratio(self, pattern: tuple[int, ...]) -> float:
        """The logarithm of how much likelier the pattern is among matches; a missing value says nothing."""
        return float(sum(np.log(self.m[k][level]) - np.log(self.u[k][level]) for k, level in enumerate(pattern) if level))

    def posterior(self, pattern: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.log(self.prior) - np.log1p(-self.prior) + self.ratio(pattern), -500, 500))))


def estimate(counts: dict[tuple[int, ...], float], others: dict[tuple[int, ...], float] | None = None, rounds: int = 200) -> Model:
    """Expectation-maximisation over the counts of patterns of agreement of the compared pairs, and of others, which are no matches.

    Attributes are taken as independent among matches and among others; a missing value counts
    for neither. The start is that matches agree, better levels more often, and others are as all pairs are. A
    few pairs keep the weight of the start, so that levels which few pairs have stay what they are.
    """
    sizes = list(LEVELS.values())
    others = others or {}
    patterns = np.array([*counts, *others] or [(0,) * len(sizes)], np.int64)
    weight = np.array([*counts.values(), *others.values()] or [1.0], float)
    all_pairs = max(1e-9, weight.sum())
    open_ = np.arange(len(patterns)) < len(counts)
    m0 = [np.array([0.02, *np.arange(1.0, k - 1)]) for k in sizes]
    m0 = [x / x.sum() for x in m0]
    u0 = [np.array([0.94, *np.full(k - 2, 0.06 / (k - 2))]) for k in sizes]
    m, u = ([np.array([1.0, *x]) for x in start] for start in (m0, u0))
    for k, size in enumerate(sizes):
        level = np.bincount(patterns[:, k], weight, size)[1:] + 0.5 * u0[k]
        u[k] = np.array([1.0, *(level / level.sum())])
    agreeing = open_ & ((patterns >= np.array(sizes) - 1).sum(axis=1) >= 2) & ~(patterns == 1).any(axis=1)
    prior = float(np.clip((weight * agreeing).sum() / all_pairs, 1e-15, 0.5))
    for _ in range(rounds):
        log = np.full(len(patterns), np.log(prior) - np.log1p(-prior))
        for k in range(len(sizes)):
            seen = patterns[:, k] > 0
            log[seen] += np.log(m[k][patterns[seen, k]]) - np.log(u[k][patterns[seen, k]])
        p = np.where(open_, 1 / (1 + np.exp(-np.clip(log, -500, 500))), 0.0)
        matches = float((p * weight).sum())
        prior = float(np.clip(matches / all_pairs, 1e-15, 1 - 1e-6))
        few = 3 + 0.002 * matches
        for k, size in enumerate(sizes):
            for probs, start, share, keep in ((m, m0, p * weight, few), (u, u0, (1 - p) * weight, 0.5)):
                level = np.bincount(patterns[:, k], share, size)[1:] + keep * start[k]
                probs[k] = np.array([1.0, *(level / level.sum())])
    return Model(prior, m, u)


def _pairs(n: str) -> Column:
    """Pairs of different groups' members, from the groups' sizes n."""
    return (F.pow(F.sum(n), F.lit(2)) - F.sum(F.col(n) * F.col(n))) / 2


def _both(profiles: DataFrame, **has: Column) -> list[float]:
    """Of all pairs of profiles of one species and two tables: how many there are, and how many have each value both, from counts alone."""
    counts = profiles.groupBy("species", "src").agg(F.count(F.lit(1)).cast("double").alias("all"), *[F.sum(c.cast("double")).alias(k) for k, c in has.items()])
    by = counts.groupBy("species").agg(*[_pairs(k).alias(k) for k in ("all", *has)])
    return [x or 0.0 for x in by.agg(*[F.sum(k) for k in ("all", *has)]).first()]


def _alike(profiles: DataFrame, value: Column) -> float:
    """How many of these pairs agree in a value that isn't null."""
    counts = profiles.groupBy("species", "src", value.alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n")).where("v is not null")
    return counts.groupBy("species", "v").agg(_pairs("n").alias("p")).agg(F.sum("p")).first()[0] or 0.0


def other_patterns(profiles: DataFrame, compared: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """Counts of patterns among the pairs of two tables that weren't compared: what has no block in common disagrees.

    How many pairs lack a value, or agree in role, comes from counts of the values, the attributes being taken as independent. Pairs
    with one stem but different members are members of a family, and are counted by themselves.
    """
    total, both, stems, roles = _both(profiles, symbol=F.coalesce("own", "entry").isNotNull(), named=F.col("stem").isNotNull(), role=F.col("role").isNotNull())
    same_role = _alike(profiles, F.array_join("role", " "))
    named = F.col("stem").isNotNull() & F.col("member").isNotNull()
    families = _alike(profiles, F.when(named, F.col("stem")))
    numbered = _alike(profiles, F.when(named, F.concat_ws(" ", "stem", F.col("member").cast("string"))))
    out = {(1, 2, 2): max(0.0, families - numbered)}
    left = max(0.0, total - sum(compared.values()) - sum(out.values()))
    if total:
        for s, ps in ((0, 1 - both / total), (1, both / total)):
            for n, pn in ((0, 1 - stems / total), (1, stems / total)):
                for r, pr in ((0, 1 - roles / total), (1, (roles - same_role) / total), (2, same_role / total)):
                    out[s, n, r] = out.get((s, n, r), 0.0) + left * ps * pn * pr
    return out


def _meeting(rows: DataFrame, on: str, most: int = 1_000_000) -> DataFrame:
    """Pairs of rows (on, src and others) that have one value of on and different src, src_a < src_b; no task makes many more than most of one value's pairs.

    The rows of a value and two tables are counted. Where they make more pairs, the first table's rows are cut by their hash into as many salts
    as needed, and the second's are repeated once per salt. Rows of one table never meet, however many have a value.
    """
    counts = write_table(rows.groupBy(on, "src").agg(F.count(F.lit(1)).alias("n")))
    both = counts.toDF(on, "src_a", "na").join(counts.toDF(on, "src_b", "nb").hint("merge"), on).where("src_a < src_b")
    salts = F.least(F.col("na"), F.lit(4096), F.ceil(F.col("na") * F.col("nb") / most)).cast("int")
    both = write_table(both.select(on, "src_a", "src_b", salts.alias("salts"), (F.col("na") * F.col("nb")).alias("pairs")))
    drop_table(counts)
    pairs = both.agg(F.sum("pairs")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, partitions_for(pairs, most)))
    rest = [c for c in rows.columns if c not in (on, "src")]
    side = lambda x: rows.select(on, F.col("src").alias(f"src_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in rest])
    left = side("a").join(both.drop("pairs").hint("merge"), [on, "src_a"]).withColumn("_salt", F.pmod(F.xxhash64(*[f"{c}_a" for c in rest]), F.col("salts")).cast("int")).drop("salts")
    right = side("b").join(both.drop("pairs").hint("merge"), [on, "src_b"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    keys = [on, "src_a", "src_b", "_salt"]
    return left.repartition(parts, *keys).join(right.repartition(parts, *keys).hint("merge"), keys).drop("_salt")


def link(records: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(key_a, key_b, confidence) of the pairs of records of different tables that describe the same thing.

    records are as record() makes them. Equal ones are one profile, whatever the number of copies;
    profiles meet in several passes of blocking by symbol, alias, entry name and name, the last with
    any one letter left out and by either end, so that a letter too many, too few, exchanged or
    swapped with its neighbour doesn't matter. A block that many profiles share is spread over tasks by its pairs, and all
    of them are compared. The patterns of agreement are counted, and those of pairs
    that don't meet are added as no matches (other_patterns); expectation-maximisation gives
    each pattern its probability of being a match, and this is the confidence. Records that a third one of another table links are
    linked too, if the product of the confidences, with the evidence of their own pattern, is still at the threshold.
    Records with a null key or species are in no pair; a pair of keys is given once, with key_a < key_b.
    """
    spark = records.sparkSession
    flat = unambiguous(records.where("key is not null and species is not null")).select("key", "src", "species", "own", F.sort_array("aliases").alias("aliases"), "entry", "n.words", "n.member")
    attributes = ["src", "species", "own", "aliases", "entry", "words", "member"]
    flat = write_table(flat.withColumn("profile", F.unhex(F.md5(F.to_json(F.struct(*attributes))))).distinct())
    profiles = name_parts(write_table(flat.select("profile", *attributes).dropDuplicates(["profile"])))
    attributes = ["src", "species", "own", "aliases", "entry", "stem", "role", "member"]
    # equal hashes of different keys only make a pair to compare
    blocked = profiles.select("profile", "src", F.explode(F.array_distinct(F.transform(_keys(), lambda k: F.xxhash64("species", k)))).alias("block"))
    blocked = write_table(blocked.select("block", "src", "profile"))
    pairs = _meeting(blocked, "block").select(F.col("profile_a").alias("pa"), F.col("profile_b").alias("pb")).distinct()
    side = lambda name: profiles.select(F.col("profile").alias(f"p{name}"), F.struct("profile", *attributes).alias(name)).hint("merge")
    pairs = pairs.join(side("a"), "pa").join(side("b"), "pb").where("a.species = b.species")
    compared = write_table(pairs.select("pa", "pb", F.col("a.src").alias("sa"), F.col("b.src").alias("sb"), *agreement()))
    drop_table(blocked)
    counts = {tuple(r[k] for k in LEVELS): r["count"] for r in compared.groupBy(*LEVELS).count().collect()}
    model = estimate(counts, other_patterns(profiles, counts))
    rows = [(*k, model.posterior(k), model.ratio(k)) for k in itertools.product(*(range(n) for n in LEVELS.values()))]
    rated = F.broadcast(spark.createDataFrame(rows, ", ".join(f"{k} int" for k in LEVELS) + ", confidence double, ratio double"))  # every pattern there is
    links = write_table(compared.join(rated, list(LEVELS)).where(F.col("confidence") >= threshold).select("pa", "pb", "sa", "sb", "confidence"))
    drop_table(compared)

    there = links.select(F.col("pa").alias("mid"), F.col("pb").alias("end"), F.col("sb").alias("src"), "confidence")
    back = links.select(F.col("pb").alias("mid"), F.col("pa").alias("end"), F.col("sa").alias("src"), "confidence")
    hops = write_table(there.union(back).select("mid", "src", "end", "confidence"))
    two = _meeting(hops, "mid").select(F.col("end_a").alias("pa"), F.col("end_b").alias("pb"), F.col("confidence_a").alias("ca"), F.col("confidence_b").alias("cb"))
    two = two.groupBy("pa", "pb").agg(F.max(F.col("ca") * F.col("cb")).alias("through"))
    two = two.join(side("a"), "pa").join(side("b"), "pb").select("pa", "pb", "through", *agreement()).join(rated.drop("confidence"), list(LEVELS))
    odds = F.col("through") / F.greatest(1 - F.col("through"), F.lit(1e-9)) * F.exp("ratio")
    two = two.select("pa", "pb", (odds / (1 + odds)).alias("confidence")).where(F.col("confidence") >= threshold)
    all_links = links.select("pa", "pb", "confidence").union(two)
    members = flat.select("profile", "key")
    keyed = all_links.join(members.select(F.col("profile").alias("pa"), F.col("key").alias("ka")).hint("merge"), "pa").join(members.select(F.col("profile").alias("pb"), F.col("key").alias("kb")).hint("merge"), "pb")
    return keyed.groupBy(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).agg(F.max("confidence").alias("confidence"))


def acting(molecules: DataFrame) -> DataFrame:
    """The words (word) that molecules which aren't proteins have in their names, and proteins hardly ever: what acts on a protein is named so.

    Learned from all molecules (type, name) whose type is known.
    """
    words = molecules.where("type is not null and name is not null").select((F.lower("type") == "protein").alias("is"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))).alias("word"))
    rates = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is").cast("int")).alias("proteins"))
    return rates.where((F.col("proteins") + 0.5) / (F.col("n") + 1) < 0.2).select("word")


def gene_records(hgnc: DataFrame, ensembl: DataFrame, uniprot: DataFrame, chembl: DataFrame) -> DataFrame:
    """The records of the four gene and protein tables in one form.

    A protein stands for its gene. A molecule counts if its type is protein, or missing, and no word of its name is one that other
    types have and proteins don't (acting()), as that of a molecule which acts on the protein; it is human.
    """
    docs = hgnc.select(F.explode("response.docs").alias("d"))
    aliases = F.filter(F.transform("d.alias_symbol", symbol), lambda t: t.isNotNull())
    h = docs.select(*record(F.col("d.hgnc_id"), "hgnc", F.lit("human"), symbol(F.col("d.symbol")), aliases, None, F.col("d.name")))
    species = F.when(F.col("species") == "homo_sapiens", "human").when(F.col("species") == "mus_musculus", "mouse").when(F.col("species") == "rattus_norvegicus", "rat").otherwise(F.col("species"))
    e = ensembl.select(*record(F.col("id"), "ensembl", species, symbol(F.col("display_name")), None, None, F.col("description")))
    entry, tail = F.split_part(F.upper("uniProtkbId"), F.lit("_"), F.lit(1)), F.lower(F.split_part("uniProtkbId", F.lit("_"), F.lit(2)))
    taxon = F.col("organism.taxonId")
    of_taxon = F.when(taxon == 9606, "human").when(taxon == 10090, "mouse").when(taxon == 10116, "rat")
    u = uniprot.select(*record(F.col("primaryAccession"), "uniprot", F.coalesce(of_taxon, F.nullif(tail, F.lit(""))), None, None, F.when(entry != F.upper("primaryAccession"), symbol(entry)), F.col("proteinDescription.recommendedName.fullName.value")))
    named = chembl.select(F.col("molecule_chembl_id").alias("key"), F.col("molecule_type").alias("type"), F.col("pref_name").alias("name"))
    maybe = named.where(F.coalesce(F.lower("type"), F.lit("protein")) == "protein")
    said = maybe.select("key", F.explode(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("word"))
    acts = said.join(acting(named).hint("merge"), "word").select("key").distinct()
    proteins = maybe.join(acts.hint("merge"), "key", "left_anti")
    c = proteins.select(*record(F.col("key"), "chembl", F.lit("human"), None, None, None, F.col("name")))
    return h.union(e).union(u).union(c)
