"""Derived datasets of a snapshot, what a profile lets into them, and their reconciliation with the snapshot."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.labels import namespace_of


@dataclass(frozen=True)
class Profile:
    """What a projection takes in: empty sets take in everything."""

    relations: tuple[str, ...] = ()
    namespaces: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    unsupported: tuple[str, ...] = ()
    on_unsupported: str = "skip"
    transformed: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        groups = [set(self.dropped), set(self.unsupported), set(self.transformed)]
        if sum(map(len, groups)) != len(set().union(*groups)):
            raise ValueError("a predicate is declared twice")
        if self.on_unsupported not in ("error", "skip", "flatten"):
            raise ValueError(f"unknown behaviour {self.on_unsupported}")


def included(profile: Profile) -> Column:
    """Whether the profile takes in a row with kind, subject, predicate and object (null for attributes)."""
    ok = F.lit(True)
    if profile.relations:
        ok = ok & F.col("predicate").isin(*profile.relations)
    if profile.dropped:
        ok = ok & ~F.col("predicate").isin(*profile.dropped)
    if profile.unsupported and profile.on_unsupported == "skip":
        ok = ok & ~F.col("predicate").isin(*profile.unsupported)
    if profile.unsupported and profile.on_unsupported == "error":
        ok = ok & F.when(F.col("predicate").isin(*profile.unsupported), F.raise_error(F.concat(F.lit("unsupported predicate "), F.col("predicate")))).otherwise(True)
    if profile.kinds:
        ok = ok & F.col("kind").isin(*profile.kinds)
    if profile.namespaces:
        ok = ok & namespace_of(F.col("subject")).isin(*profile.namespaces) & (F.col("object").isNull() | namespace_of(F.col("object")).isin(*profile.namespaces))
    return ok


def project(rows: DataFrame, profile: Profile) -> DataFrame:
    """The rows that the profile takes in, with renamed predicates; unsupported ones flattened to plain values if it says so."""
    out = rows.where(included(profile))
    name = F.col("predicate")
    for old, new in profile.transformed.items():
        name = F.when(F.col("predicate") == old, new).otherwise(name)
    flat = F.col("predicate").isin(*profile.unsupported) if profile.unsupported and profile.on_unsupported == "flatten" else F.lit(False)
    return out.withColumns({"value": F.when(flat, F.coalesce("object", "value")).otherwise(F.col("value")), "object": F.when(~flat, F.col("object")), "predicate": name})


def undeclared(rows: DataFrame, profile: Profile, preserved: tuple[str, ...]) -> DataFrame:
    """Predicates that the profile neither keeps, renames, drops nor calls unsupported."""
    declared = [*preserved, *profile.transformed, *profile.dropped, *profile.unsupported]
    return rows.select("predicate").distinct().where(~F.col("predicate").isin(*declared))


def entities(rows: DataFrame) -> DataFrame:
    """(entity_id, namespace) of subjects and objects, each once."""
    ids = rows.select(F.col("subject").alias("entity_id")).union(rows.where("object is not null").select("object")).distinct()
    return ids.select("entity_id", namespace_of(F.col("entity_id")).alias("namespace"))


def relations(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'relationship'").select(F.col("id").alias("assertion_id"), "subject", "predicate", "object", "state")


def group_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows by the column's values, nulls left out."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def search_documents(rows: DataFrame) -> DataFrame:
    """(doc_id, kind, digest, label, text): one document for each assertion, relation and subject."""
    text = F.concat_ws(" ", "subject", "predicate", F.coalesce("object", "value"))
    assertion = rows.select(F.col("id").alias("doc_id"), F.lit("assertion").alias("kind"), F.sha2("predicate", 256).alias("digest"), F.col("predicate").alias("label"), text.alias("text"))
    relation = rows.where("object is not null").select(F.concat_ws("|", "id", "object").alias("doc_id"), F.lit("relation").alias("kind"), F.sha2("object", 256).alias("digest"), F.col("object").alias("label"), text.alias("text"))
    entity = rows.select("subject").distinct().select(F.col("subject").alias("doc_id"), F.lit("entity").alias("kind"), F.sha2("subject", 256).alias("digest"), F.col("subject").alias("label"), F.col("subject").alias("text"))
    return assertion.union(relation).union(entity)


def property_graph(rows: DataFrame) -> DataFrame:
    """(id, attributes): each entity with its attributes as a JSON object, the last value by assertion id of each; keys are letters, digits and '_'."""
    key = F.concat(F.lit("attr_"), F.regexp_replace("predicate", "[^A-Za-z0-9_]", "_"))
    last = rows.where("kind = 'attribute'").groupBy("subject", key.alias("k")).agg(F.max_by("value", "id").alias("v"))
    made = last.groupBy("subject").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "k", "v"))), ";").alias("attributes"))
    return entities(rows).join(made, F.col("entity_id") == F.col("subject"), "left").select("entity_id", F.coalesce("attributes", F.lit("")).alias("attributes"))


def compare(expected: DataFrame, actual: DataFrame, keys: list[str], digest: str = "digest") -> DataFrame:
    """(keys, status) of rows that are missing, unexpected or changed; both sides have one row per key."""
    x = expected.select(*keys, F.col(digest).alias("_x"), F.lit(1).alias("_in_x"))
    y = actual.select(*keys, F.col(digest).alias("_y"), F.lit(1).alias("_in_y"))
    status = F.when(F.col("_in_y").isNull(), "missing").when(F.col("_in_x").isNull(), "unexpected").when(~F.col("_x").eqNullSafe(F.col("_y")), "changed")
    return x.join(y, keys, "full_outer").select(*keys, status.alias("status")).where("status is not null")


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, repetitions counting, and how many more the first has."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_n")).union(b.select(*cols, F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("_n").alias("more")).where("more <> 0")


def assertions(rows: DataFrame) -> DataFrame:
    """All assertions, relational and of literals, in one form."""
    return rows.select(F.col("id").alias("assertion_id"), "kind", "subject", "predicate", "object", "value", "state")


def _parts(quads: DataFrame, prefix: str) -> DataFrame:
    return quads.where(F.col("s").startswith(prefix)).withColumn("s", F.substring("s", len(prefix) + 1, 1 << 20))


def provenance(quads: DataFrame) -> DataFrame:
    """(assertion_id, agent, activity, asserted_at, method, input_assertions, input_resources) of assertions with provenance quads: the first value of each, inputs as sorted lists."""
    one = lambda p: F.min(F.when(F.col("p") == f"urn:prov:{p}", F.col("o"))).alias(p)
    many = lambda p, name: F.array_join(F.sort_array(F.collect_set(F.when(F.col("p") == f"urn:prov:{p}", F.col("o")))), ",").alias(name)
    rows = _parts(quads, "urn:assertion:").where(F.col("p").startswith("urn:prov:"))
    return rows.groupBy(F.col("s").alias("assertion_id")).agg(*map(one, ("agent", "activity", "asserted_at", "method")), many("input_assertion", "input_assertions"), many("input_resource", "input_resources"))


def evidence(quads: DataFrame) -> DataFrame:
    """(evidence_id, claim_id, kind, record_id, artifact_id, obtained_at): a row for each claim and piece of evidence that the claim's quads name."""
    links = _parts(quads, "urn:assertion:").where("p = 'urn:evidence:evidence'").select(F.col("s").alias("claim_id"), F.regexp_replace("o", "^urn:evidence:", "").alias("evidence_id")).distinct()
    one = lambda p, name: F.min(F.when(F.col("p") == f"urn:evidence:{p}", F.col("o"))).alias(name)
    about = _parts(quads, "urn:evidence:").groupBy(F.col("s").alias("evidence_id")).agg(one("kind", "kind"), one("record", "record_id"), one("artifact", "artifact_id"), one("obtained_at", "obtained_at"))
    return links.join(about, "evidence_id", "left").select("evidence_id", "claim_id", "kind", "record_id", "artifact_id", "obtained_at")


#: Ways of reconciliation.
STRATEGIES = ("rebuild", "row_by_row", "digest", "stats")


def reconcile(expected: DataFrame, actual: DataFrame, strategy: str) -> DataFrame:
    """(assertions, entities, relations, same_digest, missing, unexpected, transformed) of two sides' records (kind, key, digest), in one row.

    rebuild and row_by_row count differing rows. digest only asks whether the assertions' digests agree as a bag: if not, transformed is at least one.
    stats only counts. Digests are compared by bag sums of hashes, which don't depend on order or partitioning.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    kinds = [F.coalesce(F.sum((F.col("kind") == k).cast("int")), F.lit(0)).cast("long").alias(n) for k, n in (("assertion", "assertions"), ("entity", "entities"), ("relation", "relations"))]
    bag = lambda df, name: df.where("kind = 'assertion'").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(i), "key", "digest").cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)]).select(F.struct("n", "h0", "h1").alias(name))
    same = bag(expected, "x").crossJoin(bag(actual, "y")).select(F.col("x").eqNullSafe(F.col("y")).alias("same_digest"))  # one row each
    one = expected.agg(*kinds).crossJoin(same)
    status = F.count_if
    if strategy == "stats":
        found = None
    else:
        diff = compare(expected, actual, ["kind", "key"])
        found = diff.agg(*[status(F.col("status") == s).alias(n) for s, n in (("missing", "missing"), ("unexpected", "unexpected"), ("changed", "transformed"))])
    if found is None:
        return one.select("*", *[F.lit(0).cast("long").alias(n) for n in ("missing", "unexpected", "transformed")])
    if strategy == "digest":
        counts = {n: F.when(F.col("same_digest"), 0).otherwise(F.col(n) if n != "transformed" else F.lit(1)).cast("long") for n in ("missing", "unexpected", "transformed")}
        return one.crossJoin(found).withColumns(counts)
    return one.crossJoin(found)


def profile_checks(rows: DataFrame, profile: Profile, name: tuple[str, str], declared: tuple[str, str], dropped: list[str], unsupported: list[str]) -> DataFrame:
    """(code, status) of the four checks of a projection against its profile.

    name and declared are the profile's name and version as the projection and the profile have them; dropped and unsupported are predicates that the
    projection says it dropped or couldn't express; rows are what it holds. Unsupported data must follow the profile: error allows none, skip allows none in the rows.
    """
    held = rows.where(F.col("predicate").isin(*profile.unsupported)).isEmpty() if profile.unsupported else True
    behaved = not unsupported if profile.on_unsupported == "error" else held if profile.on_unsupported == "skip" else True
    checks = [("profile_mismatch", name == declared), ("undeclared_drop", not set(dropped) - set(profile.dropped)), ("undeclared_unsupported", not set(unsupported) - set(profile.unsupported)), ("unsupported_behavior", behaved)]
    return rows.sparkSession.createDataFrame([(code, "PASS" if ok else "FAIL") for code, ok in checks], "code string, status string")


def property_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(kind, key, status) of two property graphs' rows (kind, key, identifier, assertion_id): missing, unexpected, identifier_mismatch or assertion_mismatch; nulls equal nulls."""
    x = expected.select("kind", "key", F.struct("identifier", "assertion_id").alias("x"))
    y = actual.select("kind", "key", F.struct("identifier", "assertion_id").alias("y"))
    differ = lambda c: ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "unexpected").when(differ("identifier"), "identifier_mismatch").when(differ("assertion_id"), "assertion_mismatch")
    return x.join(y, ["kind", "key"], "full_outer").select("kind", "key", status.alias("status")).where("status is not null")
