"""Release snapshots as quads: building, exporting, reading back, and comparing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import possible_members
from graphloom.scratch import write_table

#: The names of predicates and graphs in a snapshot.
SUBJECT, PREDICATE, OBJECT, VALUE, STATE, TYPE = (f"urn:assertion:{x}" for x in ("subject", "predicate", "object", "value", "state", "type"))
RELATIONSHIP, ATTRIBUTE = "urn:assertion:RelationshipAssertion", "urn:assertion:AttributeAssertion"
APPROVED, SOURCE, PROVENANCE, METADATA = (f"urn:graph:{x}" for x in ("approved_assertion", "source_assertion", "provenance", "release_metadata"))

#: Predicates of changed rows by which transformed_by() leaves out others before it makes hashes, at most.
MAX_NAMED = 1000


def _exploded(df: DataFrame, graph: Column, node: Column, parts: list[tuple[str, Column, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind")) for p, o, kind in parts])
    return df.select(graph.alias("graph"), node.alias("s"), F.explode(rows).alias("x")).select("graph", "s", "x.*").where("o is not null")


def assertion_node(c: Column) -> Column:
    return F.concat(F.lit("urn:assertion:"), c)


def identifier_iri(c: Column) -> Column:
    return F.concat(F.lit("urn:identifier:"), c)


def relationship_quads(assertions: DataFrame) -> DataFrame:
    """Five quads for each assertion (id, s, p, o, state), in the approved graph or in the source graph."""
    graph = F.when(F.col("state") == "approved", APPROVED).otherwise(SOURCE)
    parts = [(TYPE, F.lit(RELATIONSHIP), "iri"), (SUBJECT, identifier_iri(F.col("s")), "iri"), (PREDICATE, F.concat(F.lit("urn:predicate:"), F.col("p")), "iri"), (OBJECT, identifier_iri(F.col("o")), "iri"), (STATE, F.col("state"), "literal")]
    return _exploded(assertions, graph, assertion_node(F.col("id")), parts)


def attribute_quads(assertions: DataFrame) -> DataFrame:
    """The same for assertions (id, s, p, value, state) about literals."""
    graph = F.when(F.col("state") == "approved", APPROVED).otherwise(SOURCE)
    parts = [(TYPE, F.lit(ATTRIBUTE), "iri"), (SUBJECT, identifier_iri(F.col("s")), "iri"), (PREDICATE, F.concat(F.lit("urn:predicate:"), F.col("p")), "iri"), (VALUE, F.col("value"), "literal"), (STATE, F.col("state"), "literal")]
    return _exploded(assertions, graph, assertion_node(F.col("id")), parts)


def provenance_quads(rows: DataFrame) -> DataFrame:
    """Quads of rows (id, agent, activity, at) and their refs (array), one for each input."""
    node = assertion_node(F.col("id"))
    parts = [("urn:prov:agent", F.col("agent"), "literal"), ("urn:prov:activity", F.col("activity"), "literal"), ("urn:prov:asserted_at", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), "literal")]
    refs = rows.select(F.lit(PROVENANCE).alias("graph"), node.alias("s"), F.lit("urn:prov:input_resource").alias("p"), F.explode("refs").alias("o"), F.lit("literal").alias("o_kind")).where("o is not null")
    return _exploded(rows, F.lit(PROVENANCE), node, parts).union(refs)


def evidence_quads(rows: DataFrame) -> DataFrame:
    """Quads of evidence (evidence_id, claim_id, kind, record, artifact), linked in both directions."""
    ev, claim = F.concat(F.lit("urn:evidence:"), F.col("evidence_id")), assertion_node(F.col("claim_id"))
    parts = [("urn:evidence:claim", claim, "iri"), ("urn:evidence:kind", F.col("kind"), "literal"), ("urn:evidence:record", F.col("record"), "literal"), ("urn:evidence:artifact", F.col("artifact"), "literal")]
    back = rows.select(F.lit(PROVENANCE).alias("graph"), claim.alias("s"), F.lit("urn:evidence:evidence").alias("p"), ev.alias("o"), F.lit("iri").alias("o_kind"))
    return _exploded(rows, F.lit(PROVENANCE), ev, parts).union(back)


def release_quads(releases: DataFrame) -> DataFrame:
    """Quads of releases (release_id, version, status, digest)."""
    parts = [(f"urn:release:{c}", F.col(c), "literal") for c in ("version", "status", "digest")]
    return _exploded(releases, F.lit(METADATA), F.concat(F.lit("urn:release:"), F.col("release_id")), parts)


def to_nquads(quads: DataFrame) -> DataFrame:
    """Lines (line) of an N-Quads file."""
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    text = F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    o = F.when(F.col("o_kind") == "iri", iri(F.col("o"))).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    return quads.select(F.concat(iri(F.col("s")), F.lit(" "), iri(F.col("p")), F.lit(" "), o, F.lit(" "), iri(F.col("graph")), F.lit(" .")).alias("line"))


def from_quads(quads: DataFrame) -> DataFrame:
    """Assertion rows (id, kind, s, p, o, value, state) read back from quads, the first value of each part."""
    part = lambda name, prefix="": F.regexp_replace(F.min(F.when(F.col("p") == name, F.col("o"))), f"^{prefix}", "")
    rows = quads.where(F.col("graph").isin(APPROVED, SOURCE)).groupBy("s").agg(
        part(TYPE).alias("type"), part(SUBJECT, "urn:identifier:").alias("subject"), part(PREDICATE, "urn:predicate:").alias("predicate"), part(OBJECT, "urn:identifier:").alias("object"), part(VALUE).alias("value"), part(STATE).alias("state")
    )
    kind = F.when(F.col("type") == RELATIONSHIP, "relationship").otherwise("attribute")
    return rows.select(F.regexp_replace("s", "^urn:assertion:", "").alias("id"), kind.alias("kind"), "subject", "predicate", "object", "value", "state")


def records(quads: DataFrame) -> DataFrame:
    """Comparison rows (kind, key, digest) of the approved graph: entities, relations and assertions."""
    kind = F.when(F.col("p") == SUBJECT, "entity").when(F.col("p") == OBJECT, "relation").when(F.col("p") == PREDICATE, "assertion")
    rows = quads.where(F.col("graph") == APPROVED).withColumn("kind", kind).where("kind is not null")
    key = F.when(F.col("kind") == "entity", F.col("o")).otherwise(F.concat_ws("|", "s", "o"))
    return rows.select("kind", key.alias("key"), F.sha2("o", 256).alias("digest"))


def summary(quads: DataFrame) -> DataFrame:
    return quads.groupBy("graph").agg(F.count(F.lit(1)).alias("triples"), F.countDistinct("s").alias("subjects"))


def transformed(authoritative: DataFrame, projected: DataFrame) -> DataFrame:
    """(graph, s, p) whose sets of values differ between two sets of quads."""
    key = ["graph", "s", "p"]
    values = lambda q, name: q.groupBy(*key).agg(F.sha2(F.array_join(F.sort_array(F.collect_set("o")), "\x1f"), 256).alias(name))
    return values(authoritative, "x").join(values(projected, "y"), key).where("x <> y").select(*key)


def transformed_by(quads: DataFrame, value: Column) -> DataFrame:
    """(graph, s, p) whose sets of values differ once each row's o is replaced by value: transformed() of quads and of what a rewriting makes of them.

    Every row is compared with its own new value, and only keys with a row that differs can have sets that differ. The keys' hashes and predicates are
    written, and all rows that may have such a key are read again and compared as sets, without a group of a key's values in one row. Repeated rows change
    nothing; a null is no value, and a null in the key compares with nothing. value is made twice, so it must be the same each time.
    """
    key = ["graph", "s", "p"]
    same = F.col("_x").eqNullSafe(F.col("_y"))
    rows = quads.dropna(subset=key).select(*key, F.col("o").alias("_x"), value.alias("_y"), F.xxhash64(*key).alias("_h"))
    changed = write_table(rows.where(~same).select("_h", "p"))
    named = [r["p"] for r in changed.select("p").distinct().limit(MAX_NAMED + 1).collect()]
    other = F.xxhash64(F.lit(1), "_h")
    near = possible_members(rows.where(F.col("p").isin(named)) if len(named) <= MAX_NAMED else rows, "_h", changed)
    near = possible_members(near.withColumn("_h", other), "_h", changed.select(other))  # other bits, so that few of the others stay
    side = lambda c, sides: F.struct(F.col(c).alias("v"), F.lit(sides).alias("sides"))
    values = F.when(same, F.array(side("_x", 3))).otherwise(F.array(side("_x", 1), side("_y", 2)))
    found = near.select(*key, F.explode(values).alias("_v")).select(*key, "_v.*").where("v is not null")
    return found.groupBy(*key, "v").agg(F.bit_or("sides").alias("sides")).where("sides <> 3").select(*key).distinct()


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
