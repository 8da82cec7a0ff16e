"""Queries of legacy matching tiers, provenance, view, vector search and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import labels
from graphloom.operators import alignment, lifecycle, matching, provenance, rdf, search
from graphloom.plans import fusion_queries, pipeline, worlds
from graphloom.plans.tables import table


def _sides(spark, d):
    e = fusion_queries._entities(spark, d)
    return e.where("graph = 'graph_a'").select("id", "label"), e.where("graph = 'graph_b'").select("id", "label")


def tiered_pairs(spark, d):
    return matching.tiered_pairs(*_sides(spark, d))


def ratio_pairs(spark, d):
    a, b = _sides(spark, d)
    tokens = lambda x: x.withColumn("tokens", labels.tokens(F.col("label")))
    pairs = matching.similar_sets(tokens(a), tokens(b), 0.5).select("id_a", "id_b")
    named = pairs.join(a.select(F.col("id").alias("id_a"), F.col("label").alias("label_a")), "id_a").join(b.select(F.col("id").alias("id_b"), F.col("label").alias("label_b")), "id_b")
    return matching.ratio_pairs(named, 0.85)


def overlapping_labels(spark, d):
    return matching.overlapping_labels(table(spark, d, "part").select(F.col("p_name").alias("label")))


def vector_knn(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return search.nearest_many(v, v.where("key % 100 = 0").select(F.col("key").alias("query"), F.col("vector").alias("q")), 5)


def vector_pairs(spark, d):
    """All items with a cosine of 0.3 or more to a query, every hundredth item being one."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    found = search.nearest_many(v, v.where("key % 100 = 0").select(F.col("key").alias("query"), F.col("vector").alias("q")), floor=0.3)
    return found.where("query <> key").select("query", "key")


def node_origins(spark, d):
    return provenance.node_origins(worlds.statements(spark, d))


def source_artifacts(spark, d):
    rows = table(spark, d, "release_ingestions").where("artifacts is not null")
    return rows.select("ingestion_id", provenance.source_artifact(F.filter("artifacts", lambda a: a.isNotNull())).alias("source_artifact")).where("source_artifact is not null")


def graph_membership(spark, d):
    t = table(spark, d, "canonical_entities")
    inside = provenance.from_graph(F.when(F.col("record_id") % 3 == 0, F.col("graph_id")), F.lit(None).cast("string"), F.concat_ws(":", "graph_id", "member_id"), "graph_a")
    return t.groupBy(inside.alias("inside")).agg(F.count(F.lit(1)).alias("n"))


def missing_artifacts(spark, d):
    refs = table(spark, d, "release_ingestions").select(F.explode("artifacts").alias("ref"))
    return provenance.missing_references(refs, "ref", table(spark, d, "artifacts").select(F.col("artifact_id").alias("id")))


def pruned_provenance(spark, d):
    f = worlds.statements(spark, d).where("at is not null").select(F.col("seq").cast("string").alias("id"), F.col("source").alias("agent"), F.lit("load").alias("activity"), "at", F.array("graph").alias("refs"), "confidence")
    kept = f.where("confidence >= 0.9").select(rdf.assertion_node(F.col("id")).alias("s"))
    return provenance.pruned(rdf.provenance_quads(f.drop("confidence")), kept).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def human_decisions(spark, d):
    log = worlds.log(spark, d)
    wanted = log.groupBy("assertion_id").agg(F.max("event_id").alias("event_id"), F.max("ts").alias("ts")).withColumn("accept", F.col("assertion_id") % 2 == 0)
    return provenance.decided(log, wanted.withColumn("event_id", F.col("event_id") + 1_000_000)).drop("ts")


def abstaining_verifier(spark, d):
    rows = table(spark, d, "match_pairs").where("origin = 'review_required_pairs'").select("pair_id", "score")
    return provenance.verified(rows, F.when(F.col("score") >= 0.8, "same").when(F.col("score") < 0.7, "maybe")).select("pair_id", "verdict")


def view_nodes(spark, d):
    return provenance.graph_view(worlds.statements(spark, d))[0]


def view_edges(spark, d):
    return provenance.graph_view(worlds.statements(spark, d))[1]


def smoke_checks(spark, d):
    return lifecycle.smoke(worlds.relations(spark, d), ["id", "s", "p", "o"])


#: The reference's biomedical rules: namespaces of kinds, disjoint kinds, and mappings of relations.
_KINDS = {"hgnc": "gene", "chembl": "drug", "uniprot": "protein", "mondo": "disease"}
_DISJOINT = [("gene", "disease"), ("drug", "disease")]
_MAPPINGS = [("encodes", "producesProtein", "equivalent", 1.0), ("targets", "modulates", "directed", 1.0), ("indicated_for", "treats", "equivalent", 1.0)]


def _fused(spark, d, reject):
    a, b = _sides(spark, d)
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])[F.regexp_extract(F.lower("id"), "^[a-z]+", 0)]
    mappings = alignment.directional(spark.createDataFrame(_MAPPINGS, "predicate string, target string, kind string, confidence double"))
    return pipeline.fuse(
        a, b, worlds.statements(spark, d), fusion_queries.OPPOSING, [*fusion_queries.FUNCTIONAL, "producesProtein"], reject, fusion_queries.identity_pairs(spark, d),
        kinds=a.union(b).select("id", kinds.alias("kind")).distinct(), disjoint=spark.createDataFrame(_DISJOINT, "x string, y string"), mappings=mappings,
    )


def pipeline_stages(spark, d):
    return _fused(spark, d, False).stages


def pipeline_problems(spark, d):
    return pipeline.problems(_fused(spark, d, True))


QUERIES = {f.__name__: f for f in (tiered_pairs, ratio_pairs, overlapping_labels, vector_knn, vector_pairs, node_origins, source_artifacts, graph_membership, missing_artifacts, pruned_provenance, human_decisions, abstaining_verifier, view_nodes, view_edges, smoke_checks, pipeline_stages, pipeline_problems)}

_E = f"with {fusion_queries._ENTITIES}"
ORACLES = {
    "tiered_pairs": f"""{_E}, w as (select graph, id, label, list_distinct(string_split(label, ' ')) as t, string_split(label, ' ')[1] as f from entities), x as (select a.id as id_a, b.id as id_b, a.label as la, b.label as lb, a.t as ta, b.t as tb, a.f as fa, b.f as fb from w a join w b on a.graph = 'graph_a' and b.graph = 'graph_b'),
y as (select id_a, id_b, case when id_a = id_b then 1.0::double when la = lb then 0.92::double when fa = fb or len(list_intersect(ta, tb))::double / len(list_distinct(list_concat(ta, tb))) >= 0.5 then 0.88::double when len(list_intersect(ta, tb)) = len(ta) or len(list_intersect(ta, tb)) = len(tb) then 0.75::double end as score from x)
select id_a, id_b, score, case score when 1.0 then 'exact_uri' when 0.92 then 'normalized_label' when 0.88 then 'domain_symbol_match' else 'label_similarity' end as method from y where score is not null""",
    "overlapping_labels": """with l as (select distinct lower(trim(p_name)) as l from part where p_name is not null and trim(p_name) <> ''), w as (select l, unnest(string_split(l, ' ')) as w from l)
select distinct x.l as a, y.l as b, case when contains(x.l, y.l) or contains(y.l, x.l) then 0.88::double else 0.78::double end as score from w x join w y on x.w = y.w and x.l < y.l""",
    "vector_knn": """with s as (select q.vec_id as query, v.vec_id as key, round(list_dot_product(v.embedding::double[], q.embedding::double[]), 6) as score from embeddings v, embeddings q where q.vec_id % 100 = 0 and v.embedding is not null and q.embedding is not null)
select query, key, score from s qualify row_number() over (partition by query order by score desc, key) <= 5""",
    "vector_pairs": "select q.vec_id as query, v.vec_id as key from embeddings v, embeddings q where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id and round(list_dot_product(v.embedding::double[], q.embedding::double[]), 6) >= 0.3",
    "node_origins": f"with {worlds.STATEMENTS}, e as (select unnest([s, o]) as id, graph from statements) select id, count(*) as facts, coalesce(array_to_string(list_sort(list(distinct graph) filter (graph is not null)), '+'), '') as origin from e group by id",
    "source_artifacts": "with x as (select ingestion_id, list_filter(artifacts, lambda a: a is not null and (starts_with(a, 'artifact:') or starts_with(a, 'artifact_')))[1] as a from release_ingestions where artifacts is not null) select ingestion_id, case when contains(a, ':') then a else 'artifact:' || a end as source_artifact from x where a is not null",
    "graph_membership": "select case when record_id % 3 = 0 and graph_id is not null then lower(graph_id) = 'graph_a' else coalesce(list_contains(regexp_split_to_array(lower(concat_ws(':', graph_id, member_id)), '[:_\\-/#.\\s]+'), 'graph_a'), false) end as inside, count(*) as n from canonical_entities group by 1",
    "missing_artifacts": "select distinct id from (select unnest(artifacts) as id from release_ingestions) where id is not null and id not in (select artifact_id from artifacts where artifact_id is not null)",
    "pruned_provenance": f"""with {worlds.STATEMENTS}, x as (select * from statements where "at" is not null and confidence >= 0.9) select p, n from (select unnest(['urn:prov:agent', 'urn:prov:activity', 'urn:prov:asserted_at', 'urn:prov:input_resource']) as p, unnest([count(source), count(*), count(*), count(graph)]) as n from x) where n > 0""",
    "abstaining_verifier": "select pair_id, case when score >= 0.8 then 'SAME' else 'ABSTAIN' end as verdict from match_pairs where origin = 'review_required_pairs'",
    "view_nodes": f"with {worlds.STATEMENTS}, e as (select distinct s, p, o from statements), x as (select unnest([s, o]) as id from e) select id, count(*) as degree from x group by id",
    "view_edges": f"with {worlds.STATEMENTS} select distinct s, p, o from statements",
    "smoke_checks": "select unnest(['columns', 'rows', 'keys']) as \"check\", true as ok",
}
