"""Queries of the fusion of two graphs: matching, alignment, canonical facts and conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import labels, literals
from graphloom.operators import alignment, canonical, components, conflicts, matching, states
from graphloom.plans import worlds
from graphloom.plans.tables import table
from graphloom.scratch import write_table

OPPOSING = [("treats", "contraindicated_in"), ("associated_with", "not_associated_with")]
FUNCTIONAL = ["encodes", "subtype_of"]


def _entities(spark, d):
    """(graph, id, label): each graph's entities with the label of their last record that has one."""
    rows = table(spark, d, "canonical_entities").where("label is not null and member_id is not null").withColumn("label", labels.label(F.col("label"))).where("label <> ''")
    return rows.groupBy(F.col("graph_id").alias("graph"), F.col("member_id").alias("id")).agg(F.max_by("label", "record_id").alias("label"))


_ENTITIES = r"""
named as (
  select graph_id as graph, member_id as id, record_id, case when starts_with(t, '<') and ends_with(t, '>') and length(t) >= 2 then t[2:-2] else t end as t
  from (select *, regexp_replace(label, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as t from canonical_entities where label is not null and member_id is not null)
), cut as (select *, case when contains(t, '#') then string_split(t, '#')[-1] when contains(t, '/') then string_split(t, '/')[-1] else t end as u from named),
cut2 as (select *, case when contains(u, ':') and not starts_with(u, 'urn:') then substring(u, instr(u, ':') + 1) else u end as v from cut),
labelled as (select graph, id, record_id, trim(regexp_replace(regexp_replace(lower(v), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) as label from cut2),
entities as (select graph, id, arg_max(label, record_id) as label from labelled where label <> '' group by all)
"""


def blocked_pairs(spark, d):
    e = _entities(spark, d).withColumn("keys", F.array(F.concat(F.lit("id:"), "id"), F.concat(F.lit("label:"), "label")))
    return matching.blocked_pairs(e.where("graph = 'graph_a'"), e.where("graph = 'graph_b'"))


def similar_labels(spark, d):
    e = _entities(spark, d).withColumn("tokens", labels.tokens(F.col("label")))
    found = matching.similar_sets(e.where("graph = 'graph_a'"), e.where("graph = 'graph_b'"), 0.7)
    return found.withColumn("similarity", F.round("similarity", 6))


def identity_pairs(spark, d):
    rows = table(spark, d, "canonical_entities").where("source_canonical_id is not null").select(F.col("graph_id").alias("graph"), F.col("member_id").alias("id"), F.lit("source").alias("property"), F.concat("source_canonical_id", F.lit("|"), F.col("label")).alias("value")).where("value is not null")
    return matching.identity_pairs(rows.where("graph = 'graph_a'"), rows.where("graph = 'graph_b'"))


def _scored(spark, d):
    e, facts = _entities(spark, d), worlds.statements(spark, d)
    near = lambda g: matching.both_ways(facts.where(F.col("graph") == g).select(F.lower("s").alias("s"), F.lower("o").alias("o")))
    return matching.class_scores(e.where("graph = 'graph_a'"), e.where("graph = 'graph_b'"), near("graph_a"), near("graph_b"))


def match_scores(spark, d):
    return _scored(spark, d).rows().withColumn("decision", matching.band(F.col("score")))


def best_matches(spark, d):
    return _scored(spark, d).best(3)


def decision_counts(spark, d):
    return _scored(spark, d).counts()


def full_scores(spark, d):
    """All candidates of the two graphs by the reference's blocking and signals; identity keys are those of identity_pairs()."""
    e, facts = _entities(spark, d), worlds.statements(spark, d)
    a, b = (e.where(F.col("graph") == g).select("id", "label") for g in ("graph_a", "graph_b"))
    near_a, near_b = (matching.neighbour_labels(x, facts.where(F.col("graph") == g)) for x, g in ((a, "graph_a"), (b, "graph_b")))
    return matching.scored_pairs(a, b, near_a, near_b, identity_pairs(spark, d))


def full_match_scores(spark, d):
    return full_scores(spark, d).select("id_a", "id_b", "score", "method", matching.band(F.col("score")).alias("decision"))


def full_best_matches(spark, d):
    return matching.best_candidates(full_scores(spark, d).select("id_a", "id_b", "score"), 3)


def full_decision_counts(spark, d):
    return full_scores(spark, d).groupBy(matching.band(F.col("score")).alias("decision"), "method").agg(F.count(F.lit(1)).alias("pairs"))


def small_cross(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("id"))
    return matching.all_pairs(a, b)


def neighbour_sets(spark, d):
    return _neighbour_sets(worlds.relations(spark, d))


def _neighbour_sets(edges):
    near = matching.neighbours(edges)
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("neighbours"), F.min("neighbour").alias("least"), F.max("neighbour").alias("most"))


def disjoint_veto(spark, d):
    rows = table(spark, d, "match_pairs").where("left_id is not null and right_id is not null").select("pair_id", F.split_part("left_id", F.lit("_"), F.lit(1)).alias("type_a"), F.split_part("right_id", F.lit("_"), F.lit(1)).alias("type_b"))
    rules = spark.createDataFrame([("DRUG", "GENE"), ("DRUG", "DIS"), ("GENE", "DIS")], "x string, y string")
    return matching.not_disjoint(rows, rules)


def pair_bands(spark, d):
    rows = table(spark, d, "match_pairs").where("score is not null")
    return rows.select("pair_id", matching.band(F.col("score")).alias("band"), (F.col("origin") == "auto_merged_pairs").alias("merged"))


def predicate_alignment(spark, d):
    mappings = spark.createDataFrame([("associated_with", "graph_a", "relates_to", 0.7), ("associated_with", "graph_a", "linked_with", 0.9), ("binds", "graph_b", "targets", 0.8), ("treats", "graph_a", "treats", 0.6)], "predicate string, role string, target string, confidence double")
    aligned = alignment.align_predicates(worlds.statements(spark, d), mappings)
    return aligned.groupBy("graph", "aligned", "mapped").agg(F.count(F.lit(1)).alias("n"))


def unmapped_predicates(spark, d):
    mappings = spark.createDataFrame([("associated_with", "graph_a", "linked_with", 0.9), ("binds", "graph_b", "targets", 0.8)], "predicate string, role string, target string, confidence double")
    return alignment.unmapped(worlds.statements(spark, d), mappings)


def inverse_relations(spark, d):
    contracts = spark.createDataFrame([("contains", "partOfOrder"), ("placed", "placedBy")], "p string, inverse string")
    rows = alignment.with_inverses(worlds.relations(spark, d).select("s", "p", "o"), contracts)
    return rows.groupBy("p", "derived").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("least"), F.max("s").alias("most"))


def source_alignment(spark, d):
    t = table(spark, d, "aligned_source_pairs").where("canonical_id is not null")
    a = t.select(F.col("source_a_id").alias("id"), F.lower("canonical_id").alias("uri"), F.col("alignment_method").alias("digest"), F.col("pair_id").alias("seq"))
    b = t.select(F.col("source_b_id").alias("id"), F.lower("canonical_id").alias("uri"), F.col("alignment_method").alias("digest"), F.col("pair_id").alias("seq"))
    return alignment.align_sources(a, b)


def alias_components(spark, d):
    t = table(spark, d, "match_pairs").where("origin = 'source_alias_map'")
    edges = t.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    ranks = t.select(F.explode(F.array("left_id", "right_id")).alias("id")).where("id is not null").distinct().select("id", F.when(F.col("id").contains("_A_"), 0).otherwise(2).alias("rank"))
    return components.components(edges, ranks)


def redirected_facts(spark, d):
    facts = worlds.statements(spark, d)
    pairs = table(spark, d, "canonical_entities").where("member_id is not null").groupBy(F.col("member_id").alias("id")).agg(F.min("canonical_id").alias("root"))
    moved = canonical.redirect(facts, pairs)
    return moved.groupBy("graph", "redirected").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("subjects"))


def facts_once(spark, d):
    return canonical.held_once(worlds.statements(spark, d)).withColumn("confidence", F.round("confidence", 6))


def alias_clusters(spark, d):
    return canonical.clusters(table(spark, d, "canonical_entities").where("member_id is not null").select(F.col("member_id").alias("id"), F.col("canonical_id").alias("root")).distinct())


def right_wins(spark, d):
    e = _entities(spark, d)
    return canonical.right_wins(e.where("graph = 'graph_a'"), e.where("graph = 'graph_b'"), "id")


def property_values(spark, d):
    rows = table(spark, d, "canonical_entities").where("color is not null and member_id is not null").select(F.col("member_id").alias("s"), F.lit("color").alias("p"), F.col("color").alias("value"), F.coalesce("graph_id", F.lit("")).alias("graph"), F.col("record_id").alias("seq"))
    return canonical.literal_values(rows)


def contradictions(spark, d):
    return conflicts.contradictions(worlds.statements(spark, d), spark.createDataFrame(OPPOSING, "x string, y string"))


def functional_collisions(spark, d):
    return conflicts.functional_collisions(worlds.statements(spark, d), FUNCTIONAL)


def conflict_winners(spark, d):
    facts = worlds.statements(spark, d)
    found = conflicts.contradictions(facts, spark.createDataFrame(OPPOSING, "x string, y string"))
    row = F.struct((F.col("source") == "curated").alias("trusted"), "confidence", "p", "graph", "seq")
    side = lambda name, key: facts.select(F.col("seq").alias(key), row.alias(name))
    both = found.join(side("x", "against"), "against").join(side("y", "seq"), "seq")
    first, tier = conflicts.winner("x", "y", (), "graph_a")
    return both.select("seq", "against", F.when(first, F.col("against")).otherwise(F.col("seq")).alias("winner"), tier.alias("tier"))


def conflict_fold(spark, d):
    folded = conflicts.fold(worlds.statements(spark, d), OPPOSING, FUNCTIONAL, reject=True)
    return folded.groupBy("kept", "reason").agg(F.count(F.lit(1)).alias("n"))


def conflict_preserve(spark, d):
    """With both claims kept, the fold finds what the joins find."""
    folded = conflicts.fold(worlds.statements(spark, d), OPPOSING, FUNCTIONAL, reject=False)
    return folded.where("reason = 'contradiction'").select("seq", "against")


def graph_values(spark, d):
    """Literal and relational statements of each graph, by predicate."""
    rows = worlds.statements(spark, d)
    return rows.groupBy("graph", literals.is_literal(F.col("p"), F.col("o")).alias("is_literal")).agg(F.count(F.lit(1)).alias("n"))


def first_entities(spark, d):
    rows = worlds.statements(spark, d).select("graph", "seq", F.explode(F.array("s", "o")).alias("id"))
    return states.latest_rows(rows.select("graph", "id", "seq"), ["graph", "id"], [F.col("seq")])


def flagship(spark, d):
    """Two graphs matched, decided, merged into components, and their facts redirected and held once, counted by decision."""
    scored = _scored(spark, d)
    roots = write_table(components.components(scored.merged().select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))))
    facts = canonical.held_once(canonical.redirect(worlds.statements(spark, d), roots))
    decided = scored.counts().groupBy("decision").agg(F.sum("pairs").alias("n"))
    return decided.union(roots.select(F.lit("ROOTS"), F.countDistinct("root"))).union(facts.select(F.lit("FACTS"), F.count(F.lit(1))))


_FUNCTIONS = (blocked_pairs, similar_labels, identity_pairs, match_scores, best_matches, decision_counts, full_match_scores, full_best_matches, full_decision_counts, small_cross, neighbour_sets, disjoint_veto, pair_bands, predicate_alignment, unmapped_predicates, inverse_relations, source_alignment, alias_components, redirected_facts, facts_once, alias_clusters, right_wins, property_values, contradictions, functional_collisions, conflict_winners, conflict_fold, conflict_preserve, graph_values, first_entities)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {"fusion": flagship}

_STRIP = r"'^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$', '', 'g'"
_BARE = rf"regexp_replace(regexp_replace(regexp_replace(p, {_STRIP}), '(?s)^<(.*)>$', '\1'), {_STRIP})"
_LOCAL = f"lower(regexp_replace(case when contains({_BARE}, '#') then string_split({_BARE}, '#')[-1] when contains({_BARE}, '/') then string_split({_BARE}, '/')[-1] when contains({_BARE}, ':') then substring({_BARE}, instr({_BARE}, ':') + 1) else {_BARE} end, {_STRIP}))"
_FIRSTS = f"firsts as (select s, {_LOCAL} as p, o, min(seq) as seq from statements group by all)"
_RULES = "rules(x, y) as (values ('treats', 'contraindicated_in'), ('contraindicated_in', 'treats'), ('associated_with', 'not_associated_with'), ('not_associated_with', 'associated_with'))"
_CONTRA = f"{_FIRSTS}, {_RULES}, contra as (select b.seq, min(a.seq) as against from firsts b join firsts a on a.s = b.s and a.o = b.o and a.seq < b.seq join rules on rules.x = a.p and rules.y = b.p group by b.seq)"
_TOK = r"list_distinct(regexp_extract_all(lower(label), '[\p{L}\p{M}\p{N}_]+'))"
_SIMILAR = rf"""
tok as (select graph, id, label, {_TOK} as t from entities), sets as (select distinct graph, t from tok where len(t) > 0),
heads as (select distinct graph, t, w from (select graph, t, unnest(t) as w from sets)),
near as (select distinct a.t as ta, b.t as tb from heads a join heads b on a.w = b.w and a.graph = 'graph_a' and b.graph = 'graph_b'),
good as (select ta, tb, len(list_intersect(ta, tb))::double / len(list_distinct(list_concat(ta, tb))) as similarity from near),
similar_ids as (select x.id as id_a, y.id as id_b, similarity from good join tok x on x.t = ta and x.graph = 'graph_a' join tok y on y.t = tb and y.graph = 'graph_b' where similarity >= 0.7)
"""
_SCORED = rf"""
pairs as (
  select a.id as id_a, b.id as id_b from entities a join entities b on a.graph = 'graph_a' and b.graph = 'graph_b' and (a.id = b.id)
  union select a.id, b.id from entities a join entities b on a.graph = 'graph_a' and b.graph = 'graph_b' and a.label = b.label
  union select id_a, id_b from similar_ids
), edges as (select graph, lower(s) as id, lower(o) as n from statements union select graph, lower(o), lower(s) from statements),
degree as (select graph, id, count(*) as k from edges group by all),
keyed as (select distinct lower(id_a) as ka, lower(id_b) as kb from pairs),
common as (select ka, kb, count(*) as c from keyed join edges x on x.id = ka and x.graph = 'graph_a' join edges y on y.id = kb and y.graph = 'graph_b' and y.n = x.n group by all),
structure as (select ka, kb, coalesce(c::double / (x.k + y.k - c), 0.0) as st from keyed left join common using (ka, kb) left join degree x on x.id = ka and x.graph = 'graph_a' left join degree y on y.id = kb and y.graph = 'graph_b'),
signals as (
  select id_a, id_b, case when id_a = id_b then 1.0::double else 0.0::double end as e, st,
    case when a.label = b.label then 0.95::double when j >= 0.7 then j when least(length(a.label), length(b.label)) >= 3 and (contains(a.label, b.label) or contains(b.label, a.label)) then 0.75::double else 0.0::double end as l
  from (select id_a, id_b, a.label as la, b.label as lb, a as a, b as b, len(list_intersect(a.t, b.t))::double / greatest(1, len(list_distinct(list_concat(a.t, b.t)))) as j
    from pairs join tok a on a.id = id_a and a.graph = 'graph_a' join tok b on b.id = id_b and b.graph = 'graph_b') x join structure on ka = lower(id_a) and kb = lower(id_b)
), scored as (
  select id_a, id_b, round(least(1.0::double, 1.0::double * e + 0.75::double * l + 0.3::double * st), 6) as score, case when e >= 1 then 'exact_id' when l >= 0.9 then 'normalized_label' when st >= 0.6 then 'structural_neighborhood' else 'label_similarity' end as method from signals
), decided as (select *, case when score >= 0.88 then 'MERGE' when score >= 0.65 then 'REVIEW' else 'KEEP' end as decision from scored)
"""
_MATCH = f"with {worlds.STATEMENTS}, {_ENTITIES}, {_SIMILAR}, {_SCORED}"
_ONCE = """select s, arg_min(p, seq) as p, o, min(seq) as first_seq, round(max(confidence), 6) as confidence, coalesce(array_to_string(list_sort(list(distinct source) filter (source is not null)), '+'), '') as origin,
  coalesce(array_to_string(list_sort(list(distinct graph) filter (graph is not null)), '+'), '') as graphs, count(*) as statements"""

ORACLES = {
    "blocked_pairs": f"with {_ENTITIES} select a.id as id_a, b.id as id_b from entities a join entities b on a.graph = 'graph_a' and b.graph = 'graph_b' and a.id = b.id union select a.id, b.id from entities a join entities b on a.graph = 'graph_a' and b.graph = 'graph_b' and a.label = b.label",
    "similar_labels": f"with {_ENTITIES}, {_SIMILAR} select id_a, id_b, round(similarity, 6) as similarity from similar_ids",
    "identity_pairs": """with r as (select graph_id as g, member_id as id, lower(trim(source_canonical_id || '|' || label, ' ')) as v from canonical_entities where source_canonical_id is not null and label is not null)
select distinct a.id as id_a, b.id as id_b, 'source' as property from r a join r b on a.v = b.v and a.g = 'graph_a' and b.g = 'graph_b'""",
    "match_scores": f"{_MATCH} select id_a, id_b, score, method, decision from decided",
    "best_matches": f"{_MATCH} select id_a, id_b, score, cast(row_number() over (partition by id_a order by score desc, id_b) as integer) as rank from decided qualify rank <= 3",
    "decision_counts": f"{_MATCH} select decision, method, count(*) as pairs from decided group by all",
    "small_cross": "select n_nationkey as id_a, r_regionkey as id_b from nation, region",
    "neighbour_sets": f"with {worlds.RELATIONS}, n as (select s as id, o as x from relations union select o, s from relations) select id, count(*) as neighbours, min(x) as least, max(x) as most from n group by id",
    "disjoint_veto": """select pair_id, split_part(left_id, '_', 1) as type_a, split_part(right_id, '_', 1) as type_b from match_pairs where left_id is not null and right_id is not null
  and not (list_sort([split_part(left_id, '_', 1), split_part(right_id, '_', 1)]) in (['DRUG', 'GENE'], ['DIS', 'DRUG'], ['DIS', 'GENE']))""",
    "pair_bands": "select pair_id, case when score >= 0.88 then 'MERGE' when score >= 0.65 then 'REVIEW' else 'KEEP' end as band, origin = 'auto_merged_pairs' as merged from match_pairs where score is not null",
    "predicate_alignment": f"with {worlds.STATEMENTS}, x as (select graph, p, case when graph = 'graph_a' and {_LOCAL} = 'associated_with' then 'linked_with' when graph = 'graph_b' and {_LOCAL} = 'binds' then 'targets' when graph = 'graph_a' and {_LOCAL} = 'treats' then 'treats' end as t from statements) select graph, coalesce(t, p) as aligned, t is not null as mapped, count(*) as n from x group by all",
    "unmapped_predicates": f"with {worlds.STATEMENTS}, x as (select distinct {_LOCAL} as predicate, graph from statements) select predicate, graph from x where not (predicate = 'associated_with' and coalesce(graph, '') = 'graph_a') and not (predicate = 'binds' and coalesce(graph, '') = 'graph_b')",
    "inverse_relations": f"with {worlds.RELATIONS}, a as (select s, p, o, false as derived from relations union all select o, 'partOfOrder', s, true from relations where p = 'contains' union all select o, 'placedBy', s, true from relations where p = 'placed') select p, derived, count(*) as n, min(s) as least, max(s) as most from a group by all",
    "alias_components": """with recursive e as (select left_id as a, right_id as b from match_pairs where origin = 'source_alias_map' and left_id is not null and right_id is not null),
both_ways as (select a, b from e union select b, a from e), reach as (select a as id, a as x from both_ways union select r.id, e.b from reach r join both_ways e on e.a = r.x)
select id, arg_min(x, row(case when contains(x, '_A_') then 0 else 2 end, x)) as root from reach group by id""",
    "redirected_facts": f"with {worlds.STATEMENTS}, al as (select member_id as id, min(canonical_id) as root from canonical_entities where member_id is not null group by 1) select graph, (coalesce(x.root, s) <> s or coalesce(y.root, o) <> o) as redirected, count(*) as n, count(distinct coalesce(x.root, s)) as subjects from statements left join al x on x.id = s left join al y on y.id = o group by all",
    "facts_once": f"with {worlds.STATEMENTS}, k as (select *, {_LOCAL} as lp from statements), g as ({_ONCE} from k group by s, lp, o) select *, case when statements > 1 then 'canon_' || substring(sha256(concat_ws(':', s, p, o, origin)), 1, 16) else cast(first_seq as varchar) end as id from g",
    "alias_clusters": "select canonical_id as root, count(*) as members, string_agg(member_id, ',' order by member_id) as ids from (select distinct canonical_id, member_id from canonical_entities where member_id is not null) group by 1",
    "right_wins": f"with {_ENTITIES} select graph, id, label from entities where graph = 'graph_b' union all select graph, id, label from entities where graph = 'graph_a' and id not in (select id from entities where graph = 'graph_b')",
    "property_values": "with f as (select member_id as s, color as v, coalesce(graph_id, '') as g, min(record_id) as q from canonical_entities where color is not null and member_id is not null group by all) select s, 'color' as p, count(*) as n, string_agg(v, '|' order by q, v) as \"values\" from f group by s",
    "contradictions": f"with {worlds.STATEMENTS}, {_CONTRA} select seq, against from contra",
    "functional_collisions": f"with {worlds.STATEMENTS}, {_FIRSTS}, f as (select *, min(seq) over (partition by s, p) as against, first_value(o) over (partition by s, p order by seq) as fo from firsts where p in ('encodes', 'subtype_of')) select seq, against from f where o <> fo",
    "conflict_winners": f"""with {worlds.STATEMENTS}, {_CONTRA}, j as (select c.seq, c.against, coalesce(x.confidence, 1.0) as cx, coalesce(y.confidence, 1.0) as cy, x.source = 'curated' as tx, y.source = 'curated' as ty, x.graph = 'graph_a' as gx, y.graph = 'graph_a' as gy from contra c join statements x on x.seq = c.against join statements y on y.seq = c.seq)
select seq, against, case when tx and not ty then against when ty and not tx then seq when cx > cy then against when cy > cx then seq when gx and not gy then against when gy and not gx then seq else against end as winner,
  case when (tx and not ty) or (ty and not tx) then 'ULTIMATE_GROUND_TRUTH_AUTHORITY' when cx > cy or cy > cx then 'HIGHER_EVIDENCE_CONFIDENCE_SCORE' when (gx and not gy) or (gy and not gx) then 'GRAPH_A_DEFAULT_PRECEDENCE' else 'DETERMINISTIC_ID_ORDER' end as tier from j""",
    "conflict_preserve": f"with {worlds.STATEMENTS}, {_CONTRA} select seq, against from contra",
    "first_entities": f"with {worlds.STATEMENTS} select graph, id, min(seq) as seq from (select graph, seq, unnest([s, o]) as id from statements) group by graph, id",
    "fusion": f"""{_MATCH.replace('with ', 'with recursive ', 1)}, both_ways as (select id_a as a, id_b as b from decided where decision = 'MERGE' union select id_b, id_a from decided where decision = 'MERGE'),
reach as (select a as id, a as x from both_ways union select r.id, e.b from reach r join both_ways e on e.a = r.x), roots as (select id, min(x) as root from reach group by id),
moved as (select coalesce(x.root, s) as s, {_LOCAL} as lp, coalesce(y.root, o) as o from statements left join roots x on x.id = s left join roots y on y.id = o)
select decision, count(*) as n from decided group by 1 union all select 'ROOTS', count(distinct root) from roots union all select 'FACTS', count(*) from (select distinct s, lp, o from moved)""",
}
