"""Queries of validators of merged pairs, conflict modes, datasets, ways of reconciliation, saved releases and the matcher's benchmark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import normalizers
from graphloom.operators import conflicts, evaluation, matching, policies, projections, rdf, releases
from graphloom.plans import fusion_queries, release_queries, worlds
from graphloom.plans.tables import table

_TYPES = {"gene": "Gene", "prot": "Protein", "drug": "Drug"}


def entity_validators(spark, d):
    """The checks of a pair on every pair of the matcher."""
    kind = lambda c: reduce(lambda w, kv: w.when(F.lower(c).startswith(kv[0]), kv[1]), _TYPES.items(), F.when(F.lit(False), "")).otherwise("Concept")
    rows = table(spark, d, "match_pairs").where("left_id is not null and right_id is not null")
    rows = rows.select(
        "pair_id", kind("left_id").alias("source_type"), kind("right_id").alias("candidate_type"), F.when(F.col("score") > 0.9, "9606").alias("source_tax_id"), F.when(F.col("pair_id") % 2 == 0, "9606").otherwise("10090").alias("candidate_tax_id"),
        F.col("origin").alias("predicate"), F.col("score").isNull().alias("is_salt"), (F.col("left_id") != F.col("right_id")).alias("is_active_moiety"), F.when(F.col("origin") == "alias_map", "merge").alias("action"),
        (F.col("origin") == "kept_separate_pairs").alias("is_isoform"), F.lower("left_id").startswith("gene").alias("is_gene_locus"),
        F.split_part("left_id", F.lit("_"), F.lit(1)).alias("source_granularity"), F.split_part("right_id", F.lit("_"), F.lit(1)).alias("candidate_granularity"),
        (F.col("score") >= 0.65).alias("has_required_evidence"), (F.col("origin") == "alias_map").alias("is_deprecated"), (F.col("left_id") < F.col("right_id")).alias("has_replacement"),
    )
    return policies.validate_entities(rows, "pair_id")


def conflict_review(spark, d):
    """What a person has to look at, and repetitions, with everything kept."""
    found = conflicts.resolve(worlds.statements(spark, d), fusion_queries.OPPOSING, fusion_queries.FUNCTIONAL, "review")
    return found.where("reason is not null").select("seq", "reason", "against", "action", "review", "kept")


def conflict_policy(spark, d):
    found = conflicts.resolve(worlds.statements(spark, d), fusion_queries.OPPOSING, fusion_queries.FUNCTIONAL, "policy")
    return found.groupBy("kept", "reason", "action").agg(F.count(F.lit(1)).alias("n"))


def authority_conflicts(spark, d):
    """Contradicting statements by each strategy of preferred sources."""
    facts = worlds.statements(spark, d)
    found = conflicts.contradictions(facts, spark.createDataFrame(fusion_queries.OPPOSING, "x string, y string"))
    row = F.struct(F.lower("p").alias("p"), "source", "seq")
    both = found.join(facts.select(F.col("seq").alias("against"), row.alias("a")), "against").join(facts.select("seq", row.alias("b")), "seq")
    ways = []
    for strategy in conflicts.STRATEGIES:
        won, review = conflicts.by_authority("a", "b", strategy, {"treats": "curated", "contraindicated_in": "curated"})
        ways.append(F.struct(F.lit(strategy).alias("strategy"), won.alias("winner"), review.alias("review")))
    return both.select("seq", "against", F.explode(F.array(*ways)).alias("x")).select("seq", "against", "x.*")


def dataset_assertions(spark, d):
    return projections.assertions(rdf.from_quads(release_queries._quads(spark, d)))


def dataset_provenance(spark, d):
    return projections.provenance(release_queries.provenance_quads(spark, d))


def dataset_evidence(spark, d):
    return projections.evidence(release_queries.evidence_quads(spark, d))


def _records(facts: DataFrame) -> DataFrame:
    entity = facts.select(F.lit("entity").alias("kind"), F.col("s").alias("key"), F.sha2("s", 256).alias("digest")).distinct()
    relation = facts.groupBy(F.concat_ws("|", "s", "p", "o").alias("key")).agg(F.sha2(F.max("o"), 256).alias("digest")).select(F.lit("relation").alias("kind"), "key", "digest")
    return entity.union(relation).union(facts.select(F.lit("assertion"), F.col("seq").cast("string"), F.sha2(F.lower("p"), 256)))


def reconciliation_strategies(spark, d):
    """A projection that lost uncertain statements and wrote another predicate, against the graph, in every way."""
    facts = worlds.statements(spark, d)
    kept = facts.where("confidence >= 0.5").withColumn("p", F.when(F.lower("p") == "treats", "heals").otherwise(F.col("p")))
    expected, actual = _records(facts), _records(kept)
    return reduce(DataFrame.union, [projections.reconcile(expected, actual, s).select(F.lit(s).alias("strategy"), "*") for s in projections.STRATEGIES])


def release_saves(spark, d):
    """Releases saved first, requested again by their last ingestion."""
    rows = table(spark, d, "release_ingestions").where("release_id is not null")
    fields = [F.col("release_id").alias("graph_a_release_id"), F.lit(None).cast("string").alias("graph_b_release_id"), F.lit("general").alias("domain_id"), F.lit("preserve").alias("conflict_mode")]
    one = lambda pick: rows.groupBy("release_id").agg(pick("status", "ingestion_id").alias("fusion_run_id")).select("release_id", "fusion_run_id", *fields)
    first = one(F.min_by).where(F.substring("release_id", -1, 1) < "6")
    return releases.save(first, one(F.max_by))


def matcher_benchmark(spark, d):
    """The metrics of the matcher's scored pairs, merged ones being true."""
    rows = table(spark, d, "match_pairs").where("score is not null and left_id is not null and right_id is not null")
    once = rows.groupBy(F.col("left_id").alias("q"), F.col("right_id").alias("item")).agg(F.max("score").alias("p"), F.max((F.col("origin") == "auto_merged_pairs").cast("int")).alias("y"))
    return evaluation.benchmark(once.withColumns({"decision": matching.band(F.col("p")), "ms": F.length("q") + F.length("item")}))


def entities_by_type(spark, d):
    """Nodes whose type contains a name, in any case."""
    return table(spark, d, "canonical_entities").where(F.lower("group_name").contains("drug")).select("record_id", "group_name")


def normalizer_chain(spark, d):
    """Labels through white space, case and identifier normalizers, step by step."""
    rows = table(spark, d, "canonical_entities").where("label is not null")
    return normalizers.run(rows, "record_id", "label", [("white_space", normalizers.white_space), ("case:lower", normalizers.case("lower")), ("identifier", normalizers.identifier)])


QUERIES = {f.__name__: f for f in (entity_validators, conflict_review, conflict_policy, authority_conflicts, dataset_assertions, dataset_provenance, dataset_evidence, reconciliation_strategies, release_saves, matcher_benchmark, entities_by_type, normalizer_chain)}

_KIND = "case when starts_with(lower({0}), 'gene') then 'Gene' when starts_with(lower({0}), 'prot') then 'Protein' when starts_with(lower({0}), 'drug') then 'Drug' else 'Concept' end"
_SP = r"[\s\p{Z}\x{0b}\x{85}]+"


def _check(code, severity, bad, no, yes):
    return f"select cast(pair_id as varchar) as target, '{code}' as \"check\", case when bad then '{severity}' else 'INFO' end as severity, case when bad then 'FAIL' else 'PASS' end as status, case when bad then {no} else '{yes}' end as message from (select *, coalesce({bad}, false) as bad from m)"


ORACLES = {
    "entity_validators": f"""with m as (select *, {_KIND.format('left_id')} as st, {_KIND.format('right_id')} as ct, case when score > 0.9 then '9606' end as stx, case when pair_id % 2 = 0 then '9606' else '10090' end as ctx,
  split_part(left_id, '_', 1) as sg, split_part(right_id, '_', 1) as cg from match_pairs where left_id is not null and right_id is not null)
""" + " union all ".join((
        _check("BIO-TYPE-001", "BLOCKER", "(st = 'Gene' and ct = 'Protein') or (st = 'Protein' and ct = 'Gene')", "'Gene and Protein entities cannot be automatically merged.'", "Entity types compatible."),
        _check("BIO-TAXON-001", "ERROR", "stx <> ctx and origin is distinct from 'orthologous_to'", "'Cross-species assertion missing explicit orthologous_to semantics.'", "Taxonomic compatibility valid."),
        _check("BIO-DRUG-001", "BLOCKER", "score is null and left_id <> right_id and origin = 'alias_map'", "'Salt and active moiety cannot be merged.'", "Salt and active moiety distinction preserved."),
        _check("BIO-ISOFORM-001", "ERROR", "origin = 'kept_separate_pairs' and starts_with(lower(left_id), 'gene')", "'Protein isoform cannot be equated directly with gene locus.'", "Isoform vs gene locus distinction valid."),
        _check("BIO-GRANULARITY-001", "BLOCKER", "sg <> '' and cg <> '' and sg <> cg", "'Granularity mismatch (' || sg || ' vs ' || cg || ') prevents merging.'", "Granularity levels match."),
        _check("BIO-EVIDENCE-001", "BLOCKER", "not coalesce(score >= 0.65, false)", "'Required evidence missing for promotion.'", "Evidence sufficiency validated."),
        _check("BIO-ID-001", "ERROR", "origin = 'alias_map' and not left_id < right_id", "'Deprecated identifier used without valid replacement.'", "Identifier status valid."),
    )),
    "conflict_review": f"""with {worlds.STATEMENTS}, {fusion_queries._CONTRA},
f as (select *, min(seq) over (partition by s, p) as against, first_value(o) over (partition by s, p order by seq) as fo from firsts where p in ('encodes', 'subtype_of')),
k as (select x.seq, min(y.seq) as against from (select seq, s, {fusion_queries._LOCAL} as p, o from statements) x join firsts y on y.s = x.s and y.p = x.p and y.o = x.o where x.seq <> y.seq group by x.seq),
noted as (select seq, 'repetition' as reason, against from k union all select seq, 'contradiction', against from contra union all select seq, 'collision', against from f where o <> fo and seq not in (select seq from contra))
select seq, reason, against, case reason when 'repetition' then 'EXACT_TRIPLE_PRESERVED' else 'FLAGGED_FOR_HUMAN_REVIEW' end as action, reason <> 'repetition' as review, true as kept from noted""",
    "authority_conflicts": f"""with {worlds.STATEMENTS}, {fusion_queries._CONTRA}, j as (select c.seq, c.against, lower(x.p) as p, coalesce(lower(x.source), '') = 'curated' as ax, coalesce(lower(y.source), '') = 'curated' as bx from contra c join statements x on x.seq = c.against join statements y on y.seq = c.seq),
w as (select *, case when p not in ('treats', 'contraindicated_in') then against when ax and not bx then against when bx and not ax then seq end as won from j)
select seq, against, 'preserve_source_specific_assertions' as strategy, cast(null as bigint) as winner, false as review from w union all select seq, against, 'preserve_conflict_and_review', null, true from w
union all select seq, against, 'preferred_source_wins_with_provenance', won, won is null from w""",
    "dataset_assertions": f"select id as assertion_id, kind, subject, predicate, object, value, state from ({release_queries.ORACLES['quads_read_back']})",
    "dataset_provenance": f"with {worlds.STATEMENTS} select cast(seq as varchar) as assertion_id, source as agent, 'load' as activity, strftime(\"at\", '%Y-%m-%dT%H:%M:%S') as asserted_at, cast(null as varchar) as method, '' as input_assertions, coalesce(graph, '') as input_resources from statements where \"at\" is not null",
    "dataset_evidence": "select record_id as evidence_id, record_id as claim_id, min(record_type) as kind, record_id, min(artifact_id) as artifact_id, cast(null as varchar) as obtained_at from parsed_records where record_id is not null group by record_id",
    "reconciliation_strategies": f"""with {worlds.STATEMENTS}, k as (select seq, s, case when lower(p) = 'treats' then 'heals' else p end as p, o from statements where confidence >= 0.5),
e as (select 'entity' as kind, s as key, sha256(s) as digest from statements group by all union all select 'relation', s || '|' || p || '|' || o, sha256(max(o)) from statements group by s || '|' || p || '|' || o union all select 'assertion', cast(seq as varchar), sha256(lower(p)) from statements),
a as (select 'entity' as kind, s as key, sha256(s) as digest from k group by all union all select 'relation', s || '|' || p || '|' || o, sha256(max(o)) from k group by s || '|' || p || '|' || o union all select 'assertion', cast(seq as varchar), sha256(lower(p)) from k),
n as (select count(*) filter (kind = 'assertion') as assertions, count(*) filter (kind = 'entity') as entities, count(*) filter (kind = 'relation') as relations from e),
q as (select (select list(key || digest order by key) from e where kind = 'assertion') is not distinct from (select list(key || digest order by key) from a where kind = 'assertion') as same_digest),
c as (select count(*) filter (a.key is null) as missing, count(*) filter (e.key is null) as unexpected, count(*) filter (a.digest <> e.digest) as transformed from e full join a on a.kind = e.kind and a.key = e.key)
select w.strategy, n.*, q.*, case when strategy = 'stats' or (strategy = 'digest' and same_digest) then 0 else missing end as missing, case when strategy = 'stats' or (strategy = 'digest' and same_digest) then 0 else unexpected end as unexpected,
  case when strategy = 'stats' then 0 when strategy = 'digest' then case when same_digest then 0 else 1 end else transformed end as transformed from (select unnest(['rebuild', 'row_by_row', 'digest', 'stats']) as strategy) w, n, q, c""",
    "release_saves": """with f as (select release_id, arg_min(status, ingestion_id) as x, arg_max(status, ingestion_id) as y from release_ingestions where release_id is not null group by 1)
select release_id, case when right(release_id, 1) >= '6' then 'saved' when x is not distinct from y then 'returned' else 'collision' end as outcome from f""",
    "matcher_benchmark": """with r as (select left_id as q, right_id as item, max(score) as p, max(case when origin = 'auto_merged_pairs' then 1 else 0 end) as y from match_pairs where score is not null and left_id is not null and right_id is not null group by 1, 2),
b as (select *, case when p >= 0.88 then 'MERGE' when p >= 0.65 then 'REVIEW' else 'KEEP' end as decision, length(q) + length(item) as ms, row_number() over (partition by q order by p desc, item) as rk, least(4, cast(floor(p * 5 + 1e-9) as int)) as bin from r),
s as (select sum(case when decision = 'MERGE' and y = 1 then 1.0::double else 0 end) as tp, sum(case when decision = 'MERGE' and y = 0 then 1.0::double else 0 end) as fp, sum(case when decision <> 'MERGE' and y = 1 then 1.0::double else 0 end) as fn, sum(case when decision <> 'MERGE' and y = 0 then 1.0::double else 0 end) as tn,
  count(*)::double as n, sum(case when decision = 'REVIEW' then 1.0::double else 0 end) as rv, sum((p - y) * (p - y)) as sq from b),
g as (select sum(abs(sp - sy)) as gap from (select sum(p) as sp, sum(y) as sy from b group by bin)), o as (select ms, row_number() over (order by ms) as i, count(*) over () as n from b)
select 'recall_at_' || k as metric, round(avg(case when rk <= k then 1.0::double else 0.0 end), 6) as value from b, (select unnest([10, 20, 50]) as k) where y = 1 group by k
union all select unnest(['precision', 'recall', 'f1', 'false_positive_rate', 'abstention', 'brier', 'ece']), unnest([round(coalesce(tp / nullif(tp + fp, 0), 0), 6), round(coalesce(tp / nullif(tp + fn, 0), 0), 6), round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6), round(coalesce(fp / nullif(fp + tn, 0), 0), 6), round(rv / n, 6), round(sq / n, 6), round(gap / n, 6)]) from s, g
union all select 'p' || cast(share * 100 as int) || '_ms', min(ms)::double from o, (select unnest([0.5::double, 0.95::double, 0.99::double]) as share) where i >= ceil(share * n) group by share""",
    "entities_by_type": "select record_id, group_name from canonical_entities where contains(lower(group_name), 'drug')",
    "normalizer_chain": rf"""with x as (select record_id, label as v0, trim(regexp_replace(label, '{_SP}', ' ', 'g'), ' ') as v1 from canonical_entities where label is not null), y as (select *, lower(v1) as v2, regexp_replace(regexp_replace(regexp_replace(lower(v1), '{_SP}', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') as v3 from x),
z as (select record_id, unnest([0, 1, 2]) as place, unnest(['white_space', 'case:lower', 'identifier']) as step, unnest([v0, v1, v2]) as input, unnest([v1, v2, v3]) as output from y) select *, input <> output as changed from z""",
}
