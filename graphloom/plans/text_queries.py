"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import labels, literals, python_exact, vectors
from graphloom.plans import worlds
from graphloom.plans.tables import table


def local_names(spark, d):
    raw = worlds.statements(spark, d).select(F.explode(F.array("s", "p", "o")).alias("raw"))
    iris = table(spark, d, "part").select(F.concat(F.lit("<http://example.org/part#"), F.col("p_partkey"), F.lit(">")).alias("raw"))
    raw = raw.union(iris).union(table(spark, d, "canonical_entities").select("source_canonical_id").where("source_canonical_id is not null")).distinct()
    return raw.select("raw", labels.local_name(F.col("raw")).alias("local"))


def normalized_labels(spark, d):
    rows = table(spark, d, "canonical_entities").where("label is not null").select("record_id", "label")
    return rows.select("record_id", labels.label(F.col("label"), ("alpha", "beta", "protein", "sclerosis")).alias("normal"))


def label_jaccard(spark, d):
    rows = table(spark, d, "canonical_entities").where("label is not null and description is not null")
    j = labels.jaccard(labels.tokens(F.col("label")), labels.tokens(F.col("description")))
    return rows.select("record_id", F.round(j, 6).alias("similarity"))


def literal_typing(spark, d):
    rows = worlds.attributes(spark, d).where("value is not null")
    typed = rows.withColumn("l", literals.literal(F.col("value")))
    return typed.groupBy("p", F.col("l.type").alias("type"), literals.is_literal(F.col("p"), F.col("value")).alias("is_literal")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l.lex").alias("values"), F.min("l.lex").alias("least"), F.max("l.lex").alias("most"))


def literal_keys(spark, d):
    rows = worlds.attributes(spark, d).where("value is not null")
    typed = rows.withColumn("l", literals.literal(F.col("value")))
    return typed.select("s", "p", literals.literal_key(F.col("l.type"), F.col("l.lex")).alias("literal_key"))


def identifiers(spark, d):
    rows = worlds.statements(spark, d).select(F.explode(F.array("s", "o")).alias("raw")).distinct()
    parsed = rows.withColumn("i", labels.identifier(F.col("raw")))
    return parsed.select("raw", F.col("i.namespace").alias("namespace"), F.col("i.value").alias("value"))


def namespace_counts(spark, d):
    ends = worlds.relations(spark, d).select(F.explode(F.array("s", "o")).alias("entity")).distinct()
    return ends.groupBy(labels.namespace_of(F.col("entity")).alias("namespace")).agg(F.count(F.lit(1)).alias("entities"))


def resource_identifiers(spark, d):
    rows = table(spark, d, "canonical_entities").select("source_canonical_id").where("source_canonical_id is not null").distinct()
    parsed = rows.withColumn("i", labels.resource_identifier(F.col("source_canonical_id"), {}, "ENTITY"))
    return parsed.select("source_canonical_id", F.col("i.namespace").alias("namespace"), F.col("i.value").alias("value"))


def source_uris(spark, d):
    rows = table(spark, d, "aligned_source_pairs").select("pair_id", F.upper("canonical_id").alias("uri")).where("uri is not null")
    return rows.select("pair_id", labels.source_uri(F.col("uri"), ("urn:doi:", "https://doi.org/"), ("doi:",)).alias("uri"), F.col("uri").rlike(r"^URN:DOI:10\.\d{4}/.+$").alias("valid"))


def patent_numbers(spark, d):
    rows = table(spark, d, "aligned_source_pairs").where("canonical_id like 'urn:patent:%'").select("pair_id", F.regexp_replace(F.regexp_replace("canonical_id", "^urn:patent:", ""), ":", "").alias("raw"))
    return rows.select("pair_id", labels.patent_number(F.col("raw")).alias("patent"))


def derived_ids(spark, d):
    rows = worlds.relations(spark, d)
    return rows.select("id", literals.short_digest("canon_", F.col("s"), F.col("p"), F.col("o")).alias("derived"))


def normalizer_steps(spark, d):
    """Each step of a chain of normalizers that a label passes, with what went in and came out."""
    rows = table(spark, d, "canonical_entities").where("label is not null").select("record_id", F.col("label").alias("v0"))
    rows = rows.withColumn("v1", F.trim(F.regexp_replace("v0", r"[ \t\r\n]+", " "))).withColumn("v2", F.lower("v1")).withColumn("v3", F.regexp_replace("v2", "[^a-z0-9 ]", ""))
    steps = F.array(*[F.struct(F.lit(n).alias("step"), F.col(f"v{i}").alias("input"), F.col(f"v{i + 1}").alias("output"), (F.col(f"v{i}") != F.col(f"v{i + 1}")).alias("changed")) for i, n in enumerate(("white_space", "case", "identifier"))])
    return rows.select("record_id", F.explode(steps).alias("x")).select("record_id", "x.*")


def canonical_rows(spark, d):
    rows = table(spark, d, "nation")
    return rows.select("n_nationkey", literals.canonical_json({"name": F.col("n_name"), "id": F.col("n_nationkey"), "region": F.col("n_regionkey"), "alias": F.lit(None).cast("string")}).alias("row"))


def entity_kinds(spark, d):
    kinds = {"gene": ("hgnc",), "protein": ("uniprot",), "drug": ("chembl",), "disease": ("mondo",)}
    rows = table(spark, d, "canonical_entities").select("record_id", labels.kind_of(F.col("member_id"), kinds).alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def masked_messages(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("token="), F.substring(F.regexp_replace("text", r"\s+", "_"), 1, 12), F.lit(" "), F.col("text")).alias("m"))
    return rows.select("doc_id", labels.masked(F.col("m")).alias("message"))


def vector_dots(spark, d):
    one = table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    rows = table(spark, d, "embeddings").join(F.broadcast(one))
    return rows.select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("q")), 5).alias("dot"), F.round(vectors.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"))


def folded_labels(spark, d):
    rows = table(spark, d, "canonical_entities").where("label is not null")
    return rows.select("record_id", python_exact.folded(F.col("label")).alias("folded"))


def label_ratios(spark, d):
    rows = table(spark, d, "canonical_entities").where("label is not null and description is not null")
    return rows.select("record_id", python_exact.round4(python_exact.matching_ratio(F.lower("label"), F.lower(F.split_part("description", F.lit(":"), F.lit(1))))).alias("ratio"))


def surface_vectors(spark, d):
    rows = table(spark, d, "canonical_entities").where("label is not null")
    text = F.concat_ws(". ", F.concat(F.col("label"), F.lit(" ["), F.coalesce("group_name", F.lit("Entity")), F.lit("]")), F.array_join(F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, 5), ". "), F.col("description"))
    return rows.select("record_id", python_exact.hash_embedding(64)(text).alias("vector")).select("record_id", F.round(vectors.norm(F.col("vector")), 6).alias("length"))


QUERIES = {f.__name__: f for f in (local_names, normalized_labels, label_jaccard, literal_typing, literal_keys, identifiers, namespace_counts, resource_identifiers, source_uris, patent_numbers, derived_ids, normalizer_steps, canonical_rows, entity_kinds, masked_messages, vector_dots, folded_labels, label_ratios, surface_vectors)}

_TRIM = r"'^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$', '', 'g'"

ORACLES = {
    "local_names": f"""with {worlds.STATEMENTS}, raws as (
  select unnest([s, p, o]) as raw from statements union select '<http://example.org/part#' || p_partkey || '>' from part union select source_canonical_id from canonical_entities where source_canonical_id is not null
), distinct_raws as (select distinct raw from raws), b as (
  select raw, case when starts_with(t, '<') and ends_with(t, '>') and length(t) >= 2 then regexp_replace(t[2:-2], {_TRIM}) else t end as x from (select raw, regexp_replace(raw, {_TRIM}) as t from distinct_raws)
) select raw, regexp_replace(case when contains(x, '#') then string_split(x, '#')[-1] when contains(x, '/') then string_split(x, '/')[-1]
    when contains(x, ':') and not starts_with(x, 'http://') and not starts_with(x, 'https://') and not starts_with(x, 'urn:') then substring(x, instr(x, ':') + 1) else x end, {_TRIM}) as local from b""",
    "normalized_labels": rf"""with b as (
  select record_id, case when starts_with(t, '<') and ends_with(t, '>') and length(t) >= 2 then regexp_replace(t[2:-2], {_TRIM}) else t end as t from (select record_id, regexp_replace(label, {_TRIM}) as t from canonical_entities where label is not null)
), c as (select record_id, case when contains(t, '#') then string_split(t, '#')[-1] when contains(t, '/') then string_split(t, '/')[-1] else t end as t from b),
e as (select record_id, case when contains(t, ':') and not starts_with(t, 'http://') and not starts_with(t, 'https://') and not starts_with(t, 'urn:') then substring(t, instr(t, ':') + 1) else t end as t from c),
f as (select record_id, t, regexp_replace(regexp_replace(regexp_replace(lower(t), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'), {_TRIM}) as k, regexp_replace(t, '(?i)_(alpha|beta|protein|sclerosis)$', '') as short from e)
select record_id, case when short <> t then regexp_replace(regexp_replace(lower(short), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), {_TRIM})
  when ends_with(k, ' alpha') then trim(k[:-7]) when ends_with(k, ' beta') then trim(k[:-6]) when ends_with(k, ' protein') then trim(k[:-9]) when ends_with(k, ' sclerosis') then trim(k[:-11]) else k end as normal from f""",
    "label_jaccard": r"""with t as (select record_id, list_distinct(regexp_extract_all(lower(label), '[\p{L}\p{M}\p{N}_]+')) as a, list_distinct(regexp_extract_all(lower(description), '[\p{L}\p{M}\p{N}_]+')) as b
  from canonical_entities where label is not null and description is not null)
select record_id, round(case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end, 6) as similarity from t""",
    "literal_typing": rf"""with {worlds.ATTRIBUTES}, s0 as (select p, value, string_split(value, '^^')[1] as v from attributes where value is not null),
s1 as (select p, value, case when length(v) >= 2 and ((starts_with(v, '"') and ends_with(v, '"'))) then v[2:-2] else v end as v from s0),
s2 as (select p, value, case when lower(v) in ('true', 'false') then 'boolean' when regexp_full_match(v, '-?\d+') then 'integer' when regexp_full_match(v, '-?\d+\.\d+') then 'float' else 'string' end as type,
  case when lower(v) in ('true', 'false') then lower(v) when regexp_full_match(v, '\d{{4}}/\d\d/\d\d') then replace(v, '/', '-') else v end as lex from s1),
s3 as (select p, type, lex, lower(p) similar to '.*(id|code|name|fullname|title|label|description|age|yearsold|birthdate|dateofbirth|foundeddate|amount|count|value|score|confidence|email|phone|url|comment|status|chemicalformula|molecularweight|approveddate|chembl_id|weight|formula)' or lower(p) in ('uuid', 'key') or contains(value, '^^') or (starts_with(value, '"') and ends_with(value, '"'))
  or regexp_full_match(value, '-?\d+(\.\d+)?') or lower(value) in ('true', 'false', 'yes', 'no') or regexp_full_match(value, '\d{{4}}[-/]\d\d[-/]\d\d') as is_literal from s2)
select p, type, is_literal, count(*) as n, count(distinct lex) as "values", min(lex) as least, max(lex) as most from s3 group by all""",
    "literal_keys": rf"""with {worlds.ATTRIBUTES} select s, p, case when lower(value) in ('true', 'false') then 'boolean:' || lower(value) when p = 'size' then 'integer:' || value
  when p = 'orderDate' then 'string:' || replace(value, '/', '-') when p = 'status' then 'string:' || replace(value, '"', '') when p = 'balance' then 'float:' || string_split(value, '^^')[1]
  else 'string:' || value end as literal_key
from attributes where value is not null""",
    "identifiers": rf"""with {worlds.STATEMENTS}, r as (select distinct unnest([s, o]) as raw from statements),
x as (select raw, regexp_replace(string_split(raw, ':')[1], {_TRIM}) as n, regexp_replace(substring(raw, instr(raw, ':') + 1), {_TRIM}) as v from r)
select raw, case when contains(raw, ':') and n <> '' and v <> '' then n end as namespace, case when contains(raw, ':') and n <> '' and v <> '' then v end as value from x""",
    "namespace_counts": f"with {worlds.RELATIONS} select split_part(entity, ':', 1) as namespace, count(*) as entities from (select distinct unnest([s, o]) as entity from relations) group by 1",
    "resource_identifiers": r"""select distinct source_canonical_id, upper(split_part(source_canonical_id, ':', 2)) as namespace, regexp_replace(source_canonical_id, '^[^:]*:[^:]*:', '') as value
from canonical_entities where source_canonical_id is not null""",
    "source_uris": r"""select pair_id, 'urn:doi:' || lower(trim(regexp_replace(regexp_replace(upper(canonical_id), '(?i)^(?:urn:doi:|https://doi\.org/)', ''), '(?i)^(?:doi:)', ''))) as uri,
  regexp_full_match(upper(canonical_id), 'URN:DOI:10\.\d{4}/.+') as valid from aligned_source_pairs where canonical_id is not null""",
    "patent_numbers": r"""select pair_id, regexp_replace(upper(replace(substring(canonical_id, 12), ':', '')), '^([A-Z]{2})(\d+)([A-Z][A-Z0-9]*)$', '\1:\2:\3') as patent from aligned_source_pairs where canonical_id like 'urn:patent:%'""",
    "derived_ids": f"with {worlds.RELATIONS} select id, 'canon_' || substring(sha256(s || ':' || p || ':' || o), 1, 16) as derived from relations",
    "normalizer_steps": r"""with a as (select record_id, label as v0, trim(regexp_replace(label, '[ \t\r\n]+', ' ', 'g'), ' ') as v1 from canonical_entities where label is not null),
b as (select *, lower(v1) as v2, regexp_replace(lower(v1), '[^a-z0-9 ]', '', 'g') as v3 from a)
select record_id, 'white_space' as step, v0 as input, v1 as output, v0 <> v1 as changed from b union all select record_id, 'case', v1, v2, v1 <> v2 from b union all select record_id, 'identifier', v2, v3, v2 <> v3 from b""",
    "canonical_rows": """select n_nationkey, '{"alias":null,"id":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}' as row from nation""",
    "entity_kinds": """select case when contains(lower(member_id), 'hgnc') then 'gene' when contains(lower(member_id), 'uniprot') then 'protein' when contains(lower(member_id), 'chembl') then 'drug'
  when contains(lower(member_id), 'mondo') then 'disease' else 'concept' end as kind, count(*) as n from canonical_entities group by 1""",
    "masked_messages": r"""with m as (select doc_id, regexp_replace('token=' || substring(regexp_replace(text, '\s+', '_', 'g'), 1, 12) || ' ' || text, '(?i)(api[_-]?key|token|password|secret|bearer)(\s*[=:]\s*|\s+)\S+', '\1\2***', 'g') as m
  from documents where text is not null)
select doc_id, case when length(m) > 200 then substring(m, 1, 200) || '...' else m end as message from m""",
    "vector_dots": """with q as (select embedding::double[] as q from embeddings where vec_id = 0)
select vec_id, round(list_dot_product(embedding::double[], q), 5) as dot, round(list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))), 5) as cosine from embeddings, q""",
}
