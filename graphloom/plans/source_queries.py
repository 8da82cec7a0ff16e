"""Queries of readers, adapters, shaping and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.plans import worlds
from graphloom.plans.tables import table
from graphloom.sources import adapters, shaping
from graphloom.streaming import logs


def registry_observations(spark, d):
    return adapters.registry_observations(*(table(spark, d, f"{t}_sample") for t in ("hgnc", "ensembl", "uniprot", "chembl")))


def shaped_statements(spark, d):
    rows = table(spark, d, "parsed_records").where("payload is not null and record_id is not null")
    rows = rows.select(F.col("record_id").alias("seq"), F.col("payload").alias("raw")).distinct().select("seq", F.from_json("raw", "map<string,string>").alias("payload"))
    return shaping.statements(rows, "release")


def _stream(spark, d):
    at = table(spark, d, "events")
    rows = spark.readStream.schema(at.schema).option("pathGlobFilter", "events.parquet").parquet(d) if not _is_folder(spark, f"{d}/events.parquet") else spark.readStream.schema(at.schema).parquet(f"{d}/events.parquet")
    states = {"signup": "candidate", "view": "verified", "click": "promotion_review", "purchase": "approved", "error": "rejected"}
    state = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])[F.col("event_type")]
    return rows.select("event_id", F.col("user_id").alias("assertion_id"), state.alias("to_state"), "ts")


def _is_folder(spark, path):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def stream_replay(spark, d):
    return logs.run_to_table(logs.replay(_stream(spark, d)), "append")


def stream_once(spark, d):
    return logs.run_to_table(logs.once(_stream(spark, d), "event_id", "30 days"), "append").select("event_id", "assertion_id")


def stream_counts(spark, d):
    rows = logs.run_to_table(logs.counts(_stream(spark, d), "1 hour", "30 days", ["to_state"]), "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "to_state", "n")


QUERIES = {f.__name__: f for f in (registry_observations, shaped_statements, stream_replay, stream_once, stream_counts)}

ORACLES = {
    "registry_observations": """with h as (select distinct unnest(response.docs, recursive := true) from hgnc_sample)
select distinct 'hgnc' as source, trim(hgnc_id) as observation_id, sha256('{"hgnc_id":"' || hgnc_id || '"' || coalesce(',"status":"' || status || '"', '') || coalesce(',"symbol":"' || symbol || '"', '') || '}') as digest from h where hgnc_id is not null
union select 'ensembl', 'ENSEMBL:' || id, sha256('{' || coalesce('"biotype":"' || biotype || '",', '') || '"id":"' || id || '"' || coalesce(',"species":"' || species || '"', '') || '}') from ensembl_sample where id is not null
union select 'uniprot', 'UniProt:' || primaryAccession, sha256('{"primaryAccession":"' || primaryAccession || '"' || coalesce(',"taxon":"' || organism.taxonId || '"', '') || '}') from uniprot_sample where primaryAccession is not null
union select 'chembl', case when starts_with(upper(molecule_chembl_id), 'CHEMBL:') then molecule_chembl_id else 'ChEMBL:' || molecule_chembl_id end, sha256('{"molecule_chembl_id":"' || molecule_chembl_id || '"' || coalesce(',"molecule_type":"' || molecule_type || '"', '') || '}') from chembl_sample where molecule_chembl_id is not null""",
    "shaped_statements": r"""with p as (select distinct record_id, payload from parsed_records where payload is not null and record_id is not null),
x as (select record_id, trim(payload::json ->> 'subject') as s, trim(payload::json ->> 'predicate') as p, trim(payload::json ->> 'object') as o from p)
select 'release_a_' || record_id as id, 'release' as graph, regexp_replace(s, '\s+', '_', 'g') as s, regexp_replace(p, '\s+', '_', 'g') as p, regexp_replace(o, '\s+', '_', 'g') as o from x where s <> '' and p <> '' and o <> ''""",
    "stream_replay": f"""with {worlds.LOG}, l as (select *, lag(to_state) over (partition by assertion_id order by ts, event_id) as f from log)
select assertion_id, event_id, f as from_state, to_state, case when f is null then case when to_state = 'candidate' then null else 'no_start' end
  when (f = 'candidate' and to_state in ('verified', 'rejected', 'abstained')) or (f = 'verified' and to_state in ('promotion_review', 'rejected')) or (f = 'promotion_review' and to_state in ('approved', 'rejected')) or (f = 'approved' and to_state in ('superseded', 'retracted')) then null else 'illegal_transition' end as error from l""",
    "stream_once": "select event_id, min(user_id) as assertion_id from events group by 1",
    "stream_counts": f"with {worlds.LOG} select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, to_state, count(*) as n from log group by 1, 2",
}
