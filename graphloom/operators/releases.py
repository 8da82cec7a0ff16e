"""Releases: their ingestion, artifacts, status and the projections made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphloom.operators.states import latest_rows

#: The statuses that may follow a status of a release.
LIFECYCLE = {"CANDIDATE": ("VALIDATING",), "VALIDATING": ("APPROVED", "QUARANTINED"), "APPROVED": ("PUBLISHED", "QUARANTINED"), "PUBLISHED": ("SUPERSEDED",)}


def ingest_status(rows: DataFrame) -> DataFrame:
    """rows (with artifacts and errors, arrays) with their counts and the status they make: failed without artifacts, partial with errors, else complete."""
    size = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0))
    n, e = size(F.col("artifacts")), size(F.col("errors"))
    status = F.when((n <= 0) & (e > 0), "failed").when(e > 0, "partial").otherwise("complete")
    return rows.withColumns({"n_artifacts": F.greatest(n, F.lit(0)), "n_errors": F.greatest(e, F.lit(0)), "computed": status})


def stored_once(artifacts: DataFrame) -> DataFrame:
    """The first artifact of each content (sha256), by retrieval and id."""
    return latest_rows(artifacts.where("sha256 is not null"), ["sha256"], [F.col("retrieved_at").asc_nulls_last(), F.col("artifact_id").asc_nulls_last()])


def damaged(artifacts: DataFrame) -> DataFrame:
    """Artifacts (content binary, sha256) whose content isn't what the digest says."""
    return artifacts.where(F.sha2("content", 256) != F.col("sha256"))


def active_projections(manifests: DataFrame) -> DataFrame:
    """Each backend's active projection: the last activated or, without that, created; statuses in any case."""
    at = F.coalesce("activated_at", "created_at")
    return latest_rows(manifests.where(F.lower("status") == "active"), ["backend"], [at.desc(), F.col("created_at").desc(), F.col("projection_id")])


def rollback_targets(manifests: DataFrame) -> DataFrame:
    """Each backend's last retained projection that didn't fail, other than the active one."""
    active = active_projections(manifests).select("backend", F.col("projection_id").alias("_active"))
    rest = manifests.where(~F.lower("status").isin("failed", "destroyed", "quarantined")).join(active, "backend", "left")
    return latest_rows(rest.where(F.col("_active").isNull() | (F.col("projection_id") != F.col("_active"))), ["backend"], [F.coalesce("retained_at", "created_at").desc(), F.col("projection_id")]).drop("_active")


def rolled_back(manifests: DataFrame) -> DataFrame:
    """manifests with each backend's active projection retained and its rollback target active; without a target nothing changes."""
    target = rollback_targets(manifests).select(F.col("backend").alias("_b"), F.col("projection_id").alias("_t"))
    active = active_projections(manifests).select(F.col("backend").alias("_b"), F.col("projection_id").alias("_a"))
    both = active.join(target, "_b")
    out = manifests.join(both, F.col("backend") == F.col("_b"), "left")
    status = F.when(F.col("projection_id") == F.col("_a"), "retained").when(F.col("projection_id") == F.col("_t"), "active").otherwise(F.lower("status"))
    return out.withColumn("status", status).drop("_b", "_a", "_t")


def gates_passed(gates: DataFrame) -> DataFrame:
    """(release_id, passed) of gates (release_id, gate, ok): whether all hold; a null doesn't."""
    return gates.groupBy("release_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("passed"))


def history(log: DataFrame) -> DataFrame:
    """A release's statuses (release_id, status, at, seq) with whether each may follow the one before it."""
    by = W.Window.partitionBy("release_id").orderBy("at", "seq")
    out = log.withColumn("before", F.lag("status").over(by))
    ok = F.when(F.col("before").isNull(), F.col("status") == "CANDIDATE")
    for status, nexts in LIFECYCLE.items():
        ok = ok.when(F.col("before") == status, F.col("status").isin(*nexts))
    return out.withColumn("legal", F.coalesce(ok.otherwise(False), F.lit(False)))


def lineage(parsed: DataFrame, artifacts: DataFrame, releases: DataFrame) -> DataFrame:
    """(record_id, artifact_id, release_id, complete): each record with its artifact and release, and whether the chain has no gap."""
    a = artifacts.select("artifact_id", F.col("source_release_id").alias("release_id")).where("artifact_id is not null").groupBy("artifact_id").agg(F.min("release_id").alias("release_id"))
    r = releases.select(F.col("release_id"), F.lit(True).alias("_known")).where("release_id is not null").distinct()
    out = parsed.select("record_id", "artifact_id").distinct().join(a, "artifact_id", "left").join(r, "release_id", "left")
    return out.select("record_id", "artifact_id", "release_id", F.coalesce("_known", F.lit(False)).alias("complete"))


#: What must not change of a saved release.
IDENTITY = ("fusion_run_id", "graph_a_release_id", "graph_b_release_id", "domain_id", "conflict_mode")


def save(existing: DataFrame, requested: DataFrame) -> DataFrame:
    """(release_id, outcome) of requested releases: saved, returned (the same release is there already) or collision (another one has the id).

    Both have release_id and the columns of IDENTITY; nulls equal nulls. Of several requests with one id the first by those columns counts.
    """
    once = latest_rows(requested, ["release_id"], [F.col(c).asc_nulls_first() for c in IDENTITY])
    old = existing.select("release_id", F.struct(*IDENTITY).alias("old"))
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(c).eqNullSafe(F.col(f"old.{c}"))
    return once.join(old, "release_id", "left").select("release_id", F.when(F.col("old").isNull(), "saved").when(same, "returned").otherwise("collision").alias("outcome"))


def upsert(manifests: DataFrame, updates: DataFrame, order: str) -> DataFrame:
    """manifests with the rows of updates: of each projection_id the last by order, an update coming behind what is there."""
    both = manifests.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return latest_rows(both, ["projection_id"], [F.desc("_new"), F.col(order).desc_nulls_last()]).drop("_new")


def status_change(log: DataFrame, requested: DataFrame) -> DataFrame:
    """(release_id, outcome) of requested lifecycles (release_id, status): appended, repeated (it is there already) or conflict (another is); log has the same columns, one row a release."""
    old = log.select("release_id", F.col("status").alias("_old"))
    return requested.join(old, "release_id", "left").select("release_id", F.when(F.col("_old").isNull(), "appended").when(F.col("_old") == F.col("status"), "repeated").otherwise("conflict").alias("outcome"))
