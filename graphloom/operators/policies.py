"""Conditions, decisions, gates and validators, as boolean columns and rows of reasons."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def condition(tree: dict[str, Any], schema: T.StructType, thresholds: dict[str, float] | None = None) -> Column:
    """A condition tree as a boolean column: exists, equals, gte, lte, not, all, any.

    A comparison with a field that isn't a number, or is null, is false; booleans aren't numbers. equals None asks
    for a null in a field that there is. gte and lte take a number or the name of a threshold.
    """
    names = {f.name: f.dataType for f in schema.fields}
    (op, arg), *rest = tree.items()
    if rest:
        raise ValueError("a condition has one operator")
    if op in ("all", "any"):
        parts = [condition(x, schema, thresholds) for x in arg]
        return reduce((lambda a, b: a & b) if op == "all" else (lambda a, b: a | b), parts, F.lit(op == "all"))
    if op == "not":
        return ~condition(arg, schema, thresholds)
    if op == "exists":
        return F.col(f"`{arg}`").isNotNull() if arg in names else F.lit(False)
    name, value = arg
    if name not in names:
        return F.lit(False)
    c = F.col(f"`{name}`")
    if op == "equals":
        return c.isNull() if value is None else F.coalesce(c == F.lit(value), F.lit(False))
    if op not in ("gte", "lte"):
        raise ValueError(f"unknown operator {op}")
    bound = (thresholds or {})[value] if isinstance(value, str) else value
    if not isinstance(names[name], T.NumericType):
        return F.lit(False)
    return F.coalesce(c >= bound if op == "gte" else c <= bound, F.lit(False))


def decide(rows: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """rows with passed, the reasons of failed conditions, the evidence that is missing, and the reviewer's role on failure.

    policy has conditions (name, condition), thresholds, required_evidence and review_routing; rows may have
    evidence, an array of kinds.
    """
    checks = [(name, condition(tree, rows.schema, policy.get("thresholds"))) for name, tree in policy["conditions"]]
    reasons = F.filter(F.array(*[F.when(~c, F.lit(name)) for name, c in checks]), lambda x: x.isNotNull())
    required = F.array(*[F.lit(e) for e in policy.get("required_evidence", ())]).cast("array<string>")
    missing = F.array_except(required, F.col("evidence")) if "evidence" in rows.columns else required
    out = rows.withColumns({"reasons": F.array_join(reasons, ","), "missing_evidence": F.array_join(missing, ",")})
    out = out.withColumn("passed", (F.col("reasons") == "") & (F.col("missing_evidence") == ""))
    return out.withColumn("review_role", F.when(~F.col("passed"), policy.get("review_routing")))


def identity_decision(veto: Column, same_kind: Column, score: Column, method: Column, verified: Column, low: float = 0.65, high: float = 0.88) -> Column:
    """What an identity policy says of a pair: a veto and a mismatch of kinds reject, exact identifiers accept, scores between low and high are left open."""
    return (
        F.when(veto, "reject_disjoint")
        .when(~same_kind, "reject_kind")
        .when(method.isin("exact_id", "exact_uri", "exact_identifier"), "accept_exact")
        .when(score < low, "reject_low")
        .when(score < high, F.when(verified, "accept_verified").otherwise("review_band_abstain"))
        .otherwise("accept_high")
    )


def evidence_level(kinds: Column, production: tuple[str, ...]) -> Column:
    """hypothesis for evidence that is only predicted or of no required kind, else production."""
    only = F.forall(kinds, lambda k: k == "predicted")
    return F.when(only, "hypothesis").when(F.arrays_overlap(kinds, F.array(*map(F.lit, production))), "production").otherwise("hypothesis")


def validate(rows: DataFrame, target: str, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """(target, check, severity, status): a row for each target and check (name, severity, condition); a null condition is an ERROR."""
    made = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.when(c, "PASS").when(~c, "FAIL").otherwise("ERROR").alias("status")) for n, s, c in checks])
    return rows.select(F.col(f"`{target}`").cast("string").alias("target"), F.explode(made).alias("x")).select("target", "x.*")


def gate(results: DataFrame, by: list[str]) -> DataFrame:
    """BLOCKED by a failed blocker, REVIEW by a failed error or a check that broke, else PASS."""
    blocked = F.bool_or((F.col("status") == "FAIL") & (F.col("severity") == "BLOCKER"))
    review = F.bool_or(((F.col("status") == "FAIL") & (F.col("severity") == "ERROR")) | (F.col("status") == "ERROR"))
    return results.groupBy(*by).agg(F.when(blocked, "BLOCKED").when(review, "REVIEW").otherwise("PASS").alias("gate"), F.count(F.lit(1)).alias("checks"))


def licensed(rows: DataFrame, licenses: DataFrame) -> DataFrame:
    """rows (with source) with allowed: whether the source's licence lets its data be passed on and exported; an unknown source may. Licences are a table of rules and are broadcast."""
    out = rows.join(F.broadcast(licenses), "source", "left")
    return out.withColumn("allowed", F.coalesce(F.col("redistribution") & F.col("export"), F.lit(True))).drop("redistribution", "export")


def promotable(derived: DataFrame, known: DataFrame, agents: DataFrame) -> DataFrame:
    """(id, problem) of rows (id, agent, refs) that can't be promoted: an unknown agent, no input, or an input that isn't known (id)."""
    agent = derived.join(agents.select("agent").distinct(), "agent", "left_anti").select("id", F.lit("unknown_agent").alias("problem"))
    none = derived.where(F.coalesce(F.size("refs"), F.lit(0)) <= 0).select("id", F.lit("no_inputs").alias("problem"))
    refs = derived.select("id", F.explode("refs").alias("ref")).where("ref is not null")
    lost = refs.join(known.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").select("id", F.lit("unresolved_input").alias("problem")).distinct()
    return agent.union(none).union(lost)


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _both_differ(a: str, b: str) -> Column:
    return F.coalesce((F.col(a) != "") & (F.col(b) != "") & (F.col(a) != F.col(b)), F.lit(False))


def entity_checks() -> list[tuple[str, str, Column, Column, Column]]:
    """(code, severity of a failure, whether it fails, message on failure, message otherwise) of the checks of a merged or promoted pair.

    The rows have source_type, candidate_type, source_tax_id, candidate_tax_id, predicate, is_salt, is_active_moiety, action, is_isoform,
    is_gene_locus, source_granularity, candidate_granularity, has_required_evidence, is_deprecated, has_replacement; a null is a no.
    """
    kinds = F.array_sort(F.array("source_type", "candidate_type"))
    granularity = F.concat(F.lit("Granularity mismatch ("), F.col("source_granularity"), F.lit(" vs "), F.col("candidate_granularity"), F.lit(") prevents merging."))
    # fixed values: codes, severities and messages
    return [
        ("BIO-TYPE-001", "BLOCKER", F.coalesce(kinds == F.array(F.lit("Gene"), F.lit("Protein")), F.lit(False)), F.lit("Gene and Protein entities cannot be automatically merged."), F.lit("Entity types compatible.")),
        ("BIO-TAXON-001", "ERROR", _both_differ("source_tax_id", "candidate_tax_id") & ~F.col("predicate").eqNullSafe("orthologous_to"), F.lit("Cross-species assertion missing explicit orthologous_to semantics."), F.lit("Taxonomic compatibility valid.")),
        ("BIO-DRUG-001", "BLOCKER", _yes("is_salt") & _yes("is_active_moiety") & F.col("action").eqNullSafe("merge"), F.lit("Salt and active moiety cannot be merged."), F.lit("Salt and active moiety distinction preserved.")),
        ("BIO-ISOFORM-001", "ERROR", _yes("is_isoform") & _yes("is_gene_locus"), F.lit("Protein isoform cannot be equated directly with gene locus."), F.lit("Isoform vs gene locus distinction valid.")),
        ("BIO-GRANULARITY-001", "BLOCKER", _both_differ("source_granularity", "candidate_granularity"), granularity, F.lit("Granularity levels match.")),
        ("BIO-EVIDENCE-001", "BLOCKER", ~_yes("has_required_evidence"), F.lit("Required evidence missing for promotion."), F.lit("Evidence sufficiency validated.")),
        ("BIO-ID-001", "ERROR", _yes("is_deprecated") & ~_yes("has_replacement"), F.lit("Deprecated identifier used without valid replacement."), F.lit("Identifier status valid.")),
    ]


def validate_entities(rows: DataFrame, target: str) -> DataFrame:
    """(target, check, severity, status, message): a row for each target and each of entity_checks(); what passes has severity INFO."""
    made = F.array(*[
        F.struct(F.lit(code).alias("check"), F.when(bad, severity).otherwise("INFO").alias("severity"), F.when(bad, "FAIL").otherwise("PASS").alias("status"), F.when(bad, no).otherwise(yes).alias("message"))
        for code, severity, bad, no, yes in entity_checks()
    ])
    return rows.select(F.col(f"`{target}`").cast("string").alias("target"), F.explode(made).alias("x")).select("target", "x.*")


def thresholds_named(policy: dict[str, Any]) -> dict[str, Any]:
    """The policy, if each gte and lte that names a threshold names one it has and its conditions are well formed; else raises."""
    known = policy.get("thresholds") or {}

    def walk(tree: dict[str, Any]) -> None:
        ((op, arg),) = tree.items()
        if op in ("all", "any"):
            for x in arg:
                walk(x)
        elif op == "not":
            walk(arg)
        elif op in ("gte", "lte") and isinstance(arg[1], str) and arg[1] not in known:
            raise ValueError(f"unknown threshold {arg[1]}")

    for _, tree in policy["conditions"]:
        walk(tree)
    return policy


def load_policy(text: str) -> dict[str, Any]:
    """A policy from JSON with conditions (name to condition), thresholds, required_evidence and review_routing, checked by thresholds_named()."""
    raw = json.loads(text)
    conditions = raw.get("conditions", {})
    return thresholds_named(raw | {"conditions": list(conditions.items()) if isinstance(conditions, dict) else [tuple(x) for x in conditions]})
