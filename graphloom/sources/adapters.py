"""Registry tables as observations: a normalized id and a digest of the whole row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the row as JSON with its keys in order and without nulls."""
    return F.sha2(F.to_json(F.struct(*[fields[k].cast("string").alias(k) for k in sorted(fields)])), 256)


def observations(df: DataFrame, source: str, id_field: Column, fields: dict[str, Column], prefix: str) -> DataFrame:
    """(source, observation_id, digest), each once; the id gets the prefix unless it has it. Rows with a null id are left out."""
    i = F.trim(id_field.cast("string"))
    named = F.when(F.upper(i).startswith(prefix.upper()), i).otherwise(F.concat(F.lit(prefix), i))
    return df.where(id_field.isNotNull()).select(F.lit(source).alias("source"), named.alias("observation_id"), row_digest(fields).alias("digest")).distinct()


def registry_observations(hgnc: DataFrame, ensembl: DataFrame, uniprot: DataFrame, chembl: DataFrame) -> DataFrame:
    docs = hgnc.select(F.explode("response.docs").alias("d")).select("d.*")
    parts = [
        observations(docs, "hgnc", docs.hgnc_id, {c: docs[c] for c in ("hgnc_id", "symbol", "status")}, "HGNC:"),
        observations(ensembl, "ensembl", ensembl.id, {c: ensembl[c] for c in ("id", "biotype", "species")}, "ENSEMBL:"),
        observations(uniprot, "uniprot", uniprot.primaryAccession, {"primaryAccession": uniprot.primaryAccession, "taxon": uniprot["organism.taxonId"]}, "UniProt:"),
        observations(chembl, "chembl", chembl.molecule_chembl_id, {c: chembl[c] for c in ("molecule_chembl_id", "molecule_type")}, "ChEMBL:"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def mondo_observations(documents: DataFrame) -> DataFrame:
    """(source, observation_id, digest) of JSON documents (json) of diseases, each an object with an id; others are left out."""
    rows = documents.select("json", F.get_json_object("json", "$.id").alias("id"), F.get_json_object("json", "$.lbl").alias("lbl"))
    return observations(rows, "mondo", rows["id"], {"id": rows["id"], "lbl": rows["lbl"]}, "MONDO:")


def chebi_observations(files: DataFrame) -> DataFrame:
    """(source, observation_id, digest) of tab-separated files (content): the first row behind the header, as the registry's form has one entity a file; files without it have none."""
    line = F.try_element_at(F.split(F.trim("content"), "\r?\n"), F.lit(2))
    rows = files.select(F.split(line, "\t").alias("x")).where("x is not null")
    rows = rows.select(F.try_element_at("x", F.lit(1)).alias("chebi_id"), F.coalesce(F.try_element_at("x", F.lit(2)), F.lit("")).alias("name"))
    return observations(rows, "chebi", rows["chebi_id"], {"chebi_id": rows["chebi_id"], "name": rows["name"]}, "CHEBI:")
