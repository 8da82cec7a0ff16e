import pytest
from pyspark.sql import functions as F

from graphloom.llm import linkage as lk

HGNC = "batch_id long, response struct<docs: array<struct<hgnc_id: string, symbol: string, name: string, status: string, locus_group: string, location: string, alias_symbol: array<string>>>>"
ENSEMBL = "id string, display_name string, biotype string, species string, description string"
UNIPROT = "primaryAccession string, uniProtkbId string, proteinDescription struct<recommendedName: struct<fullName: struct<value: string>>>, organism struct<taxonId: long>"
CHEMBL = "molecule_chembl_id string, pref_name string, molecule_type string"


def link(spark, hgnc=(), ensembl=(), uniprot=(), chembl=()):
    docs = [(1, ([(i, s, n, "Approved", None, None, a) for i, s, n, a in hgnc],)), (2, None)]
    tables = (
        spark.createDataFrame(docs, HGNC),
        spark.createDataFrame([(i, s, None, sp, n) for i, s, sp, n in ensembl], ENSEMBL),
        spark.createDataFrame([(i, e, None if n is None else (((n,),),), None if t is None else (t,)) for i, e, n, t in uniprot], UNIPROT),
        spark.createDataFrame(chembl, CHEMBL),
    )
    return {(r["key_a"], r["key_b"]): r["confidence"] for r in lk.link(lk.gene_records(*tables)).collect()}


FAMILIES = ("zalomomedase receptor subunit", "hunavalumylin synthase", "kovivozenin like protein", "dugunapetropin kinase", "bamadofegulin adaptor protein")
H = [(f"HGNC:{f}{m}", f"{sym}{m}", f"{name} {m}", [f"WX{f}Z{m}"]) for f, (name, sym) in enumerate(zip(FAMILIES, ("QRSTV", "BCDFG", "HJKLM", "NPQRS", "TVWXZ")), 1) for m in (1, 2, 3)]
E = [(f"ENSG{f}{m}", f"{sym.lower()}-{m}", "homo_sapiens", f"{name.replace('protein', 'prot.')} {'I' * m}") for f, (name, sym) in enumerate(zip(FAMILIES, ("QRSTV", "BCDFG", "HJKLM", "NPQRS", "TVWXZ")), 1) for m in (1, 2, 3)]
EXPECTED = {(f"ENSG{f}{m}", f"HGNC:{f}{m}") for f in range(1, 6) for m in (1, 2, 3)}


def test_members_of_a_family_stay_apart(spark):
    assert set(link(spark, H, E)) == EXPECTED


def test_mistakes_aliases_and_missing_names(spark):
    e = [("E1", None, "homo_sapiens", "zalomomedsae receptor subunit, member beta"), ("E2", "WX2Z1", "homo_sapiens", None), ("E3", "QRSTV1.1", "homo_sapiens", "novel transcript"), ("E4", "QRSTV1", "mus_musculus", FAMILIES[0] + " 1")]
    found = set(link(spark, H, E + e)) - EXPECTED
    assert found == {("E1", "HGNC:12"), ("E2", "HGNC:21"), ("E3", "HGNC:11")}


def test_proteins_stand_for_genes_and_molecules_must_be_them(spark):
    u = [("P1", "QRST1_HUMAN", "Receptor subunit 1, zalomomedase", 9606), ("P2", "P2_RAT", "Hunavalumylin synthase 2", None), ("P3", "TVWXZ3_HUMAN", None, None)]
    c = [("CHEMBL1", "RECOMBINANT HUMAN ZALOMOMEDASE RCPT SU ALPHA", "Protein"), ("CHEMBL2", "ANTI-ZALOMOMEDASE RECEPTOR SUBUNIT 1 ANTIBODY", "Antibody"), ("CHEMBL3", "HUNAVALUMYLIN SYNTHASE 2 INHIBITOR", "Small molecule"), ("CHEMBL4", "VELORASTIN", None), ("CHEMBL5", None, "Protein")]
    found = set(link(spark, H, E, u, c)) - EXPECTED
    assert found == {("HGNC:11", "P1"), ("ENSG11", "P1"), ("CHEMBL1", "HGNC:11"), ("CHEMBL1", "ENSG11"), ("CHEMBL1", "P1"), ("HGNC:53", "P3"), ("ENSG53", "P3")}


def test_repeated_records_and_nulls(spark):
    again = [(None, "QRSTV1", "homo_sapiens", "x"), ("E9", None, "homo_sapiens", None), ("E8", "", None, "")]
    assert set(link(spark, H + H, E + E + again)) == EXPECTED
    assert link(spark) == {}


def test_confidence_is_a_probability(spark):
    values = link(spark, H, E).values()
    assert all(0.5 <= v <= 1 for v in values)


def test_estimate_separates_matches_from_chance():
    counts = {(4, 5, 2): 900, (1, 1, 1): 500, (1, 1, 2): 700, (3, 0, 0): 100, (0, 5, 2): 300, (2, 1, 1): 20}
    others = {(1, 2, 2): 4000.0, (1, 1, 1): 1e6, (1, 1, 2): 1e5, (1, 0, 0): 1e5, (0, 1, 1): 1e5}
    model = lk.estimate(counts, others)
    assert model.posterior((4, 5, 2)) > 0.99 and model.posterior((0, 5, 2)) > 0.9 and model.posterior((3, 0, 0)) > 0.5
    for nothing_agrees in ((1, 1, 2), (1, 0, 0), (1, 2, 2), (0, 0, 0), (1, 0, 2)):
        assert model.posterior(nothing_agrees) < 0.05
    assert lk.estimate({}).posterior((4, 5, 2)) <= 1


@pytest.mark.parametrize(("name", "words", "member"), [("adaptor protein VI, dozazo", ["adaptor", "dozazo", "protein"], 6), ("ζ-Dozazo adaptor prot.", ["adaptor", "dozazo", "prot"], 6), ("DOZAZO (ADAPTOR PROTEIN) F ALFA", ["adaptor", "alfa", "dozazo", "protein"], 6), ("the ox", ["ox", "the"], None), ("", [], None), (None, [], None)])
def test_names_in_any_order(spark, name, words, member):
    df = spark.createDataFrame([(name,)], "n string").select(lk.name_words(F.col("n")).alias("x"))
    assert tuple(df.select("x.*").first()) == (words, member)


def test_parts_of_names_are_learned(spark):
    rows = [(f"{f}{m}{v}", f"{'QRSTVWXZ'[f]}BCD{m}", None, ["kinase", name, *extra], m) for f, name in enumerate(("zalomomedase", "hunavalumylin", "kovivozenin", "dugunapetropin")) for m in (1, 2, 3) for v, extra in enumerate(([], [], ["fragment"]))]
    rows += [(f"u{i}", f"X{'BCDFGHJK'[i]}YZ{i}", None, ["uncharacterized"], None) for i in range(8)]
    profiles = spark.createDataFrame([(bytearray(k.encode()), own, e, w, m) for k, own, e, w, m in rows], "profile binary, own string, entry string, words array<string>, member int")
    got = {bytes(r["profile"]).decode(): (r["stem"], r["role"]) for r in lk.name_parts(profiles).collect()}
    assert got["112"] == ("hunavalumylin", ["kinase"]) == got["111"] and got["u3"] == (None, None) and len(got) == len(rows)


def test_what_acts_on_a_protein_is_learned(spark):
    rows = [("Protein", f"recombinant X{i} kinase") for i in range(20)] + [("Antibody", f"anti-X{i} kinase antibody") for i in range(9)] + [(None, "anti-X3 kinase"), ("Protein", None)]
    assert {r["word"] for r in lk.acting(spark.createDataFrame(rows, "type string, name string")).collect()} == {"anti", "antibody"}


def test_hot_block_is_spread_and_kept_whole(spark):
    n = 100_000
    h = spark.range(n).select(*lk.record(F.concat(F.lit("H"), "id"), "hgnc", F.lit("human"), F.lit("HOT1"), F.array(F.concat(F.lit("A"), "id")), None, F.lit(None).cast("string")))
    e = spark.range(1).select(*lk.record(F.lit("E1"), "ensembl", F.lit("human"), F.lit("HOT1"), None, None, F.lit(None).cast("string")))
    assert lk.link(h.union(e), threshold=0.0).count() == n


def test_blocking_loses_no_link_of_the_cross_product(spark):
    links = set(link(spark, H, E))
    records = lk.gene_records(*[spark.createDataFrame([], s) for s in (HGNC, ENSEMBL, UNIPROT, CHEMBL)])
    assert records.count() == 0
    assert links == {(e[0], h[0]) for h in H for e in E if e[0][4:] == h[0][5:]}


def test_extra_columns_may_clash(spark):
    r = lk.gene_records(*[spark.createDataFrame([], s) for s in (HGNC, ENSEMBL, UNIPROT, CHEMBL)]).withColumn("profile", F.lit("x")).withColumn("stem", F.lit("y"))
    assert lk.link(r).collect() == []
