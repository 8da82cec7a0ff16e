import unicodedata

import pytest
from pyspark.sql import functions as F

from graphloom.functions import canon, labels, literals, python_exact, times, vectors


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("raw", "name"), [("http://a/b#c", "c"), ("<http://a/b/c>", "c"), ("ex:Thing", "Thing"), ("urn:x:y", "urn:x:y"), (" plain ", "plain"), ("a/b#c/d", "c/d"), ("", ""), (None, None), ("http://a", "a")])
def test_local_name(spark, raw, name):
    assert one(spark, labels.local_name, raw) == name


@pytest.mark.parametrize(("raw", "label"), [("Metformin_Drug", "metformin"), ("Acme  Inc", "acme"), ("ex:Acme-Corp!", "acmecorp"), ("Ärzte Inc", "ärzte"), ("inc", "inc"), (None, None)])
def test_label(spark, raw, label):
    assert one(spark, lambda c: labels.label(c, ("drug", "inc")), raw) == label


@pytest.mark.parametrize(
    ("predicate", "value", "literal"),
    [("hasLipid", "x", True), ("zipcode", "x", True), ("filename", "x", True), ("bodyWeight", "x", True), ("synonym", "x", False), ("startDate", "x", False), ("knows", '"Al"', True), ("knows", "-1.5", True), ("knows", "No", True), ("knows", "2024/01/02", True), ("knows", "5^^xsd:int", True), ("knows", "Bob", False), ("knows", "", False)],
)
def test_literal_or_entity(spark, predicate, value, literal):
    assert spark.createDataFrame([(predicate, value)], "p string, v string").select(literals.is_literal(F.col("p"), F.col("v"))).first()[0] is literal


@pytest.mark.parametrize(
    ("raw", "kind", "lex"),
    [("TRUE", "boolean", "true"), ("yes", "string", "yes"), ("007", "integer", "7"), ("1.50", "float", "1.50"), ("2024/03/05", "string", "2024-03-05"), ("2024-03-05T10:00:00Z", "string", "2024-03-05"), ("2024-03-05 10:00:00", "string", "2024-03-05"), ("12/31/2020", "string", "12/31/2020"), ("2024-03-05T10:00:00", "string", "2024-03-05T10:00:00"), ("05-03-2024", "string", "2024-03-05"), ("'x'", "string", "x"), ('"5"^^xsd:int', "integer", "5")],
)
def test_literal_forms(spark, raw, kind, lex):
    assert tuple(one(spark, literals.literal, raw)) == (kind, lex)


def test_identifiers(spark):
    assert tuple(one(spark, labels.identifier, " HGNC : 5:6 ")) == ("HGNC", "5:6")
    assert one(spark, labels.identifier, ":5") is None and one(spark, labels.identifier, "x") is None
    raw = lambda v: tuple(one(spark, lambda c: labels.resource_identifier(c, {"mesh": "MESH"}, "ENTITY"), v))
    assert raw("urn:isbn:1:2") == ("ISBN", "1:2") and raw("hgnc:5") == ("HGNC", "5") and raw("http://x.org/go/12/") == ("GO", "12") and raw("plain") == ("ENTITY", "plain") and raw("http://x/mesh/D1") == ("MESH", "D1")
    assert one(spark, lambda c: labels.sanitized(c, "none"), " <a b> ") == "a_b" and one(spark, lambda c: labels.sanitized(c, "none"), " ") == "none"


def test_white_space_and_letters(spark):
    assert one(spark, canon.is_blank, "　  \t") and not one(spark, canon.is_blank, "x")
    assert one(spark, canon.bare, "A-b_1！«é»") == "ab1é" and one(spark, canon.strip, "  a b　") == "a b"
    assert one(spark, canon.is_missing, "N/A") and one(spark, canon.is_missing, "…") and not one(spark, canon.is_missing, "Nan0")


def test_python_exact(spark):
    df = spark.createDataFrame([("apple", "aple"), ("", "x"), ("same", "same"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(python_exact.matching_ratio("a", "b")).collect()]
    assert got == [pytest.approx(8 / 9), 0.0, 1.0, 0.0]
    bound = [r[0] for r in df.where("a is not null").select(python_exact.ratio_bound(F.col("a"), F.col("b"))).collect()]
    assert all(b >= g for b, g in zip(bound, got))
    assert one(spark, python_exact.round4, 0.88005, "double") == round(0.88005, 4)
    assert one(spark, python_exact.folded, "Straße  É") == unicodedata.normalize("NFC", "strasse é")
    assert one(spark, python_exact.float_text, 1e16, "double") == "1e+16"
    vector = one(spark, python_exact.hash_embedding(16), "b a a")
    assert sum(v * v for v in vector) == pytest.approx(1.0) and one(spark, python_exact.hash_embedding(16), "!!") == [0.0] * 16


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [tuple(r) for r in df.select(vectors.dot(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("b"))).collect()] == [(10.0, pytest.approx(1.0)), (0.0, 0.0)]


def test_times_dont_depend_on_the_session(spark):
    import datetime as dt

    t = dt.datetime(1969, 12, 31, 23, 59, 59, 5)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert one(spark, times.micros, t, "timestamp_ntz") == -999_995 and one(spark, times.month, t, "timestamp_ntz") == 196912
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_masking(spark):
    assert one(spark, lambda c: labels.masked(c, 30), "token=abc password: x9 " + "z" * 40) == "token=*** password: *** zzzzzz..."
