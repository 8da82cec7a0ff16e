import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.sources import readers, shaping, writers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return f"file://{tmp_path / name}"


def payloads(df):
    return [(r["record_type"], r["payload"], r["status"]) for r in df.collect()]


def test_csv_rows_of_another_width_are_errors(spark, tmp_path):
    at = put(tmp_path, "a.csv", 'subject,predicate,object\na,p,"b, c"\nshort\n\na,b,c,d\nx,y,z\n')
    got = payloads(readers.read_csv(spark, at))
    assert [(p["_line"], s) for _, p, s in got] == [("2", "parsed"), ("3", "error"), ("5", "error"), ("6", "parsed")]
    assert got[0][1]["object"] == "b, c"
    columns = readers.read_table(spark, at, "subject string, predicate string, object string").collect()
    assert [r["_corrupt"] for r in columns if r["_corrupt"]] == ["short", "a,b,c,d"]


TURTLE = """@prefix ex: <http://x/> .
ex:b a ex:Drug ; ex:treats ex:d , ex:c ; ex:name "Met \\"x\\""@en . # comment
<http://x/a> ex:size "5"^^<http://int> ; ex:n 1.5 .
"""


def test_turtle(spark, tmp_path):
    rows = payloads(readers.read_turtle(spark, put(tmp_path, "a.ttl", TURTLE)))
    triples = [tuple(p[k] for k in ("subject", "predicate", "object")) for _, p, _ in rows]
    assert triples == sorted(triples) and len(triples) == 6
    assert ("http://x/b", "http://x/treats", "http://x/c") in triples and ("http://x/b", "http://x/name", 'Met \\"x\\"') in triples
    (kind, payload, status), *rest = payloads(readers.read_turtle(spark, put(tmp_path, "b.ttl", "ex:a ex:b ex:c .")))
    assert status == "error" and not rest


def test_json_graphs(spark, tmp_path):
    edges = put(tmp_path, "e.json", '{"edges": [{"from": "a", "predicate": "p", "to": "b"}, 5]}')
    assert payloads(readers.read_jsonld(spark, edges)) == [("edge", {"from": "a", "predicate": "p", "to": "b"}, "parsed"), ("edge", None, "error")]
    nodes = put(tmp_path, "n.json", '{"@graph": [{"@id": "a", "@type": "T", "name": null, "n": [1]}]}')
    assert payloads(readers.read_jsonld(spark, nodes)) == [("node", {"@id": "a", "@type": "T", "n": "[1]"}, "parsed")]
    assert payloads(readers.read_jsonld(spark, put(tmp_path, "x.json", '{"edges": [{"from": "a"}]}')))[0][2] == "error"
    assert payloads(readers.read_jsonld(spark, put(tmp_path, "y.json", "{")))[0][2] == "error"


def test_rdf_xml_and_lines(spark, tmp_path):
    xml = put(tmp_path, "a.rdf", '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://x/"><e:Drug rdf:about="http://x/a" e:code="1"><e:name>N</e:name><e:to rdf:resource="http://x/b"/></e:Drug></rdf:RDF>')
    assert {(r[1]["predicate"], r[1]["object"]) for r in payloads(readers.read_rdfxml(spark, xml))} == {("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://x/Drug"), ("http://x/code", "1"), ("http://x/name", "N"), ("http://x/to", "http://x/b")}
    nt = put(tmp_path, "a.nt", '<http://x/a> <http://x/p> "v \\"q\\""@en .\n# no\n\nbroken line\n_:b <http://x/p> <http://x/c> .\n')
    got = payloads(readers.read_ntriples(spark, nt))
    assert sorted(s for _, _, s in got) == ["error", "parsed", "parsed"] and ("triple", {"subject": "_:b", "predicate": "http://x/p", "object": "http://x/c"}, "parsed") in got


def test_registry_of_readers(spark, tmp_path):
    r = readers.Readers.default()
    with pytest.raises(ValueError):
        r.register("text/csv", readers.read_csv)
    with pytest.raises(ValueError):
        r.read(spark, "x", "application/n-triples")
    at = put(tmp_path, "a.csv", "subject,predicate,object\na,p,b\n")
    assert r.read(spark, at, "text/csv").count() == 1
    assert readers.verified(spark, at, hashlib.sha256(b"subject,predicate,object\na,p,b\n").hexdigest()).count() == 1
    with pytest.raises(Exception, match="the file isn't the one expected"):
        readers.verified(spark, at, "0").collect()


def test_shaping(spark):
    rows = [(1, {"subject": "a b", "predicate": "p", "object": "c"}), (2, {"x": "s", "y": "q", "z": "t"}), (3, {"subject": " ", "object": "c"}), (4, None), (5, {"head": "h", "relation": "r", "tail": "<t>"}), (6, {"x": "s", "z": "t"})]
    df = spark.createDataFrame(rows, "seq long, payload map<string,string>")
    got = sorted(tuple(r) for r in shaping.statements(df, "g").collect())
    assert got == [("g_a_1", "g", "a_b", "p", "c"), ("g_a_2", "g", "s", "q", "t"), ("g_a_5", "g", "h", "r", "t")]


def test_versions_swap_and_copies_compare(spark, tmp_path):
    v = writers.Versions(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        v.current()
    v.publish(spark.range(3))
    v.publish(spark.range(5))
    assert v.current().count() == 5
    v.rollback()
    assert v.current().count() == 3
    v.rollback()
    assert v.current().count() == 5
    assert writers.same_rows(spark.range(5), v.current()) and not writers.same_rows(spark.range(5), spark.range(5).union(spark.range(1)))


def test_sorted_files(spark, tmp_path):
    writers.write_sorted(spark.range(50).withColumn("g", F.col("id") % 2), f"file://{tmp_path}/s", ["id"], ["g"])
    assert spark.read.parquet(f"file://{tmp_path}/s").where("g = 1").count() == 25
    writers.write_lines(spark.range(3).selectExpr("cast(id as string) as line"), f"file://{tmp_path}/l")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/l").orderBy("value").collect()] == ["0", "1", "2"]
    writers.write_json(spark.range(1).selectExpr("id as b", "cast(null as string) as a"), f"file://{tmp_path}/j")
    assert spark.read.text(f"file://{tmp_path}/j").first()[0] == '{"a":null,"b":0}'
