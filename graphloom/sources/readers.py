"""Readers that turn files into parsed records.

A record is (artifact_id, record_id, record_type, payload map<string,string>, status, error). What
can't be parsed is a record with status error, not a failure. N-Triples and large tables are read
in parallel within a file; the other formats have no safe place to split a file, so a file is a task's unit.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "artifact_id string, record_id string, record_type string, payload map<string,string>, status string, error string"

Row = tuple[str, dict[str, str] | None, str | None]  # kind, payload, error


def _artifact(content: bytes) -> str:
    return "artifact:" + hashlib.sha256(content).hexdigest()[:20]


def _files(spark: SparkSession, path: str, parse: Callable[[str], list[Row]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                artifact = _artifact(content)
                try:
                    rows = parse(content.decode("utf-8"))
                except (ValueError, ET.ParseError) as e:
                    rows = [("file", None, str(e))]
                out = [(artifact, f"{artifact}:{i}", kind, payload, "error" if error else "parsed", error) for i, (kind, payload, error) in enumerate(rows, 1)]
                yield pd.DataFrame(out, columns=["artifact_id", "record_id", "record_type", "payload", "status", "error"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)


def _csv_rows(text: str) -> list[Row]:
    rows = csv.reader(io.StringIO(text))
    header = next(rows, None)
    if header is None:
        return []
    out: list[Row] = []
    for line, r in enumerate(rows, 2):
        if not r:
            continue
        if len(r) != len(header):
            out.append(("row", {"_line": str(line)}, f"line {line} has {len(r)} fields, not {len(header)}"))
        else:
            out.append(("row", dict(zip(header, r)) | {"_line": str(line)}, None))
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A record for each row behind the header, with its number in _line; rows of another width are errors."""
    return _files(spark, path, _csv_rows)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same kind of file as columns, read in parallel; rows that don't fit have only _corrupt."""
    return spark.read.csv(path, schema=f"{schema}, _corrupt string", header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


_TURTLE = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<text>"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w-]*:[\w-]+))?)|(?P<directive>@prefix|@base|PREFIX|BASE)|(?P<name>_:[\w-]+|[\w-]*:[\w.-]*[\w-]|[\w-]*:)|(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<word>a|true|false)(?=[\s;.,])|(?P<mark>[.;,\[\]()])""")


def turtle_triples(text: str) -> list[tuple[str, str, str]]:
    """Triples of a Turtle text: prefixes, 'a', lists with ';' and ','; sorted. An undeclared prefix raises, as do brackets."""
    tokens, at = [], 0
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group()))
        at = m.end()
    prefixes: dict[str, str] = {}

    def term(kind: str, word: str) -> str:
        if kind == "iri":
            return word[1:-1]
        if kind == "name" and not word.startswith("_:"):
            prefix, rest = word.split(":", 1)
            if prefix not in prefixes:
                raise ValueError(f"undeclared prefix {prefix}")
            return prefixes[prefix] + rest
        if kind == "word" and word == "a":
            return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
        if kind == "text":
            return word if "^^" in word else re.sub(r'"(@[A-Za-z-]+)?$', "", word[1:])
        return word

    out, i = [], 0
    while i < len(tokens):
        kind, word = tokens[i]
        if kind == "directive":
            prefixes[tokens[i + 1][1].rstrip(":")] = tokens[i + 2][1][1:-1]
            i += 3 + (i + 3 < len(tokens) and tokens[i + 3][1] == ".")
            continue
        statement = []
        while i < len(tokens) and tokens[i] != ("mark", "."):
            if tokens[i][1] in "[]()":
                raise ValueError("brackets aren't supported")
            statement.append(tokens[i])
            i += 1
        i += 1
        if len(statement) < 3:
            raise ValueError("a statement has less than three parts")
        subject, rest = term(*statement[0]), statement[1:]
        predicate, expect = None, "predicate"
        for k, w in rest:
            if (k, w) == ("mark", ";"):
                expect = "predicate"
            elif (k, w) == ("mark", ","):
                expect = "object"
            elif expect == "predicate":
                predicate, expect = term(k, w), "object"
            else:
                out.append((subject, predicate, term(k, w)))
    return sorted(out)


def _triples(rows: list[tuple[str, str, str]]) -> list[Row]:
    return [("triple", {"subject": s, "predicate": p, "object": o}, None) for s, p, o in rows]


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """A record for each triple, numbered in the order of subject, predicate and object."""
    return _files(spark, path, lambda text: _triples(turtle_triples(text)))


def _rdfxml(text: str) -> list[Row]:
    rdf = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
    out = []
    plain = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag
    for node in ET.fromstring(text):
        subject = node.get(f"{rdf}about") or "_:" + (node.get(f"{rdf}nodeID") or node.get(f"{rdf}ID") or "b")
        if node.tag != f"{rdf}Description":
            out.append((subject, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", plain(node.tag)))
        out += [(subject, plain(k), v) for k, v in node.attrib.items() if not k.startswith(rdf)]
        out += [(subject, plain(p.tag), p.get(f"{rdf}resource") or (p.text or "").strip()) for p in node]
    return _triples(sorted(out))


def read_rdfxml(spark: SparkSession, path: str) -> DataFrame:
    """Triples of RDF/XML whose nodes stand directly below the root."""
    return _files(spark, path, _rdfxml)


def _jsonld(text: str) -> list[Row]:
    data = json.loads(text)
    out: list[Row] = []
    written = lambda v: v if isinstance(v, str) else json.dumps(v, sort_keys=True)
    if isinstance(data, dict) and isinstance(data.get("edges"), list):
        kind, items = "edge", data["edges"]
    elif isinstance(data, dict) and isinstance(data.get("assertions"), list):
        kind, items = "assertion", data["assertions"]
    else:
        kind, items = "node", (data.get("@graph") or data.get("nodes") or [data]) if isinstance(data, dict) else data
    for x in items:
        if not isinstance(x, dict):
            out.append((kind, None, "an item isn't an object"))
        elif kind == "edge" and not ({"from", "source", "subject"} & set(x) and {"to", "target", "object"} & set(x)):
            raise ValueError("an edge lacks an end")
        else:
            out.append((kind, {k: written(v) for k, v in x.items() if v is not None}, None))
    return out


def read_jsonld(spark: SparkSession, path: str) -> DataFrame:
    """Edges, else assertions, else nodes of a JSON graph, without expansion of names."""
    return _files(spark, path, _jsonld)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """A record for each line that is a triple, an error for each other line that isn't blank or a comment; files are split freely."""
    line = F.trim("value")
    pattern = r'^(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.$'
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(line.alias("line"))
    part = lambda i: F.regexp_replace(F.regexp_extract("line", pattern, i), "^<|>$", "")
    ok = F.col("line").rlike(pattern)
    payload = F.when(ok, F.create_map(F.lit("subject"), part(1), F.lit("predicate"), part(2), F.lit("object"), part(3)))
    return rows.select(
        F.lit("artifact:lines").alias("artifact_id"), F.concat(F.lit("line:"), F.substring(F.sha2("line", 256), 1, 20)).alias("record_id"), F.lit("triple").alias("record_type"),
        payload.alias("payload"), F.when(ok, "parsed").otherwise("error").alias("status"), F.when(~ok, F.lit("not a triple")).alias("error"),
    )


class Readers:
    """Readers by media type. Registering a type twice raises, and so does reading an unknown one."""

    def __init__(self) -> None:
        self._by_type: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    @classmethod
    def default(cls) -> Readers:
        out = cls()
        for media, reader in (("text/turtle", read_turtle), ("application/ld+json", read_jsonld), ("text/csv", read_csv)):
            out.register(media, reader)
        return out

    def register(self, media_type: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
        if media_type in self._by_type:
            raise ValueError(f"{media_type} has a reader")
        self._by_type[media_type] = reader

    def read(self, spark: SparkSession, path: str, media_type: str) -> DataFrame:
        if media_type not in self._by_type:
            raise ValueError(f"no reader for {media_type}")
        return self._by_type[media_type](spark, path)


def verified(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The file's content as one row, if it has this digest; else the read fails."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.where(F.when(F.sha2("content", 256) == sha256, True).otherwise(F.raise_error(F.lit("the file isn't the one expected"))))
