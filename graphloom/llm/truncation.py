"""Texts that lost their end to a field limit or a broken transfer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from graphloom.llm.encoding import chunks
from graphloom.llm.radix import places, radix_plan
from graphloom.operators.skew import mark_members, salted_join
from graphloom.scratch import drop_table, write_table

_CLOSERS = "\"'”’»)]"
_STOPS = ".!?。\n"
_TOKEN = regex.compile(r"\d+(?:[.,:\-]\d+)*|\p{L}[\p{L}\p{M}\p{N}]*(?:['’\-_:][\p{L}\p{N}]+)*|\n|[^\w\s]|\w")
#: A trace of a cut: dots or a broken character behind the text.
_TRACE = regex.compile(r"(?:[\s…�]|\.{3,}|\[(?=[\s…�]*(?:\.{3,}[\s…�]*)?$))+$")
_TRACED = regex.compile(r"[…�]|\.{3}")
_ENDED = regex.compile(r"[.!?。][\"'”’»)\]]*(?:\s*[^\w\s.]+)*$")
_JSON = regex.compile(r'"(?:[^"\\]|\\.)*+("?)|[\[\]{}]')

#: Occurrences per document that make a word's own ends count; those of rarer words are taken by form.
OWN_SHARE, OWN_LEAST = 0.004, 4
#: Occurrences per document from which a last word is known, whatever goes on from it.
KNOWN_SHARE, KNOWN_LEAST = 0.0002, 2
#: A last word that ends a sentence, line or text more rarely is followed by something.
ENDS = 0.05
#: At a field limit, a last word that ends a sentence, line or text so often may be the true end.
ENDS_AT_LIMIT = 0.5
#: Share of the documents of a source, and least number, that a field limit cuts.
LIMIT_SHARE, LIMIT_LEAST = 0.002, 5
#: Bytes of vocabulary that one trie holds.
TRIE_BYTES = 4 << 20


def _core(text: str) -> tuple[str, bool]:
    """The text without what may trail behind a cut, and whether that shows a cut."""
    m = _TRACE.search(text)
    return (text[: m.start()], bool(_TRACED.search(m.group()))) if m else (text, False)


def _unclosed(text: str) -> bool:
    """True if a JSON text ends inside a string, an array or an object."""
    depth = 0
    for m in _JSON.finditer(text):
        if m.group() in "[{":
            depth += 1
        elif m.group() in "]}":
            depth -= 1
        elif not (len(m.group()) > 1 and m.group(1)):
            return True
    return depth > 0


def _state(core: str, traced: bool, text: str) -> str:
    if core.lstrip()[:1] == "{":
        return "broken" if _unclosed(text) else "whole"
    if traced:
        return "traced"
    return "whole" if _ENDED.search(core) else "open"


_READ = "kind string, word string, n long, ends long, id {id}, source string, chars long, bytes long, state string, start boolean"


def _ends(tokens: list[str]) -> Iterator[str]:
    """The tokens that end a sentence, a line or the text, closing quotes and brackets behind them left out."""
    after = True
    for t in reversed(tokens):
        if t in _STOPS:
            after = True
        elif not (after and t in _CLOSERS):
            if after:
                yield t
            after = False


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part of the texts: words with their numbers and ends, an open end left out; sources with their numbers; a row for each text that isn't whole.

    All numbers are one word, "0". A row's word is the text's last token, and start whether that begins a sentence; "^" stands for all words that do.
    """
    for batch in (b for whole in batches for b, _ in chunks(whole)):
        words: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        out: dict[str, list] = {c: [] for c in ("i", "word", "source", "chars", "bytes", "state", "start")}
        sources = Counter(batch["source"].to_pylist())
        for i, (text, source) in enumerate(zip(batch["text"].to_pylist(), batch["source"].to_pylist())):
            core, traced = _core(text)
            if not core:
                continue
            state = _state(core, traced, text)
            tokens = ["0" if t[0].isdigit() else t for t in _TOKEN.findall(core)]
            starts = sum(1 for a, b in zip(tokens, tokens[1:]) if a in _STOPS[:-1] and b not in _STOPS)
            if state == "whole":
                words.update(tokens)
                words["^"] += starts
                ends.update(_ends(tokens))
                ends["^"] += sum(1 for a, b, c in zip(tokens, tokens[1:], tokens[2:]) if a in _STOPS[:-1] and c in _STOPS and b not in _STOPS)
                continue
            words.update(tokens[:-1])
            words["^"] += starts
            cut = max((k for k, t in enumerate(tokens) if t in _STOPS), default=-1)
            ends.update(_ends(tokens[: cut + 1]))
            plain = [t for t in tokens[-24:] if t != "\n"]
            while plain and plain[-1] in _CLOSERS:
                plain.pop()
            start = len(plain) > 1 and plain[-2] in _STOPS[:-1]
            for c, v in zip(out, (i, plain[-1] if plain else None, source, len(text), len(text.encode()), state, start)):
                out[c].append(v)
        rows = [("w", w, n, ends[w], None) for w, n in words.items() if w != "\n"] + [("s", None, n, None, s) for s, n in sources.items()]
        kinds, names, ns, es, of = zip(*rows) if rows else ((),) * 5
        m, n = len(rows), len(out["i"])
        both = lambda a, b, kind: pa.concat_arrays([pa.array(a, kind), pa.array(b, kind)])
        pad, long = [None] * m, pa.int64()
        yield pa.RecordBatch.from_arrays(
            [
                both(kinds, ["d"] * n, pa.string()), both(names, out["word"], pa.string()), both(ns, [None] * n, long), both(es, [None] * n, long),
                pa.concat_arrays([pa.nulls(m, batch["id"].type), batch["id"].take(pa.array(out["i"], long))]), both(of, out["source"], pa.string()),
                both(pad, out["chars"], long), both(pad, out["bytes"], long), both(pad, out["state"], pa.string()), both(pad, out["start"], pa.bool_()),
            ],
            names=["kind", "word", "n", "ends", "id", "source", "chars", "bytes", "state", "start"],
        )


class WordTrie:
    """A trie of words, in which a node knows whether a word goes on from it."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            at = self.root
            for c in w:
                at = at.setdefault(c, {})

    def goes_on(self, prefix: str) -> bool:
        at = self.root
        for c in prefix:
            at = at.get(c)
            if at is None:
                return False
        return bool(at)


_PLACED = "bucket int, word string, asked boolean, sure boolean"


def _place(batches: Iterator[pa.RecordBatch], bounds: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Adds the bucket of each word. Where the next bucket begins with an asked word, the vocabulary is sure to go on from it."""
    for b in batches:
        at = places(pa.array([w.encode() for w in b["word"].to_pylist()], pa.binary()), bounds)
        nexts = [bounds[k + 1] if k + 1 < len(bounds) else b"" for k in at.tolist()]
        sure = [a and n != w.encode() and n.startswith(w.encode()) for a, w, n in zip(b["asked"].to_pylist(), b["word"].to_pylist(), nexts)]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b["word"], b["asked"], pa.array(sure, pa.bool_())], names=["bucket", "word", "asked", "sure"])


def _proper_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    asked, sure = t["asked"].to_numpy(zero_copy_only=False), t["sure"].to_pylist()
    words = t["word"].to_pylist()
    trie = WordTrie([w for w, a in zip(words, asked) if not a])
    yield pa.RecordBatch.from_arrays([pa.array([w for w, a, s in zip(words, asked, sure) if a and (s or trie.goes_on(w))], pa.string())], names=["word"])


def fragments(asked: DataFrame, words: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The words of asked (word) from which a word of the vocabulary goes on: words (word, n) with n of 2 or more.

    The vocabulary is spread by its bytes over radix buckets of trie_bytes at most, each of which has a
    trie and answers for the asked words whose place is in it. The words that go on from a word are its successors in
    the order of bytes, so they begin in its own bucket or with the bound of the next.
    """
    vocabulary = words.where("n >= 2").select("word")
    sized = vocabulary.select(F.encode("word", "UTF-8").alias("k"), (F.octet_length("word") + 30).cast("long").alias("size"))
    bounds = radix_plan(sized, trie_bytes)
    if not bounds:
        return asked.select("word").limit(0)
    both = asked.select("word", F.lit(True).alias("asked")).union(vocabulary.select("word", F.lit(False).alias("asked")))
    placed = both.mapInArrow(lambda it: _place(it, bounds), _PLACED)
    return placed.repartitionById(len(bounds), F.col("bucket")).select("word", "asked", "sure").mapInArrow(_proper_prefixes, "word string")


def field_limits(ends: DataFrame, sizes: DataFrame) -> DataFrame:
    """(limit) keys of lengths at which a source cuts: many open ends of exactly this length, many of them inside a word.

    ends has source, chars, bytes, fragment of the open texts; sizes the documents of each source.
    A length counts in characters or bytes, whichever has more such ends.
    """
    one = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("u")
    counts = ends.select(F.coalesce("source", F.lit("")).alias("source"), "fragment", one).groupBy("source", "u.unit", "u.length").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fragment").cast("int")).alias("broken"))
    near = W.Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-3, 3)
    counts = counts.withColumn("beside", F.sum("n").over(near) - F.col("n"))
    best = W.Window.partitionBy("source", "length").orderBy(F.desc("n"), F.desc("unit"))
    least = F.greatest(F.lit(LIMIT_LEAST), F.col("documents") * LIMIT_SHARE)
    found = counts.join(sizes, "source").where((F.col("n") >= least) & (F.col("broken") >= 3) & (F.col("broken") >= 0.25 * F.col("n")) & (F.col("n") >= F.col("beside")))
    return found.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(_limit_key(F.col("source"), F.col("unit"), F.col("length")).alias("limit"))


def _limit_key(source: Column, unit: Column, length: Column) -> Column:
    return F.concat_ws("\x1f", F.coalesce(source, F.lit("")), unit, length.cast("string"))


def _form(word: Column) -> Column:
    """The kind of a token, for words too rare to count by themselves; punctuation, and "^", is a kind of its own each."""
    return (
        F.when(~word.rlike(r"^[\p{L}\p{M}\p{N}]") | (word == "0"), word)
        .when(word.rlike(r"\p{N}"), "mixed")
        .when(word.rlike(r"^\p{Ll}$"), "letter")
        .when(word.rlike(r"^[^\p{Ll}]{2,}$"), "upper")
        .otherwise(F.when(word.rlike(r"^\p{Lu}"), "capital").otherwise("lower"))
    )


def cut_texts(df: DataFrame, id_column: str, text: str, source: str) -> DataFrame:
    """(id) of each text that was cut before its end; a repeated id once.

    A text that a full stop or the like ends, or a JSON text that closes, is whole. Of the others,
    these are cut: texts with a trace of it (dots or a broken character behind them), JSON texts
    that end open, texts whose last word is no known word but the beginning of one (by the tries of fragments()), open texts as
    long as a field limit of their source, unless their last word mostly ends something, and texts whose last word
    ends a sentence, a line or a text in less than a twentieth of its cases in the corpus, and texts hardly more often than
    texts cut anywhere would. Words too rare to tell are taken by their form, and words that begin a sentence together. Field limits are lengths with
    unusually many open ends, a quarter of them within a word.

    One pass over all texts counts words in the map tasks; what is shuffled are counts, and a row for each text that isn't whole. The driver gets
    the numbers of some forms and the bounds of the tries.
    Null and blank texts are no cases, nor are rows with a null id. A null source is a source of its own.
    """
    pick = lambda c: F.col(f"`{c}`")
    docs = df.select(pick(id_column).alias("id"), pick(text).cast("string").alias("text"), pick(source).cast("string").alias("source")).where("id is not null and text is not null")
    read = write_table(docs.mapInArrow(_read, _READ.format(id=docs.schema["id"].dataType.simpleString())))
    sizes = read.where("kind = 's'").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("n").alias("documents"))
    n = sizes.agg(F.sum("documents")).first()[0] or 1
    words = write_table(read.where("kind = 'w'").groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")))
    found = read.where("kind = 'd'").select("id", "source", "chars", "bytes", "state", "start", F.coalesce("word", F.lit("")).alias("word"))

    lasts = write_table(found.where("state = 'open'").groupBy("word").agg(F.count(F.lit(1)).alias("texts")).join(words, "word", "left").na.fill(0, ["n", "ends"]))
    unknown = lasts.where(F.col("n") < max(KNOWN_LEAST, int(KNOWN_SHARE * n))).where(F.col("word").rlike(r"^\p{L}[\p{L}'’\-]*$"))
    broken = fragments(unknown, words).distinct().withColumn("fragment", F.lit(True))
    lasts = write_table(lasts.join(broken, "word", "left").na.fill(False, ["fragment"]))
    ends = write_table(salted_join(found.where("state = 'open'"), lasts.select("word", "texts", "fragment"), ["word"], "texts", F.xxhash64("id")))
    limits = write_table(field_limits(ends, sizes))
    ends = mark_members(ends.withColumn("key_c", _limit_key(F.col("source"), F.lit("chars"), F.col("chars"))), "key_c", limits, "at_chars")
    ends = mark_members(ends.withColumn("key_b", _limit_key(F.col("source"), F.lit("bytes"), F.col("bytes"))), "key_b", limits, "at_bytes")
    ends = write_table(ends.select("id", "word", "start", "fragment", (F.col("at_chars") | F.col("at_bytes")).alias("at_limit")))

    # what is cut for other reasons proves no end of a word, and a text doesn't prove its own
    closing = ends.where("not fragment and not at_limit").groupBy(F.when(F.col("start"), "^").otherwise(F.col("word")).alias("word")).agg(F.count(F.lit(1)).alias("closing"))
    counted = write_table(lasts.select("word", "texts", "n", "ends").union(words.where("word = '^'").select("word", F.lit(0).cast("long").alias("texts"), "n", "ends")).join(closing, "word", "left").na.fill(0, ["closing"]))
    drop_table(lasts)
    form, key = _form(F.col("word")), F.col("word")
    sums = words.groupBy(form.alias("form")).agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).join(counted.groupBy(form.alias("form")).agg(F.sum("closing").alias("closing")), "form")
    forms = sums.where(F.col("form").isin("mixed", "letter", "upper", "capital", "lower", "^")).collect()
    total = words.where("word <> '^'").agg(F.sum("n")).first()[0] or 1
    chance = (counted.agg(F.sum("closing")).first()[0] or 0) / total
    drop_table(words)

    def rate(ending: Column, closing: Column, of: Column) -> Column:
        """How often the word ends something, where texts cut anywhere don't explain its ends of texts; else how often it ends what is whole."""
        return F.when(closing > 2 * chance * of + 2, (ending + closing) / (of + closing) + ENDS).otherwise((ending + closing) / F.greatest(of + closing, F.lit(1)))

    others = F.greatest(F.col("closing") - 1, F.lit(0))
    of_form = F.lit(0.0)
    by_form = {r["form"]: rate(F.lit(r["ends"]), F.lit(r["closing"]), F.lit(r["n"])) for r in forms}
    for kind, value in by_form.items():
        of_form = F.when(form == kind, value).otherwise(of_form)
    rare = (F.col("n") + F.col("closing") < max(OWN_LEAST, OWN_SHARE * n)) & form.isin("mixed", "letter", "upper", "capital", "lower")
    letter = key.rlike(r"^\p{Ll}$")  # cut words of one letter are too many for its ends of texts to say anything
    rated = write_table(counted.where("texts > 0").select("word", "texts", F.when(letter, F.col("ends") / F.greatest(F.col("n"), F.lit(1))).when(rare, of_form).otherwise(rate(F.col("ends"), others, F.col("n"))).alias("rate"), (F.col("ends") + others).alias("others")))
    seen = salted_join(ends, rated, ["word"], "texts", F.xxhash64("id"))
    may_end = ~key.rlike(r"^\p{L}$") & (F.col("rate") >= ENDS_AT_LIMIT) & (F.col("others") >= 2)
    began = F.when(F.col("start"), by_form.get("^", F.lit(0.0))).otherwise(F.col("rate"))
    verdict = F.when(F.col("fragment"), True).when(F.col("at_limit"), ~may_end).otherwise(began < ENDS)
    return seen.where(verdict).select("id").union(found.where("state in ('broken', 'traced')").select("id")).distinct()


def rates(df: DataFrame, cut: DataFrame, id_column: str, text: str, source: str) -> DataFrame:
    """(source, documents, cut, rate): of each source's texts that aren't null or blank, how many were cut."""
    texts = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").cast("string").alias("text")).where(~F.col("text").rlike(r"^[\s\p{Z}]*$"))
    marked = texts.select("id", "source").join(cut.withColumn("_cut", F.lit(1)), "id", "left")
    return marked.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("_cut").alias("cut")).withColumn("rate", F.col("cut") / F.col("documents"))
