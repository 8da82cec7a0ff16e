"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters that are encoded at once, a longer text alone.
CHUNK_CHARS = 2_000_000
#: Distinct words, and their bytes, that a task keeps encoded.
KEPT_WORDS, KEPT_BYTES = 400_000, 16_000_000

_NO_RANK = np.int64(1) << 40


class Merges:
    """The merges of a vocabulary in arrays: sorted pair keys with the rank and the result of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.doubles = left == right  # by rank
        # a vocabulary file writes each byte as a character: printable ones of Latin-1 as they are, the others from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.bytes = np.array([vocab[chars[b]] for b in range(256)], np.int64)

    @classmethod
    def of(cls, parts: dict) -> Merges:
        """From vars() of another one, which any process can read."""
        out = cls.__new__(cls)
        out.__dict__.update(parts)
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NO_RANK where the two don't merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)


def encode_words(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and where each word's begin (one offset more than words).

    All words lie in one array of tokens. An index maps each mergeable pair's rank to all positions
    of the pair. The least rank with positions is applied to all of them at once; the pairs that
    the merged tokens form with their neighbours join the index, and outdated positions are
    skipped when their turn comes.
    """
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length)
    starts = ends - length
    tok = merges.bytes[np.frombuffer(b"".join(words), np.uint8)]
    n = len(tok)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    some = length > 0
    nxt[ends[some] - 1] = -1
    prv[starts[some]] = -1
    alive = np.ones(n, bool)
    rank = np.full(n, _NO_RANK)
    has = np.flatnonzero(nxt >= 0)
    rank[has] = merges.rank(tok[has], tok[nxt[has]])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(pos: np.ndarray) -> None:
        pos = pos[rank[pos] != _NO_RANK]
        if not len(pos):
            return
        of = rank[pos]
        if len(pos) > 1:
            order = np.argsort(of, kind="stable")
            pos, of = pos[order], of[order]
        cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
        for r, part in zip(of[np.concatenate([[0], cuts])].tolist(), np.split(pos, cuts) if len(cuts) else [pos]):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    add(has)
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        pos = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        pos = pos[alive[pos] & (rank[pos] == r)]
        if not len(pos):
            continue
        if merges.doubles[r]:
            pos = np.sort(pos)
            follows = np.concatenate([[False], nxt[pos[:-1]] == pos[1:]])
            first = np.flatnonzero(~follows)
            within = np.arange(len(pos)) - np.repeat(first, np.diff(np.append(first, len(pos))))
            pos = pos[within % 2 == 0]
        right = nxt[pos]
        after = nxt[right]
        tok[pos] = merges.results[r]
        alive[right] = False
        rank[right] = _NO_RANK
        nxt[pos] = after
        linked = after >= 0
        prv[after[linked]] = pos[linked]
        rank[pos] = _NO_RANK
        before = prv[pos]
        changed = np.unique(np.concatenate([pos[linked], before[before >= 0]]))
        rank[changed] = merges.rank(tok[changed], tok[nxt[changed]])
        add(changed)
    kept = np.concatenate([[0], np.cumsum(alive)])
    return tok[alive].astype(np.int32), kept[np.concatenate([starts, [n]])]


class _Words(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts, keeping the ids of the words seen so far."""

    def __init__(self, merges: Merges):
        self.merges, self.split = merges, regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.start, self.count = _Words(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts as numbers, and how many each text has."""
        if len(self.words) > KEPT_WORDS or len(self.ids) * 4 > KEPT_BYTES:
            self._forget()
        known = len(self.words)
        number, per_text, parts = self.words.__getitem__, np.zeros(len(texts), np.int64), []
        for i, t in enumerate(texts):
            if t:
                w = self.split(t)
                per_text[i] = len(w)
                parts.append(np.fromiter(map(number, w), np.int64, len(w)))
        new = list(self.words)[known:] if len(self.words) > known else []
        if new:
            ids, offsets = encode_words([w.encode() for w in new], self.merges)
            self.start = np.concatenate([self.start, len(self.ids) + offsets[:-1]])
            self.count = np.concatenate([self.count, np.diff(offsets)])
            self.ids = np.concatenate([self.ids, ids])
        return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), per_text

    def sizes(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        seq, per_text = self.look_up(texts)
        total = np.concatenate([[0], np.cumsum(self.count[seq])])
        ends = np.cumsum(per_text)
        return total[ends] - total[ends - per_text]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        seq, per_text = self.look_up(texts)
        count = self.count[seq]
        total = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(total[-1]) + np.repeat(self.start[seq] - total[:-1], count)
        ends = np.cumsum(per_text)
        return self.ids[at], total[ends] - total[ends - per_text]


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of about CHUNK_CHARS characters; null texts as empty ones."""
    texts = [t or "" for t in batch["text"].to_pylist()]
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK_CHARS or i == len(texts) - 1:
            yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
            begin, held = i + 1, 0


def encode(df: DataFrame, id_column: str, text: str, vocabulary: str) -> DataFrame:
    """(id, ids array<int>) of each row: the token ids of its whole text.

    vocabulary is the path of a byte-level BPE vocabulary on the driver; its merges are broadcast,
    their size being that of the file. Strings that look like special tokens are ordinary text. An
    empty text and a null one have the empty list. Nothing is shuffled.
    """
    kind = df.schema[id_column].dataType
    merges = df.sparkSession.sparkContext.broadcast(vars(Merges(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges.of(merges.value))
        for batch in batches:
            for part, texts in chunks(batch):
                ids, count = encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["id", "ids"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)


def count(df: DataFrame, keep: list[str], text: str, vocabulary: str, name: str = "tokens") -> DataFrame:
    """The columns keep and the number of token ids of each row's whole text; 0 for empty and null texts."""
    merges = df.sparkSession.sparkContext.broadcast(vars(Merges(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges.of(merges.value))
        for batch in batches:
            for part, texts in chunks(batch):
                yield pa.RecordBatch.from_arrays([*(part[c] for c in range(len(keep))), pa.array(encoder.sizes(texts))], names=[*keep, name])

    chosen = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:-1], T.StructField(name, T.LongType())]))
