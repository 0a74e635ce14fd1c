"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Every text streams through the automaton, which tracks the longest match that ends at each word; where it reaches a
window's length the window's words are hit and the automaton's state names the items that hold it. Before that, array
operations over a whole batch leave only stretches whose neighbouring words are neighbours in some item: no window can
lie elsewhere.

The automaton grows with the benchmark, so the benchmark is dealt to parts of bounded size, and each part is one more
narrow pass over the rows, which carry what the earlier parts hit. Items are never cut: a window lies within one item.

Defined cases: a null text has no words; an item without words or without an id is left out; equal items or repeated
item ids count once by id; an empty benchmark hits nothing; repeated rows are judged alike; a text of any length is
streamed whole; of two items with the same window both are named, in the order of their ids as text; other columns are
carried past the scan under one name, so none can clash; an empty table of documents gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut_spans, prepare, slices

#: Bytes of item texts in one automaton, about.
PART_BYTES = 2 << 20
WINDOW = 8

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def words_of(array: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words in order, where they start and stop in their text's bytes, and each text's first word."""
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    if array.buffers()[2] is None or low == high:
        none = np.zeros(0, np.int64)
        return pa.array([], pa.binary()), none, none, np.zeros(len(array) + 1, np.int64)
    data = _FOLD[np.frombuffer(array.buffers()[2], np.uint8)[low:high]]
    at = offsets - low
    inside = _WORD[data]
    before = np.concatenate([[False], inside[:-1]])
    before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    # A word ends before a byte that is none of its own: another kind of byte, or the next text's first.
    after = np.concatenate([inside[1:], [False]])
    last = at[1:-1]
    after[last[last > 0] - 1] = False
    stops = np.flatnonzero(inside & ~after) + 1
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=ends[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    first = np.searchsorted(starts, at)
    base = np.repeat(at[:-1], np.diff(first))
    return words, starts - base, stops - base, first


class SuffixAutomaton:
    """All runs of consecutive words of any item, as states of one automaton."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.length, self.link, self.next = [0], [-1], [{}]
        own: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
                own.setdefault(last, set()).add(name)
        for name, words in items:
            if 0 < len(words) < window:
                s = 0
                for w in words:
                    s = self.next[s][w]
                self.short.setdefault(s, []).append((len(words), name))
        # Names go up the links as far as states that hold a whole window.
        self.items: dict[int, set[str]] = {}
        length, link = self.length, self.link
        for s in sorted((s for s in range(len(length)) if length[s] >= window), key=length.__getitem__, reverse=True):
            names = self.items.setdefault(s, set())
            names |= own.get(s, set())
            if link[s] > 0 and length[link[s]] >= window:
                self.items.setdefault(link[s], set()).update(names)

    def _extend(self, last: int, w: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        now = len(length)
        length.append(length[last] + 1), link.append(0), nxt.append({})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[now] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return now

    def _clone(self, p: int, w: int, q: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        copy = len(length)
        length.append(length[p] + 1), link.append(link[q]), nxt.append(dict(nxt[q]))
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def matches(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """At each word the state and the length of the longest match that ends there."""
        length, link, nxt = self.length, self.link, self.next
        s = n = 0
        for w in words:
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if w in nxt[s]:
                s = nxt[s][w]
                n += 1
            yield s, n

    def hits(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [i, j) of windows' words that occur, and the items they are of."""
        spans, names = [], set()
        window, length, link = self.window, self.length, self.link
        for i, (s, n) in enumerate(self.matches(words)):
            if n >= window:
                t = s
                while length[link[t]] >= window:
                    t = link[t]
                names |= self.items[t]
                spans.append((i + 1 - window, i + 1))
            if self.short:
                t, m = s, n
                while t > 0:
                    for size, name in self.short.get(t, ()):
                        if size <= m:
                            names.add(name)
                            spans.append((i + 1 - size, i + 1))
                    t = link[t]
                    m = length[t]
        return spans, names


class Index:
    """One part of the benchmark: its words, its neighbouring words, its automaton."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        found, _, _, first = words_of(pa.array([t for _, t in items], pa.string()))
        coded = found.dictionary_encode()
        self.words = coded.dictionary
        ids = coded.indices.to_numpy().astype(np.int64)
        lists = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        self.automaton = SuffixAutomaton([(n, w) for (n, _), w in zip(items, lists, strict=True)], window)
        self.least = min([window, *(len(w) for w in lists if w)])
        self.size = max(1, len(self.words))
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(w[:-1], np.int64) * self.size + np.array(w[1:], np.int64) for w in lists)]))

    def stretches(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops of the stretches that can hold a window."""
        n = len(ids)
        joined = np.zeros(n + 1, bool)  # word i goes on from word i - 1
        near = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0)) + 1
        if len(near) and len(self.pairs):
            key = ids[near - 1] * self.size + ids[near]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[near[self.pairs[at] == key]] = True
        joined[first] = False
        starts = np.flatnonzero(~joined[:n])
        stops = np.append(starts[1:], n)
        fit = (stops - starts >= self.least) & (ids[starts] >= 0) if n else np.zeros(0, bool)
        return starts[fit], stops[fit]


#: This worker's last part, by a name that no other part has.
_indexes: dict[str, Index] = {}


def _pass(items, number: str, window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _indexes:
            _indexes.clear()
            _indexes[number] = Index(items.value, window)
        index = _indexes[number]
        for batch in batches:
            for part in slices(batch, "text"):
                words, starts, stops, first = words_of(part.column("text"))
                ids = pc.fill_null(pc.index_in(words, value_set=index.words), -1).to_numpy().astype(np.int64)
                old_hits, old_items = part.column("hits").to_pylist(), part.column("items").to_pylist()
                hits, names = [set(h or ()) for h in old_hits], [set(x or ()) for x in old_items]
                for a, b in zip(*index.stretches(ids, first), strict=True):
                    spans, of = index.automaton.hits(ids[a:b].tolist())
                    if of:
                        row = int(np.searchsorted(first, a, "right")) - 1
                        names[row] |= of
                        for i, j in spans:
                            hits[row].update(range(a + i - first[row], a + j - first[row]))
                spans = []
                for row, h in enumerate(hits):
                    order, own = sorted(h), []
                    for w in order:
                        i = first[row] + w
                        if own and own[-1][2] == w - 1:
                            own[-1][1:] = [int(stops[i]), w]
                        else:
                            own.append([int(starts[i]), int(stops[i]), w])
                    spans.append([{"start": a, "stop": b} for a, b, _ in own])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(k) for k in part.schema.names if k not in ("n_words", "hits", "items", "spans")),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([sorted(map(int, h)) for h in hits], pa.list_(pa.int32())),
                        pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    ],
                    [*(k for k in part.schema.names if k not in ("n_words", "hits", "items", "spans")), "n_words", "hits", "items", "spans"],
                )

    return run


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The other columns of docs as one struct column doc, text, and n_words, hits (numbers of hit words), items, spans.

    Spans are byte offsets into the text's UTF-8, from a hit word's start to the stop of the last hit word after it.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).filter("name is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // part_bytes))
    kind = "array<struct<start:int,stop:int>>"
    rows = docs.select(F.struct(*([docs[c] for c in docs.columns if c != text_column] or [F.lit(True).alias("alone")])).alias("doc"), F.col(text_column).alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<int>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"), F.expr(f"cast(array() as {kind})").alias("spans"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    for k in range(parts):
        # Each part is about part_bytes: that bounds what is brought here and sent out at once.
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == k)
        texts = spark.sparkContext.broadcast([(r["name"], r["text"]) for r in own.collect()])
        rows = rows.mapInArrow(_pass(texts, uuid.uuid4().hex, window), schema)
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, window: int = WINDOW, text_column: str = "text", **options) -> DataFrame:
    """docs with hit spans cut out of their texts.

    A document goes if at least the share coverage of its words is hit; texts without a hit are untouched.
    """
    names = docs.columns
    found = scan(docs, benchmark, window, text_column, **options)
    hit = F.size("hits")
    kept = found.filter((F.col("n_words") == 0) | (hit < F.col("n_words") * coverage))
    cleaned = F.when(hit > 0, cut_spans(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return kept.select(*(cleaned.alias(c) if c == text_column else F.col("doc")[c].alias(c) for c in names))
