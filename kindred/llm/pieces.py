"""Splits texts into the pieces that a byte-level BPE merges within, a batch at a time and without a Python loop.

A batch's texts lie end to end in one Arrow buffer. Each byte gets the class of its character; piece boundaries
follow from neighbouring classes, so the whole batch is cut by array operations, and the pieces, which cover the
buffer without gaps, are an Arrow array over the same bytes. Arrow's dictionary encoding then gives the batch's
distinct pieces and each position's code. What the cutting needs besides, some 15 bytes a byte of text, it needs for one
part of the batch at a time.
"""

from __future__ import annotations

import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
_WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters newer than the interpreter's own tables; only those that it calls unassigned take these classes.
_NEWER = {
    LETTER: "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 "
    "113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0",
    NUMBER: "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa",
}
def _stands_for() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


_STANDS_FOR = _stands_for()
#: Bytes of text that are cut at a time, whatever a batch has; a longer text is a part by itself.
PART_BYTES = 1 << 19
_ENDINGS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    category = unicodedata.category
    table = np.fromiter((kinds.get(category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for kind, ranges in _NEWER.items():
        for r in ranges.split():
            a, b = (int(x, 16) for x in r.split("-"))
            for c in range(a, b + 1):
                if category(chr(c)) == "Cn":
                    table[c] = kind
    table[_WHITE] = SPACE
    table[0x20] = BLANK
    return table


def byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Class of each byte's character, and which bytes begin one (None: all do)."""
    table = classes()
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return kind, None
    first = data[lead].astype(np.int32)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
    for k in (1, 2, 3):
        more = size > k
        point[more] = (point[more] << 6) | (data[lead[more] + k] & 0x3F)
    of = table[point]
    kind[lead] = of
    for k in (1, 2, 3):
        more = size > k
        kind[lead[more] + k] = of[more]
    return kind, (data & 0xC0) != 0x80


def boundaries(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets at which pieces begin; starts are those of texts, which no piece crosses."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind, begins = byte_classes(data)
    white = kind >= SPACE
    cut = np.zeros(n, bool)
    before, now = kind[:-1], kind[1:]
    was, isnow = white[:-1], white[1:]
    cut[1:] = np.where(isnow, ~was, np.where(was, before != BLANK, before != now))
    edge = starts[(starts > 0) & (starts < n)]
    text_start = np.zeros(n + 1, bool)
    text_start[edge] = True
    text_start[0] = text_start[n] = True
    # The last white character of a run stands alone, or leads the next piece, if more text follows it.
    if begins is None:
        tail = np.flatnonzero(isnow[:-1] & was[:-1] & ~white[2:]) + 1
        tail = tail[~text_start[tail + 1] & ~text_start[tail]]
    else:
        chars = np.flatnonzero(begins)
        w = white[chars]
        at = np.flatnonzero(w[1:-1] & w[:-2] & ~w[2:]) + 1
        at = at[~text_start[chars[at + 1]] & ~text_start[chars[at]]]
        tail = chars[at]
        cut &= begins
    cut[tail] = True
    cut[edge] = True
    cut[0] = True
    quotes = np.flatnonzero((data == 0x27) & cut)
    if len(quotes):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        for end in _ENDINGS:
            hit = a == end[1]
            if len(end) == 3:
                hit &= b == end[2]
            at = quotes[hit]
            stop = at + len(end)
            fine = stop <= n
            for k in range(1, len(end)):
                fine &= ~text_start[np.minimum(at + k, n)]
            at, stop = at[fine], stop[fine]
            cut[at + 1] = False
            if len(end) == 3:
                cut[at + 2] = False
            cut[stop[stop < n]] = True
    return np.flatnonzero(cut)


def _special_spans(raw: bytes, special: dict[bytes, int], starts: np.ndarray) -> list[tuple[int, int]]:
    found = []
    for name in special:
        at = raw.find(name)
        while at >= 0:
            inside = np.searchsorted(starts, at, "right") == np.searchsorted(starts, at + len(name) - 1, "right")
            if inside:
                found.append((at, at + len(name)))
            at = raw.find(name, at + (len(name) if inside else 1))
    return sorted(found)


def _cuts(data: np.ndarray, starts: np.ndarray, special: dict[bytes, int] | None) -> np.ndarray:
    """boundaries() of texts that lie end to end in data; a special name is one piece."""
    raw = data.tobytes() if special else b""
    spans = _special_spans(raw, special, starts[:-1]) if special and any(name in raw for name in special) else []
    cuts = boundaries(data, np.union1d(starts, np.array(spans, np.int64).ravel()) if spans else starts)
    for a, b in spans:
        cuts = cuts[(cuts <= a) | (cuts >= b)]
    return cuts


def split(array: pa.Array, special: dict[bytes, int] | None = None) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Pieces of all texts in order, and for each text (and the end) the index of its first piece.

    Nulls count as empty texts, which have no pieces.
    """
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    store = array.buffers()[2]
    if store is None or high == low:
        empty = pa.array([], pa.binary()).dictionary_encode()
        return empty, np.zeros(len(array) + 1, np.int64)
    store = store.slice(low, high - low)
    data, starts = np.frombuffer(store, np.uint8), offsets - low
    bounds, first = [], np.zeros(len(array) + 1, np.int64)
    i = found = 0
    while i < len(array):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PART_BYTES, "right")) - 1)
        cuts = _cuts(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], special)
        first[i:j] = found + np.searchsorted(cuts, starts[i:j] - starts[i])
        bounds.append((cuts + starts[i]).astype(np.int32))
        found += len(cuts)
        i = j
    first[-1] = found
    ends = np.concatenate([*bounds, np.array([len(data)], np.int32)])
    del bounds
    return pa.Array.from_buffers(pa.binary(), found, [None, pa.py_buffer(ends), store]).dictionary_encode(), first


class Encoder:
    """Ids of distinct pieces by the tokenizers library; keeps up to cache pieces' ids for later batches (None: all)."""

    def __init__(self, path: str, cache: int | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.known: dict[bytes, bytes] = {}
        self.cache = sys.maxsize if cache is None else cache

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """For each piece its ids as little-endian unsigned 32-bit integers."""
        known = self.known
        new = [p for p in pieces if p not in known]
        if new:
            if len(known) + len(new) > self.cache:
                known.clear()
                new = pieces
            self._learn(new)
        out = list(map(known.__getitem__, pieces))
        if len(known) > self.cache:
            known.clear()
        return out

    def _learn(self, new: list[bytes]) -> None:
        """The library's merge model takes a piece as characters that stand for its bytes; all pieces are mapped at once."""
        known, tokenize = self.known, self.model.tokenize
        plain = [p for p in new if p not in self.special]
        known.update((p, np.array([self.special[p]], "<u4").tobytes()) for p in new if p in self.special)
        joined = b"\n".join(p for p in plain if b"\n" not in p)
        mapped = iter(joined.decode("latin-1").translate(_STANDS_FOR).split(_STANDS_FOR[0x0A]))
        for p in plain:
            stood = next(mapped) if b"\n" not in p else p.decode("latin-1").translate(_STANDS_FOR)
            known[p] = array("I", [t.id for t in tokenize(stood)]).tobytes()


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, cache: int | None = 1_200_000) -> Encoder:
    """This worker's encoder: made once, used by all its tasks."""
    if (path, cache) not in _encoders:
        _encoders[path, cache] = Encoder(path, cache)
    return _encoders[path, cache]
