"""Substring deduplication by hashed lines and the sentences within them.

Every line is covered by units, so a line that was met before goes whole, however short it is. A unit is a sentence of
least_words words at least, or as many shorter ones in a row, between such sentences and the line's ends, as make up
least_words words; what is left of a row goes with the unit before it, or else after it. A line of fewer words is one
unit. Sentences of over long_words words are cut once more, after words that their own hash picks. What a line's units
are depends on its words alone, and each longer sentence sets them right again: so a passage in the middle of a line
falls into the same units wherever it stands, but for its ends. Units are normalised (lower case, single blanks) and
their 128-bit digests grouped over all documents.
The occurrence of least rank (document id, then offset) stays; all others are cut out, and their offsets in the original
text are kept.

A digest that a third of all lines share is one row a task after partial aggregation; in the join that brings it back
to its occurrences their side is split by Spark's skew join, as only one row is on the other.

Defined cases: a null text stays null; a line without words is no unit; a text of any length is cut whole, its spans
are one row's list; rows that agree in both id and text count as one document and are treated alike; rows without an id
rank first, by a hash of their text; a column of the input that has the name of the spans' gives way to them, any other
is carried past unread; empty tables stay empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut_spans, keep, prepare, scratch, texts

LEAST_WORDS = 8
#: A sentence of more words than this may be cut without an end.
LONG_WORDS = 24

_WORD = re.compile(rb"\S+")
_ENDS = re.compile(rb"[.!?]")


def units(text: bytes, least: int = LEAST_WORDS, long: int = LONG_WORDS) -> Iterator[tuple[int, int]]:
    """Byte spans of a text's units, in order; white space after a unit belongs to it."""
    at = 0
    for line in text.split(b"\n"):
        words = [(m.start(), m.group()) for m in _WORD.finditer(line)]
        last = [k for k, (_, w) in enumerate(words) if _ENDS.search(w)]
        if words and (not last or last[-1] != len(words) - 1):
            last.append(len(words) - 1)
        begin = sentence = 0
        found: list[list[int]] = []  # first word and the one after the last
        for k in last:
            size = k - sentence + 1
            if size >= least:
                if begin < sentence and found:
                    found[-1][1] = sentence
                    begin = sentence
                if size > long:
                    since = sentence
                    for j in range(sentence, k - least + 1):
                        if j - since + 1 >= least and zlib.crc32(words[j][1]) & 3 == 0:
                            found.append([begin, j + 1])
                            begin = since = j + 1
                found.append([begin, k + 1])
                begin = k + 1
            elif k - begin + 1 >= least:
                found.append([begin, k + 1])
                begin = k + 1
            sentence = k + 1
        if found and begin < len(words):
            found[-1][1] = len(words)
        if words and not found:
            found.append([0, len(words)])
        for i, j in found:
            yield at + words[i][0], at + (words[j][0] if j < len(words) else len(line))
        at += len(line) + 1


def digest(unit: bytes) -> bytes:
    folded = unit.lower() if unit.isascii() else unit.decode("utf-8", "replace").lower().encode()
    return xxhash.xxh3_128_digest(b" ".join(folded.split()))


def _units(least: int, long: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows, starts, stops, digests = [], [], [], []
                for row, text in enumerate(texts(part.column("text"))):
                    for a, b in units(text, least, long):
                        rows.append(row), starts.append(a), stops.append(b)
                        digests.append(digest(text[a:b]))
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), part.column("id").take(at), part.column("mark").take(at), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())],
                    ["high", "low", "id", "mark", "start", "stop"],
                )

    return run


def repeated(docs: DataFrame, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, mark, spans): what goes from each document, as byte offsets; mark is a hash of the text. Kept."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("mark"), F.col(text_column).alias("text"))
    fields = [("high", T.LongType()), ("low", T.LongType()), ("id", rows.schema["id"].dataType), ("mark", T.LongType()), ("start", T.IntegerType()), ("stop", T.IntegerType())]
    with scratch(spark) as held:
        found = held(rows.mapInArrow(_units(least_words, long_words), T.StructType([T.StructField(*f) for f in fields])), "units")
        rank = F.struct("id", "mark", "start")
        first = found.groupBy("high", "low").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).filter("first < last").select("high", "low", "first")
        later = found.join(first, ["high", "low"]).filter(rank > F.col("first"))
        return keep(later.groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans")), "spans")


def remove(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", spans_column: str | None = "removed", **options) -> DataFrame:
    """docs with repeated units cut out of their texts; spans_column, unless None, is one more: array<struct<start,stop>>."""
    gone = repeated(docs, id_column=id_column, text_column=text_column, **options)
    names = [c for c in docs.columns if c != spans_column]
    left = docs.select(F.struct(*(docs[c] for c in names)).alias("doc"), docs[id_column].alias("id"), F.xxhash64(docs[text_column]).alias("mark"))
    joined = left.join(gone.withColumnRenamed("id", "of").withColumnRenamed("mark", "of_mark"), F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)"))
    text = F.col("doc")[text_column]
    cleaned = F.when(F.size(spans) > 0, cut_spans(text, spans)).otherwise(text)
    return joined.select(*(cleaned.alias(c) if c == text_column else F.col("doc")[c].alias(c) for c in names), *([spans.alias(spans_column)] if spans_column else []))
