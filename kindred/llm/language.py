"""Language identification by hyperdimensional profiles.

Every letter has a random bipolar vector; an n-gram binds its letters' vectors, each permuted by its place; a document
bundles its n-grams' vectors; a language's prototype bundles its documents. Prediction is the prototype of greatest
cosine. A batch's documents are bundled at once as (counts of n-grams) x (n-grams' vectors).

Defined cases: null texts and texts without a letter are "und" with score 0; the score is the best cosine, negative
ones as 0; equal cosines go to the first language in alphabetical order; with nothing to learn from all is "und";
repeated rows are judged alike; texts of any length are read whole, one at a time where they are long; columns but the
text are carried past the model under one name, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import LETTER, classes
from .shared import bounded, prepare, slices

DIMENSIONS = 1024
N = 3
#: Labelled rows that prototypes are learnt from, at most.
SAMPLE = 20_000
#: n-grams whose vectors a worker keeps.
_KEPT = 1 << 15
UNKNOWN = "und"


class Grams:
    """Vectors of n-grams, made from letters' vectors when first met."""

    def __init__(self, dimensions: int, n: int, seed: int = 0):
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((1024, dimensions), np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            if len(self.letters) > _KEPT:
                self.letters.clear()
            bits = np.random.Generator(np.random.Philox(key=[c, self.seed])).integers(0, 2, self.dimensions)
            self.letters[c] = (2 * bits - 1).astype(np.int8)
        return self.letters[c]

    def vector(self, key: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for place in range(self.n):
            out = out * np.roll(self.letter(key >> 21 * place & 0x1FFFFF), place)
        return out

    def of(self, keys: list[int]) -> np.ndarray:
        """int8 matrix of the keys' vectors."""
        if len(self.rows) + len(keys) > _KEPT:
            self.rows.clear()
        at = []
        for k in keys:
            r = self.rows.get(k)
            if r is None:
                r = self.rows[k] = len(self.rows)
                if r >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros((max(len(self.vectors), r + 1 - len(self.vectors)), self.dimensions), np.int8)])
                self.vectors[r] = self.vector(k)
            at.append(r)
        return self.vectors[at]


def gram_keys(text: str, n: int) -> np.ndarray:
    """Keys of a text's n-grams over letters and single blanks; anything that is no letter is a blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)
    letter = classes()[points] == LETTER
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.concatenate([[0x20], np.where(letter, points, 0x20), [0x20]])
    points = points[np.concatenate([[True], (points[1:] != 0x20) | (points[:-1] != 0x20)])]
    keys = np.zeros(max(0, len(points) - n + 1), np.int64)
    for place in range(n):
        keys |= points[place : place + len(keys)] << 21 * place
    return keys


def bundle(texts: list[str], grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Documents' vectors (float32, not normalised) and which documents have any n-gram."""
    out = np.zeros((len(texts), grams.dimensions), np.float32)
    found, counts, rows = [], [], []
    for i, t in enumerate(texts):
        keys, number = np.unique(gram_keys(t, grams.n), return_counts=True)
        found.append(keys), counts.append(number), rows.append(np.full(len(keys), i))
    keys, row, number = np.concatenate(found), np.concatenate(rows), np.concatenate(counts)
    distinct, column = np.unique(keys, return_inverse=True)
    # So many n-grams at a time that neither their vectors nor the counts grow with the batch.
    for a in range(0, len(distinct), 8192):
        some = (column >= a) & (column < a + 8192)
        part = distinct[a : a + 8192]
        table = np.zeros((len(texts), len(part)), np.float32)
        table[row[some], column[some] - a] = number[some]
        out += table @ grams.of(part.tolist()).astype(np.float32)
    return out, np.array([len(k) > 0 for k in found], bool)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text", 1 << 20):
        for i in range(0, part.num_rows, 256):
            yield part.slice(i, 256)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _bundles(dimensions: int, n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(dimensions, n), {}
        for batch in batches:
            for part in _blocks(batch):
                vectors, _ = bundle([t or "" for t in part.column("text").to_pylist()], grams)
                vectors = _unit(vectors)
                names = np.array(part.column("lang").to_pylist(), object)
                for name in set(names):
                    sums[name] = sums.get(name, 0) + vectors[names == name].sum(0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    return run


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS, n: int = N, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (unit rows); what comes to the driver is a vector a language."""
    prepare(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    chosen = bounded(rows, id_column, sample).select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    sums = chosen.mapInArrow(_bundles(dimensions, n), "lang string, vector array<double>")
    total = sums.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in total.collect():
        found.setdefault(r["lang"], np.zeros(dimensions))[r["k"]] = r["x"]
    names = sorted(found)
    return names, _unit(np.array([found[k] for k in names], np.float32)) if names else np.zeros((0, dimensions), np.float32)


def _predict(names: list[str], prototypes: np.ndarray, n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(prototypes.shape[1], n)
        for batch in batches:
            for part in _blocks(batch):
                vectors, any_ = bundle([t or "" for t in part.column("text").to_pylist()], grams)
                cosines = np.round(_unit(vectors) @ prototypes.T, 6) if names else np.zeros((part.num_rows, 1))
                best = cosines.argmax(1)
                langs = [names[b] if ok and names else UNKNOWN for b, ok in zip(best, any_, strict=True)]
                scores = np.where(any_, np.clip(cosines.max(1), 0, 1), 0.0).astype(float)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(langs), pa.array(scores)], ["doc", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, n: int = N, text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc: struct of the carried columns, lang_pred, score) of every row; the rest is carried past the model unseen."""
    from pyspark.sql import types as T

    prepare(docs.sparkSession)
    kept = F.struct(*(docs[c] for c in (carry if carry is not None else docs.columns))).alias("doc")
    rows = docs.select(kept, docs[text_column].alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(names, prototypes, n), schema)
