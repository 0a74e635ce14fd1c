"""Quality classification by compression.

Two zstandard dictionaries are trained, on chunks of good and of bad labelled texts. A text's chunks are compressed with
either and with none; the difference of the two sizes relative to the size without a dictionary, the gain of the better
one, and how far the text compresses by itself are calibrated to a probability on labelled rows.

Both samples are bounded (DICTIONARY_CHUNKS chunks of CHUNK bytes a class, FIT_ROWS rows); all texts are scored whole.

Defined cases: null and empty texts have all features 0 and so a constant score; with no labelled rows, or labels of one
class, the score is constant; repeated rows, and so ties, score alike; texts of any length are scored whole, a chunk
at a time; columns but the text and those carried are not read, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import logistic
from .shared import bounded, prepare, texts

CHUNK = 4096
DICTIONARY_CHUNKS = 1500
DICTIONARY_BYTES = 1 << 16
FIT_ROWS = 12_000
LEVEL = 3


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), texts(batch.column("text")), strict=True):
            parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["label", "chunk"])


def train(labelled: DataFrame, chunks: int = DICTIONARY_CHUNKS, size: int = DICTIONARY_BYTES) -> tuple[bytes, bytes]:
    """Dictionaries of the good (label 1) and bad (0) texts of (label, text); b"" where there is too little to train on."""
    prepare(labelled.sparkSession)
    cut = labelled.mapInArrow(_chunks, "label int, chunk binary")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.sum(1 + F.floor(F.octet_length("text") / CHUNK)).alias("n")).collect()}
    out = []
    for label in (1, 0):
        own = cut.filter(F.col("label") == label)
        # The order makes the dictionary the same whatever the partitions.
        samples = sorted(r["chunk"] for r in bounded(own, "chunk", chunks, counts.get(label) or 0).select("chunk").collect())
        try:
            out.append(bytes(zstandard.train_dictionary(size, [bytes(s) for s in samples], level=LEVEL).as_bytes()))
        except (zstandard.ZstdError, ValueError):
            out.append(b"")
    return out[0], out[1]


class Features:
    def __init__(self, good: bytes, bad: bytes):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_dict_id=False) if d else self.plain for d in (good, bad)]
        for c, d in zip(self.by, (good, bad), strict=True):
            if d:
                zstandard.ZstdCompressionDict(d).precompute_compress(level=LEVEL)

    def of(self, text: bytes) -> tuple[float, float, float]:
        if not text:
            return 0.0, 0.0, 0.0
        g = b = p = 0
        for i in range(0, len(text), CHUNK):
            part = text[i : i + CHUNK]
            g += len(self.by[0].compress(part))
            b += len(self.by[1].compress(part))
            p += len(self.plain.compress(part))
        return (b - g) / p, (p - min(b, g)) / p, p / (len(text) + 16)


def _features(good: bytes, bad: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(good, bad)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                found = [features.of(t) for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([list(f) for f in found], pa.list_(pa.float64()))], ["key", "features"])

    return run


def featurise(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """(key, features) of (key, text)."""
    prepare(rows.sparkSession)
    schema = T.StructType([rows.schema["key"], T.StructField("features", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(_features(good, bad), schema)


def logit(features: str, model) -> F.Column:
    w, mean, scale = model
    z = F.lit(float(w[-1]))
    for k in range(len(mean)):
        z = z + (F.col(features)[k] - float(mean[k])) / float(scale[k]) * float(w[k])
    return z


def fit(sample: DataFrame) -> dict:
    """The model of a bounded sample (id, label, text): dictionaries and calibration."""
    good, bad = train(sample.select("label", "text"))
    found = featurise(sample.select(F.col("label").alias("key"), "text"), good, bad).collect()
    x = np.array([_extend(r["features"]) for r in found], float).reshape(-1, 5)
    return {"good": good, "bad": bad, "model": logistic.fit(x, np.array([r["key"] for r in found], float))}


def _extend(f: list[float]) -> list[float]:
    return [*f, f[0] * abs(f[0]), f[2] * f[2]]


def score(docs: DataFrame, model: dict, carry: list[str], text_column: str = "text") -> DataFrame:
    """The carried columns and score: the probability of label 1."""
    rows = docs.select(F.struct(*(docs[c] for c in carry)).alias("key"), docs[text_column].alias("text"))
    f = featurise(rows, model["good"], model["bad"])
    more = F.array(F.col("features")[0], F.col("features")[1], F.col("features")[2], F.col("features")[0] * F.abs(F.col("features")[0]), F.col("features")[2] * F.col("features")[2])
    z = f.select("key", more.alias("features"))
    return z.select(*(F.col("key")[c].alias(c) for c in carry), (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit("features", model["model"])))))).alias("score"))
