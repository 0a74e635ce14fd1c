"""Nearest neighbours of vectors: exact within blocks, or among what random hyperplanes bring together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import cosine, dot, norm
from ..workers import ship
from .blocking import normalise_pairs, tasks
from .filters import apply_filters
from .tables import keep


#: Rows of a block whose vectors are one side of a product of matrices.
TILE = 4000


def _tile(limit: int, threshold: float):
    """Of one cell, two tiles' rows (k, v, side): each left row's limit best of the right ones, of equals the least keys."""

    def best(cell: pa.Table) -> pa.Table:
        side = cell["side"].to_numpy()
        keys, rows = cell["k"], cell["v"].combine_chunks()
        dimension = len(rows[0]) if len(rows) else 0
        every = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), dimension)
        size = np.sqrt((every * every).sum(axis=1))
        unit = every / np.where(size > 0, size, 1)[:, None]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        right = right[pc.sort_indices(keys.take(pa.array(right))).to_numpy()]
        n, least = len(right), round(threshold * 1e6)
        ends = keys.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        out = [], [], []
        for at in range(0, len(left) if n else 0, 256):
            own = left[at : at + 256]
            near = unit[own] @ unit[right].T
            # As places of equal score are told apart, each row's best are unique.
            score = (np.sign(near) * np.floor(np.abs(near) * 1e6 + 0.5)).astype(np.int64)
            score[ends[own][:, None] == ends[right][None, :]] = least - 1
            order = score * n + (n - 1 - np.arange(n))
            top = np.argpartition(order, n - limit, axis=1)[:, n - limit :] if n > limit else np.broadcast_to(np.arange(n), (len(own), n))
            found = np.take_along_axis(score, top, axis=1)
            i, j = np.nonzero(found >= least)
            out[0].append(own[i])
            out[1].append(right[top[i, j]])
            out[2].append(found[i, j] / 1e6)
        x, y, similarity = (np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True))
        return pa.table({"doc1_key": keys.take(pa.array(x)), "doc2_key": keys.take(pa.array(y)), "similarity": similarity})

    return best


def knn_pairs(docs: DataFrame, vector: str, key: str, threshold: float = 0.7, limit: int = 20, block: str | None = None) -> DataFrame:
    """(doc1_key, doc2_key, similarity): each document's limit best within its block, of threshold at least.

    Exact, hence quadratic in a block: block may not be left out, lsh_pairs() is for the whole. Each two tiles of a block are
    a cell, a product of matrices in one task; of a cell only each row's limit best go on. Vectors have one dimension.
    """
    if block is None:
        raise ValueError("knn_pairs compares all of a block: name one, or take lsh_pairs")
    spark = docs.sparkSession
    ship(spark)
    g = F.col(block).cast("string")
    rows = docs.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), F.coalesce(F.concat(F.lit("="), g), F.lit("")).alias("g"))
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / TILE).alias("n"))
    tiled = rows.join(sizes, "g").withColumn("c", F.pmod(F.xxhash64("k"), F.col("n")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    left = tiled.select("g", F.col("c").alias("i"), every.alias("j"), "k", "v", F.lit(0).alias("side"))
    right = tiled.select("g", every.alias("i"), F.col("c").alias("j"), "k", "v", F.lit(1).alias("side"))
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("doc1_key", kind), T.StructField("doc2_key", kind), T.StructField("similarity", T.DoubleType())])
    cells = left.union(right).repartition(tasks(spark), "g", "i", "j")
    scored = cells.groupBy("g", "i", "j").applyInArrow(_tile(limit, threshold), schema)
    w = Window.partitionBy("doc1_key").orderBy(F.desc("similarity"), "doc2_key")
    return scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def nearest(docs: DataFrame, query: list[float], vector: str, key: str, threshold: float = 0.7, limit: int = 20, exclude: object = None, filters: dict[str, dict] | None = None) -> DataFrame:
    """The limit best of one vector: a scan and a top-k. Filters (equals, or in) leave the rows that count, before the limit."""
    q = F.array(*(F.lit(float(x)) for x in query))
    usable = apply_filters(docs.filter(F.col(vector).isNotNull()), filters or {})
    scored = usable.select(F.col(key).alias("doc_key"), F.round(cosine(F.col(vector), q), 6).alias("similarity")).filter(F.col("similarity") >= threshold)
    if exclude is not None:
        scored = scored.filter(F.col("doc_key") != F.lit(exclude))
    return scored.orderBy(F.desc("similarity"), "doc_key").limit(limit)


def nearest_to(docs: DataFrame, of: object, vector: str, key: str, threshold: float = 0.7, limit: int = 20, exclude_self: bool = True, filters: dict[str, dict] | None = None) -> DataFrame:
    """nearest() for the vector of the document whose key is of; KeyError if it has none. One row comes to the driver."""
    row = docs.filter((F.col(key) == F.lit(of)) & F.col(vector).isNotNull()).select(vector).first()
    if row is None:
        raise KeyError(of)
    return nearest(docs, list(row[0]), vector, key, threshold, limit, of if exclude_self else None, filters)


def hyperplanes(tables: int, planes: int, dimension: int, seed: int = 42) -> np.ndarray:
    """tables x planes x dimension, unit rows; the same for the same seed."""
    rows = np.random.RandomState(seed).randn(tables * planes, dimension)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).reshape(tables, planes, dimension)


def signature(vector: Column, planes: np.ndarray) -> Column:
    """The bits of one table as text: 1 where the vector lies on a plane's positive side."""
    return F.concat(*(F.when(dot(vector, F.array(*(F.lit(float(x)) for x in p))) >= 0, "1").otherwise("0") for p in planes))


def planes_for(rows: int, bucket: int = 64) -> int:
    """So many planes that a bucket of evenly spread vectors holds about bucket of them, however many rows there are."""
    return max(4, min(40, (max(1, rows) // bucket).bit_length()))


def lsh_pairs(docs: DataFrame, vector: str, key: str, tables: int = 10, planes: int | None = None, seed: int = 42, dimension: int = 64, block: str | None = None, threshold: float | None = None, most: int | None = None) -> DataFrame:
    """Pairs that share a signature in any table and a block value (null equals null), each once; with a threshold,
    those of at least that cosine.

    Signatures are computed before vectors are dropped from the rows that meet, so the join moves keys alone. Without a
    number of planes it follows from the rows' number. Buckets of more than most rows, where vectors are crowded, are
    parted once more, by DEEPER planes of their own; bucket_sizes() tells how large they are.
    """
    usable = docs.filter(F.col(vector).isNotNull() & (norm(F.col(vector)) > 0))
    signed = _signed(usable, vector, key, tables, planes, seed, dimension, block, most is not None)
    if most is not None:
        sizes = signed.groupBy("t", "bits", "g").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.col("t").alias("_t"), F.col("bits").alias("_bits"), F.col("g").alias("_g"), F.lit(True).alias("crowded"))
        met = signed.join(sizes, (F.col("t") == F.col("_t")) & (F.col("bits") == F.col("_bits")) & F.col("g").eqNullSafe(F.col("_g")), "left")
        signed = met.select("k", "g", "t", F.when(F.col("crowded"), F.concat("bits", "deeper")).otherwise(F.col("bits")).alias("bits"))
    a, b = signed.alias("a"), signed.alias("b")
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.bits") == F.col("b.bits")) & F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.k") < F.col("b.k")))
    pairs = normalise_pairs(met.select(F.col("a.k").alias("doc1_key"), F.col("b.k").alias("doc2_key")))
    if threshold is None:
        return pairs
    x = usable.select(F.col(key).alias("doc1_key"), F.col(vector).alias("x"))
    y = usable.select(F.col(key).alias("doc2_key"), F.col(vector).alias("y"))
    return pairs.join(x, "doc1_key").join(y, "doc2_key").select("doc1_key", "doc2_key", F.round(cosine(F.col("x"), F.col("y")), 6).alias("similarity")).filter(F.col("similarity") >= threshold)


def meet_in(pairs: DataFrame, docs: DataFrame, vector: str, key: str, tables: int = 10, planes: int | None = None, seed: int = 42, dimension: int = 64, block: str | None = None) -> DataFrame:
    """Those of pairs (doc1_key, doc2_key) that lsh_pairs() would bring together, without its other pairs: both ends'
    signatures tell."""
    usable = docs.filter(F.col(vector).isNotNull() & (norm(F.col(vector)) > 0))
    signed = keep(_signed(usable, vector, key, tables, planes, seed, dimension, block, False), "signed")
    a = pairs.join(signed.select(F.col("k").alias("doc1_key"), "t", "bits", F.col("g").alias("g1")), "doc1_key")
    both = a.join(signed.select(F.col("k").alias("doc2_key"), "t", "bits", F.col("g").alias("g2")), ["doc2_key", "t", "bits"])
    return both.filter(F.col("g1").eqNullSafe(F.col("g2"))).select("doc1_key", "doc2_key").distinct()


#: Planes by which a crowded bucket is parted.
DEEPER = 8


def _signed(usable: DataFrame, vector: str, key: str, tables: int, planes: int | None, seed: int, dimension: int, block: str | None, deeper: bool) -> DataFrame:
    """(k, g, t, bits[, deeper]): each row's signature in each table."""
    n = planes or planes_for(usable.count())
    block_value = F.col(block).cast("string") if block else F.lit(None).cast("string")
    shown = [F.struct(signature(F.col(vector), t).alias("bits")) for t in hyperplanes(tables, n, dimension, seed)]
    if deeper:
        more = hyperplanes(tables, DEEPER, dimension, seed + 1)
        shown = [F.struct(s["bits"].alias("bits"), signature(F.col(vector), t).alias("deeper")) for s, t in zip(shown, more, strict=True)]
    return usable.select(F.col(key).alias("k"), block_value.alias("g"), F.posexplode(F.array(*shown)).alias("t", "x")).select("k", "g", "t", "x.*")


def bucket_sizes(docs: DataFrame, vector: str, key: str, tables: int = 10, planes: int | None = None, seed: int = 42, dimension: int = 64, block: str | None = None) -> DataFrame:
    """One row: buckets that lsh_pairs() would make, the largest, and the pairs of all, before anything meets."""
    usable = docs.filter(F.col(vector).isNotNull() & (norm(F.col(vector)) > 0))
    n = F.col("n")
    sizes = _signed(usable, vector, key, tables, planes, seed, dimension, block, False).groupBy("t", "bits", "g").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("buckets"), F.max("n").alias("largest"), F.sum((n * (n - 1) / 2).cast("long")).alias("pairs"))


def coverage(docs: DataFrame, vector: str) -> DataFrame:
    """One row: documents, with and without a vector, share in percent, dimension."""
    has = F.count(vector)
    return docs.agg(F.count("*").alias("total"), has.alias("with_embedding"), (F.count("*") - has).alias("without_embedding"), F.round(100 * has / F.count("*"), 2).alias("coverage_percent"), F.max(F.size(vector)).alias("dimension"))
