"""What several operators of this subpackage need: shared storage, byte-bounded batches, label splits."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import keep, scratch, shared_folder
from ..workers import ship

__all__ = ["blocks", "bounded", "cut_spans", "filesystem", "held_out", "keep", "labelled_sample", "prepare", "scratch", "shared_folder", "slices", "texts"]

#: Texts of at most this many bytes are worked on at a time, however many rows a batch of Spark's has.
BATCH_BYTES = 6 << 20
#: Bytes in an Arrow batch between Java and Python.
ARROW_BYTES = 2 << 20
#: The workers' C library gives large blocks back when they are freed, instead of keeping them for later.
MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies on a disk they share (a cluster gets it by --py-files)."""
    ship(spark)
    spark.sparkContext.environment.update(MEMORY)
    # A batch of ten thousand long texts would be held several times over, in Java and in Python.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")


def filesystem(uri: str):
    """pyarrow's file system and path for an address of shared_folder(), which always has a scheme."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    elif uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri[6:]
    return fs.FileSystem.from_uri(uri)


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in pieces whose texts have about limit bytes at most; one text is never cut."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        n = 0 if n != n else int(n)
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut again so that most have nearly limit bytes of text."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        for part in slices(batch, column, limit):
            size = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and total + size > limit:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, total = [], 0
            held.append(part)
            total += size
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def texts(array: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    return pc.fill_null(array.cast(pa.binary()), b"").to_pylist()


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 5: 0 is the held-out fifth."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """Rows without an id are never learnt from."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(True))


def bounded(rows: DataFrame, key: str, bound: int, count: int | None = None) -> DataFrame:
    """About bound rows at most, chosen by a hash of key: the same rows whatever the partitions, no sort, no limit."""
    n = rows.count() if count is None else count
    if n <= bound:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < int(bound / n * (1 << 20)))


def cut_spans(text: Column, spans: Column) -> Column:
    """text without spans: sorted array<struct<start,stop>> of byte offsets that begin and end at characters."""
    raw = text.cast("binary")
    before = F.concat(F.array(F.lit(0)), spans["stop"])
    until = F.concat(spans["start"], F.array(F.octet_length(text)))
    kept = F.transform(F.arrays_zip(before.alias("a"), until.alias("b")), lambda x: F.substring(raw, x["a"] + 1, F.greatest(F.lit(0), x["b"] - x["a"])).cast("string"))
    return F.array_join(kept, "")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, label, text) of about rows labelled documents at most, kept.

    The ids are chosen first, so that what is sent to all executors has a size that rows bounds.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("label"))
    chosen = bounded(usable, key, rows).withColumnRenamed(key, "id")
    rows_ = docs.select(F.col(key).alias("id"), F.col(text_column).alias("text")).filter("text is not null")
    return keep(rows_.join(F.broadcast(chosen), "id").select("id", "label", "text"), "sample")
