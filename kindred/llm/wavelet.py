"""Token ids on disk as one wavelet matrix per shard.

A file holds a shard's ids as bit planes, highest bit first; after each plane the ids are stably parted by that bit.
Planes are cut into blocks, each compressed by itself, with running counts of ones beside them: access, rank and
select decompress one block a plane. Documents of ascending ids follow each other; a shard ends with a whole document.

Layout: b"WVM1", length of the header (u32), header (JSON: tokens, bits, documents, zeros), then as little-endian
arrays the documents' ends (u64), and for each plane the blocks' offsets (u64) and counts of ones before them (u64),
then the documents' ids (an Arrow stream) and the blocks.

Defined cases: a null text is an empty one, which has the end id alone; repeated ids of documents are neighbours,
ordered by text; rows without an id come first; a text is never cut, so one of any length is in one shard (a document
of over 2**29 tokens would not fit a row when it is read back); columns but the id and the text are not read, so none can
clash; an empty table writes no file and reads back as no row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces as cut
from .shared import BATCH_BYTES, blocks, filesystem, keep, prepare

SHARD_TOKENS = 1 << 20
#: Bits in a block of a plane.
BLOCK_BITS = 1 << 18


def dump(ids: np.ndarray, ends: np.ndarray, names: pa.Array, bits: int) -> bytes:
    """A shard's file: ids, where each document's ids end, and the documents' own ids."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    zeros, offsets, counts, blocks, at = [], [], [], [], 0
    for k in range(bits - 1, -1, -1):
        ones = (now & now.dtype.type(1 << k)) != 0
        packed = np.packbits(ones, bitorder="little")
        where, before, total = [], [], 0
        for i in range(0, len(packed), BLOCK_BITS // 8):
            part = packed[i : i + BLOCK_BITS // 8]
            where.append(at)
            before.append(total)
            total += int(np.bitwise_count(part).sum())
            blocks.append(squeeze(part.tobytes()))
            at += len(blocks[-1])
        zeros.append(len(now) - total)
        offsets.append([*where, at])
        counts.append([*before, total])
        now = np.concatenate([now[~ones], now[ones]])
    stream = pa.BufferOutputStream()
    with pa.ipc.new_stream(stream, pa.schema([("id", names.type)])) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([names], ["id"]))
    table = stream.getvalue().to_pybytes()
    header = json.dumps({"tokens": len(ids), "bits": bits, "documents": len(ends), "zeros": zeros, "table": len(table)}).encode()
    return b"".join([b"WVM1", np.uint32(len(header)).tobytes(), header, np.asarray(ends, "<u8").tobytes(), np.array(offsets, "<u8").tobytes(), np.array(counts, "<u8").tobytes(), table, *blocks])


class WaveletMatrix:
    """Answers from one file, given as bytes or as an open file of pyarrow's: after the header, only those blocks are
    read and decompressed that a question touches."""

    def __init__(self, source: bytes | pa.NativeFile):
        self.file = pa.BufferReader(source) if isinstance(source, bytes) else source
        start = bytes(self.file.read_at(8, 0))
        if start[:4] != b"WVM1":
            raise ValueError("not a wavelet matrix file")
        size = int(np.frombuffer(start, "<u4", 1, 4)[0])
        head = json.loads(bytes(self.file.read_at(size, 8)))
        self.tokens, self.bits, self.zeros, documents = head["tokens"], head["bits"], head["zeros"], head["documents"]
        n = -(-self.tokens // BLOCK_BITS) + 1
        counted = 8 * (documents + 2 * n * self.bits)
        numbers = np.frombuffer(self.file.read_at(counted, 8 + size), "<u8").astype(np.int64)
        self.ends = numbers[:documents]
        self.offsets, self.counts = numbers[documents:].reshape(2, self.bits, n)
        self.names_at, self.table = 8 + size + counted, head["table"]
        self.base = self.names_at + self.table
        self.open = zstandard.ZstdDecompressor()

    @property
    def names(self) -> pa.Array:
        """The documents' own ids."""
        return pa.ipc.open_stream(self.file.read_at(self.table, self.names_at)).read_all().column("id").combine_chunks()

    def _block(self, level: int, k: int) -> np.ndarray:
        a, b = int(self.offsets[level, k]), int(self.offsets[level, k + 1])
        return np.frombuffer(self.open.decompress(self.file.read_at(b - a, self.base + a)), np.uint8)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, BLOCK_BITS)
        total = int(self.counts[level, k])
        if rest:
            bits = self._block(level, k)[: -(-rest // 8)]
            total += int(np.unpackbits(bits, bitorder="little")[:rest].sum())
        return total

    def access(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            ones = self._ones(level, i)
            bit = self._ones(level, i + 1) - ones
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, i), self._ones(level, j)
            if token >> (self.bits - 1 - level) & 1:
                i, j = self.zeros[level] + a, self.zeros[level] + b
            else:
                i, j = i - a, j - b
        return i, j

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before position i."""
        return self.count(token, 0, i)

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        a, b = self._range(token, i, self.tokens if j is None else j)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of token's occurrence number k, from 0."""
        first, last = self._range(token, 0, self.tokens)
        if not 0 <= k < last - first:
            raise IndexError(k)
        return int(self._up(token, np.array([first + k]))[0])

    def locate(self, token: int) -> np.ndarray:
        """All positions of token, ascending: they lie together on the lowest plane and go up together."""
        first, last = self._range(token, 0, self.tokens)
        return self._up(token, np.arange(first, last))

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        """Positions in the text of ascending positions below the lowest plane; each block is opened once for all."""
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            k = at - (self.zeros[level] if bit else 0)
            counts = self.counts[level]
            before = counts if bit else np.minimum(np.arange(len(counts)) * BLOCK_BITS, self.tokens) - counts
            block = np.searchsorted(before, k, "right") - 1
            at = np.empty_like(k)
            for b in np.unique(block).tolist():
                bits = np.unpackbits(self._block(level, b), bitorder="little")[: self.tokens - b * BLOCK_BITS]
                own = block == b
                at[own] = b * BLOCK_BITS + np.flatnonzero(bits == bit)[k[own] - before[b]]
        return at

    def all(self) -> np.ndarray:
        """Every token, by undoing the partings from the lowest plane up."""
        values = np.zeros(self.tokens, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            packed = [self._block(level, k) for k in range(self.offsets.shape[1] - 1)]
            ones = np.unpackbits(np.concatenate(packed), bitorder="little", count=self.tokens).view(bool) if packed else np.zeros(0, bool)
            up = np.empty_like(values)
            z = self.zeros[level]
            up[~ones] = values[:z]
            up[ones] = values[z:] | values.dtype.type(1 << (self.bits - 1 - level))
            values = up
        return values


def _write(folder: str, tokenizer: str, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = cut.encoder(tokenizer)
        bits = max(1, max(end, encoder.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        partition, number = TaskContext.get().partitionId(), 0
        ids, sizes, names = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal number
            name = f"{uuid.uuid4().hex}.wvm"
            tokens = np.concatenate(ids)
            with fs.open_output_stream(f"{root}/{name}") as sink:
                sink.write(dump(tokens, np.cumsum(np.concatenate(sizes)), pa.concat_arrays(names), bits))
            row = pa.RecordBatch.from_pylist([{"partition": partition, "number": number, "file": name, "tokens": len(tokens), "documents": sum(map(len, names))}])
            number += 1
            ids.clear(), sizes.clear(), names.clear()
            return row

        for part in blocks(batches, "text", BATCH_BYTES):
            found, first = cut.split(part.column("text"), encoder.special)
            known = pa.array(encoder.ids(found.dictionary.to_pylist()), pa.binary())
            joined = known.take(found.indices)
            ends = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
            raw = np.frombuffer(joined.buffers()[2] or b"", "<u4") if len(joined) else np.zeros(0, "<u4")
            stops = (ends[first] - ends[0]) // 4
            tokens = np.insert(raw[ends[0] // 4 : ends[-1] // 4], stops[1:], end)
            ids.append(tokens)
            sizes.append(np.diff(stops) + 1)
            names.append(part.column("id"))
            if sum(map(len, ids)) >= SHARD_TOKENS:
                yield flush()
        if ids:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write docs as shards in ascending order of their ids; the table of shards, with each one's first position.

    The table names the files of tasks that were committed: a lost or repeated task's files are in no row.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    shards = keep(ranged.mapInArrow(_write(folder, tokenizer, end), "partition long, number long, file string, tokens long, documents long"), "shards")
    # One row a range partition is summed in one place, and one partition's shards in one place: neither grows with rows.
    whole = shards.groupBy("partition").agg(F.sum("tokens").alias("all"))
    before = whole.select("partition", (F.sum("all").over(Window.orderBy("partition")) - F.col("all")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("partition").orderBy("number")) - F.col("tokens")
    return shards.join(before, "partition").select("file", "tokens", "documents", (F.col("before") + inside).alias("start"))


def _read(folder: str, kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{file}") as source:
                    matrix = WaveletMatrix(source.read())
                raw = matrix.all().astype("<u4")
                begins = np.concatenate([[0], matrix.ends[:-1]]).astype(np.int64)
                bytes_at = pa.py_buffer(np.concatenate([begins, matrix.ends[-1:]]).astype(np.int32) * np.int32(4))
                ids = pa.Array.from_buffers(pa.binary(), len(begins), [None, bytes_at, pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([matrix.names.cast(kind), pa.array(begins + start, pa.int64()), pa.array(matrix.ends - begins, pa.int64()), ids], ["id", "start", "n_tokens", "ids"])

    return run


def read(shards: DataFrame, folder: str, id_type: T.DataType | None = None, id_column: str = "doc_id") -> DataFrame:
    """(id_column, start, n_tokens, ids binary: little-endian unsigned 32-bit integers) from the files."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = shards.sparkSession
    prepare(spark)
    id_type = id_type or T.LongType()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    out = shards.select("file", "start").repartition(n, "file").mapInArrow(_read(folder, to_arrow_type(id_type)), schema)
    return out.select(F.col("id").alias(id_column), "start", "n_tokens", "ids")
