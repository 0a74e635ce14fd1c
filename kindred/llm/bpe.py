"""BPE encoding and decoding over a distinct-word table.

Texts are cut into pieces (the spans that merges never cross) batch by batch. A block of texts is written to the
shared folder as codes into the block's own list of distinct pieces; only those lists are shuffled. They meet by
bucket of the piece's hash. The task of a bucket holds its distinct pieces, one in so many of the whole table's, and
encodes each once, whichever blocks it came from; the ids return to the blocks, where they are put back by position.
Decoding joins ids to the vocabulary's pieces: a table of fixed size whose keys are its row numbers, so the join is a
lookup in a copy that every worker has.

Defined cases: a null text counts as empty and has no ids; a text of any length is encoded whole, in one block; repeated
rows and null ids of documents are kept as they are; the order of rows is not; other columns of the input are not read,
so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces as cut
from .shared import blocks, filesystem, keep, prepare, shared_folder

#: Bytes of text in a block.
BLOCK_BYTES = 12 << 20
#: Buckets that a block's distinct pieces are dealt to: a piece always goes to the same one.
MOST_BUCKETS = 2048


def pack(values: pa.Array) -> bytes:
    """A binary array as compressed bytes: lengths, then the values."""
    size = pc.binary_length(values).to_numpy(zero_copy_only=False).astype("<u4")
    return zstandard.compress(np.array([len(values)], "<u4").tobytes() + size.tobytes() + b"".join(values.to_pylist()), 3)


def unpack(packed: bytes) -> pa.Array:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    size = np.frombuffer(raw, "<u4", n, 4)
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw).slice(4 + 4 * n)])


def _split(folder: str, special: dict[bytes, int], buckets: int):
    def one(fs, root: str, part: pa.RecordBatch) -> pa.RecordBatch:
        found, first = cut.split(part.column("text"), special)
        name = f"{uuid.uuid4().hex}.arrow"
        distinct = found.dictionary
        hashes = np.fromiter(map(zlib.crc32, distinct.to_pylist()), np.int64, len(distinct)) % buckets
        # Codes follow the buckets, and the pieces' order within one: so a bucket's pieces need no places, and
        # neighbours begin alike, which the compression likes.
        sorted_ = pc.array_sort_indices(distinct).to_numpy()
        order = sorted_[np.argsort(hashes[sorted_], kind="stable")]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        codes = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(rank[found.indices.to_numpy()]))
        table = pa.table({"id": part.column("id"), "codes": codes})
        with fs.open_output_stream(f"{root}/{name}") as sink, pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        used, start = np.unique(hashes[order], return_index=True)
        ordered = distinct.take(pa.array(order))
        stop = np.append(start[1:], len(order)) if len(used) else []
        packed = [pack(ordered.slice(a, b - a)) for a, b in zip(start, stop, strict=True)] or [pack(ordered)]
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(packed)), pa.array(used if len(used) else [0], pa.int32()), pa.array(packed, pa.binary())],
            ["block", "bucket", "pieces"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        for part in blocks(batches, "text", BLOCK_BYTES):
            # All that a block needed is gone when the next one is gathered.
            yield one(fs, root, part)
            del part

    return run


def _encode(tokenizer: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A bucket's rows follow each other. Its pieces are in no other bucket, so each is encoded once in all.
        encoder, now = cut.encoder(tokenizer, None), None
        encoder.known.clear()
        for batch in batches:
            ids = []
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("pieces"), strict=True):
                if bucket != now:
                    encoder.known.clear()
                    now = bucket
                ids.append(pack(pa.array(encoder.ids(unpack(raw.as_py()).to_pylist()), pa.binary())))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(ids, pa.binary())], ["block", "bucket", "ids"])
        encoder.known.clear()

    return run


def _assemble(folder: str):
    def finish(fs, root: str, block: str, ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        with fs.open_input_stream(f"{root}/{block}") as source:
            table = pa.ipc.open_stream(source).read_all().combine_chunks()
        known = pa.concat_arrays([unpack(x) for x in ids])
        if not len(table):
            return
        codes = table.column("codes").combine_chunks()
        first = codes.offsets.to_numpy()
        step = max(1, len(table) // max(1, int(first[-1] - first[0]) // 250_000 + 1))
        for i in range(0, len(table), step):
            j = min(i + step, len(table))
            some = known.take(codes.values.slice(first[i], first[j] - first[i]))
            ends = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
            raw = np.frombuffer(some.buffers()[2], "<i4") if len(some) and ends[-1] else np.zeros(0, "<i4")
            at = (ends[first[i : j + 1] - first[i]] - ends[0]) // 4
            values = pa.array(raw[ends[0] // 4 : ends[-1] // 4], pa.int32())
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks().slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)], ["id", "ids"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        block, ids = None, []
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if b != block:
                    if block is not None:
                        yield from finish(fs, root, block, ids)
                    block, ids = b, []
                ids.append(x)
        if block is not None:
            yield from finish(fs, root, block, ids)

    return run


def _put_back(docs: DataFrame, tokenizer: str, id_column: str, text_column: str, then: Callable, more: list[T.StructField]) -> DataFrame:
    """(id_column, ids, more) for every row of docs: then() is given (id, ids) in the worker that puts a block together."""
    spark = docs.sparkSession
    prepare(spark)
    folder = f"{shared_folder(spark)}/codes"
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    words = keep(rows.mapInArrow(_split(folder, cut.encoder(tokenizer, None).special, min(n, MOST_BUCKETS)), "block string, bucket int, pieces binary"), "words")
    encoded = words.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode(tokenizer), "block string, bucket int, ids binary")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), *more])
    assemble = _assemble(folder)
    out = encoded.repartition(n, "block").sortWithinPartitions("block", "bucket").mapInArrow(lambda batches: then(assemble(batches)), schema)
    return out.withColumnRenamed("id", id_column)


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, ids array<int>) for every row of docs; ids as the tokenizers library gives them."""
    return _put_back(docs, tokenizer, id_column, text_column, lambda batches: batches, [])


def round_trip(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """decode(encode(docs)) with one Python worker a task: of two, each would hold the libraries and its own buffers."""
    pieces = docs.sparkSession.sparkContext.broadcast(pack(pa.array(vocabulary(tokenizer), pa.binary())))
    return _put_back(docs, tokenizer, id_column, text_column, _decode(pieces), [T.StructField("decoded", T.StringType())])


def vocabulary(tokenizer: str) -> list[bytes]:
    """Bytes of every id's piece; the table's size is the tokenizer's, whatever the corpus."""
    encoder = cut.encoder(tokenizer, None)
    back = {ord(c): b for b, c in cut._stands_for().items()}
    special = {i: name for name, i in encoder.special.items()}
    size = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
    return [special[i] if i in special else bytes(back[ord(c)] for c in encoder.tokenizer.id_to_token(i)) for i in range(size)]


def _decode(pieces):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = unpack(pieces.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = pc.fill_null(part.column("ids"), pa.scalar([], pa.list_(pa.int32())))
                joined = table.take(lists.flatten())
                ends = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
                raw = memoryview(joined.buffers()[2] or b"")
                at = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
                texts = [bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, tokenizer: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id_column, ids, decoded string): each id is joined to its piece; invalid UTF-8 becomes U+FFFD."""
    prepare(encoded.sparkSession)
    rows = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    pieces = encoded.sparkSession.sparkContext.broadcast(pack(pa.array(vocabulary(tokenizer), pa.binary())))
    return rows.mapInArrow(_decode(pieces), schema).select(F.col("id").alias(id_column), "ids", "decoded")


def digests(decoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, n_tokens, and the SHA-256 of its ids and of its decoded text."""
    return decoded.select(
        F.col(id_column),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
