"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most r bits exactly if some variant lies within half of r of both. So each distinct
fingerprint emits its variants, variants are the shuffle key, and fingerprints that meet at one are compared. At most
as many distinct fingerprints meet at a variant as a ball of that radius holds. Among those sorted there, each is
compared with the one before it: for an even radius all of them are within r of each other by way of the variant, so
these links join the same components as all pairs would.

Balls of a radius that copies of similarity 0.8 would need are far too many. near_duplicates() therefore adds tables
of further SimHashes, each over the few shingles that come first under the table's own order: copies often agree in
one of them outright. What meets there is compared whole, however many meet, by sketches with a wide margin; the groups
that come of it are decided by the exact share of distinct shingles in common. What is joined already is not compared again.

Its classes are texts of equal distinct shingles (shape, a digest of them), never of equal fingerprints alone.

Defined cases: a null or wordless text has fingerprint zero; a text of fewer words than a shingle is one shingle;
repeated rows have equal fingerprints and share a component; rows without an id get their fingerprint's component; of a
group the least id stands for it, so ties cannot arise; a text of any length is read whole; columns but the id and the
text are not read, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import keep, prepare, scratch, texts

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BITS = 64
#: Classes of a sketch. Its estimate of 0.8 has a standard deviation of 0.025; what is MARGIN below is looked at exactly.
SLOTS, MARGIN = 256, 0.15
#: Buckets of more texts, and groups of more shingles, are split.
BLOCK_ROWS, BLOCK_SHINGLES = 10_000, 2_000_000


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of words, in order; A-Z lower-cased, words cut at ASCII white space."""
    found = text.translate(LOWER).split()
    joined = b" ".join(found)
    h = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([h(joined, seed)] if found else [], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    stops = np.cumsum(sizes + 1) - 1
    starts = (stops - sizes)[: len(found) - words + 1].tolist()
    return np.fromiter((h(joined[i:j], seed) for i, j in zip(starts, stops[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fold(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


@lru_cache(8)
def _multipliers(tables: int) -> np.ndarray:
    """An odd factor a table: its own order of the hashes."""
    return np.random.RandomState(7).randint(1, 1 << 62, tables).astype(np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def sampled(distinct: np.ndarray, tables: int, size: int) -> np.ndarray:
    """For each table the SimHash of the size distinct shingles that its own order puts first, mixed with the table's number."""
    numbers = np.arange(tables, dtype=np.uint64)
    if not len(distinct):
        return numbers
    mixed = distinct * _multipliers(tables)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    first = np.argpartition(mixed, size, axis=1)[:, :size] if len(distinct) > size else np.broadcast_to(np.arange(len(distinct)), mixed.shape)
    bits = np.unpackbits(distinct[first].astype(">u8").view(np.uint8).reshape(tables, -1, 8), axis=2)
    folded = np.packbits(bits.sum(1, dtype=np.int64) * 2 > first.shape[1], axis=1).view(">u8").ravel().astype(np.uint64)
    return folded * np.uint64(0x9E3779B97F4A7C15) + numbers


def sketch(hashes: np.ndarray) -> bytes:
    """A byte a class: 0 where it is empty, else eight bits of its least hash."""
    h = hashes * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    least = np.full(SLOTS, ~np.uint64(0))
    np.minimum.at(least, (h & np.uint64(SLOTS - 1)).astype(np.int64), h >> np.uint64(8))
    mixed = least * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    return np.where(least == ~np.uint64(0), 0, 1 + mixed % np.uint64(255)).astype(np.uint8).tobytes()


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _fingerprint(words: int, seed: int, tables: int, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                hashes = [shingle_hashes(x, words, seed) for x in texts(part.column("text"))]
                distinct = [np.unique(h) for h in hashes] if tables else hashes
                columns = [part.column("id"), _signed([fold(h) for h in distinct])]
                if tables:
                    flat = pa.array(np.concatenate([sampled(h, tables, size) for h in distinct]).view(np.int64))
                    columns.append(pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, tables), pa.int32()), flat))
                    columns.append(pa.array([sketch(h) for h in distinct], pa.binary()))
                    columns.append(_signed([xxhash.xxh3_64_intdigest(h.tobytes()) for h in distinct]))
                    columns.append(pa.array([len(h) for h in distinct], pa.int64()))
                    columns.append(pa.array([h.tobytes() for h in distinct], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "fingerprint", "samples", "sketch", "shape", "weight", "shingles"][: len(columns)])

    return run


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, tables: int = 0, size: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint long[, samples array<long>, sketch binary, shape long, weight long, shingles binary]) of every row. With tables, repeated shingles count once."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    fields = [rows.schema["id"], T.StructField("fingerprint", T.LongType())]
    if tables:
        fields += [T.StructField("samples", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("shape", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("shingles", T.BinaryType())]
    return rows.mapInArrow(_fingerprint(words, seed, tables, size), T.StructType([T.StructField("id", fields[0].dataType), *fields[1:]]))


def ball_masks(radius: int) -> list[int]:
    half = (radius + 1) // 2
    masks = [sum(1 << k for k in c) for n in range(half + 1) for c in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def ball_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join those within radius, directly or by way of others."""
    if radius % 2:
        raise ValueError("an even radius: then all that meet at a variant are links")
    met = distinct.select("fingerprint", F.explode(F.lit(ball_masks(radius))).alias("mask")).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"))
    before = F.lag("fingerprint").over(Window.partitionBy("variant").orderBy("fingerprint"))
    pairs = met.select("fingerprint", before.alias("a")).filter("a is not null").select("a", F.col("fingerprint").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links (i, j) that join 0..n-1 into the components of near(i, others), which tells which of others i links to.

    All that is not reached yet is compared with each that is, so no pair of different components goes uncompared.
    """
    rest, reached = np.arange(n), []
    while len(rest):
        if not reached:
            reached, rest = [int(rest[0])], rest[1:]
        i = reached.pop()
        if len(rest):
            hit = near(i, rest)
            for j in rest[hit].tolist():
                yield i, j
                reached.append(j)
            rest = rest[~hit]


def near_sketches(sketches: list[bytes], least: float):
    """near() of spanning() for texts whose sketches agree in the share least of their classes."""
    table = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SLOTS)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        x, y = table[i], table[others]
        empty = ((x | y) == 0).sum(1)
        return (x == y).sum(1) - empty >= least * (SLOTS - empty)

    return near


def near_sets(sets: list[bytes], least: float):
    """near() of spanning() for sets of hashes that have the share least of their union in common."""
    sizes = np.array([len(x) // 8 for x in sets])
    stops = np.cumsum(sizes)
    known, codes = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    marked = np.zeros(len(known), np.uint8)
    held: list = [len(sets) + 1, None, None]  # the codes of the others of last time, who only become fewer

    def near(i: int, others: np.ndarray) -> np.ndarray:
        if held[0] != len(others):
            held[:] = len(others), np.concatenate([codes[stops[k] - sizes[k] : stops[k]] for k in others.tolist()]), np.cumsum(sizes[others])
        own = codes[stops[i] - sizes[i] : stops[i]]
        marked[own] = 1
        total = np.concatenate([[0], np.cumsum(marked[held[1]], dtype=np.int64)])
        marked[own] = 0
        common = total[held[2]] - total[held[2] - sizes[others]]
        union = sizes[i] + sizes[others] - common
        return np.where(union > 0, common / np.maximum(union, 1), 1.0) >= least

    return near


def _spanning(maker: Callable):
    """Links within each part of rows (group, i, j, node, value) that are sorted; maker(values) gives near()."""

    def links(nodes: list[int], values: list) -> pa.RecordBatch:
        found = [(nodes[i], nodes[j]) for i, j in spanning(len(nodes), maker(values))]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, values = None, [], []
        for batch in batches:
            parts = zip(*(batch.column(k).to_pylist() for k in ("group", "i", "j")), strict=True)
            for part, x, v in zip(parts, batch.column("node").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if part != now:
                    if len(nodes) > 1:
                        yield links(nodes, values)
                    now, nodes, values = part, [], []
                nodes.append(x)
                values.append(v)
        if len(nodes) > 1:
            yield links(nodes, values)

    return run


def links_within(rows: DataFrame, values: DataFrame, maker: Callable, most: int) -> DataFrame:
    """Links (a, b) between the nodes of each group that join its components under maker(their values).

    rows: (group long, node long, weight); values: (node, value). A group of more weight than most is split into blocks
    by a hash, and each two blocks are one part: its size has no cap, and a task holds the texts of two blocks.
    """
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).filter("n > 1")
    sizes = sizes.select("group", F.greatest(F.lit(1), F.ceil(F.col("w") / most)).cast("int").alias("blocks"))
    met = rows.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))
    parts = met.withColumn("other", F.explode(others)).select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")
    key = ["group", "i", "j"]
    sorted_ = parts.join(values, "node").select(*key, "node", "value").repartition(*key).sortWithinPartitions(*key)
    return sorted_.mapInArrow(_spanning(maker), "a long, b long")


def sample_links(classes: DataFrame, least: float) -> DataFrame:
    """Links between classes of texts that share a sampled SimHash and whose sketches agree in the share least."""
    met = classes.select(F.explode("samples").alias("group"), F.col("shape").alias("node"), F.lit(1).alias("weight"))
    return links_within(met, classes.select(F.col("shape").alias("node"), F.col("sketch").alias("value")), lambda x: near_sketches(x, least), BLOCK_ROWS)


def class_ball_links(classes: DataFrame, radius: int, held: Callable) -> DataFrame:
    """ball_links() between classes of texts, and links between those of one fingerprint."""
    anchors = held(classes.groupBy("fingerprint").agg(F.min("shape").alias("anchor")), "anchors")
    same = classes.join(anchors, "fingerprint").filter("shape != anchor").select(F.col("anchor").alias("a"), F.col("shape").alias("b"))
    x, y = (anchors.select(F.col("fingerprint").alias(c), F.col("anchor").alias(f"of_{c}")) for c in "ab")
    return ball_links(anchors, radius).join(x, "a").join(y, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).union(same)


def _with_components(found: DataFrame, firsts: DataFrame, links: DataFrame, held: Callable, id_column: str, node: str = "fingerprint") -> DataFrame:
    labels = components(links).withColumnRenamed("node", node)
    rooted = held(firsts.join(labels, node, "left").select(node, "first", F.coalesce("root", node).alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select(node, "component_id")
    return found.join(of, node).select(F.col("id").alias(id_column), "fingerprint", "component_id")


def link(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint long, component_id): components under links of at most radius differing bits."""
    with scratch(docs.sparkSession) as held:
        found = held(fingerprints(docs, words, seed, id_column=id_column, text_column=text_column), "fingerprints")
        firsts = held(found.groupBy("fingerprint").agg(F.min("id").alias("first")), "firsts")
        return keep(_with_components(found, firsts, ball_links(firsts, radius), held, id_column), "linked")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2, tables: int = 12, size: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) where texts link if they have the share similarity of their shingles in common.

    Candidates are those within radius bits, and all that share a sampled SimHash and whose sketches agree in MARGIN less
    than similarity. They only make groups; within a group the shingles themselves decide, for all pairs.
    """
    with scratch(docs.sparkSession) as held:
        found = held(fingerprints(docs, words, tables=tables, size=size, id_column=id_column, text_column=text_column), "sketches")
        # Equal shapes are equal in all of these; the shingles themselves are left where they lie.
        of = [F.any_value(c).alias(c) for c in ("fingerprint", "samples", "sketch", "weight")]
        classes = held(found.groupBy("shape").agg(F.min("id").alias("first"), *of), "classes")
        links = class_ball_links(classes, radius, held).union(sample_links(classes, similarity - MARGIN))
        labels = components(links)
        groups = held(labels.union(labels.select("root", "root")).distinct(), "groups")
        rows = groups.join(classes, F.col("node") == F.col("shape")).select(F.col("root").alias("group"), "node", "weight")
        sets = found.join(groups, F.col("node") == F.col("shape"), "left_semi").groupBy(F.col("shape").alias("node")).agg(F.any_value("shingles").alias("value"))
        same = links_within(rows, sets, lambda x: near_sets(x, similarity), BLOCK_SHINGLES)
        return keep(_with_components(found.select("id", "fingerprint", "shape"), classes.select("shape", "first"), held(same, "links"), held, id_column, "shape"), "near")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """docs without all but the least id of each group; an id's rows stay or go together, rows without an id stay."""
    of = near_duplicates(docs, id_column=id_column, text_column=text_column, **options)
    gone = of.filter(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("gone")).distinct()
    return docs.join(gone, docs[id_column] == gone["gone"], "left_anti")


def hexadecimal(fingerprint: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
