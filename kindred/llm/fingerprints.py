"""Document fingerprints from prefix polynomial hashes.

A text of code points c has the prefix array P[i] = sum of c[j] * B**j for j < i, modulo a prime; two primes side by
side make 62 bits. From it any span's hash follows in constant time, so spans are compared without being read again,
and the longest common extension of two positions is found by binary search.

A fingerprint is a sample of that array: the number of code points, the hash of the whole text, and marks, which are
places in the text with the prefix hash there. MARKS of them are where the least hashes of SPAN code points are first
met, so a passage has the same marks wherever it stands; up to GRID more stand at equal distances of a power of two.
Between two marks that two texts share, the spans are equal or not by their prefix hashes alone. The likeness of two
fingerprints begins with the longest common beginning, found by binary search over the shared places, and goes on
through the marks of equal hash after it, from each to the end of the longest common extension, found alike; it is the
share of the longer text that is covered. Equal texts have likeness 1.

Defined cases: a null text is an empty one; two empty texts are alike (1), an empty and another not at all (0); texts
shorter than SPAN have marks at equal distances only; a text of any length is read whole, and its fingerprint
does not grow with it; rows that share an id follow each other by text; rows without an id come first; a lone document is
its own next one; columns but the id and the text are not read, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import prepare

PRIMES = ((2**31 - 1, 1_000_003), (2**31 - 19, 1_299_709))
SPAN = 12
MARKS, GRID = 24, 16

_powers: dict[int, np.ndarray] = {}


def powers(k: int, n: int) -> np.ndarray:
    """B**0 .. B**(n-1) of prime k, by doubling; kept and grown."""
    have = _powers.get(k)
    p, b = PRIMES[k]
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        step = np.uint64(pow(b, len(have), p))
        have = np.concatenate([have, have * step % np.uint64(p)])
    _powers[k] = have if len(have) <= 1 << 22 else have[: 1 << 22]
    return have[:n]


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.arrays = []
        for k, (p, _) in enumerate(PRIMES):
            terms = (points.astype(np.uint64) + np.uint64(1)) * powers(k, self.n) % np.uint64(p)
            whole = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=whole[1:])
            self.arrays.append(whole % np.uint64(p))

    @classmethod
    def of(cls, text: str) -> Prefixes:
        return cls(np.frombuffer(text.encode("utf-32-le"), "<u4"))

    def equal(self, i: int, other: Prefixes, j: int, size: int) -> bool:
        """Whether this text's span at i agrees with the other's at j."""
        if i + size > self.n or j + size > other.n:
            return False
        for k, (p, b) in enumerate(PRIMES):
            mine = int(self.arrays[k][i + size]) - int(self.arrays[k][i])
            theirs = int(other.arrays[k][j + size]) - int(other.arrays[k][j])
            if i < j:
                mine *= pow(b, j - i, p)
            else:
                theirs *= pow(b, i - j, p)
            if (mine - theirs) % p:
                return False
        return True

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, size: int) -> np.ndarray:
        """62-bit hashes of all spans of size code points, each as if it began the text."""
        m = self.n - size + 1
        out = np.zeros(m, np.uint64)
        for k, (p, b) in enumerate(PRIMES):
            # Divided by B**i, that is multiplied by the inverse's power.
            inverse = pow(b, -1, p)
            q = _inverse_powers(k, m, inverse, p)
            out = (out << np.uint64(31)) | (self.arrays[k][size:] + np.uint64(p) - self.arrays[k][:m]) % np.uint64(p) * q % np.uint64(p)
        return out

    def whole(self) -> int:
        return int(self.arrays[0][-1]) << 31 | int(self.arrays[1][-1])


_inverses: dict[int, np.ndarray] = {}


def _inverse_powers(k: int, n: int, inverse: int, p: int) -> np.ndarray:
    have = _inverses.get(k)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(inverse, len(have), p)) % np.uint64(p)])
    _inverses[k] = have if len(have) <= 1 << 22 else have[: 1 << 22]
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


@dataclass(frozen=True)
class Fingerprint:
    """Marks in the text's order, the first at its beginning, the last at its end; those at equal distances have no key."""

    at: list[int]
    keys: list[int | None]
    #: Prefix hash at each mark, of either prime.
    prefix: tuple[list[int], list[int]]

    @property
    def n(self) -> int:
        return self.at[-1]

    def __str__(self) -> str:
        x, y = self.prefix
        rows = list(zip(self.at, self.keys, x, y, strict=True))[1:-1]
        marks = ".".join(f"{p:x}:{'' if k is None else f'{k:08x}'}:{u << 31 | v:016x}" for p, k, u, v in rows)
        return f"{self.n:x}-{x[-1] << 31 | y[-1]:016x}-{marks}"

    @classmethod
    def read(cls, text: str) -> Fingerprint:
        n, whole, marks = text.split("-")
        rows = [m.split(":") for m in marks.split(".")] if marks else []
        hashes = [0, *(int(r[2], 16) for r in rows), int(whole, 16)]
        return cls([0, *(int(r[0], 16) for r in rows), int(n, 16)], [None, *(int(r[1], 16) if r[1] else None for r in rows), None], ([h >> 31 for h in hashes], [h & (1 << 31) - 1 for h in hashes]))

    def same(self, i: int, k: int, other: Fingerprint, j: int, m: int) -> bool:
        """Whether the text between marks i and k is the other's between j and m."""
        a, b = self.at[i], other.at[j]
        if self.at[k] - a != other.at[m] - b:
            return False
        for (p, base), mine, theirs in zip(PRIMES, self.prefix, other.prefix, strict=True):
            x, y = mine[k] - mine[i], theirs[m] - theirs[j]
            if (x * pow(base, b - a, p) - y if a < b else x - y * pow(base, a - b, p)) % p:
                return False
        return True


def fingerprint(points: np.ndarray) -> Fingerprint:
    prefixes = Prefixes(points)
    n, at, keys = prefixes.n, np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n >= SPAN:
        h = _mix(prefixes.spans(SPAN))
        # The least hashes, each where it is first met; all are sorted only if repeats leave too few.
        near = np.flatnonzero(h <= np.partition(h, 2 * MARKS)[2 * MARKS]) if len(h) > 4 * MARKS else np.arange(len(h))
        found, first = np.unique(h[near], return_index=True)
        if len(found) < MARKS and len(near) < len(h):
            near = np.arange(len(h))
            found, first = np.unique(h, return_index=True)
        at, keys = near[first[:MARKS]], (found[:MARKS] >> np.uint64(32)).astype(np.int64)
    step = 1 << max(0, (n - 1).bit_length() - GRID.bit_length() + 1)
    even = np.arange(step, n, step)
    every = np.concatenate([[0], even, at, [n]]).astype(np.int64)
    of = np.concatenate([np.full(len(even) + 1, -1), keys, [-1]]).astype(np.int64)
    order = np.lexsort((of, every))
    order = np.concatenate([[0], order[(order > 0) & (order < len(every) - 1)], [len(every) - 1]])
    every = every[order]
    return Fingerprint(every.tolist(), [None if k < 0 else k for k in of[order].tolist()], tuple(p[every].tolist() for p in prefixes.arrays))


def _extended(a: Fingerprint, b: Fingerprint, shared: list[tuple[int, int]], now: int) -> int:
    """Number of the last of the shared marks up to which both texts go on alike from number now."""
    low, high = now, len(shared) - 1
    while low < high:
        middle = (low + high + 1) // 2
        if a.same(shared[now][0], shared[middle][0], b, shared[now][1], shared[middle][1]):
            low = middle
        else:
            high = middle - 1
    return low


def likeness(a: Fingerprint | str, b: Fingerprint | str) -> float:
    """0 to 1, from fingerprints alone."""
    a, b = (Fingerprint.read(x) if isinstance(x, str) else x for x in (a, b))
    last = len(a.at) - 1, len(b.at) - 1
    if a.same(0, last[0], b, 0, last[1]):
        return 1.0
    if not a.n or not b.n:
        return 0.0
    places = {p: j for j, (p, k) in enumerate(zip(b.at, b.keys, strict=True)) if k is None and j < last[1]}
    even = [(i, places[p]) for i, (p, k) in enumerate(zip(a.at, a.keys, strict=True)) if k is None and i < last[0] and p in places]
    begin = even[_extended(a, b, even, 0)]
    where = {k: j for j, k in enumerate(b.keys) if k is not None}
    shared = [begin, *((i, where[k]) for i, k in enumerate(a.keys) if k in where and i > begin[0]), last]
    covered, now = a.at[begin[0]], 0
    while now < len(shared) - 1:
        end = _extended(a, b, shared, now)
        covered += a.at[shared[end][0]] - a.at[shared[now][0]]
        now = max(end, now + 1)
    return min(1.0, covered / max(a.n, b.n))


def edit(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last quarter replaced by as many of the next text's first code points, or all it has."""
    m = len(points) // 4
    return np.concatenate([points[: len(points) - m], following[:m]])


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and order; a row is judged when the one after it is known, if it is its bucket's own."""
    rows: list[tuple] = []
    held = None  # (bucket, own, id, points, fingerprint)
    size = 0

    def out() -> pa.RecordBatch:
        ids, counts, shas, own, edited, near, following = zip(*rows, strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(counts, pa.int64()), pa.array(shas), pa.array(own), pa.array(edited), pa.array(near, pa.float64()), pa.array(following, pa.float64())], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        rows.clear()
        return batch

    kind = None
    for batch in batches:
        kind = batch.schema.field("id").type
        for i in range(0, batch.num_rows, 100):
            part = batch.slice(i, 100)
            for bucket, own, name, text in zip(*(part.column(k).to_pylist() for k in ("bucket", "own", "id", "text")), strict=True):
                points = np.frombuffer((text or "").encode("utf-32-le"), "<u4")
                mark = fingerprint(points)
                if held is not None and held[0] == bucket and held[1]:
                    changed = edit(held[3], points)
                    other = fingerprint(changed)
                    sha = hashlib.sha256(changed.tobytes().decode("utf-32-le").encode()).hexdigest()
                    rows.append((held[2], len(held[3]), sha, str(held[4]), str(other), likeness(held[4], other), likeness(held[4], mark)))
                held = (bucket, own, name, points, mark)
                size += len(points)
            if size > 1 << 20 and rows:
                size = 0
                yield out()
    if rows:
        yield out()


def _bucket(bounds: list):
    """Bucket of an id that is not null: how many of the bounds it reaches. Only the ids go to Python, as whole numbers."""
    edges = np.array(bounds, np.int64)

    @F.pandas_udf(T.IntegerType())
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), "right").astype(np.int32))

    return of


def with_next(docs: DataFrame, buckets: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; ids are whole numbers.

    Ids are cut into ranges. A range's first document also goes to the range before it, as the next of that range's
    last; the first of all goes to the last range. Only the ranges' bounds and first ids come to the driver.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = buckets or 4 * partitions
    ids = rows.select("id")
    bounds = sorted({int(x) for x in ids.approxQuantile("id", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
    place = F.when(F.col("id").isNull(), 0).otherwise(_bucket(bounds)(F.coalesce(F.col("id"), F.lit(bounds[0])).cast("long"))) if bounds else F.lit(0)
    placed = rows.withColumn("bucket", place)
    # Rows without an id are first, so the first of a range is null where one of them is there.
    lead = F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("first"))
    firsts = sorted((r["bucket"], r["lead"]["first"]) for r in ids.withColumn("bucket", place).groupBy("bucket").agg(F.min(lead).alias("lead")).collect())
    if not firsts:
        firsts = [(0, None)]
    before = [firsts[k - 1][0] for k in range(len(firsts))]
    # One row a range.
    table = spark.createDataFrame([(b, f, t) for (b, f), t in zip(firsts, before, strict=True)], T.StructType([T.StructField("b", T.IntegerType()), T.StructField("f", rows.schema["id"].dataType), T.StructField("to", T.IntegerType())]))
    sent = placed.join(F.broadcast(table), (F.col("bucket") == F.col("b")) & F.col("id").eqNullSafe(F.col("f")), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(True).alias("own"))
    head = F.struct(F.col("to").alias("bucket"), F.lit(False).alias("own"))
    both = sent.select("id", "text", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, head))).alias("x"))
    spread = both.select(F.col("x.bucket").alias("bucket"), F.col("x.own").alias("own"), "id", "text")
    ordered = spread.repartition(partitions, "bucket").sortWithinPartitions(F.col("bucket"), F.col("own").desc(), F.col("id"), F.col("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_chars", T.LongType()), *(T.StructField(k, T.StringType()) for k in ("edited_sha256", "fingerprint", "edited_fingerprint")), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    return ordered.mapInArrow(_judge, T.StructType([T.StructField("id", rows.schema["id"].dataType), *schema.fields[1:]])).withColumnRenamed("id", id_column)
