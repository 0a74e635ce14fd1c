"""Weakly connected components by alternating stars; a small graph is solved in one task, a large one first range by range."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import ship
from .tables import keep, scratch

#: Distinct links up to which one task finds the components by union-find; more go through rounds of joins.
LOCAL_LINKS = 200_000


def active(edges: DataFrame) -> DataFrame:
    """Edges that are not suppressed; an unset flag counts as active."""
    return edges.filter(~F.coalesce(F.col("suppressed"), F.lit(False))) if "suppressed" in edges.columns else edges


def _forest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch["u"], batch["v"], strict=True):
            parent.setdefault(u, u), parent.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pd.DataFrame({"node": nodes, "root": [find(n) for n in nodes]})


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, src: str = "src", dst: str = "dst", local_links: int = LOCAL_LINKS, rounds: int = 100) -> DataFrame:
    """(node, root): root is the least node reachable over active edges; nodes of no edge are absent.

    A node's least neighbour comes from an aggregation joined back on the node: a hub's edges are combined where they
    lie. Each round is kept, so rounds do not pile up in the plan; the labels are kept, and the rounds removed.
    """
    a, b = F.col(src), F.col(dst)
    links = active(edges).filter(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    with scratch(edges.sparkSession) as held:
        stars = held(links.distinct(), "links")
        if stars.count() <= local_links:
            ship(edges.sparkSession)
            kind = stars.schema["u"].dataType
            return keep(stars.coalesce(1).mapInPandas(_forest, T.StructType([T.StructField("node", kind), T.StructField("root", kind)])), "components")
        return keep(_with_loops(stars, _solved(stars.filter("u != v"), held, rounds)), "components")


def _with_loops(links: DataFrame, named: DataFrame) -> DataFrame:
    """Nodes whose only link is to themselves are components, too."""
    loops = links.filter("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    return named.union(loops.join(named.select("node"), "node", "left_anti"))


def _labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, sorted, and the least node that each is linked to over any number of them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (further := label[label]).tobytes() != label.tobytes():
            label = further


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        nodes, roots = _labels(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


#: Links from which on a graph is contracted before the rounds, and those that one task contracts.
CONTRACT, PART = 200_000, 500_000


def _solved(stars: DataFrame, held: Callable[[DataFrame, str], DataFrame], rounds: int) -> DataFrame:
    """(node, root) of links (u, v) with u > v.

    Links of near numbers lie in one range and mostly hang together, so each range's components are found in its task
    first. What is left to the rounds are links between the ranges' roots, by nodes that several ranges have. A graph whose
    links are not near each other is not made smaller and goes through the rounds as it is.
    """
    kind, count = stars.schema["u"].dataType, stars.count()
    if count <= CONTRACT or not isinstance(kind, T.LongType):
        return _by_rounds(stars, held, rounds)
    ship(stars.sparkSession)
    schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
    near = held(stars.repartitionByRange(max(4, -(-count // PART)), "v", "u").mapInArrow(_local, schema), "near")
    one = held(near.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other"), F.count("*").alias("n")), "one")
    # Of a node in more than two ranges the roots between the least and the greatest, too.
    more = near.join(one.filter("n > 2").select("node", F.col("root").alias("least")), "node").select(F.col("root").alias("u"), F.col("least").alias("v"))
    between = held(one.select(F.col("other").alias("u"), F.col("root").alias("v")).union(more).filter("u != v").distinct(), "between")
    left = between.count()
    if left > count // 2:
        return _by_rounds(stars, held, rounds)
    if not left:
        return one.select("node", "root")
    found = _solved(between, held, rounds).select(F.col("node").alias("root"), F.col("root").alias("_last"))
    return one.select("node", "root").join(found, "root", "left").select("node", F.coalesce("_last", "root").alias("root"))


def _by_rounds(stars: DataFrame, held: Callable[[DataFrame, str], DataFrame], rounds: int) -> DataFrame:
    state = _state(stars)
    for _ in range(rounds):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        pulled = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = pulled.join(pulled.groupBy("u").agg(F.min("v").alias("m")), "u")
        stars = held(nearest.select("u", F.col("m").alias("v")).union(nearest.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "stars")
        before, state = state, _state(stars)
        if before == state:
            found = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return found.union(found.select(F.col("root").alias("node"), "root").distinct())
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def clusters(labels: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """Members' labels of clusters of a fit size."""
    sizes = labels.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    if most is not None:
        sizes = sizes.filter(F.col("size") <= most)
    return labels.join(sizes, "root").select(F.col("root").alias("cluster_id"), F.col("node").alias("member_key"), "size")


def cluster_documents(members: DataFrame) -> DataFrame:
    """(cluster_id, size, member_keys, cluster_key): one row a cluster, for sinks. Its key hashes its members."""
    gathered = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.col("member_key").cast("string"))).alias("member_keys"))
    return gathered.withColumn("cluster_key", F.concat(F.lit("c_"), F.substring(F.md5(F.array_join("member_keys", "|")), 1, 24)))
