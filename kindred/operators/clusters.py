"""What is known of clusters: quality, sizes, validity, listings, repair."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import ship
from .components import active


def intra_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, src, dst, similarity) of active edges inside clusters, each pair once: its best score, null as 0."""
    e = active(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.coalesce("similarity", F.lit(0.0)).alias("similarity")).filter("src != dst")
    once = e.groupBy("src", "dst").agg(F.max("similarity").alias("similarity"))
    a = members.select(F.col("member_key").alias("src"), "cluster_id")
    b = members.select(F.col("member_key").alias("dst"), F.col("cluster_id").alias("_other"))
    return once.join(a, "src").join(b, "dst").filter("cluster_id = _other").drop("_other")


def quality(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, size, edge_count, average, min, max similarity, density, quality_score)."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    inside = intra_edges(members, edges).groupBy("cluster_id").agg(F.count("*").alias("edge_count"), F.round(F.avg("similarity"), 4).alias("average_similarity"), F.round(F.min("similarity"), 4).alias("min_similarity"), F.round(F.max("similarity"), 4).alias("max_similarity"))
    met = sizes.join(inside, "cluster_id", "left").fillna(0, ["edge_count"]).fillna(0.0, ["average_similarity", "min_similarity", "max_similarity"])
    possible = F.col("size") * (F.col("size") - 1) / 2
    density = F.when(F.col("size") > 1, F.round(F.col("edge_count") / possible, 4)).otherwise(0.0)
    return met.withColumn("density", density).withColumn("quality_score", F.round(F.least(F.lit(1.0), 0.4 * F.col("density") + 0.6 * F.col("average_similarity")), 4))


def size_penalised_quality(measured: DataFrame, least_size: int = 2, least_density: float = 0.3) -> DataFrame:
    """measured with an older score: size, density and similarity; large clusters and thin ones lose."""
    size = F.when(F.col("size") >= least_size, 1.0).otherwise(0.5) * F.when(F.col("size") > 20, 0.8).otherwise(1.0)
    density = F.when(F.col("density") >= least_density, F.col("density")).otherwise(F.col("density") * 0.5)
    return measured.withColumn("size_penalised_score", F.round(F.least(F.lit(1.0), size * 0.3 + density * 0.4 + F.col("average_similarity") * 0.3), 4))


def validate(measured: DataFrame, sizes: tuple[int, int] = (2, 100), density: float = 0.3, similarity: float = 0.7, spread: float = 0.5, pass_at: float = 0.6) -> DataFrame:
    """measured with four checks, the share passed, and whether that is enough."""
    checks = {
        "size_adequate": F.col("size").between(*sizes),
        "density_adequate": F.col("density") >= density,
        "similarity_adequate": F.col("average_similarity") >= similarity,
        "score_range_reasonable": F.round(F.col("max_similarity") - F.col("min_similarity"), 4) <= spread,
    }
    passed = sum((c.cast("int") for c in checks.values()), F.lit(0))
    return measured.withColumns(checks).withColumn("validation_score", passed / len(checks)).withColumn("is_valid", F.col("validation_score") >= pass_at)


def validation_summary(validated: DataFrame) -> DataFrame:
    """One row; without a cluster the rate is NaN, as in SQL."""
    n = F.count("*")
    return validated.agg(n.alias("total_clusters"), F.count_if("is_valid").alias("valid_clusters"), F.round(F.avg("validation_score"), 4).alias("average_quality_score"), F.coalesce(F.round(F.try_divide(F.count_if("is_valid"), n), 4), F.lit(float("nan"))).alias("validation_rate"))


#: Three ways to class sizes: upper bounds and names.
SIZE_CLASSES = {
    "clusters": ((2, "2"), (3, "3"), (10, "4-10"), (50, "11-50"), (None, "51+")),
    "evaluation": ((2, "2"), (5, "3-5"), (10, "6-10"), (50, "11-50"), (None, "51+")),
    "listing": ((2, "2"), (3, "3"), (4, "4"), (5, "5"), (10, "6-10"), (20, "11-20"), (None, "21+")),
}


def size_class(size: Column, kind: str = "clusters") -> Column:
    out: Column = F.lit(None).cast("string")
    for high, name in reversed(SIZE_CLASSES[kind]):
        out = F.lit(name) if high is None else F.when(size <= high, name).otherwise(out)
    return out


def size_histogram(measured: DataFrame, kind: str = "clusters") -> DataFrame:
    return measured.groupBy(size_class(F.col("size"), kind).alias("size_class")).agg(F.count("*").alias("clusters"), F.sum("size").alias("members"))


def coherence(members: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """quality() with is_bridge (weakest edge below half the mean, not complete) and low_coherence; clusters with an edge."""
    m = quality(members, edges).filter("edge_count > 0")
    bridge = (F.col("min_similarity") < 0.5 * F.col("average_similarity")) & (F.col("density") < 1)
    return m.withColumn("is_bridge", bridge).withColumn("low_coherence", F.col("average_similarity") < least)


def structural_check(members: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """One row: clusters, too small ones, members of several clusters, active edges that cross clusters."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    shared = members.groupBy("member_key").agg(F.countDistinct("cluster_id").alias("n")).filter("n > 1")
    a = members.select(F.col("member_key").alias("src"), F.col("cluster_id").alias("_a"))
    b = members.select(F.col("member_key").alias("dst"), F.col("cluster_id").alias("_b"))
    crossing = active(edges).join(a, "src").join(b, "dst").filter("_a != _b")
    one = sizes.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") < least).alias("too_small"))
    # Three one-row tables side by side.
    return one.join(F.broadcast(shared.agg(F.count("*").alias("overlapping_members")))).join(F.broadcast(crossing.agg(F.count("*").alias("crossing_edges"))))


def listing(measured: DataFrame, least: int = 2, by: str = "size", offset: int = 0, limit: int | None = None) -> DataFrame:
    """Clusters of a size, largest (or best) first."""
    order = [F.desc("size"), F.asc("cluster_id")] if by == "size" else [F.desc("quality_score"), F.desc("size"), F.asc("cluster_id")]
    rows = measured.filter(F.col("size") >= least).orderBy(*order).offset(offset)
    return rows if limit is None else rows.limit(limit)


def by_member(members: DataFrame, keys: DataFrame, key: str = "member_key") -> DataFrame:
    """All members of the clusters that keys are in."""
    return members.join(members.join(keys.select(key), key, "left_semi").select("cluster_id").distinct(), "cluster_id", "left_semi")


def graph(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in one cluster, suppressed ones too."""
    a = members.select(F.col("member_key").alias("src"), "cluster_id")
    b = members.select(F.col("member_key").alias("dst"), F.col("cluster_id").alias("_b"))
    return edges.join(a, "src").join(b, "dst").filter("cluster_id = _b").drop("_b")


def _density(keys: list, scores: dict) -> float:
    possible = len(keys) * (len(keys) - 1) // 2
    return 1.0 if not possible else sum(p in scores for p in combinations(sorted(keys), 2)) / possible


def _parts(keys: list, pairs: set) -> list[list]:
    left, out = set(keys), []
    while left:
        todo, part = [min(left)], set()
        while todo:
            k = todo.pop()
            if k not in part:
                part.add(k)
                todo += [x for p in pairs if k in p for x in p if x not in part]
        left -= part
        out.append(sorted(part))
    return out


def analyse(keys: list, scores: dict, confirmed: set, coherence_: float = 0.5) -> dict:
    """ok, split (with the edge to cut and both halves) or queue, for one cluster.

    Cut are only unconfirmed edges weaker than coherence_, weakest first, if that leaves two parts both denser than
    the whole.
    """
    if not scores:
        return {"status": "queue", "reason": "no_intra_edges"}
    mean, low, density = sum(scores.values()) / len(scores), min(scores.values()), _density(keys, scores)
    if mean >= coherence_ and not (low < 0.5 * mean and density < 1):
        return {"status": "ok", "reason": ""}
    weak = sorted((s, p) for p, s in scores.items() if p not in confirmed and s < coherence_)
    for _, pair in weak:
        parts = _parts(sorted(keys), set(scores) - {pair})
        if len(parts) == 2 and all(_density(p, scores) > density for p in parts):
            return {"status": "split", "reason": "", "cut": pair, "halves": parts}
    return {"status": "queue", "reason": "low_coherence" if mean < coherence_ else "bridge_no_clean_split"}


def _coherent(sizes: DataFrame, members: DataFrame, edges: DataFrame, coherence_: float) -> DataFrame:
    """sizes (cluster_id, size) with status and reason: ok, or queued."""
    inside = intra_edges(members.join(sizes, "cluster_id", "left_semi"), edges).groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg("similarity").alias("mean"), F.min("similarity").alias("low"))
    met = sizes.join(inside, "cluster_id", "left")
    whole = F.col("n") >= F.col("size") * (F.col("size") - 1) / 2
    fine = (F.col("mean") >= coherence_) & ((F.col("low") >= 0.5 * F.col("mean")) | whole)
    reason = F.when(F.col("n").isNull(), "no_intra_edges").when(fine, "").otherwise("too_large")
    return met.select("cluster_id", F.when(F.col("n").isNotNull() & fine, "ok").otherwise("queue").alias("status"), reason.alias("reason"))


def repair(members: DataFrame, edges: DataFrame, coherence_: float = 0.5, most: int = 1000) -> DataFrame:
    """(cluster_id, status, reason, cut_src, cut_dst, half_a, half_b) of every cluster.

    Whether a cluster is coherent is an aggregation, whatever its size. Trying the weak edges of one that is not is for
    a reviewer's sizes: such clusters of more than most members are queued as too_large, and no task is handed a cluster
    of unbounded size.
    """
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    large = _coherent(sizes.filter(F.col("size") > most), members, edges, coherence_).select("cluster_id", "status", "reason", *(F.lit(None).cast("string").alias(c) for c in ("cut_src", "cut_dst")), *(F.lit(None).cast("array<string>").alias(c) for c in ("half_a", "half_b")))
    small = members.join(sizes.filter(F.col("size") <= most), "cluster_id", "left_semi")
    inside = intra_edges(small, edges)
    flags = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.coalesce("confirmed", F.lit(False)).alias("confirmed")).groupBy("src", "dst").agg(F.bool_or("confirmed").alias("confirmed"))
    rows = inside.join(flags, ["src", "dst"], "left").select("cluster_id", F.col("src").cast("string"), F.col("dst").cast("string"), "similarity", "confirmed")
    keys = small.select("cluster_id", F.col("member_key").cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("boolean").alias("confirmed"))
    kind = members.schema["cluster_id"].dataType.simpleString()
    ship(members.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["dst"].notna()]
        pairs = [tuple(sorted(p)) for p in zip(own["src"], own["dst"], strict=True)]
        found = analyse(pdf[pdf["dst"].isna()]["src"].tolist(), dict(zip(pairs, own["similarity"], strict=True)), {p for p, c in zip(pairs, own["confirmed"], strict=True) if c}, coherence_)
        cut, halves = found.get("cut", (None, None)), found.get("halves", [None, None])
        return pd.DataFrame([{"cluster_id": pdf["cluster_id"].iloc[0], "status": found["status"], "reason": found["reason"], "cut_src": cut[0], "cut_dst": cut[1], "half_a": halves[0], "half_b": halves[1]}])

    schema = f"cluster_id {kind}, status string, reason string, cut_src string, cut_dst string, half_a array<string>, half_b array<string>"
    return keys.unionByName(rows).groupBy("cluster_id").applyInPandas(one, schema).unionByName(large)


def recluster(edges: DataFrame, old: DataFrame, touched: DataFrame, least: int = 2) -> DataFrame:
    """Members after edges changed: the clusters of touched (member_key) are found anew, all others stay as they are."""
    from .components import clusters, components

    affected = by_member(old, touched)
    near = edges.join(affected.select(F.col("member_key").alias("src")).union(touched.select(F.col("member_key").alias("src"))).distinct(), "src", "left_semi")
    new = clusters(components(near), least)
    return old.join(affected.select("member_key").distinct(), "member_key", "left_anti").select("cluster_id", "member_key", "size").unionByName(new)
