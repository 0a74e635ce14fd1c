"""Match edges as a table: deterministic keys, idempotent inserts, removal, verdicts, defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edge_key, pair_id, vertex_key


def make_edges(scored: DataFrame, method: str = "similarity", timestamp: str | None = None, extra: list[str] | None = None, bidirectional: bool = False) -> DataFrame:
    """(edge_key, src, dst, similarity, method, ts, suppressed, confirmed, ...extra), one row a pair.

    The best score of a repeated pair stays. bidirectional adds each reverse edge under a key of its own.
    """
    ends = F.col("doc1_key").cast("string"), F.col("doc2_key").cast("string")
    a, b = F.least(*ends), F.greatest(*ends)
    ts = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    extra = extra or []
    best = scored.select(a.alias("src"), b.alias("dst"), F.col("score").alias("similarity"), *extra).groupBy("src", "dst").agg(F.max_by(F.struct("similarity", *extra), F.struct("similarity", *extra)).alias("_x"))
    edges = best.select(edge_key(F.col("src"), F.col("dst")).alias("edge_key"), "src", "dst", F.col("_x.similarity").alias("similarity"), F.lit(method).alias("method"), ts.alias("ts"), F.lit(False).alias("suppressed"), F.lit(False).alias("confirmed"), *(F.col("_x")[c].alias(c) for c in extra))
    if not bidirectional:
        return edges
    back = edges.withColumn("edge_key", F.md5(F.concat("dst", F.lit("=>"), "src"))).withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(back)


def insert_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing and what is new by key: inserting twice changes nothing."""
    return existing.unionByName(new.join(existing.select("edge_key"), "edge_key", "left_anti"), allowMissingColumns=True)


def clear_edges(edges: DataFrame, method: str | None = None, older_than: str | None = None) -> DataFrame:
    """edges without those of a method and before a time; without either all go."""
    gone: Column = F.lit(True)
    if method is not None:
        gone = gone & (F.col("method") == method)
    if older_than is not None:
        gone = gone & (F.col("ts") < older_than)
    return edges.filter(~F.coalesce(gone, F.lit(False)))


def clear_inferred(edges: DataFrame, older_than: str | None = None) -> DataFrame:
    gone = F.col("inferred")
    if older_than is not None:
        gone = gone & (F.col("ts") < older_than)
    return edges.filter(~F.coalesce(gone, F.lit(False)))


def keep_last(rows: DataFrame, n: int, timestamp: str = "ts") -> DataFrame:
    """Rows of the n latest distinct times."""
    latest = rows.select(timestamp).distinct().orderBy(F.desc(timestamp)).limit(n)
    return rows.join(latest.agg(F.min(timestamp).alias("_cut")), F.col(timestamp) >= F.col("_cut")).drop("_cut")


def apply_verdicts(edges: DataFrame, verdicts: DataFrame, timestamp: str = "") -> DataFrame:
    """edges after (key1, key2, decision) verdicts: no_match suppresses, match confirms; missing edges are added.

    Of several verdicts on a pair the last by created_at (then decision) holds.
    """
    a, b = F.least("key1", "key2"), F.greatest("key1", "key2")
    last = verdicts.select(a.alias("src"), b.alias("dst"), "decision", "created_at").groupBy("src", "dst").agg(F.max_by("decision", F.struct("created_at", "decision")).alias("decision"))
    said = last.select(edge_key(F.col("src"), F.col("dst")).alias("edge_key"), F.col("src").alias("_src"), F.col("dst").alias("_dst"), "decision")
    met = edges.join(said, "edge_key", "full")
    new = {
        "src": F.coalesce("src", "_src"),
        "dst": F.coalesce("dst", "_dst"),
        "method": F.coalesce("method", F.lit("verdict")),
        "ts": F.coalesce("ts", F.lit(timestamp)),
        "suppressed": F.when(F.col("decision").isNull(), F.col("suppressed")).otherwise(F.col("decision") == "no_match"),
        "confirmed": F.when(F.col("decision").isNull(), F.col("confirmed")).otherwise(F.col("decision") == "match"),
    }
    return met.select(*(new.get(c, F.col(c)).alias(c) for c in edges.columns))


def removal_verdicts(members: DataFrame, removed: DataFrame, timestamp: str) -> DataFrame:
    """no_match between each removed member and every other of its cluster; (cluster_id, member_key) both."""
    gone = removed.select("cluster_id", F.col("member_key").alias("key1"))
    rest = members.select("cluster_id", F.col("member_key").alias("key2"))
    return gone.join(rest, "cluster_id").filter("key1 != key2").select("key1", "key2", F.lit("no_match").alias("decision"), F.lit(timestamp).alias("created_at"))


def merge_verdicts(members: DataFrame, timestamp: str, group: str = "cluster_id") -> DataFrame:
    """match along the consecutive members of each group."""
    w = Window.partitionBy(group).orderBy("member_key")
    return members.select(F.lag("member_key").over(w).alias("key1"), F.col("member_key").alias("key2")).filter("key1 is not null").withColumns({"decision": F.lit("match"), "created_at": F.lit(timestamp)})


def edge_defects(edges: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row: edges, without a score, below the threshold, loops."""
    return edges.agg(F.count("*").alias("total_edges"), F.count_if(F.col("similarity").isNull()).alias("missing_score"), F.count_if(F.col("similarity") < threshold).alias("below_threshold"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))


def confidence_buckets(edges: DataFrame, width: float = 0.05) -> DataFrame:
    """(bucket, edges, avg_confidence) of inferred edges by confidence."""
    b = F.round(F.floor(F.col("similarity") / width + 1e-7) * width, 4)
    return edges.filter(F.col("similarity").isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("edges"), F.round(F.avg("similarity"), 4).alias("avg_confidence"))


def canonical_pairs(edges: DataFrame) -> DataFrame:
    return edges.select(pair_id(F.col("src"), F.col("dst")).alias("pair_id"), "similarity", "confirmed")


def scored_edges(edges: DataFrame, least: float | None = None) -> DataFrame:
    """(pair_id, score, confirmed) of active edges that have a score, of least at least."""
    own = edges.filter(~F.coalesce(F.col("suppressed"), F.lit(False)) & F.col("similarity").isNotNull())
    if least is not None:
        own = own.filter(F.col("similarity") >= least)
    return own.select(pair_id(F.col("src"), F.col("dst")).alias("pair_id"), F.col("similarity").alias("score"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


def truth_pairs(rows: DataFrame) -> DataFrame:
    """(pair_id) of known matches, whether they come as edges (_from, _to: ids with a collection) or as (id_a, id_b)."""
    a, b = (("_from", "_to") if "_from" in rows.columns else ("id_a", "id_b"))
    x, y = (vertex_key(F.col(c).cast("string")) for c in (a, b))
    return rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(pair_id(x, y).alias("pair_id")).distinct()


def weighted_edges(edges: DataFrame, weight: str = "confidence", least: float | None = None) -> DataFrame:
    """(src, dst, weight) of active edges: each pair once, by its greatest weight; without one it is 1."""
    value = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight in edges.columns else F.lit(1.0)
    own = edges.filter(~F.coalesce(F.col("suppressed"), F.lit(False)) & (F.col("src") != F.col("dst"))).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), value.alias("weight"))
    found = own.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return found if least is None else found.filter(F.col("weight") >= least)
