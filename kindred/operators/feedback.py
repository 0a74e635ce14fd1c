"""Verdicts of reviewers: statistics, queries, queues."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import learning, scoring
from .tables import keep


def statistics(verdicts: DataFrame) -> DataFrame:
    """(decision, n, avg_score, avg_confidence)."""
    return verdicts.groupBy("decision").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("avg_score"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


def query(verdicts: DataFrame, decision: str | None = None, source: str | None = None, scores: tuple[float, float] | None = None, sort: str = "created_at", descending: bool = True, offset: int = 0, limit: int | None = 50) -> tuple[DataFrame, DataFrame]:
    """A page of verdicts in order (pair_key after equals), and the total as one row."""
    if sort not in ("score", "created_at", "confidence"):
        raise ValueError(sort)
    rows = verdicts
    if decision:
        rows = rows.filter(F.col("decision") == decision)
    if source:
        rows = rows.filter(F.col("source") == source)
    if scores:
        rows = rows.filter(F.col("score").between(*scores))
    page = rows.orderBy(F.desc(sort) if descending else F.asc(sort), "pair_key").offset(offset)
    return (page if limit is None else page.limit(limit)), rows.agg(F.count("*").alias("total"))


def pending_reviews(verdicts: DataFrame) -> DataFrame:
    """One row: pairs that a model left for review and no person has decided since."""
    asked = verdicts.filter((F.col("source") == "llm") & (F.col("decision") == "needs_review")).select("pair_key").distinct()
    return asked.join(verdicts.filter(F.col("source") == "human").select("pair_key"), "pair_key", "left_anti").agg(F.count("*").alias("pending"))


def history(rows: DataFrame, key: str | None = None, value: object = None, offset: int = 0, limit: int = 50, time: str = "ts") -> DataFrame:
    """The latest rows, of one key if given."""
    own = rows.filter(F.col(key) == value) if key else rows
    return own.orderBy(F.desc(time), *(c for c in rows.columns if c != time)).offset(offset).limit(limit)


def suspects(queue: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pending entries of clusters that still exist, least coherent first."""
    return queue.filter(F.col("status") == "pending").join(clusters.select("cluster_id").distinct(), "cluster_id", "left_semi").orderBy("mean_score", "cluster_id")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows in place of those of equal key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def result_check(expected: int, actual: DataFrame) -> DataFrame:
    """One row: whether as many rows came as were expected; nothing expected always passes."""
    return actual.agg(F.count("*").alias("actual")).select(F.lit(expected).cast("long").alias("expected"), "actual", ((F.lit(expected) == 0) | (F.col("actual") == expected)).alias("passes"))


@dataclass
class AdaptiveVerifier:
    """verification_band() whose band follows the verdicts: after every so many new ones it is learnt anew from all.

    What a model decided (match or no_match) is appended to the table at path; failures and scores outside the band are
    not. A band learnt from too few verdicts is not taken over.
    """

    spark: SparkSession
    path: str
    every: int = 50
    low: float = 0.6
    high: float = 0.85
    since: int = 0

    def review(self, scored: DataFrame, verdicts: Callable[[DataFrame], DataFrame], budget: int | None = None, timestamp: str = "") -> DataFrame:
        said: list[DataFrame] = []

        def once(asked: DataFrame) -> DataFrame:
            said.append(keep(verdicts(asked), "verdicts"))
            return said[0]

        found = scoring.verification_band(scored, once, self.low, self.high, budget)
        decided = said[0].filter(F.col("verdict").isin("match", "no_match")).join(scored.select("doc1_key", "doc2_key", "score"), ["doc1_key", "doc2_key"])
        new = keep(decided.select("doc1_key", "doc2_key", "score", F.col("verdict").alias("decision"), "confidence", F.lit("llm").alias("source"), F.lit(timestamp).alias("created_at")), "decided")
        new.write.mode("append").parquet(self.path)
        self.since += new.count()
        if self.since >= self.every:
            self.refresh()
        return found

    def refresh(self) -> bool:
        """Whether the band was learnt anew."""
        self.since = 0
        row = learning.thresholds_by_rank(self.spark.read.parquet(self.path)).first()
        if row["optimized"]:
            self.low, self.high = row["low_threshold"], row["high_threshold"]
        return row["optimized"]
