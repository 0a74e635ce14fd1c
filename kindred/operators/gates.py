"""Precision gates on scored pairs: token overlap, token Jaccard, margin to the runner-up, token to type affinity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .tables import keep


@dataclass
class Gates:
    """Which gates hold. mode: enforce drops what fails; report_only and shadow only mark it."""

    min_token_jaccard: float | None = None
    min_margin: float = 0.0
    require_overlap: bool = False
    overlap_bypass: float = 1.01
    affinity: dict[str, list[str]] = field(default_factory=dict)
    mode: str = "enforce"


def margins(scored: DataFrame) -> DataFrame:
    """(key, second): each document's second best score, 0 if it has one pair only. Top two by aggregation, not by sorting all."""
    ends = scored.select(F.col("doc1_key").alias("key"), "score").unionByName(scored.select(F.col("doc2_key").alias("key"), "score"))
    counted = ends.groupBy("key", "score").agg(F.count("*").alias("n"))
    best = counted.groupBy("key").agg(F.max_by(F.struct("score", "n"), "score").alias("best"))
    next_ = counted.join(best.select("key", F.col("best.score").alias("top")), "key").filter(F.col("score") < F.col("top")).groupBy("key").agg(F.max("score").alias("next"))
    return best.join(next_, "key", "left").select("key", F.when(F.col("best.n") > 1, F.col("best.score")).otherwise(F.coalesce("next", F.lit(0.0))).alias("second"))


def token_table(docs: DataFrame, columns: list[str], key: str, stopwords: tuple[str, ...] = (), acronyms: bool = False, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, tokens): distinct words of all columns, with acronyms and aliases if asked for."""
    found = F.array_distinct(F.flatten(F.array(*(text.gate_tokens(F.col(c), stopwords, acronyms) for c in columns))))
    return docs.select(F.col(key).alias("key"), text.expand_aliases(found, aliases or {}).alias("tokens"))


def affinity_rejects(tokens: Column, kind: Column, affinity: dict[str, list[str]]) -> Column:
    """Some token of the source asks for types, and none of them is the candidate's."""
    asked, met = F.lit(False), F.lit(False)
    for token, types in affinity.items():
        there = F.array_contains(tokens, token)
        asked, met = asked | there, met | (there & kind.isin(*types))
    return F.when(F.coalesce(F.trim(kind), F.lit("")) == "", F.lit(False)).otherwise(asked & ~met)


def apply_gates(scored: DataFrame, gates: Gates, tokens: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """scored with rejected_by (null: accepted); enforce keeps the accepted alone. A pair is rejected by the first gate it fails.

    tokens is (key, tokens), types (key, type). Margins are those among all pairs, before any gate.
    """
    if gates.min_margin > 0:
        scored = keep(scored, "scored")  # read once for the pairs and for each of the margins' steps
    out = scored
    if tokens is not None:
        out = out.join(tokens.select(F.col("key").alias("doc1_key"), F.col("tokens").alias("_t1")), "doc1_key", "left").join(tokens.select(F.col("key").alias("doc2_key"), F.col("tokens").alias("_t2")), "doc2_key", "left")
    if gates.min_margin > 0:
        second = keep(margins(scored), "margins")
        out = out.join(second.select(F.col("key").alias("doc1_key"), F.col("second").alias("_m1")), "doc1_key", "left").join(second.select(F.col("key").alias("doc2_key"), F.col("second").alias("_m2")), "doc2_key", "left")
    if types is not None:
        out = out.join(types.select(F.col("key").alias("doc2_key"), F.col("type").alias("_type")), "doc2_key", "left")
    none = F.expr("cast(array() as array<string>)")
    t1, t2 = (F.coalesce(F.col(c), none) if tokens is not None else none for c in ("_t1", "_t2"))
    why: Column = F.lit(None).cast("string")
    # From the last gate to the first, so that the first one's name stays.
    if gates.affinity and types is not None:
        why = F.when(affinity_rejects(t1, F.col("_type"), gates.affinity), "type_affinity").otherwise(why)
    if gates.require_overlap:
        why = F.when((F.col("score") < gates.overlap_bypass) & ~F.arrays_overlap(t1, t2), "token_overlap").otherwise(why)
    if gates.min_margin > 0:
        low = (F.round(F.col("score") - F.col("_m1"), 6) < gates.min_margin) | (F.round(F.col("score") - F.col("_m2"), 6) < gates.min_margin)
        why = F.when(low, "margin").otherwise(why)
    if gates.min_token_jaccard is not None:
        why = F.when(text.jaccard(t1, t2) < gates.min_token_jaccard, "token_jaccard").otherwise(why)
    judged = out.withColumn("rejected_by", why).select(*scored.columns, "rejected_by")
    return judged.filter("rejected_by is null") if gates.mode == "enforce" else judged


def gate_report(judged: DataFrame) -> DataFrame:
    """(rejected_by, pairs) of pairs judged with a mode that drops none; 'accepted' for the rest."""
    return judged.groupBy(F.coalesce("rejected_by", F.lit("accepted")).alias("rejected_by")).agg(F.count("*").alias("pairs"))
