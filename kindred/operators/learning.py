"""Parameters from data: EM for Fellegi-Sunter, thresholds from feedback, versions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json


def gammas(scored: DataFrame, thresholds: dict[str, float], prefix: str = "s_") -> DataFrame:
    """(g_<field>..., weight): agreement patterns and how often each occurs; a missing score disagrees.

    However many pairs there are, there are no more patterns than 2 to the number of fields.
    """
    bits = [(F.coalesce(F.col(prefix + f), F.lit(0.0)) >= t).cast("int").alias(f"g_{f}") for f, t in thresholds.items()]
    return scored.select(*bits).groupBy(*(f"g_{f}" for f in thresholds)).agg(F.count("*").alias("weight"))


@dataclass(frozen=True)
class Estimate:
    m: dict[str, float]
    u: dict[str, float]
    prior: float
    iterations: int


def em(patterns: DataFrame, fields: list[str], m: float = 0.9, u: float = 0.1, prior: float = 0.1, tolerance: float = 1e-5, most: int = 50) -> Estimate:
    """m, u and the share of matches. Patterns with weights give exactly what their rows one by one would.

    If a model comes out with u above m on the whole its classes have changed places and are put right.
    """
    rows = patterns.select(*(f"g_{f}" for f in fields), "weight").collect()
    g = np.array([[r[f"g_{f}"] for f in fields] for r in rows], float).reshape(-1, len(fields))
    w = np.array([r["weight"] for r in rows], float)
    ms, us, lam, n = np.full(len(fields), m), np.full(len(fields), u), prior, 0
    if not w.sum():
        return Estimate(dict.fromkeys(fields, m), dict.fromkeys(fields, u), prior, 0)
    for n in range(1, most + 1):
        a = lam * np.prod(np.where(g == 1, ms, 1 - ms), axis=1)
        b = (1 - lam) * np.prod(np.where(g == 1, us, 1 - us), axis=1)
        r = a / np.maximum(a + b, 1e-300)
        x, y = w * r, w * (1 - r)
        new = np.clip(x @ g / max(x.sum(), 1e-12), 1e-6, 1 - 1e-6), np.clip(y @ g / max(y.sum(), 1e-12), 1e-6, 1 - 1e-6), float(np.clip(x.sum() / w.sum(), 1e-6, 1 - 1e-6))
        change = max(np.abs(new[0] - ms).max(), np.abs(new[1] - us).max(), abs(new[2] - lam))
        ms, us, lam = new
        if change < tolerance:
            break
    if ms.sum() < us.sum():
        ms, us, lam = us, ms, 1 - lam
    return Estimate(dict(zip(fields, map(float, ms), strict=True)), dict(zip(fields, map(float, us), strict=True)), float(lam), n)


def config_hash(config: object) -> str:
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()[:16]


def next_version(versions: DataFrame, hash_: Column) -> DataFrame:
    """(config_hash, version): one more than the last stored for that configuration."""
    return versions.filter(F.col("config_hash") == hash_).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).select(hash_.alias("config_hash"), (F.col("v") + 1).alias("version"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """The last version's row of each configuration."""
    others = [c for c in versions.columns if c != "config_hash"]
    return versions.groupBy("config_hash").agg(F.max_by(F.struct(*others), "version").alias("_x")).select("config_hash", *(F.col("_x")[c].alias(c) for c in others))


def thresholds_by_rank(verdicts: DataFrame, least: int = 20) -> DataFrame:
    """One row: low (a tenth up the matches' scores) and high (nine tenths up the others', and a margin).

    Too few verdicts, or of one kind only, give the defaults. Ranks come from counts by score: scores have four places.
    """
    from pyspark.sql import Window

    match = F.col("decision") == "match"
    by = verdicts.groupBy(F.round("score", 4).alias("score")).agg(F.count_if(match).alias("m"), F.count_if(~match).alias("x"))
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    run = by.select("score", F.sum("m").over(w).alias("cm"), F.sum("x").over(w).alias("cx"), "m", "x")
    n = verdicts.agg(F.count_if(match).alias("nm"), F.count_if(~match).alias("nx"))
    low_at = F.greatest(F.lit(0), F.floor(F.col("nm") * 0.1) - 1)
    high_at = F.least(F.col("nx") - 1, F.floor(F.col("nx") * 0.9))
    met = run.join(F.broadcast(n))
    picked = met.agg(F.max("nm").alias("nm"), F.max("nx").alias("nx"), F.min(F.when((F.col("m") > 0) & (F.col("cm") > low_at), F.col("score"))).alias("low"), F.min(F.when((F.col("x") > 0) & (F.col("cx") > high_at), F.col("score"))).alias("top"))
    enough = (F.coalesce(F.col("nm"), F.lit(0)) + F.coalesce(F.col("nx"), F.lit(0)) >= least) & (F.col("nm") > 0) & (F.col("nx") > 0)
    low = F.round("low", 3)
    high = F.round(F.least(F.lit(0.95), F.greatest(F.round(F.col("top") + 0.05, 3), low + 0.1)), 3)
    return picked.select(F.when(enough, low).otherwise(0.55).alias("low_threshold"), F.when(enough, high).otherwise(0.8).alias("high_threshold"), (F.coalesce("nm", F.lit(0)) + F.coalesce("nx", F.lit(0))).alias("sample_count"), F.coalesce(enough, F.lit(False)).alias("optimized"))


def isotonic_thresholds(verdicts: DataFrame, precision: float = 0.95) -> tuple[float, float]:
    """low and high where the calibrated chance of a match reaches 1 - precision and precision."""
    from pyspark.ml.regression import IsotonicRegression

    data = verdicts.select(F.col("score").cast("double").alias("features"), (F.col("decision") == "match").cast("double").alias("label"))
    model = IsotonicRegression().fit(data)
    at, value = np.array(model.boundaries.toArray()), np.array(model.predictions.toArray())

    def first(p: float) -> float:
        return float(at[min(int(np.searchsorted(value, p)), len(at) - 1)])

    high, low = first(precision), first(1 - precision)
    low = round(max(0.3, min(low, high - 0.1)), 3)
    return low, round(min(0.95, max(high, low + 0.1)), 3)
