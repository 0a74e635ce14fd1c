"""Python workers that can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Name this package's folder to the workers, which see the same disk; a cluster gets it by --py-files or an install."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
