"""Writers: tables, JSON lines, delimited files, cluster exports, embeddings, and a version file for schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replaces what is there; rows go to the folders of their by columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_delimited(df: DataFrame, path: str, delimiter: str = "\t", header: bool = True) -> None:
    """Arrays and maps go as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("sep", delimiter).option("header", header).csv(path)


def export_clusters(clusters: DataFrame, path: str) -> None:
    """(cluster_id, size, member_keys...) as JSON lines and as CSV."""
    write_jsonl(clusters, f"{path}/json")
    write_delimited(clusters, f"{path}/csv", ",")


def write_nodes_and_edges(nodes: DataFrame, edges: DataFrame, path: str, form: str = "jsonl") -> None:
    for name, df in (("nodes", nodes), ("edges", edges)):
        write_jsonl(df, f"{path}/{name}") if form == "jsonl" else write_delimited(df, f"{path}/{name}")


def with_embeddings(docs: DataFrame, embeddings: DataFrame, key: str = "_key", column: str = "embedding", only_missing: bool = True) -> DataFrame:
    """docs with (key, vector) joined in; vectors that are there stay if only_missing."""
    new = embeddings.select(key, F.col("vector").alias("_v"))
    met = docs.join(new, key, "left")
    old = F.col(column) if column in docs.columns else F.lit(None)
    value = F.coalesce(old, F.col("_v")) if only_missing else F.coalesce(F.col("_v"), old)
    return met.withColumn(column, value).drop("_v")


def migrate(spark: SparkSession, path: str, steps: list[Callable[[SparkSession], None]]) -> int:
    """Runs the steps beyond the version that path records, each recorded as it is done; the version then."""
    try:
        done = spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = 0
    for k, step in enumerate(steps, 1):
        if k > done:
            step(spark)
            spark.range(1).select(F.lit(k).alias("version")).write.mode("append").parquet(path)
    return max(done, len(steps))
