"""Canonicalisation: rows to distinct normalised signatures, with the variants they came from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest16

Normalisers = dict[str, Callable[[Column], Column]]


def signed(rows: DataFrame, fields: Normalisers, shard: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """rows with n_<field>, signature (their hash) and shard; rows with nothing in any field are dropped."""
    normal = {f"n_{f}": F.coalesce(g(F.col(f)), F.lit("")) for f, g in fields.items()}
    out = rows.withColumns(normal)
    joined = F.concat_ws("|", *(F.col(n) for n in normal))
    some = F.concat(*(F.col(n) for n in normal)) != ""
    return out.filter(some).withColumn("signature", digest16(joined)).withColumn("shard", shard(out) if shard else F.lit(None).cast("string"))


def canonical(rows: DataFrame, fields: Normalisers, key: str, source: str, keep: list[str] | None = None, hub_at: int = 10, shard: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """One row a signature: normalised fields, the first row's (least key's) attributes, rows, sources, hub flag."""
    s = signed(rows, fields, shard)
    normal = [f"n_{f}" for f in fields]
    attributes = [*fields, *(keep or [])]
    return (
        s.groupBy("signature", "shard", *normal)
        .agg(F.min(key).alias("first_key"), F.min_by(F.struct(*attributes), key).alias("_first"), F.count("*").alias("row_count"), F.countDistinct(source).alias("in_degree"))
        .select("signature", "shard", *normal, "first_key", *(F.col("_first")[a].alias(a) for a in attributes), "row_count", "in_degree", (F.col("in_degree") >= hub_at).alias("is_hub"))
    )


def variants(rows: DataFrame, fields: Normalisers, key: str, top: int = 5) -> DataFrame:
    """(signature, variant, n, rank): each signature's most frequent raw spellings, the first seen before equals."""
    s = signed(rows, fields)
    raw = F.concat_ws("|", *(F.coalesce(F.col(f), F.lit("")) for f in fields))
    counted = s.groupBy("signature", raw.alias("variant")).agg(F.count("*").alias("n"), F.min(key).alias("first_key"))
    w = Window.partitionBy("signature").orderBy(F.desc("n"), "first_key")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("first_key")


def links(rows: DataFrame, fields: Normalisers, key: str, source: str, extra: list[str] | None = None) -> DataFrame:
    """(source, signature, n, ...extra): an edge from each source to each of its signatures."""
    return signed(rows, fields).groupBy(source, "signature", *(extra or [])).agg(F.count("*").alias("n"))


def address_blocks(docs: DataFrame, key_column: Column, key: str, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Members of duplicate addresses of a fit size; and (address_key, size) of those too large."""
    rows = docs.select(F.col(key).alias("_key"), key_column.alias("address_key")).filter("address_key is not null and replace(address_key, '|', '') != ''")
    sizes = rows.groupBy("address_key").agg(F.count("*").alias("size")).filter("size >= 2")
    return rows.join(sizes.filter(F.col("size") <= most), "address_key"), sizes.filter(F.col("size") > most)
