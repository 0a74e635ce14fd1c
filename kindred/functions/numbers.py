"""Dates, geography, vectors and quantiles as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd")


def parse_date(value: Column) -> Column:
    """The first format that fits; four digits alone are a year; null if none does."""
    text = F.trim(value.cast("string"))
    year = F.when(text.rlike("^[0-9]{4}$"), F.try_to_date(F.concat(text, F.lit("-01-01")), "yyyy-MM-dd"))
    return F.coalesce(year, *(F.try_to_date(F.substring(text, 1, 10) if "-" in f else text, f) for f in FORMATS))


def recency(*values: Column) -> Column:
    """Seconds since 1970 of the first value that is a time, 0 if none is."""
    return F.coalesce(*(F.unix_timestamp(F.try_to_timestamp(v.cast("string"))) for v in values), F.lit(0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() would make 1 of a null.
    return 2 * 6371.0 * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bucket(x: Column, width: float) -> Column:
    return F.floor(x / width + 1e-7)


def nearest_quantile(df: DataFrame, column: str, q: float, by: list[str] | None = None) -> DataFrame:
    """(by..., quantile): the value at index round(q * (n - 1)) of each group's sorted values, halves to the even index."""
    keys = by or []
    w = Window.partitionBy(*keys).orderBy(column)
    ranked = df.filter(F.col(column).isNotNull()).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return ranked.filter(F.col("_i") == F.bround(F.lit(q) * (F.col("_n") - 1), 0)).select(*keys, F.col(column).alias("quantile"))
