"""Readers: JSON with a wrapper, delimited files with or without a header file, ground truth, columnar tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, wrappers: tuple[str, ...] = ("customers", "data")) -> DataFrame:
    """A list of objects, one object, or a list under one of the wrappers' names."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    for name in wrappers:
        if df.columns == [name] and isinstance(df.schema[name].dataType, T.ArrayType):
            return df.select(F.inline(name)) if isinstance(df.schema[name].dataType.elementType, T.StructType) else df.select(F.explode(name).alias("value"))
    return df


def read_pandas(spark: SparkSession, pdf: pd.DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
    return spark.createDataFrame(pdf, schema=schema) if schema is not None else spark.createDataFrame(pdf)


def read_delimited(spark: SparkSession, path: str, delimiter: str = "\t", header_path: str | None = None, schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """Text columns; a header file's first line names them. Bytes that are not UTF-8 become replacement characters."""
    reader = spark.read.option("sep", delimiter).option("quote", "" if delimiter == "\t" else '"').option("encoding", "UTF-8").option("mode", "PERMISSIVE")
    if schema is not None:
        return reader.schema(schema).option("header", header and header_path is None).csv(path)
    if header_path is None:
        return reader.option("header", header).csv(path)
    names = [n.strip() for n in spark.read.text(header_path).first()[0].split(delimiter)]
    fields = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return reader.schema(fields).csv(path)


def read_table(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """parquet, orc, csv, json, text, avro or jdbc, as far as the session has them."""
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def truth_flag(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes", "y", "t", "match"), F.lit(False))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(doc1_key, doc2_key) of known matches from JSON or CSV of (record_a_id, record_b_id, is_match)."""
    df = read_json(spark, path, wrappers=("pairs", "data")) if path.endswith((".json", ".jsonl")) else spark.read.option("header", True).csv(path)
    lacking = {"record_a_id", "record_b_id", "is_match"} - set(df.columns)
    if lacking:
        raise ValueError(f"no {', '.join(sorted(lacking))} in {path}")
    a, b = F.col("record_a_id").cast("string"), F.col("record_b_id").cast("string")
    return df.filter(truth_flag(F.col("is_match"))).select(F.least(a, b).alias("doc1_key"), F.greatest(a, b).alias("doc2_key")).distinct()


def fetch(docs: DataFrame, keys: DataFrame, key: str = "_key") -> DataFrame:
    """docs of the given keys: a semi-join, whatever their number."""
    return docs.join(keys.select(key), key, "left_semi")
