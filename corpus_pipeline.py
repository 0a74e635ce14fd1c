"""A corpus pipeline over documents: each stage is an operator of kindred.llm and works on all that came before it.

Defined cases of every stage: an empty table gives an empty table; repeated rows of an id are treated alike; rows without
an id are kept unless their language is rejected; further columns are carried through, whatever they are called; texts of
any length are worked on whole. What a null or empty text, or a tie, means is said at each stage.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from kindred.llm import bpe, decontaminate, language, repeats, simhash  # noqa: E402
from kindred.llm.queries import tokenizer_path  # noqa: E402
from kindred.llm.shared import held_out, keep  # noqa: E402

#: Texts less like every learnt language than this are rejected, as are texts without a letter.
LEAST_COSINE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay. With no labelled language there is nothing to tell by, and all stay.

    A text that is null or has no letter goes. Of equal likenesses the first language in the alphabet is taken: either stays.
    """
    names, prototypes = language.learn(docs.filter(~held_out(F.col("doc_id"))))
    if not names:
        return docs
    found = language.predict(docs, names, prototypes)
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_COSINE))
    return kept.select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays. Empty and null texts are copies of each other."""
    return simhash.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and sentences met in a document of lesser id, or before in the same one, are cut out; a null text stays null."""
    return repeats.remove(docs, spans_column=None)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out, documents that are little else go; texts without a word, and null ones, stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of what they decode to; a null text counts as empty and has no ids."""
    decoded = bpe.round_trip(docs, tokenizer_path())
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Learnt prototypes, fingerprints and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over documents, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
