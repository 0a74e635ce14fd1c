"""Incremental resolution: new records against a table, as a batch or from a stream."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import jaro_winkler_similarity


def _beginning(f: str, letters: int) -> Column:
    return F.lower(F.substring(F.col(f).cast("string"), 1, letters))


def meeting_sizes(records: DataFrame, docs: DataFrame, fields: list[str], prefix: int = 3) -> DataFrame:
    """(field, p, records, docs, pairs) of each beginning that records and docs share: what resolve() would compare."""
    out = []
    for f in fields:
        a, b = (d.select(_beginning(f, prefix).alias("p")).filter("p is not null and p != ''").groupBy("p").agg(F.count("*").alias(n)) for d, n in ((records, "records"), (docs, "docs")))
        out.append(a.join(b, "p").select(F.lit(f).alias("field"), "p", "records", "docs", (F.col("records") * F.col("docs")).alias("pairs")))
    return reduce(DataFrame.union, out)


def resolve(records: DataFrame, docs: DataFrame, fields: list[str], key: str = "_key", threshold: float = 0.8, top: int = 10, prefix: int = 3, most: int | None = None, longer: int = 3) -> DataFrame:
    """(record_key, doc_key, score): each record's best documents.

    They meet where some field begins alike in lower case (an equi-join a field). A field scores 1 where equal but for
    case, else by Jaro-Winkler; it is left out only if both are empty. A record does not meet its own key. Of equal
    scores the least key comes first.

    With most, a beginning that more documents share is not a key by itself: there the field must begin alike for longer
    more letters. The sizes are counted first; those beyond most are as few as most is large.
    """
    met = []
    for f in fields:
        a = records.select(F.col(key).alias("record_key"), _beginning(f, prefix).alias("p"), _beginning(f, prefix + longer).alias("q")).filter("p is not null and p != ''")
        b = docs.select(F.col(key).alias("doc_key"), _beginning(f, prefix).alias("p"), _beginning(f, prefix + longer).alias("q")).filter("p is not null and p != ''")
        if most is not None:
            crowded = b.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("p", F.lit(True).alias("crowded"))
            a, b = (d.join(crowded, "p", "left").withColumn("p", F.when(F.col("crowded"), F.concat(F.lit("+"), "q")).otherwise(F.concat(F.lit("="), "p"))) for d in (a, b))
        met.append(a.select("record_key", "p").join(b.select("doc_key", "p"), "p").select("record_key", "doc_key"))
    pairs = reduce(DataFrame.union, met).filter("record_key != doc_key").distinct()
    left = records.select(F.col(key).alias("record_key"), *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"a_{f}") for f in fields))
    right = docs.select(F.col(key).alias("doc_key"), *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"b_{f}") for f in fields))
    both = pairs.join(left, "record_key").join(right, "doc_key")
    parts = []
    for f in fields:
        a, b = F.col(f"a_{f}"), F.col(f"b_{f}")
        parts.append(F.when((a == "") & (b == ""), None).when(F.lower(a) == F.lower(b), 1.0).otherwise(jaro_winkler_similarity(a, b)))
    named = both.withColumns({f"_s{i}": p for i, p in enumerate(parts)})
    there = sum((F.col(f"_s{i}").isNotNull().cast("int") for i in range(len(parts))), F.lit(0))
    total = sum((F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i in range(len(parts))), F.lit(0.0))
    scored = named.withColumn("score", F.when(there > 0, F.round(total / there, 4)).otherwise(0.0)).filter(F.col("score") >= threshold).select("record_key", "doc_key", "score")
    from pyspark.sql import Window

    w = Window.partitionBy("record_key").orderBy(F.desc("score"), "doc_key")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def resolve_stream(stream: DataFrame, docs: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, fields: list[str], **options) -> StreamingQuery:
    """Each micro-batch against docs() as it is then; sink gets the matches and the batch's number, and may be called
    again with the same number after a failure."""

    def each(batch: DataFrame, number: int) -> None:
        sink(resolve(batch, docs(), fields, **options), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
