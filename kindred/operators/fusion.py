"""Golden records: which value of each field survives in a cluster, and from whom it came."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import valid

STRATEGIES = ("field_voting", "most_complete", "most_recent", "source_priority")


def long_values(members: DataFrame, docs: DataFrame, fields: list[str], key: str = "_key", recency: str | None = None, source: str | None = None) -> DataFrame:
    """(cluster_id, member_key, field, value, ts, origin): every member's values that are not blank."""
    rows = docs.select(F.col(key).alias("member_key"), *(F.col(f).cast("string").alias(f) for f in fields), (F.col(recency).cast("string") if recency else F.lit(None).cast("string")).alias("_ts"), (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("_origin"))
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))
    out = members.select("cluster_id", "member_key").join(rows, "member_key").select("cluster_id", "member_key", F.col("_ts").alias("ts"), F.col("_origin").alias("origin"), F.inline(entries))
    return out.filter(F.col("value").isNotNull() & (F.regexp_replace("value", r"\s+", "") != ""))


def survivors(values: DataFrame, strategy: str = "field_voting", overrides: dict[str, str] | None = None, priority: list[str] | None = None) -> DataFrame:
    """(cluster_id, field, value, distinct_values, chosen_from, strategy).

    field_voting: the most frequent value, of those the longest, of those the one of the first member. most_complete:
    the longest. most_recent: that of the latest time, source_priority: that of the first listed origin; both vote
    where no value has a time or a listed origin. Ties go to the first member. All are aggregations with partial sums.
    """
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(priority or []))):
        rank = F.when(F.col("origin") == name, i).otherwise(rank)
    v = values.withColumn("rank", rank)
    per = v.groupBy("cluster_id", "field", "value").agg(F.count("*").alias("n"), F.min("member_key").alias("first"))
    # Least key first under a maximum: by a window-free detour, the order is (n, length) and then the earliest first.
    voted = per.groupBy("cluster_id", "field").agg(F.min_by(F.struct("value", "first"), F.struct(-F.col("n"), -F.length("value"), F.col("first"))).alias("vote"), F.min_by(F.struct("value", "first"), F.struct(-F.length("value"), F.col("first"))).alias("longest"), F.count("*").alias("distinct_values"))
    timed = v.filter("ts is not null").groupBy("cluster_id", "field", "ts").agg(F.min_by(F.struct("value", F.col("member_key").alias("first")), "member_key").alias("x")).groupBy("cluster_id", "field").agg(F.max_by("x", "ts").alias("latest"))
    ranked = v.filter("rank is not null").groupBy("cluster_id", "field").agg(F.min_by(F.struct("value", F.col("member_key").alias("first")), F.struct("rank", "member_key")).alias("preferred"))
    met = voted.join(timed, ["cluster_id", "field"], "left").join(ranked, ["cluster_id", "field"], "left")
    choose = {"field_voting": F.col("vote"), "most_complete": F.col("longest"), "most_recent": F.coalesce("latest", "vote"), "source_priority": F.coalesce("preferred", "vote")}
    used: Column = F.lit(strategy)
    chosen: Column = choose[strategy]
    for field, own in (overrides or {}).items():
        used = F.when(F.col("field") == field, own).otherwise(used)
        chosen = F.when(F.col("field") == field, choose[own]).otherwise(chosen)
    return met.select("cluster_id", "field", chosen.alias("_c"), "distinct_values", used.alias("strategy")).select("cluster_id", "field", F.col("_c.value").alias("value"), "distinct_values", F.col("_c.first").alias("chosen_from"), "strategy")


def golden_records(members: DataFrame, docs: DataFrame, fields: list[str], key: str = "_key", strategy: str = "field_voting", overrides: dict[str, str] | None = None, recency: str | None = None, source: str | None = None, priority: list[str] | None = None, collection: str = "docs") -> DataFrame:
    """One row a cluster: golden_key, member_keys, source_cluster_hash, a column a field, provenance, stale.

    golden_key hashes the members' ids, source_cluster_hash their keys: the same members always give the same record.
    """
    chosen = survivors(long_values(members, docs, fields, key, recency, source), strategy, overrides, priority)
    wide = chosen.groupBy("cluster_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields), F.map_from_entries(F.collect_list(F.struct("field", F.struct("distinct_values", F.col("chosen_from").cast("string").alias("chosen_from"), "strategy")))).alias("provenance"))
    keys = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.col("member_key").cast("string"))).alias("member_keys"))
    ids = F.array_join(F.transform("member_keys", lambda k: F.concat(F.lit(collection + "/"), k)), "|")
    return keys.join(wide, "cluster_id", "left").select(F.md5(ids).alias("golden_key"), "cluster_id", "size", "member_keys", F.md5(F.array_join("member_keys", "|")).alias("source_cluster_hash"), *fields, "provenance", F.lit(False).alias("stale"))


def resolved_to(golden: DataFrame) -> DataFrame:
    """(member_key, golden_key): an edge from every member to its record."""
    return golden.select(F.explode("member_keys").alias("member_key"), "golden_key")


def mark_stale(golden: DataFrame, current: DataFrame) -> DataFrame:
    """golden with stale set where no current cluster (cluster_id, member_key) has exactly its members."""
    now = current.groupBy("cluster_id").agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.col("member_key").cast("string"))), "|")).alias("source_cluster_hash")).select("source_cluster_hash", F.lit(True).alias("_there")).distinct()
    return golden.drop("stale").join(now, "source_cluster_hash", "left").withColumn("stale", F.col("_there").isNull()).select(*golden.columns)


def drop_stale(golden: DataFrame, current: DataFrame) -> DataFrame:
    return mark_stale(golden, current).filter("not stale")


def merge_preview(members: DataFrame, docs: DataFrame, fields: list[str], key: str = "_key", strategy: str = "most_complete", recency: Column | None = None) -> DataFrame:
    """(cluster_id, canonical_key, fields...): the canonical member's values, its blanks filled by the others in key order.

    most_complete: most fields filled; newest: latest recency; first: least key.
    """
    shown = [F.when(F.trim(F.col(f).cast("string")) == "", None).otherwise(F.col(f).cast("string")).alias(f) for f in fields]
    rows = members.select("cluster_id", "member_key").join(docs.select(F.col(key).alias("member_key"), *shown, (recency if recency is not None else F.lit(0)).alias("_r")), "member_key")
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    order = {"most_complete": F.struct(-filled, F.col("member_key")), "newest": F.struct(-F.col("_r"), F.col("member_key")), "first": F.struct(F.col("member_key"))}[strategy]
    best = rows.groupBy("cluster_id").agg(F.min_by(F.struct("member_key", *fields), order).alias("_best"), *(F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("member_key"))).alias(f"_any_{f}") for f in fields))
    return best.select("cluster_id", F.col("_best.member_key").alias("canonical_key"), *(F.coalesce(F.col("_best")[f], F.col(f"_any_{f}")).alias(f) for f in fields))


def field_quality(kind: str, value: Column) -> Column:
    """0 to 1: blank 0; valid values of checked kinds 1, others 0.3; else longer is better, up to 20 characters."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    if kind in ("email", "phone", "zip_code", "state"):
        score = F.when(valid(kind, text), 1.0).otherwise(0.3)
    else:
        score = F.lit(0.5) + F.least(F.lit(0.5), F.length(text) / 40)
    return F.when(text == "", 0.0).otherwise(score)


def best_quality(members: DataFrame, docs: DataFrame, kinds: dict[str, str], key: str = "_key") -> DataFrame:
    """(cluster_id, fields...): the value of best quality, then the most frequent, then the first member's."""
    out = members.select("cluster_id").distinct()
    values = long_values(members, docs, list(kinds), key)
    q: Column = F.lit(0.0)
    for field, kind in kinds.items():
        q = F.when(F.col("field") == field, field_quality(kind, F.col("value"))).otherwise(q)
    per = values.groupBy("cluster_id", "field", "value").agg(F.count("*").alias("n"), F.min("member_key").alias("first")).withColumn("q", F.round(q, 4))
    best = per.groupBy("cluster_id", "field").agg(F.min_by("value", F.struct(-F.col("q"), -F.col("n"), F.col("first"))).alias("value"))
    return out.join(best.groupBy("cluster_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in kinds)), "cluster_id", "left")


def validate_records(golden: DataFrame, required: list[str], fields: list[str]) -> DataFrame:
    """golden with missing_required, completeness and is_valid."""
    there = {f: F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "" for f in {*required, *fields}}
    lacking = F.array_compact(F.array(*(F.when(~there[f], f) for f in required)))
    share = sum((there[f].cast("int") for f in fields), F.lit(0)) / len(fields)
    return golden.withColumn("missing_required", lacking).withColumn("completeness", F.round(share, 4)).withColumn("is_valid", F.size(lacking) == 0)


def statistics(golden: DataFrame, score: str = "completeness", high: float = 0.8) -> DataFrame:
    return golden.agg(F.count("*").alias("records"), F.round(F.avg(score), 4).alias("avg_score"), F.round(F.min(score), 4).alias("min_score"), F.round(F.max(score), 4).alias("max_score"), F.count_if(F.col(score) >= high).alias("high_count"))
