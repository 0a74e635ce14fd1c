"""Golden records and canonical forms. Clusters here are customers of one nation and segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import canonical, feedback, fusion
from .registry import query, table

FIELDS = ["c_name", "c_mktsegment", "balance"]
_MEM = """mem AS (SELECT CAST(c_nationkey AS VARCHAR) || ':' || CAST(c_custkey % 40 AS VARCHAR) AS cluster_id, c_custkey AS member_key FROM customer),
big AS (SELECT * FROM mem WHERE cluster_id IN (SELECT cluster_id FROM mem GROUP BY 1 HAVING count(*) >= 2)),
doc AS (SELECT c_custkey AS member_key, CASE WHEN c_custkey % 3 = 0 THEN 'Customer' WHEN c_custkey % 5 = 0 THEN '  ' ELSE c_name END AS c_name, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 6 AS VARCHAR) END AS balance,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(1990 + c_custkey % 30 AS VARCHAR) END AS ts, CAST(c_custkey % 5 AS VARCHAR) AS origin FROM customer)"""
_VAL = f"""{_MEM}, lv AS (SELECT cluster_id, member_key, ts, origin, field, value FROM big JOIN doc USING (member_key), LATERAL (VALUES ('c_name', c_name), ('c_mktsegment', c_mktsegment), ('balance', balance)) f(field, value) WHERE value IS NOT NULL AND regexp_replace(value, '\\s+', '', 'g') <> ''),
cnt AS (SELECT cluster_id, field, value, count(*) AS n, min(member_key) AS first FROM lv GROUP BY ALL)"""
_PICK = """vote AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, field ORDER BY n DESC, length(value) DESC, first) AS r FROM cnt) WHERE r = 1),
dv AS (SELECT cluster_id, field, count(*) AS distinct_values FROM cnt GROUP BY ALL)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat_ws(":", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 40).cast("string")).alias("cluster_id"), F.col("c_custkey").alias("member_key"))
    big = rows.groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n >= 2").select("cluster_id")
    return rows.join(big, "cluster_id", "left_semi")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("_key"),
        F.when(k % 3 == 0, "Customer").when(k % 5 == 0, "  ").otherwise(F.col("c_name")).alias("c_name"),
        "c_mktsegment",
        F.when(k % 4 != 0, (k % 6).cast("string")).alias("balance"),
        F.when(k % 7 != 0, (1990 + k % 30).cast("string")).alias("ts"),
        (k % 5).cast("string").alias("origin"),
    )


def _survivors(spark: SparkSession, sf_dir: str, strategy: str, **options) -> DataFrame:
    values = fusion.long_values(members(spark, sf_dir), documents(spark, sf_dir), FIELDS, recency="ts", source="origin")
    return fusion.survivors(values, strategy, **options).select("cluster_id", "field", "value", "chosen_from", "distinct_values")


@query(f"WITH {_VAL}, {_PICK} SELECT cluster_id, field, value, first AS chosen_from, distinct_values FROM vote JOIN dv USING (cluster_id, field)")
def golden_field_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir, "field_voting")


@query(f"WITH {_VAL}, {_PICK}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, field ORDER BY length(value) DESC, first) AS r FROM cnt) WHERE r = 1) SELECT cluster_id, field, value, first AS chosen_from, distinct_values FROM best JOIN dv USING (cluster_id, field)")
def golden_most_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir, "most_complete")


@query(f"""WITH {_VAL}, {_PICK}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, field ORDER BY ts DESC, member_key) AS r FROM lv WHERE ts IS NOT NULL) WHERE r = 1)
SELECT v.cluster_id, v.field, CASE WHEN b.value IS NULL THEN v.value ELSE b.value END AS value, coalesce(b.member_key, v.first) AS chosen_from, distinct_values FROM vote v JOIN dv USING (cluster_id, field) LEFT JOIN best b ON b.cluster_id = v.cluster_id AND b.field = v.field""")
def golden_most_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir, "most_recent")


@query(f"""WITH {_VAL}, {_PICK}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, field ORDER BY CASE origin WHEN '3' THEN 0 ELSE 1 END, member_key) AS r FROM lv WHERE origin IN ('3', '1')) WHERE r = 1)
SELECT v.cluster_id, v.field, CASE WHEN b.value IS NULL THEN v.value ELSE b.value END AS value, coalesce(b.member_key, v.first) AS chosen_from, distinct_values FROM vote v JOIN dv USING (cluster_id, field) LEFT JOIN best b ON b.cluster_id = v.cluster_id AND b.field = v.field""")
def golden_source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir, "source_priority", priority=["3", "1"])


@query(f"""WITH {_VAL}, {_PICK}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, field ORDER BY length(value) DESC, first) AS r FROM cnt) WHERE r = 1),
ch AS (SELECT cluster_id, field, value FROM vote WHERE field <> 'c_name' UNION ALL SELECT cluster_id, field, value FROM best WHERE field = 'c_name'),
w AS (SELECT cluster_id, max(value) FILTER (field = 'c_name') AS c_name, max(value) FILTER (field = 'c_mktsegment') AS c_mktsegment, max(value) FILTER (field = 'balance') AS balance FROM ch GROUP BY 1),
k AS (SELECT cluster_id, count(*) AS size, md5(string_agg('customers/' || member_key, '|' ORDER BY CAST(member_key AS VARCHAR))) AS golden_key, md5(string_agg(CAST(member_key AS VARCHAR), '|' ORDER BY CAST(member_key AS VARCHAR))) AS source_cluster_hash FROM big GROUP BY 1)
SELECT golden_key, cluster_id, size, source_cluster_hash, c_name, c_mktsegment, balance FROM k LEFT JOIN w USING (cluster_id)""")
def golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.golden_records(members(spark, sf_dir), documents(spark, sf_dir), FIELDS, overrides={"c_name": "most_complete"}, collection="customers")
    return found.select("golden_key", "cluster_id", "size", "source_cluster_hash", *FIELDS)


@query(f"""WITH {_MEM}, k AS (SELECT cluster_id, count(*) AS n FROM big GROUP BY 1), a AS (SELECT cluster_id, min(member_key) AS gone FROM big GROUP BY 1) SELECT count(*) AS records, count(*) FILTER (gone % 2 = 0) AS stale FROM k JOIN a USING (cluster_id)""")
def golden_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters whose first key is even lose that member; their records are stale."""
    m = members(spark, sf_dir)
    first = m.groupBy("cluster_id").agg(F.min("member_key").alias("member_key")).filter("member_key % 2 = 0")
    now = m.join(first, ["cluster_id", "member_key"], "left_anti")
    golden = fusion.golden_records(m, documents(spark, sf_dir), ["c_mktsegment"])
    return fusion.mark_stale(golden, now).agg(F.count("*").alias("records"), F.count_if("stale").alias("stale"))


@query(f"""WITH {_MEM}, s AS (SELECT cluster_id, member_key, nullif(trim(c_name), '') AS c_name, c_mktsegment, balance FROM big JOIN doc USING (member_key)),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY (CAST(c_name IS NOT NULL AS INTEGER) + CAST(c_mktsegment IS NOT NULL AS INTEGER) + CAST(balance IS NOT NULL AS INTEGER)) DESC, member_key) AS r FROM s)
SELECT cluster_id, max(member_key) FILTER (r = 1) AS canonical_key, coalesce(max(c_name) FILTER (r = 1), arg_min(c_name, member_key) FILTER (c_name IS NOT NULL)) AS c_name, coalesce(max(c_mktsegment) FILTER (r = 1), arg_min(c_mktsegment, member_key) FILTER (c_mktsegment IS NOT NULL)) AS c_mktsegment,
coalesce(max(balance) FILTER (r = 1), arg_min(balance, member_key) FILTER (balance IS NOT NULL)) AS balance FROM o GROUP BY cluster_id""")
def merge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.merge_preview(members(spark, sf_dir), documents(spark, sf_dir), FIELDS)


@query(f"""WITH {_VAL}, q AS (SELECT *, round(CASE WHEN field = 'balance' THEN CASE WHEN regexp_matches(trim(value), '^[0-9]{{5}}(-[0-9]{{4}})?$') THEN 1.0 ELSE 0.3 END ELSE 0.5 + least(0.5, length(trim(value)) / 40) END, 4) AS q FROM cnt),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, field ORDER BY q DESC, n DESC, first) AS r FROM q) WHERE r = 1)
SELECT c.cluster_id, max(value) FILTER (field = 'c_name') AS c_name, max(value) FILTER (field = 'balance') AS balance FROM (SELECT DISTINCT cluster_id FROM big) c LEFT JOIN b USING (cluster_id) GROUP BY 1""")
def golden_best_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.best_quality(members(spark, sf_dir), documents(spark, sf_dir), {"c_name": "name", "balance": "zip_code"})


@query(f"""WITH {_VAL}, {_PICK}, w AS (SELECT c.cluster_id, max(value) FILTER (field = 'c_name') AS a, max(value) FILTER (field = 'c_mktsegment') AS b, max(value) FILTER (field = 'balance') AS d FROM (SELECT DISTINCT cluster_id FROM big) c LEFT JOIN vote USING (cluster_id) GROUP BY 1),
x AS (SELECT round((CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER) + CAST(d IS NOT NULL AS INTEGER)) / 3, 4) AS s, d IS NOT NULL AS v FROM w)
SELECT count(*) AS records, round(avg(s), 4) AS avg_score, round(min(s), 4) AS min_score, round(max(s), 4) AS max_score, count(*) FILTER (s >= 0.8) AS high_count, count(*) FILTER (v) AS valid FROM x""")
def golden_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = fusion.validate_records(fusion.golden_records(members(spark, sf_dir), documents(spark, sf_dir), FIELDS), ["balance"], FIELDS)
    return fusion.statistics(checked).join(F.broadcast(checked.agg(F.count_if("is_valid").alias("valid"))))


_STREET = "CAST(c_custkey % 60 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN ' N. Main St.' WHEN c_custkey % 3 = 0 THEN ' north main street, Apt 4' ELSE ' Main  Ave' END"
_ZIP = "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(60000 + c_nationkey AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN '-1234' ELSE '' END END"
_SIG = f"""src AS (SELECT c_custkey AS k, c_mktsegment AS origin, {_STREET} AS street, {_ZIP} AS zip FROM customer),
n AS (SELECT *, CAST(k % 60 AS VARCHAR) || CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN ' NORTH MAIN STREET' ELSE ' MAIN AVENUE' END AS n_street, coalesce(substring(zip, 1, 5), '') AS n_zip FROM src)"""
_NORMAL = {"street": text.street, "zip": text.postal}


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("origin"), F.expr(_STREET.replace('VARCHAR', 'STRING')).alias("street"), F.expr(_ZIP.replace('VARCHAR', 'STRING')).alias("zip"))


@query(f"""WITH {_SIG} SELECT substring(sha256(n_street || '|' || n_zip), 1, 16) AS signature, n_street, n_zip, min(k) AS first_key, arg_min(street, k) AS street, count(*) AS row_count, count(DISTINCT origin) AS in_degree, count(DISTINCT origin) >= 4 AS is_hub FROM n GROUP BY n_street, n_zip""")
def canonical_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canonical.canonical(_addresses(spark, sf_dir), _NORMAL, "k", "origin", hub_at=4)
    return found.select("signature", "n_street", "n_zip", "first_key", "street", "row_count", "in_degree", "is_hub")


@query(f"""WITH {_SIG}, c AS (SELECT substring(sha256(n_street || '|' || n_zip), 1, 16) AS signature, street || '|' || coalesce(zip, '') AS variant, count(*) AS n, min(k) AS f FROM n GROUP BY ALL)
SELECT signature, variant, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY n DESC, f) AS r FROM c) WHERE r <= 2""")
def canonical_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.variants(_addresses(spark, sf_dir), _NORMAL, "k", 2)


@query(f"""WITH {_SIG}, a AS (SELECT k, upper(trim(regexp_replace(regexp_replace(upper(street), '[^A-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))) || '|' || coalesce(substring(regexp_replace(zip, '[^A-Z0-9\\s]', '', 'g'), 1, 5), '') AS address_key FROM n),
s AS (SELECT address_key, count(*) AS size FROM a GROUP BY 1 HAVING count(*) >= 2) SELECT k AS _key, address_key, size FROM a JOIN s USING (address_key) WHERE size <= 50""")
def address_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(text.address_key(F.col("street"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("zip")), r"\|")
    return canonical.address_blocks(_addresses(spark, sf_dir), F.concat_ws("|", parts[0], parts[3]), "k")[0]


_VER = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'match' WHEN event_id % 3 = 1 THEN 'no_match' ELSE 'needs_review' END AS decision, CASE WHEN event_id % 2 = 0 THEN 'llm' ELSE 'human' END AS source, round((event_id % 100) / 100.0, 2) AS score, round((user_id % 10) / 10.0, 2) AS confidence, CAST(user_id AS VARCHAR) AS pair_key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e,
        F.when(e % 3 == 0, "match").when(e % 3 == 1, "no_match").otherwise("needs_review").alias("decision"),
        F.when(e % 2 == 0, "llm").otherwise("human").alias("source"),
        F.round((e % 100) / 100.0, 2).alias("score"),
        F.round((F.col("user_id") % 10) / 10.0, 2).alias("confidence"),
        F.col("user_id").cast("string").alias("pair_key"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


@query(f"WITH v AS ({_VER}) SELECT decision, count(*) AS n, round(avg(score), 4) AS avg_score, round(avg(confidence), 4) AS avg_confidence FROM v GROUP BY 1")
def verdict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.statistics(verdicts(spark, sf_dir))


@query(f"WITH v AS ({_VER}) SELECT event_id, decision, score, pair_key FROM v WHERE decision = 'match' AND score BETWEEN 0.3 AND 0.6 ORDER BY score DESC, pair_key, event_id LIMIT 25 OFFSET 5")
def verdict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir)
    page, _ = feedback.query(v.withColumn("pair_key", F.concat_ws(":", F.lpad("pair_key", 12, "0"), F.lpad(F.col("event_id").cast("string"), 12, "0"))), "match", scores=(0.3, 0.6), sort="score", offset=0, limit=None)
    ordered = page.withColumn("pair_key", F.regexp_replace(F.substring_index("pair_key", ":", 1), "^0+(?=.)", ""))
    return ordered.orderBy(F.desc("score"), "pair_key", "event_id").offset(5).limit(25).select("event_id", "decision", "score", "pair_key")


@query(f"WITH v AS ({_VER}) SELECT count(DISTINCT pair_key) AS pending FROM v WHERE source = 'llm' AND decision = 'needs_review' AND pair_key NOT IN (SELECT pair_key FROM v WHERE source = 'human')")
def pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.pending_reviews(verdicts(spark, sf_dir))


@query(f"WITH v AS ({_VER}) SELECT event_id, decision FROM v WHERE source = 'human' ORDER BY created_at DESC, event_id LIMIT 20")
def audit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdicts(spark, sf_dir).select("event_id", "decision", "source", "created_at")
    return feedback.history(rows, "source", "human", limit=20, time="created_at").select("event_id", "decision")
