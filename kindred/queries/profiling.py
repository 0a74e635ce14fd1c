"""Profiles, strings, learnt thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, numbers, text
from ..operators import advisor, learning, profile
from ..plans import pipeline
from .records import _VER, verdicts
from .registry import query, table

COLUMNS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_LONG = "u AS (SELECT field, value FROM part, LATERAL (VALUES ('p_name', p_name), ('p_brand', p_brand), ('p_type', CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_type END)) f(field, value))"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_size") % 9 != 0, F.col("p_type")))


@query(f"WITH {_LONG} SELECT field, count(*) AS total, count(*) - count(value) AS nulls, round(100 * (count(*) - count(value)) / count(*), 2) AS null_percent, count(DISTINCT value) AS distinct_values, round(count(value) / count(*), 4) AS completeness FROM u GROUP BY 1")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.data_quality(_parts(spark, sf_dir), ["p_name", "p_brand", "p_type"])


@query(f"""WITH {_LONG}, b AS (SELECT field, count(*) AS n, count(value) AS f, round(avg(len(list_filter(string_split_regex(trim(value), '\\s+'), lambda x: x <> ''))), 4) AS avg_tokens, round(avg(length(value)), 4) AS avg_chars FROM u GROUP BY 1),
c AS (SELECT field, lower(trim(value)) AS s, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL), d AS (SELECT field, count(*) AS distinct_count FROM c GROUP BY 1),
h AS (SELECT c.field, s, c.n / b.f AS p, row_number() OVER (PARTITION BY c.field ORDER BY c.n DESC, s) AS r FROM c JOIN b USING (field)),
e AS (SELECT field, string_agg(s, ',' ORDER BY r) AS heavy_hitters, round(-sum(p * log2(p)) / log2(count(*)), 4) AS entropy FROM h WHERE r <= 5 GROUP BY 1)
SELECT field, round(1 - f / n, 4) AS null_rate, distinct_count, heavy_hitters, entropy, avg_tokens, avg_chars FROM b JOIN d USING (field) JOIN e USING (field)""")
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.field_profile(_parts(spark, sf_dir), ["p_name", "p_brand", "p_type"]).withColumn("heavy_hitters", F.array_join("heavy_hitters", ","))


@query("""WITH s AS (SELECT lower(trim(p_name)) || '|' || lower(trim(p_brand)) AS s, count(*) AS n FROM part GROUP BY 1)
SELECT round(coalesce(sum(n - 1) FILTER (n > 1), 0) / sum(n), 4) AS duplicate_rate, round(max(n) / sum(n), 4) AS hub_risk FROM s""")
def pairwise_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.pairwise_signals(table(spark, sf_dir, "part"), "p_name", "p_brand")


@query("""WITH u AS (SELECT field, trim(value) AS v FROM (SELECT 'c_name' AS field, c_name AS value FROM customer UNION ALL SELECT 'mail', lower(replace(c_name, '#', '.')) || '@example.com' FROM customer UNION ALL SELECT 'phone', '+1 ' || CAST(5550000 + c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'address', CAST(c_custkey AS VARCHAR) || ' Main St' FROM customer) WHERE trim(value) <> '')
SELECT field, count(*) AS n, round(count(DISTINCT v) / count(*), 4) AS cardinality, round(avg(len(string_split_regex(v, '\\s+'))), 4) AS avg_tokens, round(avg(length(v)), 4) AS avg_length,
CASE field WHEN 'mail' THEN 'email' WHEN 'phone' THEN 'phone' WHEN 'address' THEN 'address' ELSE 'id' END AS semantic_type FROM u GROUP BY 1""")
def semantic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_name")
    rows = table(spark, sf_dir, "customer").select("c_name", F.concat(F.lower(F.replace(c, F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("mail"), F.concat(F.lit("+1 "), (5550000 + F.col("c_custkey")).cast("string")).alias("phone"), F.concat(F.col("c_custkey").cast("string"), F.lit(" Main St")).alias("address"))
    return profile.semantic_type(profile.type_shares(rows, rows.columns)).select("field", "n", "cardinality", "avg_tokens", "avg_length", "semantic_type")


@query("""WITH u AS (SELECT 'p_brand' AS field, upper(trim(p_brand)) AS value FROM part UNION ALL SELECT 'p_name', upper(trim(p_name)) FROM part), c AS (SELECT field, value, count(*) AS n FROM u WHERE value <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r, sum(n) OVER (PARTITION BY field) AS t FROM c) SELECT field, value, n, round(n / t, 6) AS frequency FROM r WHERE r <= 10""")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.term_frequencies(table(spark, sf_dir, "part"), ["p_brand", "p_name"], 10)


@query("""SELECT 'c_name' AS field, 'string' AS type, count(*) AS rows, count(c_name) AS filled FROM customer UNION ALL SELECT 'c_acctbal', 'double', count(*), count(c_acctbal) FROM customer""")
def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"]).select("field", "type", "rows", "filled")


@query("SELECT 'part' AS name, count(*) AS rows FROM part UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def collection_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.catalogue({n: table(spark, sf_dir, n) for n in ("part", "customer", "orders")})


@query("""SELECT p_partkey, p_name || ' | ' || p_name || ' | ' || p_brand || ' | ' || CAST(p_size AS VARCHAR) AS text FROM part""")
def serializer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.serialise(["p_name", "p_brand", "p_size"], weights={"p_name": 0.6, "p_brand": 0.3, "p_size": 0.3}).alias("text"))


@query("""WITH s AS (SELECT c_custkey, upper(trim(c_mktsegment)) AS u, regexp_replace(c_name, '[^0-9]', '', 'g') AS d FROM customer)
SELECT c_custkey, u, d AS digits, CASE WHEN length(d) = 10 THEN '+1' ELSE '+' END || d AS e164 FROM s""")
def normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalise(F.col("c_mktsegment")).alias("u"), text.normalise(name, ("digits_only",)).alias("digits"), text.e164(name).alias("e164"))


_SOUNDEX_SQL = """WITH RECURSIVE n AS (SELECT n_nationkey AS k, upper(trim(n_name)) AS s FROM nation), r AS (SELECT k, s, 2 AS i, substring(s, 1, 1) AS out FROM n
UNION ALL SELECT k, s, i + 1, CASE WHEN c = '0' OR right(out, 1) = c THEN out ELSE out || c END FROM (SELECT k, s, i, out, translate(CASE WHEN regexp_matches(substring(s, i, 1), '[A-Z]') THEN substring(s, i, 1) ELSE 'A' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') AS c FROM r WHERE i <= length(s)))
SELECT k AS n_nationkey, substring(arg_max(out, i) || '000', 1, 4) AS code FROM r GROUP BY k"""


@query(_SOUNDEX_SQL)
def library_soundex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", text.soundex(F.col("n_name")).alias("code"))


@query()
def phonetic_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", *(names.phonetic(k, n).alias(k) for k in ("metaphone", "nysiis", "match_rating")))


@query("""WITH s AS (SELECT c_custkey, lower(replace(c_name, '#', '@')) || '.com' AS mail, CAST(2125550000 + c_custkey AS VARCHAR) AS phone, CASE WHEN c_custkey % 2 = 0 THEN '62701' ELSE '6270' END AS zip FROM customer)
SELECT c_custkey, regexp_matches(mail, '^[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}$') AS mail_ok, length(phone) IN (10, 11) AS phone_ok, regexp_matches(zip, '^[0-9]{5}(-[0-9]{4})?$') AS zip_ok, array_to_string([mail, split_part(mail, '@', 2)], ',') AS features FROM s""")
def field_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("@"))), F.lit(".com")).alias("mail"), (F.lit(2125550000) + k).cast("string").alias("phone"), F.when(k % 2 == 0, "62701").otherwise("6270").alias("zip"))
    return rows.select("c_custkey", text.valid("email", F.col("mail")).alias("mail_ok"), text.valid("phone", F.col("phone")).alias("phone_ok"), text.valid("zip_code", F.col("zip")).alias("zip_ok"), F.array_join(text.field_features("email", F.col("mail")), ",").alias("features"))


@query("""SELECT c_custkey, 'customers/' || c_custkey AS vertex, CAST(c_custkey AS VARCHAR) AS vertex_key, 'masked_' || substring(md5(c_name), 1, 10) AS masked, substring(sha256(c_name), 1, 16) AS digest FROM customer""")
def keys_and_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertex = text.vertex_id("customers", F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", vertex.alias("vertex"), text.vertex_key(vertex).alias("vertex_key"), text.mask(F.col("c_name")).alias("masked"), text.digest16(F.col("c_name")).alias("digest"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's date written in one of four ways and read back."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/MM/dd")).when(k == 2, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.parse_date(shown).alias("day"))


@query("""WITH r AS (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WHERE c_acctbal IS NOT NULL) SELECT c_nationkey, c_acctbal AS quantile FROM r WHERE i = round_even(0.9 * (n - 1), 0)""")
def nearest_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers.nearest_quantile(table(spark, sf_dir, "customer"), "c_acctbal", 0.9, ["c_nationkey"])


@query(f"""WITH v AS ({_VER}), m AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM v WHERE decision = 'match'), x AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM v WHERE decision <> 'match'),
l AS (SELECT round(score, 3) AS low FROM m WHERE i = greatest(0, floor(n * 0.1) - 1)), t AS (SELECT score AS top FROM x WHERE i = least(n - 1, floor(n * 0.9)))
SELECT low AS low_threshold, round(least(0.95, greatest(round(top + 0.05, 3), low + 0.1)), 3) AS high_threshold, (SELECT count(*) FROM v) AS sample_count, true AS optimized FROM l, t""")
def threshold_optimiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.thresholds_by_rank(verdicts(spark, sf_dir))


@query("""WITH v AS (SELECT CAST(p_size % 5 AS VARCHAR) AS config_hash, p_partkey AS version, p_name AS body FROM part) SELECT config_hash, max(version) AS version, arg_max(body, version) AS body FROM v GROUP BY 1""")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 5).cast("string").alias("config_hash"), F.col("p_partkey").alias("version"), F.col("p_name").alias("body"))
    return learning.latest_versions(rows)


@query("""WITH a AS (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type), b AS (SELECT count(*) AS n FROM part GROUP BY p_name)
SELECT 'p_brand,p_type' AS fields, count(*) AS blocks, CAST(coalesce(sum(n * (n - 1) // 2) FILTER (n BETWEEN 2 AND 20), 0) AS BIGINT) AS pairs, max(n) AS largest FROM a
UNION ALL SELECT 'p_name', count(*), CAST(coalesce(sum(n * (n - 1) // 2) FILTER (n BETWEEN 2 AND 20), 0) AS BIGINT), max(n) FROM b""")
def measured_blocking_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advisor.measured_plan(table(spark, sf_dir, "part"), [["p_brand", "p_type"], ["p_name"]], 20).select("fields", "blocks", "pairs", "largest")


_PROFILE = f"""{_LONG}, b AS (SELECT field, count(*) AS n, count(value) AS f FROM u GROUP BY 1), c AS (SELECT field, lower(trim(value)) AS s, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL),
h AS (SELECT c.field, c.n / b.f AS p, row_number() OVER (PARTITION BY c.field ORDER BY c.n DESC, s) AS r FROM c JOIN b USING (field)),
e AS (SELECT field, CASE WHEN count(*) > 1 THEN round(-sum(p * log2(p)) / log2(count(*)), 4) ELSE 0 END AS entropy FROM h WHERE r <= 5 GROUP BY 1),
fp AS (SELECT field, round(1 - f / n, 4) AS nulls, entropy FROM b JOIN e USING (field)),
sg AS (SELECT count(*) AS n FROM part GROUP BY lower(trim(p_name)) || '|' || lower(trim(p_brand))),
t AS (SELECT CAST(sum(n) AS BIGINT) AS rows, round(coalesce(sum(n - 1) FILTER (n > 1), 0) / sum(n), 4) AS dup, round(max(n) / sum(n), 4) AS hub FROM sg)"""


@query(f"""WITH {_PROFILE}, o AS (SELECT *, CASE field WHEN 'p_name' THEN 1 WHEN 'p_brand' THEN 2 ELSE 3 END AS i FROM fp),
k AS (SELECT field AS fields, 1 AS n, nulls AS sn, entropy AS se FROM o UNION ALL SELECT a.field || ',' || b.field, 2, a.nulls + b.nulls, a.entropy + b.entropy FROM o a JOIN o b ON a.i < b.i
  UNION ALL SELECT string_agg(field, ',' ORDER BY i), 3, sum(nulls), sum(entropy) FROM o)
SELECT fields, round(greatest(0, least(1, 0.55 * (1 - sn / n) + 0.3 * se / n + least(0.15, 0.05 * (n - 1)))), 4) AS score, CAST(floor(rows * rows * CASE n WHEN 1 THEN 0.02 WHEN 2 THEN 0.006 ELSE 0.002 END + 1e-6) AS BIGINT) AS candidate_pairs,
round(greatest(0, 0.95 - 0.07 * (n - 1)), 4) AS recall, round(least(0.99, 0.45 + 0.12 * (n - 1)), 4) AS precision, round(greatest(0, hub - least(0.5, 0.15 * (n - 1))), 4) AS hub_risk FROM k, t ORDER BY score DESC, string_split(fields, ',') LIMIT 5""")
def blocking_key_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = advisor.blocking_keys(advisor.dataset_profile(_parts(spark, sf_dir), ["p_name", "p_brand", "p_type"]), ["p_name", "p_brand", "p_type"])
    return spark.createDataFrame([(",".join(x["fields"]), x["score"], x["candidate_pairs"], x["recall"], x["precision"], x["hub_risk"]) for x in found], "fields string, score double, candidate_pairs long, recall double, precision double, hub_risk double")


#: Each strategy's fit to balanced priorities, its edge control, noise tolerance, precision and throughput, worked out by hand.
_FITS = """(VALUES ('hybrid_block_then_weighted_match', 0.85 * 0.24 + 0.76 * 0.20 + 0.82 * 0.18 + 0.78 * 0.14 + 0.73 * 0.14 + 0.84 * 0.10, 0.84, 0.64, 0.85, 0.82),
('pre_ingest_canonicalize_then_match', 0.88 * 0.24 + 0.68 * 0.20 + 0.91 * 0.18 + 0.84 * 0.14 + 0.80 * 0.14 + 0.94 * 0.10, 0.94, 0.56, 0.88, 0.91),
('deterministic_rules_then_review', 0.87 * 0.24 + 0.58 * 0.20 + 0.83 * 0.18 + 0.81 * 0.14 + 0.93 * 0.14 + 0.89 * 0.10, 0.89, 0.42, 0.87, 0.83),
('embedding_first_nearest_neighbor', 0.73 * 0.24 + 0.90 * 0.20 + 0.57 * 0.18 + 0.46 * 0.14 + 0.52 * 0.14 + 0.62 * 0.10, 0.62, 0.93, 0.73, 0.57),
('graph_first_collective_resolution', 0.81 * 0.24 + 0.86 * 0.20 + 0.50 * 0.18 + 0.48 * 0.14 + 0.59 * 0.14 + 0.50 * 0.10, 0.50, 0.76, 0.81, 0.50)) AS v(strategy, fit, edges, noise, precise, through)"""


@query(f"""WITH {_PROFILE}, a AS (SELECT avg(entropy) AS entropy, avg(nulls) AS nulls FROM fp)
SELECT strategy, round(fit + CASE WHEN dup >= 0.08 THEN 0.06 * edges ELSE 0 END + CASE WHEN hub >= 0.2 THEN 0.08 * edges - CASE WHEN strategy LIKE 'graph%' THEN 0.03 ELSE 0 END ELSE 0 END
  + CASE WHEN entropy < 0.45 THEN 0.05 * noise ELSE 0.03 * precise END - CASE WHEN nulls > 0.35 THEN 0.06 * precise + 0.04 * through ELSE 0 END + CASE WHEN rows >= 500000 THEN 0.05 * through ELSE 0 END, 4) AS score FROM {_FITS}, a, t""")
def strategy_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = advisor.strategies(advisor.dataset_profile(_parts(spark, sf_dir), ["p_name", "p_brand", "p_type"]))
    return spark.createDataFrame([(x["strategy"], x["score"]) for x in found], "strategy string, score double")


@query()
def record_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.encode_records(table(spark, sf_dir, "part"), ["p_name", "p_brand"], "p_partkey", 16)
