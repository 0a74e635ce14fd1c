"""Looking after what was found: lookups, removals, queues, loaders, dictionaries, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import advisor, clusters, edges, feedback, profile
from ..sources import readers, writers
from .clustering import MEMBERS, QUALITY, STAMP, part_edges, part_members, part_quality
from .registry import query, table


@query(f"WITH RECURSIVE {MEMBERS} SELECT cluster_id, member_key, size FROM mem WHERE cluster_id IN (SELECT cluster_id FROM mem WHERE CAST(member_key AS BIGINT) % 10 = 0)")
def clusters_by_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole clusters that some asked part is in."""
    asked = table(spark, sf_dir, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").cast("string").alias("member_key"))
    return clusters.by_member(part_members(spark, sf_dir), asked)


@query(f"""WITH RECURSIVE {MEMBERS}, g AS (SELECT cluster_id, max(member_key) AS key1 FROM mem GROUP BY 1), w AS (SELECT lag(member_key) OVER (PARTITION BY cluster_id ORDER BY member_key) AS key1, member_key AS key2 FROM mem)
SELECT key1, member_key AS key2, 'no_match' AS decision FROM g JOIN mem USING (cluster_id) WHERE key1 <> member_key UNION ALL SELECT key1, key2, 'match' FROM w WHERE key1 IS NOT NULL""")
def member_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last member of each cluster taken out of it, and the verdicts that would join each cluster in a chain."""
    members = part_members(spark, sf_dir)
    last = members.groupBy("cluster_id").agg(F.max("member_key").alias("member_key"))
    return edges.removal_verdicts(members, last, STAMP).union(edges.merge_verdicts(members, STAMP)).select("key1", "key2", "decision")


@query(f"""WITH RECURSIVE {QUALITY} SELECT cluster_id, average_similarity AS mean_score FROM q WHERE size % 2 = 0""")
def suspect_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending entries of clusters that exist; some are decided, some name clusters that are gone."""
    q = part_quality(spark, sf_dir)
    status = F.when(F.col("size") % 2 == 0, "pending").otherwise("done")
    queue = q.select("cluster_id", F.col("average_similarity").alias("mean_score"), status.alias("status"))
    gone = queue.withColumns({"cluster_id": F.concat(F.lit("gone"), F.col("cluster_id")), "status": F.lit("pending")})
    return feedback.suspects(queue.union(gone), q).select("cluster_id", "mean_score")


@query("""SELECT c_custkey, array_to_string(list_concat([s], CASE upper(trim(s)) WHEN 'BUILDING' THEN ['construction', 'house'] WHEN 'AUTOMOBILE' THEN ['car'] ELSE [] END), '|') AS names
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS s FROM customer)""")
def acronym_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    known = {"building": ["construction", "house"], "AUTOMOBILE": ["car"]}
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(text.expand_acronyms(shown, known), "|").alias("names"))


@query("""WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS t FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(t, CASE WHEN list_contains(t, 'red') THEN ['crimson', 'ruby'] ELSE [] END, CASE WHEN list_contains(t, 'bolt') THEN ['screw'] ELSE [] END))), ' ') AS tokens FROM t""")
def alias_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to block on, with the aliases of those that have some."""
    tokens = text.expand_aliases(text.gate_tokens(F.col("p_name")), {" Red": ["crimson", "Ruby"], "bolt": ["screw"]})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


@query("SELECT 25::BIGINT AS expected, count(*) AS actual, count(*) = 25 AS passes FROM nation UNION ALL SELECT 7, count(*), false FROM region UNION ALL SELECT 0, count(*), true FROM part")
def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [feedback.result_check(n, table(spark, sf_dir, t)) for n, t in ((25, "nation"), (7, "region"), (0, "part"))]
    return found[0].union(found[1]).union(found[2])


@query("""WITH v AS (SELECT f, b, t, e, g, CAST(e AS INTEGER) AS x, CAST(g AS INTEGER) AS y FROM (VALUES (1, 150, 0.82, false, false), (3, 50, 0.9, true, false), (5, 2000, 0.7, true, true)) v(f, b, t, e, g))
SELECT f AS fields, round(greatest(10.0, 90 + 42 * least(1.0, 160.0 / b) + 9 * f + 38 * x + 22 * y), 3) AS runtime_sec, round(greatest(64.0, 520 + 120 * f + 1.3 * b + 340 * x + 260 * y), 3) AS peak_memory_mb,
round(greatest(20.0, 260 + 35 * f + 0.35 * b + 190 * y + 55 * x), 3) AS storage_mb, round(least(0.99, 0.7 + (t - 0.7) * 0.62 + 0.015 * least(3, f) + 0.02 * y - 0.01 * x), 4) AS precision, round(least(0.99, 0.62 + (0.9 - t) * 0.55 - 0.01 * greatest(0, f - 2) + 0.09 * x + 0.07 * y), 4) AS recall FROM v""")
def variant_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, advisor.variant_metrics(n, b, t, e, g)) for n, b, t, e, g in ((1, 150, 0.82, False, False), (3, 50, 0.9, True, False), (5, 2000, 0.7, True, True))]
    return spark.createDataFrame([(n, *(float(m[k]) for k in ("runtime_sec", "peak_memory_mb", "storage_mb", "precision", "recall"))) for n, m in rows], "fields int, runtime_sec double, peak_memory_mb double, storage_mb double, precision double, recall double")


@query(f"WITH {MEMBERS.split(', both_ AS')[0]} SELECT src, dst FROM ed WHERE NOT (CAST(src AS BIGINT) % 2 = 0 AND similarity < 0.95)")
def inferred_edges_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred edges before a time are gone: here those of even sources, the weak ones being older."""
    ts = F.when(F.col("similarity") < 0.95, "2023-01-01").otherwise("2025-01-01")
    e = part_edges(spark, sf_dir).withColumns({"inferred": F.col("src").cast("long") % 2 == 0, "ts": ts})
    return edges.clear_inferred(e, "2024-01-01").select("src", "dst")


@query(f"""WITH {MEMBERS.split(', both_ AS')[0]}, s AS (SELECT least(src, dst) || '|' || greatest(src, dst) AS pair_id, similarity FROM ed WHERE CAST(src AS BIGINT) % 3 <> 0 AND similarity >= 0.85), t AS (SELECT DISTINCT least(CAST(p_partkey AS VARCHAR), CAST(p_partkey + 1 AS VARCHAR)) || '|' || greatest(CAST(p_partkey AS VARCHAR), CAST(p_partkey + 1 AS VARCHAR)) AS pair_id FROM part)
SELECT 'scored' AS kind, pair_id, similarity AS value FROM s UNION ALL SELECT 'truth', pair_id, 1.0 FROM t UNION ALL SELECT 'weight', src || '|' || dst, CASE WHEN CAST(dst AS BIGINT) % 2 = 0 THEN similarity ELSE 1.0 END FROM ed WHERE CAST(src AS BIGINT) % 3 <> 0""")
def loaded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evaluation, repair and embedding take from edges: scores, known matches, weights."""
    e = part_edges(spark, sf_dir).withColumns({"suppressed": F.col("src").cast("long") % 3 == 0, "confidence": F.when(F.col("dst").cast("long") % 2 == 0, F.col("similarity"))})
    key = F.col("p_partkey")
    known = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), key).alias("_from"), F.concat(F.lit("part/"), key + 1).alias("_to"))
    parts = [
        edges.scored_edges(e, 0.85).select(F.lit("scored").alias("kind"), "pair_id", F.col("score").alias("value")),
        edges.truth_pairs(known).select(F.lit("truth"), "pair_id", F.lit(1.0)),
        edges.weighted_edges(e).select(F.lit("weight"), text.pair_id(F.col("src"), F.col("dst")), "weight"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT least(count(*), 10) AS first, least(count(*), 25) AS random, least(count(*), 25) AS known FROM customer")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows as they come, and 25 by chance, all of them the table's own."""
    docs = table(spark, sf_dir, "customer")
    some = profile.sample(docs, 25, seed=7).select("c_custkey").distinct()
    known = readers.fetch(docs, some, "c_custkey")
    one = profile.sample(docs, 10).agg(F.count("*").alias("first"))
    return one.join(F.broadcast(some.agg(F.count("*").alias("random")))).join(F.broadcast(known.agg(F.count("*").alias("known"))))


@query("SELECT p_partkey, p_name AS name, p_size AS size FROM part")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in JSON, every second one in a code fence."""
    body = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    fenced = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))).otherwise(body)
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_answer(fenced, "name string, size int").alias("x")).select("p_partkey", "x.name", "x.size")


@query("SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN 2.0 ELSE CAST(embedding[1] AS DOUBLE) END, 5) AS first FROM embeddings")
def embeddings_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third vector is missing, and only those are taken from the new ones."""
    docs = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("embedding").cast("array<double>")).alias("embedding"))
    new = docs.select("vec_id", F.array_repeat(F.lit(2.0), 64).alias("vector"))
    return writers.with_embeddings(docs, new, "vec_id").select("vec_id", F.round(F.element_at("embedding", 1), 5).alias("first"))
