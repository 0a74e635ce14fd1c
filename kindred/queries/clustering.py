"""Edges, components, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, components, edges, relations
from ..operators.tables import keep
from ..plans import pipeline
from .registry import query, table
from .scores import PART_SCORED, part_scored

STAMP = "2024-01-01T00:00:00"
EDGES = f"""{PART_SCORED}, ed AS (SELECT md5(least(CAST(doc1_key AS VARCHAR), CAST(doc2_key AS VARCHAR)) || '->' || greatest(CAST(doc1_key AS VARCHAR), CAST(doc2_key AS VARCHAR))) AS edge_key,
  least(CAST(doc1_key AS VARCHAR), CAST(doc2_key AS VARCHAR)) AS src, greatest(CAST(doc1_key AS VARCHAR), CAST(doc2_key AS VARCHAR)) AS dst, score AS similarity FROM scored WHERE score >= 0.8)"""
MEMBERS = f"""{EDGES}, both_ AS (SELECT src AS u, dst AS v FROM ed UNION SELECT dst, src FROM ed), reach AS (SELECT u AS node, u AS other FROM both_ UNION SELECT r.node, b.v FROM reach r JOIN both_ b ON b.u = r.other),
lab AS (SELECT node AS member_key, min(other) AS cluster_id FROM reach GROUP BY node), mem AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS size FROM lab)"""
QUALITY = f"""{MEMBERS}, ins AS (SELECT a.cluster_id, src, dst, similarity FROM ed JOIN mem a ON a.member_key = src JOIN mem b ON b.member_key = dst AND a.cluster_id = b.cluster_id),
agg AS (SELECT cluster_id, count(*) AS edge_count, round(avg(similarity), 4) AS average_similarity, round(min(similarity), 4) AS min_similarity, round(max(similarity), 4) AS max_similarity FROM ins GROUP BY ALL),
sz AS (SELECT cluster_id, count(*) AS size FROM mem GROUP BY ALL), q0 AS (SELECT cluster_id, size, edge_count, average_similarity, min_similarity, max_similarity, round(edge_count / (size * (size - 1) / 2), 4) AS density FROM sz JOIN agg USING (cluster_id)),
q AS (SELECT *, round(least(1.0, 0.4 * density + 0.6 * average_similarity), 4) AS quality_score FROM q0)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept: components, quality and checks all read them."""
    return keep(edges.make_edges(part_scored(spark, sf_dir, 0.8), "levenshtein", STAMP), "edges")


def part_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.clusters(components.components(part_edges(spark, sf_dir)))


def part_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part_edges(spark, sf_dir)
    return clusters.quality(components.clusters(components.components(e)), e)


@query(f"WITH {EDGES} SELECT edge_key, src, dst, similarity, 'levenshtein' AS method, '{STAMP}' AS ts, false AS suppressed, false AS confirmed FROM ed")
def edge_keys_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges inserted twice, in either direction, are there once."""
    found = part_scored(spark, sf_dir, 0.8)
    turned = found.select(F.col("doc2_key").alias("doc1_key"), F.col("doc1_key").alias("doc2_key"), "score")
    first = edges.make_edges(found, "levenshtein", STAMP)
    return edges.insert_edges(first, edges.make_edges(found.union(turned), "again", STAMP))


@query(f"WITH {PART_SCORED} SELECT count(*) AS total_edges, 0::BIGINT AS missing_score, count(*) FILTER (score < 0.75) AS below_threshold, 0::BIGINT AS self_loops FROM scored WHERE score >= 0.5")
def edge_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.edge_defects(edges.make_edges(part_scored(spark, sf_dir, 0.5), "x", STAMP))


@query(f"WITH {PART_SCORED} SELECT round(floor(score / 0.05 + 1e-7) * 0.05, 4) AS bucket, count(*) AS edges, round(avg(score), 4) AS avg_confidence FROM scored WHERE score >= 0.5 GROUP BY 1")
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.confidence_buckets(edges.make_edges(part_scored(spark, sf_dir, 0.5), "x", STAMP))


@query(f"""WITH {EDGES} SELECT edge_key, similarity, CAST(src AS BIGINT) % 3 = 0 AS suppressed, CAST(src AS BIGINT) % 3 = 1 AS confirmed FROM ed""")
def apply_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part_edges(spark, sf_dir)
    n = F.col("src").cast("long") % 3
    said = e.filter(n < 2).select(F.col("dst").alias("key1"), F.col("src").alias("key2"), F.when(n == 0, "no_match").otherwise("match").alias("decision"), F.lit("2024-02-01").alias("created_at"))
    early = said.withColumns({"decision": F.lit("match"), "created_at": F.lit("2024-01-15")})
    return edges.apply_verdicts(e, said.union(early)).select("edge_key", "similarity", "suppressed", "confirmed")


@query("""WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders ORDER BY d DESC LIMIT 30) SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT min(d) FROM t)""")
def keep_last_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return edges.keep_last(rows, 30, "d").select("o_orderkey")


@query(f"WITH {EDGES} SELECT src, dst FROM ed WHERE NOT (similarity < 0.9)")
def clear_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part_edges(spark, sf_dir).withColumn("method", F.when(F.col("similarity") < 0.9, "weak").otherwise("strong"))
    return edges.clear_edges(e, "weak", "2024-06-01").select("src", "dst")


@query(f"WITH RECURSIVE {MEMBERS} SELECT cluster_id, member_key, size FROM mem")
def wcc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_members(spark, sf_dir)


@query(f"WITH RECURSIVE {MEMBERS} SELECT cluster_id, member_key, size FROM mem")
def wcc_components_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by rounds of joins, as a graph too large for one task is solved."""
    return components.clusters(components.components(part_edges(spark, sf_dir), local_links=0))


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), f AS (SELECT k, CASE WHEN k % 50 <> 0 AND lag(k) OVER (ORDER BY k) = k - 1 THEN 0 ELSE 1 END AS first FROM o),
g AS (SELECT k, sum(first) OVER (ORDER BY k) AS g FROM f), r AS (SELECT k, min(k) OVER (PARTITION BY g) * 8 AS root FROM g),
n AS (SELECT k, k * 8 AS node FROM o UNION SELECT l_orderkey, l_orderkey * 8 + l_linenumber FROM lineitem) SELECT root, count(*) AS size FROM n JOIN r USING (k) GROUP BY root""")
def large_graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line linked to its order, every order to the one before it within fifty: the components, by rounds of joins.

    Their roots and sizes follow from the orders that are missing, so two components made one would show, as one made two.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = lines.select(F.col("l_orderkey").alias("k")).distinct()
    of_lines = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("src"), (F.col("l_orderkey") * 8).cast("long").alias("dst"))
    before = orders.select((F.col("k") + 1).alias("k")).join(orders, "k", "left_semi").filter("k % 50 != 0")
    links = of_lines.union(before.select((F.col("k") * 8).cast("long"), ((F.col("k") - 1) * 8).cast("long")))
    return components.components(links, local_links=0).groupBy("root").agg(F.count("*").alias("size"))


@query(f"WITH RECURSIVE {QUALITY} SELECT * FROM q")
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_quality(spark, sf_dir)


@query(f"""WITH RECURSIVE {QUALITY} SELECT cluster_id, round(least(1.0, CASE WHEN size >= 2 THEN 1.0 ELSE 0.5 END * CASE WHEN size > 20 THEN 0.8 ELSE 1.0 END * 0.3 + CASE WHEN density >= 0.3 THEN density ELSE density * 0.5 END * 0.4 + average_similarity * 0.3), 4) AS size_penalised_score FROM q""")
def cluster_size_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.size_penalised_quality(part_quality(spark, sf_dir)).select("cluster_id", "size_penalised_score")


@query(f"WITH RECURSIVE {QUALITY} SELECT CASE WHEN size <= 2 THEN '2' WHEN size <= 5 THEN '3-5' WHEN size <= 10 THEN '6-10' WHEN size <= 50 THEN '11-50' ELSE '51+' END AS size_class, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS members FROM q GROUP BY 1")
def cluster_size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.size_histogram(part_quality(spark, sf_dir), "evaluation")


@query(f"""WITH RECURSIVE {QUALITY}, v AS (SELECT *, (CAST(size BETWEEN 2 AND 100 AS INTEGER) + CAST(density >= 0.3 AS INTEGER) + CAST(average_similarity >= 0.9 AS INTEGER) + CAST(round(max_similarity - min_similarity, 4) <= 0.1 AS INTEGER)) / 4 AS s FROM q)
SELECT cluster_id, s AS validation_score, s >= 0.6 AS is_valid FROM v""")
def cluster_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.validate(part_quality(spark, sf_dir), similarity=0.9, spread=0.1).select("cluster_id", "validation_score", "is_valid")


@query(f"""WITH RECURSIVE {QUALITY}, v AS (SELECT (CAST(size BETWEEN 2 AND 100 AS INTEGER) + CAST(density >= 0.3 AS INTEGER) + CAST(average_similarity >= 0.9 AS INTEGER) + CAST(round(max_similarity - min_similarity, 4) <= 0.1 AS INTEGER)) / 4 AS s FROM q)
SELECT count(*) AS total_clusters, count(*) FILTER (s >= 0.6) AS valid_clusters, round(avg(s), 4) AS average_quality_score, round(count(*) FILTER (s >= 0.6) / count(*), 4) AS validation_rate FROM v""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.validation_summary(clusters.validate(part_quality(spark, sf_dir), similarity=0.9, spread=0.1))


@query(f"WITH RECURSIVE {QUALITY} SELECT cluster_id, density, min_similarity < 0.5 * average_similarity AND density < 1 AS is_bridge, average_similarity < 0.9 AS low_coherence FROM q")
def cluster_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part_edges(spark, sf_dir)
    return clusters.coherence(components.clusters(components.components(e)), e, 0.9).select("cluster_id", "density", "is_bridge", "low_coherence")


@query(f"WITH RECURSIVE {QUALITY} SELECT cluster_id, size, quality_score FROM q ORDER BY size DESC, cluster_id LIMIT 10 OFFSET 2")
def cluster_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.listing(part_quality(spark, sf_dir), offset=2, limit=10).select("cluster_id", "size", "quality_score")


@query(f"WITH RECURSIVE {MEMBERS} SELECT count(DISTINCT cluster_id) AS clusters, 0::BIGINT AS too_small, 0::BIGINT AS overlapping_members, 0::BIGINT AS crossing_edges FROM mem")
def cluster_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part_edges(spark, sf_dir)
    return clusters.structural_check(components.clusters(components.components(e)), e)


@query(f"WITH RECURSIVE {MEMBERS} SELECT a.cluster_id, count(*) AS edges FROM ed JOIN mem a ON a.member_key = src JOIN mem b ON b.member_key = dst WHERE a.cluster_id = b.cluster_id GROUP BY ALL")
def cluster_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part_edges(spark, sf_dir)
    return clusters.graph(components.clusters(components.components(e)), e).groupBy("cluster_id").agg(F.count("*").alias("edges"))


@query(f"WITH RECURSIVE {MEMBERS} SELECT cluster_id, size, 'c_' || substring(md5(string_agg(member_key, '|' ORDER BY member_key)), 1, 24) AS cluster_key FROM mem GROUP BY ALL")
def cluster_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.cluster_documents(part_members(spark, sf_dir)).select("cluster_id", "size", "cluster_key")


@query()
def cluster_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part_edges(spark, sf_dir)
    return clusters.repair(components.clusters(components.components(e)), e, 0.9)


@query(f"""WITH RECURSIVE {MEMBERS}, ins AS (SELECT a.cluster_id, src, dst, similarity FROM ed JOIN mem a ON a.member_key = src JOIN mem b ON b.member_key = dst WHERE CAST(a.cluster_id AS BIGINT) % 3 = 0),
cut AS (SELECT src, dst FROM ins QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY similarity, src, dst) = 1), left_ AS (SELECT src, dst FROM ed ANTI JOIN cut USING (src, dst)),
both2 AS (SELECT src AS u, dst AS v FROM left_ UNION SELECT dst, src FROM left_), reach2 AS (SELECT u AS node, u AS other FROM both2 UNION SELECT r.node, b.v FROM reach2 r JOIN both2 b ON b.u = r.other),
lab2 AS (SELECT node AS member_key, min(other) AS cluster_id FROM reach2 GROUP BY node) SELECT cluster_id, member_key, count(*) OVER (PARTITION BY cluster_id) AS size FROM lab2""")
def recluster_after_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weakest edge of every third cluster is cut; only the clusters touched are found anew."""
    e = part_edges(spark, sf_dir)
    old = keep(components.clusters(components.components(e)), "old")
    cut = clusters.intra_edges(old, e).groupBy("cluster_id").agg(F.min_by(F.struct("src", "dst"), F.struct("similarity", "src", "dst")).alias("x")).filter(F.col("cluster_id").cast("long") % 3 == 0)
    said = cut.select(F.col("x.src").alias("key1"), F.col("x.dst").alias("key2"), F.lit("no_match").alias("decision"), F.lit(STAMP).alias("created_at"))
    new = keep(edges.apply_verdicts(e, said), "judged")
    touched = said.select(F.col("key1").alias("member_key")).union(said.select("key2")).distinct()
    return clusters.recluster(new, old, touched)


@query("""WITH m AS (SELECT p_partkey AS e, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS g FROM part), r AS (SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS type, l_quantity AS c, l_linestatus AS o FROM lineitem),
v AS (SELECT coalesce(a.g, src) AS src, 1000000 + dst AS dst, type, c, o FROM r LEFT JOIN m a ON a.e = src)
SELECT src, dst, type, count(*) AS n, max(c) AS confidence, string_agg(DISTINCT o, ',' ORDER BY o) AS provenance FROM v WHERE src <> dst GROUP BY ALL""")
def relationship_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    firsts = parts.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("golden"))
    mapping = parts.join(firsts, ["p_name", "p_brand"]).select(F.col("p_partkey").alias("entity"), "golden")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("confidence"), F.col("l_linestatus").alias("origin"))
    return relations.rewire(rows, mapping, ends=("src",)).withColumn("provenance", F.array_join("provenance", ","))


@query("""WITH RECURSIVE m AS (SELECT p_partkey AS e, CASE WHEN p_partkey % 10 = 0 THEN p_partkey - 9 WHEN p_partkey % 50 = 1 THEN p_partkey + 1 WHEN p_partkey % 50 = 2 THEN p_partkey - 1 ELSE p_partkey - p_partkey % 10 END AS g FROM part WHERE p_partkey % 7 <> 3),
w AS (SELECT e, g AS f, 1 AS h FROM m UNION ALL SELECT w.e, m.g, h + 1 FROM w JOIN m ON m.e = w.f WHERE h < 120),
t AS (SELECT e, max(h) AS h, max_by(f, h) AS f FROM w GROUP BY e)
SELECT e AS entity, CASE WHEN h < 100 THEN f END AS final, CASE WHEN h >= 100 THEN 'cycle' ELSE 'ok' END AS status FROM t""")
def mapping_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    target = F.when(p % 10 == 0, p - 9).when(p % 50 == 1, p + 1).when(p % 50 == 2, p - 1).otherwise(p - p % 10)
    mapping = table(spark, sf_dir, "part").filter(p % 7 != 3).select(p.alias("entity"), target.alias("golden"))
    return relations.resolve_chains(mapping).select("entity", "final", "status")


@query()
def node_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    walks = relations.random_walks(part_edges(spark, sf_dir), 6, 3)
    return relations.node_embeddings(walks, 16)


@query("""WITH RECURSIVE p AS (SELECT *, upper(trim(p_name)) AS n FROM part), s1 AS (SELECT *, count(*) OVER (PARTITION BY p_name, p_brand, p_type) AS c FROM p),
e1 AS (SELECT a.p_partkey AS k1, b.p_partkey AS k2 FROM s1 a JOIN s1 b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey WHERE a.c BETWEEN 2 AND 100),
l AS (SELECT * FROM p WHERE p_partkey NOT IN (SELECT k1 FROM e1 UNION SELECT k2 FROM e1)), s2 AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type) AS c FROM l),
e2 AS (SELECT a.p_partkey AS k1, b.p_partkey AS k2 FROM s2 a JOIN s2 b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey
  WHERE a.c BETWEEN 2 AND 1000 AND round(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)), 4) >= 0.8),
ed AS (SELECT CAST(k1 AS VARCHAR) AS k1, CAST(k2 AS VARCHAR) AS k2 FROM (SELECT * FROM e1 UNION SELECT * FROM e2)), both_ AS (SELECT k1 AS u, k2 AS v FROM ed UNION SELECT k2, k1 FROM ed),
reach AS (SELECT u AS node, u AS other FROM both_ UNION SELECT r.node, b.v FROM reach r JOIN both_ b ON b.u = r.other), lab AS (SELECT node AS member_key, min(other) AS cluster_id FROM reach GROUP BY node)
SELECT cluster_id, member_key, count(*) OVER (PARTITION BY cluster_id) AS size FROM lab""")
def multi_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal names first, then similar ones among what is left."""
    from ..operators import scoring

    name = [scoring.Field("p_name", 1.0, "levenshtein")]
    stages = [pipeline.Stage("exact", ["p_name", "p_brand", "p_type"], name, 1.0), pipeline.Stage("near", ["p_brand", "p_type"], name, 0.8, most_block=1000)]
    return pipeline.run_staged(table(spark, sf_dir, "part"), stages, "p_partkey", STAMP)[1]


@query(f"WITH RECURSIVE {MEMBERS} SELECT (SELECT count(*) FROM part) AS documents, (SELECT count(*) FROM ed) AS edges, (SELECT count(DISTINCT cluster_id) FROM mem) AS clusters")
def pipeline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = pipeline.Config(["p_brand", "p_type"], [("p_name", 1.0, "levenshtein")], "p_partkey", 0.8, 1000)
    docs = table(spark, sf_dir, "part")
    found = pipeline.run(docs, config, STAMP)
    return pipeline.status(docs, found.edges, found.members)
