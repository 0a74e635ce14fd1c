"""Filters and candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, filters, relations, search, vectors
from ..streaming import incremental
from .registry import query, table

#: Blocks of brand and type, of up to 1000 parts.
MOST = 1000


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.Exact(["p_brand", "p_type"], "p_partkey", most=MOST).generate(table(spark, sf_dir, "part")).select("doc1_key", "doc2_key")


PART_PAIRS = f"""sized AS (SELECT p_brand, p_type FROM part GROUP BY ALL HAVING count(*) BETWEEN 2 AND {MOST}),
rows_ AS (SELECT p.* FROM part p JOIN sized s ON p.p_brand IS NOT DISTINCT FROM s.p_brand AND p.p_type IS NOT DISTINCT FROM s.p_type),
pairs AS (SELECT a.p_partkey AS doc1_key, b.p_partkey AS doc2_key FROM rows_ a JOIN rows_ b
  ON a.p_brand IS NOT DISTINCT FROM b.p_brand AND a.p_type IS NOT DISTINCT FROM b.p_type AND a.p_partkey < b.p_partkey)"""


@query("""WITH s AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS n FROM part)
SELECT a.p_partkey AS doc1_key, b.p_partkey AS doc2_key, a.p_brand AS brand, a.n AS block_size
FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE a.n BETWEEN 2 AND 100""")
def exact_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields: their blocks stay below the default size at every scale of the tables."""
    found = blocking.Exact(["p_brand", "p_type", "p_size"], "p_partkey").generate(table(spark, sf_dir, "part"))
    return found.select("doc1_key", "doc2_key", F.col("blocking_keys.p_brand").alias("brand"), "block_size")


@query("""WITH r AS (SELECT p_partkey, p_brand, p_size, p_partkey % 8 AS shard FROM part), s AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size, shard) AS n FROM r)
SELECT a.p_partkey AS doc1_key, b.p_partkey AS doc2_key, a.n AS block_size, a.shard AS shard FROM s a JOIN s b
ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.shard = b.shard AND a.p_partkey < b.p_partkey WHERE a.n BETWEEN 2 AND 100""")
def sharded_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of eight shards is blocked by itself, in one plan."""
    docs = table(spark, sf_dir, "part").withColumn("shard", F.col("p_partkey") % 8)
    found = blocking.Exact(["p_brand", "p_size"], "p_partkey", shard_key="shard").generate(docs)
    return found.select("doc1_key", "doc2_key", "block_size", F.col("blocking_keys.shard").alias("shard"))


@query("""WITH r AS (SELECT p_partkey, p_name, nullif(p_size % 3, 0) AS k, p_brand FROM part),
s AS (SELECT *, count(*) OVER (PARTITION BY p_name, p_brand, k) AS n FROM r)
SELECT a.p_partkey AS doc1_key, b.p_partkey AS doc2_key, a.n AS block_size FROM s a JOIN s b
ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.k IS NOT DISTINCT FROM b.k AND a.p_partkey < b.p_partkey WHERE a.n BETWEEN 2 AND 100""")
def exact_block_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part")
    strategy = blocking.Exact(["p_name", "p_brand", "k"], "p_partkey", computed_fields={"k": "nullif(p_size % 3, 0)"})
    return strategy.generate(docs).select("doc1_key", "doc2_key", "block_size")


@query("""SELECT p_partkey, p_name FROM part WHERE p_name IS NOT NULL AND (p_brand IS NULL OR p_brand NOT IN ('Brand#11', 'Brand#22'))
AND coalesce(length(p_name), 0) >= 8 AND coalesce(length(p_type), 0) <= 20 AND contains(p_name, 'e') AND regexp_matches(p_type, '^[A-Z]+') AND p_size IN (1, 2, 3, 5, 8, 13, 21, 34)""")
def filter_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"p_name": {"not_null": True, "min_length": 8, "contains": "e"}, "p_brand": {"not_equal": ["Brand#11", "Brand#22"]}, "p_type": {"max_length": 20, "regex": "^[A-Z]+"}, "p_size": {"in": [1, 2, 3, 5, 8, 13, 21, 34]}}
    return filters.apply_filters(table(spark, sf_dir, "part"), spec).select("p_partkey", "p_name")


@query("""SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE coalesce(nullif(c_mktsegment, 'BUILDING'), '') NOT IN ('MACHINERY', 'FURNITURE')""")
def exclude_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"))
    return filters.exclude_values(rows, {"segment": ["MACHINERY", "FURNITURE"]})


@query("""WITH s AS (SELECT *, upper(substring(p_name, 1, 4)) AS k, count(*) OVER (PARTITION BY upper(substring(p_name, 1, 4)), p_brand, p_size) AS n FROM part)
SELECT a.p_partkey AS doc1_key, b.p_partkey AS doc2_key, a.n AS block_size FROM s a JOIN s b
ON a.k = b.k AND a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE a.n BETWEEN 2 AND 100""")
def computed_prefix_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy = blocking.Exact(["k", "p_brand", "p_size"], "p_partkey", computed_fields={"k": "upper(substring(p_name, 1, 4))"})
    return strategy.generate(table(spark, sf_dir, "part")).select("doc1_key", "doc2_key", "block_size")


@query("""WITH s AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer)
SELECT a.c_custkey AS doc1_key, b.c_custkey AS doc2_key, a.n AS block_size FROM s a JOIN s b
ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey WHERE a.n BETWEEN 2 AND 1000""")
def geo_city_state_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy = blocking.Geographic("city_state", {"city": "c_mktsegment", "state": "c_nationkey"}, "c_custkey")
    return strategy.generate(table(spark, sf_dir, "customer")).select("doc1_key", "doc2_key", "block_size")


@query("""WITH r AS (SELECT c_custkey, substring(CAST(CAST(floor(abs(c_acctbal) * 10) AS BIGINT) AS VARCHAR), 1, 3) AS z FROM customer WHERE c_acctbal IS NOT NULL),
s AS (SELECT *, count(*) OVER (PARTITION BY z) AS n FROM r)
SELECT a.c_custkey AS doc1_key, b.c_custkey AS doc2_key, a.z AS zip3, a.n AS block_size FROM s a JOIN s b ON a.z = b.z AND a.c_custkey < b.c_custkey WHERE a.n BETWEEN 2 AND 1000""")
def geo_zip_prefix_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("zip_text", F.floor(F.abs("c_acctbal") * 10).cast("string"))
    found = blocking.Geographic("zip_prefix", {"zip": "zip_text"}, "c_custkey").generate(rows)
    return found.select("doc1_key", "doc2_key", F.col("blocking_keys.zip").alias("zip3"), "block_size")


@query("""WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS z FROM orders),
k AS (SELECT * FROM r WHERE substring(z, 1, 6) BETWEEN '199501' AND '199503' OR substring(z, 1, 4) BETWEEN '1997' AND '1997'),
s AS (SELECT *, count(*) OVER (PARTITION BY z) AS n FROM k)
SELECT a.o_orderkey AS doc1_key, b.o_orderkey AS doc2_key, a.n AS block_size FROM s a JOIN s b ON a.z = b.z AND a.o_orderkey < b.o_orderkey WHERE a.n BETWEEN 2 AND 1000""")
def zip_range_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("z", F.date_format("o_orderdate", "yyyyMMdd"))
    strategy = blocking.Geographic("zip_range", {"zip": "z"}, "o_orderkey", [("199501", "199503"), ("1997", "1997")])
    return strategy.generate(rows).select("doc1_key", "doc2_key", "block_size")


@query("""WITH r AS (SELECT p_partkey, upper(substring(p_name, 1, 3)) || '_' || CAST(length(p_name) // 2 AS VARCHAR) AS k FROM part WHERE p_name <> '')
SELECT a.p_partkey AS doc1_key, b.p_partkey AS doc2_key, a.k AS ngram_key FROM r a JOIN r b ON a.k = b.k AND a.p_partkey < b.p_partkey""")
def bulk_ngram_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.bulk_ngram(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("doc1_key", "doc2_key", F.col("blocking_keys.ngram_key").alias("ngram_key"))


@query("""WITH r AS (SELECT c_custkey, CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) AS v FROM customer)
SELECT a.c_custkey AS doc1_key, b.c_custkey AS doc2_key FROM r a JOIN r b ON a.v = b.v AND a.c_custkey < b.c_custkey WHERE a.v NOT IN ('', '0')""")
def bulk_exact_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("v", F.round("c_acctbal").cast("long").cast("string"))
    return blocking.bulk_exact(rows, "v", "c_custkey").select("doc1_key", "doc2_key")


#: Of each letter; 7 is passed over, 0 parts equal codes.
_SOUND = "01230127022455012623017202"
_PHONETIC = f"""WITH RECURSIVE n AS (SELECT min(p_partkey) AS k, upper(p_name) AS s FROM part WHERE p_name <> '' GROUP BY p_name),
r AS (SELECT k, s, 2 AS i, substring(s, 1, 1) AS code, translate(substring(s, 1, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{_SOUND}') AS last FROM n
UNION ALL SELECT k, s, i + 1, CASE WHEN c IN ('0', '7') OR c = last THEN code ELSE code || c END, CASE WHEN c = '7' THEN last ELSE c END
  FROM (SELECT *, translate(CASE WHEN regexp_matches(substring(s, i, 1), '[A-Z]') THEN substring(s, i, 1) ELSE 'A' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{_SOUND}') AS c FROM r WHERE i <= length(s))),
c AS (SELECT k, substring(arg_max(code, i) || '000', 1, 4) AS code FROM r GROUP BY k)
SELECT a.k AS doc1_key, b.k AS doc2_key, a.code AS code FROM c a JOIN c b ON a.code = b.code AND a.k < b.k"""


@query(_PHONETIC)
def bulk_phonetic_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least part of each name, by the sound of the name."""
    named = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    return blocking.bulk_phonetic(named, "p_name", "p_partkey").select("doc1_key", "doc2_key", F.col("blocking_keys.code").alias("code"))


_UNION = """a AS (SELECT x.p_partkey AS doc1_key, y.p_partkey AS doc2_key FROM part x JOIN part y ON x.p_name = y.p_name AND x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey),
b AS (SELECT x.p_partkey AS doc1_key, y.p_partkey AS doc2_key FROM part x JOIN part y ON x.p_type = y.p_type AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey),
u AS (SELECT *, 'name' AS source FROM a UNION ALL SELECT *, 'size' FROM b),
g AS (SELECT doc1_key, doc2_key, count(*) AS n_sources, string_agg(source, ',' ORDER BY source) AS sources FROM u GROUP BY ALL)"""


_TWO = {"name": ["p_name", "p_brand"], "size": ["p_type", "p_size"]}


@query(f"WITH {_UNION} SELECT doc1_key, doc2_key, n_sources, sources FROM g")
def union_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.any_block_pairs(table(spark, sf_dir, "part"), _TWO, "p_partkey").select("doc1_key", "doc2_key", F.size("sources").cast("long").alias("n_sources"), F.array_join("sources", ",").alias("sources"))


@query(f"WITH {_UNION} SELECT doc1_key, doc2_key FROM g WHERE n_sources = 2")
def intersect_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.all_block_pairs(table(spark, sf_dir, "part"), _TWO, "p_partkey")


@query(f"WITH {_UNION} SELECT doc1_key, doc2_key, CASE WHEN sources LIKE 'name%' THEN 'name' ELSE 'size' END AS method FROM g")
def bulk_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.any_block_pairs(table(spark, sf_dir, "part"), _TWO, "p_partkey").select("doc1_key", "doc2_key", "method")


@query("""WITH s AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) BETWEEN 2 AND 1000)
SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS total_pairs, count(*) AS unique_blocks, max(n) AS largest_block FROM s""")
def block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_statistics(table(spark, sf_dir, "part"), ["p_brand", "p_type"], most=MOST)


@query("""WITH s AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)
SELECT count(*) AS blocks, CAST(coalesce(sum(n * (n - 1) // 2) FILTER (n BETWEEN 2 AND 20), 0) AS BIGINT) AS pairs,
CAST(coalesce(sum(n * (n - 1) // 2) FILTER (n > 20), 0) AS BIGINT) AS skipped_pairs, max(n) AS largest FROM s""")
def blocking_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.preflight(table(spark, sf_dir, "part"), ["p_brand", "p_type"], most=20)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS e FROM lineitem), d AS (SELECT *, count(*) OVER (PARTITION BY node) AS n FROM l)
SELECT a.e AS doc1_key, b.e AS doc2_key, a.node AS shared_node, a.n AS node_degree FROM d a JOIN d b ON a.node = b.node AND a.e < b.e WHERE a.n BETWEEN 2 AND 100""")
def shared_neighbor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.shared_neighbours(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").drop("method")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS e FROM lineitem), d AS (SELECT *, count(*) OVER (PARTITION BY node) AS n FROM l),
p AS (SELECT a.node, a.n FROM d a JOIN d b ON a.node = b.node AND a.e < b.e WHERE a.n BETWEEN 2 AND 100)
SELECT count(*) AS total_pairs, count(DISTINCT node) AS unique_shared_nodes, round(avg(n), 4) AS avg_degree FROM p""")
def shared_neighbor_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.shared_neighbour_statistics(shared_neighbor_pairs(spark, sf_dir))


@query("""WITH r AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_mktsegment || c_name, c_custkey) AS rn FROM customer)
SELECT least(a.k, b.k) AS doc1_key, greatest(a.k, b.k) AS doc2_key, CAST(b.rn - a.rn AS INTEGER) AS distance FROM r a JOIN r b ON b.rn BETWEEN a.rn + 1 AND a.rn + 3""")
def sorted_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.sorted_neighbourhood(table(spark, sf_dir, "customer"), F.concat("c_mktsegment", "c_name"), "c_custkey", 3, 16)


@query("""WITH t AS (SELECT s_suppkey, s_nationkey, CAST(CAST(floor(s_acctbal / 100) AS BIGINT) AS VARCHAR) AS b, substring(s_name, length(s_name) - 1) AS e FROM supplier),
d AS (SELECT c_custkey, CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS VARCHAR) AS b, c_nationkey, substring(c_name, length(c_name) - 1) AS e FROM customer),
u AS (SELECT s_suppkey, c_custkey, 'balance' AS s FROM t JOIN d USING (b) UNION SELECT s_suppkey, c_custkey, 'name_end' FROM t JOIN d USING (e)),
g AS (SELECT s_suppkey AS target_key, c_custkey AS doc_key, string_agg(s, ',' ORDER BY s) AS strategies FROM u WHERE s_suppkey <> c_custkey GROUP BY ALL)
SELECT target_key, doc_key, strategies FROM g""")
def candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "_key")
    docs = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "_key")
    hundreds = lambda c: F.floor(F.col(c) / 100).cast("string")
    end = lambda c: F.substring(F.col(c), -2, 2)
    found = blocking.candidates(targets, docs, {"balance": (hundreds("s_acctbal"), hundreds("c_acctbal")), "name_end": (end("s_name"), end("c_name"))})
    return found.withColumn("strategies", F.array_join("strategies", ","))


@query("""SELECT 'o' || o_orderkey AS doc FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)""")
def unresolved_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no line links to a supplier."""
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"))
    return filters.unresolved(table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("doc")), edges, "doc")


@query(f"""WITH {PART_PAIRS}, u AS (SELECT p_partkey FROM part WHERE p_size <= 25)
SELECT doc1_key, doc2_key FROM pairs WHERE doc1_key IN (SELECT p_partkey FROM u) AND doc2_key IN (SELECT p_partkey FROM u)""")
def restrict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.restrict_pairs(part_pairs(spark, sf_dir), table(spark, sf_dir, "part").filter("p_size <= 25"), "p_partkey").select("doc1_key", "doc2_key")


_POSTINGS = """w AS (SELECT p_partkey AS k, list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM part),
i AS (SELECT k, len(w) AS size, unnest(w) AS token FROM w), post AS (SELECT k, token, size, count(*) AS tf FROM i GROUP BY ALL),
tot AS (SELECT count(*) AS docs, avg(size) AS mean_size FROM (SELECT DISTINCT k, size FROM post)), df AS (SELECT token, count(*) AS df FROM post GROUP BY token)"""


@query(f"""WITH {_POSTINGS}, q AS (SELECT DISTINCT s_suppkey AS query_key, unnest(['blue', 'steel', 'large', 'tin', 'copper', 'small'][1 + s_suppkey % 5:2 + s_suppkey % 5]) AS token FROM supplier),
s AS (SELECT query_key, k AS doc_key, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean_size))), 4) AS bm25 FROM q JOIN post USING (token) JOIN df USING (token), tot GROUP BY ALL)
SELECT query_key, doc_key, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY bm25 DESC, doc_key) AS r FROM s) WHERE r <= 20""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part").withColumn("text", F.concat_ws(" ", "p_name", "p_type"))
    words = F.array(*(F.lit(x) for x in ("blue", "steel", "large", "tin", "copper", "small")))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_key"), F.explode(F.slice(words, (1 + F.col("s_suppkey") % 5).cast("int"), F.lit(2))).alias("token"))
    return search.bm25_top(search.postings(docs, "text", "p_partkey"), asked, 20)


_NAMES = """n AS (SELECT p_partkey AS k, p_name, p_brand, ' ' || array_to_string(list_filter(string_split_regex(lower(p_name), '[^a-z0-9_]+'), lambda x: x <> ''), ' ') || ' ' AS phrase FROM part),
i AS (SELECT k, len(string_split(trim(phrase), ' ')) AS size, unnest(string_split(trim(phrase), ' ')) AS token FROM n WHERE trim(phrase) <> ''), post AS (SELECT k, token, size, count(*) AS tf FROM i GROUP BY ALL),
tot AS (SELECT count(*) AS docs, avg(size) AS mean_size FROM (SELECT DISTINCT k, size FROM post)), df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
met AS (SELECT a.k AS doc1_key, b.k AS doc2_key FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.k < b.k AND contains(b.phrase, a.phrase)),
scored AS (SELECT doc1_key, doc2_key, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * y.tf * 2.2 / (y.tf + 1.2 * (0.25 + 0.75 * y.size / mean_size))), 4) AS bm25
  FROM met JOIN post x ON x.k = doc1_key JOIN post y ON y.k = doc2_key AND y.token = x.token JOIN df ON df.token = x.token, tot GROUP BY ALL)"""


@query(f"""WITH {_NAMES} SELECT doc1_key, doc2_key, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY doc1_key ORDER BY bm25 DESC, doc2_key) AS r FROM scored WHERE bm25 > 2.0) WHERE r <= 20""")
def bm25_phrase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrase_pairs(table(spark, sf_dir, "part"), "p_name", "p_partkey", block="p_brand")


@query(f"""WITH {_NAMES.replace("FROM part)", "FROM part WHERE p_name IS NOT NULL AND length(p_name) > 9 AND p_brand IS NOT NULL)", 1)} SELECT doc1_key, doc2_key, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY doc1_key ORDER BY bm25 DESC, doc2_key) AS r FROM scored WHERE bm25 > 1.0) WHERE r <= 5""")
def bm25_filtered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of more than nine letters only: a least length is exclusive in full-text blocking."""
    spec = {"p_name": {"not_null": True, "min_length": 9}, "p_brand": {"not_null": True}}
    return search.phrase_pairs(table(spark, sf_dir, "part"), "p_name", "p_partkey", 1.0, 5, "p_brand", spec)


@query(f"""WITH {_NAMES}, l AS (SELECT s.*, round(0.75 * (1 - levenshtein(upper(trim(a.p_name)), upper(trim(b.p_name))) / greatest(length(trim(a.p_name)), length(trim(b.p_name)))) + 0.25 * (1 - levenshtein(upper(trim(x.p_type)), upper(trim(y.p_type))) / greatest(length(trim(x.p_type)), length(trim(y.p_type)))), 4) AS levenshtein_score
  FROM scored s JOIN n a ON a.k = doc1_key JOIN n b ON b.k = doc2_key JOIN part x ON x.p_partkey = doc1_key JOIN part y ON y.p_partkey = doc2_key WHERE bm25 > 2.0),
c AS (SELECT *, round(bm25 * 0.2 + levenshtein_score * 0.8, 4) AS combined_score FROM l WHERE levenshtein_score >= 0.85)
SELECT doc1_key, doc2_key, bm25, levenshtein_score, combined_score FROM (SELECT *, row_number() OVER (PARTITION BY doc1_key ORDER BY combined_score DESC, doc2_key) AS r FROM c) WHERE r <= 20""")
def hybrid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_pairs(table(spark, sf_dir, "part"), {"p_name": 3.0, "p_type": 1.0}, "p_partkey", block="p_brand")


COSINE_SQL = "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)"


@query(f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS doc1_key, b.vec_id AS doc2_key, {COSINE_SQL} AS similarity FROM e a JOIN e b ON a.label IS NOT DISTINCT FROM b.label AND a.vec_id <> b.vec_id)
SELECT doc1_key, doc2_key, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc1_key ORDER BY similarity DESC, doc2_key) AS r FROM s WHERE similarity >= 0.1) WHERE r <= 20""")
def topk_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.knn_pairs(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", 0.1, 20, "label")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END) AS w)
SELECT vec_id AS doc_key, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) AS similarity FROM e, q
WHERE round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) >= 0.05 ORDER BY similarity DESC, doc_key LIMIT 20""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), [1.0 if i % 2 == 0 else -0.5 for i in range(64)], "embedding", "vec_id", 0.05, 20)


@query(f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), a AS (SELECT * FROM e WHERE vec_id = 7)
SELECT b.vec_id AS doc_key, {COSINE_SQL} AS similarity FROM a, e b WHERE b.vec_id <> 7 AND b.label IN (0, 2, 4) AND {COSINE_SQL} >= 0.0 ORDER BY similarity DESC, doc_key LIMIT 15""")
def nearest_to_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of some labels for one document's own vector."""
    return vectors.nearest_to(table(spark, sf_dir, "embeddings"), 7, "embedding", "vec_id", 0.0, 15, filters={"label": {"in": [0, 2, 4]}})


def lsh_sql(tables: int = 4, planes: int = 6) -> str:
    every = vectors.hyperplanes(tables, planes, 64)
    bits = ["concat(" + ", ".join(f"CASE WHEN list_dot_product(v, CAST([{', '.join(repr(float(x)) for x in p)}] AS DOUBLE[])) >= 0 THEN '1' ELSE '0' END" for p in t) + ")" for t in every]
    return f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS ({' UNION ALL '.join(f'SELECT vec_id, label, {i} AS t, {b} AS bits FROM e' for i, b in enumerate(bits))})
SELECT DISTINCT a.vec_id AS doc1_key, b.vec_id AS doc2_key FROM s a JOIN s b ON a.t = b.t AND a.bits = b.bits AND a.label IS NOT DISTINCT FROM b.label AND a.vec_id < b.vec_id"""


@query(lsh_sql())
def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.lsh_pairs(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", 4, 6, block="label")


@query("""SELECT count(*) AS total, count(embedding) AS with_embedding, count(*) - count(embedding) AS without_embedding, round(100 * count(embedding) / count(*), 2) AS coverage_percent, CAST(max(len(embedding)) AS INTEGER) AS dimension FROM embeddings""")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.coverage(table(spark, sf_dir, "embeddings"), "embedding")


@query("""WITH p AS (SELECT a.s_suppkey AS source_key, b.c_custkey AS target_key, round(1 - levenshtein(upper(right(a.s_name, 6)), upper(right(b.c_name, 6))) / 6, 4) AS score
  FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey WHERE a.s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0))
SELECT source_key, target_key, score FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY score DESC, target_key) AS r FROM p WHERE score >= 0.5) WHERE r = 1""")
def best_match_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("s_end", F.substring("s_name", -6, 6))
    c = table(spark, sf_dir, "customer").withColumn("c_end", F.substring("c_name", -6, 6))
    linked = s.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("source_key"))
    return relations.best_matches(s, c, {"s_nationkey": "c_nationkey"}, {"s_end": ("c_end", 1.0)}, "s_suppkey", "c_custkey", 0.5, linked)


@query("""WITH w AS (SELECT p_partkey AS k, p_brand, p_size, p_name, list_filter(string_split_regex(lower(p_name), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM part),
s AS (SELECT * FROM w WHERE k % 4 = 1), t AS (SELECT * FROM w WHERE k % 4 <> 1), q AS (SELECT DISTINCT k AS source_key, unnest(w) AS token FROM s),
i AS (SELECT k, len(w) AS size, unnest(w) AS token FROM t), post AS (SELECT k, token, size, count(*) AS tf FROM i GROUP BY ALL), tot AS (SELECT count(*) AS docs, avg(size) AS mean_size FROM (SELECT DISTINCT k, size FROM post)), df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
p AS (SELECT s.k AS source_key, t.k AS target_key, round(1 - levenshtein(upper(trim(s.p_name)), upper(trim(t.p_name))) / greatest(length(trim(s.p_name)), length(trim(t.p_name))), 4) AS score FROM s JOIN t ON s.p_brand = t.p_brand),
b AS (SELECT source_key, target_key, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean_size))), 4) AS bm25 FROM p JOIN q USING (source_key) JOIN post ON post.k = target_key AND post.token = q.token JOIN df ON df.token = q.token, tot WHERE score >= 0.3 GROUP BY ALL),
m AS (SELECT source_key, target_key, score, coalesce(bm25, 0) AS bm25 FROM p LEFT JOIN b USING (source_key, target_key) WHERE score >= 0.3)
SELECT source_key, target_key, score, bm25, round(score * 0.8 + bm25 * 0.2, 4) AS total FROM m QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY round(score * 0.8 + bm25 * 0.2, 4) DESC, target_key) = 1""")
def best_match_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth part against the others of its brand, by edit distance and BM25 of the names."""
    parts = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    return relations.best_matches(parts.filter(k == 1), parts.filter(k != 1), {"p_brand": "p_brand"}, {"p_name": ("p_name", 1.0)}, "p_partkey", "p_partkey", 0.3, bm25=("p_name", "p_name"))


@query("""WITH d AS (SELECT n_nationkey AS k, n_name AS n FROM nation),
p AS (SELECT a.k AS record_key, b.k AS doc_key, round(CASE WHEN lower(a.n) = lower(b.n) THEN 1.0 ELSE jaro_winkler_similarity(lower(a.n), lower(b.n)) END, 4) AS score FROM d a JOIN d b ON lower(substring(a.n, 1, 3)) = lower(substring(b.n, 1, 3)) AND a.k <> b.k)
SELECT record_key, doc_key, score, CAST(row_number() OVER (PARTITION BY record_key ORDER BY score DESC, doc_key) AS INTEGER) AS rank FROM p WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY score DESC, doc_key) <= 10""")
def incremental_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_key"), "n_name")
    return incremental.resolve(docs, docs, ["n_name"], threshold=0.5)


@query("""WITH m AS (SELECT DISTINCT p_type AS mention_id, lower(p_type) AS name FROM part), e AS (SELECT min(p_partkey) AS entity_key, lower(p_name) AS known FROM part GROUP BY lower(p_name)),
k AS (SELECT mention_id, name, unnest(list_distinct(list_concat(['^' || substring(name, 1, 2)], string_split_regex(name, '\\s+')))) AS k FROM m),
j AS (SELECT entity_key, known, unnest(list_distinct(list_concat(['^' || substring(known, 1, 2)], string_split_regex(known, '\\s+')))) AS k FROM e),
p AS (SELECT DISTINCT mention_id, entity_key, round(jaro_winkler_similarity(name, known), 4) AS similarity FROM k JOIN j USING (k))
SELECT mention_id, entity_key, similarity FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY similarity DESC, entity_key) AS r FROM p WHERE similarity >= 0.5) WHERE r = 1""")
def entity_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    mentions = parts.select(F.col("p_type").alias("mention_id"), F.col("p_type").alias("name")).distinct()
    entities = parts.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_key"))
    return relations.link_names(mentions, entities, 0.5)
