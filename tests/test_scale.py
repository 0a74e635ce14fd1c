"""What a query shuffles, holds and counts must not grow beyond its input; each test is named by the finding it settles."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from kindred.operators import blocking, components, profile, relations, scoring, search, vectors
from kindred.queries import oracle_sql, queries
from kindred.queries import pairs as pair_queries
from kindred.queries import scores as score_queries

from . import compare


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles_pairs(df) -> bool:
    """Whether an exchange or a sort lies above what makes pairs."""
    above = re.split(r"Generate explode", plan(df))[0]
    return "Exchange" in above or "Sort" in above


def same_as_sql(spark, folder, name):
    return compare.differences(queries()[name](spark, folder), compare.views(folder), oracle_sql()[name])


def write(df, folder, name):
    df.toPandas().to_parquet(f"{folder}/{name}.parquet")


def small_parts(spark, rows):
    return spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")


def test_r03_f2_one_block_is_many_tasks(spark):
    """One block's pairs come from more than one task, whole."""
    rows = spark.range(3500).select("id", F.lit("steel bolt").alias("name"))
    found = blocking.bulk_ngram(rows, "name", "id")
    by = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in by) == 3500 * 3499 // 2
    assert len(by) > 4


def test_r03_f1_f15_sources_are_read_off_the_rows(spark, sf_dir):
    for name in ("bulk_all_pairs", "union_strategies"):
        assert not shuffles_pairs(getattr(pair_queries, name)(spark, sf_dir)), name


def test_r03_f1_f14_f15_null_equals_nothing(spark):
    """As in SQL: a null key brings no pair together, whichever strategy has it."""
    parts = small_parts(spark, [(1, "a", "x", "t", 1), (2, "a", "x", "t", 1), (3, None, "x", "t", 1), (4, None, "x", "t", 2), (5, "a", "x", None, 1)])
    two = {"name": ["p_name", "p_brand"], "size": ["p_type", "p_size"]}
    got = {(r[0], r[1]): (r["method"], r["sources"]) for r in blocking.any_block_pairs(parts, two, "p_partkey").collect()}
    assert got == {(1, 2): ("name", ["name", "size"]), (1, 5): ("name", ["name"]), (2, 5): ("name", ["name"]), (1, 3): ("size", ["size"]), (2, 3): ("size", ["size"])}
    assert [tuple(r) for r in blocking.all_block_pairs(parts, two, "p_partkey").collect()] == [(1, 2)]


def test_r03_f14_both_strategies_are_one_block(spark, sf_dir):
    assert not shuffles_pairs(pair_queries.intersect_strategies(spark, sf_dir))


def test_r03_f3_equal_queries_are_answered_once(spark):
    """Queries of the same tokens, in any order, have one answer, and it is that of BM25 over all documents."""
    docs = spark.createDataFrame([(i, f"red {'steel ' * (i % 3)}n{i}") for i in range(60)], "k long, t string")
    asked = spark.createDataFrame([(q, t) for q in range(40) for t in (["red", "steel"] if q % 2 else ["steel", "red", "red"])], "query_key long, token string")
    index = search.postings(docs, "t", "k")
    got = {}
    for r in search.bm25_top(index, asked, 5).collect():
        got.setdefault(r["query_key"], set()).add((r["doc_key"], r["bm25"]))
    alone = search.bm25_scores(index, asked.filter("query_key = 1")).collect()
    best = sorted((-round(r["bm25"], 4), r["doc_key"]) for r in alone)[:5]
    assert set(got) == set(range(40)) and all(v == {(k, -s) for s, k in best} for v in got.values())


def test_r03_f4_f12_pairs_are_aggregated_where_they_arise(spark, sf_dir):
    """Of the pairs that meet only each source's scores go on: they are hashed, not sorted."""
    for name in ("best_match_bm25", "best_match_cross"):
        above = re.split(r"Generate explode", plan(getattr(pair_queries, name)(spark, sf_dir)))[0]
        assert "SortAggregate" not in above.split("Exchange")[-1], name


def test_r03_f4_equal_sources_and_targets_meet_once(spark):
    left = spark.createDataFrame([(i, "b", ["red bolt", "blue nut", None][i % 3]) for i in range(90)], "s long, g string, n string")
    right = spark.createDataFrame([(1000 + i, ["b", None][i == 4], ["red bolts", "blue nuts", "red"][i % 3]) for i in range(60)], "t long, g string, n string")
    got = {r["source_key"]: (r["target_key"], r["score"], r["bm25"]) for r in relations.best_matches(left, right, {"g": "g"}, {"n": ("n", 1.0)}, "s", "t", 0.3, bm25=("n", "n")).collect()}
    plain = {r["source_key"]: (r["target_key"], r["score"]) for r in relations.best_matches(left, right, {"g": "g"}, {"n": ("n", 1.0)}, "s", "t", 0.3).collect()}
    assert set(got) == set(plain) == {i for i in range(90) if i % 3 < 2}
    assert {v[:2] for k, v in got.items() if k % 3 == 1} == {(1001, 0.8889)} == {v for k, v in plain.items() if k % 3 == 1}
    assert {v for k, v in plain.items() if k % 3 == 0} == {(1000, 0.8889)}


def test_r03_f13_f19_every_candidate_is_there(spark, tmp_path):
    """No target's candidates end at a hundred, and pairs of two conditions are not brought together by a shuffle."""
    write(spark.range(3).selectExpr("id as s_suppkey", "concat('S', id) as s_name", "0 as s_nationkey", "150.0 as s_acctbal"), tmp_path, "supplier")
    write(spark.range(400).selectExpr("id as c_custkey", "concat('C', id % 30) as c_name", "0 as c_nationkey", "100.0 + id % 2 * 100 as c_acctbal"), tmp_path, "customer")
    found = pair_queries.candidate_lookup(spark, str(tmp_path))
    assert not shuffles_pairs(found)
    assert found.groupBy("target_key").count().agg(F.min("count")).first()[0] > 100
    assert same_as_sql(spark, str(tmp_path), "candidate_lookup") == ""


def crowded(spark, folder):
    """Tables whose only block of brand and type is over its limit: no pair, no cluster."""
    rows = [(i, f"name {i % 7}", "b", "t", i % 9) for i in range(1001)]
    write(small_parts(spark, rows).withColumn("p_retailprice", F.lit(1.0)), folder, "part")
    return str(folder)


def test_r03_f8_no_cluster(spark, tmp_path):
    assert same_as_sql(spark, crowded(spark, tmp_path), "validation_summary") == ""


def test_r03_f16_no_block(spark, tmp_path):
    assert same_as_sql(spark, crowded(spark, tmp_path), "block_statistics") == ""


def test_r03_f16_counts_make_no_pairs(spark, sf_dir):
    assert "Join" not in plan(pair_queries.block_statistics(spark, sf_dir))


def test_r03_f17_suppliers_are_not_parts(spark, tmp_path):
    """A supplier whose shown key is a part's key by chance stays what it is."""
    write(small_parts(spark, [(1, "a", "b", "t", 1), (1000007, "a", "b", "t", 1)]), tmp_path, "part")
    lines = spark.createDataFrame([(1, 7, 2.0, "N", "O"), (1000007, 7, 3.0, "N", "F")], "l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string")
    write(lines, tmp_path, "lineitem")
    assert same_as_sql(spark, str(tmp_path), "relationship_sweep") == ""


def test_r03_f18_no_pair_has_no_weights(spark, tmp_path):
    assert same_as_sql(spark, crowded(spark, tmp_path), "feature_weights") == ""


def test_r03_f5_f6_f7_f11_equal_values_are_scored_once(spark, sf_dir, tmp_path):
    """What compares values lies below what makes pairs of rows."""
    for name in ("context_score", "feature_comparator", "ngram_jaccard_score", "word_jaccard_score"):
        above, *below = re.split(r"Generate explode", plan(getattr(score_queries, name)(spark, sf_dir)))
        compares = r"levenshtein\(|array_intersect\(|array_union\(|ArrowEvalPython"
        assert below and re.search(compares, below[-1]) and not re.search(compares, above), name


def test_r03_f5_f6_groups_give_each_pair_once(spark):
    """Groups of equal values, of two and of one row, give the pairs and the order of rows joined one by one."""
    docs = spark.createDataFrame([(i, f"b{i % 2}", [None, "red bolt", "bolt red", "martha", "marhta"][i % 5 if i < 30 else 3]) for i in range(36)], "k long, g string, n string")
    columns = {"last_name": "n"}
    joined = scoring.features(blocking.block_pairs(docs, ["g"], "k"), docs, columns, "k").select("doc1_key", "doc2_key", *scoring.feature_columns(columns))
    grouped = scoring.block_features(docs, ["g"], columns, "k")
    assert grouped.count() == 2 * 18 * 17 // 2
    assert sorted(map(str, grouped.select(*joined.columns).collect())) == sorted(map(str, joined.collect()))


def test_r03_f23_f24_f25_f26_f30_true_pairs_are_counted_not_made(spark, sf_dir, tmp_path):
    """A thousand and one equal parts are over the block's limit: no candidate, and half a million true pairs are missed."""
    folder = crowded(spark, tmp_path)
    for name in ("threshold_sweep", "best_f1", "confusion_at", "blocking_quality"):
        assert same_as_sql(spark, folder, name) == "", name
    assert "Generate" not in plan(score_queries.blocking_quality(spark, sf_dir))
    tally = score_queries._tally(spark, folder)
    assert tally.count() == 1 and tally.first()["n"] == sum(143 * 142 // 2 for _ in range(7))
    assert not shuffles_pairs(score_queries._labelled(spark, sf_dir))


def test_r03_f20_f21_f27_documents_take_their_best_from_classes(spark, monkeypatch):
    """Several levels a document, lines of five places, ties by key: the best three are those of all pairs."""
    monkeypatch.setattr(search, "LINE", 5)
    texts = ["red", "red bolt", "Red  bolt!", "bolt red bolt", "old red bolt", "red tin", None, "!"]
    docs = spark.createDataFrame([(i * 7 % 101, texts[i * i % 8 if i < 60 else i % 8], f"b{i % 2}") for i in range(101)], "k long, t string, g string")
    every = search.phrase_pairs(docs, "t", "k", -10.0, None, "g").collect()
    rows = {r["k"]: (" " + " ".join(re.findall("[a-z]+", (r["t"] or "").lower())) + " ", r["g"]) for r in docs.collect()}
    wanted = {(a, b) for a in rows for b in rows if a < b and rows[a][1] == rows[b][1] and rows[a][0].strip() and rows[a][0] in rows[b][0]}
    assert {(r[0], r[1]) for r in every} == wanted and len(every) == len(wanted)
    best = {}
    for r in sorted(every, key=lambda r: (-r["bm25"], r["doc2_key"])):
        best.setdefault(r["doc1_key"], []).append((r["doc2_key"], r["bm25"]))
    got = {}
    for r in search.phrase_pairs(docs, "t", "k", -10.0, 3, "g").collect():
        got.setdefault(r["doc1_key"], set()).add((r["doc2_key"], r["bm25"]))
    assert got == {k: set(v[:3]) for k, v in best.items()} and max(len({s for _, s in v}) for v in got.values()) > 1


def test_r03_f9_f10_tiles_give_the_best_of_all(spark, monkeypatch):
    """Several tiles a block, equal vectors, a null block, a zero vector: the best four are those of all pairs, ties by key."""
    monkeypatch.setattr(vectors, "TILE", 30)
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(240, 8)).astype("float32")
    rows[1::3] = rows[0::3]
    rows[7] = 0
    docs = spark.createDataFrame([(int(i * 17 % 240), [float(x) for x in v], [None, 1, 2][i % 3 if i < 90 else 1]) for i, v in enumerate(rows)], "k long, v array<float>, g int")
    every = [(r["k"], np.array(r["v"], np.float64), r["g"]) for r in docs.collect()]
    wanted = set()
    for k, v, g in every:
        near = [(-round(float(v @ w) / size, 6) if (size := np.linalg.norm(v) * np.linalg.norm(w)) else 0.0, j) for j, w, h in every if j != k and h == g]
        wanted |= {(k, j, -s + 0.0) for s, j in sorted(near)[:4] if -s >= -0.2}
    found = vectors.knn_pairs(docs, "v", "k", -0.2, 4, "g")
    assert {(r[0], r[1], r[2] + 0.0) for r in found.collect()} == wanted and len(wanted) > 900
    near = {tuple(sorted((r[0], r[1]))) for r in vectors.lsh_pairs(docs, "v", "k", 3, 4, dimension=8, block="g").collect()}
    met = vectors.meet_in(found, docs, "v", "k", 3, 4, dimension=8, block="g").collect()
    assert {(r[0], r[1]) for r in met} == {(a, b) for a, b, _ in wanted if tuple(sorted((a, b))) in near}


def test_r03_f28_a_task_holds_a_part_of_the_values(spark):
    """Values are dealt before they are counted, and no map of a field's values is built where its rows lie."""
    docs = spark.range(2000).selectExpr("concat('n', id % 500) as a", "cast(id as string) as b")
    found = profile.type_shares(docs, ["a", "b"])
    assert {r["field"]: (r["n"], r["cardinality"], r["avg_tokens"]) for r in found.collect()} == {"a": (2000, 0.25, 1.0), "b": (2000, 1.0, 1.0)}
    deepest = plan(found).split("HashAggregate")[-1]
    assert "REPARTITION_BY_NUM" in deepest


def test_r03_f29_chains_are_not_broadcast(spark, sf_dir):
    assert "Broadcast" not in plan(queries()["mapping_cycles"](spark, sf_dir))


def test_r03_f22_ranges_are_contracted_first(spark, monkeypatch):
    """A chain over all ranges, a hub in each of them, loops, near and far links: the roots are those of union-find, and the
    rounds get fewer links than there are."""
    monkeypatch.setattr(components, "CONTRACT", 40)
    monkeypatch.setattr(components, "PART", 60)
    rng = np.random.default_rng(2)
    given, rounds = [], components._by_rounds
    monkeypatch.setattr(components, "_by_rounds", lambda stars, *rest: given.append(stars.count()) or rounds(stars, *rest))
    near = [(i, i + 1) for i in range(400) if i % 90] + [(7, 40 * i + 3) for i in range(8)] + [(5000, 5000), (3, 3)] + [(6000 + i, 6000 + i // 2) for i in range(1, 200)]
    far = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))]
    for links in (near, far):
        root = {x: x for pair in links for x in pair}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        found = components.components(spark.createDataFrame(links, "src long, dst long"), local_links=0)
        assert sorted(map(tuple, found.collect())) == sorted((x, find(x)) for x in root)
    assert given[0] < len(near) // 4 and len(given) == 2
