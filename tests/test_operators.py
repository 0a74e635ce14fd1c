"""Operators on small fixtures whose results are worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kindred.functions import names, numbers, text
from kindred.operators import blocking, clusters, components, edges, evaluation, filters, fusion, gates, learning, relations, scoring, vectors


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()["x"]


def pairs(df):
    return sorted((r["doc1_key"], r["doc2_key"]) for r in df.collect())


@pytest.fixture(scope="module")
def people(spark):
    rows = [("1", "John", "Smith", "555-1", "a@x.com"), ("2", "Jane", "Doe", "555-2", "b@x.com"), ("3", "John", "Smith", "555-1", "c@x.com"), ("4", None, None, None, None), ("5", None, "", None, "")]
    return spark.createDataFrame(rows, "_key string, first string, last string, phone string, email string")


def test_exact_blocks_pair_rows_of_equal_phone_and_null_is_a_value(people):
    assert pairs(blocking.Exact(["phone"]).generate(people)) == [("1", "3"), ("4", "5")]
    assert pairs(blocking.Exact(["phone"], filters={"phone": {"not_null": True}}).generate(people)) == [("1", "3")]


@pytest.mark.parametrize(("size", "expected"), [(1, 0), (2, 1), (3, 3), (4, 0)])
def test_block_sizes_at_the_limits(spark, size, expected):
    docs = spark.createDataFrame([(i, "k") for i in range(size)], "_key int, k string")
    assert blocking.Exact(["k"], most=3).generate(docs).count() == expected


def test_pairs_are_normalised_and_the_first_method_stays(spark):
    raw = spark.createDataFrame([("b", "a", "2"), ("a", "b", "1"), (None, "a", "1"), ("", "a", "1")], "doc1_key string, doc2_key string, method string")
    assert [tuple(r) for r in blocking.normalise_pairs(raw).collect()] == [("a", "b", "1")]


def test_bulk_exact_skips_placeholders(spark):
    docs = spark.createDataFrame([(1, "0"), (2, "0"), (3, ""), (4, ""), (5, None), (6, None), (7, "9"), (8, "9")], "_key int, phone string")
    assert pairs(blocking.bulk_exact(docs, "phone")) == [(7, 8)]


def test_combined_sources(spark):
    schema = "doc1_key int, doc2_key int"
    a, b = spark.createDataFrame([(1, 2), (3, 4)], schema), spark.createDataFrame([(2, 1), (5, 6)], schema)
    assert {(r[0], r[1]): r[2] for r in blocking.combine({"a": a, "b": b}).collect()} == {(1, 2): ["a", "b"], (3, 4): ["a"], (5, 6): ["b"]}
    assert pairs(blocking.combine({"a": a, "b": b}, "intersection")) == [(1, 2)]


def test_filters_and_nulls(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "x"), (4, "")], "k int, v string")

    def kept(spec):
        return [r["k"] for r in filters.apply_filters(docs, {"v": spec}).orderBy("k").collect()]

    assert kept({"not_equal": "x"}) == [1, 2, 4]
    assert kept({"max_length": 1}) == [2, 3, 4]
    assert kept({"min_length": 1}) == [1, 3]
    assert kept({"contains": "b"}) == [1]
    assert [r["k"] for r in filters.exclude_values(docs, {"v": ["x"]}).orderBy("k").collect()] == [1, 2, 4]
    with pytest.raises(ValueError):
        filters.check_name("a; drop")
    with pytest.raises(ValueError):
        filters.check_expression("1; delete from x")


@pytest.mark.parametrize(("word", "code"), [("Pfister", "P123"), ("Tymczak", "T520"), ("", "0000"), ("Lee", "L000")])
def test_soundex_keeps_the_last_code_over_vowels(spark, word, code):
    assert one(spark, text.soundex(F.col("w")), w=("string", word)) == code


def test_jaro_winkler():
    assert round(names.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(names.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert names.jaro_winkler("", "") == 0.0 and names.jaro_winkler("a", "a") == 1.0
    assert names.jaro_winkler("abc", "xyz") == 0.0


def test_string_similarities(spark):
    v = {"a": ("string", "Night"), "b": ("string", "nacht")}
    assert round(one(spark, text.ngram_jaccard(F.col("a"), F.col("b")), **v), 4) == 0.0
    assert one(spark, text.ngram_jaccard(F.col("a"), F.col("b")), a=("string", "ab"), b=("string", "abc")) == 0.0
    assert one(spark, text.levenshtein_similarity(F.col("a"), F.col("b")), a=("string", "é"), b=("string", "e")) == 0.0
    assert one(spark, text.word_jaccard(F.col("a"), F.col("b")), a=("string", ""), b=("string", "")) == 1.0


@pytest.mark.parametrize(("raw", "expected"), [("123 N. Main St., Apt 4", "123 NORTH MAIN STREET"), ("null", ""), (None, ""), ("5th ave # 9", "FIFTH AVENUE 9")])
def test_street(spark, raw, expected):
    assert one(spark, text.street(F.col("s")), s=("string", raw)) == expected


def test_small_normalisers(spark):
    s = F.col("s")
    assert one(spark, text.postal(s), s=("string", "62701-1234")) == "62701"
    assert one(spark, text.shard_prefix(s), s=("string", "7")) == "000"
    assert one(spark, text.state_code(s), s=("string", "new york")) == "NY"
    assert one(spark, text.e164(s), s=("string", "(212) 555-0101")) == "+12125550101"
    assert one(spark, text.company_suffix(s), s=("string", "Acme, Inc.")) == "Acme incorporated"
    assert one(spark, text.street_suffix(s), s=("string", "Oak Ave.")) == "Oak avenue"
    assert one(spark, text.address_key(s, s, s, s), s=("string", "Main St. 5")) == "MAIN ST 5|MAIN ST 5|MAIN ST 5|MAIN "
    assert one(spark, text.address_key(s, s, s, s, compat=True), s=("string", "Main St. 5")).startswith("M S 5|")
    assert one(spark, text.gate_tokens(s, acronyms=True), s=("string", "World Health Org")) == ["world", "health", "org", "wh"]
    assert one(spark, text.parse_answer(s, "m string"), s=("string", '```json\n{"m": "y"}\n```'))["m"] == "y"


@pytest.mark.parametrize(("raw", "day"), [("2024-03-01", "2024-03-01"), ("2024/03/01", "2024-03-01"), ("03/01/2024", "2024-03-01"), ("20240301", "2024-03-01"), ("2024", "2024-01-01"), ("soon", None), (None, None)])
def test_dates(spark, raw, day):
    got = one(spark, numbers.parse_date(F.col("d")), d=("string", raw))
    assert (str(got) if got else None) == day


def test_geo_and_temporal_gates_pass_what_is_missing(spark):
    df = spark.createDataFrame([(40.7128, -74.006, 40.7549, -73.984), (40.7128, -74.006, 34.05, -118.24), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    assert scoring.geo_gate(df, F.col("a"), F.col("b"), F.col("c"), F.col("d")).count() == 2


def test_weighted_score_skips_blank_fields(spark):
    docs = spark.createDataFrame([(1, "abcd", None), (2, "abcd", "x"), (3, None, None), (4, None, None)], "_key int, n string, z string")
    p = spark.createDataFrame([(1, 2), (3, 4)], "doc1_key int, doc2_key int")

    def scores(null):
        fields = [scoring.Field("n", 0.5, "levenshtein"), scoring.Field("z", 0.5, "levenshtein", null=null)]
        return {r["doc1_key"]: r["score"] for r in scoring.score_pairs(p, docs, fields, None).collect()}

    assert scores("skip") == {1: 1.0, 3: 0.0}
    assert scores("zero") == {1: 0.5, 3: 0.0}


def test_margin_is_to_the_second_best_of_either_end(spark):
    scored = spark.createDataFrame([("m4", "m9", 0.77), ("m4", "m2", 0.71)], "doc1_key string, doc2_key string, score double")
    assert {r["key"]: r["second"] for r in gates.margins(scored).collect()} == {"m4": 0.71, "m9": 0.0, "m2": 0.0}
    kept = gates.apply_gates(scored, gates.Gates(min_margin=0.02))
    assert pairs(kept) == [("m4", "m9")]


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, local):
    rows = [("1", "2", None), ("2", "3", False), ("3", "4", None), ("5", "6", None), ("7", "8", None), ("8", "9", None), ("4", "5", True), ("z", "z", None), (None, "q", None)]
    found = components.components(spark.createDataFrame(rows, "src string, dst string, suppressed boolean"), local_links=local)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    assert groups == {"1": {"1", "2", "3", "4"}, "5": {"5", "6"}, "7": {"7", "8", "9"}, "z": {"z"}}


@pytest.mark.parametrize("local", [0, 1000])
def test_a_long_chain_is_one_component(spark, local):
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = components.components(chain, local_links=local)
    assert found.count() == 201 and {r["root"] for r in found.collect()} == {0}


def test_edges_are_inserted_once_and_verdicts_hold(spark):
    scored = spark.createDataFrame([("b", "a", 0.5), ("a", "b", 0.9)], "doc1_key string, doc2_key string, score double")
    made = edges.make_edges(scored, "m", "t")
    assert [(r["src"], r["dst"], r["similarity"]) for r in made.collect()] == [("a", "b", 0.9)]
    assert edges.insert_edges(made, made).count() == 1
    said = spark.createDataFrame([("b", "a", "no_match", "1"), ("x", "y", "match", "1")], "key1 string, key2 string, decision string, created_at string")
    judged = {(r["src"], r["dst"]): (r["suppressed"], r["confirmed"]) for r in edges.apply_verdicts(made, said).collect()}
    assert judged == {("a", "b"): (True, False), ("x", "y"): (False, True)}


def test_repair_splits_at_the_weak_bridge_unless_confirmed():
    scores = {("a", "b"): 0.95, ("c", "d"): 0.93, ("b", "c"): 0.2}
    found = clusters.analyse(list("abcd"), scores, set())
    assert (found["status"], found["cut"], found["halves"]) == ("split", ("b", "c"), [["a", "b"], ["c", "d"]])
    assert clusters.analyse(list("abcd"), scores, {("b", "c")})["status"] == "queue"


def test_survivorship(spark):
    docs = spark.createDataFrame([("1", "Bob", "2024"), ("2", "Robert Smith", "2026"), ("3", "Bob", "2025")], "_key string, name string, at string")
    members = spark.createDataFrame([("c", k) for k in "123"], "cluster_id string, member_key string")
    values = fusion.long_values(members, docs, ["name"], recency="at")
    got = {s: fusion.survivors(values, s).first()["value"] for s in ("field_voting", "most_complete", "most_recent", "source_priority")}
    assert got == {"field_voting": "Bob", "most_complete": "Robert Smith", "most_recent": "Robert Smith", "source_priority": "Bob"}
    golden = fusion.golden_records(members, docs, ["name"])
    assert fusion.mark_stale(golden, members).first()["stale"] is False
    assert fusion.mark_stale(golden, members.filter("member_key != '3'")).first()["stale"] is True


def test_confusion_counts_missed_pairs(spark):
    schema = "doc1_key string, doc2_key string"
    scored = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 0.6), ("e", "f", 0.3)], schema + ", score double")
    found = evaluation.confusion(evaluation.labelled(scored, spark.createDataFrame([("a", "b"), ("f", "e")], schema)), 0.5).first()
    assert (found["tp"], found["fp"], found["fn"], found["precision"], found["recall"]) == (1, 1, 1, 0.5, 0.5)


def test_em_recovers_parameters_and_weights_equal_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    match = rng.random(20000) < 0.2
    m, u = np.array([0.95, 0.9, 0.85]), np.array([0.05, 0.1, 0.2])
    g = (rng.random((20000, 3)) < np.where(match[:, None], m, u)).astype(int)
    rows = spark.createDataFrame([(int(a), int(b), int(c), 1) for a, b, c in g], "g_a int, g_b int, g_c int, weight long")
    grouped = rows.groupBy("g_a", "g_b", "g_c").agg(F.sum("weight").alias("weight"))
    x, y = learning.em(rows, list("abc")), learning.em(grouped, list("abc"))
    assert abs(x.prior - 0.2) < 0.03 and all(abs(x.m[k] - v) < 0.05 for k, v in zip("abc", m, strict=True))
    assert abs(x.prior - y.prior) < 1e-9 and x.m == pytest.approx(y.m) and x.u == pytest.approx(y.u)


def test_chains_cycles_and_dangling(spark):
    rows = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")]
    found = {r["entity"]: (r["final"], r["status"]) for r in relations.resolve_chains(spark.createDataFrame(rows, "entity string, golden string")).collect()}
    assert found == {"a": ("c", "ok"), "b": ("c", "ok"), "x": (None, "cycle"), "y": (None, "cycle")}


def test_hyperplanes_repeat_and_more_tables_find_more(spark):
    import numpy as np

    assert (vectors.hyperplanes(2, 3, 8) == vectors.hyperplanes(2, 3, 8)).all()
    rng = np.random.default_rng(0)
    base = rng.normal(size=(2, 8))
    rows = [(i, (base[i % 2] + 0.1 * rng.normal(size=8)).tolist()) for i in range(10)]
    docs = spark.createDataFrame(rows, "_key int, v array<double>")
    few, many = (set(pairs(vectors.lsh_pairs(docs, "v", "_key", t, 8, dimension=8))) for t in (1, 6))
    assert few <= many and many
