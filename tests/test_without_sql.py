"""The queries that SQL does not say, and helpers of them, against brute force or published codes."""

from __future__ import annotations

import collections
import itertools
import re

import numpy as np
import pytest

from kindred.functions import names
from kindred.operators import clusters, relations, search, vectors
from kindred.queries import queries
from kindred.queries.clustering import part_edges, part_members
from kindred.queries.pairs import part_pairs

xxhash = pytest.importorskip("xxhash")
QUERIES = queries()
#: Larger than the other tests' tables: clusters of several members.
LARGER = "/root/testdata/sf0.01"
#: Each has a test below.
HELD = {"cluster_repair", "feature_comparator", "node_embeddings", "phonetic_codes", "record_embeddings"}


def spark_hash(*values: str | int) -> int:
    """Spark's xxhash64 of texts and ints: each value's hash is the next one's seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(4, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def test_every_query_is_held_by_sql_or_here():
    from kindred.queries import oracle_sql

    assert set(QUERIES) - set(oracle_sql()) == HELD


@pytest.mark.parametrize(("word", "code"), [("Worthy", "WARTY"), ("Ogata", "OGAT"), ("montgomery", "MANTGANARY"), ("Costales", "CASTAL"), ("Tu", "T"), ("martincevic", "MARTANCAFAC"), ("Catherine", "CATARAN"), ("Katherine", "CATARAN"), ("Johnathan", "JANATAN"), ("mitchell", "MATCAL"), ("macintosh", "MCANT"), ("knight", "NAGT"), ("", "")])
def test_nysiis(word, code):
    assert names.nysiis(word) == code


@pytest.mark.parametrize(("word", "code"), [("Byrne", "BYRN"), ("Boern", "BRN"), ("Smith", "SMTH"), ("Smyth", "SMYTH"), ("Catherine", "CTHRN"), ("Kathryn", "KTHRYN"), ("Ad", "AD"), ("Ernestine", "ERNSTN"), ("", "")])
def test_match_rating(word, code):
    assert names.match_rating(word) == code


@pytest.mark.parametrize(("word", "code"), [("metaphone", "MTFN"), ("Thumb", "0M"), ("knight", "NT"), ("Wright", "RT"), ("Philip", "FLP"), ("Xavier", "SFR"), ("judge", "JJ"), ("", "")])
def test_metaphone(word, code):
    assert names.metaphone(word) == code


def test_phonetic_codes(spark, sf_dir):
    got = {r["n_nationkey"]: r for r in QUERIES["phonetic_codes"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect():
        own = got.pop(r["n_nationkey"])
        for kind in ("metaphone", "nysiis", "match_rating"):
            assert own[kind] == " ".join(filter(None, map(getattr(names, kind), r["n_name"].split())))
    assert not got


def _jaro(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    reach, used, left = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == x), None)
        if j is not None:
            used.add(j)
            left.append(x)
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(left, sorted(used), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def _winkler(a: str, b: str) -> float:
    a, b = a.strip().lower(), b.strip().lower()
    s = 1.0 if a == b else _jaro(a, b)
    common = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a[:4], b[:4], strict=False))))
    return s + (0.1 * common * (1 - s) if s >= 0.7 else 0)


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _levenshtein(a: str, b: str) -> float:
    a, b = a.strip().upper(), b.strip().upper()
    return 1 - _edits(a, b) / max(len(a), len(b))


def _grams(a: str, b: str) -> float:
    a, b = a.strip().lower(), b.strip().lower()
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    return 1.0 if a == b else len(x & y) / len(x | y) if len(a) >= 3 and len(b) >= 3 else 0.0


def _soundex(a: str) -> str:
    a = a.strip().upper()
    codes = {c: str(i + 1) for i, group in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R")) for c in group}
    digits = [codes[c] for c in a[1:] if c in codes]
    return (a[0] + "".join(k for k, _ in itertools.groupby(digits)) + "000")[:4]


def test_feature_comparator(spark, sf_dir):
    parts = {r["p_partkey"]: r for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    got = QUERIES["feature_comparator"](spark, sf_dir).collect()
    assert len(got) == part_pairs(spark, sf_dir).count() > 0
    measures = {"ngram": _grams, "levenshtein": _levenshtein, "jaro_winkler": _winkler, "phonetic": lambda a, b: float(_soundex(a) == _soundex(b)), "exact": lambda a, b: float(a.strip().lower() == b.strip().lower())}
    columns = {"name": "p_name", "last_name": "p_name", "first_name": "p_brand", "company": "p_type", "email": "p_brand"}
    seen = set()
    for r in got:
        a, b = parts[r["doc1_key"]], parts[r["doc2_key"]]
        for name in set(r.asDict()) - {"doc1_key", "doc2_key"}:
            kind = next(k for k in measures if name.endswith(k))
            c = columns[name[: -len(kind) - 1]]
            assert abs(r[name] - measures[kind](a[c], b[c])) < 6e-5, (name, a[c], b[c])
            seen.add(name)
    assert len(seen) >= 10


def test_record_embeddings(spark, sf_dir):
    for r in QUERIES["record_embeddings"](spark, sf_dir).collect():
        v = np.zeros(16)
        for w in set(re.findall("[a-z0-9]+", r["text"].lower())):
            v[spark_hash(w) % 16] += -1.0 if spark_hash(w, 1) % 2 == 0 else 1.0
        size = np.linalg.norm(v)
        assert np.allclose(r["vector"], v / size if size else v), r["text"]


def test_walks_and_node_embeddings(spark):
    """Walks go along edges; vectors are those of the walks' co-occurrences."""
    edges = part_edges(spark, LARGER)
    near = {(r["src"], r["dst"]) for r in edges.collect()}
    near |= {(b, a) for a, b in near}
    walks = collections.defaultdict(dict)
    for r in relations.random_walks(edges, 6, 3).collect():
        walks[r["walk"]][r["step"]] = r["node"]
    counts = collections.defaultdict(collections.Counter)
    for w in walks.values():
        assert sorted(w) == list(range(6)) and all((w[i], w[i + 1]) in near for i in range(5))
        for i, j in itertools.combinations(range(6), 2):
            if j - i <= 3 and w[i] != w[j]:
                counts[w[i]][w[j]] += 1
                counts[w[j]][w[i]] += 1
    got = {r["node"]: np.array(r["vector"]) for r in QUERIES["node_embeddings"](spark, LARGER).collect()}
    assert set(got) == set(counts) and len(got) > 10
    for node, others in counts.items():
        v = sum(np.log1p(n) * np.array([-1.0 if spark_hash(o, k, 42) % 2 == 0 else 1.0 for k in range(1, 17)]) for o, n in others.items())
        size = np.linalg.norm(v)
        assert np.allclose(got[node], v / size if size > 1e-9 else v, atol=1e-6), node


def _halves(keys, pairs):
    root = {k: k for k in keys}
    for _ in keys:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    out = collections.defaultdict(set)
    for k in keys:
        x = k
        while root[x] != x:
            x = root[x]
        out[x].add(k)
    return list(out.values())


def _dense(keys, pairs):
    n = len(keys) * (len(keys) - 1) / 2
    return 1.0 if not n else sum(a in keys and b in keys for a, b in pairs) / n


def test_cluster_repair(spark):
    scores = {tuple(sorted((r["src"], r["dst"]))): r["similarity"] for r in part_edges(spark, LARGER).collect()}
    members = collections.defaultdict(set)
    for r in part_members(spark, LARGER).collect():
        members[r["cluster_id"]].add(r["member_key"])
    got = {r["cluster_id"]: r for r in QUERIES["cluster_repair"](spark, LARGER).collect()}
    assert set(got) == set(members)
    for c, keys in members.items():
        own = {p: s for p, s in scores.items() if p[0] in keys}
        mean, status = sum(own.values()) / len(own), "queue"
        if mean >= 0.9 and not (min(own.values()) < 0.5 * mean and _dense(keys, own) < 1):
            status = "ok"
        else:
            for pair in sorted((p for p in own if own[p] < 0.9), key=lambda p: (own[p], p)):
                parts = _halves(keys, set(own) - {pair})
                if len(parts) == 2 and all(_dense(p, own) > _dense(keys, own) for p in parts):
                    status = "split"
                    assert (got[c]["cut_src"], got[c]["cut_dst"]) == pair
                    assert {frozenset(got[c]["half_a"]), frozenset(got[c]["half_b"])} == set(map(frozenset, parts))
                    break
        assert got[c]["status"] == status


def test_repair_reads_clusters_of_any_size(spark):
    """Beyond most members a coherent cluster is still ok; only one whose edges would have to be tried is queued unread."""
    edges = [(f"a{i}", f"a{i + 1}", 0.95) for i in range(9)] + [(f"b{i}", f"b{i + 1}", 0.3) for i in range(9)]
    members = [(k[0], k, 10) for k in {x for e in edges for x in e[:2]}]
    e = spark.createDataFrame([(*x, False, False) for x in edges], "src string, dst string, similarity double, suppressed boolean, confirmed boolean")
    m = spark.createDataFrame(members, "cluster_id string, member_key string, size long")
    got = {r["cluster_id"]: (r["status"], r["reason"]) for r in clusters.repair(m, e, most=5).collect()}
    assert got == {"a": ("ok", ""), "b": ("queue", "too_large")}


def test_crowded_buckets_are_parted(spark):
    rng = np.random.default_rng(3)
    crowd = rng.normal(size=8) + 0.05 * rng.normal(size=(120, 8))
    rows = np.concatenate([crowd, rng.normal(size=(40, 8))])
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "_key long, v array<double>")
    size = vectors.bucket_sizes(docs, "v", "_key", 2, 4, dimension=8).first()
    few, many = (vectors.lsh_pairs(docs, "v", "_key", 2, 4, dimension=8, most=m).count() for m in (50, None))
    assert size["largest"] >= 100 and few < many <= size["pairs"]
    assert vectors.planes_for(64) == 4 and vectors.planes_for(64 << 20) == 21
    with pytest.raises(ValueError):
        vectors.knn_pairs(docs, "v", "_key")
    with pytest.raises(KeyError):
        vectors.nearest_to(docs, 10_000, "v", "_key")


def test_bm25_of_given_pairs(spark):
    docs = spark.createDataFrame([(1, "red steel"), (2, "red steel bolt"), (3, "blue tin"), (4, None)], "k long, t string")
    pairs = search.phrase_pairs(docs, "t", "k", threshold=-10.0)
    assert [(r["doc1_key"], r["doc2_key"]) for r in pairs.collect()] == [(1, 2)]
    assert search.phrase_pairs(docs, "t", "k", -10.0, filters={"t": {"min_length": 9}}).count() == 0


def test_linking_recall(spark):
    """Names with one letter wrong, moved or missing: how many best matches meet at a first pair of letters or a word."""
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), n)) for n in rng.integers(4, 9, 80)]
    known = sorted({" ".join(rng.choice(pool, 2, replace=False)) for _ in range(150)})
    asked = []
    for k in range(200):
        name = list(known[rng.integers(len(known))])
        at = int(rng.integers(len(name) - 1))
        name[at : at + 1] = [["x"], [], [name[at], "y"]][k % 3]
        asked.append("".join(name))
    e = spark.createDataFrame(list(enumerate(known)), "entity_key long, name string")
    m = spark.createDataFrame(list(enumerate(asked)), "mention_id long, name string")
    got = {r["mention_id"]: r["similarity"] for r in relations.link_names(m, e).collect()}
    best = [max(names.jaro_winkler(a, k) for k in known) for a in asked]
    found = [got.get(i, 0) >= round(b, 4) - 1e-9 for i, b in enumerate(best) if b >= 0.7]
    assert np.mean(found) >= 0.97


def test_crowded_beginnings_ask_for_more_letters(spark):
    from kindred.streaming import incremental

    docs = spark.createDataFrame([(i, f"smith{i % 3} n{i}") for i in range(30)] + [(100, "jones a"), (101, "jones b")], "_key long, name string")
    new = spark.createDataFrame([(200, "smith1 n1"), (201, "jones a")], "_key long, name string")
    sizes = {r["p"]: r["pairs"] for r in incremental.meeting_sizes(new, docs, ["name"]).collect()}
    assert sizes == {"smi": 30, "jon": 2}
    every, few = (incremental.resolve(new, docs, ["name"], threshold=0.0, top=100, most=m).collect() for m in (None, 10))
    assert len(every) == 32 and {r["doc_key"] for r in few if r["record_key"] == 200} == set(range(1, 30, 3))
    assert {r["doc_key"] for r in few if r["record_key"] == 201} == {100, 101}
    best = [r["doc_key"] for r in few if r["rank"] == 1]
    assert sorted(best) == [1, 100]


def test_adaptive_verifier(spark, tmp_path):
    from pyspark.sql import functions as F

    from kindred.operators.feedback import AdaptiveVerifier

    scored = spark.createDataFrame([(i, i + 1000, 0.6 + i / 400) for i in range(100)], "doc1_key long, doc2_key long, score double")

    def model(asked):
        return asked.select("doc1_key", "doc2_key", F.when(F.col("doc1_key") % 10 == 0, None).when(F.col("score") > 0.7, "match").otherwise("no_match").alias("verdict"), F.lit(0.9).alias("confidence"))

    v = AdaptiveVerifier(spark, f"{tmp_path}/verdicts", every=30)
    got = {r["doc1_key"]: r["review"] for r in v.review(scored, model).collect()}
    assert got[5] == "no_match" and got[55] == "match"
    stored = spark.read.parquet(f"{tmp_path}/verdicts")
    assert stored.count() == 90 and stored.filter("doc1_key % 10 = 0").count() == 0
    assert v.since == 0 and 0.68 < v.low < 0.75 and v.high > v.low


def test_locks_exports_and_commands(spark, tmp_path, sf_dir, capsys):
    import json

    from kindred.__main__ import main
    from kindred.operators import locks
    from kindred.operators.advisor import Export

    with locks.lock(spark, f"file://{tmp_path}", "cluster 7"):
        with pytest.raises(locks.Locked), locks.lock(spark, f"file://{tmp_path}", "cluster 7"):
            pass
        with locks.lock(spark, f"file://{tmp_path}", "cluster 8"):
            pass
    with locks.lock(spark, f"file://{tmp_path}", "cluster 7"):
        pass
    address = Export({"b": 1, "a": [2]}).write(spark, f"file://{tmp_path}/x")
    with open(address.removeprefix("file:").replace("//", "/")) as f:
        assert json.load(f) == {"a": [2], "b": 1}
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"blocking_fields": ["p_brand", "p_type"], "fields": [["p_name", 1.0, "levenshtein"]], "key": "p_partkey", "threshold": 0.8, "most_block": 1000}))
    assert main(["check", str(config)]) == 0 and main(["list"]) == 0 and "golden_records" in capsys.readouterr().out
    assert main(["link", str(config), f"{sf_dir}/part.parquet", "--out", f"{tmp_path}/out"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["edges"] == spark.read.parquet(f"{tmp_path}/out/edges").count() > 0
    assert main(["query", "none", sf_dir]) == 1
