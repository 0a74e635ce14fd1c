"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: every operator and stage."""

from __future__ import annotations

import io
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import bpe, components, decontaminate, fingerprints, language, logistic, pieces, quality, queries, repeats, simhash, toxicity, urls, wavelet
from kindred.llm.shared import shared_folder

LONG = " ".join(f"word{k % 977} über" for k in range(60_000))
#: The long passage, mid-line in two documents.
PASSAGE = "It stands between other words of a line here, long enough to count. And then goes on with one more sentence of many words. It ends only after this third one, which is no shorter at all."
TEXTS = [None, "", " \n\t ", "one", LONG, "a b c d e f g h", "a b c d e f g h", f"first some words {PASSAGE} and more", f"Other beginning. {PASSAGE} other end", "no letters: 12 34!", "<|endoftext|> mid <|endoftext|>", "naïve café\u00a0 ﬁn 漢字 😀"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, mark string, bucket string, key string, doc string, spans string, hits string, label string, score string, removed string, fingerprint string, words string"


def table(spark, texts, extra=()):
    data = [(k, t, "en" if k % 2 else "fr", None, None, 1, "m", "b", "k", "d", "s", "h", "l", "x", "r", "f", "w") for k, t in enumerate(texts)]
    return spark.createDataFrame([*data, *extra], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    """All texts, one row twice, one row without an id."""
    again = (5, TEXTS[5], "en", None, None, 1, "m", "b", "k", "d", "s", "h", "l", "x", "r", "f", "w")
    return table(spark, TEXTS, [again, (None, "a b c d e f g h", *again[2:])])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


def count(df):
    return len(df.collect())


# Pieces and BPE.


def test_pieces_are_those_of_the_library(path):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(path), pieces.Encoder(path, 1000)
    random.seed(5)
    alphabet = [*"ab 's\n\t'!  é9٣relvmd-²_", "<|endoftext|>", "'ll", " 's", "  ", "漢", "😀", "\u2003", "\u00a0"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(2000)]
    found, first = pieces.split(pa.array(texts), own.special)
    ids = own.ids(found.dictionary.to_pylist())
    codes = found.indices.to_numpy()
    got = [[int(i) for c in codes[a:b] for i in np.frombuffer(ids[c], "<u4")] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_classes_are_those_of_the_library(path):
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    table_ = pieces.classes()
    for c in [*range(0x250), *range(0x370, 0x110000, 397), 0x1C89, 0xA7DA, 0x10D40, 0x1E5F1, 0x3000, 0x2028]:
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            kind = pieces.LETTER if len(cut(f"a{x}a")) == 1 else pieces.NUMBER if len(cut(f"1{x}1")) == 1 else pieces.OTHER if len(cut(f"!{x}!")) == 1 else pieces.SPACE
            assert min(table_[c], pieces.SPACE) == kind, hex(c)


def test_parts_of_a_batch_give_its_pieces(path, monkeypatch):
    special = pieces.Encoder(path, 1000).special
    random.seed(9)
    texts = [random.choice([None, "", "", "a", " it's\u00a0né  \n", "  ", "'ll", "<|endoftext|>x<|endoftext|>", "漢字 12 ", "😀 over a part's end"]) for _ in range(3000)]
    for given in (texts, ["", None], ["", "a", ""], [LONG, "", LONG]):
        array = pa.array([None, *given], pa.string()).slice(1)
        monkeypatch.setattr(pieces, "PART_BYTES", 1 << 40)
        whole, at = pieces.split(array, special)
        for size in (1, 13, 400):
            monkeypatch.setattr(pieces, "PART_BYTES", size)
            found, first = pieces.split(array, special)
            assert found.cast(pa.binary()).equals(whole.cast(pa.binary())) and first.tolist() == at.tolist()


def test_cutting_needs_arrays_for_a_part_of_the_batch_only():
    array = pa.array([LONG] * 10)
    pieces.split(array.slice(0, 1))
    tracemalloc.start()
    try:
        pieces.split(array)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 5 * 10 * len(LONG.encode())


def test_each_piece_is_encoded_once(spark, path, monkeypatch):
    """Blocks that share their pieces: the tasks of the buckets encode the table's distinct pieces, each once."""
    folder = f"{shared_folder(spark)}/codes"
    own, met = pieces.Encoder(path, None), []
    monkeypatch.setattr(own, "_learn", lambda new: (met.extend(new), pieces.Encoder._learn(own, new)))
    monkeypatch.setattr(bpe.cut, "encoder", lambda *_: own)
    random.seed(2)
    words = [f" w{k}" for k in range(3000)]
    tables = [pa.table({"id": [k], "text": ["".join(random.choices(words, k=4000))]}) for k in range(6)]
    lists = [row for t in tables for b in bpe._split(folder, {}, 4)(t.to_batches()) for row in b.to_pylist()]
    for bucket in range(4):
        batches = pa.Table.from_pylist([r for r in lists if r["bucket"] == bucket]).to_batches(max_chunksize=2)
        assert sum(b.num_rows for b in bpe._encode(path)(batches)) == 6
    distinct = set(pieces.split(pa.array([t.column("text")[0].as_py() for t in tables]))[0].dictionary.to_pylist())
    assert len(met) == len(set(met)) == len(distinct) > 2500 and set(met) == distinct


def test_bpe_round_trip(docs, none, path):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["decoded"]) for r in bpe.decode(bpe.encode(docs, path), path).collect())
    assert got == sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in docs.collect())
    assert count(bpe.decode(bpe.encode(none, path), path)) == 0


def test_decoding_any_ids(spark, path):
    from tokenizers import Tokenizer

    ids = [[50256, 1, 220], [], [122, 163, 94], [30325]]
    rows = spark.createDataFrame([(k, i) for k, i in enumerate(ids)] + [(9, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(rows, path).collect()}
    assert got == {k: Tokenizer.from_file(path).decode(i, skip_special_tokens=False) for k, i in enumerate(ids)} | {9: ""}


# Wavelet matrix.


@pytest.mark.parametrize("n", [0, 1, 7, 300_000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 50257, n).astype("u4")
    ids[: n // 3] = 7
    m = wavelet.WaveletMatrix(wavelet.dump(ids, np.array([n]), pa.array([1]), 16))
    assert (m.all() == ids).all()
    for i in [0, n // 2, n - 1] if n else []:
        where = np.flatnonzero(ids == ids[i])
        assert m.access(i) == ids[i] and m.count(int(ids[i])) == len(where) and m.rank(int(ids[i]), i) == (where < i).sum()
        assert m.select(int(ids[i]), int((where < i).sum())) == i and (m.locate(int(ids[i])) == where).all()
    assert m.count(50258) == 0 and len(m.locate(50258)) == 0
    with pytest.raises(IndexError):
        m.access(n)


def test_an_access_reads_a_few_blocks_of_the_file():
    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            found = super().read(n)
            Counted.read_bytes += len(found)
            return found

    ids = np.random.default_rng(1).integers(0, 50257, 1 << 21).astype("u4")
    raw = wavelet.dump(ids, np.array([len(ids)]), pa.array([1]), 16)
    m = wavelet.WaveletMatrix(pa.PythonFile(Counted(raw), mode="r"))
    assert m.access(1_500_000) == ids[1_500_000] and Counted.read_bytes < len(raw) / 3


def test_token_files(spark, docs, none, path):
    folder = f"{shared_folder(spark)}/t"
    got = wavelet.read(wavelet.write(docs, folder, path, 2), folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 4, 5, 5, *range(6, 12)]
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    assert all(np.frombuffer(r["ids"], "<u4")[-1] == 2 for r in got)
    assert count(wavelet.read(wavelet.write(none, f"{folder}2", path, 2), f"{folder}2")) == 0


# Fingerprints.


def test_spans_and_extensions_by_brute_force():
    random.seed(1)
    for _ in range(60):
        a, b = ("".join(random.choices("abé", k=random.randint(0, 40))) for _ in "ab")
        x, y = fingerprints.Prefixes.of(a), fingerprints.Prefixes.of(b)
        for _ in range(10):
            i, j, n = random.randint(0, len(a)), random.randint(0, len(b)), random.randint(0, 6)
            assert x.equal(i, y, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
            longest = next(k for k in range(len(a) + len(b) + 1) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k])
            assert x.extension(i, y, j) == longest


def test_next_documents(spark, docs, none):
    got = fingerprints.with_next(docs).collect()
    assert len(got) == len(TEXTS) + 2 and count(fingerprints.with_next(none)) == 0
    same = {r["fingerprint"] for r in got if r["n_chars"] == 15}
    assert len(same) == 1
    order = spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    by = {b: sorted(map(tuple, fingerprints.with_next(order, b).collect())) for b in (1, 3, 400)}
    assert by[1] == by[3] == by[400]


# Near duplicates, components.


def test_simhash_cases(docs, none):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.link(docs).collect()}
    assert got[0, 0] == got[1, 0] == got[2, 0] == 0
    five = {c for (d, f), c in got.items() if d in (5, 6) or d is None}
    assert five == {5} and count(simhash.link(none)) == 0 and count(simhash.near_duplicates(none)) == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_ball_links_reach_two_bits(spark, bits):
    rng = np.random.default_rng(bits)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 20)]
    flipped = [b ^ sum(1 << int(k) for k in rng.choice(62, bits, replace=False)) for b in base]
    rows = spark.createDataFrame([(x,) for x in {*base, *flipped}], "fingerprint long")
    links = {frozenset((r["a"], r["b"])) for r in simhash.ball_links(rows, 2).collect()}
    assert links == ({frozenset(p) for p in zip(base, flipped, strict=True)} if 0 < bits <= 2 else set())


def test_near_copies_go_and_clean_documents_stay(spark):
    random.seed(9)
    vocabulary = ["".join(random.choices("abcdefghij", k=6)) for _ in range(3000)]
    clean = [" ".join(random.choices(vocabulary, k=300)) for _ in range(60)]
    copies = []
    for k in range(200):
        words = clean[k % 20].split()
        for _ in range(4):
            words[random.randrange(300)] = random.choice(vocabulary)
        copies.append(" ".join(words))
    docs = table(spark, [*clean, *copies, *clean[:3]])
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert set(range(60)) <= kept and len(kept) <= 62


def test_components_by_brute_force(spark):
    random.seed(4)
    pairs = [(random.randint(0, 150), random.randint(0, 150)) for _ in range(110)] + [(k, k + 1) for k in range(300, 400)] + [(500, k) for k in range(501, 600)]
    root = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r} and count(components.components(spark.createDataFrame([], "a long, b long"))) == 0


# Substrings.


def test_embedded_passages_go(docs, none):
    got = {r["doc_id"]: r for r in repeats.remove(docs).collect()}
    assert "more sentence of many words" in got[7]["text"] and "more sentence of many words" not in got[8]["text"]
    assert got[8]["text"].startswith("Other beginning.") and got[0]["text"] is None and got[4]["text"] == LONG.strip() or got[4]["removed"]
    assert count(repeats.remove(none)) == 0


def test_equal_rows_of_one_id_are_one_document(spark):
    text = "one two three four five six seven eight nine."
    docs = table(spark, [text, text])
    both = docs.filter("doc_id = 0").union(docs.filter("doc_id = 0"))
    assert [r["text"] for r in repeats.remove(both).collect()] == [text, text]
    assert sorted(r["text"] for r in repeats.remove(docs).collect()) == ["", text]


# Decontamination.


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_scan_by_brute_force(spark, part_bytes):
    random.seed(7)
    alphabet = "a b c d é F9".split()
    texts = [" ".join(random.choices(alphabet, k=random.randint(0, 40))) + random.choice(["", "!", ". x"]) for _ in range(120)] + [None, ""]
    items = [(k, " ".join(random.choices(alphabet, k=random.choice([0, 1, 2, 7, 8, 9, 20])))) for k in range(10)] + [(None, "a b"), (11, None)]
    fold = lambda t: [w.lower() for w in (t or "").replace("!", " ").replace(".", " ").split()]
    windows = {}
    for k, t in items:
        w = fold(t)
        for i in range(max(1, len(w) - 7) if w and k is not None else 0):
            windows.setdefault(tuple(w[i : i + 8]), set()).add(str(k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc"]["doc_id"]: r for r in decontaminate.scan(table(spark, texts), bench, part_bytes=part_bytes).collect()}
    for k, t in enumerate(texts):
        w, hit, names = fold(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    names |= found
                    hit.update(range(i, i + n))
        assert (got[k]["n_words"], got[k]["hits"], got[k]["items"]) == (len(w), sorted(hit), sorted(names))


def test_spans_are_cut_and_full_copies_go(spark, docs, none):
    item = "the quick brown fox jumps over the lazy dog und Öl"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    mixed = table(spark, [f"Bevor – {item} – danach kommen noch einige andere Wörter", item, "unrelated", None])
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(mixed, bench).collect()}
    assert got == {0: "Bevor –  – danach kommen noch einige andere Wörter", 2: "unrelated", 3: None}
    assert count(decontaminate.decontaminate(none, bench)) == 0
    assert count(decontaminate.decontaminate(docs, bench.limit(0))) == len(TEXTS) + 2


# Models.


def test_language_cases(spark, docs, none):
    names, prototypes = language.learn(docs)
    got = {r["doc"]["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, names, prototypes).collect()}
    assert names == ["en", "fr"] and got[0] == got[1] == got[2] == ("und", 0.0) and got[11][0] in names
    nothing = language.learn(none)
    assert nothing[0] == [] and {r["lang_pred"] for r in language.predict(docs, *nothing).collect()} == {"und"}
    assert count(language.predict(none, names, prototypes)) == 0


def test_letters_vectors_are_nearly_orthogonal_and_repeat():
    a, b = language.Grams(1024, 3), language.Grams(1024, 3)
    assert (a.letter(97) == b.letter(97)).all() and abs(int(a.letter(97).astype(int) @ a.letter(98).astype(int))) < 200
    text, keys = "ab", language.gram_keys("ab", 3)
    assert (language.bundle([text], a)[0][0] == sum(a.vector(int(k)).astype(float) for k in keys)).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_models_of_nothing_and_of_one_class(spark, docs, module):
    schema = "id long, label int, text string"
    for rows in ([], [(1, 1, "only one class"), (2, 1, "only one class")]):
        scored = module.score(docs, module.fit(spark.createDataFrame(rows, schema)), ["doc_id"]).collect()
        assert len(scored) == len(TEXTS) + 2 and all(0 <= r["score"] <= 1 for r in scored)
    assert count(module.score(docs.limit(0), module.fit(spark.createDataFrame([], schema)), ["doc_id"])) == 0


def test_grammar_patterns():
    g = toxicity.grammar()
    I, H, T, N, R, O, E = toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.OTHER, toxicity.END  # noqa: E741, N806
    lone = toxicity.LONE
    at = lambda k, *symbols: round(g.run(symbols)[k] / lone, 6)
    assert at(2, T, O, I) == 1.5 and at(2, T, E, I) == 1.0
    assert at(2, N, O, I) == 0.6 and at(4, N, O, O, O, I) == 1.0
    assert at(5, R, O, O, O, O, I) == 0.8
    assert g.run([I, O, I])[2] == 1.0 and g.run([I, E, E, E, I])[4] == lone and g.run([I, E, E, I])[3] == 1.0
    assert g.run([H, T])[1] == 1.0 and g.run([O, T])[1] == 0.0 and g.run([H, E, T])[2] == 0.0
    score = lambda t: toxicity.score_batch(pa.array([t]), toxicity.Lexicon({}, {}), g)[0][1]
    assert score("nice words") == 0
    assert score("I will kill you") == 1.0 and score("I will kill time") == 0.0


#: The first of each pair is the more toxic; both have the same insults and threats.
PAIRS = [
    ("You are an idiot.", "There was an idiot."),
    ("You are an idiot.", "You are not an idiot."),
    ("He is a moron, and a clown.", "He is a moron. So they went. The day was long. It rained. A clown came."),
    ("What a pathetic loser.", "Critics said what a pathetic loser."),
    ("They will kill you.", "They will never kill you."),
    ("I will kill you.", "I will kill time."),
    ("Du bist dumm, Dummkopf.", "Du bist nicht dumm. Morgen. Abend. Nacht. Dummkopf."),
]


def test_the_grammar_orders_what_its_words_do_not():
    """With all weights 1 these pairs tie or change places."""
    texts = [t for pair in PAIRS for t in pair]
    flat = toxicity.compose(toxicity.window(toxicity.TARGET, 3, {}), toxicity.again(3, 1.0))
    score = lambda m: toxicity.score_batch(pa.array(texts), toxicity.Lexicon({}, {}), m)[:, 1].reshape(-1, 2)
    full = score(toxicity.grammar())
    assert (full[:, 0] > full[:, 1]).all(), full
    without = score(flat)
    # A threat without a target is none in either.
    assert all(a <= b for (a, b), pair in zip(without, PAIRS, strict=True) if "kill time" not in pair[1])


def test_learnt_words_are_whole_words_or_long_stems(spark):
    """Words that merely begin like an insult are none; seeds of other kinds keep theirs."""
    rows = [(k, k % 2, "You are a worthless pathetic idiot, never said better, scumbagging." if k % 2 else "The pathway is worthwhile, path worth idiom.") for k in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows, "id long, label int, text string"))
    own = toxicity.Lexicon(*model["lexicon"])
    clean = "The pathway through the park is worthwhile and worthy. Idiomatic clownfish trashes, they never said."
    got = toxicity.score_batch(pa.array([clean, "A pathetically worthless scumbagged idiot."]), own, model["machine"])
    assert not got[0].any() and got[1][1] > 0
    assert own.read([b"you", b"never", b"said", b"kill"])[0].tolist() == [toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.THREAT]


def test_logistic_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    p = logistic.apply(logistic.fit(x, y), x)
    assert abs(p.mean() - y.mean()) < 0.01 and abs(p[p > 0.8].mean() - y[p > 0.8].mean()) < 0.05


# Pages.


def test_url_cases(spark):
    rows = ["http://A.Example.COM/en/x?y", "https://www.example.com/en/", "no scheme", None, "ftp://x.net/es/1#f", "http://x.net", "x://net/fr/a/b/c/d/e/f", "http://q.org/p/1", "http://q.org/p/1"]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame([(k, u, "h") for k, u in enumerate(rows)], "page_id long, url string, host string")).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(7)] == [("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("", "", None), ("", "", None), ("x.net", "/es/1", "net/es/"), ("x.net", "", None), ("net", "/fr/a/b/c/d/e/f", "net/fr/")]
    assert got[6]["template"] == "/fr/a/b/c/**" and got[7]["template"] == "/p/*" and got[7]["verdict"] == got[8]["verdict"] == "allow"
    assert count(urls.judge(spark.createDataFrame([], "page_id long, url string"))) == 0


def test_impure_templates_are_rejected(spark):
    """A host whose labelled pages of one template are mostly blocked rejects the template's other pages."""
    rules = (urls.Rule("block", "h.org", "/bad/x"), urls.Rule("allow", "h.org", "/good/x"))
    rows = [f"http://h.org/bad/x{k}" for k in range(30)] + [f"http://h.org/good/x{k}" for k in range(30)] + ["http://h.org/bad/9", "http://h.org/good/9", "http://other.org/bad/9"]
    got = [r["verdict"] for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).orderBy("page_id").collect()]
    assert got[-3:] == ["block", "allow", "allow"]


# The pipeline.


def test_stages_take_any_rows(spark, docs, none, sf_dir):
    for texts in (docs, none):
        now = texts
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before, now = now, stage(spark, now, sf_dir)
            rows = now.collect()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == before.columns, name
            now = spark.createDataFrame(rows, now.schema)
    kept = {r["doc_id"] for r in rows}
    assert kept == set()


def test_what_each_stage_decides(spark, docs, sf_dir):
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert not {0, 1, 2} & set(ids) and {4, 5, 6, 7, 8} <= set(ids)
    left = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, kept, sf_dir).select("doc_id").collect()]
    assert 6 not in left and 5 in left


def test_encoding_has_one_python_worker_a_task(spark, docs, none, path, sf_dir):
    """Two Python steps of one stage would be two workers, which stay with the executor after it."""
    stage = corpus_pipeline.encoding(spark, docs, sf_dir)
    plan = [line for line in stage._jdf.queryExecution().executedPlan().toString().splitlines() if "MapInArrow" in line or "Exchange" in line]
    assert all("Exchange" in below for line, below in zip(plan, plan[1:], strict=False) if "MapInArrow" in line), plan
    two = bpe.decode(bpe.encode(docs, path), path)
    one = bpe.round_trip(docs, path)
    assert one.schema == two.schema
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    assert count(bpe.round_trip(none, path)) == 0


def test_whole_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    documents = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    got = [r["doc_id"] for r in found.collect()]
    assert set(got) < documents and len(got) == len(set(got)) > 0.8 * len(documents)
