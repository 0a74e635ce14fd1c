"""Cases that a candidate rule or an estimate could lose: each is held against exact similarities or planted passages."""

from __future__ import annotations

import random

from kindred.llm import repeats, simhash


def vocabulary(rng, n=5000):
    return ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]


def edited(rng, words, names, changes):
    out = list(words)
    for at in rng.sample(range(len(words)), changes):
        out[at] = rng.choice(names)
    return " ".join(out)


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def kept(spark, texts):
    return {r["doc_id"] for r in simhash.deduplicate(table(spark, texts)).select("doc_id").collect()}


def test_star_of_many_copies(spark):
    """Copies that are alike to one original and not to each other, which meet in large buckets."""
    rng = random.Random(3)
    names = vocabulary(rng)
    original = rng.choices(names, k=300)
    copies = [edited(rng, original, names, 6) for _ in range(600)]
    near = {k + 1 for k, c in enumerate(copies) if jaccard(" ".join(original), c) >= 0.8}
    assert len(near) > 500 and not near & kept(spark, [" ".join(original), *copies])


def test_lone_pairs_at_the_threshold(spark):
    rng = random.Random(6)
    names, texts, want = vocabulary(rng, 20000), [], set()
    while len(texts) < 240:
        words = rng.choices(names, k=1000)
        pair = [" ".join(words), edited(rng, words, names, rng.choice([21, 22, 23, 24, 25]))]
        if 0.78 <= (s := jaccard(*pair)) < 0.82:
            texts += pair
            want |= {len(texts) - 2} | ({len(texts) - 1} if s < 0.8 else set())
    assert kept(spark, texts) == want


def test_texts_of_one_fingerprint_stay(spark):
    rng = random.Random(5)
    names = vocabulary(rng)
    texts = [" ".join([*rng.choices(names, k=200), *["again"] * 260]) for _ in range(20)]
    assert kept(spark, texts) == set(range(20))


def test_repeats_within_a_text_do_not_hide_copies(spark):
    rng = random.Random(4)
    names, texts = vocabulary(rng), []
    for _ in range(30):
        body, line = " ".join(rng.choices(names, k=200)), " ".join(rng.choices(names, k=11))
        texts += [" ".join([body, *[line] * n]) for n in (2, 20, 60)]
    assert kept(spark, texts) == {k for k in range(90) if k % 3 == 0}


def test_short_lines_are_units(spark):
    rng = random.Random(7)
    names = vocabulary(rng)
    passage = "\n".join(" ".join(rng.choices(names, k=6)) for _ in range(10))
    texts = [f"{' '.join(rng.choices(names, k=20))}\n{passage}\n{' '.join(rng.choices(names, k=20))}\nAll rights reserved." for _ in range(3)]
    got = [r["text"] for r in repeats.remove(table(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == texts[0]
    for text, left in zip(texts[1:], got[1:], strict=True):
        lines = text.split("\n")
        assert left.split() == " ".join([lines[0], lines[-2]]).split()
