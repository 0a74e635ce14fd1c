"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, threat, target, negation, report (of another's speech), other, and the end of a
clause. Small transducers each know one pattern and answer a symbol with a weight: an insult counts for more near a
target, and for less if no other came in the clauses before it; a threat counts only with a target after it; negation
shortly before damps; a report damps the rest of its clause. compose() makes one machine of them, whose states are
tuples of theirs and whose weights are products. Clauses are scored by that machine: the sum, over insults and threats
matched, of the word's own weight times the weight of the path that led there. All features are made of clause scores:
a document's greatest, their total, and the total in proportion to its words. They are calibrated to a probability.

A lexicon of insults beyond the seed words is learnt from labelled rows: whole words, and stems of STEMS letters, found
far more often in toxic texts. A stem does not stand for words that other texts hold about as often. The lexicon has
MOST_ENTRIES entries at most, the most telling first; rows are SAMPLE at most. Nothing learnt takes the place of a seed
that is a threat, a target, a negation or a report.

Defined cases: null and empty texts have no clause and score as such; texts of any length are read whole, a few
megabytes at a time but never cut; ties between lexicon entries go by the word; with nothing to learn from the seed
words remain and scores are constant but for them; repeated rows score alike; columns but the text and those carried are
not read, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import logistic
from .decontaminate import words_of
from .shared import keep, prepare, slices

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
SYMBOLS = 7
SAMPLE = 20_000
MOST_ENTRIES = 20_000
#: Letters of a stem.
STEMS = (6, 7, 8)
#: Clauses for which an insult is remembered, and the weight of one that no other came before.
MEMORY, LONE = 3, 0.6

SEEDS: dict[int, str] = {
    INSULT: "idiot moron stupid scum trash loser pathetic worthless disgusting clown dumb fool jerk creep pig imbécile crétin connard idiote stupide trottel dummkopf arschloch versager abschaum estúpido imbécil basura escoria",
    THREAT: "kill hurt destroy smash beat stab shoot burn crush murder tuer frapper détruire töten schlagen vernichten matar golpear destruir",
    TARGET: "you your yours they them he she him her tu toi vous ton votre du dich dir ihr euch dein tú usted ustedes te vosotros",
    NEGATION: "not never no neither nor cannot isn aren wasn don doesn didn ne pas jamais nicht nie kein keine nunca tampoco ningún",
    REPORT: "said says told claimed called wrote quoted reported according dit disait déclaré écrit sagte sagt behauptete schrieb laut dijo dice afirmó escribió según",
}


@dataclass(frozen=True)
class Transducer:
    """Deterministic: step[state][symbol] is (next state, weight); state 0 is the start."""

    step: tuple[tuple[tuple[int, float], ...], ...]

    def run(self, symbols: Iterable[int]) -> list[float]:
        state, out = 0, []
        for s in symbols:
            state, weight = self.step[state][s]
            out.append(weight)
        return out


def _machine(states: int, rule) -> Transducer:
    return Transducer(tuple(tuple(rule(q, s) for s in range(SYMBOLS)) for q in range(states)))


def window(trigger: int, size: int, weights: dict[int, float]) -> Transducer:
    """For size symbols after a trigger the weights hold; a clause's end forgets it."""

    def rule(q: int, s: int) -> tuple[int, float]:
        weight = weights.get(s, 1.0) if q else 1.0
        return (0 if s == END else size if s == trigger else max(0, q - 1)), weight

    return _machine(size + 1, rule)


def report(damping: float) -> Transducer:
    """After a report the rest of the clause is damped."""
    return _machine(2, lambda q, s: (0 if s == END else 1 if s == REPORT or q else 0, damping if q and s in (INSULT, THREAT) else 1.0))


def threat(size: int) -> Transducer:
    """A threat counts by the target that comes at most size symbols after it: the weight is given at the target."""

    def rule(q: int, s: int) -> tuple[int, float]:
        if s == TARGET:
            return 0, (1.0 if q else 0.0)
        return (0 if s == END else size if s == THREAT else max(0, q - 1)), 1.0

    return _machine(size + 1, rule)


def again(clauses: int, lone: float) -> Transducer:
    """An insult counts for lone, unless another came in the same clause or one of as many clauses before it."""

    def rule(q: int, s: int) -> tuple[int, float]:
        if s == INSULT:
            return clauses, (1.0 if q else lone)
        return (max(0, q - 1) if s == END else q), 1.0

    return _machine(clauses + 1, rule)


def compose(*parts: Transducer) -> Transducer:
    """One machine whose weight is the product of the parts'; only states that can be reached."""
    number: dict[tuple[int, ...], int] = {(0,) * len(parts): 0}
    rows: list[tuple[tuple[int, float], ...]] = []
    for state in (todo := list(number)):
        row = []
        for s in range(SYMBOLS):
            steps = [p.step[q][s] for p, q in zip(parts, state, strict=True)]
            after = tuple(q for q, _ in steps)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], float(np.prod([w for _, w in steps]))))
        rows.append(tuple(row))
    return Transducer(tuple(rows))


def grammar() -> Transducer:
    return compose(window(TARGET, 3, {INSULT: 1.5}), window(NEGATION, 3, {INSULT: 0.6, THREAT: 0.6, TARGET: 0.6}), report(0.8), threat(4), again(MEMORY, LONE))


class Lexicon:
    """Symbols and weights of words; a stem holds for the words that go on after it, unless they are known not to be meant."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], innocent: list[str] = ()):
        self.seeds = {w.encode(): s for s, text in SEEDS.items() for w in text.split()}
        self.words = {w.encode(): x for w, x in words.items()}
        self.stems, self.innocent = stems, {w.encode() for w in innocent}

    def read(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        symbols, weights = np.zeros(len(distinct), np.int8), np.zeros(len(distinct))
        for i, raw in enumerate(distinct):
            seed = self.seeds.get(raw, OTHER)
            if seed not in (OTHER, INSULT):
                symbols[i], weights[i] = seed, 1.0
                continue
            weight = self.words.get(raw, 1.0 if seed == INSULT else 0.0)
            if not weight and self.stems and len(raw) > STEMS[0] and raw not in self.innocent:
                word = raw.decode("utf-8", "replace")
                weight = max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n), default=0.0)
            if weight > 0:
                symbols[i], weights[i] = INSULT, weight
        return symbols, weights


_CLAUSE = np.zeros(256, bool)
_CLAUSE[[ord(c) for c in ".!?;:\n"]] = True


def score_batch(array: pa.Array, lexicon: Lexicon, machine: Transducer) -> np.ndarray:
    """For each text its greatest clause score, their total, and the total in proportion to the root of its words."""
    words, starts, stops, first = words_of(array)
    out = np.zeros((len(array), 3))
    if not len(words):
        return out
    coded = words.dictionary_encode()
    symbol, weight = lexicon.read(coded.dictionary.to_pylist())
    at = coded.indices.to_numpy()
    symbols, weights = symbol[at], weight[at]
    raws = pc.fill_null(array.cast(pa.binary()), b"")
    step = machine.step
    for row in np.unique(np.searchsorted(first, np.flatnonzero((symbols == INSULT) | (symbols == THREAT)), "right") - 1):
        a, b = first[row], first[row + 1]
        data = np.frombuffer(raws[int(row)].as_buffer(), np.uint8)
        marks = np.concatenate([[0], np.cumsum(_CLAUSE[data])])
        clause = marks[starts[a:b]]
        # Each clause with an insult or a threat, whole; those between them only end, and what they end is soon forgotten.
        hot = np.unique(clause[(symbols[a:b] == INSULT) | (symbols[a:b] == THREAT)])
        best = total = 0.0
        state, before = 0, None
        for c in hot:
            for _ in range(0 if before is None else min(int(c - before), MEMORY + 1)):
                state = step[state][END][0]
            before = c
            i, j = a + np.searchsorted(clause, c, "left"), a + np.searchsorted(clause, c, "right")
            value = pending = 0.0
            for s, w in zip(symbols[i:j].tolist(), weights[i:j].tolist(), strict=True):
                state, k = step[state][s]
                if s == INSULT:
                    value += w * k
                elif s == THREAT:
                    pending = w
                elif s == TARGET and pending:
                    value += pending * k
                    pending = 0.0
            best, total = max(best, value), total + value
        out[row] = best, total, total / np.sqrt(b - a)
    return out


def _score(lexicon: tuple, machine: Transducer):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*lexicon)
        for batch in batches:
            for part in slices(batch, "text"):
                found = score_batch(part.column("text"), own, machine)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found.tolist(), pa.list_(pa.float64()))], ["key", "features"])

    return run


def featurise(rows: DataFrame, lexicon: tuple, machine: Transducer) -> DataFrame:
    prepare(rows.sparkSession)
    schema = T.StructType([rows.schema["key"], T.StructField("features", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(_score(lexicon, machine), schema)


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and stems of each text, with the text's label."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            words, _, _, first = words_of(part.column("text"))
            coded = words.dictionary_encode()
            names = [w.decode("utf-8", "replace") for w in coded.dictionary.to_pylist()]
            codes = coded.indices.to_numpy()
            labels, kinds, entries = [], [], []
            for label, a, b in zip(part.column("label").to_pylist(), first[:-1], first[1:], strict=True):
                own = [names[c] for c in np.unique(codes[a:b])]
                found = {(0, w) for w in own} | {(n, w[:n]) for w in own for n in STEMS if len(w) > n}
                for kind, entry in found:
                    labels.append(label), kinds.append(kind), entries.append(entry)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(kinds, pa.int32()), pa.array(entries, pa.string())], ["label", "kind", "entry"])


def learn(sample: DataFrame, least: int = 5, telling: float = 3.0, most: int = MOST_ENTRIES) -> tuple[dict[str, float], dict[str, float], list[str]]:
    """Words and stems whose share of toxic texts is exp(telling) times their share of others, at least.

    And the words that begin with such a stem, but that other texts hold so often that they are not toxic themselves.
    """
    prepare(sample.sparkSession)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, fine = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not bad or not fine:
        return {}, {}, []
    entries = sample.select("label", "text").mapInArrow(_entries, "label int, kind int, entry string")
    odds = F.log((F.col("bad") + 0.1) / (bad + 0.2)) - F.log((F.col("fine") + 0.1) / (fine + 0.2))
    counts = keep(entries.groupBy("kind", "entry").agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") != 1).alias("fine")).withColumn("odds", odds), "entries")
    # A stem stands for words not seen yet, so it must have come in more texts.
    enough = F.col("bad") >= F.when(F.col("kind") == 0, least).otherwise(2 * least)
    chosen = counts.filter((F.col("odds") >= telling) & enough)
    rows = chosen.orderBy(F.desc(F.col("odds") * F.log1p("bad")), "entry", "kind").limit(most).collect()
    stems = {r["entry"]: round(r["odds"], 4) for r in rows if r["kind"]}
    # Of the words of the bounded sample only.
    begins = F.array(*(F.substring("entry", 1, n) for n in STEMS))
    other = counts.filter((F.col("kind") == 0) & (F.col("fine") >= 2) & (F.col("odds") < telling) & F.arrays_overlap(begins, F.array(*map(F.lit, sorted(stems))))) if stems else None
    innocent = sorted(r["entry"] for r in other.select("entry").collect()) if stems else []
    return {r["entry"]: round(r["odds"], 4) for r in rows if not r["kind"]}, stems, innocent


def fit(sample: DataFrame, machine: Transducer | None = None) -> dict:
    """Lexicon and calibration from a bounded sample (id, label, text)."""
    machine = machine or grammar()
    lexicon = learn(sample)
    found = featurise(sample.select(F.col("label").alias("key"), "text"), lexicon, machine).collect()
    x = np.array([_extend(r["features"]) for r in found], float).reshape(-1, 3)
    return {"lexicon": lexicon, "machine": machine, "model": logistic.fit(x, np.array([r["key"] for r in found], float))}


def _extend(f: list[float]) -> list[float]:
    return [float(np.log1p(f[0])), float(np.log1p(f[1])), f[2]]


def score(docs: DataFrame, model: dict, carry: list[str], text_column: str = "text") -> DataFrame:
    """The carried columns, the clause features and score: the probability of label 1."""
    from .quality import logit

    rows = docs.select(F.struct(*(docs[c] for c in carry)).alias("key"), docs[text_column].alias("text"))
    f = featurise(rows, model["lexicon"], model["machine"])
    more = F.array(F.log1p(F.col("features")[0]), F.log1p(F.col("features")[1]), F.col("features")[2])
    z = f.select("key", F.col("features").alias("found"), more.alias("features"))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit("features", model["model"])))))
    return z.select(*(F.col("key")[c].alias(c) for c in carry), p.alias("score"), F.col("found")[0].alias("worst_clause"), F.col("found")[1].alias("all_clauses"))
