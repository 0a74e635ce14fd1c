"""Pair scores: weighted field similarities, Fellegi-Sunter, heuristics, validators, context."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, numbers, text
from . import blocking

Similarity = str | Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Field:
    """How one field is compared. A callable takes and gives columns (names.similarity_udf wraps a Python function)."""

    name: str
    weight: float = 1.0
    algorithm: Similarity = "jaro_winkler"
    transformers: tuple[str, ...] = ()
    null: str = "skip"  # skip: leave the field out; zero: count it as 0; default: compare the empty strings


def compare(algorithm: Similarity, a: Column, b: Column) -> Column:
    if callable(algorithm):
        return algorithm(a, b)
    known = {
        "jaro_winkler": lambda x, y: names.jaro_winkler_similarity(x, y, fold=False),
        "levenshtein": text.levenshtein_similarity,
        "jaccard": text.word_jaccard,
        "ngram": text.ngram_jaccard,
        "exact": lambda x, y: (x == y).cast("double"),
        "phonetic": text.phonetic_equal,
    }
    return known[algorithm](a, b)


def fetch(value: Column) -> Column:
    """A field as the scorer sees it: null, 0 and false are ''."""
    shown = value.cast("string")
    return F.when(value.isNull() | shown.isin("0", "0.0", "false"), "").otherwise(shown)


def join_documents(pairs: DataFrame, docs: DataFrame, columns: list[str], key: str = "_key") -> DataFrame:
    """Pairs with a_<column> and b_<column>; pairs with an unknown end are dropped. Only these columns are read."""
    a = docs.select(F.col(key).alias("doc1_key"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = docs.select(F.col(key).alias("doc2_key"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return pairs.join(a, "doc1_key").join(b, "doc2_key")


def _ready(docs: DataFrame, fields: list[Field], keep: list[str]) -> DataFrame:
    """Values normalised once a document, before a document meets its many pairs."""
    return docs.select(*keep, *(text.normalise(fetch(F.col(f.name)), f.transformers).alias(f"n{i}") for i, f in enumerate(fields)))


def _field_columns(met: DataFrame, fields: list[Field]) -> DataFrame:
    columns = {}
    for i, f in enumerate(fields):
        a, b = F.col(f"a_n{i}"), F.col(f"b_n{i}")
        s = F.round(compare(f.algorithm, a, b), 4)
        blank = (a == "") | (b == "")
        columns[f"s_{f.name}"] = s if f.null == "default" else F.when(blank, F.lit(0.0) if f.null == "zero" else None).otherwise(s)
    return met.withColumns(columns).drop(*(f"{side}_n{i}" for side in "ab" for i in range(len(fields))))


def field_scores(pairs: DataFrame, docs: DataFrame, fields: list[Field], key: str = "_key") -> DataFrame:
    """pairs with one column s_<field> each: null where the field is left out, rounded to four places."""
    return _field_columns(join_documents(pairs, _ready(docs, fields, [key]), [f"n{i}" for i in range(len(fields))], key), fields)


def block_scores(docs: DataFrame, keys: list[str], fields: list[Field], threshold: float | None = None, key: str = "_key", least: int = 2, most: int = 100, carry: list[str] | None = None) -> DataFrame:
    """blocking.value_cells() of the fields' values with s_<field> and score: each two groups of equal values of a block are
    scored once, whatever their number of pairs. carry: more columns to have as a_ and b_. blocking.expand() gives the pairs."""
    more = list(carry or [])
    ready = _ready(docs, fields, list(dict.fromkeys([key, *keys, *more])))
    met = blocking.value_cells(ready, keys, key, [*(f"n{i}" for i in range(len(fields))), *more], least, most)
    scored = _field_columns(met, fields).withColumn("score", weighted(fields))
    return scored if threshold is None else scored.filter(F.col("score") >= threshold)


def weighted(fields: list[Field]) -> Column:
    """Mean of the field scores that are there, by weight; 0 if none is; rounded to four places."""
    zero = F.lit(0.0)
    total = sum((F.when(F.col(f"s_{f.name}").isNull(), 0.0).otherwise(f.weight) for f in fields), zero)
    value = sum((F.coalesce(F.col(f"s_{f.name}"), zero) * f.weight for f in fields), zero)
    return F.when(total > 0, F.round(value / total, 4)).otherwise(0.0)


def score_pairs(pairs: DataFrame, docs: DataFrame, fields: list[Field], threshold: float | None = 0.75, key: str = "_key", detailed: bool = False) -> DataFrame:
    """pairs with score; detailed keeps field_scores, a map in which a field left out is 0."""
    scored = field_scores(pairs, docs, fields, key).withColumn("score", weighted(fields))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    if detailed:
        entries = [x for f in fields for x in (F.lit(f.name), F.coalesce(F.col(f"s_{f.name}"), F.lit(0.0)))]
        scored = scored.withColumn("field_scores", F.create_map(*entries))
    return scored.drop(*(f"s_{f.name}" for f in fields))


# Fellegi-Sunter.


@dataclass(frozen=True)
class Evidence:
    """m and u of a field, the similarity from which it agrees, and its importance."""

    name: str
    m: float
    u: float
    threshold: float = 0.85
    importance: float = 1.0


def _default_evidence() -> dict[str, Evidence]:
    rows = (
        "name_ngram 90 1 .7 1|first_name_ngram 85 2 .7 .8|last_name_ngram 90 1.5 .7 1|first_name_levenshtein 80 5 .6 .7|last_name_levenshtein 85 3 .6 .9|"
        "first_name_jaro_winkler 88 3 .75 .9|last_name_jaro_winkler 92 2 .75 1.1|first_name_phonetic 75 8 1 .6|last_name_phonetic 80 6 1 .7|address_ngram 80 3 .6 .8|"
        "city_ngram 90 5 .8 .6|email_exact 95 .1 1 1.2|phone_exact 90 .5 1 1.1|company_ngram 80 2 .7 .7"
    )
    out = {}
    for row in rows.split("|"):
        name, m, u, threshold, importance = row.split()
        out[name] = Evidence(name, float(m) / 100, float(u) / 100, float(threshold), float(importance))
    return out


#: The fourteen features of the feature comparator. Percentages of agreement among matches and among others.
EVIDENCE = _default_evidence()


def features(pairs: DataFrame, docs: DataFrame, columns: dict[str, str], key: str = "_key") -> DataFrame:
    """pairs with a column for each of the fourteen features whose field is in columns (field: column of docs).

    A feature is null unless both values are there, but the exact ones are 0 then.
    """
    read = list(dict.fromkeys(columns.values()))
    return join_documents(pairs, docs, read, key).withColumns(feature_columns(columns)).drop(*(f"{side}_{c}" for side in "ab" for c in read))


def block_features(docs: DataFrame, keys: list[str], columns: dict[str, str], key: str = "_key", least: int = 2, most: int = 100) -> DataFrame:
    """features() of all pairs of blocks, computed once for each two groups of equal values."""
    found = feature_columns(columns)
    cells = blocking.value_cells(docs, keys, key, list(dict.fromkeys(columns.values())), least, most)
    return blocking.expand(cells.withColumns(found), *found)


def feature_columns(columns: dict[str, str]) -> dict[str, Column]:
    """Each feature by its name, over a_ and b_ columns."""
    out = {}
    for name in EVIDENCE:
        field, kind = next((name[: -len(k) - 1], k) for k in ("ngram", "levenshtein", "jaro_winkler", "phonetic", "exact") if name.endswith(k))
        if field not in columns:
            continue
        a, b = (F.coalesce(F.col(f"{side}_{columns[field]}").cast("string"), F.lit("")) for side in "ab")
        there = (a != "") & (b != "")
        if kind == "exact":
            out[name] = (there & (F.lower(F.trim(a)) == F.lower(F.trim(b)))).cast("double")
            continue
        value = {"ngram": text.ngram_jaccard, "levenshtein": text.levenshtein_similarity, "jaro_winkler": lambda x, y: names.jaro_winkler_similarity(x, y, halves=True), "phonetic": text.phonetic_equal}[kind](a, b)
        out[name] = F.when(there, F.round(value, 4))
    return out


def log_ratio(value: Column, e: Evidence, low: float = 1e-3) -> Column:
    """Log likelihood ratio of agreement or disagreement; null without a value."""
    m, u = (max(min(p, 1 - low), low) for p in (e.m, e.u))
    return F.when(value.isNull(), None).when(value >= e.threshold, math.log(m / u)).otherwise(math.log((1 - m) / (1 - u)))


def llr_sum(evidence: list[Evidence], prefix: str = "", weighted_: bool = False, low: float = 1e-3) -> Column:
    return sum((F.coalesce(log_ratio(F.col(prefix + e.name), e, low) * (e.importance if weighted_ else 1.0), F.lit(0.0)) for e in evidence), F.lit(0.0))


def fellegi_sunter(evidence: list[Evidence], prior: float, prefix: str = "") -> Column:
    """Posterior probability of a match; a missing score disagrees, as 0."""
    p = max(min(prior, 1 - 1e-6), 1e-6)
    filled = sum((log_ratio(F.coalesce(F.col(prefix + e.name), F.lit(0.0)), e, 1e-6) for e in evidence), F.lit(0.0))
    return numbers.sigmoid(filled + math.log(p / (1 - p)))


def decide(scored: DataFrame, evidence: list[Evidence], method: str = "weighted_heuristic", upper: float = 3.5, lower: float = -1.5, prior: float = 0.5, prefix: str = "") -> DataFrame:
    """scored with total_score, normalized_score, decision and confidence.

    fellegi_sunter: the plain sum and its posterior. weighted_heuristic: the sum by importance; confidence says how far
    beyond a limit it lies and is no probability.
    """
    if method == "fellegi_sunter":
        total = llr_sum(evidence, prefix)
        normalized = total
        confidence = numbers.sigmoid(total + math.log(prior / (1 - prior)))
    else:
        total = llr_sum(evidence, prefix, weighted_=True)
        importance = sum((F.when(F.col(prefix + e.name).isNull(), 0.0).otherwise(e.importance) for e in evidence), F.lit(0.0))
        normalized = F.when(importance > 0, total / importance).otherwise(0.0)
        above = F.least(F.lit(1.0), F.lit(0.5) + (total - upper) / (2 * upper))
        between = F.lit(0.3) + F.lit(0.4) * (total - lower) / (upper - lower)
        below = F.greatest(F.lit(0.0), F.lit(0.1) * (total - lower) / abs(lower))
        confidence = F.when(total > upper, above).when(total > lower, between).otherwise(below)
    decision = F.when(total > upper, "match").when(total > lower, "possible_match").otherwise("non_match")
    return scored.withColumns({"total_score": F.round(total, 6), "normalized_score": F.round(normalized, 6), "decision": decision, "confidence": F.round(confidence, 6)})


def batch_summary(decided: DataFrame) -> DataFrame:
    """One row: pairs, matches, possible matches, mean score."""
    return decided.agg(F.count("*").alias("pairs"), F.count_if(F.col("decision") == "match").alias("matches"), F.count_if(F.col("decision") == "possible_match").alias("possible_matches"), F.round(F.avg("total_score"), 4).alias("avg_score"))


# Validators and context.


def geo_gate(pairs: DataFrame, lat1: Column, lon1: Column, lat2: Column, lon2: Column, most_km: float = 50.0) -> DataFrame:
    """pairs no further apart than most_km, with geo_distance_km; a missing coordinate passes."""
    km = F.round(numbers.haversine_km(lat1, lon1, lat2, lon2), 2)
    return pairs.withColumn("geo_distance_km", km).filter(F.coalesce(F.col("geo_distance_km") <= most_km, F.lit(True)))


def temporal_gate(pairs: DataFrame, date1: Column, date2: Column, most_days: int = 365) -> DataFrame:
    """pairs no more than most_days apart, with temporal_gap_days; a missing date passes."""
    gap = F.abs(F.datediff(date1, date2))
    return pairs.withColumn("temporal_gap_days", gap).filter(F.coalesce(F.col("temporal_gap_days") <= most_days, F.lit(True)))


STOPWORDS = ("a", "an", "and", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with")


def context_overlap(a: Column, b: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Shared words relative to the smaller text's words."""
    x, y = text.gate_tokens(a, stopwords), text.gate_tokens(b, stopwords)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / least)


def context_score(base: Column, overlap: Column, weight: float = 0.3, penalty: float = 0.1) -> Column:
    return F.when(overlap == 0, base * (1 - penalty)).otherwise(base * (1 - weight) + overlap * weight)


def type_compatible(pairs: DataFrame, source_type: str, target_type: str, allowed: DataFrame, strict: bool = False) -> DataFrame:
    """pairs whose types the table (source_type, target_type) allows; an unknown source type passes unless strict."""
    known = allowed.select(F.col("source_type").alias(source_type)).distinct()
    fit = pairs.join(allowed.select(F.col("source_type").alias(source_type), F.col("target_type").alias(target_type)).distinct(), [source_type, target_type], "left_semi")
    return fit if strict else fit.unionByName(pairs.join(known, source_type, "left_anti"))


# Review by a language model.

Verdicts = Callable[[DataFrame], DataFrame]


def verification_band(scored: DataFrame, verdicts: Verdicts, low: float = 0.6, high: float = 0.85, budget: int | None = None) -> DataFrame:
    """scored with final_score and review.

    verdicts takes the pairs with low <= score < high and gives (doc1_key, doc2_key, verdict, confidence), verdict
    null where it failed. A match is lifted above high, a non-match pushed below low; a failure goes by the band's
    middle; what a budget does not reach is pending_review. Budget order: best scores first, then keys.
    """
    inside = scored.filter((F.col("score") >= low) & (F.col("score") < high))
    asked = inside if budget is None else inside.orderBy(F.desc("score"), "doc1_key", "doc2_key").limit(budget)
    said = verdicts(asked).select("doc1_key", "doc2_key", "verdict", "confidence", F.lit(True).alias("asked"))
    met = scored.join(said, ["doc1_key", "doc2_key"], "left")
    band = (F.col("score") >= low) & (F.col("score") < high)
    middle = (low + high) / 2
    final = F.when(~band | F.col("asked").isNull() | F.col("verdict").isNull(), F.col("score")).when(F.col("verdict") == "match", high + (1 - high) * F.col("confidence")).otherwise(low * (1 - F.col("confidence")))
    review = F.when(F.col("score") >= high, "auto_match").when(F.col("score") < low, "auto_no_match").when(F.col("asked").isNull(), "pending_review").when(F.col("verdict").isNull(), F.when(F.col("score") >= middle, "match").otherwise("no_match")).otherwise(F.col("verdict"))
    return met.select(*(scored[c] for c in scored.columns), F.round(final, 4).alias("final_score"), review.alias("review"))


def override(scored: DataFrame, verdicts: DataFrame, threshold: float) -> DataFrame:
    """scored with the scores of (doc1_key, doc2_key, score) in verdicts instead of its own; those of threshold at least."""
    new = verdicts.select("doc1_key", "doc2_key", F.col("score").alias("_new"))
    rest = [c for c in scored.columns if c != "score"]
    return scored.join(new, ["doc1_key", "doc2_key"], "left").select(*(scored[c] for c in rest), F.coalesce("_new", "score").alias("score")).filter(F.col("score") >= threshold)


def explain(pairs: DataFrame, docs: DataFrame, columns: list[str], key: str = "_key") -> DataFrame:
    """pairs with the better of Jaro-Winkler and equality for each field, their mean, and what it means."""
    met = join_documents(pairs, docs, columns, key)
    parts = {}
    for c in columns:
        a, b = (F.coalesce(F.col(f"{side}_{c}").cast("string"), F.lit("")) for side in "ab")
        parts[f"e_{c}"] = F.when((a == "") & (b == ""), None).when(F.lower(a) == F.lower(b), 1.0).otherwise(F.round(names.jaro_winkler_similarity(a, b), 4))
    scored = met.withColumns(parts)
    there = sum((F.col(c).isNotNull().cast("int") for c in parts), F.lit(0))
    mean = F.when(there > 0, F.round(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in parts), F.lit(0.0)) / there, 4)).otherwise(0.0)
    band = F.when(F.col("score") >= 0.9, "very strong").when(F.col("score") >= 0.75, "strong").when(F.col("score") >= 0.55, "moderate").otherwise("weak")
    return scored.withColumn("score", mean).withColumn("interpretation", band).drop(*(f"{side}_{c}" for side in "ab" for c in columns))
