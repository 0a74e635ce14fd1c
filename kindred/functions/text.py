"""Normalisation, tokens and similarity of strings, as Spark expressions that stay inside the JVM."""

from __future__ import annotations

import json
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"[.,#\-'\"()]"


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of key in a constant table, null where it is absent."""
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))[key]


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Transformers by name; each takes and gives a string column.
TRANSFORMERS = {
    "strip": lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""),
    "lower": F.lower,
    "upper": F.upper,
    "collapse_whitespace": squeeze,
    "remove_punctuation": lambda c: F.regexp_replace(c, r"(?U)[^\w\s]", ""),
    "digits_only": lambda c: F.regexp_replace(c, r"\P{N}", ""),
    "alphanumeric_only": lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", ""),
    "e164": lambda c: e164(c),
    "state_code": lambda c: state_code(c),
    "street_suffix": lambda c: street_suffix(c),
    "company_suffix": lambda c: company_suffix(c),
    "soundex": lambda c: soundex(c),
}


def normalise(value: Column, transformers: tuple[str, ...] = (), case: str = "upper", strip: bool = True, collapse: bool = True, punctuation: bool = True) -> Column:
    """Transformers in order, then strip, case, collapsed blanks and, if punctuation is False, no punctuation; null is ''."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for name in transformers:
        out = TRANSFORMERS[name](out)
    if strip:
        out = TRANSFORMERS["strip"](out)
    out = {"upper": F.upper, "lower": F.lower}.get(case, lambda c: c)(out)
    if collapse:
        out = F.regexp_replace(out, r"\s+", " ")
    return out if punctuation else TRANSFORMERS["remove_punctuation"](out)


def e164(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9]", "")
    return F.when(digits == "", "").when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).otherwise(F.concat(F.lit("+"), digits))


_STATES = "AL=ALABAMA AK=ALASKA AZ=ARIZONA AR=ARKANSAS CA=CALIFORNIA CO=COLORADO CT=CONNECTICUT DE=DELAWARE DC=DISTRICT_OF_COLUMBIA FL=FLORIDA GA=GEORGIA HI=HAWAII ID=IDAHO IL=ILLINOIS IN=INDIANA IA=IOWA KS=KANSAS KY=KENTUCKY LA=LOUISIANA ME=MAINE MD=MARYLAND MA=MASSACHUSETTS MI=MICHIGAN MN=MINNESOTA MS=MISSISSIPPI MO=MISSOURI MT=MONTANA NE=NEBRASKA NV=NEVADA NH=NEW_HAMPSHIRE NJ=NEW_JERSEY NM=NEW_MEXICO NY=NEW_YORK NC=NORTH_CAROLINA ND=NORTH_DAKOTA OH=OHIO OK=OKLAHOMA OR=OREGON PA=PENNSYLVANIA RI=RHODE_ISLAND SC=SOUTH_CAROLINA SD=SOUTH_DAKOTA TN=TENNESSEE TX=TEXAS UT=UTAH VT=VERMONT VA=VIRGINIA WA=WASHINGTON WV=WEST_VIRGINIA WI=WISCONSIN WY=WYOMING"
STATES = {name.replace("_", " "): code for code, name in (x.split("=") for x in _STATES.split())}


def _table(text: str) -> dict[str, str]:
    """'LONG:A,B' gives both A and B, and LONG itself, as LONG."""
    out = {}
    for entry in text.split():
        full, _, short = entry.partition(":")
        out |= {s: full for s in [full, *filter(None, short.split(","))]}
    return out


SUFFIXES = _table("STREET:ST AVENUE:AVE,AV ROAD:RD DRIVE:DR LANE:LN BOULEVARD:BLVD COURT:CT,CRT PLACE:PL HIGHWAY:HWY PARKWAY:PKWY CIRCLE:CIR TRAIL:TRL WAY SQUARE:SQ TERRACE:TER,TERR")
DIRECTIONS = {a: b for b, a in (x.split(":") for x in "NORTH:N SOUTH:S EAST:E WEST:W NORTHEAST:NE NORTHWEST:NW SOUTHEAST:SE SOUTHWEST:SW".split())}
ORDINALS = dict(zip("1ST 2ND 3RD 4TH 5TH 6TH 7TH 8TH 9TH 10TH".split(), "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH".split(), strict=True))
UNITS = ("APT", "APARTMENT", "FL", "FLOOR", "RM", "ROOM", "STE", "SUITE", "UNIT")
COMPANIES = {k.upper(): v for k, v in (("co", "company"), ("company", "company"), ("corp", "corporation"), ("corporation", "corporation"), ("inc", "incorporated"), ("incorporated", "incorporated"), ("llc", "llc"), ("ltd", "limited"), ("limited", "limited"))}


def state_code(value: Column) -> Column:
    cleaned = squeeze(F.upper(F.regexp_replace(value, PUNCTUATION, "")))
    return F.coalesce(lookup(STATES, cleaned), cleaned)


def _last_word(value: Column, table: dict[str, str]) -> Column:
    words = F.split(squeeze(F.regexp_replace(value, r"(?U)[^\w\s]", "")), " ")
    last = F.coalesce(lookup(table, F.upper(F.element_at(words, -1))), F.element_at(words, -1))
    return F.array_join(F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(last)), " ")


def street_suffix(value: Column) -> Column:
    """The last word alone is expanded, in lower case."""
    return _last_word(value, {k: v.lower() for k, v in SUFFIXES.items()})


def company_suffix(value: Column) -> Column:
    return _last_word(value, COMPANIES)


def missing(raw: Column) -> Column:
    return raw.isNull() | F.upper(raw).isin("", "NULL", "NONE")


def token_words(raw: Column, case: str = "upper") -> Column:
    """Words of raw with punctuation as blanks."""
    cased = F.upper(raw) if case == "upper" else F.lower(raw)
    return F.filter(F.split(squeeze(F.regexp_replace(cased, PUNCTUATION, " ")), " "), lambda w: w != "")


def token_normalise(raw: Column, expansions: dict[str, str], strip_after: tuple[str, ...] = (), case: str = "upper") -> Column:
    """Each word expanded; the first word of strip_after and all after it go."""
    words = token_words(raw, case)
    if strip_after:
        ends = F.filter(F.transform(words, lambda w, i: F.when(F.upper(w).isin(*strip_after), i)), lambda i: i.isNotNull())
        words = F.slice(words, F.lit(1), F.coalesce(F.try_element_at(ends, F.lit(1)), F.size(words)))
    cased = {k: v if case == "upper" else v.lower() for k, v in expansions.items()}
    expanded = F.transform(words, lambda w: F.coalesce(lookup(cased, F.upper(w)), w)) if cased else words
    return F.when(missing(raw), "").otherwise(F.array_join(expanded, " "))


def street(raw: Column) -> Column:
    return token_normalise(raw, ORDINALS | DIRECTIONS | SUFFIXES, UNITS)


def city(raw: Column) -> Column:
    return F.when(missing(raw), "").otherwise(squeeze(F.upper(raw)))


def state(raw: Column) -> Column:
    return F.when(missing(raw), "").otherwise(state_code(raw))


def postal(raw: Column, digits: int = 5) -> Column:
    """Digits before the first hyphen, digits of them at most."""
    return F.when(missing(raw), "").otherwise(F.substring(F.regexp_replace(F.substring_index(raw, "-", 1), "[^0-9]", ""), 1, digits))


def shard_prefix(raw: Column, size: int = 3) -> Column:
    found = postal(raw, 5)
    return F.when(F.length(found) >= size, F.substring(found, 1, size)).otherwise("0" * size)


def address_key(street_: Column, city_: Column, state_: Column, zip_: Column, compat: bool = False) -> Column:
    """Normalised parts joined by a bar; compat drops lower-case letters, as an older rule did."""

    def part(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        text = text if compat else F.upper(text)
        return squeeze(F.upper(F.regexp_replace(text, r"[^A-Z0-9\s]", "")))

    return F.concat_ws("|", part(street_), part(city_), part(state_), F.substring(part(zip_), 1, 5))


# Similarity.


def levenshtein_similarity(a: Column, b: Column, empty: float = 1.0) -> Column:
    """1 - distance / length of the longer; empty where both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, empty).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Of two arrays taken as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(words(a), words(b))


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams; none of a text shorter than n."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
    return F.when(F.length(text) < n, F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n))))


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    blank = (F.coalesce(x, F.lit("")) == "") | (F.coalesce(y, F.lit("")) == "")
    short = (F.length(x) < n) | (F.length(y) < n)
    return F.when(blank, 0.0).when(x == y, 1.0).when(short, 0.0).otherwise(jaccard(ngrams(x, n), ngrams(y, n), 0.0))


#: Codes of A to Z.
_CODES = "01230120022455012623010202"


def soundex(value: Column) -> Column:
    """A letter's code is left out only if it is the last one kept: vowels do not part equal codes; '' is 0000."""
    text = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    rest = F.translate(F.regexp_replace(F.substring(text, 2, 1 << 30), "[^A-Z]", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _CODES)
    digits = F.regexp_replace(F.regexp_replace(rest, "0", ""), r"([1-6])\1+", "$1")
    return F.when(text == "", "0000").otherwise(F.substring(F.concat(F.substring(text, 1, 1), digits, F.lit("000")), 1, 4))


def phonetic_equal(a: Column, b: Column) -> Column:
    blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(blank, 0.0).otherwise((soundex(a) == soundex(b)).cast("double"))


# Fields.

EMAIL, ZIP = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$", r"^\d{5}(-\d{4})?$"


def valid(kind: str, value: Column) -> Column:
    """Whether value is an acceptable email, phone, zip_code or state."""
    text = F.coalesce(value, F.lit(""))
    if kind == "email":
        return text.rlike(EMAIL)
    if kind == "phone":
        return F.length(F.regexp_replace(text, r"[^0-9]", "")).isin(10, 11)
    if kind == "zip_code":
        return text.rlike(ZIP)
    if kind == "state":
        return F.upper(text).isin(*(s for s in STATES.values() if s != "DC"))
    raise ValueError(kind)


def field_value(kind: str, value: Column) -> Column:
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    if kind == "email":
        return F.lower(text)
    if kind == "phone":
        return F.regexp_replace(text, r"[^0-9]", "")
    if kind in ("first_name", "last_name", "company", "city", "state"):
        return F.initcap(text)
    if kind == "address":
        out = F.initcap(text)
        for short, full in (("St", "Street"), ("Ave", "Avenue"), ("Rd", "Road"), ("Dr", "Drive")):
            out = F.regexp_replace(out, rf"\b{short}\.?\b", full)
        return out
    return text


def field_features(kind: str, value: Column) -> Column:
    """Strings to block a field on; none of a blank one."""
    v = field_value(kind, value)
    more: list[Column] = []
    if kind in ("first_name", "last_name"):
        more = [F.when(F.length(v) >= 3, F.substring(v, 1, 3)), soundex(v)]
    elif kind == "email":
        more = [F.when(F.contains(v, F.lit("@")), F.try_element_at(F.split(v, "@"), F.lit(2)))]
    elif kind == "phone":
        more = [F.when(F.length(v) >= 10, F.substring(v, 1, 3))]
    elif kind == "address":
        more = [F.try_element_at(F.split(v, r"\s+"), F.lit(1))]
    return F.when(v == "", F.expr("cast(array() as array<string>)")).otherwise(F.array_compact(F.array(v, *more)))


def gate_tokens(text: Column, stopwords: tuple[str, ...] = (), acronyms: bool = False, acronym_length: int = 4) -> Column:
    """Distinct lower-case words of ASCII letters and digits, and the initials of the long ones as one more."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    kept = F.filter(raw, lambda w: ~w.isin(*stopwords)) if stopwords else raw
    if acronyms:
        long = F.filter(raw, lambda w: F.length(w) >= max(1, acronym_length))
        initials = F.array_join(F.transform(long, lambda w: F.substring(w, 1, 1)), "")
        kept = F.concat(kept, F.when(F.size(long) >= 2, F.array(initials)).otherwise(F.expr("cast(array() as array<string>)")))
    return F.array_distinct(kept)


def expand_aliases(tokens: Column, aliases: dict[str, list[str]]) -> Column:
    if not aliases:
        return tokens
    table = F.create_map(*chain.from_iterable((F.lit(k.strip().lower()), F.array(*(F.lit(v.strip().lower()) for v in vs))) for k, vs in aliases.items()))
    return F.array_union(tokens, F.flatten(F.transform(tokens, lambda t: F.coalesce(table[t], F.expr("cast(array() as array<string>)")))))


def expand_acronyms(text: Column, table: dict[str, list[str]]) -> Column:
    """text and, where all of it is a known acronym, its expansions."""
    known = F.create_map(*chain.from_iterable((F.lit(k.upper()), F.array(*(F.lit(v) for v in vs))) for k, vs in table.items()))
    return F.array_distinct(F.concat(F.array(text), F.coalesce(known[F.upper(F.trim(text))], F.expr("cast(array() as array<string>)"))))


def serialise(columns: list[str], separator: str = " | ", weights: dict[str, float] | None = None, include_missing: bool = False, most: int = 5) -> Column:
    """A row as text in the order of columns; heavier fields are repeated in proportion to the least weight, most times at most."""
    parts = []
    least = min((w for w in (weights or {}).values() if w > 0), default=None)
    for c in columns:
        v = F.regexp_replace(F.col(c).cast("string"), r"^\s+|\s+$", "")
        v = F.when(v == "", None).otherwise(v)
        times = 1 if not least or c not in (weights or {}) else max(1, min(most, round(weights[c] / least)))
        parts.append(F.array_repeat(F.coalesce(v, F.lit("")) if include_missing else v, times))
    return F.array_join(F.concat(*parts), separator)


# Keys.


def pair_id(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def vertex_id(collection: str, key: Column) -> Column:
    return F.when(F.contains(key, F.lit("/")), key).otherwise(F.concat(F.lit(collection + "/"), key))


def vertex_key(vertex: Column) -> Column:
    return F.when(F.contains(vertex, F.lit("/")), F.regexp_replace(vertex, "^[^/]*/", "")).otherwise(vertex)


def edge_key(a: Column, b: Column, shard: Column | None = None) -> Column:
    """The same for either direction; a shard goes before and after."""
    key = F.md5(F.concat(F.least(a, b), F.lit("->"), F.greatest(a, b)))
    return key if shard is None else F.concat_ws(":", shard, key, shard)


def digest16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def mask(value: Column) -> Column:
    """What stands for a personal value outside."""
    return F.when(value.isNull(), None).otherwise(F.concat(F.lit("masked_"), F.substring(F.md5(value.cast("string")), 1, 10)))


def parse_answer(text: Column, schema: str) -> Column:
    """A model's JSON answer, with or without a code fence around it."""
    body = F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.from_json(body, schema)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))
