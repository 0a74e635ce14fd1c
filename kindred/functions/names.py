"""Jaro-Winkler and phonetic codes, which Spark has no expressions for: Arrow-batched, once per distinct value."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..workers import ship


def jaro(a: str, b: str, halves: bool = False) -> float:
    """halves: an odd count of transposed characters counts half a transposition, instead of none."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = bytearray(len(b)), []
    for i, ch in enumerate(a):
        j = b.find(ch, max(0, i - reach), i + reach + 1)
        while j >= 0 and taken[j]:
            j = b.find(ch, j + 1, i + reach + 1)
        if j >= 0:
            taken[j] = 1
            mine.append(ch)
    m = len(mine)
    if not m:
        return 0.0
    wrong = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, taken, strict=True) if t), strict=True))
    return (m / len(a) + m / len(b) + (m - (wrong / 2 if halves else wrong // 2)) / m) / 3


def jaro_winkler(a: str, b: str, boost: float = 0.7, weight: float = 0.1, halves: bool = False) -> float:
    """A common beginning of up to four characters lifts a likeness above boost."""
    score = jaro(a, b, halves)
    if score <= boost if not halves else score < boost:
        return score
    common = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        common += 1
    return score + common * weight * (1 - score)


def metaphone(word: str) -> str:
    """A reduced English code: silent beginnings dropped, sounds folded, inner vowels dropped."""
    w = re.sub("[^A-Z]", "", word.upper())
    w = re.sub(r"(.)\1+", lambda m: m[0] if m[1] == "C" else m[1], w)
    if re.match("AE|GN|KN|PN|WR", w):
        w = w[1:]
    w = re.sub("^WH", "W", re.sub("^X", "S", w))
    for pattern, to in (("MB$", "M"), ("SCH", "SK"), ("TCH", "CH"), ("CIA|CH", "X"), ("C(?=[IEY])", "S"), ("CK", "K"), ("C", "K"), ("DG(?=[EIY])", "J"), ("D", "T"), ("GH(?=[^AEIOU]|$)", ""), ("GN(ED)?$", "N"), ("G(?=[EIY])", "J"), ("G", "K"), ("(?<=[CSPTG])H", "h"), ("H(?![AEIOU])", ""), ("PH|Ph", "F"), ("Q", "K"), ("SH|Sh|S(?=IO|IA)", "X"), ("T(?=IA|IO)", "X"), ("TH|Th", "0"), ("V", "F"), ("[WY](?![AEIOU])", ""), ("X(?=.)(?<!^)(?<=[AEIOU]X)", "KS"), ("Z", "S"), ("h", "")):
        w = re.sub(pattern, to, w)
    return w[:1] + re.sub("[AEIOU]", "", w[1:])


_VOWELS = frozenset("AEIOU")
_NYSIIS_FIRST = (("MAC", "MCC"), ("KN", "N"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS"))
_NYSIIS_LAST = (("EE", "Y"), ("IE", "Y"), *((x, "D") for x in ("DT", "RT", "RD", "NT", "ND")))
_NYSIIS_LETTER = {"Q": "G", "Z": "S", "M": "N", "K": "C"} | dict.fromkeys("AEIOU", "A")


def nysiis(word: str) -> str:
    """The New York system's code, of any length."""
    w = re.sub("[^A-Z]", "", word.upper())
    if not w:
        return ""
    w = next((to + w[len(x) :] for x, to in _NYSIIS_FIRST if w.startswith(x)), w)
    w = next((w[: -len(x)] + to for x, to in _NYSIIS_LAST if w.endswith(x)), w)
    code, i = w[0], 1
    while i < len(w):
        before, now, after = w[i - 1], w[i], w[i + 1 : i + 2]
        size, to = 1, _NYSIIS_LETTER.get(now, now)
        if w.startswith("EV", i):
            size, to = 2, "AF"
        elif w.startswith("SCH", i):
            size, to = 3, "SS"
        elif w.startswith("PH", i):
            size, to = 2, "F"
        elif w.startswith("KN", i):
            to = "N"
        elif now == "H" and not (before in _VOWELS and after in _VOWELS and after):
            to = "A" if before in _VOWELS else before
        elif now == "W" and before in _VOWELS:
            to = "A"
        # What repeats the code's last letter is left out.
        code += "" if to[-1] == code[-1] else to
        i += size
    if len(code) > 1:
        code = code.removesuffix("S")
    if code.endswith("AY"):
        code = code[:-2] + "Y"
    return code[:-1] if len(code) > 1 and code.endswith("A") else code


def match_rating(word: str) -> str:
    """Codex: no vowels but a leading one, no letter right after itself, the first and last three of what is left."""
    w = re.sub("[^A-Z]", "", word.upper())
    kept = "".join(x for i, x in enumerate(w) if (i == 0 or x not in _VOWELS) and x != w[i - 1 : i])
    return kept if len(kept) <= 6 else kept[:3] + kept[-3:]


def _each(values: pd.Series, f: Callable[[str], object]) -> pd.Series:
    """f of every distinct value once."""
    known = {v: f(v) for v in values.dropna().unique()}
    return values.map(known)


def jaro_winkler_similarity(a: Column, b: Column, halves: bool = False, fold: bool = True) -> Column:
    """fold: lower case without outer blanks first. Null counts as empty; two empties score 0."""

    ship()

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for p in zip(x, y, strict=True):
            if p not in known:
                known[p] = jaro_winkler(p[0], p[1], halves=halves)
            out.append(known[p])
        return pd.Series(out, dtype="float64")

    def ready(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        return F.lower(F.trim(text)) if fold else text

    return score(ready(a), ready(b))


def phonetic(kind: str, value: Column) -> Column:
    """metaphone, nysiis or match_rating of each word, joined by blanks."""
    code = {"metaphone": metaphone, "nysiis": nysiis, "match_rating": match_rating}[kind]

    ship()

    @F.pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return _each(x, lambda text: " ".join(filter(None, map(code, text.split()))))

    return of(value)


def similarity_udf(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """A caller's own (str, str) -> float as a column function, called once per distinct pair of a batch."""

    ship()

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        known = {p: float(f(*p)) for p in set(zip(x, y, strict=True))}
        return pd.Series([known[p] for p in zip(x, y, strict=True)], dtype="float64")

    return score
