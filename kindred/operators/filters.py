"""Filter specifications and the anti- and semi-joins that restrict documents and pairs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$")
_FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|create|alter|truncate|merge|grant)\b|;|--|/\*", re.I)


def check_name(name: str) -> str:
    """A column or table name, dotted or not, or ValueError."""
    if not isinstance(name, str) or len(name) > 256 or not _NAME.match(name):
        raise ValueError(f"not a name: {name!r}")
    return name


def check_expression(text: str) -> str:
    """A computed field's SQL expression: no statement, no comment, no end of statement."""
    if not text.strip() or _FORBIDDEN.search(text):
        raise ValueError(f"not an expression: {text!r}")
    return text


def condition(field: str, spec: dict, strict_length: bool = False) -> Column:
    """All of a field's conditions.

    not_null, equals, not_equal (a value or a list), min_length, max_length, contains, regex, in. A null differs from
    every value and has length 0. strict_length makes min_length exclusive.
    """
    c = F.col(check_name(field))
    size = F.coalesce(F.length(c.cast("string")), F.lit(0))
    parts: list[Column] = []
    for key, value in spec.items():
        if key == "not_null":
            parts += [c.isNotNull()] if value else []
        elif key == "equals":
            parts.append(c.eqNullSafe(F.lit(value)))
        elif key == "not_equal":
            parts += [~c.eqNullSafe(F.lit(v)) for v in (value if isinstance(value, list | tuple | set) else [value])]
        elif key == "min_length":
            parts.append(size > value if strict_length else size >= value)
        elif key == "max_length":
            parts.append(size <= value)
        elif key == "contains":
            parts.append(F.coalesce(F.contains(c, F.lit(value)), F.lit(False)))
        elif key == "regex":
            parts.append(F.coalesce(c.rlike(value), F.lit(False)))
        elif key == "in":
            parts.append(F.coalesce(c.isin(*value), F.lit(False)))
        else:
            raise ValueError(f"unknown condition {key!r} of {field}")
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def apply_filters(df: DataFrame, spec: dict[str, dict], strict_length: bool = False) -> DataFrame:
    """All fields' conditions."""
    for field, conditions in spec.items():
        df = df.filter(condition(field, conditions, strict_length))
    return df


def exclude_values(df: DataFrame, values: dict[str, Iterable]) -> DataFrame:
    """Without rows whose field is a placeholder; a null is none."""
    for field, unwanted in values.items():
        df = df.filter(~F.coalesce(F.col(check_name(field)).isin(*unwanted), F.lit(False)))
    return df


def computed(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    return df.withColumns({check_name(k): F.expr(check_expression(v)) for k, v in fields.items()})


def unresolved(docs: DataFrame, edges: DataFrame, key: str = "_key", src: str = "src", dst: str = "dst") -> DataFrame:
    """Documents that no edge touches."""
    return docs.join(edges.select(F.col(src).alias(key)), key, "left_anti").join(edges.select(F.col(dst).alias(key)), key, "left_anti")


def restrict_pairs(pairs: DataFrame, docs: DataFrame, key: str = "_key") -> DataFrame:
    """Pairs both of whose ends are among docs."""
    for end in ("doc1_key", "doc2_key"):
        pairs = pairs.join(docs.select(F.col(key).alias(end)).distinct(), end, "left_semi")
    return pairs
