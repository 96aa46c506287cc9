"""Ordered rule tables compiled into one expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[str, Column]], otherwise: str | None) -> Column:
    """Name of the first rule that holds."""
    chain = F
    for name, holds in rules:
        chain = chain.when(F.coalesce(holds, F.lit(False)), name)
    return chain.otherwise(otherwise) if rules else F.lit(otherwise)


def keyword_class(text: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """Class of the first pattern that the text holds, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return first_match([(name, low.rlike(pattern)) for name, pattern in rules], otherwise)


def detected(text: Column, rules: Sequence[tuple[str, str, float]]) -> Column:
    """Array of (kind, weight, evidence) of all patterns that the text holds, in rule order."""
    found = [F.when(F.lower(text).rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(w).alias("weight"), F.regexp_extract(F.lower(text), f"({p})", 1).alias("evidence"))) for k, p, w in rules]
    return F.array_compact(F.array(*found))


def additive(base: float, rules: Sequence[tuple[str, Column, float]]) -> tuple[Column, Column]:
    """Clamped sum of the weights of rules that hold, and the array of their names."""
    total, reasons = F.lit(base), []
    for name, holds, weight in rules:
        sure = F.coalesce(holds, F.lit(False))
        total = total + F.when(sure, weight).otherwise(0.0)
        reasons.append(F.when(sure, F.lit(name)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), F.array_compact(F.array(*reasons))


def clamped(value: Column, allowed: Sequence[str], otherwise: str) -> Column:
    """A value of a fixed vocabulary, else the default."""
    return F.when(value.isin(*allowed), value).otherwise(otherwise)


def bound(value: Column, result: Callable[[Column], Column]) -> Column:
    """result(value), with the value worked out once however often the result reads it, also where a filter is pushed down."""
    return F.transform(F.array(value), result)[0]
