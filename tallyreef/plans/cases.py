"""Values that queries and their SQL pick by a key, so that both see the same texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(values: Sequence, key: str) -> Column:
    """The value at the key modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_pick(values: Sequence, key: str) -> str:
    listed = ", ".join("NULL" if v is None else sql_text(v) if isinstance(v, str) else str(v) for v in values)
    return f"([{listed}])[{key} % {len(values)} + 1]"
