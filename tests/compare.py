"""Comparison of a Spark result with rows of DuckDB, without order."""

from collections import Counter
from decimal import Decimal


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x.isoformat() if hasattr(x, "isoformat") else x


def same(df, relation):
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    ours = Counter(tuple(repr(plain(row[n])) for n in names) for row in df.collect())
    theirs = Counter(tuple(repr(plain(row[i])) for i in at) for row in relation.fetchall())
    assert ours == theirs, (list((ours - theirs))[:3], list((theirs - ours))[:3])
