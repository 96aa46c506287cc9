"""Latest rows, changes, edges, newest of a group, throttling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each key; filtering on the rank lets Spark drop rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= most).drop("__place")


def latest_by_key(df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[Column], now: Column | None = None, days: int | None = None) -> DataFrame:
    """The latest row of each key, among rows at most so many days old (inclusive)."""
    if days is not None:
        df = df.filter(F.timestamp_diff("SECOND", F.col(at), now) <= days * 86400)
    return ranked(df, keys, [F.desc(at), *ties])


def change_feed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], fields: Sequence[str], important: Sequence[str] = (), filled_only: bool = False) -> DataFrame:
    """Rows at which fields differ from the row before: changed (names), important, and before/after of each field.

    A first sight is no change. ``filled_only`` counts a change only where both
    sides are there and not empty.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = df.withColumn("__before", F.lag(F.struct(*fields)).over(w))

    def differs(f: str) -> Column:
        now, old = F.col(f), F.col(f"__before.{f}")
        if filled_only:
            return now.isNotNull() & old.isNotNull() & (now.cast("string") != "") & (old.cast("string") != "") & (now != old)
        return ~now.eqNullSafe(old)

    changed = F.array_compact(F.array(*[F.when(differs(f), F.lit(f)) for f in fields]))
    out = before.filter(F.col("__before").isNotNull()).withColumn("changed", changed).filter(F.size("changed") > 0)
    out = out.withColumn("important", F.arrays_overlap("changed", F.array(*map(F.lit, important)))) if important else out.withColumn("important", F.lit(False))
    return out.select("*", *[F.col(f"__before.{f}").alias(f"before_{f}") for f in fields]).drop("__before")


def edges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], becomes: Column) -> DataFrame:
    """Rows at which a state begins: it holds now and did not at the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__now", F.coalesce(becomes, F.lit(False))).withColumn("__was", F.lag("__now").over(w)).filter(F.col("__now") & ~F.col("__was")).drop("__now", "__was")


def title_changes(df: DataFrame, key: str, order: Sequence[Column], title: str) -> DataFrame:
    """Each key's runs: number, title changes, and the last title."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("__changed", F.coalesce(F.col(title) != F.lag(title).over(w), F.lit(False))).withColumn("__last", F.row_number().over(w))
    return marked.groupBy(key).agg(F.count("*").alias("runs"), F.count_if("__changed").alias("changes"), F.max_by(title, "__last").alias("last_title"))


def throttle(df: DataFrame, key: str, at: str, order: str, minutes: int) -> DataFrame:
    """key, at, order, count and notify: notify if that long has passed since the last row that was notified.

    What is notified depends on all earlier choices, which no window frame
    expresses; each key is folded in its order. Rows of a key stream through in
    bounded batches, so a long history is never held at once.
    """
    gap = max(1, minutes) * 60

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            notify, counts = [], []
            for k, t in zip(pdf[key].tolist(), (pdf[at].astype("datetime64[us]").astype("int64") / 1e6).tolist(), strict=True):
                current, n, last = held.get("state", (None, 0, None))
                if current != k or "state" not in held:
                    n, last = 0, None
                n += 1
                due = last is None or t - last >= gap
                last = t if due else last
                held["state"] = (k, n, last)
                notify.append(due)
                counts.append(n)
            yield pdf.assign(count=counts, notify=notify)

    kept = df.select(key, at, order)
    schema = f"{kept.schema.simpleString()[7:-1].replace(':', ' ')}, count long, notify boolean"
    return kept.repartition(key).sortWithinPartitions(key, at, order).mapInPandas(fold, schema)
