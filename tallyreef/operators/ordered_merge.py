"""Ordered first-match merges: each row joins the first kept row that it shares a key with, else it is kept itself.

Which rows are kept depends on the order, so the plain way is a fold over all rows. Here
it goes by rounds over (row, key) pairs. A row that is the first open one of all its keys
has no earlier row to wait for and is kept; every row that shares a key with it is then
settled, as it joins some kept row, if not necessarily this one. A round settles the first
open row of every neighbourhood at once, so few rounds do for most inputs, and no task
holds a group: rows meet by equal joins with one row for each key.

A long chain, in which each row waits for the one before, settles little in a round. So
when a round settles few rows, or few are left, the ``FOLD`` first open rows are folded in
one task, which settles all of them: the number of rounds is at most about
``log(rows) + rows / FOLD`` whatever the input.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyreef.sources.scratch import written

#: Open rows that one task folds at most; a few hundred bytes each.
FOLD = 100_000
#: A round that settles a smaller share of the open pairs is followed by a fold.
SLOW = 0.25


def _pairs(df: DataFrame, order: str, keys: Sequence[Sequence[str]]) -> DataFrame:
    """row and key for each key of a row whose parts are all filled."""
    made = []
    for i, key in enumerate(keys):
        parts = [F.col(c).cast("string") for c in key]
        filled = parts[0].isNotNull() & (parts[0] != "")
        for p in parts[1:]:
            filled = filled & p.isNotNull() & (p != "")
        # Lengths keep parts apart that hold what parts are joined by.
        made.append(F.when(filled, F.concat(F.lit(f"{i}"), *[F.concat(F.lit(":"), F.length(p).cast("string"), F.lit(":"), p) for p in parts])))
    return df.select(F.col(order).alias("row"), F.explode(F.array_compact(F.array(*made))).alias("key"))


def _folded(pairs: DataFrame) -> DataFrame:
    """Kept rows among the rows of few pairs, in one task."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, taken = [], set()
        for frame in frames:
            for row, keys in zip(frame["row"], frame["keys"], strict=True):
                if taken.isdisjoint(keys):
                    kept.append(row)
                    taken.update(keys)
        yield pd.DataFrame({"row": kept})

    kind = pairs.schema["row"].dataType.simpleString()
    rows = pairs.groupBy("row").agg(F.collect_list("key").alias("keys"))
    return rows.repartition(1).sortWithinPartitions("row").mapInPandas(fold, f"row {kind}")


def first_match(df: DataFrame, order: str, keys: Sequence[Sequence[str]], kept: DataFrame | None = None, fold: int = FOLD) -> DataFrame:
    """``order`` and ``head``: the kept row that each row joins, itself if it is kept.

    A row joins the first kept row with which it agrees in all parts of a key, none of
    them null or empty. ``order`` is unique and not null. Rows of ``kept``, which have the
    same columns and come before all of df in order, are kept whatever they share.
    """
    every = written(_pairs(df, order, keys), "merge-pairs")
    kind = df.schema[order].dataType.simpleString()
    # Keys that no row shares settle nothing.
    shared = every.groupBy("key").agg(F.count("*").alias("n"))
    if kept is not None:
        old = written(_pairs(kept, order, keys).groupBy("key").agg(F.min("row").alias("head")), "merge-kept")
        taken = [old]
        told = old.select("key")
        shared = shared.join(told.withColumn("told", F.lit(True)), "key", "left").filter("n > 1 or told").select("key")
    else:
        taken = []
        shared = shared.filter("n > 1").select("key")
    open_pairs = written(every.join(shared, "key", "left_semi"), "merge-open")
    left = open_pairs.count()
    if kept is not None and left:
        gone = open_pairs.join(taken[0], "key", "left_semi").select("row").distinct()
        open_pairs = written(open_pairs.join(gone, "row", "left_anti"), "merge-open")
        left = open_pairs.count()
    slow = False
    while left:
        if slow or left <= fold:
            some = open_pairs if left <= fold else open_pairs.join(written(open_pairs.select("row").distinct().orderBy("row").limit(fold), "merge-first"), "row", "left_semi")
            heads = _folded(some)
        else:
            first = open_pairs.groupBy("key").agg(F.min("row").alias("first"))
            waits = open_pairs.join(first, "key").groupBy("row").agg(F.bool_or(F.col("first") < F.col("row")).alias("waits"))
            heads = waits.filter(~F.col("waits")).select("row")
        new = written(open_pairs.join(heads, "row").select("key", F.col("row").alias("head")), "merge-taken")
        taken.append(new)
        gone = open_pairs.join(new.select("key"), "key", "left_semi").select("row").distinct()
        open_pairs = written(open_pairs.join(gone, "row", "left_anti"), "merge-open")
        before, left = left, open_pairs.count()
        slow = not slow and left > (1 - SLOW) * before
    heads = None
    for t in taken:
        heads = t if heads is None else heads.unionByName(t)
    rows = df.select(order)
    if heads is None:
        return rows.withColumn("head", F.col(order))
    least = every.join(heads, "key").groupBy("row").agg(F.min("head").alias("head"))
    return rows.join(least.withColumnRenamed("row", order), order, "left").select(order, F.coalesce("head", F.col(order)).cast(kind).alias("head"))


def last_evidence(df: DataFrame, group: str, order: Sequence[str], key: Sequence[str], most: int = 20) -> DataFrame:
    """Rows of df that a group keeps as evidence, with place (from 0, oldest first): a row whose key is not among those kept is added, and the oldest beyond ``most`` goes.

    A key that went may come again, so what is kept depends on the order. Rows stream
    through a task by group and in order, which holds ``most`` of them at a time. Rows
    that repeat the key of the row before them never change anything and are dropped first.
    """
    columns = df.columns
    before = F.lag(F.struct(*key)).over(Window.partitionBy(group).orderBy(*order))
    some = df.withColumn("__before", before).filter(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(F.struct(*key))).drop("__before")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, any_rows = None, deque(), False

        def out() -> list[tuple]:
            return [(*row, i) for i, (_, row) in enumerate(held)]

        for frame in frames:
            done = []
            at, g = [columns.index(k) for k in key], columns.index(group)
            for row in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None):
                if not any_rows or row[g] != current:
                    done += out()
                    held.clear()
                    current, any_rows = row[g], True
                value = tuple(row[i] for i in at)
                if all(value != v for v, _ in held):
                    held.append((value, row))
                    if len(held) > most:
                        held.popleft()
            yield pd.DataFrame(done, columns=[*columns, "place"])
        yield pd.DataFrame(out(), columns=[*columns, "place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return some.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, f"{schema}, place int")


def merged_candidates(df: DataFrame, order: str, keys: Sequence[Sequence[str]], confidence: str, detected: str, evidence: Sequence[str], most: int = 20, kept: DataFrame | None = None, held: DataFrame | None = None, fold: int = FOLD) -> tuple[DataFrame, DataFrame]:
    """Heads (rows of df that are kept, with n, confidence, last_detected_at) and the evidence of each, after that which they ``held`` before.

    The greatest confidence counts, within 0 and 1, and the last time of detection; what a
    kept row lacks is not filled, so later rows match it by its own keys alone.
    """
    found = written(df.join(first_match(df, order, keys, kept, fold), order), "merged")
    sums = found.groupBy("head").agg(F.count("*").alias("n"), F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))).alias("confidence"), F.max_by(detected, order).alias("last_detected_at"))
    own = found.filter(F.col(order) == F.col("head")).drop("head", confidence, detected)
    heads = sums.join(own, F.col("head") == F.col(order), "left").drop(order)
    shown = found.select("head", order, *evidence)
    return heads, last_evidence(shown if held is None else held.unionByName(shown), "head", [order], evidence, most)


def upsert_candidates(stored: DataFrame | None, hits: DataFrame, order: str, keys: Sequence[Sequence[str]], confidence: str, detected: str, evidence: Sequence[str], most: int = 20, fold: int = FOLD) -> DataFrame:
    """The candidate store after a batch of hits, whose order comes after all that is stored.

    One row a candidate: the columns of its first hit, n, confidence (the greatest),
    last_detected_at, and evidence, an array of the newest rows of other keys, oldest first.
    Batches give what all hits at once would.
    """
    rest = [c for c in hits.columns if c not in (order, confidence, detected)]
    known = held = None
    if stored is not None:
        known = stored.select(order, *dict.fromkeys(c for key in keys for c in key))
        held = stored.select(F.col(order).alias("head"), F.explode("evidence").alias("e")).select("head", f"e.{order}", *[f"e.{c}" for c in evidence])
    heads, kept = merged_candidates(hits, order, keys, confidence, detected, evidence, most, known, held, fold)
    gathered = kept.groupBy(F.col("head").alias(order)).agg(F.array_sort(F.collect_list(F.struct(order, *evidence))).alias("evidence"))
    if stored is None:
        return heads.select(F.col("head").alias(order), *rest, "n", "confidence", "last_detected_at").join(gathered, order)
    new = heads.select(F.col("head").alias(order), F.struct("n", "confidence", "last_detected_at", *rest).alias("new"))
    old = stored.drop("evidence")
    both = old.select(order, F.struct(*[c for c in old.columns if c != order]).alias("old")).join(new, order, "full_outer")
    merged = both.select(
        order, *[F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in rest],
        (F.coalesce("old.n", F.lit(0)) + F.coalesce("new.n", F.lit(0))).alias("n"), F.greatest("old.confidence", "new.confidence").alias("confidence"), F.coalesce("new.last_detected_at", "old.last_detected_at").alias("last_detected_at"),
    )
    return merged.join(gathered, order)


def intake(df: DataFrame, order: str, gates: Sequence[tuple[str, Column]], keys: Sequence[Sequence[str]], identity: Sequence[Column], known: DataFrame | None = None, fold: int = FOLD) -> DataFrame:
    """df with ``reason`` (the first gate that a row fails, else merged, known or promoted), ``head`` and ``product_id`` of what is promoted.

    Rows that pass all gates join the first known or promoted row that shares a key with
    them, in order; those that join none are promoted, under a hash of their identity. So a
    row is matched with what rows before it have added, as if they came one by one.
    """
    chain = F
    for name, holds in gates:
        chain = chain.when(~F.coalesce(holds, F.lit(False)), name)
    gated = written(df.withColumn("reason", chain.otherwise(None)), "intake")
    passed = gated.filter(F.col("reason").isNull())
    columns = list(dict.fromkeys(c for key in keys for c in key))
    found = first_match(passed.select(order, *columns), order, keys, known, fold)
    own = F.col("head") == F.col(order)
    told = F.when(own, "promoted")
    if known is not None:
        old = known.select(F.col(order).alias("head")).distinct().withColumn("__known", F.lit(True))
        found = found.join(old, "head", "left")
        told = told.when(F.col("__known"), "known")
    out = passed.drop("reason").join(found, order).withColumn("reason", told.otherwise("merged"))
    made = F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in identity]), 256), 1, 16)
    out = out.withColumn("product_id", F.when(own, made)).drop("__known")
    return out.unionByName(gated.filter(F.col("reason").isNotNull()), allowMissingColumns=True)
