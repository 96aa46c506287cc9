"""Deduplication, merging and conflict resolution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreef.functions.text import blank, first_filled
from tallyreef.operators.components import linked_groups
from tallyreef.operators.windows import ranked

#: Evidence that is kept for a row at most.
MOST_EVIDENCE = 20


def identity(explicit: Column, *parts: Column) -> Column:
    """An explicit id, else the parts in lower case joined by bars."""
    made = F.concat_ws("|", *[F.lower(blank(p)) for p in parts])
    return first_filled(explicit, made)


def stable_id(*parts: Column, length: int = 16) -> Column:
    """Start of the SHA-256 of parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *[blank(p) for p in parts]), 256), 1, length)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; struct minima combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("x")).select(*keys, "x.*").select(*df.columns)


def distinct_values(df: DataFrame, keys: Sequence[str], value: str, most: int) -> DataFrame:
    """keys and the sorted distinct values of each, the first ``most``; a key with very many never holds them all at once."""
    once = df.select(*keys, value).filter(F.col(value).isNotNull()).distinct()
    return ranked(once, keys, [F.col(value)], most).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(value))


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], accumulate: Sequence[str] = (), most: int = MOST_EVIDENCE) -> DataFrame:
    """The last row of each key; columns to accumulate become sorted distinct arrays of its rows' values, the first ``most``."""
    rest = [c for c in df.columns if c not in keys and c not in order and c not in accumulate]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("x")).select(*keys, "x.*")
    for c in accumulate:
        out = out.join(distinct_values(df, keys, c, most), list(keys), "left")
    return out


def merged_discoveries(df: DataFrame, identity: Sequence[Column], order: Sequence[str], sources: str) -> DataFrame:
    """The first row of each identity, a hash of parts without separators, with ``identity``, n, and the sources of all its rows, each once, as first seen.

    Sources are made distinct before they meet, so a hot identity gathers no more than its distinct sources.
    """
    bare = [F.regexp_replace(F.lower(blank(c)), r"(?U)[\s　「」『』・_\-/]", "") for c in identity]
    # Rows are grouped by the parts themselves, which are shorter than their hash, and by plain columns, which travel once.
    rows = df.withColumn("__key", F.concat_ws("|", *bare))
    rest = [c for c in df.columns if c not in (*order, sources)]
    first = rows.groupBy("__key").agg(F.min(F.struct(*order, *rest)).alias("x"), F.count("*").alias("n")).select("__key", "x.*", "n")
    told = rows.select("__key", F.struct(*order).alias("__at"), F.posexplode(sources).alias("__i", "__s"))
    once = told.groupBy("__key", "__s").agg(F.min(F.struct("__at", "__i")).alias("__at"))
    gathered = once.groupBy("__key").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__s"))), lambda x: x["__s"]).alias(sources))
    out = first.join(gathered, "__key", "left").withColumn(sources, F.coalesce(sources, F.array().cast(df.schema[sources].dataType)))
    return out.select(F.sha2("__key", 256).alias("identity"), *[c for c in out.columns if c != "__key"])


def upgraded_in_place(df: DataFrame, keys: Sequence[str], order: str, candidate: Column, evidence: str, most: int = MOST_EVIDENCE) -> DataFrame:
    """First-wins, but a confirmed row replaces a candidate; evidence of all rows is united, the first ``most``, and the first place kept."""
    rest = [c for c in df.columns if c not in keys and c != evidence]
    chosen = (
        df.withColumn("__rank", F.struct(candidate.cast("int"), order))
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), "__rank").alias("x"), F.min(order).alias("place"), F.count("*").alias("merged"))
        .select(*keys, "x.*", "place", "merged")
    )
    return chosen.join(distinct_values(df.select(*keys, F.explode(evidence).alias(evidence)), keys, evidence, most), list(keys), "left")


def fill_missing(current: Column, incoming: Column) -> Column:
    return F.coalesce(F.nullif(blank(current), F.lit("")), incoming.cast("string"))


def conflict(left: Column, right: Column) -> Column:
    """Both are there and differ."""
    return F.coalesce(left != right, F.lit(False))


def date_decision(old: Column, new: Column, old_priority: Column, new_priority: Column, old_seen: Column, new_seen: Column, rolled_back: Column) -> Column:
    """Why a new date is taken or not; the first rule that applies."""
    return (
        F.when(new.isNull(), "incoming_date_unknown")
        .when(old.isNull(), "existing_date_unknown")
        .when(new == old, "same_date")
        .when(new_priority < old_priority, "lower_priority_source")
        .when(old_seen.isNotNull() & new_seen.isNotNull() & (new_seen < old_seen), "older_observation")
        .when((new_priority <= old_priority) & F.coalesce(rolled_back, F.lit(False)), "historical_date_rollback")
        .otherwise("trusted_newer_observation")
    )


def by_priority(current: Column, incoming: Column, current_priority: Column, incoming_priority: Column, manual: Column) -> Column:
    """Attribute of the better source; a filled value stays on a manual edit, and nothing is overwritten by blanks."""
    take = (incoming_priority >= current_priority) & ~F.coalesce(manual, F.lit(False)) & (blank(incoming) != "")
    return F.when(take, incoming).otherwise(F.when(blank(current) == "", incoming).otherwise(current))


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The merged table, and counts of added, updated and unchanged rows."""
    values = [c for c in current.columns if c not in keys]
    old, new = (df.select(*keys, F.struct(*values).alias(side)) for df, side in ((current, "__old"), (incoming, "__new")))
    both = old.join(new, list(keys), "full_outer")
    outcome = F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "added").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("updated")
    merged = both.select(*keys, F.coalesce("__new", "__old").alias("x"), outcome.alias("outcome"))
    return merged.select(*keys, "x.*"), merged.groupBy("outcome").agg(F.count("*").alias("n"))


def greedy_merge(df: DataFrame, block: str, order: str, keys: Sequence[Sequence[str]], fill: Sequence[str], count: str = "merged") -> DataFrame:
    """Order-dependent merge within a block: a row joins the first earlier row with which it agrees in all parts of a key, none of them empty, and fills what that lacks.

    A filled row may then equal later rows, so the result is a fold and no
    grouping. Rows that no key links, directly or through others, never meet, so
    each linked group of a block is folded apart: it streams through one task in
    order, which holds the rows that remain and finds them by key, so time grows
    with the rows. As filling may put a key together from several rows, rows are
    linked by the first part of each key alone. ``order`` is unique.
    """
    df = df.withColumn("__block", F.coalesce(F.concat(F.lit("is "), F.col(block).cast("string")), F.lit("none")))
    groups = linked_groups(df, order, [("__block", key[0]) for key in keys])
    grouped = df.drop("__block").join(groups.withColumnRenamed("label", "__group"), order)
    merged = _fold(grouped, "__group", order, keys, fill, count)
    return merged.drop("__group")


def _fold(df: DataFrame, block: str, order: str, keys: Sequence[Sequence[str]], fill: Sequence[str], count: str) -> DataFrame:
    """The fold of greedy_merge within each value of ``block``."""
    columns = df.columns

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        first: dict[tuple, int] = {}
        current = None

        def values(row: dict) -> Iterator[tuple]:
            for i, key in enumerate(keys):
                parts = [row[c] for c in key]
                if not any(pd.isna(x) or x == "" for x in parts):
                    yield (i, *parts)

        for frame in frames:
            done = []
            for row in frame.astype(object).to_dict("records"):
                if row[block] != current and not (pd.isna(row[block]) and current is None):
                    done += held
                    held, first, current = [], {}, None if pd.isna(row[block]) else row[block]
                at = min((first[v] for v in values(row) if v in first), default=None)
                if at is None:
                    at = len(held)
                    held.append(row | {count: 1})
                else:
                    held[at][count] += 1
                    for c in fill:
                        if pd.isna(held[at][c]) or held[at][c] == "":
                            held[at][c] = row[c]
                for v in values(held[at]):
                    first[v] = min(first.get(v, at), at)
            if done:
                yield pd.DataFrame(done, columns=[*columns, count])
        yield pd.DataFrame(held, columns=[*columns, count])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(block).sortWithinPartitions(block, order).mapInPandas(fold, f"{schema}, {count} long")
