"""Aggregations: rates, zero-filled counts, groups, funnels, facets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreef.operators.windows import ranked


def win_rates(df: DataFrame, keys: Sequence[str | Column], win: Column, loss: Column, few: int = 10) -> DataFrame:
    """Totals by key: total, wins, losses, waiting, win_rate (percent of what is decided, null if nothing is), reference (few decided)."""
    decided = F.col("wins") + F.col("losses")
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("total"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"))
        .withColumn("waiting", F.col("total") - decided)
        .withColumn("win_rate", F.try_divide(F.col("wins") * 100.0, decided))
        .withColumn("reference", decided < few)
    )


def zero_filled(counted: DataFrame, dimension: DataFrame, on: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Every row of the dimension with the measures, 0 where nothing was counted."""
    return dimension.join(counted, list(on), "left").select(*on, *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def counts_with_total(df: DataFrame, keys: str | Column, dimension: DataFrame, key: str = "key", total: str = "all") -> DataFrame:
    """Rows by a multi-valued key, zero-filled, and the number of all rows under ``total``."""
    each = df.select(F.explode(F.array_distinct(keys)).alias(key)).groupBy(key).agg(F.count("*").alias("n"))
    everything = df.agg(F.count("*").alias("n")).select(F.lit(total).alias(key), "n")
    return zero_filled(each, dimension, [key], ["n"]).unionByName(everything)


def grouped_rows(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """Rows of a group as an array of structs in the given order, the first ``most``."""
    if most:
        df = ranked(df, keys, [F.col(order), *map(F.col, columns)], most)
    return df.groupBy(*keys).agg(F.min(order).alias("first"), F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))


def histogram(df: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """Counts of a reason by key as one map."""
    counts = df.groupBy(*keys, reason).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("reasons"))


def funnel(dimension: DataFrame, key: str, stages: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables by a key, zero-filled over the dimension."""
    out = dimension
    for name, rows in stages.items():
        out = out.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in stages])


def coverage(df: DataFrame, key: str, unit: str, covered: Column, size: str, success: str | None = None) -> DataFrame:
    """By key: distinct units, covered ones, their percentage to one place, summed size, and the last success where its column is given."""
    last = [F.max(success).alias("last_success")] if success else []
    each = df.groupBy(key, unit).agg(F.max(covered.cast("int")).alias("covered"), F.sum(size).alias("size"), *last)
    again = [F.max("last_success").alias("last_success")] if success else []
    return (
        each.groupBy(key)
        .agg(F.count("*").alias("units"), F.sum("covered").alias("covered"), F.sum("size").alias("size"), *again)
        .withColumn("percent", F.round(F.try_divide(F.col("covered") * 100.0, F.col("units")), 1))
    )


def facets(df: DataFrame, filters: Sequence[tuple[str, Column]], counted: Sequence[tuple[str, Column, int]]) -> DataFrame:
    """(facet, value, n): each facet counts the rows that pass the filters before its depth, in one pass.

    ``counted`` has (facet, value, depth): a facet is counted before the filter of its own.
    """
    held, passed = [F.lit(True)], F.lit(True)
    for _, f in filters:
        passed = passed & F.coalesce(f, F.lit(False))
        held.append(passed)
    entries = [F.when(held[depth], F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value"))) for name, value, depth in counted]
    return df.select(F.explode(F.array_compact(F.array(*entries))).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def priority_of(flags: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """Aggregate: the first state that any row of a group has."""
    chain = F
    for name, flag in flags:
        chain = chain.when(F.coalesce(F.bool_or(flag), F.lit(False)), name)
    return chain.otherwise(otherwise)
