"""Searches over shops: candidates against the offers of many plugins, and staged searches that read details for few."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Outcomes that every search knows; others are reasons of a policy.
ACCEPTED, DUPLICATE, UNSURE = "accepted", "duplicate", "unsure"
#: Rows that one task joins and ranks, about.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in tasks of about ``TASK_ROWS`` of its ``rows``, so that their memory does not grow with the table; as it is where the session's own partitions are no larger."""
    tasks = rows // TASK_ROWS
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def fan_out(candidates: DataFrame, offers: DataFrame, plugins: DataFrame, key: str, category: str, term: str, order: Sequence[str], same: Sequence[str], confidence: str, least: float, verdict: Column, rows: int = 0) -> DataFrame:
    """All hits of all plugins with ``outcome``: duplicate, unsure, what ``verdict`` says, or accepted.

    ``plugins`` has a row for each shop: plugin, rank, and categories, an array that is empty
    for a shop of all. A candidate meets the offers of its term in shops that have its
    category. The first hit of equal ``same`` columns stays, by the shops' ranks and then
    ``order``; hits below ``least`` are unsure; the rest go by the verdict. Offers are read
    once, and meet candidates by term before shops are looked up, so nothing multiplies.
    ``rows`` is about how many offers there are: many are joined and ranked in more tasks.
    """
    met = candidates.join(dealt(offers, rows, term), term).join(plugins.select("plugin", F.col("rank").alias("__rank"), F.col("categories").alias("__for")), "plugin")
    met = met.filter((F.size("__for") == 0) | F.array_contains("__for", F.col(category)))
    # By candidate alone, so what is counted for each later needs no other tasks.
    ranked = dealt(met, rows, key).withColumn("__first", F.row_number().over(Window.partitionBy(key, *same).orderBy("__rank", *order)))
    outcome = F.when(F.col("__first") > 1, DUPLICATE).when(F.coalesce(F.col(confidence), F.lit(0.0)) < least, UNSURE).otherwise(F.coalesce(verdict, F.lit(ACCEPTED)))
    return ranked.withColumn("outcome", outcome).drop("__rank", "__for", "__first")


def search_counters(hits: DataFrame, key: str, shop: str) -> DataFrame:
    """Per candidate: hits, duplicates, unsure and excluded ones, accepted ones, shops found and shops that sell regularly, and the reasons counted."""
    sure = ~F.col("outcome").isin(DUPLICATE, UNSURE)
    accepted = F.col("outcome") == ACCEPTED
    # Counts by outcome and shop come first: a hot candidate sends few rows on.
    small = hits.groupBy(key, "outcome", shop).agg(F.count("*").alias("n"))
    # Shops are told apart by rows of their own, which need no other tasks, as distinct counts would.
    kinds = {"duplicates": F.col("outcome") == DUPLICATE, "unsure": F.col("outcome") == UNSURE, "excluded": sure & ~accepted, "accepted": accepted}
    shops = small.groupBy(key, shop).agg(F.sum("n").alias("hits"), *[F.sum(F.when(what, F.col("n")).otherwise(0)).alias(name) for name, what in kinds.items()])
    named = F.col(shop).isNotNull()
    by = shops.groupBy(key).agg(
        F.sum("hits").alias("hits"), *[F.sum(name).alias(name) for name in kinds], F.count_if(named & (F.col("excluded") + F.col("accepted") > 0)).alias("found_shops"), F.count_if(named & (F.col("accepted") > 0)).alias("regular_shops"),
    )
    reasons = small.filter(sure & ~accepted).groupBy(key, "outcome").agg(F.sum("n").alias("n")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("outcome", "n"))).alias("reasons"))
    return by.join(reasons, key, "left")


def observed(hits: DataFrame, reasons: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """hits, and counters of outcomes that are filled by whatever job writes them."""
    seen = Observation("search")
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in (ACCEPTED, DUPLICATE, UNSURE, *reasons)]
    return hits.observe(seen, F.count(F.lit(1)).alias("hits"), *counts), seen


def staged(
    listings: DataFrame, details: DataFrame, key: str, address: str, order: Sequence[str], preliminary: Column, least_preliminary: float, most_details: int, enriched: Sequence[str], final: Column, least: float, reason: Column,
) -> DataFrame:
    """Hits of each candidate with ``confidence`` and ``outcome``: duplicate, preliminary, detail_limit, a reason, or accepted.

    The first listing of each address counts. Those that a cheap look finds likely get their
    details, the first ``most_details`` of each candidate; filled fields of the details
    replace the listing's, and the final look decides. Only the columns that looks need are
    ranked, and details are joined with the few rows that get so far.
    """
    first = F.row_number().over(Window.partitionBy(key, address).orderBy(*order))
    looked = listings.withColumn("__first", first).withColumn("__likely", F.coalesce(preliminary, F.lit(0.0)) >= least_preliminary)
    likely = (F.col("__first") == 1) & F.col("__likely")
    place = F.row_number().over(Window.partitionBy(key, likely).orderBy(*order))
    ranked = looked.withColumn("__place", F.when(likely, place))
    early = F.when(F.col("__first") > 1, DUPLICATE).when(~F.col("__likely"), "preliminary").when(F.col("__place") > most_details, "detail_limit")
    ranked = ranked.withColumn("outcome", early).drop("__first", "__likely", "__place")
    asked = ranked.filter(F.col("outcome").isNull()).drop("outcome")
    read = details.select(address, *[F.col(c).alias(f"__{c}") for c in enriched])
    full = asked.join(read, address, "left")
    for c in enriched:
        filled = F.when(F.coalesce(F.col(f"__{c}").cast("string"), F.lit("")) != "", F.col(f"__{c}"))
        full = full.withColumn(c, F.coalesce(filled, F.col(c)) if c in asked.columns else filled).drop(f"__{c}")
    full = full.withColumn("confidence", final)
    decided = full.withColumn("outcome", F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) >= least, ACCEPTED).otherwise(F.coalesce(reason, F.lit(UNSURE))))
    return decided.unionByName(ranked.filter(F.col("outcome").isNotNull()), allowMissingColumns=True)


def reason_histogram(hits: DataFrame, *keys: str) -> DataFrame:
    """How many hits each outcome has."""
    return hits.groupBy(*keys, "outcome").agg(F.count("*").alias("n"))


def by_reason(reasons: Mapping[str, Column]) -> Column:
    """The first reason whose condition holds, null if none does."""
    chain = F
    for name, holds in reasons.items():
        chain = chain.when(F.coalesce(holds, F.lit(False)), name)
    return chain.otherwise(None)
