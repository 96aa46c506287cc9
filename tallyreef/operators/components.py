"""Rows that are linked by any of several keys, directly or through others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyreef.sources.scratch import written

#: Rounds after which an unfinished search is an error; distances fall by half in each, so it is never reached.
MOST_ROUNDS = 60


def linked_groups(df: DataFrame, row: str, keys: Sequence[Sequence[str]]) -> DataFrame:
    """row and label: the least row that a row is linked to by keys whose parts are all filled, itself if none.

    Each row points to the least row of each of its keys. In every round each row
    moves on to the least row that any row pointing to it, or that it points to,
    points to, and then to what that one points to.
    """
    edges = None
    for key in keys:
        filled = df
        for c in key:
            filled = filled.filter(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
        least = filled.groupBy(*key).agg(F.min(row).alias("v"))
        found = filled.join(least, list(key)).select(F.col(row).alias("u"), "v").filter("u <> v")
        edges = found if edges is None else edges.unionByName(found)
    edges = written(edges.distinct(), "links")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    for _ in range(MOST_ROUNDS):
        # What the neighbours know, then one jump along what is known so far.
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u", "left").select("u", "label", F.least("label", F.coalesce("near", "label")).alias("to"))
        jump = step.join(labels.select(F.col("u").alias("to"), F.col("label").alias("far")), "to", "left")
        moved = written(jump.select("u", F.col("label").alias("before"), F.least("to", F.coalesce("far", "to")).alias("label")), "labels")
        labels = moved.select("u", "label")
        if moved.filter("label <> before").isEmpty():
            return df.select(row).join(labels.withColumnRenamed("u", row), row, "left").select(row, F.coalesce("label", row).alias("label"))
    raise RuntimeError("links did not settle")
