"""Connected components of a link table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyreef.llm import common

#: Steps after which an unfinished search is an error; stars halve in each, so it is never reached.
MOST_STEPS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v.

    Large: every node links its larger neighbours to the least of its neighbours
    and itself. Small: every node links its smaller neighbours and itself to the
    least of them. The least neighbours are written before they are joined, so
    that Spark may split the rows of a node with very many links, or send the
    table to all tasks where it is small.
    """
    if large:
        # (u, v) is the larger neighbour u of v; v moves on to the least of what it is linked to. Most v are least themselves.
        moving = common.written(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v"), "components-moving")
        out = edges.join(moving, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
    else:
        least = common.written(edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top")), "components-least")
        # A node with one smaller neighbour only keeps its edge.
        spread = edges.join(least.filter("m < top").select("u", "m"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = least.select("u", F.col("m").alias("v")).union(spread)
    return common.written(out.filter("u > v").distinct(), "components-edges")


def connect(links: DataFrame) -> DataFrame:
    """cid and label (the least cid of its component) of every node that has a link; links has a and b."""
    edges = common.written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components-links")
    before = None
    for _ in range(MOST_STEPS):
        edges = _star(_star(edges, large=True), large=False)
        # Equal counts and sums of hashes: no edge has changed.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return common.written(edges.select(F.col("u").alias("cid"), F.col("v").alias("label")).union(edges.select("v", "v").distinct()), "components")
        before = now
    raise RuntimeError("components did not settle")
