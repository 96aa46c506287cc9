"""The main product scan: ids are repaired, the master follows, what is new becomes history, and what users see is returned.

All tables of the scan become current at once (``sources.staged``), from the version that the
scan began with. So a scan that fails leaves all of them as they were, and one that finds
nothing new writes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.operators import master, resolve
from tallyreef.sources import sinks, staged
from tallyreef.sources.scratch import written

# What a site's status adds to the history, and what a new product is called there.
ACTIONS, OTHER_ACTION, NEW_PRODUCT = (("抽選", "抽選追加"), ("予約", "予約追加")), "商品追加", "新商品"
PRODUCTS, MASTER, HISTORY = "products", "master", "history"
#: What makes an event of the history one and the same.
EVENT = ("store_id", "action", "product_id", "occurred_at")


def action(status: Column) -> Column:
    """What a site of that status adds."""
    chain = F
    for word, name in ACTIONS:
        chain = chain.when(F.contains(F.coalesce(status, F.lit("")), F.lit(word)), name)
    return chain.otherwise(OTHER_ACTION)


def site_events(products: DataFrame, sites: DataFrame, row: str) -> DataFrame:
    """Events of the sites that have a time, each once; sites have row, store_id, status and occurred_at."""
    joined = sites.filter(F.col("occurred_at").isNotNull()).join(products.select(row, "product_id", "name"), row)
    events = joined.select("store_id", action(F.col("status")).alias("action"), "product_id", "occurred_at", F.col("name").alias("detail"))
    return events.groupBy(*EVENT).agg(F.min("detail").alias("detail"))


@dataclass
class Scan:
    """What a scan found: rows that users see, new events and new records, and the store's version after it."""

    visible: DataFrame
    new_events: int
    new_records: int
    version: int


def scan(spark: SparkSession, path: str, products: DataFrame, sites: DataFrame, state: DataFrame, row: str, now: Column, days: int = 183, fields: Sequence[str] = ()) -> Scan:
    """Scan products (prepared rows with row, product_id, name, release) against the tables of the store at path.

    ``state`` has product_id and what a user keeps of it. Products whose release is more than
    ``days`` ago are not seen; a bad or missing date is.
    """
    began = staged.manifest(path)["version"]
    repaired = written(master.split_conflicting_ids(products, "product_id", row).select(row, "product_id", "old_id", "split", "name", "release", *fields), "scan-products")
    known, past = staged.read(spark, path, MASTER), staged.read(spark, path, HISTORY)
    first = resolve.first_wins(repaired.select("product_id", row, "name", "release"), ["product_id"], [row])
    new = first if known is None else first.join(known.select("product_id"), "product_id", "left_anti")
    new = written(new.withColumn("created_at", F.date_format(now, "yyyy-MM-dd HH:mm:ss")), "scan-new")
    made = new.select(F.lit("").alias("store_id"), F.lit(NEW_PRODUCT).alias("action"), "product_id", F.col("created_at").alias("occurred_at"), F.col("name").alias("detail"))
    events = site_events(repaired, sites, row).unionByName(made)
    fresh = written(events if past is None else events.join(past.select(*EVENT), list(EVENT), "left_anti").select(*events.columns), "scan-events")
    before = staged.read(spark, path, PRODUCTS)
    n_events, n_new = fresh.count(), new.count()
    version = began
    if n_events or n_new or before is None or sinks.differs(before, repaired):
        tables = {PRODUCTS: repaired, MASTER: new if known is None else known.unionByName(new), HISTORY: fresh if past is None else past.unionByName(fresh)}
        version = staged.write_all(tables, path, began)
    release = F.col("release").try_cast("date")
    seen = repaired.filter(release.isNull() | (F.date_diff(now, release) <= days)).join(state, "product_id", "left")
    return Scan(seen, n_events, n_new, version)
