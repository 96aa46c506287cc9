"""Queries over whole scans, which write tables of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.operators import product_scan
from tallyreef.plans.master import _SPLIT, _shared_ids
from tallyreef.sources import staged
from tallyreef.sources.scratch import scratch
from tallyreef.sources.tables import table

NOW = "1999-06-01 12:00:00"


def product_scans(spark: SparkSession, sf: str) -> DataFrame:
    """The same parts scanned twice: the second scan adds nothing; tables, events and visible rows counted."""
    now = F.lit(NOW).cast("timestamp_ntz")
    release = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").cast("date").cast("string").alias("release"))
    products = _shared_ids(spark, sf).join(release, "p_partkey", "left").withColumn("name", F.col("p_name"))
    status = F.when(F.col("l_returnflag") == "R", "抽選受付").when(F.col("l_returnflag") == "A", "予約受付中")
    sites = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("store_id"), status.alias("status"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate").cast("string")).alias("occurred_at"))
    state = table(spark, sf, "customer").select(F.concat(F.lit("id"), F.col("c_custkey").cast("string")).alias("product_id"), (F.col("c_acctbal") > 0).alias("favorite"))
    path = scratch(spark, "scan")
    first = product_scan.scan(spark, path, products, sites, state, "p_partkey", now)
    again = product_scan.scan(spark, path, products, sites, state, "p_partkey", now)
    history, known = staged.read(spark, path, product_scan.HISTORY), staged.read(spark, path, product_scan.MASTER)
    counts = history.groupBy(F.col("action").alias("what")).agg(F.count("*").alias("n"))
    counts = counts.unionByName(known.agg(F.lit("master").alias("what"), F.count("*").alias("n"))).unionByName(again.visible.agg(F.lit("visible").alias("what"), F.count("*").alias("n"))).unionByName(again.visible.agg(F.lit("favorites").alias("what"), F.count_if("favorite").alias("n")))
    told = [("second scan", again.new_events + again.new_records), ("versions", first.version + again.version)]
    return counts.unionByName(spark.createDataFrame(told, "what string, n long"))


QUERIES = {f.__name__: f for f in (product_scans,)}

ORACLE_SQL = {
    "product_scans": f"""{_SPLIT}, i AS (SELECT p_partkey, split, CASE WHEN NOT split THEN pid WHEN n = 0 THEN own ELSE left(sha256(own || '|' || n), 16) END AS product_id FROM n),
      e AS (SELECT DISTINCT l_suppkey, CASE l_returnflag WHEN 'R' THEN '抽選追加' WHEN 'A' THEN '予約追加' ELSE '商品追加' END AS action, product_id, l_shipdate FROM lineitem JOIN i ON p_partkey = l_partkey WHERE l_linestatus = 'F'),
      v AS (SELECT product_id, c_acctbal FROM i LEFT JOIN (SELECT l_partkey, max(l_shipdate)::DATE AS release FROM lineitem GROUP BY 1) ON l_partkey = p_partkey LEFT JOIN customer ON product_id = 'id' || c_custkey WHERE release IS NULL OR DATE '1999-06-01' - release <= 183)
      SELECT action AS what, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT '新商品', count(DISTINCT product_id) FROM i UNION ALL SELECT 'master', count(DISTINCT product_id) FROM i UNION ALL SELECT 'visible', count(*) FROM v UNION ALL SELECT 'favorites', count_if(coalesce(c_acctbal > 0, false)) FROM v UNION ALL SELECT 'second scan', 0 UNION ALL SELECT 'versions', 2""",
}
