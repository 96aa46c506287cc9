"""Queries that search shops for products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.functions import money
from tallyreef.operators import searches
from tallyreef.sources.tables import table

LEAST, LIKELY, SURE, DETAILS = 0.72, 0.55, 0.82, 3


def _retail_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as candidates, lines as offers of suppliers; a supplier's nation tells its categories."""
    shops = table(spark, sf, "supplier")
    few = F.when(F.col("s_nationkey") < 10, F.array(F.lit("ECONOMY"), F.lit("PROMO"))).when(F.col("s_nationkey") < 20, F.array(F.lit("STANDARD"), F.lit("LARGE"), F.lit("MEDIUM"))).otherwise(F.array().cast("array<string>"))
    plugins = shops.select(F.col("s_suppkey").alias("plugin"), F.col("s_nationkey").alias("rank"), few.alias("categories"))
    line = table(spark, sf, "lineitem")
    offers = line.select(
        F.col("l_partkey").alias("term"), F.col("l_suppkey").alias("plugin"), F.concat(F.lit("/"), "l_suppkey", F.lit("/"), "l_linestatus", "l_returnflag").alias("url"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).alias("sale"), (1 - 5 * F.col("l_discount")).alias("confidence"),
        (F.col("l_tax") < 0.07).alias("verified"), F.when(F.col("l_shipdate") < "1994-01-01", "中古").otherwise("新品").alias("wording"), "l_orderkey", "l_linenumber", "l_shipdate",
    )
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_partkey").alias("term"), "p_type", F.floor("p_retailprice").alias("reference"))
    verdict = money.price_verdict(F.col("wording"), F.col("verified"), F.col("reference"), F.col("sale"), F.lit(1.5), {"used": "中古"})
    return searches.fan_out(parts, offers, plugins, "p_partkey", "p_type", "term", ["l_orderkey", "l_linenumber", "l_shipdate"], ["plugin", "url"], "confidence", LEAST, verdict, line.count())


def retail_search(spark: SparkSession, sf: str) -> DataFrame:
    """What the search over all shops finds for each product, and why other hits fell out."""
    found = searches.search_counters(_retail_hits(spark, sf), "p_partkey", "plugin")
    return found.withColumn("reasons", F.coalesce(F.array_join(F.transform("reasons", lambda x: F.concat(x["outcome"], F.lit(":"), x["n"].cast("string"))), ","), F.lit("")))


def retail_offers(spark: SparkSession, sf: str) -> DataFrame:
    """The offers that are accepted, the first of each address."""
    return _retail_hits(spark, sf).filter(F.col("outcome") == searches.ACCEPTED).select("p_partkey", "plugin", "url", "sale", "l_orderkey", "l_linenumber")


def _staged_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as listings of products, found by part; orders as their detail pages."""
    line = table(spark, sf, "lineitem").select("l_partkey", F.col("l_orderkey").alias("address"), "l_linenumber", "l_suppkey", "l_shipdate", (F.col("l_quantity") / 50).alias("look"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("state"))
    details = table(spark, sf, "orders").select(F.col("o_orderkey").alias("address"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("state"), "o_totalprice")
    final = F.when(F.col("state") == "F", F.greatest(F.col("look"), F.lit(0.9))).when(F.col("o_totalprice") < 20_000, F.lit(0.1)).otherwise(F.col("look"))
    reason = searches.by_reason({"cheap": F.col("o_totalprice") < 20_000, "state": F.col("state") == "O"})
    return searches.staged(line, details, "l_partkey", "address", ["l_linenumber", "l_suppkey", "l_shipdate", "address"], F.col("look"), LIKELY, DETAILS, ["state", "o_totalprice"], final, SURE, reason)


def staged_search(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of each product whose details were read, with their confidence."""
    return _staged_hits(spark, sf).filter("confidence is not null").select("l_partkey", "address", "state", "confidence", "outcome")


def staged_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why listings fell out, at which stage, counted."""
    return searches.reason_histogram(_staged_hits(spark, sf))


QUERIES = {f.__name__: f for f in (retail_search, retail_offers, staged_search, staged_reasons)}

_RETAIL = f"""WITH m AS (SELECT p.p_partkey, p.p_type, floor(p.p_retailprice)::BIGINT AS reference, s.s_suppkey AS plugin, '/' || l_suppkey || '/' || l_linestatus || l_returnflag AS url, floor(l_extendedprice / l_quantity)::BIGINT AS sale, 1 - 5 * l_discount AS confidence, l_tax, l_shipdate, l_orderkey, l_linenumber, s_nationkey
    FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE s_nationkey >= 20 OR (s_nationkey < 10 AND p_type IN ('ECONOMY', 'PROMO')) OR (s_nationkey >= 10 AND p_type IN ('STANDARD', 'LARGE', 'MEDIUM'))),
  h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY p_partkey, plugin, url ORDER BY s_nationkey, l_orderkey, l_linenumber, l_shipdate) > 1 THEN 'duplicate' WHEN confidence < {LEAST}::DOUBLE THEN 'unsure' WHEN l_shipdate < '1994-01-01' THEN 'used' WHEN l_tax >= 0.07 THEN 'seller' WHEN sale > round_even(reference * 1.5::DOUBLE, 0) THEN 'price' ELSE 'accepted' END AS outcome FROM m)"""
_STAGED = f"""WITH a AS (SELECT l_partkey, l_orderkey AS address, l_linenumber, l_suppkey, l_shipdate, l_quantity / 50 AS look, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS state FROM lineitem),
  b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, address ORDER BY l_linenumber, l_suppkey, l_shipdate) AS f FROM a),
  c AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, f = 1 AND look >= {LIKELY}::DOUBLE ORDER BY l_linenumber, l_suppkey, l_shipdate, address) AS place FROM b),
  d AS (SELECT *, CASE WHEN f > 1 THEN 'duplicate' WHEN look < {LIKELY}::DOUBLE THEN 'preliminary' WHEN place > {DETAILS} THEN 'detail_limit' END AS early FROM c),
  e AS (SELECT d.* REPLACE (coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, state) AS state), o_totalprice AS price FROM d LEFT JOIN orders ON o_orderkey = address WHERE early IS NULL),
  g AS (SELECT *, CASE WHEN state = 'F' THEN greatest(look, 0.9::DOUBLE) WHEN price < 20000 THEN 0.1::DOUBLE ELSE look END AS confidence FROM e),
  h AS (SELECT l_partkey, address, state, confidence, CASE WHEN coalesce(confidence, 0) >= {SURE}::DOUBLE THEN 'accepted' WHEN price < 20000 THEN 'cheap' WHEN state = 'O' THEN 'state' ELSE 'unsure' END AS outcome FROM g)"""
ORACLE_SQL = {
    "retail_search": f"""{_RETAIL}, r AS (SELECT p_partkey, string_agg(outcome || ':' || n, ',' ORDER BY outcome) AS reasons FROM (SELECT p_partkey, outcome, count(*) AS n FROM h WHERE outcome IN ('used', 'seller', 'price') GROUP BY ALL) GROUP BY 1)
        SELECT p_partkey, count(*) AS hits, count_if(outcome = 'duplicate') AS duplicates, count_if(outcome = 'unsure') AS unsure, count_if(outcome IN ('used', 'seller', 'price')) AS excluded, count_if(outcome = 'accepted') AS accepted, count(DISTINCT plugin) FILTER (WHERE outcome NOT IN ('duplicate', 'unsure')) AS found_shops, count(DISTINCT plugin) FILTER (WHERE outcome = 'accepted') AS regular_shops, coalesce(any_value(reasons), '') AS reasons
        FROM h LEFT JOIN r USING (p_partkey) GROUP BY 1""",
    "retail_offers": f"{_RETAIL} SELECT p_partkey, plugin, url, sale, l_orderkey, l_linenumber FROM h WHERE outcome = 'accepted'",
    "staged_search": f"{_STAGED} SELECT * FROM h",
    "staged_reasons": f"{_STAGED} SELECT outcome, count(*) AS n FROM (SELECT outcome FROM h UNION ALL SELECT early FROM d WHERE early IS NOT NULL) GROUP BY 1",
}
