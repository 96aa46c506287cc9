"""Statistics queries: rates, dashboards, coverage, funnels, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.operators import aggregates as agg
from tallyreef.operators import shapes
from tallyreef.sources.tables import table


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


def win_rate_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as applications: finished is a win, open a loss, pending waits; rate by the customer's nation."""
    orders = _orders(spark, sf).select("o_custkey", "o_orderstatus")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rates = agg.win_rates(joined, ["n_name"], F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")
    return rates.orderBy(F.desc("total"), "n_name")


_RATES = """count(*) AS total, count_if(o_orderstatus = 'F') AS wins, count_if(o_orderstatus = 'O') AS losses,
  count(*) - count_if(o_orderstatus IN ('F', 'O')) AS waiting,
  count_if(o_orderstatus = 'F') * 100.0::DOUBLE / nullif(count_if(o_orderstatus IN ('F', 'O')), 0) AS win_rate,
  count_if(o_orderstatus IN ('F', 'O')) < 10 AS reference"""


def win_rate_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """The same by month."""
    orders = _orders(spark, sf).select("o_orderstatus", F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("month"))
    return agg.win_rates(orders, ["month"], F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")


def win_rate_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Priority, segment and both totals in one pass over the joined rows."""
    joined = _orders(spark, sf).select("o_custkey", "o_orderstatus", "o_orderpriority").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupingSets([["o_orderpriority"], ["c_mktsegment"], []], "o_orderpriority", "c_mktsegment").agg(
        F.grouping_id().alias("level"), F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("wins")
    )


def status_dashboard_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by status, zero-filled over all known statuses."""
    dimension = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "status string")
    counted = _orders(spark, sf).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))
    return agg.zero_filled(counted, dimension, ["status"], ["n", "customers"])


def multi_key_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts under each word of their name and their type, with the total."""
    parts = table(spark, sf, "part")
    words = spark.createDataFrame([("red",), ("small",), ("widget",), ("ring",), ("PROMO",), ("absent",)], "key string")
    return agg.counts_with_total(parts, F.concat(F.split("p_name", " "), F.array("p_type")), words)


def region_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and balance by region and nation, with totals; unknown nations are named so."""
    joined = (
        table(spark, sf, "customer").select("c_nationkey", "c_acctbal")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(F.coalesce("r_name", F.lit("unknown")).alias("region"), F.coalesce("n_name", F.lit("unknown")).alias("nation"), "c_acctbal")
    )
    return joined.rollup("region", "nation").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def coverage_percent(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of each region with a supplier in credit of 5000 or more, and the last day on which one of its suppliers shipped what was kept."""
    sent = table(spark, sf, "lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_shipdate").cast("date").cast("string").alias("success"))
    joined = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(sent, "s_suppkey", "left")
    return agg.coverage(joined, "n_regionkey", "n_nationkey", F.col("s_acctbal") >= 5000, "s_suppkey", "success")


def funnel_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Users seen, clicking and buying by user group of 10, over all groups of 0 to 20."""
    events = table(spark, sf, "events").select((F.col("user_id") % 21).alias("key"), "event_type")
    groups = spark.range(0, 21).select(F.col("id").alias("key"))
    stages = {"seen": events, "clicked": events.filter("event_type = 'click'"), "bought": events.filter("event_type = 'purchase' and key % 2 = 0")}
    return agg.funnel(groups, "key", stages)


def reason_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses of each priority as one text of sorted counts."""
    counted = agg.histogram(_orders(spark, sf), ["o_orderpriority"], "o_orderstatus")
    entries = F.transform(F.array_sort(F.map_entries("reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return counted.select("o_orderpriority", F.array_join(entries, ",").alias("reasons"))


def faceted_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Segments before their own filter, nations after it, priorities after both, in one pass."""
    joined = _orders(spark, sf).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    filters = [("segment", F.col("c_mktsegment") == "BUILDING"), ("nation", F.col("c_nationkey") < 5)]
    return agg.facets(joined, filters, [("segment", F.col("c_mktsegment"), 0), ("nation", F.col("c_nationkey"), 1), ("priority", F.col("o_orderpriority"), 2)])


def dashboard_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional counts of orders and customers in one row."""
    orders = _orders(spark, sf).agg(F.count_if(F.col("o_orderstatus") == "P").alias("waiting"), F.count_if(F.col("o_totalprice") > 400000).alias("large"), F.max("o_orderdate").cast("string").alias("latest"))
    customers = table(spark, sf, "customer").agg(F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.countDistinct("c_nationkey").alias("nations"))
    # Two rows of one table each, put together as their only values.
    both = orders.unionByName(customers, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def dashboard_all_filters(spark: SparkSession, sf: str) -> DataFrame:
    """All twelve filters of the list at once, in its order: period, kind, mode, channel, nation, region, favorites, new rows, near deadlines, category, state, keyword."""
    o = _orders(spark, sf).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    day, mode = F.col("o_orderdate").cast("date"), F.when(F.col("c_acctbal") > 6000, "HYBRID").when(F.col("c_acctbal") > 2000, "ONLINE").otherwise("STORE")
    wanted = shapes.snapshot(
        o.withColumn("day", day), period=day.between(F.lit("1993-01-01"), F.lit("1999-12-31")), o_orderpriority=["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], mode=mode != "STORE", channel=shapes.channel(mode, "online"), n_name="all", r_name=["AFRICA", "AMERICA", "ASIA", "EUROPE"],
        favorites=F.col("o_custkey") % 5 != 0, new=day >= F.lit("1994-06-01"), deadline=F.date_add(day, 30) <= F.lit("1999-01-15"), c_mktsegment=["BUILDING", "MACHINERY", "HOUSEHOLD"], state=shapes.any_state("O", "o_orderstatus", "o_orderpriority"), word=shapes.keyword("customer 1", "o_orderpriority", "c_name"),
    )
    return wanted.select("o_orderkey", F.col("day").cast("string").alias("day"), "n_name", "c_mktsegment")


def dashboard_filtered_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """A filtered and ranked list: statuses, segment, keyword, then the 50 first by status rank and date."""
    joined = _orders(spark, sf).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wanted = shapes.snapshot(joined, o_orderstatus=["P", "O"], c_mktsegment="BUILDING", region="all", word=shapes.keyword("high 2", "o_orderpriority", "c_name"))
    return (
        wanted.select("o_orderkey", "o_orderstatus", shapes.dated(F.col("o_orderdate").cast("date")).alias("day"), shapes.rank_of(F.col("o_orderstatus"), ["P", "O"]).alias("state_rank"))
        .orderBy("state_rank", "day", "o_orderkey").limit(50)
    )


def priority_state(spark: SparkSession, sf: str) -> DataFrame:
    """The most urgent state among each customer's orders."""
    flags = [("waiting", F.col("o_orderstatus") == "P"), ("open", F.col("o_orderstatus") == "O")]
    return _orders(spark, sf).groupBy("o_custkey").agg(agg.priority_of(flags, "done").alias("state"))


def grouped_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's first three orders in order, as one text."""
    rows = agg.grouped_rows(_orders(spark, sf), ["o_custkey"], "o_orderkey", ["o_orderstatus"], most=3)
    return rows.select("o_custkey", "first", F.array_join(F.transform("rows", lambda r: F.concat(r["o_orderkey"].cast("string"), r["o_orderstatus"])), ",").alias("rows"))


QUERIES = {f.__name__: f for f in (win_rate_by_nation, win_rate_by_month, win_rate_grouping_sets, status_dashboard_counts, multi_key_counts, region_rollup, coverage_percent, funnel_by_key, reason_histogram, faceted_counts, dashboard_kpis, dashboard_filtered_sorted, dashboard_all_filters, priority_state, grouped_rows)}

ORACLE_SQL = {
    "win_rate_by_nation": f"SELECT n_name, {_RATES} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "win_rate_by_month": f"SELECT strftime(o_orderdate, '%Y-%m') AS month, {_RATES} FROM orders GROUP BY 1",
    "win_rate_grouping_sets": "SELECT o_orderpriority, c_mktsegment, grouping(o_orderpriority, c_mktsegment) AS level, count(*) AS total, count_if(o_orderstatus = 'F') AS wins FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((o_orderpriority), (c_mktsegment), ())",
    "status_dashboard_counts": "SELECT status, count(o_orderkey) AS n, count(DISTINCT o_custkey) AS customers FROM (VALUES ('F'), ('O'), ('P'), ('X')) d(status) LEFT JOIN orders ON o_orderstatus = status GROUP BY status",
    "multi_key_counts": "WITH e AS (SELECT unnest(list_distinct(list_append(string_split(p_name, ' '), p_type))) AS key FROM part) SELECT d.key, count(e.key) AS n FROM (VALUES ('red'), ('small'), ('widget'), ('ring'), ('PROMO'), ('absent')) d(key) LEFT JOIN e USING (key) GROUP BY d.key UNION ALL SELECT 'all', count(*) FROM part",
    "region_rollup": "SELECT region, nation, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM (SELECT coalesce(r_name, 'unknown') AS region, coalesce(n_name, 'unknown') AS nation, c_acctbal FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey) GROUP BY ROLLUP (region, nation)",
    "coverage_percent": "SELECT n_regionkey, count(*) AS units, sum(c)::BIGINT AS covered, sum(s)::BIGINT AS size, max(l) AS last_success, round(sum(c) * 100.0::DOUBLE / count(*), 1) AS percent FROM (SELECT n_regionkey, n_nationkey, max((s_acctbal >= 5000)::INT) AS c, sum(s_suppkey) AS s, max(d) AS l FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, max(l_shipdate)::DATE::VARCHAR AS d FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON l_suppkey = s_suppkey GROUP BY 1, 2) GROUP BY 1",
    "funnel_by_key": "SELECT key, count(event_type) AS seen, count(*) FILTER (event_type = 'click') AS clicked, count(*) FILTER (event_type = 'purchase' AND key % 2 = 0) AS bought FROM range(21) d(key) LEFT JOIN events ON user_id % 21 = key GROUP BY key",
    "reason_histogram": "SELECT o_orderpriority, string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) AS reasons FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1",
    "faceted_counts": "WITH j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) SELECT 'segment' AS facet, c_mktsegment AS value, count(*) AS n FROM j GROUP BY 2 UNION ALL SELECT 'nation', c_nationkey::VARCHAR, count(*) FROM j WHERE c_mktsegment = 'BUILDING' GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM j WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5 GROUP BY 2",
    "dashboard_kpis": "SELECT (SELECT count_if(o_orderstatus = 'P') FROM orders) AS waiting, (SELECT count_if(o_totalprice > 400000) FROM orders) AS large, (SELECT max(o_orderdate)::VARCHAR FROM orders) AS latest, (SELECT count_if(c_acctbal < 0) FROM customer) AS in_debt, (SELECT count(DISTINCT c_nationkey) FROM customer) AS nations",
    "dashboard_all_filters": """SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, n_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
        WHERE o_orderdate::DATE BETWEEN DATE '1994-06-01' AND DATE '1998-12-16' AND o_orderpriority < '5' AND c_acctbal > 2000 AND r_name IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') AND o_custkey % 5 <> 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND o_orderstatus = 'O' AND contains(o_orderpriority || c_name, '1')""",
    "dashboard_filtered_sorted": "SELECT o_orderkey, o_orderstatus, o_orderdate::DATE::VARCHAR AS day, CASE o_orderstatus WHEN 'P' THEN 1 ELSE 2 END AS state_rank FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('P', 'O') AND c_mktsegment = 'BUILDING' AND contains(lower(o_orderpriority || ' ' || c_name), 'high') AND contains(lower(o_orderpriority || ' ' || c_name), '2') ORDER BY state_rank, day, o_orderkey LIMIT 50",
    "priority_state": "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'waiting' WHEN bool_or(o_orderstatus = 'O') THEN 'open' ELSE 'done' END AS state FROM orders GROUP BY 1",
    "grouped_rows": "SELECT o_custkey, min(o_orderkey) AS first, string_agg(o_orderkey || o_orderstatus, ',' ORDER BY o_orderkey) FILTER (r <= 3) AS rows FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1",
}
