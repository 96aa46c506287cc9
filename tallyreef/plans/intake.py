"""Queries over what comes in: offers, messages, candidates, promotions, and the figures of the home page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.functions import money, names, text
from tallyreef.operators import aggregates as agg
from tallyreef.operators import ordered_merge, resolve, shapes
from tallyreef.plans.cases import pick, sql_pick
from tallyreef.plans.shops import first_match_sql
from tallyreef.sources.tables import table

NOW, TODAY = "2024-01-20 12:00:00", "1998-06-01"
_OFFERS = (("新品", "accepted"), ("中古 美品", "中古品"), ("オリパ", "オリパ"), ("引退品", "まとめ売り"), ("3 BOXセット", "抱き合わせ販売"), ("フリマ", "オークション・フリマ"), ("英語版", "海外版"), ("プレミア価格", "プレミア価格表記"), ("売り切れ", "販売終了・在庫切れ"), (None, "accepted"), ("通常品", "accepted"))
_SHOPS = (("shop", "", "", True, False, "accepted"), ("shop", "", "", False, True, "unverified"), ("amazon_jp", "Amazon.co.jp", "amazon japan g.k.", False, False, "accepted"), ("amazon_jp", "x", "Amazon.co.jp", True, True, "marketplace"), ("dmm_marketplace", "", "", True, False, "mall"), ("dmm_marketplace", "", "", True, True, "accepted"), ("rakuten_books", "楽天ブックス 本店", "", False, False, "accepted"), ("rakuten_books", "other", "", True, True, "third party"))
_KINDS = (("アクセサリー", 1.25), ("プレミアム商品", 1.10), ("構築デッキ", 1.20), ("何か", 1.15), (None, 1.15))


def offer_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Offers that are taken, and the first reason why others are not."""
    shop, seller, shipper, verified, official = (pick([s[i] for s in _SHOPS], "l_suppkey") for i in range(5))
    sale = F.floor(F.col("l_extendedprice") / F.col("l_quantity"))
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", sale.alias("sale")).join(table(spark, sf, "part").select("p_partkey", F.floor("p_retailprice").alias("price")), F.col("l_partkey") == F.col("p_partkey"))
    found = money.offer_verdict(pick([o[0] for o in _OFFERS], "l_orderkey"), shop, seller, shipper, verified, official, pick([k[0] for k in _KINDS], "l_linenumber"), F.when(F.col("l_partkey") % 6 > 0, F.col("price")), F.col("sale"))
    return line.groupBy(found.alias("verdict")).agg(F.count("*").alias("n"))


def mail_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as messages, those of users plain and all others HTML: the text that was sent."""
    said = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", ""), "[ \\t\\n\\r]+", " "))
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), said, F.lit(" &amp; "), "turn")
    html = F.concat(F.lit("Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n<b>"), said, F.lit("</b> &amp; "), "turn")
    body = F.regexp_replace(text.mail_text(F.when(F.col("role") == "user", plain).otherwise(html)), "[ \\t\\n\\r]+", " ")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.trim(body).alias("body"))


def candidate_intake(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by category and the first gate that stops them, as one map of reasons a category."""
    p = table(spark, sf, "part")
    known = p.filter("p_partkey % 4 = 0").groupBy(names.product_name(F.col("p_name")).alias("plain")).agg(F.count("*").alias("known"))
    rows = p.select("p_type", "p_size", "p_retailprice", names.product_name(F.col("p_name")).alias("plain")).join(known, "plain", "left")
    gates = [("confidence", F.col("p_retailprice") % 10 >= 3), ("window", F.col("p_size") <= 40), ("ambiguous", F.coalesce("known", F.lit(0)) <= 3)]
    counted = agg.histogram(rows.withColumn("reason", shapes.first_failing(gates)), ["p_type"], "reason")
    entries = F.transform(F.array_sort(F.map_entries("reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return counted.select("p_type", F.array_join(entries, ",").alias("reasons"))


def intake_promotions(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as candidates: the gates that stop them, known products that they are, candidates before them that they join, and those that become products."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), "p_retailprice")
    known = table(spark, sf, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("least"), F.count("*").alias("n")).filter("n > 12").select((F.col("least") - (1 << 40)).alias("p_partkey"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("int").alias("size"))
    gates = [("confidence", F.col("p_retailprice") % 10 >= 3), ("window", F.col("size") <= 40), ("kind", F.col("kind") != "PROMO")]
    return ordered_merge.intake(p, "p_partkey", gates, [("name", "kind"), ("brand", "size")], [F.col("name"), F.col("kind")], known).select("p_partkey", "reason", "head", "product_id")


def promoted_products(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmed rows as products: an id by name and type, the first row of each, how many there were."""
    p = table(spark, sf, "part").filter("p_size > 10").select(resolve.stable_id(F.col("p_name"), F.col("p_type")).alias("product_id"), "p_partkey", "p_name", "p_type")
    first = resolve.first_wins(p, ["product_id"], ["p_partkey"])
    return first.join(p.groupBy("product_id").agg(F.count("*").alias("rows")), "product_id")


def first_products(spark: SparkSession, sf: str) -> DataFrame:
    """The first 30 products that differ in name and size, in order."""
    p = table(spark, sf, "part").select("p_name", "p_size", "p_partkey")
    return resolve.first_wins(p, ["p_name", "p_size"], ["p_partkey"]).orderBy("p_partkey").limit(30)


def home_figures(spark: SparkSession, sf: str) -> DataFrame:
    """The home page's fourteen figures, of four tables, in one row."""
    o, e, p, s = (table(spark, sf, n) for n in ("orders", "events", "part", "supplier"))
    today, now = F.lit(TODAY).cast("date"), F.lit(NOW).cast("timestamp_ntz")
    day = F.col("o_orderdate").cast("date")
    parts = [
        o.agg(F.count("*").alias("applications"), F.count_if(F.col("o_orderstatus") == "P").alias("waiting"), F.count_if(F.col("o_orderstatus") == "F").alias("won"), F.count_if(day == today).alias("today"), F.count_if(day.between(today, F.date_add(today, 7))).alias("week"), F.count_if(F.col("o_totalprice") > 400000).alias("large")),
        e.agg(F.count_if(F.timestamp_diff("SECOND", F.col("ts"), now).between(0, 86400)).alias("new_events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users")),
        p.agg(F.count("*").alias("products"), F.count_if(F.col("p_type") == "PROMO").alias("promos"), F.countDistinct("p_brand").alias("brands")),
        s.agg(F.count_if(F.col("s_acctbal") > 0).alias("stores"), F.countDistinct("s_nationkey").alias("regions")),
    ]
    both = parts[0]
    for other in parts[1:]:
        both = both.unionByName(other, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def action_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Actions by nine rules with their priorities, in order of priority and title; the first 50."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    today = F.lit(TODAY).cast("date")
    ahead = F.date_diff(F.col("day"), today)
    kinds = [
        (1, "ends today", (F.col("o_orderstatus") == "O") & (ahead == 0)), (2, "ends tomorrow", (F.col("o_orderstatus") == "O") & (ahead == 1)), (3, "pay", (F.col("o_orderstatus") == "P") & ahead.between(-3, 3)),
        (4, "result due", (F.col("o_orderstatus") == "P") & (ahead < -30)), (5, "pick up", (F.col("o_orderstatus") == "F") & ahead.between(-60, -50)), (5, "large", (F.col("o_totalprice") > 450000) & ahead.between(0, 30)),
        (6, "new", (F.col("o_orderstatus") == "O") & ahead.between(2, 9)), (7, "urgent", (F.col("o_orderpriority") == "1-URGENT") & ahead.between(10, 20)), (8, "later", (F.col("o_orderstatus") == "O") & ahead.between(21, 23)),
    ]
    tasks = [(n, kind, o.filter(held).select("o_orderkey")) for n, kind, held in kinds]
    return shapes.task_union(tasks).select("priority", "kind", "o_orderkey").orderBy("priority", "kind", "o_orderkey").limit(50)


QUERIES = {f.__name__: f for f in (offer_policy, mail_bodies, candidate_intake, intake_promotions, promoted_products, first_products, home_figures, action_rules)}

_ACT = {
    "ends today": "o_orderstatus = 'O' AND a = 0", "ends tomorrow": "o_orderstatus = 'O' AND a = 1", "pay": "o_orderstatus = 'P' AND a BETWEEN -3 AND 3", "result due": "o_orderstatus = 'P' AND a < -30", "pick up": "o_orderstatus = 'F' AND a BETWEEN -60 AND -50",
    "large": "o_totalprice > 450000 AND a BETWEEN 0 AND 30", "new": "o_orderstatus = 'O' AND a BETWEEN 2 AND 9", "urgent": "o_orderpriority = '1-URGENT' AND a BETWEEN 10 AND 20", "later": "o_orderstatus = 'O' AND a BETWEEN 21 AND 23",
}
_PRIORITY = dict(zip(_ACT, (1, 2, 3, 4, 5, 5, 6, 7, 8), strict=True))
ORACLE_SQL = {
    "offer_policy": f"WITH x AS (SELECT {sql_pick([o[1] for o in _OFFERS], 'l_orderkey')} AS w, {sql_pick([s[5] for s in _SHOPS], 'l_suppkey')} AS s, {sql_pick([k[1] for k in _KINDS], 'l_linenumber')}::DOUBLE AS t, CASE WHEN l_partkey % 6 > 0 THEN floor(p_retailprice) END AS r, floor(l_extendedprice / l_quantity) AS sale FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT CASE WHEN w <> 'accepted' THEN w WHEN s <> 'accepted' THEN s WHEN sale > round_even(r * t, 0) THEN 'price' ELSE 'accepted' END AS verdict, count(*) AS n FROM x GROUP BY 1",
    "mail_bodies": "SELECT conv_id, turn, trim(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[<>&]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) || CASE WHEN role = 'user' THEN ' &amp; ' ELSE ' & ' END || turn) AS body FROM conversations",
    "candidate_intake": "WITH k AS (SELECT p_name AS nm, count(*) AS n FROM part WHERE p_partkey % 4 = 0 GROUP BY 1), r AS (SELECT p_type, CASE WHEN NOT p_retailprice % 10 >= 3 THEN 'confidence' WHEN p_size > 40 THEN 'window' WHEN coalesce(n, 0) > 3 THEN 'ambiguous' ELSE 'eligible' END AS reason FROM part LEFT JOIN k ON nm = p_name), c AS (SELECT p_type, reason, count(*) AS n FROM r GROUP BY 1, 2) SELECT p_type, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM c GROUP BY 1",
    "intake_promotions": f"""WITH RECURSIVE {first_match_sql("SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS brand, p_size AS size FROM part WHERE p_retailprice % 10 >= 3 AND p_size <= 40 AND p_type <> 'PROMO'", {"name": "VARCHAR", "kind": "VARCHAR", "brand": "VARCHAR", "size": "INTEGER"}, "(h.name = r.name AND h.kind = r.kind) OR coalesce(h.brand = r.brand AND h.size = r.size, false)", "SELECT min(p_partkey) - 1099511627776 AS id, p_name AS name, p_type AS kind, NULL::VARCHAR AS brand, NULL::INTEGER AS size FROM part GROUP BY p_name, p_type HAVING count(*) > 12")}
        SELECT p_partkey, CASE WHEN NOT p_retailprice % 10 >= 3 THEN 'confidence' WHEN p_size > 40 THEN 'window' WHEN p_type = 'PROMO' THEN 'kind' WHEN head = id THEN 'promoted' WHEN head < 0 THEN 'known' ELSE 'merged' END AS reason, head, CASE WHEN head = id THEN left(sha256(p_name || '|' || p_type), 16) END AS product_id FROM part LEFT JOIN f ON f.id = p_partkey""",
    "promoted_products": "SELECT left(sha256(p_name || '|' || p_type), 16) AS product_id, min(p_partkey) AS p_partkey, p_name, p_type, count(*) AS rows FROM part WHERE p_size > 10 GROUP BY p_name, p_type",
    "first_products": "SELECT p_name, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2 ORDER BY 3 LIMIT 30",
    "home_figures": f"SELECT o.*, e.*, p.*, s.* FROM (SELECT count(*) AS applications, count_if(o_orderstatus = 'P') AS waiting, count_if(o_orderstatus = 'F') AS won, count_if(o_orderdate::DATE = DATE '{TODAY}') AS today, count_if(o_orderdate::DATE BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 7) AS week, count_if(o_totalprice > 400000) AS large FROM orders) o, (SELECT count_if(trunc(epoch(TIMESTAMP '{NOW}' - ts)) BETWEEN 0 AND 86400 AND ts <= TIMESTAMP '{NOW}' + INTERVAL 1 SECOND - INTERVAL 1 MICROSECOND) AS new_events, count_if(event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events) e, (SELECT count(*) AS products, count_if(p_type = 'PROMO') AS promos, count(DISTINCT p_brand) AS brands FROM part) p, (SELECT count_if(s_acctbal > 0) AS stores, count(DISTINCT s_nationkey) AS regions FROM supplier) s",
    "action_rules": f"WITH o AS (SELECT *, o_orderdate::DATE - DATE '{TODAY}' AS a FROM orders), t AS ({' UNION ALL '.join(f'SELECT {_PRIORITY[k]} AS priority, {chr(39)}{k}{chr(39)} AS kind, o_orderkey FROM o WHERE {w}' for k, w in _ACT.items())}) SELECT * FROM t ORDER BY priority, kind, o_orderkey LIMIT 50",
}
