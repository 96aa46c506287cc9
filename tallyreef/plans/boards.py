"""Queries behind lists, calendars, monitors and source diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyreef.functions import rules, text, urls
from tallyreef.operators import aggregates as agg
from tallyreef.operators import joins, shapes, windows
from tallyreef.plans.cases import pick, sql_pick
from tallyreef.sources.tables import table

_CATEGORIES = ("onepiece", "gundam", "pokemon", "union_arena", "dragon_ball_fusion_world", "mtg")
_KINDS = ("ブースターパック", "その他", "スタートデッキ", "アクセサリー")
_NAMES = ("カードセット", "スリーブ set", "event カード", "案内", "")
_LINKS = ("https://a.example/x", "http://a.example/x", "https://a.example/cardlist/")
NOW = "2024-01-20 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def release_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Products that may be new releases, and those that are not archived, counted by category."""
    o = table(spark, sf, "orders")
    date = F.when(F.col("o_orderkey") % 9 == 0, F.lit("")).when(F.col("o_orderkey") % 10 == 0, F.lit("1996-13-01")).otherwise(F.col("o_orderdate").cast("date").cast("string"))
    today, category = F.lit("1996-06-01").cast("date"), pick(_CATEGORIES, "o_orderkey")
    new = shapes.new_release(category, pick(_KINDS, "o_custkey"), pick(_NAMES, "o_orderkey"), date, F.col("o_orderstatus") == "F", pick(_LINKS, "o_custkey"), today)
    return o.groupBy(category.alias("category"), new.alias("new"), shapes.not_archived(date, today).alias("shown")).agg(F.count("*").alias("n"))


def notification_list(spark: SparkSession, sf: str) -> DataFrame:
    """Notifications of a day, category and word that are not read, and all that are not read, counted."""
    e = table(spark, sf, "events").withColumn("read", F.col("event_id") % 3 == 0)
    held = shapes.keyword("click", "event_type") & ~F.col("read") & F.col("ts").cast("string").startswith("2024-01-1")
    return e.agg(F.count_if(held).alias("listed"), F.count_if(~F.col("read")).alias("unread"), F.count_if(shapes.in_category(F.array("event_type", F.lit("any")), "view")).alias("views"))


def calendar_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the month and in the week of a day, counted by type."""
    e = table(spark, sf, "events")
    month, week = shapes.same_span(F.col("ts"), _now(), "month"), shapes.same_span(F.col("ts"), _now(), "week")
    return e.groupBy("event_type").agg(F.count_if(month).alias("month"), F.count_if(week).alias("week"))


def index_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of pages that stay on their site and have a word, marked as new or known, counted."""
    p = table(spark, sf, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("target"))
    known = p.filter("page_id % 5 = 0").select("target").distinct().withColumn("known", F.lit(True))
    links = p.filter("page_id % 5 <> 0").filter(F.lower("target").rlike("an|th")).select("target").distinct().join(known, "target", "left")
    return links.groupBy(F.coalesce("known", F.lit(False)).alias("known")).agg(F.count("*").alias("n"))


def source_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of a chain and address as one: most branches, sorted distinct categories, number of rows."""
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_quantity").cast("int").alias("branches"), "l_linestatus")
    found = line.groupBy("l_suppkey", "l_returnflag").agg(F.max("branches").alias("branches"), F.array_sort(F.collect_set("l_linestatus")).alias("kinds"), F.count("*").alias("n"))
    return found.select("l_suppkey", "l_returnflag", "branches", F.array_join("kinds", ",").alias("kinds"), "n")


def monitor_states(spark: SparkSession, sf: str) -> DataFrame:
    """State of each account's monitor by its latest retry and request."""
    e = table(spark, sf, "events")
    by = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 1 DAY"))).alias("retry"), F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last"))
    state = rules.first_match([("limited", F.col("retry") > _now()), ("fresh", F.timestamp_diff("SECOND", F.col("last"), _now()) <= 3 * 86400), ("waiting", F.col("last").isNotNull())], "unset")
    return by.select("user_id", state.alias("state"))


def account_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Highest post id as a number, posts, and share of confirmed ones of each account; accounts without posts have none."""
    accounts = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    e = table(spark, sf, "events").select("user_id", F.col("event_id").cast("string").alias("post"), "event_type")
    seen = e.groupBy("user_id").agg(F.max(F.col("post").try_cast("decimal(38,0)")).cast("long").alias("last_post"), F.count("*").alias("posts"), F.count_if(F.col("event_type") == "purchase").alias("confirmed"), F.count_if(F.col("event_type") == "error").alias("rejected"))
    out = joins.with_fallback_counts(accounts, seen, ["user_id"], ["last_post", "posts", "confirmed", "rejected"])
    return out.withColumn("accuracy", F.round(F.try_divide(F.col("confirmed") * 1.0, F.col("confirmed") + F.col("rejected")), 4))


def scan_histograms(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a scan by language, by source, and in all, in one pass, with those that need a review."""
    d = table(spark, sf, "documents").select("lang", "source", F.length("text").alias("size"))
    return d.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if(F.col("size") < 200).alias("review"))


def adapter_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of each adapter: hits, confirmed ones, errors, distinct sites, and a word for it all."""
    e = table(spark, sf, "events")
    by = e.groupBy(F.pmod("user_id", F.lit(12)).alias("adapter")).agg(F.count("*").alias("hits"), F.count_if(F.col("event_type") == "purchase").alias("confirmed"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("sites"))
    return by.withColumn("outcome", F.when(F.col("errors") * 4 > F.col("hits"), "failing").when(F.col("confirmed") > 0, "found").otherwise("empty"))


def search_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of a search as JSON: searched sites by kind of message, and the sum of what they tell."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return e.groupBy("event_type").agg(F.countDistinct("user_id").alias("sites"), F.sum(F.coalesce("k", F.lit(0))).alias("told"))


def rotation(spark: SparkSession, sf: str) -> DataFrame:
    """The account of each nation that is next in turn."""
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey")
    return shapes.rotated(c, ["c_nationkey"], [F.col("c_custkey")], F.col("c_nationkey") * 7 + 3)


def post_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with their users, and accounts by name in any case; posts of other users stay without an account."""
    posts = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.upper("c_name").alias("name"))
    accounts = table(spark, sf, "customer").filter("c_custkey % 4 = 0").select(F.lower("c_name").alias("key"), F.col("c_mktsegment").alias("tier"))
    joined = posts.join(users, "user_id", "left").join(accounts, F.lower("name") == F.col("key"), "left")
    return joined.groupBy("tier", "event_type").agg(F.count("*").alias("n"), F.count("name").alias("named"))


def discovery_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Discoveries that merge with the one candidate of their key, are ambiguous, or make a new one, counted."""
    known = table(spark, sf, "part").filter("p_partkey % 3 = 0").select(F.concat("p_name", "p_size").alias("key"), "p_partkey")
    found = table(spark, sf, "part").select(F.concat("p_name", F.col("p_size") + 1).alias("key"), F.col("p_partkey").alias("id"))
    return joins.discovered(found, known, "key", "p_partkey").groupBy("action").agg(F.count("*").alias("n"), F.count("target").alias("targets"))


def corroborated_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts that a web hit of the same user and day backs: the first one, and what that adds to their confidence."""
    e = table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    hits = e.filter("event_type = 'purchase' and value < 90").groupBy("user_id", "day").agg(F.min("event_id").alias("hit"))
    posts = e.filter("event_type = 'view'").join(hits, ["user_id", "day"], "left")
    return posts.select("event_id", "hit", F.least(F.lit(100), F.floor("value") + F.when(F.col("hit").isNotNull(), 15).otherwise(0)).alias("confidence"))


def evidence_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by the first line that rejects or confirms them, counted."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_returnflag", "l_quantity")
    found = joins.verified(o, line, "key", "l_linenumber", (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), F.col("l_quantity") > 30, F.col("o_orderstatus") == "P")
    return found.groupBy("status").agg(F.count("*").alias("n"))


def favorites_list(spark: SparkSession, sf: str) -> DataFrame:
    """Favourite products, those of a kind, by falling priority, then size and name; the first 30."""
    favorites = table(spark, sf, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    p = table(spark, sf, "part").join(favorites, "p_partkey", "left_semi").filter("p_type <> 'PROMO'")
    priority = F.when(F.col("p_size") > 40, 5).when(F.col("p_size") > 20, 3).otherwise(1)
    return p.select("p_partkey", priority.alias("priority"), "p_size", "p_name").orderBy(F.desc("priority"), "p_size", "p_name", "p_partkey").limit(30)


def previews(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of three lists: six favourites, five notifications, six new orders."""
    lists = [("favorites", table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("at")), 6), ("notices", table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("at")), 5), ("orders", table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("at")), 6)]
    out = None
    for name, rows, n in lists:
        head = rows.orderBy(F.desc("at"), "id").limit(n).select(F.lit(name).alias("list"), "id")
        out = head if out is None else out.unionByName(head)
    return out


def official_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of allowed hosts whose text holds a word or a code, counted."""
    p = table(spark, sf, "pages").select("page_id", F.col("html"), urls.in_domain(F.col("url"), F.lit("example.com")).alias("allowed"))
    held = F.lower("html").contains("thing") | F.col("html").rlike(r"\bOP-\d{2}\b")
    return p.groupBy((F.col("allowed") & held).alias("official")).agg(F.count("*").alias("n"))


def new_stores(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that no setting knows, under their present names; new ones are off. Legacy names are none that a supplier has."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("key"))
    legacy = F.concat(F.lit("legacy-"), "key")
    settings = s.filter("s_suppkey % 3 = 0").select(F.when(F.col("s_suppkey") % 2 == 0, legacy).otherwise(F.col("key")).alias("key"), (F.col("s_suppkey") % 4 > 0).alias("enabled"))
    renamed = s.select(legacy.alias("key"), F.col("key").alias("present"))
    return joins.new_members(s, settings, "key", renamed, "enabled").withColumn("key", F.col("key").cast("long"))


def merged_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as web rows and customers as posts: equal ones, by nation and balance or by the number in their name, put together."""
    make = lambda df, p, k: df.select(F.col(k).alias("row"), F.col(f"{p}_nationkey").alias("nation"), F.floor(F.col(f"{p}_acctbal") / 50).alias("band"), F.regexp_extract(f"{p}_name", "#0*([0-9]+)", 1).alias("tail"), F.concat(F.lit(p), k).alias("proof"), F.round(F.abs(F.col(f"{p}_acctbal")) / 10000, 4).alias("sure"))
    found = joins.two_sources(make(table(spark, sf, "supplier"), "s", "s_suppkey"), make(table(spark, sf, "customer"), "c", "c_custkey"), [("nation", "band"), ("tail",)], "row", "proof", "sure")
    return found.select("row", "source", F.array_join("evidence", ",").alias("evidence"), F.col("confidence"))


def mail_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The latest 100 messages of the last 7 days that were not processed before."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    seen = e.filter("event_id % 6 = 0").select("user_id", "event_id")
    recent = e.filter(F.col("ts").between(_now() - F.expr("INTERVAL 7 DAYS"), _now()))
    return joins.unseen(recent, seen, ["user_id", "event_id"]).orderBy(F.desc("ts"), "event_id").limit(100).select("user_id", "event_id")


def state_updates(spark: SparkSession, sf: str) -> DataFrame:
    """State of each row after all updates: the last one counts, and one that takes an application back clears the result."""
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("applied"), F.col("event_type").alias("result"))
    last = windows.ranked(e, ["user_id"], [F.desc("event_id")])
    return last.select("user_id", "applied", F.when(F.col("applied"), F.col("result")).otherwise("").alias("result"))


def exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that remain and keys that are excluded after rows were deleted."""
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("key"))
    gone = p.filter("p_partkey % 10 = 0")
    left = p.join(gone.select("key").distinct(), "key", "left_anti")
    return left.agg(F.count("*").alias("n")).select(F.lit("left").alias("what"), "n").unionByName(gone.agg(F.countDistinct("key").alias("n")).select(F.lit("excluded").alias("what"), "n"))


def duplicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Products distinct by address, else by name and date, with how many were dropped."""
    p = table(spark, sf, "part").select(F.coalesce(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("u"), F.col("p_partkey") % 50)), F.concat_ws("|", "p_name", "p_size")).alias("key"))
    return p.agg(F.countDistinct("key").alias("kept"), (F.count("*") - F.countDistinct("key")).alias("dropped"))


def priority_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The first candidate of each priority class and the order in which classes come."""
    e = table(spark, sf, "events").withColumn("class", F.when(F.col("value") > 80, "HIGH").when(F.col("value") > 20, "NORMAL").otherwise("LOW"))
    first = windows.ranked(e, ["class"], [F.col("ts"), F.col("event_id")])
    return first.select("class", "event_id", shapes.rank_of(F.col("class"), ["HIGH", "NORMAL", "LOW"]).alias("place"))


def category_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a run by trust tier, with zeros for tiers without any, ordered by the tiers' places."""
    tiers = spark.createDataFrame([("official", 1), ("store", 2), ("info", 3), ("none", 4)], "tier string, place int")
    s = table(spark, sf, "supplier").select(F.when(F.col("s_acctbal") > 5000, "official").when(F.col("s_acctbal") > 0, "store").otherwise("info").alias("tier"))
    counted = s.groupBy("tier").agg(F.count("*").alias("n"))
    return agg.zero_filled(counted, tiers.select("tier"), ["tier"], ["n"]).join(tiers, "tier").orderBy("place")


def running_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders with their place and the total so far."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.row_number().over(w).alias("place"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("so_far"))


QUERIES = {f.__name__: f for f in (
    release_candidates, notification_list, calendar_spans, index_links, source_groups, monitor_states, account_observations, scan_histograms, adapter_outcomes, search_diagnostics, rotation, post_candidates, discovery_merge, corroborated_posts,
    evidence_verdicts, favorites_list, previews, official_documents, new_stores, merged_sources, mail_scan, state_updates, exclusions, duplicate_counts, priority_queue, category_run_summary, running_positions,
)}

_N = f"TIMESTAMP '{NOW}'"
_CAT = sql_pick(_CATEGORIES, "o_orderkey")
_DATE = "CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 10 = 0 THEN '1996-13-01' ELSE o_orderdate::DATE::VARCHAR END"
ORACLE_SQL = {
    "release_candidates": f"WITH x AS (SELECT {_CAT} AS c, {sql_pick(_KINDS, 'o_custkey')} AS k, {sql_pick(_NAMES, 'o_orderkey')} AS nm, {_DATE} AS d, TRY_CAST({_DATE} AS DATE) AS dd, o_orderstatus = 'F' AS off, {sql_pick(_LINKS, 'o_custkey')} AS u FROM orders), y AS (SELECT *, DATE '1996-06-01' - dd AS age FROM x) SELECT c AS category, CASE WHEN c IN ('pokemon', 'mtg') THEN nm <> '' ELSE (k IN ('ブースターパック', 'スタートデッキ') OR (k = 'その他' AND c IN ('onepiece', 'gundam'))) AND (k <> 'その他' OR (NOT regexp_matches(lower(nm), 'スリーブ|プレイマット|ケース|アクセサリー|sleeve|playmat|case') AND regexp_matches(lower(nm), 'カード|セット|コレクション|card|set|collection'))) AND CASE WHEN d = '' THEN c <> 'gundam' AND off ELSE coalesce(age BETWEEN -730 AND 45, false) END AND u LIKE 'https://%' AND NOT regexp_matches(lower(nm || ' ' || u), 'cardlist|event|rule') END AS new, coalesce(age <= 183, true) AS shown, count(*) AS n FROM y GROUP BY 1, 2, 3",
    "notification_list": "SELECT count_if(event_type = 'click' AND event_id % 3 <> 0 AND ts::VARCHAR LIKE '2024-01-1%') AS listed, count_if(event_id % 3 <> 0) AS unread, count_if(event_type = 'view') AS views FROM events",
    "calendar_spans": f"SELECT event_type, count_if(date_trunc('month', ts) = date_trunc('month', {_N})) AS month, count_if(date_trunc('week', ts) = date_trunc('week', {_N})) AS week FROM events GROUP BY 1",
    "index_links": "WITH l AS (SELECT DISTINCT page_id % 5 = 0 AS old, unnest(list_distinct(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1))) AS target FROM pages) SELECT target IN (SELECT target FROM l WHERE old) AS known, count(*) AS n FROM l WHERE NOT old AND regexp_matches(lower(target), 'an|th') GROUP BY 1",
    "source_groups": "SELECT l_suppkey, l_returnflag, max(l_quantity::INT) AS branches, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS kinds, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "monitor_states": f"WITH x AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'error') + INTERVAL 1 DAY AS retry, max(ts) FILTER (WHERE event_type <> 'error') AS last FROM events GROUP BY 1) SELECT user_id, CASE WHEN retry > {_N} THEN 'limited' WHEN trunc(epoch({_N} - last)) <= 259200 THEN 'fresh' WHEN last IS NOT NULL THEN 'waiting' ELSE 'unset' END AS state FROM x",
    "account_observations": "WITH s AS (SELECT user_id, max(event_id) AS l, count(*) AS n, count_if(event_type = 'purchase') AS c, count_if(event_type = 'error') AS r FROM events GROUP BY 1) SELECT c_custkey AS user_id, coalesce(l, 0) AS last_post, coalesce(n, 0) AS posts, coalesce(c, 0) AS confirmed, coalesce(r, 0) AS rejected, round(c::DOUBLE / nullif(c + r, 0), 4) AS accuracy FROM customer LEFT JOIN s ON user_id = c_custkey",
    "scan_histograms": "SELECT lang, source, GROUPING_ID(lang, source) AS level, count(*) AS n, count_if(length(text) < 200) AS review FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
    "adapter_outcomes": "WITH x AS (SELECT user_id % 12 AS adapter, count(*) AS hits, count_if(event_type = 'purchase') AS confirmed, count_if(event_type = 'error') AS errors, count(DISTINCT user_id) AS sites FROM events GROUP BY 1) SELECT *, CASE WHEN errors * 4 > hits THEN 'failing' WHEN confirmed > 0 THEN 'found' ELSE 'empty' END AS outcome FROM x",
    "search_diagnostics": "SELECT event_type, count(DISTINCT user_id) AS sites, sum(coalesce((props->>'$.k')::INT, 0))::BIGINT AS told FROM events GROUP BY 1",
    "rotation": "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE i = (c_nationkey * 7 + 3) % n",
    "post_candidates": "SELECT CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS tier, event_type, count(*) AS n, count(c_custkey) AS named FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY 1, 2",
    "discovery_merge": "WITH k AS (SELECT p_name || p_size AS key, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), f AS (SELECT coalesce(n, 0) AS n FROM part LEFT JOIN k ON key = p_name || (p_size + 1)) SELECT CASE WHEN n = 1 THEN 'merge' WHEN n > 1 THEN 'ambiguous' ELSE 'create' END AS action, count(*) AS n, count_if(n = 1) AS targets FROM f GROUP BY 1",
    "corroborated_posts": "WITH h AS (SELECT user_id, ts::DATE AS day, min(event_id) AS hit FROM events WHERE event_type = 'purchase' AND value < 90 GROUP BY 1, 2) SELECT event_id, hit, least(100, floor(value)::BIGINT + CASE WHEN hit IS NULL THEN 0 ELSE 15 END) AS confidence FROM events e LEFT JOIN h ON h.user_id = e.user_id AND h.day = e.ts::DATE WHERE event_type = 'view'",
    "evidence_verdicts": "WITH l AS (SELECT l_orderkey, min(l_linenumber) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 40) AS no, min(l_linenumber) FILTER (WHERE l_quantity > 30 AND NOT (l_returnflag = 'R' AND l_quantity > 40)) AS yes FROM lineitem GROUP BY 1) SELECT CASE WHEN o_orderstatus = 'P' THEN 'rejected' WHEN no IS NOT NULL AND (yes IS NULL OR no < yes) THEN 'rejected' WHEN yes IS NOT NULL THEN 'confirmed' ELSE 'pending' END AS status, count(*) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1",
    "favorites_list": "SELECT p_partkey, CASE WHEN p_size > 40 THEN 5 WHEN p_size > 20 THEN 3 ELSE 1 END AS priority, p_size, p_name FROM part WHERE p_type <> 'PROMO' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) ORDER BY priority DESC, p_size, p_name, p_partkey LIMIT 30",
    "previews": "(SELECT 'favorites' AS list, p_partkey AS id FROM part ORDER BY p_size DESC, p_partkey LIMIT 6) UNION ALL (SELECT 'notices', event_id FROM events ORDER BY value DESC, event_id LIMIT 5) UNION ALL (SELECT 'orders', o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6)",
    "official_documents": "WITH p AS (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS h, html FROM pages) SELECT (h = 'example.com' OR ends_with(h, '.example.com')) AND (contains(lower(html), 'thing') OR regexp_matches(html, '\\bOP-[0-9]{2}\\b')) AS official, count(*) AS n FROM p GROUP BY 1",
    "new_stores": "SELECT s_suppkey AS key, s_suppkey % 3 = 0 AND s_suppkey % 4 > 0 AS enabled, s_suppkey % 3 <> 0 AS new FROM supplier",
    "merged_sources": "WITH s AS (SELECT s_suppkey AS row, s_nationkey AS nation, floor(s_acctbal / 50) AS band, nullif(regexp_extract(s_name, '#0*([0-9]+)', 1), '') AS tail, 's' || s_suppkey AS proof, round(abs(s_acctbal) / 10000, 4) AS sure FROM supplier), c AS (SELECT c_custkey AS row, c_nationkey AS nation, floor(c_acctbal / 50) AS band, nullif(regexp_extract(c_name, '#0*([0-9]+)', 1), '') AS tail, 'c' || c_custkey AS proof, round(abs(c_acctbal) / 10000, 4) AS sure FROM customer), p AS (SELECT c.row AS b, min(s.row) AS a FROM s JOIN c ON (s.nation = c.nation AND s.band = c.band) OR s.tail = c.tail GROUP BY 1), m AS (SELECT p.a AS row, list(c.proof) AS l, max(c.sure) AS best FROM p JOIN c ON c.row = p.b GROUP BY 1) SELECT s.row, 'first' AS source, array_to_string(list_sort(list_distinct(list_append(coalesce(list_sort(list_distinct(l))[1:20], []), proof))), ',') AS evidence, greatest(sure, coalesce(best, sure)) AS confidence FROM s LEFT JOIN m USING (row) UNION ALL SELECT row, 'second', proof, sure FROM c WHERE row NOT IN (SELECT b FROM p)",
    "mail_scan": f"SELECT user_id, event_id FROM events WHERE event_id % 6 <> 0 AND ts BETWEEN {_N} - INTERVAL 7 DAY AND {_N} ORDER BY ts DESC, event_id LIMIT 100",
    "state_updates": "SELECT user_id, arg_max(event_type, event_id) <> 'error' AS applied, CASE WHEN arg_max(event_type, event_id) <> 'error' THEN arg_max(event_type, event_id) ELSE '' END AS result FROM events GROUP BY 1",
    "exclusions": "WITH g AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_partkey % 10 = 0) SELECT 'left' AS what, count(*) AS n FROM part WHERE (p_brand, p_type) NOT IN (SELECT (p_brand, p_type) FROM g) UNION ALL SELECT 'excluded', count(*) FROM g",
    "duplicate_counts": "WITH k AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'u' || (p_partkey % 50) ELSE p_name || '|' || p_size END AS key FROM part) SELECT count(DISTINCT key) AS kept, count(*) - count(DISTINCT key) AS dropped FROM k",
    "priority_queue": "WITH x AS (SELECT *, CASE WHEN value > 80 THEN 'HIGH' WHEN value > 20 THEN 'NORMAL' ELSE 'LOW' END AS class FROM events) SELECT class, event_id, CASE class WHEN 'HIGH' THEN 1 WHEN 'NORMAL' THEN 2 ELSE 3 END AS place FROM x QUALIFY row_number() OVER (PARTITION BY class ORDER BY ts, event_id) = 1",
    "category_run_summary": "WITH t(tier, place) AS (VALUES ('official', 1), ('store', 2), ('info', 3), ('none', 4)), s AS (SELECT CASE WHEN s_acctbal > 5000 THEN 'official' WHEN s_acctbal > 0 THEN 'store' ELSE 'info' END AS tier, count(*) AS n FROM supplier GROUP BY 1) SELECT tier, coalesce(n, 0) AS n, place FROM t LEFT JOIN s USING (tier)",
    "running_positions": "SELECT o_orderkey, row_number() OVER w AS place, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS so_far FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
}
