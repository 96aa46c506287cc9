"""Queries over catalog pages, articles, stores and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.functions import names, pages, rules, text, times, urls
from tallyreef.operators import joins, notices, ordered_merge, records, resolve, shapes
from tallyreef.plans.cases import pick, sql_pick
from tallyreef.sources import staged
from tallyreef.sources.scratch import scratch
from tallyreef.sources.tables import inventory, table

_ITEM = r"(?s)<li class=\"item\">.*?</li>"
_FIELDS = {"name": r"<h3>(.*?)</h3>", "link": r"href=\"([^\"]*)\"", "code": r"<span class=\"code\">(.*?)</span>", "date": r"発売日：(\d{4}-\d{2}-\d{2})"}


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as items of list pages, ten a page; one in seven has no name, one in five no code."""
    k = F.col("p_partkey")
    item = F.concat(
        F.lit('<li class="item"><a href="/p/'), k, F.lit('"><h3>'), F.when(k % 7 > 0, F.concat("p_name", F.lit(" &amp; <b>more</b>"))).otherwise(" "), F.lit("</h3></a>"),
        F.when(k % 5 > 0, F.concat(F.lit('<span class="code">C'), k, F.lit("</span>"))).otherwise(""), F.lit("<p>発売日：2026-07-01</p></li>"),
    )
    rows = table(spark, sf, "part").select(F.floor(k / 10).alias("page"), k.alias("k"), item.alias("item"))
    made = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("k", "item"))).alias("x"))
    return made.select("page", F.concat(F.lit("<ul>"), F.array_join(F.transform("x", lambda i: i["item"]), "\n"), F.lit("</ul>")).alias("html"))


def catalog_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of list pages by a layout's patterns, in page order."""
    return pages.catalog_rows(_listing(spark, sf), "html", ["page"], _ITEM, _FIELDS)


def catalog_details(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose missing codes are filled from their detail pages."""
    items = pages.catalog_rows(_listing(spark, sf), "html", ["page"], _ITEM, _FIELDS)
    details = table(spark, sf, "part").select(F.concat(F.lit("/p/"), "p_partkey").alias("link"), F.concat(F.lit("D"), "p_partkey").alias("code"))
    return pages.supplemented(items, details, "link", ["code"]).select("link", "code")


def html_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the rows of HTML tables."""
    html = F.concat(F.lit("<table><tr><th>name</th><th>size</th></tr><tr class=x><td> "), "p_name", F.lit("</td><td><b>"), "p_size", F.lit("</b></td></tr></table>"))
    found = pages.table_rows(table(spark, sf, "part").select("p_partkey", html.alias("html")), "html", ["p_partkey"])
    return found.select("p_partkey", "ord", F.array_join("cells", "|").alias("cells"))


def script_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products that scripts name as object literals."""
    html = F.concat(F.lit("<script>var a = {"), F.lit('"id": 1};</script><script>add({"id": '), "p_partkey", F.lit(', "name": "'), "p_name", F.lit('"}); add({broken); add({"id": 0, "name": "x"})</script>'))
    return pages.script_objects(table(spark, sf, "part").select("p_partkey", html.alias("html")), "html", ["p_partkey"], r"add\((\{[^{}]*\})\)", "id long, name string")


#: Days that bring the orders' dates into this century.
LATER = 10_000


def article_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of articles, and periods of their labelled parts."""
    day = lambda days: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), LATER + days), "yyyy年M月d日")
    span = F.concat(F.lit("受付期間："), F.when(F.col("o_orderstatus") == "P", F.lit("～")).otherwise(F.concat(day(0), F.lit(" 10:00 ～ "))), day(8), F.lit("(日) 23:59 当選発表 "), day(20))
    title = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("高価買取 "), "o_orderkey")).otherwise(F.concat(F.lit("新弾 "), "o_orderkey"))
    body = F.when(F.col("o_orderpriority") == "1-URGENT", "抽選 当選発表").when(F.col("o_orderpriority") == "2-HIGH", "予約受付 予約期間").when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("発売日 税込 "), F.floor("o_totalprice"))).otherwise("エントリー")
    category = F.when(F.col("o_orderstatus") == "F", "unknown").otherwise("pokemon")
    found = pages.segment_period(span)
    return table(spark, sf, "orders").select("o_orderkey", pages.article_class(title, body, category).alias("class"), found["start"].cast("string").alias("start"), found["end"].cast("string").alias("end"))


def source_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that support a category, with what reads them."""
    k = F.col("s_suppkey")
    catalog = table(spark, sf, "supplier").select(k.alias("id"), F.array(F.lit("all"), F.when(k % 2 == 0, "a").otherwise("b")).alias("categories"))
    return inventory(catalog, catalog.filter("id % 3 = 0").select("id"), "id", "categories", "a").select("id", "class")


def store_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as stores: customers meet them by alias, else code, else the domain, which counts only where all of its stores are of one group."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("store"), names.store_name(F.col("s_name")).alias("alias"), (F.col("s_suppkey") % 10).alias("group"), F.concat(F.lit("c"), "s_suppkey").alias("code"), F.concat(F.lit("d"), F.col("s_suppkey") % 30, F.lit(".example")).alias("domain"))
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("row"), names.store_name(F.when(k % 4 == 0, F.concat(F.lit("SUPPLIER #"), F.lpad(k.cast("string"), 9, "0")))).alias("name"), F.when(k % 4 == 1, F.concat(F.lit("C"), k)).alias("code"), F.concat(F.lit("https://www.d"), k % 40, F.lit(".example/x")).alias("url"))
    return joins.store_ladder(c, s, "row").select("row", "store", "step")


def branch_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Chain and branch that the names of customers' stores tell."""
    k, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    name = F.when(segment == "BUILDING", F.concat(F.lit("カードラボ "), k, F.lit("店"))).when(segment == "MACHINERY", F.concat(F.lit("ビックカメラ第"), k, F.lit("店"))).when(segment == "HOUSEHOLD", F.concat(F.lit("ヨドバシ・カメラ マルチメディアAkiba "), k)).when(segment == "FURNITURE", "ホビーステーション").otherwise(F.col("c_name"))
    chain, branch = names.chain_and_branch(name)
    return table(spark, sf, "customer").select("c_custkey", chain.alias("chain"), branch.alias("branch"))


def application_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Applications by explicit id or by what they are about, and rows that are over, counted by identity."""
    p = table(spark, sf, "pages")
    key = records.identity(F.when(F.col("page_id") % 6 == 0, F.lit(" x1 ")), F.lit("Product"), F.lit("Chain"), pick(("a", "B", ""), "page_id"), F.lit("2026-07-01"), F.col("url"), F.when(F.col("page_id") % 2 == 0, F.lit("pokemon")))
    return p.groupBy(key.alias("identity")).agg(F.count("*").alias("n"), F.count_if(records.matching_period(F.lit("2026-07-01").cast("timestamp_ntz"), F.lit("2026-07-02").cast("timestamp_ntz"))).alias("over"))


def evidence_items(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of orders as it is kept: kinds in capitals, trust within 0 and 100, the first of each kind and address."""
    line = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("ord"), records.evidence(pick(("official", " shop ", "", None), "l_linenumber"), F.concat(F.lit("u"), F.col("l_suppkey") % 3), (F.col("l_partkey") % 150).cast("string"), F.lit("2026")).alias("e"))
    return records.distinct_evidence(line, ["l_orderkey"], "e", "ord").select("l_orderkey", "ord", "source_type", "source_url", "trust")


def _store_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as hits of stores: host, name, code, confidence, and where the evidence was seen."""
    number = urls.path_number(F.col("url"))
    return table(spark, sf, "pages").select(
        "page_id", urls.host(F.col("url")).alias("host"), names.store_name(text.page_title(F.col("html"))).alias("name"), number.alias("code"), (number / 9000).alias("confidence"), F.col("page_id").alias("seen"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("source_url"), urls.path(F.col("url")).alias("path"),
    )


_STORE_KEYS = [("host",), ("name",), ("code",)]


def store_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as candidates for stores in order: one that has the host, the name or the code of a kept one joins the first such; with the greatest confidence and the newest evidence."""
    heads, evidence = ordered_merge.merged_candidates(_store_hits(spark, sf), "page_id", _STORE_KEYS, "confidence", "seen", ["source_url", "path"])
    kept = evidence.groupBy("head").agg(F.count("*").alias("evidence"), F.min("page_id").alias("oldest"), F.max("page_id").alias("newest"))
    return heads.join(kept, "head").select("head", "host", "name", "code", "n", "confidence", "last_detected_at", "evidence", "oldest", "newest")


def candidate_store(spark: SparkSession, sf: str) -> DataFrame:
    """The same candidates when the first half of the pages is stored and the rest comes as a second batch; each batch is committed at once."""
    hits = _store_hits(spark, sf)
    middle = hits.agg(F.percentile_approx("page_id", 0.5)).first()[0]
    path = scratch(spark, "candidates")
    for batch in (hits.filter(F.col("page_id") <= middle), hits.filter(F.col("page_id") > middle)):
        done = ordered_merge.upsert_candidates(staged.read(spark, path, "candidates"), batch, "page_id", _STORE_KEYS, "confidence", "seen", ["source_url", "path"])
        staged.write(done, path, "candidates")
    ids = F.transform("evidence", lambda x: x["page_id"])
    return staged.read(spark, path, "candidates").select(
        F.col("page_id").alias("head"), "host", "name", "code", "n", "confidence", "last_detected_at", F.size("evidence").cast("long").alias("evidence"), F.array_min(ids).alias("oldest"), F.array_max(ids).alias("newest")
    )


def candidates_of_known_stores(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as new rows against suppliers as known ones: each joins the first known or kept row with its nation and balance in whole units, or with its number."""
    keys = [("nation", "units"), ("number",)]
    nation = lambda n: F.col(n).cast("string").alias("nation")
    known = table(spark, sf, "supplier").select((F.col("s_suppkey") - (1 << 40)).alias("row"), nation("s_nationkey"), F.floor(F.col("s_acctbal")).alias("units"), F.regexp_extract("s_name", "#0*([0-9]+)", 1).alias("number"))
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("row"), nation("c_nationkey"), F.floor(F.col("c_acctbal")).alias("units"), F.regexp_extract("c_name", "#0*([0-9]+)", 1).alias("number"))
    return ordered_merge.first_match(new, "row", keys, kept=known)


def sorted_boards(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten rows of each of five orders: by end, result, release, shop, and state; what is missing comes last."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate").cast("date").cast("string")).alias("end"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate").cast("date").cast("string")).alias("result"), F.col("o_orderpriority").alias("product"), (F.col("o_custkey") % 9).alias("site"),
    )
    rank = shapes.rank_of(F.col("o_orderstatus"), ["P", "F"])
    end, result = shapes.dated(F.col("end")), shapes.dated(F.col("result"))
    orders = {"end": [end, rank, "product"], "result": [result, rank, "product"], "release": [end, "product", "site"], "shop": ["site", "product"], "state": [rank, result, end, "product", "site"]}
    out = None
    for name, order in orders.items():
        head = o.orderBy(*order, "o_orderkey").limit(10).select(F.lit(name).alias("board"), "o_orderkey")
        out = head if out is None else out.unionByName(head)
    return out


def wanted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a user wants: state in any of three columns, channel, preferences, enabled categories, and what is due for a new search, counted."""
    o = table(spark, sf, "orders")
    mode = pick(("ONLINE", "STORE", "HYBRID", "UNKNOWN"), "o_orderkey")
    last = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate"))
    return o.agg(
        F.count_if(shapes.any_state("F", "o_orderstatus", "o_orderpriority")).alias("state"), F.count_if(shapes.any_state("all", "o_orderstatus")).alias("any"), *[F.count_if(shapes.channel(mode, c)).alias(c) for c in ("online", "store", "all")],
        F.count_if(shapes.wanted_by(F.array(F.lit("P"), F.lit("O")), F.array("o_orderstatus"))).alias("preferred"), F.count_if(shapes.wanted_by(F.array().cast("array<string>"), F.array("o_orderstatus"))).alias("open"),
        F.count_if(rules.clamped(F.col("o_orderstatus"), ["F", "O"], "X") == "X").alias("clamped"), F.count_if(shapes.due(last, F.lit("1996-01-01").cast("timestamp_ntz"), 86400)).alias("due"), F.count_if(times.retained(last, F.lit("1996-01-01").cast("timestamp_ntz"))).alias("kept"),
    )


def word_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a list that documents hold, their lines with a word, and their distinct words less some, measured."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.hits(F.col("text"), ["the", "und", "XX"]).alias("hits"), F.length(text.keyword_lines(F.col("text"), ["password", "token"])).alias("line_chars"), F.size(text.tokens(F.col("text"), ["the", "and"])).alias("words"))


def priority_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values that win by their source's priority, and values that fill gaps."""
    line = table(spark, sf, "lineitem")
    kept = resolve.by_priority(F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")), F.when(F.col("l_discount") > 0.02, F.col("l_linestatus")), F.col("l_suppkey") % 3, F.col("l_partkey") % 3, F.col("l_linenumber") == 7)
    filled = resolve.fill_missing(F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")), F.col("l_linestatus"))
    return line.groupBy(kept.alias("kept"), filled.alias("filled")).agg(F.count("*").alias("n"))


def recent_times(spark: SparkSession, sf: str) -> DataFrame:
    """Local times of events told as ISO texts with and without a zone, and whether they are recent."""
    told = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    shown = F.when(F.col("event_type") == "click", F.concat(told, F.lit("Z"))).when(F.col("event_type") == "view", F.concat(told, F.lit("+09:00"))).when(F.col("event_type") == "error", "bad").otherwise(told)
    at = times.local_time(shown)
    return table(spark, sf, "events").select("event_id", at.cast("string").alias("at"), notices.recent(at, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")).alias("recent"))


QUERIES = {f.__name__: f for f in (
    catalog_items, catalog_details, html_tables, script_products, article_classes, source_inventory, store_ladder, branch_splits, application_identities, evidence_items, store_candidates, candidate_store, candidates_of_known_stores, sorted_boards, wanted_rows, word_scores, priority_values, recent_times,
)}

_TS = "TIMESTAMP '1996-01-01'"
_LAST = "CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END"
_MODE = sql_pick(("ONLINE", "STORE", "HYBRID", "UNKNOWN"), "o_orderkey")
_ENDS, _RESULT = "CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE::VARCHAR ELSE '9999-99-99' END", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::DATE::VARCHAR ELSE '9999-99-99' END"
_RANK = "CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 9 END"


def _board(name: str, order: str) -> str:
    return f"(SELECT '{name}' AS board, o_orderkey FROM orders ORDER BY {order}, o_orderkey LIMIT 10)"


def first_match_sql(rows: str, columns: dict[str, str], same: str, known: str = "") -> str:
    """A recursive query f(i, id, head) that folds rows (id and the columns, with i from 1) in order, and the heads that stand before."""
    listed = ", ".join(f"{c} {t}" for c, t in {"id": "BIGINT", **columns}.items())
    held = "{" + ", ".join(f"'{c}': r.{c}" for c in ("id", *columns)) + "}"
    start = f"(SELECT list(k ORDER BY k.id) FROM ({known}) k)" if known else "[]"
    return f"""r AS ({rows}), f AS (SELECT 0::BIGINT AS i, CAST({start} AS STRUCT({listed})[]) AS heads, NULL::BIGINT AS id, NULL::BIGINT AS head
    UNION ALL SELECT i, CASE WHEN m IS NULL THEN list_append(heads, held) ELSE heads END, id, coalesce(m, id) FROM (
      SELECT r.i, r.id, f.heads, {held} AS held, list_filter(f.heads, lambda h: {same})[1].id AS m FROM f JOIN r ON r.i = f.i + 1))"""


def _sql() -> dict[str, str]:
    from tallyreef.plans import catalog

    title = "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\r\\n]+', ' ', 'g'))"
    hits = f"SELECT row_number() OVER (ORDER BY page_id) AS i, page_id AS id, {catalog._HOST} AS host, regexp_replace(lower({title}), '[\\s\\-_/・･.()（）\\[\\]【】]+', '', 'g') AS name, {catalog._NUMBER} AS code, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS source_url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages"
    merged = first_match_sql(hits, {"host": "VARCHAR", "name": "VARCHAR", "code": "BIGINT"}, "coalesce(h.host <> '' AND h.host = r.host, false) OR coalesce(h.name <> '' AND h.name = r.name, false) OR coalesce(h.code = r.code, false)")
    member = "SELECT row_number() OVER (ORDER BY {0}) AS i, {0} AS id, {1}_nationkey AS nation, floor({1}_acctbal)::BIGINT AS units, regexp_extract({1}_name, '#0*([0-9]+)', 1) AS number FROM {2}"
    known = "SELECT s_suppkey - 1099511627776 AS id, s_nationkey AS nation, floor(s_acctbal)::BIGINT AS units, regexp_extract(s_name, '#0*([0-9]+)', 1) AS number FROM supplier"
    customers = first_match_sql(member.format("c_custkey", "c", "customer"), {"nation": "BIGINT", "units": "BIGINT", "number": "VARCHAR"}, "coalesce(h.nation = r.nation AND h.units = r.units, false) OR coalesce(h.number <> '' AND h.number = r.number, false)", known)
    return {
        "store_candidates": f"""WITH RECURSIVE {merged}, m AS (SELECT f.head, r.*, row_number() OVER (PARTITION BY f.head ORDER BY r.id) AS k FROM f JOIN r ON r.id = f.id),
            e AS (SELECT head, 0::BIGINT AS k, []::STRUCT(id BIGINT, s VARCHAR, p VARCHAR)[] AS kept FROM m WHERE k = 1
              UNION ALL SELECT e.head, m.k, CASE WHEN len(list_filter(e.kept, lambda x: x.s = m.source_url AND x.p = m.path)) > 0 THEN e.kept ELSE list_append(e.kept, {{'id': m.id, 's': m.source_url, 'p': m.path}})[-20:] END FROM e JOIN m ON m.head = e.head AND m.k = e.k + 1),
            l AS (SELECT head, arg_max(kept, k) AS kept FROM e GROUP BY 1), c AS (SELECT head, count(*) AS n, max(greatest(0.0, least(1.0, coalesce(code / 9000, 0.0)))) AS confidence, max(id) AS last_detected_at FROM m GROUP BY 1)
            SELECT c.head, r.host, r.name, r.code, c.n, c.confidence::DOUBLE AS confidence, c.last_detected_at, len(l.kept) AS evidence, list_min(list_transform(l.kept, lambda x: x.id)) AS oldest, list_max(list_transform(l.kept, lambda x: x.id)) AS newest FROM c JOIN l ON l.head = c.head JOIN r ON r.id = c.head""",
        "candidates_of_known_stores": f"WITH RECURSIVE {customers} SELECT id AS row, head FROM f WHERE i > 0",
        "catalog_items": "SELECT p_partkey // 10 AS page, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1 AS ord, p_name || ' & more' AS name, '/p/' || p_partkey AS link, CASE WHEN p_partkey % 5 > 0 THEN 'C' || p_partkey ELSE '' END AS code, '2026-07-01' AS date FROM part QUALIFY p_partkey % 7 > 0",
        "catalog_details": "SELECT '/p/' || p_partkey AS link, CASE WHEN p_partkey % 5 > 0 THEN 'C' ELSE 'D' END || p_partkey AS code FROM part WHERE p_partkey % 7 > 0",
        "html_tables": "SELECT p_partkey, 0 AS ord, 'name|size' AS cells FROM part UNION ALL SELECT p_partkey, 1, p_name || '|' || p_size FROM part",
        "script_products": "SELECT p_partkey, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT p_partkey, 0, 'x' FROM part",
        "article_classes": f"SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN 'excluded' WHEN o_orderpriority LIKE '1%' THEN 'lottery' WHEN o_orderpriority LIKE '2%' THEN 'reservation' WHEN o_orderstatus = 'F' THEN 'excluded' WHEN o_orderpriority LIKE '3%' THEN 'product_info' ELSE 'event' END AS class, CASE WHEN o_orderstatus <> 'P' THEN (o_orderdate::DATE + {LATER} + INTERVAL 10 HOUR)::VARCHAR END AS start, (o_orderdate::DATE + {LATER} + INTERVAL 8 DAY + INTERVAL 1439 MINUTE)::VARCHAR AS \"end\" FROM orders",
        "source_inventory": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'plugin' ELSE 'manual' END AS class FROM supplier WHERE s_suppkey % 2 = 0",
        "store_ladder": "WITH d AS (SELECT s_suppkey % 30 AS d, min(s_suppkey) AS store, count(DISTINCT s_suppkey % 10) AS groups FROM supplier GROUP BY 1) SELECT c_custkey AS row, CASE WHEN c_custkey % 4 = 0 AND a.s_suppkey IS NOT NULL THEN a.s_suppkey WHEN c_custkey % 4 = 1 AND a.s_suppkey IS NOT NULL THEN a.s_suppkey WHEN groups = 1 THEN d.store END AS store, CASE WHEN c_custkey % 4 = 0 AND a.s_suppkey IS NOT NULL THEN 'alias' WHEN c_custkey % 4 = 1 AND a.s_suppkey IS NOT NULL THEN 'code' WHEN groups = 1 THEN 'domain' ELSE 'none' END AS step FROM customer LEFT JOIN supplier a ON a.s_suppkey = c_custkey LEFT JOIN d ON d.d = c_custkey % 40",
        "branch_splits": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'カードラボ' WHEN 'MACHINERY' THEN 'ビックカメラ' WHEN 'HOUSEHOLD' THEN 'ヨドバシカメラ' WHEN 'FURNITURE' THEN 'ホビーステーション' ELSE c_name END AS chain, CASE c_mktsegment WHEN 'BUILDING' THEN c_custkey::VARCHAR WHEN 'MACHINERY' THEN '第' || c_custkey WHEN 'HOUSEHOLD' THEN 'マルチメディアAkiba' ELSE '' END AS branch FROM customer",
        "application_identities": f"SELECT CASE WHEN page_id % 6 = 0 THEN 'x1' ELSE CASE WHEN page_id % 2 = 0 THEN 'pokemon' ELSE 'other' END || '|product|chain|' || {sql_pick(('a', 'b', ''), 'page_id')} || '|2026-07-01|' || {catalog.APPLICATION} END AS identity, count(*) AS n, count(*) AS over FROM pages GROUP BY 1",
        "evidence_items": f"WITH e AS (SELECT l_orderkey, l_linenumber * 10000000 + l_partkey AS ord, {sql_pick(('OFFICIAL', 'SHOP', 'GENERAL_INFORMATION', 'GENERAL_INFORMATION'), 'l_linenumber')} AS source_type, 'u' || (l_suppkey % 3) AS source_url, least(100, l_partkey % 150) AS trust FROM lineitem) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY l_orderkey, source_type, source_url ORDER BY ord) = 1",
        "sorted_boards": " UNION ALL ".join(_board(n, o) for n, o in (("end", f"{_ENDS}, {_RANK}, o_orderpriority"), ("result", f"{_RESULT}, {_RANK}, o_orderpriority"), ("release", f"{_ENDS}, o_orderpriority, o_custkey % 9"), ("shop", "o_custkey % 9, o_orderpriority"), ("state", f"{_RANK}, {_RESULT}, {_ENDS}, o_orderpriority, o_custkey % 9"))),
        "wanted_rows": f"SELECT count_if(o_orderstatus = 'F') AS state, count(*) AS \"any\", count_if({_MODE} IN ('ONLINE', 'HYBRID')) AS online, count_if({_MODE} IN ('STORE', 'HYBRID')) AS store, count(*) AS \"all\", count_if(o_orderstatus IN ('P', 'O')) AS preferred, count(*) AS open, count_if(o_orderstatus = 'P') AS clamped, count_if({_LAST} IS NULL OR {_TS} - {_LAST} >= INTERVAL 1 DAY) AS due, count_if({_LAST} IS NULL OR {_TS} - {_LAST} <= INTERVAL 14 DAY) AS kept FROM orders",
        "word_scores": "SELECT doc_id, contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'xx')::INT AS hits, length(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), 'password|token'))[1:80], chr(10))) AS line_chars, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: x NOT IN ('the', 'and'))) AS words FROM documents",
        "priority_values": "WITH x AS (SELECT CASE WHEN l_tax > 0.02 THEN l_returnflag END AS cur, CASE WHEN l_discount > 0.02 THEN l_linestatus END AS inc, l_suppkey % 3 AS pc, l_partkey % 3 AS pi, l_linenumber = 7 AS man, coalesce(CASE WHEN l_tax > 0.04 THEN l_returnflag END, l_linestatus) AS filled FROM lineitem) SELECT CASE WHEN pi >= pc AND NOT man AND inc IS NOT NULL THEN inc WHEN cur IS NULL THEN inc ELSE cur END AS kept, filled, count(*) AS n FROM x GROUP BY 1, 2",
        "recent_times": "WITH x AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN date_trunc('second', ts) + INTERVAL 9 HOUR ELSE date_trunc('second', ts) END AS at_ FROM events) SELECT event_id, at_::VARCHAR AS at, coalesce(at_ >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 48 HOUR, false) AS recent FROM x",
    }


ORACLE_SQL = _sql()
ORACLE_SQL["candidate_store"] = ORACLE_SQL["store_candidates"]
