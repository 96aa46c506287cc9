"""Queries over pages of catalogs, shops, applications and articles. Pages are built from the tables' own rows, in the shapes that the sites have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.functions import applications, entries, markup, pages
from tallyreef.operators import resolve
from tallyreef.sources.tables import table

#: Layouts of lists; a customer's orders are items of one of them.
LISTS = ("onepiece_list", "gundam_list", "union_arena_list", "fusion_world_list", "duel_masters_list", "weiss_list", "mtg_list", "konami_list", "bushiroad_list")
#: Days that bring the orders' dates into this century.
LATER = 10_000


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _day(days: int = 0) -> Column:
    return F.date_add(F.col("o_orderdate").cast("date"), LATER + days)


def _item(layout: str) -> Column:
    """An order as an item of a layout, with lists of its own where a pattern would end at the first closing tag."""
    k, price, day = F.col("o_orderkey"), F.floor("o_totalprice"), _day()
    name, link, image, nested = _text("Pack ", k, " &amp; <b>", F.col("o_orderpriority"), "</b>"), _text("/products/", k), _text('<img src="/i/', k, '.png">'), "<ul><li>new</li><li>10 cards</ul>"
    cost, dotted = _text("<p>希望小売価格 ", F.format_number(price, 0), "円</p>"), F.date_format(day, "yyyy.M.d")
    return {
        "onepiece_list": lambda: _text('<li class="linkListColBox new" data-cat="', F.col("o_orderstatus"), f'">{nested}<a class="linkListColItem" href="', link, '">', image, '<h4 class="linkListColTitle">', name, '</h4><time datetime="', day, '">soon</time></a>', cost, "</li>"),
        "gundam_list": lambda: _text('<div class="productsDetail" data-tags="', F.col("o_orderstatus"), '"><a href="', link, '" class="productsDetailInner">', image, '<div class="cardTit">', name, "</div><dl><dt>カテゴリ</dt><dd>2001.1.1</dd><dt> 発売日 </dt><dd>", dotted, "</dd></dl>", cost, "</a></div>"),
        "union_arena_list": lambda: _text('<li class="productsDetail" data-tags="', F.col("o_orderstatus"), '"><a href="', link, '">', image, '<dl><dt class="productsTit">', name, "</dt><dd>", dotted, f"{nested}</dd></dl></a>", cost, "</li>"),
        "fusion_world_list": lambda: _text("<li class='prpductListItem cardCol'><a href='", link, "'>", image, '<h3 class="cardText">', name, "</h3><dl><dt>発売日<dd>", dotted, "<dt>メーカー希望小売価格<dd>", F.format_number(price, 0), "円</dl></a></li>"),
        "duel_masters_list": lambda: _text('<div class="itemList01_item"><a href="https://dm.example/product/', k, '">', image, '<h2 class="title">', name, '</h2><div class="product_type">', F.col("o_orderstatus"), "</div></a><div><p>", dotted, "</p></div>", cost, "</div>"),
        "weiss_list": lambda: _text('<a href="', link, '" class="products__link">', image, '<span class="products__name">', name, '</span><span class="products__catItem">', F.col("o_orderstatus"), "</span><p>", dotted, "</p>", cost, "</a>"),
        "mtg_list": lambda: _text('<div><a href="', link, '">', image, name, "</a></div>"),
        "konami_list": lambda: _text(f'<li class="grid-col5">{nested}<a href="/detail.php?id=', k, '"><img class="picture" data-src="/i/', k, '.png" src="x"><p class="item-name">', name, '</p></a><p class="item-price">', F.format_number(price, 0), '円</p><p class="item-tag">', F.col("o_orderstatus"), "</p></li>"),
        "bushiroad_list": lambda: _text('<div class="product-item" data-handle="h', k, '" data-title="', F.regexp_replace(name, "</?b>", ""), '" data-available="true"><div><div>x</div><a href="', link, '">', image, "</a></div>", cost, "</div>"),
    }[layout]()


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each customer with orders, in the layout that falls to them."""
    o = table(spark, sf, "orders")
    layout = F.element_at(F.array(*map(F.lit, LISTS)), (F.pmod("o_custkey", F.lit(len(LISTS))) + 1).cast("int"))
    chain = F
    for i, name in enumerate(LISTS):
        chain = chain.when(F.pmod("o_custkey", F.lit(len(LISTS))) == i, _item(name))
    items = o.select("o_custkey", layout.alias("layout"), F.struct("o_orderkey", chain.alias("html")).alias("item"))
    made = items.groupBy("o_custkey", "layout").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return made.select("o_custkey", "layout", _text('<!DOCTYPE html><html lang="ja"><body class="lang-ja"><nav><ul><li>menu</li></ul></nav><ul class="main-item-list">', F.array_join(F.transform("items", lambda x: x["html"]), "\n"), "</ul></body></html>").alias("html"))


def catalog_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Items of list pages of nine layouts, with dates and prices as they are compared."""
    rows = markup.layout_rows(_lists(spark, sf), "html", F.col("layout"))
    date = [F.regexp_extract("date", r"(20\d{2})[./年-](\d{1,2})[./月-](\d{1,2})", i).try_cast("int") for i in (1, 2, 3)]
    price = F.regexp_replace(F.regexp_extract("price", r"(\d[\d,]*)円", 1), ",", "").try_cast("long")
    return rows.filter("name <> ''").select("o_custkey", "layout", "ord", "name", "url", "image", "kind", "status", "code", F.to_date(F.try_make_timestamp_ntz(*date, F.lit(0), F.lit(0), F.lit(0))).cast("string").alias("date"), price.alias("price"))


def catalog_detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Detail pages of two layouts: title, image, code, price and date of release."""
    k = F.col("o_orderkey")
    page = _text(
        '<html><head><meta property="og:image" content="/i/', k, '.png"></head><body><h2>menu</h2><h2 class="hdg-text">Pack <i>', F.col("o_orderpriority"), "</i></h2><table><tr><th>商品番号<td>CG-", k, "<tr><th>希望小売価格<td>", F.format_number(F.floor("o_totalprice"), 0), "円<tr><th>発売日<td>", F.date_format(_day(), "yyyy年M月d日"), "</table></body></html>",
    )
    rows = markup.layout_rows(table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", page.alias("html")), "html", "konami_detail")
    news = _text('<html><head><meta property="og:image" content="/i/', k, '.png"></head><body><header><ul><li>menu</ul></header><h1>Pack <i>', F.col("o_orderpriority"), "</i></h1><p>商品番号：CG-", k, "<p>販売価格 ", F.format_number(F.floor("o_totalprice"), 0), " 円<p>発売日：", F.date_format(_day(), "yyyy年M月d日"), "</body></html>")
    second = markup.layout_rows(table(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", news.alias("html")), "html", "yugioh_detail")
    rows = rows.unionByName(second.withColumn("code", F.col("price")))
    date = [F.regexp_extract("date", r"発売日\s*[:：]?\s*(20\d{2})年(\d{1,2})月(\d{1,2})日", i).try_cast("int") for i in (1, 2, 3)]
    return rows.select(
        "o_orderkey", "name", "image", F.regexp_extract("code", r"商品番号\s*[:：]?\s*([A-Za-z0-9_-]+)", 1).alias("code"), F.regexp_replace(F.regexp_extract("price", r"(?:希望小売価格|販売価格)\s*[:：]?\s*([\d,]+)\s*円", 1), ",", "").try_cast("long").alias("price"),
        F.make_date(*date).cast("string").alias("date"),
    )


def article_records(spark: SparkSession, sf: str) -> DataFrame:
    """Articles on orders as records: class, product, period, conditions, stock and prices, put together."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    long, price = "yyyy年M月d日", F.format_number(F.floor("o_totalprice"), 0)
    words = F.when(F.col("o_orderpriority") == "1-URGENT", "抽選 当選発表").when(F.col("o_orderpriority") == "2-HIGH", "予約受付 予約期間").when(F.col("o_orderpriority") == "3-MEDIUM", "大会 イベント").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "高価買取").otherwise("x")
    body = _text(words, " お一人様1点 ", price, "円 受付期間：", F.date_format(_day(), long), " 10:00 ～ ", F.date_format(_day(8), long), " 当選発表：後日 商品名：Pack ", k)
    title = F.when(F.col("o_orderstatus") == "P", _text("大会 ", k)).otherwise(_text("新弾 ", k))
    record = pages.article_record(title, body, F.lit("pokemon"), _text("https://x.example/", k))
    found = o.select("o_orderkey", record.alias("r")).filter("r is not null")
    return found.select("o_orderkey", "r.article_id", "r.class", "r.product", "r.period", F.col("r.start").cast("string").alias("start"), F.col("r.end").cast("string").alias("end"), F.array_join("r.conditions", ",").alias("conditions"), "r.stock", "r.highest", "r.first")


def _by_priority(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("o_orderpriority")]


#: Wordings by priority; the last two name no brand.
_BRANDED = {"1-URGENT": "ONE PIECEカードゲーム", "2-HIGH": "ドラゴンボールスーパーカードゲーム フュージョンワールド", "3-MEDIUM": "ONE　PIECE ＯＰ-17", "4-NOT SPECIFIED": "店舗番号 OP-17", "5-LOW": "DBSCG MASTERS FB-01"}
_PLACES = {"1-URGENT": "大阪梅田店", "2-HIGH": "東京店", "3-MEDIUM": "青葉店", "4-NOT SPECIFIED": "東京店", "5-LOW": "東京店"}


def official_applications(spark: SparkSession, sf: str) -> DataFrame:
    """Application pages of orders: brand and product, dates, branch and prefecture; other hosts, brands and pages without an end are none."""
    o = table(spark, sf, "orders").repartition("o_orderkey")  # one file may be few splits, and pages cost more than the shuffle
    k, brand, place = F.col("o_orderkey"), _by_priority(_BRANDED), _by_priority(_PLACES)
    host = F.when(F.col("o_orderstatus") == "F", "shop.example.com").otherwise(applications.APPLICATION_HOST)
    at = lambda days: F.date_format(_day(days), "yyyy/MM/dd")
    page = _text(
        "<html><head><title>x</title></head><body><nav><ul><li>menu<li>店舗</ul></nav><main><h1>【", place, "】【抽選申込】 ", brand, "</h1><section><h2>申込開始</h2><p>", at(0), " 10:00から</p><dl><dt>申込", F.when(F.col("o_totalprice") > 50_000, "終了").otherwise("方法"), "</dt><dd>", at(7), " 23:59まで</dd></dl></section><p>当選発表</p><p>", at(9), " 17:00</p><p>商品名：Booster <b>", k, "</b> [OP-", F.col("o_custkey"), "]</p><a href='/p/", k, "?utm_source=x'>", brand, "</a>",
        "<table><tr><td>店舗概要<td>", F.when(F.col("o_totalprice") > 200_000, "福岡県博多区").otherwise("駅前"), "</table></main></body></html>",
    )
    pages = o.select("o_orderkey", _text("https://", host, "/category/", F.col("o_custkey"), "/", k, ".html").alias("url"), page.alias("html"))
    found = applications.official_applications(pages, "html", "url", "o_orderkey")
    return found.select("o_orderkey", "application_url", "brand", "product", "code", "branch", "prefecture", *[F.col(c).cast("string").alias(c) for c in ("start", "end", "result")], "product_url", "article_id")


_ARTICLE_BRANDS = {"1-URGENT": "ポケモンカード", "2-HIGH": "ONE PIECEカードゲーム", "3-MEDIUM": "魂ネイションズ", "4-NOT SPECIFIED": "ポケモンカード", "5-LOW": "ドラゴンボールカードゲーム フュージョンワールド"}


def article_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of orders as candidates: only what the article holds counts, whatever stands in the sidebar."""
    o = table(spark, sf, "orders").repartition("o_orderkey")  # one file may be few splits, and pages cost more than the shuffle
    k, dear = F.col("o_orderkey"), F.col("o_totalprice") > 200_000
    link = F.when(dear, _text('<a href="https://www.cardlabo.com/shop/', k, '?utm_source=t">apply</a><a href="https://www.cardlabo.com/shop/', k, '">again</a>')).otherwise('<a href="https://news.example.com/archives/1">more</a>')
    page = _text(
        '<html><head><meta property="article:published_time" content="', F.date_format("o_orderdate", "yyyy-MM-dd"), '"></head><body><aside>ポケモンカード 大阪府 <a href="https://livepocket.jp/x">ad</a></aside><article><h1>【抽選】Pack ', k, "の抽選販売</h1><div><p>", _by_priority(_ARTICLE_BRANDS), "</p><ul><li>北海道", F.col("o_custkey"), "</li><li>", F.when(F.col("o_orderstatus") == "O", "カードラボで店頭販売").when(F.col("o_orderstatus") == "F", "amazonの通販").otherwise("予約受付"),
        "</li></ul></div>", link, "</article><footer>ワンピースカードゲーム</footer></body></html>",
    )
    pages = o.select("o_orderkey", _text("https://news.example.com/archives/", k, "?utm_source=x").alias("url"), page.alias("html"))
    found = applications.article_candidates(pages, "html", "url", "o_orderkey", "news.example.com")
    return found.withColumn("destinations", F.array_join(F.transform("destinations", lambda x: F.concat(x["url"], F.lit(" "), x["label"])), ","))


def product_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links that lead to products, by address and words, counted."""
    o = table(spark, sf, "orders")
    path = F.when(F.col("o_orderstatus") == "F", "/info/").when(F.col("o_orderstatus") == "O", "/products/").otherwise("/ex/")
    host = F.when(F.col("o_totalprice") > 300_000, "www.30th.pokemon-card.com/product").otherwise("www.example.com")
    words = _text(F.when(F.col("o_orderpriority") < "3", "拡張パック ").otherwise("お知らせ "), F.when(F.col("o_totalprice") > 150_000, F.date_format("o_orderdate", "M月d日")).otherwise(""))
    return o.groupBy("o_orderpriority", "o_orderstatus", applications.product_link(_text("https://", host, path, F.col("o_orderkey")), words).alias("product")).agg(F.count("*").alias("n"))


def card_products(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that are products of one kind: of a listed type or named so, and no supply."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", applications.card_product(F.lower("p_type"), F.col("p_name"), "(?i)widget", "(?i)^red .*ring", ("economy", "promo")).alias("card"))


def store_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as rows of stores: present ids for old ones, safe addresses, defaults."""
    s = table(spark, sf, "supplier")
    safe = F.col("s_acctbal") > 0
    raw = {
        "id": F.concat(F.lit(" "), F.upper("s_name")), "name": F.when(F.col("s_nationkey") > 5, F.col("s_name")), "url": F.when(safe, _text("HTTPS://x.example/", F.col("s_suppkey"))).otherwise(_text("http://x.example/", F.col("s_suppkey"))), "enabled": F.when(F.col("s_nationkey") > 10, safe), "channel": F.when(F.col("s_nationkey") > 20, "web"),
    }
    made = applications.store_row(raw, {"supplier#000000001": "first-store", "supplier#000000007": "seventh-store"})
    return s.select("s_suppkey", *[c.alias(n) for n, c in made.items()])


def discovery_merge_by_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as discoveries: the first of each product, status and flag, with all its sources in the order in which they came."""
    line = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", F.array(_text("s", F.col("l_suppkey")), _text("t", F.col("l_linenumber"))).alias("sources"))
    found = resolve.merged_discoveries(line, [_text("Part ", F.col("l_partkey")), F.col("l_returnflag"), F.col("l_linestatus")], ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"], "sources")
    return found.select("identity", "l_partkey", "l_returnflag", "l_linestatus", "l_orderkey", "n", F.array_join("sources", ",").alias("sources"), F.when(F.size("sources") >= 2, "HIGH").otherwise("NORMAL").alias("priority"))


def text_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as news of products: those that name one with its date, surely enough."""
    o, k, day = table(spark, sf, "orders"), F.col("o_orderkey"), F.date_format("o_orderdate", "M月d日")
    told = (
        F.when(F.col("o_orderpriority") == "1-URGENT", _text("新しい拡張パック「Pack ", k, "」全", F.col("o_custkey"), "種が", F.date_format("o_orderdate", "yyyy年M月d日"), "発売！")).when(F.col("o_orderpriority") == "2-HIGH", _text("構築デッキ『Deck ", k, "』5種　", day, " 登場。"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", _text("拡張パック「Pack ", k, "」が", day, "発売")).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", _text("大会 拡張パック「Pack ", k, "」3種 ", day)).otherwise(_text("ブースターパック Booster ", k, " EX 発売日未定"))
    )
    rows = o.select("o_orderkey", told.alias("told"), F.when(F.col("o_orderstatus") == "F", "https://x.example/info/1").otherwise("https://x.example/ex/1").alias("url"))
    return entries.product_entries(rows, "told", "url", F.lit("news"), F.lit("1998-08-02").cast("date")).select("o_orderkey", "product_id", "name", "release_date", "confidence")


QUERIES = {f.__name__: f for f in (text_entries, catalog_layouts, catalog_detail_pages, article_records, official_applications, article_candidates, product_links, card_products, store_rows, discovery_merge_by_identity)}


def _cases(values: dict[str, str]) -> str:
    return "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_D = f"(o_orderdate::DATE + {LATER})"
_K = f"(o_custkey % {len(LISTS)})"
ORACLE_SQL = {
    # A quoted name keeps its closing bracket only where a count follows; that and a date make the validator sure.
    "text_entries": """WITH x AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, o_orderdate::DATE AS d, o_custkey AS c, TRY_CAST('1998-' || strftime(o_orderdate, '%m-%d') AS DATE) AS a, TRY_CAST('1999-' || strftime(o_orderdate, '%m-%d') AS DATE) AS b FROM orders),
        y AS (SELECT o_orderkey, s, CASE WHEN p = '1-URGENT' THEN '拡張パック「Pack ' || o_orderkey || '」 ' || c || '種' ELSE '構築デッキ「Deck ' || o_orderkey || '」 5種' END AS name, CASE WHEN p = '1-URGENT' THEN d WHEN DATE '1998-08-02' - a > 120 THEN b ELSE a END AS r FROM x WHERE p IN ('1-URGENT', '2-HIGH'))
        SELECT o_orderkey, 'source_' || left(sha256('news|' || name || '|' || r), 20) AS product_id, name, r::VARCHAR AS release_date, 0.85::DOUBLE AS confidence FROM y WHERE r IS NOT NULL AND s <> 'F'""",
    "catalog_layouts": f"""SELECT o_custkey, {list(LISTS)}[{_K} + 1] AS layout, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ord, 'Pack ' || o_orderkey || ' & ' || o_orderpriority AS name,
        CASE {_K} WHEN 4 THEN 'https://dm.example/product/' WHEN 7 THEN '/detail.php?id=' ELSE '/products/' END || o_orderkey AS url, '/i/' || o_orderkey || '.png' AS image, CASE WHEN {_K} IN (0, 1, 2, 4, 5) THEN o_orderstatus ELSE '' END AS kind,
        CASE {_K} WHEN 7 THEN o_orderstatus WHEN 8 THEN 'true' ELSE '' END AS status, CASE {_K} WHEN 8 THEN 'h' || o_orderkey ELSE '' END AS code, CASE WHEN {_K} < 6 THEN {_D}::VARCHAR END AS date, CASE WHEN {_K} <> 6 THEN floor(o_totalprice)::BIGINT END AS price FROM orders""",
    "catalog_detail_pages": f"SELECT o_orderkey, 'Pack ' || o_orderpriority AS name, '/i/' || o_orderkey || '.png' AS image, 'CG-' || o_orderkey AS code, floor(o_totalprice)::BIGINT AS price, {_D}::VARCHAR AS date FROM orders",
    "article_records": f"""WITH x AS (SELECT *, o_orderstatus = 'P' AS meet, left(o_orderpriority, 1) AS p FROM orders), y AS (SELECT *, CASE p WHEN '1' THEN 'lottery' WHEN '2' THEN 'reservation' WHEN '3' THEN 'event' WHEN '5' THEN CASE WHEN meet THEN 'event' ELSE 'needs_review' END END AS class FROM x WHERE p <> '4')
        SELECT o_orderkey, 'article_' || left(sha256('https://x.example/' || o_orderkey || '|' || CASE WHEN meet THEN '大会 ' ELSE '新弾 ' END || o_orderkey), 20) AS article_id, CASE WHEN meet THEN 'event' ELSE class END AS class, 'Pack ' || o_orderkey AS product, strftime({_D}, '%Y年%-m月%-d日') || ' 10:00 ～ ' || strftime({_D} + 8, '%Y年%-m月%-d日') AS period,
        ({_D} + INTERVAL 10 HOUR)::VARCHAR AS start, ({_D} + INTERVAL 8 DAY)::VARCHAR AS "end", '購入数制限' AS conditions, CASE WHEN p = '2' THEN '予約受付中' ELSE '状態不明' END AS stock, CASE WHEN floor(o_totalprice) BETWEEN 100 AND 1000000 THEN floor(o_totalprice)::BIGINT END AS highest, floor(o_totalprice)::BIGINT AS first FROM y WHERE meet OR class <> 'needs_review'""",
    "official_applications": f"""WITH x AS (SELECT *, 'https://parks2.bandainamco-am.co.jp/category/' || o_custkey || '/' || o_orderkey || '.html' AS u, {_cases(_PLACES)} AS place FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 50000 AND o_orderpriority < '4')
        SELECT o_orderkey, u AS application_url, CASE WHEN o_orderpriority = '2-HIGH' THEN 'dragon_ball_fusion_world' ELSE 'onepiece' END AS brand, 'Booster ' || o_orderkey || ' [OP-' || o_custkey || ']' AS product, 'OP-' || o_custkey AS code, place AS branch,
        CASE WHEN o_totalprice > 200000 THEN '福岡県' WHEN place = '大阪梅田店' THEN '大阪府' WHEN place = '東京店' THEN '東京都' ELSE 'UNKNOWN' END AS prefecture, ({_D} + INTERVAL 10 HOUR)::VARCHAR AS start, ({_D} + INTERVAL 7 DAY + INTERVAL 1439 MINUTE)::VARCHAR AS "end", ({_D} + INTERVAL 9 DAY + INTERVAL 17 HOUR)::VARCHAR AS result,
        'https://parks2.bandainamco-am.co.jp/p/' || o_orderkey AS product_url, 'bandai-' || left(sha256(u), 16) AS article_id FROM x""",
    "article_candidates": """SELECT o_orderkey, 'https://news.example.com/archives/' || o_orderkey AS source_url, '【抽選】Pack ' || o_orderkey || 'の抽選販売' AS title, o_orderdate::DATE::VARCHAR AS published,
        CASE o_orderpriority WHEN '2-HIGH' THEN 'onepiece' WHEN '5-LOW' THEN 'dragon_ball_fusion_world' ELSE 'pokemon' END AS category, 'Pack ' || o_orderkey AS product, CASE o_orderstatus WHEN 'O' THEN 'カードラボ' WHEN 'F' THEN 'Amazon' ELSE '' END AS chain, '北海道' AS prefecture,
        CASE o_orderstatus WHEN 'O' THEN 'STORE' WHEN 'F' THEN 'ONLINE' ELSE 'UNKNOWN' END AS mode_hint, CASE WHEN o_totalprice > 200000 THEN 'https://www.cardlabo.com/shop/' || o_orderkey || ' apply' ELSE '' END AS destinations, o_orderstatus IN ('O', 'F') AND o_totalprice <= 200000 AS unknown_store
        FROM orders WHERE o_orderpriority <> '3-MEDIUM'""",
    "product_links": """WITH x AS (SELECT *, o_orderpriority < '3' AS w, o_totalprice > 150000 AS r FROM orders)
        SELECT o_orderpriority, o_orderstatus, CASE WHEN o_totalprice > 300000 THEN r WHEN o_orderstatus = 'F' AND NOT w THEN false ELSE (w AND r) OR (o_orderstatus = 'P' AND r) END AS product, count(*) AS n FROM x GROUP BY ALL""",
    "card_products": "SELECT p_partkey, NOT contains(lower(p_name), 'widget') AND (lower(p_type) IN ('economy', 'promo') OR regexp_matches(lower(p_name), '^red .*ring')) AS card FROM part",
    "store_rows": """WITH x AS (SELECT *, CASE s_suppkey WHEN 1 THEN 'first-store' WHEN 7 THEN 'seventh-store' ELSE lower(s_name) END AS i FROM supplier)
        SELECT s_suppkey, i AS id, i AS canonical_store_id, i AS store_group_id, CASE WHEN s_nationkey > 5 THEN s_name ELSE i END AS name, s_nationkey > 10 AND s_acctbal > 0 AS enabled, s_nationkey <= 10 OR s_acctbal > 0 AS active, CASE WHEN s_acctbal > 0 THEN 'HTTPS://x.example/' || s_suppkey ELSE '' END AS site_url,
        'unknown' AS chain_support, 'unconfirmed' AS evidence_type, 'unsupported' AS discovery_method, false AS monitoring_supported, CASE WHEN s_nationkey > 20 THEN 'web' ELSE 'chain' END AS channel, 'その他' AS sales_type, 'Web' AS application_method, '' AS notes FROM x""",
    "discovery_merge_by_identity": """WITH x AS (SELECT *, row(l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS o FROM lineitem), g AS (SELECT l_partkey, l_returnflag, l_linestatus, count(*) AS n, min(l_orderkey) AS l_orderkey FROM x GROUP BY ALL),
        s AS (SELECT l_partkey, l_returnflag, l_linestatus, 's' || l_suppkey AS s, row(o, 0) AS w FROM x UNION ALL SELECT l_partkey, l_returnflag, l_linestatus, 't' || l_linenumber, row(o, 1) FROM x), d AS (SELECT l_partkey, l_returnflag, l_linestatus, s, min(w) AS w FROM s GROUP BY ALL),
        j AS (SELECT l_partkey, l_returnflag, l_linestatus, string_agg(s, ',' ORDER BY w) AS sources FROM d GROUP BY ALL)
        SELECT sha256('part' || l_partkey || '|' || lower(l_returnflag) || '|' || lower(l_linestatus)) AS identity, l_partkey, l_returnflag, l_linestatus, l_orderkey, n, sources, 'HIGH' AS priority FROM g JOIN j USING (l_partkey, l_returnflag, l_linestatus)""",
}
