"""Pages read by layouts, application pages and articles, on small pages of the shapes that sites have."""

import json

from pyspark.sql import functions as F

from tallyreef.functions import applications, markup


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_layout_items_may_nest_and_leave_out_end_tags(spark):
    layout = json.dumps({"item": "li.item[data-id]", "fields": {"id": "@data-id", "name": "h3", "link": "a.more[href*=/p/]@href|data-href", "date": "dt=Date + dd", "all": "*"}})
    html = """<ul><li class="item first" data-id="1"><h3>One &amp; <b>only</b></h3><ul><li>inner<li>list</ul><a class=more href="/x/"></a><a class="more" href="/p/1">go</a>
      <dl><dt>Other<dd>no<dt> Date <dd>2026-01-02</dl><ul><li class=item data-id=2><h3>Inner item</h3></li></ul><script>var h = "<h3>no</h3>"</script></li>
      <li class="item" data-id="3"><a class=more data-href="y" href="/p/3"><h3></h3><h3>Third<br>line</h3></ul><li class=item>no id</li>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>nothing")], "page int, html string")
    found = sorted(rows(markup.layout_rows(pages, "html", layout), "page", "ord", "id", "name", "link", "date", "all"))
    assert found == [
        (1, 0, "1", "One & only", "/p/1", "2026-01-02", "One & only inner list go Other no Date 2026-01-02"),
        (1, 1, "2", "Inner item", "", "", "Inner item"),
        (1, 2, "3", "Third line", "/p/3", "", "Third line"),
    ]


def test_every_layout_compiles_and_reads_its_own_fields():
    for name, (_, fields) in markup.LAYOUTS.items():
        assert markup.layout_of(name).fields.keys() == fields.keys() <= set(markup.STANDARD)


def test_page_rows_know_headings_and_articles(spark):
    html = "<title>t</title><aside>side</aside><article><h1>Head</h1><dl><dt>a<dd>b</dl><a href='/x'>to <b>x</b></a><img alt='pic'></article><p>after</p>"
    found = markup.page_rows(spark.createDataFrame([(1, html)], "k int, html string"), "html").filter("kind <> 'meta'").orderBy("ord")
    assert rows(found, "kind", "text", "href", "heading", "within") == [
        ("text", "t", "", "", False), ("text", "side", "", "", False), ("text", "Head", "", "", True), ("text", "a", "", "Head", True), ("text", "b", "", "Head", True),
        ("link", "to x", "/x", "Head", True), ("text", "to x pic", "", "Head", True), ("text", "after", "", "Head", False),
    ]


def test_brands_need_a_name_beside_a_code(spark):
    cases = {
        "onepiece": ["ONE PIECEカードゲーム", "ONE PIECE CARD GAME", "ワンピースカード", "ワンピカード", "ONE PIECE OP-17", "ワンピ EB-03", "ONE PIECE PRB-02", "ワンピース ST-21"],
        "dragon_ball_fusion_world": ["DRAGON BALL SUPER CARD GAME FUSION WORLD", "FUSION WORLD", "DBSCG FW", "DBFW", "ドラゴンボール FB-11", "DBSCG SB-02", "ドラゴンボール FS-08"],
        "other": ["店舗番号 OP-17", "DRAGON BALL SUPER CARD GAME MASTERS FB-01", "商品棚 FS-08", ""],
    }
    listed = [(t, brand) for brand, texts in cases.items() for t in texts]
    found = spark.createDataFrame(listed, "t string, b string").select("t", "b", applications.brand(F.col("t")).alias("found")).collect()
    assert [(r.t, r.found) for r in found] == listed


def test_application_dates_with_and_without_a_year(spark):
    texts = [
        ("応募開始:2026年8月22日(土) 12:00 締切:2026/08/24 23:59", None, "2026-08-22 12:00:00", "2026-08-24 23:59:00"), ("応募期間:8月22日(土) 12:00~8月24日 23:59", "2026-08-20", "2026-08-22 12:00:00", "2026-08-24 23:59:00"),
        ("応募期間:8/22~8/24", "2026-08-20", None, None), ("当日18時まで", "2026-08-22", None, "2026-08-22 18:00:00"), ("応募期間:12月30日 12:00~1月4日 9時", "2026-12-20", "2026-12-30 12:00:00", "2027-01-04 09:00:00"), ("締切 2026/02/30 10:00", None, None, None),
    ]
    df = spark.createDataFrame([t[:2] for t in texts], "t string, day string")
    dates = applications.application_dates(F.col("t"), F.coalesce(F.to_date("day"), F.lit(None).cast("date")))
    assert rows(df.select(*[dates[n].cast("string").alias(n) for n in ("start", "end")]), "start", "end") == [t[2:] for t in texts]


APPLICATION = """<html><head><title>{0}</title></head><body><main><h1>{0}</h1><p>申込開始</p><p>2026/08/12 10:00から</p><p>申込終了</p><p>2026/08/16 23:59まで</p><p>当選発表</p><p>2026/08/17 17:00</p>
  <p>販売は＜公式ショップ＞店頭での購入となります。</p><p>商品名：ブースターパック 世界最強の戦士【OP-17】</p><a href="/category/item?utm_source=x&b=1">ＯＮＥ ＰＩＥＣＥ カードゲーム</a></main></body></html>"""


def test_official_applications(spark):
    url = "https://parks2.bandainamco-am.co.jp/category/E/E_1.html"
    title = "【大阪梅田店】8/22~26【抽選申込】 ONE PIECEカードゲーム"
    pages = [(1, url, APPLICATION.format(title)), (2, "https://example.invalid/a", APPLICATION.format(title)), (3, url, "<p>ONE PIECEカードゲーム 商品名：OP-17</p>"), (4, url, None), (5, url, APPLICATION.format(title).replace("商品名", "品名")), (None, url, APPLICATION.format(title + "<table><tr><td>店舗概要<td>福岡県"))]
    found = applications.official_applications(spark.createDataFrame(pages, "k int, url string, html string"), "html", "url", "k").orderBy("k")
    got = rows(found, "k", "brand", "product", "code", "branch", "prefecture", "product_url")
    same = ("onepiece", "ブースターパック 世界最強の戦士【OP-17】", "OP-17", "大阪梅田店")
    assert got == [(None, *same, "福岡県", "https://parks2.bandainamco-am.co.jp/category/item?b=1"), (1, *same, "大阪府", "https://parks2.bandainamco-am.co.jp/category/item?b=1")]
    assert rows(found.filter("k = 1").select(F.col("start").cast("string").alias("s"), F.col("end").cast("string").alias("e"), F.col("result").cast("string").alias("r")), "s", "e", "r") == [("2026-08-12 10:00:00", "2026-08-16 23:59:00", "2026-08-17 17:00:00")]


def test_articles_count_what_they_hold(spark):
    article = "<html><body>{2}<article><h1>{0}</h1><p>{1}</p></article><aside>ポケモンカード ワンピースカードゲーム 大阪府</aside></body></html>"
    pages = [
        (1, article.format("魂ネイションズ新製品", "フィギュアの予約受付情報です。", "")), (2, article.format("【抽選】新弾の抽選販売", "ポケモンカード カードラボ店頭販売 北海道 <a href='https://www.cardlabo.com/shop/lottery?utm_source=t'>応募</a>", "<a href='https://livepocket.jp/x'>ad</a>")),
        (3, "<h1>ポケモンカード</h1><p>Amazonの通販 <a href='https://news.example.com/archives/2'>次</a> <a href='https://cardlabo.com.evil.example/'>no</a></p>"), (4, None), (5, ""),
    ]
    df = spark.createDataFrame(pages, "k int, html string").withColumn("url", F.concat(F.lit("https://news.example.com/archives/"), "k"))
    found = applications.article_candidates(df, "html", "url", "k", "news.example.com").orderBy("k")
    assert rows(found, "k", "category", "product", "chain", "prefecture", "mode_hint", "unknown_store") == [(2, "pokemon", "新弾", "カードラボ", "北海道", "STORE", False), (3, "pokemon", "ポケモンカード", "Amazon", "", "ONLINE", True)]
    assert [[tuple(d) for d in r.destinations] for r in found.collect()] == [[("https://www.cardlabo.com/shop/lottery", "応募")], []]
