"""Queries over facts that texts tell. Texts are written from the tables' own rows; the SQL derives from these what each must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.functions import extract, text
from tallyreef.plans.cases import pick, sql_pick
from tallyreef.sources.tables import table


def _by_type(**told: Column) -> Column:
    """What a part's type is told as."""
    chain = F
    for kind, value in told.items():
        chain = chain.when(F.col("p_type") == kind, value)
    return chain.otherwise(F.col("p_name"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _post() -> Column:
    name, size = F.col("p_name"), F.lpad(F.col("p_size").cast("string"), 2, "0")
    return _by_type(
        STANDARD=_text("ポケモンカード「", name, "」抽選販売 https://a.example/", F.col("p_type"), "。"), ECONOMY=_text("ワンピースカード OP-", size, " 予約開始 カードラボ秋葉原店"), MEDIUM=_text("FW FB", size, " 再入荷 購入期間：", size, "日まで"),
        LARGE=_text("ポケカ 買取 ", name), PROMO=_text("ユニアリ 販売中 「", name, "」"),
    )


def discovery_posts(spark: SparkSession, sf: str) -> DataFrame:
    """What posts tell: type, category, code, product, address, store, purchase period."""
    return table(spark, sf, "part").select("p_partkey", extract.post(_post(), F.lit("other")).alias("x"), extract.post_kind(_post()).alias("kind")).select("p_partkey", "x.*", "kind")


def post_supplements(spark: SparkSession, sf: str) -> DataFrame:
    """Posts whose gaps another reader fills where it gives anything, counted by product."""
    found = extract.post(_post(), F.lit("other"))
    filled = extract.filled_by({"product": found["product"], "store": found["store"]}, {"product": F.when(F.col("p_retailprice") > 1000, F.col("p_brand"))})
    return table(spark, sf, "part").groupBy(filled["product"].alias("product"), filled["store"].alias("store")).agg(F.count("*").alias("n"))


def article_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled values, conditions, stock and prices of articles."""
    name, size, price = F.col("p_name"), F.col("p_size"), F.format_number(F.floor("p_retailprice"), 0)
    t = _by_type(
        STANDARD=_text("商品名：", name, " 応募期間：", size, "日～", size + 1, "日 当選発表：7月9日。"), ECONOMY=_text("価格：", price, "円（税込） 応募期間: ", name, " 購入する"), MEDIUM=_text("お一人様", size, "点。キャンセル不可。予約受付 99円 ", price, "円 2,000,000円"),
        LARGE=_text("売り 切れ フォロー＆リポスト 本人確認 ", name), PROMO=_text("販売終了 代理 前金 0円 ", name),
    )
    return table(spark, sf, "part").select(
        "p_partkey", extract.labelled_value(t, ("応募期間", "抽選期間")).alias("period"), extract.labelled_value(t, ("商品名",)).alias("product"), F.array_join(extract.condition_labels(t), ",").alias("conditions"),
        extract.stock(t).alias("stock"), extract.highest_price(t).alias("highest"), extract.first_price(t).alias("first"),
    )


def application_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve conditions of applications by their wordings, stated or hinted at."""
    name = F.col("p_name")
    t = _by_type(
        STANDARD=_text("公式アプリから応募 ", name, "。会員 登録が必要"), ECONOMY=_text("クレジットカード決済が必須です\n", F.col("p_size") + 10, "歳以上"), MEDIUM=_text("店舗受取限定。店頭受付のみ ", name), LARGE=_text(name, "購入履歴と地域、年齢。応募は", F.col("p_size"), "口"),
        PROMO=_text("キャンセルできません 代引きのみ ", name),
    )
    told = F.transform(extract.conditions(t), lambda x: F.concat_ws("=", x["key"], x["confidence"].cast("string")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(told, ",").alias("conditions"), F.array_join(extract.sentences(t, "応募"), "|").alias("sentences"))


def page_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of result pages, words of names, set codes, and search terms."""
    name, size = F.col("p_name"), F.lpad(F.col("p_size").cast("string"), 2, "0")
    result = _by_type(STANDARD=_text("おめでとうございます ", name, " 当選"), ECONOMY=_text("残念ながら", name, "は落選"), MEDIUM=_text(name, "の結果発表をお待ちください"), LARGE=_text("落選 ", name, " 当選"))
    code = F.when(F.col("p_retailprice") > 1000, _text("op ", size, " ", name)).otherwise(_text("eb‐", size))
    terms = extract.search_terms(F.concat(name, F.lit(" ")), F.lit(""), name, F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type")))
    return table(spark, sf, "part").select("p_partkey", extract.verdict(result, ["当選"], ["落選"], ["結果発表"]).alias("verdict"), F.array_join(extract.name_words(_text("ポケモン 強化拡張パック ", name)), ",").alias("words"), extract.set_code(code).alias("code"), F.array_join(terms, ",").alias("terms"))


def text_confidences(spark: SparkSession, sf: str) -> DataFrame:
    """How well pages of a shop fit a product: keywords, sales words, dates; and how well two products fit."""
    p = table(spark, sf, "part")
    words = F.filter(F.split("p_name", " "), lambda x: x != "")
    shown = F.concat(F.element_at(words, 1), F.when(F.col("p_size") % 2 == 0, " 予約").otherwise(""), pick((" 2026年07月8日", " 2026/07/08", " 20260708", ""), "p_partkey"))
    score = extract.text_confidence(shown, words, F.when(F.col("p_partkey") % 5 > 0, F.lit("2026-07-08")).otherwise(""))
    plain = F.replace("p_name", F.lit(" "), F.lit(""))
    other = F.when(F.col("p_partkey") % 3 == 0, plain).when(F.col("p_partkey") % 3 == 1, F.concat(plain, F.lit("box"))).otherwise(F.lit("ring"))
    dates = (F.lit("2026-07-08"), pick(("2026-07-08", "", "2026-07-09", ""), "p_size"))
    match = extract.match_confidence((F.when(F.col("p_partkey") % 10 == 0, F.lit("c1")).otherwise(""), pick(("c1", "c2", ""), "p_size")), (plain, other), (F.array_distinct(words), F.array(F.lit("ring"))), dates)
    held = extract.terms_match(F.when(F.col("p_partkey") % 4 == 0, F.lit("OP-01")).otherwise(""), pick(("OP-01", "OP-02"), "p_size"), words, shown)
    return p.select("p_partkey", F.round(score, 6).alias("score"), F.round(match, 6).alias("match"), held.alias("held"))


_LD = (
    '<script type="application/ld+json">{"@type": "Product", "name": " A ", "url": "/a"}</script>', '<script type="application/ld+json">[{"@type": "Thing", "name": "B"}, {"@type": ["Product", "X"], "name": "C", "url": "/c"}]</script>',
    '<SCRIPT TYPE=\'application/ld+json\'>{"@graph": [{"@type": "Product", "name": "D", "url": "/d"}]}</SCRIPT><p>', '<script type="application/ld+json">{"itemListElement": [{"@type": "ListItem", "item": {"@type": "Product", "name": "E", "url": "/e"}}]}</script>',
    '<script type="application/ld+json">{broken</script>', "<p>none</p>",
)


def page_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products that JSON-LD blocks of pages name."""
    html = F.concat(F.col("html"), pick(_LD, "page_id"))
    return table(spark, sf, "pages").select("page_id", F.explode(extract.json_ld_products(html)).alias("x")).select("page_id", "x.*")


def unescaped_text(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of pages as text: pictures by their words, blocks as lines, character references decoded."""
    html = _text("<p>", F.col("p_name"), " &amp; ", F.col("p_brand"), " &lt;c&gt; &#12354;&quot;</p><img src='x' alt=\"pic ", F.col("p_size"), "\"><br><script>no</script><h1>", F.col("p_type"), "</h1>")
    return table(spark, sf, "part").select("p_partkey", text.plain_text(html).alias("text"))


QUERIES = {f.__name__: f for f in (discovery_posts, post_supplements, article_facts, application_conditions, page_verdicts, text_confidences, page_products, unescaped_text)}


_Z = "lpad(p_size::VARCHAR, 2, '0')"
_CODE = f"CASE p_type WHEN 'ECONOMY' THEN 'OP-' || {_Z} WHEN 'MEDIUM' THEN 'FB' || {_Z} ELSE '' END"
_PRODUCT = f"CASE WHEN p_type IN ('STANDARD', 'PROMO') THEN p_name ELSE {_CODE} END"
_STORE = "CASE WHEN p_type = 'ECONOMY' THEN 'カードラボ秋葉原店' ELSE '' END"
_TYPE = "CASE p_type WHEN 'STANDARD' THEN 'LOTTERY' WHEN 'ECONOMY' THEN 'RESERVATION' WHEN 'MEDIUM' THEN 'RESTOCK' WHEN 'LARGE' THEN 'IRRELEVANT' WHEN 'PROMO' THEN 'SALE' ELSE 'NEWS' END"
_YEN = "floor(p_retailprice)::BIGINT"
_W = "list_filter(string_split(p_name, ' '), lambda x: x <> '')"
_SHOWN = f"({_W}[1] || CASE WHEN p_size % 2 = 0 THEN ' 予約' ELSE '' END || {sql_pick((' 2026年07月8日', ' 2026/07/08', ' 20260708', ''), 'p_partkey')})"
_FLAT = f"lower(replace({_SHOWN}, ' ', ''))"

ORACLE_SQL = {
    "discovery_posts": f"""SELECT p_partkey, {_TYPE} AS type, CASE p_type WHEN 'STANDARD' THEN 'pokemon' WHEN 'ECONOMY' THEN 'onepiece' WHEN 'MEDIUM' THEN 'dragon_ball_fusion_world' WHEN 'LARGE' THEN 'pokemon' WHEN 'PROMO' THEN 'union_arena' ELSE 'other' END AS category, {_CODE} AS code, {_PRODUCT} AS product,
        CASE WHEN p_type = 'STANDARD' THEN 'https://a.example/STANDARD' ELSE '' END AS url, {_STORE} AS store, CASE WHEN p_type = 'MEDIUM' THEN {_Z} || '日まで' ELSE '' END AS purchase, {_TYPE} AS kind FROM part""",
    "post_supplements": f"SELECT coalesce(nullif({_PRODUCT}, ''), CASE WHEN p_retailprice > 1000 THEN p_brand END, '') AS product, {_STORE} AS store, count(*) AS n FROM part GROUP BY 1, 2",
    "article_facts": f"""SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN p_size || '日～' || (p_size + 1) || '日' WHEN 'ECONOMY' THEN p_name || ' 購入する' ELSE '' END AS period, CASE WHEN p_type = 'STANDARD' THEN p_name ELSE '' END AS product,
        CASE p_type WHEN 'MEDIUM' THEN '購入数制限,キャンセル不可' WHEN 'LARGE' THEN 'Xアカウント必須,リポスト必須,本人確認' WHEN 'PROMO' THEN '前金・内金,代理不可' ELSE '' END AS conditions, CASE p_type WHEN 'ECONOMY' THEN '販売中' WHEN 'MEDIUM' THEN '予約受付中' WHEN 'LARGE' THEN '売り切れ' WHEN 'PROMO' THEN '販売終了' ELSE '状態不明' END AS stock,
        CASE WHEN p_type IN ('ECONOMY', 'MEDIUM') THEN {_YEN} END AS highest, CASE p_type WHEN 'ECONOMY' THEN {_YEN} WHEN 'MEDIUM' THEN 99 END AS first FROM part""",
    "application_conditions": """SELECT p_partkey, concat_ws(',', CASE WHEN contains(p_name, 'id') AND p_type NOT IN ('STANDARD', 'ECONOMY') THEN 'membership_required=0.55' END, CASE p_type WHEN 'STANDARD' THEN 'app_required=0.9,membership_required=0.55' WHEN 'ECONOMY' THEN 'credit_card_required=0.9,age_limit=0.9' WHEN 'MEDIUM' THEN 'store_pickup_only=0.9,in_store_only=0.9' WHEN 'LARGE' THEN 'purchase_history=0.55,region_limited=0.55,age_limit=0.55' WHEN 'PROMO' THEN 'payment_method=0.9,no_cancellation=0.9' END) AS conditions,
        CASE p_type WHEN 'STANDARD' THEN '公式アプリから応募 ' || p_name WHEN 'LARGE' THEN '応募は' || p_size || '口' ELSE '' END AS sentences FROM part""",
    "page_verdicts": f"""SELECT p_partkey, CASE WHEN p_type IN ('STANDARD', 'LARGE') THEN '当選候補' WHEN p_type = 'ECONOMY' THEN '落選候補' WHEN p_type = 'MEDIUM' THEN '結果待ち候補' ELSE '判定できません' END AS verdict, array_to_string(list_concat(['ポケモン'], regexp_extract_all(lower(p_name), '[a-z0-9]{{3,}}'))[1:6], ',') AS words,
        CASE WHEN p_retailprice > 1000 THEN 'OP-' ELSE 'EB-' END || {_Z} AS code, concat_ws(',', p_name, p_brand, CASE WHEN p_size > 25 THEN p_type END) AS terms FROM part""",
    "text_confidences": f"WITH x AS (SELECT *, {_W} AS w, {_SHOWN} AS s, {_FLAT} AS f, replace(p_name, ' ', '') AS pl FROM part), y AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN pl WHEN p_partkey % 3 = 1 THEN pl || 'box' ELSE 'ring' END AS o, {sql_pick(('2026-07-08', '', '2026-07-09', ''), 'p_size')} AS d2, {sql_pick(('c1', 'c2', ''), 'p_size')} AS c2 FROM x) SELECT p_partkey, round(least(1.0::DOUBLE, 0.65::DOUBLE * len(list_filter(w, lambda a: contains(f, a))) / len(w) + CASE WHEN p_size % 2 = 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN p_partkey % 5 > 0 AND p_partkey % 4 < 3 THEN 0.15::DOUBLE ELSE 0 END), 6) AS score, round(CASE WHEN p_partkey % 10 = 0 AND c2 <> '' THEN CASE WHEN c2 = 'c1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN d2 = '2026-07-09' THEN 0.0::DOUBLE ELSE least(0.99::DOUBLE, CASE WHEN pl = o THEN 0.95::DOUBLE WHEN contains(pl, o) OR contains(o, pl) THEN 0.84::DOUBLE + 0.1::DOUBLE * least(length(pl), length(o)) / greatest(length(pl), length(o)) ELSE (0.65::DOUBLE / len(list_distinct(w)) + 0.25::DOUBLE) * list_contains(w, 'ring')::INT END + CASE WHEN d2 = '2026-07-08' THEN 0.08::DOUBLE ELSE 0 END) END, 6) AS \"match\", CASE WHEN p_partkey % 4 = 0 THEN p_size % 2 = 0 ELSE len(list_filter(w, lambda a: contains(s, a))) >= least(2, len(w)) END AS held FROM y",
    "page_products": "SELECT page_id, (['A', 'C', 'D', 'E'])[page_id % 6 + 1] AS name, (['/a', '/c', '/d', '/e'])[page_id % 6 + 1] AS url FROM pages WHERE page_id % 6 < 4",
    "unescaped_text": "SELECT p_partkey, p_name || ' & ' || p_brand || ' <c> あ\"' || chr(10) || 'pic ' || p_size || chr(10) || p_type AS text FROM part",
}
