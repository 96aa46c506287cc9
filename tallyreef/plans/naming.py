"""Queries over names, stores and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.functions import names, urls
from tallyreef.operators import records
from tallyreef.plans import catalog
from tallyreef.plans.cases import pick, sql_pick, sql_text
from tallyreef.sources.tables import table

_ENDS = ("", " 1 BOX", "　ボックス", " 税込5,400円", " 発売日：2026年7月18日", " BOX 5400円", "（新）", " 2026/7/18(土) 300円", " box/set", "・パック")
_KINDS = ("拡張パック", "その他", "", None, "unknown", "スタート デッキ", "BOX")
_CHAINS = ("card_labo", "bookoff", "batoroco", "other", "")
_BRANCHES = ("カードラボ 秋葉原店", "bookoff 新宿", "トーナメントセンターバトロコ 高田馬場", "バトロコ_町田", "Other・Shop 1", "ブックオフ 東京", "")
_KEYS = ("pokemon", "Weiss", "dbfw", "nothing", "", None, "mtg", "union arena")
_LABELS = ("ポケモンカード", "ワンピース カード", "magic the gathering", "遊戯王", "", None, "dm", "unknown label", "DBSCG-FW")
_TYPES = ("CARD", "supply", "collab_limited", "toy", "", None)
_TEXTS = ("周年 記念カード セット", "スリーブ", "コラボ グッズ", "数量限定 BOX", "パック", "プレイマット 店舗限定", "")
_METHODS = ("official_app", "official_social", "unsupported", "product_search", "store_only", "reservation", "", "other")


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").withColumn("written", F.concat("p_name", pick(_ENDS, "p_partkey")))


def product_names(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison, strong and display forms of product names that end in prices, dates and BOX."""
    w = F.col("written")
    return _named(spark, sf).select("p_partkey", names.product_name(w).alias("plain"), names.strong_product_name(w).alias("strong"), names.display_name(w).alias("shown"), names.kind(pick(_KINDS, "p_partkey")).alias("kind"))


def product_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers by first filled field, brand, identity and content id of products."""
    p = _named(spark, sf)
    code = F.when(F.col("p_partkey") % 4 == 1, F.concat("p_brand", F.lit("-"), "p_partkey")).otherwise(F.lit("-"))
    ids = names.identifiers({"official_id": F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Ab "), "p_partkey")), "official_product_id": F.lit(" "), "product_code": code, "jan_code": F.when(F.col("p_partkey") % 5 == 0, F.lit("49-0"))})
    category, kind, strong = names.category_key(pick(_KEYS, "p_partkey"), F.lit("")), names.kind(pick(_KINDS, "p_partkey")), names.strong_product_name(F.col("written"))
    brand = names.brand(F.lit(" "), F.col("p_brand"))
    return p.select("p_partkey", *[ids[x].alias(x) for x in ids], brand.alias("brand"), names.identity_key(category, ids, kind, strong).alias("identity"), names.content_id(category, strong, kind, brand, ids).alias("content_id"))


def store_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Branch names without their chain, store names and store keys."""
    chain, branch = pick(_CHAINS, "page_id"), pick(_BRANCHES, "page_id")
    return table(spark, sf, "pages").select("page_id", names.branch_name(chain, branch).alias("branch"), names.store_name(branch).alias("store"), names.store_key(chain, branch, F.col("url")).alias("key"))


def category_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Categories by key, alias or label, whether the key was unknown, and their names."""
    key, label = pick(_KEYS, "p_partkey"), pick(_LABELS, "p_size")
    found = names.category_key(key, label)
    return table(spark, sf, "part").select("p_partkey", found.alias("key"), names.category_unknown(key).alias("unknown"), names.category_name(found, label).alias("name"))


def product_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Category of products as it is told, and as their texts tell it, counted."""
    t = F.concat_ws(" ", "p_name", pick(_TEXTS, "p_partkey"))
    return table(spark, sf, "part").groupBy(names.product_category(pick(_TYPES, "p_size")).alias("told"), names.detected_category(t).alias("detected")).agg(F.count("*").alias("n"))


def source_classes(spark: SparkSession, sf: str) -> DataFrame:
    """How applications of sources are reached, counted."""
    k = F.col("s_suppkey")
    found = names.source_class(pick(_METHODS, "s_suppkey"), k % 11 == 0, k % 7 != 0, F.when(k % 5 == 0, F.col("s_name")), F.when(k % 3 == 0, F.lit("physical")))
    return table(spark, sf, "supplier").groupBy(found.alias("class")).agg(F.count("*").alias("n"))


def search_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Names without marks and words of all products, and their letters alone."""
    w = F.concat(F.lit("ポケモンカードゲーム MEGA "), F.col("p_name"), F.lit("・拡張パック！ "), pick(_ENDS, "p_partkey"))
    return table(spark, sf, "part").select("p_partkey", names.search_keyword(w).alias("keyword"), names.letters_only(w).alias("letters"))


_SOURCES = ("official_store", "", "OFFICIAL_MANUFACTURER", "none", "", None, "general_information")
_OLDER = ("store_official", "manufacturer_official", "x", "Official_Store", None)
_UNSAFE = ("https://shop.example.jp/a", "http://a.example/", "https://user:x@a.example/", "https://a.example:444/", "https://a.example:443/", "https://10.0.0.1/", "https://x.com/post", "https://printer.local/", "https://app.localhost/", "https://LINKTR.EE/", "", "https://[::1]/", "https://localhost./")
_QUERIES = ("a=%41&b=2", "a=A&utm_source=x", "q=a+b&FBCLID=1", "q=%E3%81%82&x", "z=~!&y=%2F", "", "a=1;b=2&c=%zz")


def link_safety(spark: SparkSession, sf: str) -> DataFrame:
    """Why links are not followed."""
    return table(spark, sf, "part").groupBy(pick(_UNSAFE, "p_partkey").alias("url"), urls.safety_error(pick(_UNSAFE, "p_partkey")).alias("error")).agg(F.count("*").alias("n"))


def query_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical addresses whose parameters are decoded and written anew, so that different spellings meet."""
    u = F.concat(F.lit("https://Shop.Example.com/a/?"), pick(_QUERIES, "p_partkey"))
    return table(spark, sf, "part").groupBy(urls.application_url(u).alias("address")).agg(F.count("*").alias("n"))


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts that are valid: bad names, categories and kinds dropped, older kinds mapped, scores kept within 0 and 100, usual trust filled in."""
    c = table(spark, sf, "customer")
    name = F.concat(pick(("@", "", "bad name ", "x-"), "c_custkey"), F.lit("user"), "c_custkey")
    return records.accounts(c.select(
        name.alias("username"), pick(("pokemon", "ONEPIECE", "mtg"), "c_nationkey").alias("tcg"), pick(_SOURCES, "c_custkey").alias("source_type"), pick(_OLDER, "c_custkey").alias("category"),
        F.when(F.col("c_custkey") % 7 > 0, (F.col("c_acctbal") / 50).cast("int").cast("string")).alias("score"), pick(("", "trusted_chain"), "c_custkey").alias("trust_level"),
    ))


QUERIES = {f.__name__: f for f in (product_names, product_identities, store_keys, category_keys, product_categories, source_classes, search_keywords, link_safety, query_forms, accounts)}

_PRICE = r"[\s　/／・:：\-]*(?:税込|税抜)?\s*[￥¥]?\s*(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?\s*円(?:\s*\([^)]*\))?\s*"
_DATE = r"(?:[\s　/／・:：\-]*(?:発売日|発売予定|販売開始)\s*[:：]?\s*)?20\d{2}[年/\-.]\s*\d{1,2}[月/\-.]\s*\d{1,2}日?(?:\s*\([^)]*\))?\s*"


def _rx(value: str, pattern: str, by: str) -> str:
    return f"regexp_replace({value}, {sql_text(pattern)}, {sql_text(by)}, 'g')"


# Full-width brackets and colons are what NFKC turns into plain ones; the other characters of these texts stay.
_NFKC = "replace(replace(replace(replace(w, '（', '('), '）', ')'), '：', ':'), '　', ' ')"
_BARE = f"trim({_rx('trim(n)', f'(?:{_PRICE}|{_DATE})+$', '')})"
_BOX = r"(?i)[\s　]*(?:BOX|ボックス|1BOX)[\s　]*$"


def _plain(value: str) -> str:
    marks = "[\\s　「」『』【】・･_‐―\\-:：/／\\\\|]"
    boxed = _rx(value, "(?i)(?:1\\s*)?(?:box|ボックス)", " box ")
    return _rx(f"lower({boxed})", marks, "")


_NAMED = f"SELECT *, {_BARE} AS bare FROM (SELECT *, {_NFKC} AS n FROM (SELECT *, p_name || {sql_pick(_ENDS, 'p_partkey')} AS w FROM part))"
_STRONG = _plain(f"trim({_rx(f'trim({_rx('bare', _BOX, '')})', f'(?:{_PRICE}|{_DATE})+$', '')})")
_KIND = f"(CASE WHEN coalesce({sql_pick(_KINDS, 'p_partkey')}, '') IN ('', 'その他', '不明', 'unknown', 'none') THEN '' ELSE {_plain(f'coalesce({sql_pick(_KINDS, 'p_partkey')}, {sql_text('')})')} END)"
_ALIASES = {alias.lower(): key for key, found in names.LABELS.items() for alias in found} | {x.lower(): key for key, long, short, _ in names.CATEGORIES for x in (long, short)}


def _label_sql(value: str) -> str:
    listed = ", ".join(f"({sql_text(a)}, {sql_text(k)})" for a, k in _ALIASES.items())
    clean = f"replace(lower(trim({value})), '：', ':')"
    compact = "[\\s_\\-‐―!！]+"
    return f"coalesce((SELECT any_value(ak) FROM (VALUES {listed}) a(ax, ak) WHERE replace(ax, '：', ':') = {clean}), (SELECT any_value(ak) FROM (VALUES {listed}) a(ax, ak) WHERE regexp_replace(replace(ax, '：', ':'), '{compact}', '', 'g') = regexp_replace({clean}, '{compact}', '', 'g')))"


_KNOWN = ", ".join(sql_text(k) for k, *_ in names.CATEGORIES)


def _category_sql(key: str, label: str) -> str:
    clean = f"lower(trim(coalesce({key}, '')))"
    return f"(CASE WHEN {clean} IN ({_KNOWN}) THEN {clean} ELSE coalesce(CASE WHEN {clean} <> '' THEN {_label_sql(clean)} END, {_label_sql(f'coalesce({label}, {sql_text('')})')}, 'other') END)"


_CODE = "CASE WHEN p_partkey % 4 = 1 THEN regexp_replace(lower(p_brand || p_partkey), '[^a-z0-9]', '', 'g') END"
_IDS = f"CASE WHEN p_partkey % 3 = 0 THEN 'ab' || p_partkey END AS o, {_CODE} AS c, CASE WHEN p_partkey % 5 = 0 THEN '490' END AS j"
_B = "regexp_replace(lower(b), '[\\s　・_-]+', '', 'g')"
_STARTS = ", ".join(f"({sql_text(k)}, {i}, {sql_text(x)})" for k, found in names.CHAIN_NAMES.items() for i, x in enumerate(found))
_BRANCH = f"CASE WHEN EXISTS (SELECT 1 FROM (VALUES {_STARTS}) s(k, i, x) WHERE k = c AND starts_with({_B}, x)) THEN substring({_B}, (SELECT arg_min(length(x), i) FROM (VALUES {_STARTS}) s(k, i, x) WHERE k = c AND starts_with({_B}, x)) + 1) WHEN c <> '' AND starts_with({_B}, regexp_replace(c, '[\\s　・_-]+', '', 'g')) THEN substring({_B}, length(regexp_replace(c, '[\\s　・_-]+', '', 'g')) + 1) ELSE {_B} END"
_WORDS = "k"
for _word in names.SEARCH_WORDS:
    _WORDS = f"replace({_WORDS}, {sql_text(_word)}, '')"

ORACLE_SQL = {
    "product_names": f"SELECT p_partkey, {_plain('bare')} AS plain, {_STRONG} AS strong, coalesce(nullif(trim({_rx('trim(n)', _BOX, '')}), ''), nullif(trim(n), ''), '商品名未設定') AS shown, {_KIND} AS kind FROM ({_NAMED})",
    "product_identities": f"WITH x AS (SELECT *, {_IDS}, {_category_sql(sql_pick(_KEYS, 'p_partkey'), sql_text(''))} AS cat, {_KIND} AS kind, {_STRONG} AS strong, {_plain('p_brand')} AS brand FROM ({_NAMED})) SELECT p_partkey, o AS official_product_id, c AS product_code, j AS jan, brand, CASE WHEN o IS NOT NULL THEN cat || '|id:official_product_id:' || o WHEN c IS NOT NULL THEN cat || '|id:product_code:' || c WHEN j IS NOT NULL THEN cat || '|id:jan:' || j ELSE concat_ws('|', cat, kind, strong) END AS identity, left(sha256(concat_ws('|', cat, strong, kind, brand, concat_ws(';', 'official_product_id:' || o, 'product_code:' || c, 'jan:' || j))), 16) AS content_id FROM x",
    "category_keys": f"WITH x AS (SELECT p_partkey, {sql_pick(_KEYS, 'p_partkey')} AS k, {sql_pick(_LABELS, 'p_size')} AS l FROM part), y AS (SELECT *, {_category_sql('k', 'l')} AS key FROM x) SELECT p_partkey, key, lower(trim(coalesce(k, ''))) <> '' AND lower(trim(coalesce(k, ''))) NOT IN ({_KNOWN}) AS unknown, (SELECT any_value(n) FROM (VALUES {', '.join(f'({sql_text(k)}, {sql_text(n)})' for k, n, *_ in names.CATEGORIES)}) c(k, n) WHERE c.k = key) AS name FROM y",
    "product_categories": f"WITH x AS (SELECT upper(trim(coalesce({sql_pick(_TYPES, 'p_size')}, ''))) AS u, p_name || ' ' || {sql_pick(_TEXTS, 'p_partkey')} AS t FROM part) SELECT CASE WHEN u IN ('CARD', 'SUPPLY', 'COLLAB_LIMITED') THEN u ELSE 'CARD' END AS told, CASE WHEN regexp_matches(t, '{'|'.join(names.LIMITED_WORDS)}') AND regexp_matches(lower(t), '{'|'.join(names.LIMITED_PRODUCTS)}') THEN 'COLLAB_LIMITED' WHEN regexp_matches(t, '{'|'.join(names.SUPPLY_WORDS)}') THEN 'SUPPLY' ELSE 'CARD' END AS detected, count(*) AS n FROM x GROUP BY 1, 2",
    "source_classes": f"WITH x AS (SELECT *, coalesce(nullif({sql_pick(_METHODS, 's_suppkey')}, ''), 'unsupported') AS m FROM supplier) SELECT CASE WHEN m = 'official_app' OR s_suppkey % 11 = 0 THEN 'APP_REQUIRED' WHEN m = 'official_social' THEN 'SNS_ONLY' WHEN m = 'unsupported' OR s_suppkey % 7 = 0 THEN 'UNSUPPORTED' WHEN s_suppkey % 5 = 0 THEN 'WEB_FORM' WHEN s_suppkey % 3 = 0 OR m = 'store_only' THEN 'STORE_DIRECT' WHEN m IN ('product_search', 'reservation') THEN 'WEB_DIRECT' ELSE 'UNSUPPORTED' END AS class, count(*) AS n FROM x GROUP BY 1",
    "search_keywords": f"WITH x AS (SELECT p_partkey, 'ポケモンカードゲーム MEGA ' || p_name || '・拡張パック！ ' || {sql_pick(_ENDS, 'p_partkey')} AS w FROM part), y AS (SELECT *, lower(regexp_replace(w, '[\\s　「」『』・･_\\-&＆（）()【】\\[\\]、。！!：:]', '', 'g')) AS k FROM x) SELECT p_partkey, {_WORDS} AS keyword, regexp_replace(lower(w), '[^a-z0-9ぁ-んァ-ヶ一-龠]', '', 'g') AS letters FROM y",
    "link_safety": f"SELECT {sql_pick(_UNSAFE, 'p_partkey')} AS url, {sql_pick(('', 'scheme', 'credentials', 'port', '', 'address', 'social', 'local', 'local', 'social', 'scheme', 'address', 'local'), 'p_partkey')} AS error, count(*) AS n FROM part GROUP BY 1, 2",
    "query_forms": f"SELECT 'https://shop.example.com/a' || {sql_pick(('?a=A&b=2', '?a=A', '?q=a+b', '?q=%E3%81%82&x=', '?z=~%21&y=%2F', '', '?a=1%3Bb%3D2&c=%25zz'), 'p_partkey')} AS address, count(*) AS n FROM part GROUP BY 1",
    "accounts": f"WITH x AS (SELECT *, coalesce(nullif(upper(coalesce({sql_pick(_SOURCES, 'c_custkey')}, '')), ''), {sql_pick(('OFFICIAL_SHOP_BRANCH', 'OFFICIAL_MANUFACTURER', None, 'OFFICIAL_STORE', None), 'c_custkey')}, 'GENERAL_INFORMATION') AS kind FROM customer) SELECT 'user' || c_custkey AS username, {sql_pick(('pokemon', 'onepiece', 'mtg'), 'c_nationkey')} AS tcg, kind AS source_type, CASE WHEN c_custkey % 7 = 0 THEN 30 ELSE greatest(0, least(100, trunc(c_acctbal / 50)))::INT END AS score, CASE WHEN c_custkey % 2 = 1 THEN 'TRUSTED_CHAIN' ELSE CASE kind WHEN 'OFFICIAL_MANUFACTURER' THEN 'OFFICIAL_TCG' WHEN 'OFFICIAL_STORE' THEN 'OFFICIAL_STORE' WHEN 'OFFICIAL_SHOP_BRANCH' THEN 'TRUSTED_STORE' ELSE 'INFO_ACCOUNT' END END AS trust_level FROM x WHERE c_custkey % 4 IN (0, 1) AND c_nationkey % 3 < 2 AND kind <> 'NONE'",
    "store_keys": f"WITH x AS (SELECT page_id, url, {sql_pick(_CHAINS, 'page_id')} AS c, {sql_pick(_BRANCHES, 'page_id')} AS b FROM pages) SELECT page_id, {_BRANCH} AS branch, regexp_replace(lower(b), '[\\s\\-_/・･.()（）\\[\\]【】]+', '', 'g') AS store, c || '|' || {_BRANCH} || '|' || {catalog.APPLICATION} AS key FROM x",
}
