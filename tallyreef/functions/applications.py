"""Application pages and articles as rows: what their lines, links and headings tell."""

from __future__ import annotations

from collections.abc import Mapping
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tallyreef.functions import extract, urls
from tallyreef.functions.markup import lines_of, lists_of
from tallyreef.functions.rules import bound, first_match

# Names of two brands, and codes that count only beside a brand's name.
ONE_PIECE = r"(?i)one\s*piece\s*(?:カードゲーム|card\s*game)|ワンピースカード(?:ゲーム)?|ワンピカード"
FUSION_WORLD = r"(?i)dragon\s*ball\s*super\s*card\s*game\s*fusion\s*world|fusion\s*world|dbscg\s*fw|dbfw|フュージョンワールド"
ONE_PIECE_NAME, ONE_PIECE_CODE = r"(?i)one\s*piece|ワンピ", r"(?i)(?:OP|EB|PRB|ST)-\d+"
DRAGON_BALL_NAME, DRAGON_BALL_CODE, MASTERS = r"(?i)dragon\s*ball|ドラゴンボール|DBSCG", r"(?i)(?:FB|SB|FS)-?\d+", r"(?i)masters|マスターズ"
# The labels of dates on application pages, and a date with its time.
START = r"(?:申込|申し込み|応募|予約)(?:受付)?開始"
END = r"(?:申込|申し込み|応募|予約)(?:受付)?終了|締切"
RESULT = r"当選発表|結果発表"
MOMENT = r"(20\d{2})\s*[年/]\s*(\d{1,2})\s*[月/]\s*(\d{1,2})\s*日?\s*(?:\([^)]*\))?\s*(\d{1,2})\s*[:時]\s*(\d{2})?"
PERIOD = r"(?:応募|申込|予約)(?:受付)?期間\s*[:：]?\s*(?:(20\d{2})年)?\s*(\d{1,2})月(\d{1,2})日(?:\([^)]*\))?\s*(\d{1,2})[:時](\d{2})?\s*[~～〜-]\s*(?:(20\d{2})年)?\s*(\d{1,2})月(\d{1,2})日(?:\([^)]*\))?\s*(\d{1,2})[:時](\d{2})?"
SAME_DAY = r"当日\s*(\d{1,2})時(?:\s*(\d{1,2})分)?まで"
# What an application page says, where product, code, branch and address stand on it.
APPLIES = "抽選申込|事前抽選|抽選販売"
PRODUCT = r"商品名\s*[:：]\s*([^\n]+)"
QUOTED = r"(?i)[『「]([^』」]+(?:\[(?:OP|ST|FB|SB|FS)-?\d+\]|【OP-\d+】))['』」]"
CODE = r"(?i)[\[【]((?:OP|EB|PRB|ST|FB|SB|FS)-?\d+)[\]】]"
BRANCH = r"[【＜]([^【＜＞】\n]{1,30}店)[】＞]"
BRANCHES = {"大阪梅田店": "大阪府", "大阪心斎橋店": "大阪府", "東京店": "東京都", "東京池袋店": "東京都", "東京新宿店": "東京都", "東京渋谷店": "東京都", "横浜店": "神奈川県", "イオンモール大日店": "大阪府"}
APPLICATION_HOST = "parks2.bandainamco-am.co.jp"
# Prefectures from north to south.
PREFECTURES = (
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県", "新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県",
    "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県", "鳥取県", "島根県", "岡山県", "広島県", "山口県", "徳島県", "香川県", "愛媛県", "高知県", "福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
)
# Chains that articles name, in order, and domains that articles may point to.
CHAINS = ("カードラボ", "ホビーステーション", "バトロコ", "プレイズ", "お宝創庫", "カードボックス", "TSUTAYA", "ふるいち", "古本市場", "BOOKOFF", "Amazon", "楽天ブックス", "セブンネット", "ポケモンセンター", "プレミアムバンダイ", "麦わらストア")
DESTINATIONS = ("pokemoncenter-online.com", "pokemon-card.com", "pokemon.co.jp", "onepiece-cardgame.com", "bandainamco-am.co.jp", "p-bandai.jp", "livepocket.jp", "cardlabo.com", "hbst.net", "hobby-station.com", "amazon.co.jp", "books.rakuten.co.jp", "7net.omni7.jp")
# Ways of sale that articles hint at, and what precedes and follows a product in a title.
MODES = (("HYBRID", "(?i)Web応募.*店舗受取|オンライン応募.*店頭"), ("ONLINE", "(?i)通販|オンライン|Amazon|楽天ブックス|セブンネット"), ("STORE", "店頭抽選|店頭販売|(?:店舗|店頭)受取"))
TITLE_MARK, TITLE_END = r"^[〖【\[].*?[〗】\]]", r"(?:の)?(?:Amazon)?(?:販売予定|予約|抽選).*$"
WANTED = ("pokemon", "onepiece", "dragon_ball_fusion_world")
PUBLISHED = ("article:published_time", "date", "datepublished")
TITLES = ("og:title", "twitter:title")


def joined(base: Column, href: Column) -> Column:
    """An address as a page of address base means it."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "[^/]*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(site, href)).when(href.rlike("^[?#]"), F.concat(F.regexp_replace(base, "[?#].*$", ""), href)).otherwise(F.concat(folder, href))
    )


def first_of(words: tuple[str, ...], text: Column) -> Column:
    """The first of some words that the text holds, whatever the case; empty if none."""
    return bound(F.lower(text), lambda folded: F.coalesce(*[F.when(folded.contains(F.lower(F.lit(w))), w) for w in words], F.lit("")))


def brand(text: Column) -> Column:
    """onepiece, dragon_ball_fusion_world or other; a code alone is no proof. The text is in NFKC form."""
    return first_match(
        [
            ("onepiece", text.rlike(ONE_PIECE)),
            ("dragon_ball_fusion_world", text.rlike(FUSION_WORLD)),
            ("onepiece", text.rlike(ONE_PIECE_NAME) & text.rlike(ONE_PIECE_CODE)),
            ("dragon_ball_fusion_world", text.rlike(DRAGON_BALL_NAME) & ~text.rlike(MASTERS) & text.rlike(DRAGON_BALL_CODE)),
        ],
        "other",
    )


def _moment(text: Column, pattern: str, first: int, year: Column | None = None) -> Column:
    # The text is searched once; what the pattern found is then written as its parts.
    parts = F.split(F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, ",".join(f"${first + i}" for i in range(5))), ",")

    def at(found: Column) -> Column:
        y, m, d, h, mi = (F.get(found, i).try_cast("int") for i in range(5))
        return F.try_make_timestamp_ntz(y if year is None else F.coalesce(y, year), m, d, h, F.coalesce(mi, F.lit(0)), F.lit(0))

    return bound(parts, at)


def application_dates(text: Column, reference: Column | None = None) -> dict[str, Column]:
    """start, end and result by their labels; with a reference date also from a period, and from an end on that day. The text is in NFKC form."""
    out = {name: _moment(text, rf"(?:{label})\s*[:：]?\s*{MOMENT}", 1) for name, label in (("start", START), ("end", END), ("result", RESULT))}
    if reference is None:
        return out
    start, end_year = _moment(text, PERIOD, 1, F.year(reference)), F.nullif(F.regexp_extract(text, PERIOD, 6), F.lit(""))
    same_year = F.coalesce(F.nullif(F.regexp_extract(text, PERIOD, 1), F.lit("")).cast("int"), F.year(reference))
    end = _moment(text, PERIOD, 6, same_year)
    end = F.when((end < start) & end_year.isNull(), end + F.expr("INTERVAL 1 YEAR")).otherwise(end)
    whole = start.isNotNull() & end.isNotNull()
    hour, minute = (F.nullif(F.regexp_extract(text, SAME_DAY, i), F.lit("")).cast("int") for i in (1, 2))
    day = F.try_make_timestamp_ntz(F.year(reference), F.month(reference), F.dayofmonth(reference), hour, F.coalesce(minute, F.lit(0)), F.lit(0))
    return {"start": F.coalesce(out["start"], F.when(whole, start)), "end": F.coalesce(out["end"], F.when(whole, end), day), "result": out["result"]}


_LINK = pa.struct([("href", pa.string()), ("label", pa.string()), ("within", pa.bool_())])


def _told(html: str | None) -> tuple | None:
    """text, content, title, published and links of one page; None where there is nothing."""
    rows = lines_of(html)
    if not rows:
        return None
    lines = [r for r in rows if r[0] == "text"]
    meta = lambda names: [text for kind, tag, text, *_ in rows if kind == "meta" and tag in names and text]
    # The title is the first heading or mark of one; what tells the time of publishing last counts, else the first time element.
    titles = (text for kind, tag, text, *_ in rows if (kind == "text" and tag == "h1") or (kind == "meta" and tag in TITLES and text))
    published = (meta(PUBLISHED)[-1:] or meta(("time",)) or [""])[0]
    links = [(href, text, within) for kind, _, text, href, _, within in rows if kind == "link"]
    return "\n".join(r[2] for r in lines), "\n".join(r[2] for r in lines if r[5]), next(titles, ""), published, links


_LINKS = ArrayType(StructType().add("href", "string").add("label", "string").add("within", "boolean"))
_PAGE = StructType().add("text", "string").add("content", "string").add("title", "string").add("published", "string").add("links", _LINKS)


@F.arrow_udf(_PAGE)
def _read(pages: pa.Array) -> pa.Array:
    told = [_told(page) for page in pages.to_pylist()]
    columns = list(zip(*(t or ("", "", "", "", []) for t in told), strict=True)) or [()] * 5
    fields = [*(pa.array(c, pa.string()) for c in columns[:4]), lists_of(columns[4], _LINK)]
    return pa.StructArray.from_arrays(fields, names=["text", "content", "title", "published", "links"], mask=pa.array([t is None for t in told], pa.bool_()))


_FORMED_LINK = pa.struct([("href", pa.string()), ("label", pa.string())])
_FORMED = StructType().add("text", "string").add("formed", "string").add("links", ArrayType(StructType().add("href", "string").add("label", "string")))


@F.arrow_udf(_FORMED)
def _read_formed(pages: pa.Array) -> pa.Array:
    """text, the same in NFKC form, and links with labels in that form."""
    told = [_told(page) for page in pages.to_pylist()]
    texts = ["" if t is None else t[0] for t in told]
    links = [[] if t is None else [(href, normalize("NFKC", label)) for href, label, _ in t[4]] for t in told]
    fields = [pa.array(texts, pa.string()), pa.array([normalize("NFKC", t) for t in texts], pa.string()), lists_of(links, _FORMED_LINK)]
    return pa.StructArray.from_arrays(fields, names=["text", "formed", "links"], mask=pa.array([t is None for t in told], pa.bool_()))


def page_texts(df: DataFrame, html: str, url: str, key: str) -> DataFrame:
    """key, address, text (all lines), content (the lines of articles), title, published and links (href, label, within) of each page that has any.

    A page is told as one row where it is read, so its lines need not meet again.
    """
    # Not deterministic for the planner only, as filters on what is read would read the page again.
    pages = df.select(key, urls.application_url(F.col(url)).alias("address"), _read.asNondeterministic()(F.col(html)).alias("page"))
    return pages.filter(F.col("page").isNotNull()).select(key, "address", "page.*")


def target(address: Column, href: Column) -> Column:
    """Where a link of a page leads."""
    return bound(joined(address, href), urls.application_url)


def official_applications(df: DataFrame, html: str, url: str, key: str) -> DataFrame:
    """A row for each official application page: brand, product, code, dates, branch, prefecture, address, and the link to the product.

    Pages of other hosts, without one of the brands, an end, words of an application, or a product are none.
    """
    # Pages of other hosts are not read at all; a page and its forms are read at once. Not deterministic for the planner only, as filters on what is read would read the page again.
    pages = df.filter(urls.host(F.col(url)) == APPLICATION_HOST).select(key, F.col(url).alias("address"), _read_formed.asNondeterministic()(F.col(html)).alias("page"))
    made = pages.filter(F.col("page").isNotNull()).select(key, "address", F.col("page.formed").alias("t"), F.col("page.text").alias("raw"), "page.links")
    dates = application_dates(F.col("t"))
    # The filter below is worked out where the text is read, so what it asks for is bound and its addresses and branches come after it.
    named = bound(F.regexp_extract("raw", PRODUCT, 1), lambda found: F.when(found != "", found).otherwise(F.regexp_extract("raw", QUOTED, 1)))
    product = F.trim(F.regexp_replace(named, r"(?U)\s+", " "))
    rows = made.select(key, "address", "t", "raw", "links", brand(F.col("t")).alias("brand"), *[c.alias(n) for n, c in dates.items()], product.alias("product"))
    rows = rows.filter(F.col("raw").rlike(APPLIES) & (F.col("product") != "") & F.col("brand").isin(*WANTED) & F.col("end").isNotNull())
    known = first_of(tuple(sorted(BRANCHES, key=len, reverse=True)), F.col("raw"))
    branch = bound(known, lambda found: F.when(found != "", found).otherwise(F.trim(F.regexp_extract("raw", BRANCH, 1))))
    told = F.regexp_extract(F.regexp_extract("raw", r"(?s)店舗概要(.{0,500})", 1), "(" + "|".join(PREFECTURES) + ")", 1)
    # The first link whose label names the same brand.
    link = F.try_element_at(F.filter("links", lambda x: brand(x["label"]) == F.col("brand")), F.lit(1))["href"]
    rows = rows.select(key, urls.application_url(F.col("address")).alias("application_url"), "brand", "product", *dates, branch.alias("branch"), told.alias("told"), link.alias("named"))
    place = F.coalesce(F.create_map(*[F.lit(x) for pair in BRANCHES.items() for x in pair])[F.col("branch")], F.lit("UNKNOWN"))
    rows = rows.withColumn("prefecture", F.when(F.col("told") != "", F.col("told")).otherwise(place))
    product_url = F.when(F.col("named").isNotNull(), target(F.col("application_url"), F.col("named"))).otherwise("")
    return rows.select(
        key, "application_url", "brand", "product", F.upper(F.regexp_extract("product", CODE, 1)).alias("code"), "branch", "prefecture", "start", "end", "result", product_url.alias("product_url"),
        F.concat(F.lit("bandai-"), F.substring(F.sha2("application_url", 256), 1, 16)).alias("article_id"),
    )


def article_candidates(df: DataFrame, html: str, url: str, key: str, own_domain: str, domains: tuple[str, ...] = DESTINATIONS, chains: tuple[str, ...] = CHAINS) -> DataFrame:
    """A candidate for each article on a wanted brand: title, product, chain, prefecture, hint of the way of sale, and official destinations in order.

    What stands beside the article counts only where the page has no article of its own.
    """
    pages = page_texts(df, html, url, key)
    body = F.when(F.col("content") != "", F.col("content")).otherwise(F.col("text"))
    links = F.when(F.exists("links", lambda x: x["within"]), F.filter("links", lambda x: x["within"])).otherwise(F.col("links"))
    read = pages.select(key, F.col("address").alias("source_url"), "title", "published", body.alias("body"), links.alias("links"))
    read = read.withColumn("post", extract.post(F.concat_ws("\n", "title", "body"), F.lit("other"))).filter(F.col("post.category").isin(*WANTED))
    official_host = r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$"
    led = F.transform("links", lambda x: F.struct(target(F.col("source_url"), x["href"]).alias("url"), x["label"].alias("label")))
    at = lambda x, holds: bound(urls.host(x["url"]), holds)
    read = read.withColumn("official", F.filter(led, lambda x: at(x, lambda host: (host != own_domain) & host.rlike(official_host))))
    # The first link to each address stays.
    once = F.filter("official", lambda x, i: F.array_position(F.transform("official", lambda y: y["url"]), x["url"]) == i + 1)
    title = F.trim(F.regexp_replace(F.regexp_replace("title", TITLE_MARK, ""), TITLE_END, ""))
    chain = first_of(chains, F.col("body"))
    return read.select(
        key, "source_url", "title", "published", F.col("post.category").alias("category"), F.when(title != "", F.substring(title, 1, 200)).otherwise(F.col("post.product")).alias("product"), chain.alias("chain"), first_of(PREFECTURES, F.col("body")).alias("prefecture"),
        first_match([(n, F.col("body").rlike(p)) for n, p in MODES], "UNKNOWN").alias("mode_hint"), once.alias("destinations"), ((chain != "") & (F.size("official") == 0)).alias("unknown_store"),
    )


# Kinds of products, a date with or without a year, and the host of special pages.
PRODUCT_KINDS = ("強化拡張パック", "拡張パック", "ブースターパック", "ハイクラスパック", "プレミアムデッキセット", "スターターセットex", "スターターセット", "スタートデッキ", "スターターデッキ", "構築デッキ", "デッキセット")
ANY_DATE, SPECIAL_HOST = r"(?:\d{4}[./年]\s*)?\d{1,2}[./月]\s*\d{1,2}日?", "30th.pokemon-card.com"


def product_link(url: Column, text: Column, kinds: tuple[str, ...] = PRODUCT_KINDS) -> Column:
    """Whether a link leads to a product: words of products and of release, special pages, and information pages with a product's word."""
    path, lowered = F.lower(urls.path(url)), F.lower(text)
    product = F.exists(F.array(*[F.lit(k.lower()) for k in kinds]), lambda k: lowered.contains(k))
    release = text.contains("発売") | text.rlike(ANY_DATE)
    special = F.endswith(urls.netloc(url), F.lit(SPECIAL_HOST)) & path.contains("/product/")
    return F.when(special, release).when(path.contains("/info/") & ~product, F.lit(False)).otherwise((product & release) | (path.startswith("/ex/") & release))


# Supplies that are no card products, and card products of no listed category.
SUPPLY = r"(?i)サプライ|スリーブ|カードケース|バインダー|プレイマット|アクションポイントカードセット|フィギュア|グッズ"
CARD_OTHER = r"(?i)NEW CARD SELECTION|PREMIUM CARD SET|プレミアムコレクションボックス|BANDAI CARD GAMES Fest.*スペシャルセット"
CARD_CATEGORIES = ("boosters", "decks")


def card_product(category: Column, name: Column, supply: str = SUPPLY, other: str = CARD_OTHER, categories: tuple[str, ...] = CARD_CATEGORIES) -> Column:
    """Whether a product is one of cards: no supply, and of a card category or named as a card set."""
    return ~name.rlike(supply) & (category.isin(*categories) | name.rlike(other))


def store_row(raw: Mapping[str, Column], aliases: Mapping[str, str]) -> dict[str, Column]:
    """A store's row with its present id, an address that is safe, and a default for each field that is missing."""
    plain = F.lower(F.trim(F.coalesce(raw["id"].cast("string"), F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[plain] if aliases else F.lit(None).cast("string")
    store = F.coalesce(known, plain)
    text = lambda name, default: F.coalesce(raw[name].cast("string"), F.lit(default)) if name in raw else F.lit(default)
    flag = lambda name, default: F.coalesce(raw[name], default) if name in raw else default
    address = F.trim(F.coalesce(raw.get("site_url", F.lit(None)), raw.get("url", F.lit(None)), F.lit("")))
    enabled = flag("enabled", F.lit(False))
    name = F.trim(F.coalesce(raw["name"].cast("string"), F.when(store != "", store), F.lit("名称未設定"))) if "name" in raw else F.coalesce(F.nullif(store, F.lit("")), F.lit("名称未設定"))
    return {
        "id": store, "canonical_store_id": store, "store_group_id": F.coalesce(raw["store_group_id"], store) if "store_group_id" in raw else store, "name": F.when(name == "", "名称未設定").otherwise(name),
        "enabled": enabled, "active": flag("active", F.coalesce(raw["enabled"], F.lit(True)) if "enabled" in raw else F.lit(True)), "site_url": F.when(F.lower(address).startswith("https:"), address).otherwise(""),
        "chain_support": text("chain_support", "unknown"), "evidence_type": text("evidence_type", "unconfirmed"), "discovery_method": text("discovery_method", "unsupported"), "monitoring_supported": flag("monitoring_supported", F.lit(False)),
        "channel": text("channel", "chain"), "sales_type": text("sales_type", "その他"), "application_method": text("application_method", "Web"), "notes": text("notes", ""),
    }
