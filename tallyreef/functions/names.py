"""Names of products, stores and categories: comparison forms, identities, normalized keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyreef.functions.text import blank, first_filled
from tallyreef.functions.urls import application_url

# A price or a release date at the end of a name, spellings of BOX, and marks that names are compared without.
PRICE_END = r"[\s　/／・:：\-]*(?:税込|税抜)?\s*[￥¥]?\s*(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?\s*円(?:\s*\([^)]*\))?\s*"
DATE_END = r"(?:[\s　/／・:：\-]*(?:発売日|発売予定|販売開始)\s*[:：]?\s*)?20\d{2}[年/\-.]\s*\d{1,2}[月/\-.]\s*\d{1,2}日?(?:\s*\([^)]*\))?\s*"
BOX_END = r"[\s　]*(?:BOX|ＢＯＸ|ボックス|1BOX|１ＢＯＸ)[\s　]*$"
NAME_MARKS = r"[\s「」『』【】・･_‐―\-:：/／\\|]"
STORE_MARKS = r"[\s\-_/・･.()（）\[\]【】]+"
UNKNOWN_KINDS = ("", "その他", "不明", "unknown", "none")
NO_NAME = "商品名未設定"

# Fields of an identifier in order, with their other names.
IDENTIFIERS = (("official_product_id", ("official_product_id", "official_id")), ("product_code", ("product_code",)), ("jan", ("jan", "jan_code")))
BRANDS = ("manufacturer", "maker", "brand")

# Names by which branches of a chain begin.
CHAIN_NAMES = {
    "card_labo": ("カードラボ",),
    "hobby_station": ("ホビーステーション",),
    "batoroco": ("トーナメントセンターバトロコ", "バトロコ"),
    "plays": ("プレイズ", "playze"),
    "cardbox": ("カードボックス", "cardbox"),
    "furuichi": ("ふるいち", "古本市場"),
    "bookoff": ("bookoff", "ブックオフ"),
}

# Categories with their names, short names and places.
CATEGORIES = (
    ("pokemon", "ポケモンカード", "ポケモン", 10),
    ("onepiece", "ワンピースカード", "ワンピース", 20),
    ("yugioh", "遊戯王OCG", "遊戯王", 30),
    ("gundam", "ガンダムカード", "ガンダム", 40),
    ("union_arena", "UNION ARENA", "ユニアリ", 45),
    ("dragon_ball_fusion_world", "ドラゴンボールSCG フュージョンワールド", "DBSCG FW", 47),
    ("duelmasters", "デュエル・マスターズ", "デュエマ", 50),
    ("weiss", "ヴァイスシュヴァルツ", "ヴァイス", 60),
    ("mtg", "マジック：ザ・ギャザリング", "MTG", 70),
    ("other", "その他", "その他", 90),
)
# Other labels of a category.
LABELS = {
    "pokemon": ("ポケモンカードゲーム", "pokemon", "pokemon card game", "pokémon card game"),
    "onepiece": ("one pieceカードゲーム", "one piece", "ワンピースカードゲーム", "onepiece", "one piece card game", "opcg"),
    "yugioh": ("yu-gi-oh!", "yugioh", "yu gi oh", "yu-gi-oh", "遊戯王カードゲーム"),
    "gundam": ("ガンダムカードゲーム", "gundam", "gundam card game", "gundam gcg"),
    "union_arena": ("union arena", "union_arena", "ユニオンアリーナ"),
    "dragon_ball_fusion_world": (
        "dragon_ball_fusion_world", "dragon ball super card game fusion world", "dbscg fusion world", "dbs fw", "dbfw", "fusion world",
        "dragon ball fusion world", "ドラゴンボールスーパーカードゲーム フュージョンワールド", "ドラゴンボールカードゲーム フュージョンワールド", "フュージョンワールド",
    ),
    "duelmasters": ("デュエルマスターズ", "duel masters", "duelmasters", "dm"),
    "weiss": ("weiss schwarz", "weissschwarz", "ws"),
    "mtg": ("マジック:ザ・ギャザリング", "マジック・ザ・ギャザリング", "magic: the gathering", "magic the gathering"),
}
OTHER = "other"
_LABEL_MARKS = r"[\s_\-‐―!！]+"

# Words of supplies and of limited editions, and the products that limited words count for.
SUPPLY_WORDS = ("スリーブ", "プレイマット", "デッキケース", "ストレージ", "バインダー", "アクセサリー", "サプライセット")
LIMITED_WORDS = ("コラボ", "周年", "イベント限定", "店舗限定", "記念商品", "数量限定", "キャンペーン商品", "特別セット")
LIMITED_PRODUCTS = (*SUPPLY_WORDS, "カード", "セット", "box", "ボックス", "パック", "デッキ")

# Product words that a search keyword leaves out, in order.
SEARCH_WORDS = (
    "ポケモンカードゲーム", "ワンピースカードゲーム", "ガンダムカードゲーム", "遊戯王ocg", "デュエルマスターズtcg", "デュエルマスターズ", "ヴァイスシュヴァルツ", "マジックザギャザリング", "magicthegathering",
    "mega", "強化拡張パック", "拡張パック", "ブースターパック", "ハイクラスパック", "プレミアムデッキセット", "スターターセットex", "スターターセット", "スタートデッキ", "スターターデッキ", "構築デッキ", "デッキセット", "box",
)
SEARCH_MARKS = r"[\s「」『』・･_\-&＆（）()【】\[\]、。！!：:]"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC form."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _trimmed(column: Column) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def without_metadata(column: Column) -> Column:
    """A name without prices and release dates at its end."""
    text = _trimmed(F.regexp_replace(nfkc(F.coalesce(column.cast("string"), F.lit(""))), r"[\r\n\t]+", " "))
    return _trimmed(F.regexp_replace(text, f"(?i)(?:{PRICE_END}|{DATE_END})+$", ""))


def _comparable(text: Column) -> Column:
    boxed = F.regexp_replace(text, r"(?i)(?:1\s*)?(?:box|ボックス)", " box ")
    return F.regexp_replace(F.lower(boxed), f"(?U){NAME_MARKS}", "")


def product_name(column: Column) -> Column:
    """The form in which names of products are compared."""
    return _comparable(without_metadata(column))


def strong_product_name(column: Column) -> Column:
    """The same without BOX at the end; only for rows that agree in kind."""
    return product_name(F.regexp_replace(without_metadata(column), f"(?i){BOX_END}", ""))


def display_name(column: Column) -> Column:
    """The name that is shown: without BOX at the end, unless nothing else is left."""
    text = _trimmed(nfkc(F.coalesce(column.cast("string"), F.lit(""))))
    short = _trimmed(F.regexp_replace(text, f"(?i){BOX_END}", ""))
    return first_filled(short, text, F.lit(NO_NAME))


def identifier(*columns: Column) -> Column:
    """Letters and digits of the first of some fields that has any; null if none."""
    forms = [F.nullif(F.regexp_replace(F.lower(nfkc(F.coalesce(c.cast("string"), F.lit("")))), "[^0-9a-z]", ""), F.lit("")) for c in columns]
    return F.coalesce(*forms) if len(forms) > 1 else forms[0]


def identifiers(columns: Mapping[str, Column]) -> dict[str, Column]:
    """Canonical identifier fields, for the columns that are there."""
    return {name: identifier(*[columns[x] for x in aliases if x in columns]) if any(x in columns for x in aliases) else F.lit(None).cast("string") for name, aliases in IDENTIFIERS}


def kind(column: Column) -> Column:
    """Normalized kind; words for an unknown one are empty."""
    name = product_name(column)
    return F.when(name.isin(*UNKNOWN_KINDS), "").otherwise(name)


def brand(*columns: Column) -> Column:
    """Normalized name of the first brand that is filled."""
    return product_name(first_filled(*columns))


def identity_key(category: Column, ids: Mapping[str, Column], kind_: Column, strong: Column) -> Column:
    """By the first identifier where there is one, else by kind and strong name."""
    by_name = F.concat_ws("|", category, kind_, strong)
    chain = by_name
    for name in reversed(list(ids)):
        chain = F.when(ids[name].isNotNull(), F.concat(category, F.lit(f"|id:{name}:"), ids[name])).otherwise(chain)
    return chain


def content_id(category: Column, strong: Column, kind_: Column, brand_: Column, ids: Mapping[str, Column]) -> Column:
    """A stable id of 16 hexadecimal digits by what a product is."""
    listed = F.concat_ws(";", *[F.concat(F.lit(f"{name}:"), value) for name, value in ids.items()])
    return F.substring(F.sha2(F.concat_ws("|", category, strong, kind_, brand_, listed), 256), 1, 16)


def branch_name(chain: Column, branch: Column) -> Column:
    """A branch without separators and without the name of its chain, the first that it begins with."""

    def bare(c: Column) -> Column:
        return F.regexp_replace(F.lower(nfkc(F.coalesce(c.cast("string"), F.lit("")))), r"(?U)[\s　・_-]+", "")

    value, key = bare(branch), F.lower(blank(chain))
    chained = bare(chain)
    out = F.when((chained != "") & F.startswith(value, chained), F.substring(value, F.length(chained) + 1, F.length(value))).otherwise(value)
    known = F
    for name, starts in CHAIN_NAMES.items():
        for start in starts:
            known = known.when((key == name) & value.startswith(start), F.substring(value, F.lit(len(start) + 1), F.length(value)))
    return known.otherwise(out)


def store_key(chain: Column, branch: Column, url: Column) -> Column:
    return F.concat_ws("|", F.lower(blank(chain)), branch_name(chain, branch), application_url(url))


def store_name(column: Column) -> Column:
    """The form in which names of stores are compared."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(column.cast("string"), F.lit("")))), f"(?U){STORE_MARKS}", "")


def chain_and_branch(column: Column) -> tuple[Column, Column]:
    """Chain and branch of a store's name where it names one of the known chains; else the name and no branch."""
    value = _trimmed(nfkc(F.coalesce(column.cast("string"), F.lit(""))))
    akiba = store_name(column).rlike("ヨドバシ(?:カメラ)?(?:マルチメディア)?(?:akiba|秋葉原)")
    pattern = r"(カードラボ|ホビーステーション|ビックカメラ|ヨドバシカメラ)\s*([^\s　]{1,30}?)(?:店|店舗)?$"
    branch = F.regexp_extract(value, pattern, 2)
    chain = F.when(akiba, "ヨドバシカメラ").when(branch != "", F.regexp_extract(value, pattern, 1)).otherwise(value)
    return chain, F.when(akiba, "マルチメディアAkiba").otherwise(branch)


def search_keyword(column: Column) -> Column:
    """What is left of a name when marks and words of all products are gone."""
    value = F.lower(F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), f"(?U){SEARCH_MARKS}", ""))
    for word in SEARCH_WORDS:
        value = F.replace(value, F.lit(word), F.lit(""))
    return value


def letters_only(column: Column) -> Column:
    """Letters, digits, kana and kanji in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(column.cast("string"), F.lit(""))), "[^a-z0-9ぁ-んァ-ヶ一-龠]", "")


def _labels() -> dict[str, str]:
    found: dict[str, str] = {}
    for key, labels in LABELS.items():
        found |= {label: key for label in labels}
    for key, long, short, _ in CATEGORIES:
        found |= {long.lower(): key, short.lower(): key}
    return found


def _lookup(value: Column, known: Mapping[str, str]) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.try_element_at(entries, value)


def label_key(label: Column) -> Column:
    """Category of a label: as it stands, or without separators; null if unknown."""
    import re

    clean = F.lower(blank(nfkc(F.coalesce(label.cast("string"), F.lit("")))))
    labels = _labels()
    compact: dict[str, str] = {}
    for x, key in labels.items():
        compact.setdefault(re.sub(_LABEL_MARKS, "", unicodedata.normalize("NFKC", x).casefold()), key)
    return F.coalesce(_lookup(clean, {unicodedata.normalize("NFKC", x): k for x, k in labels.items()}), _lookup(F.regexp_replace(clean, f"(?U){_LABEL_MARKS}", ""), compact))


def category_key(key: Column, label: Column) -> Column:
    """A known key as it is, else the category of key or label, else ``other``."""
    clean = F.lower(blank(key))
    return F.when(clean.isin(*[k for k, *_ in CATEGORIES]), clean).otherwise(F.coalesce(F.when(clean != "", label_key(clean)), label_key(label), F.lit(OTHER)))


def category_unknown(key: Column) -> Column:
    """A key is given and is none of the known ones."""
    clean = F.lower(blank(key))
    return (clean != "") & ~clean.isin(*[k for k, *_ in CATEGORIES])


def category_name(key: Column, fallback: Column) -> Column:
    return F.coalesce(_lookup(key, {k: name for k, name, *_ in CATEGORIES}), F.nullif(blank(fallback), F.lit("")), F.lit("その他"))


def product_category(value: Column) -> Column:
    """One of the three product categories; CARD where it is none."""
    upper = F.upper(blank(value))
    return F.when(upper.isin("CARD", "SUPPLY", "COLLAB_LIMITED"), upper).otherwise("CARD")


def detected_category(text: Column) -> Column:
    """Limited editions before supplies before cards, by words of a text."""

    def holds(words: Sequence[str], value: Column) -> Column:
        return F.coalesce(value, F.lit("")).rlike("|".join(words))

    limited = holds(LIMITED_WORDS, text) & holds([w.lower() for w in LIMITED_PRODUCTS], F.lower(text))
    return F.when(limited, "COLLAB_LIMITED").when(holds(SUPPLY_WORDS, text), "SUPPLY").otherwise("CARD")


def source_class(method: Column, requires_app: Column, supported: Column, lottery_url: Column, channel: Column) -> Column:
    """How applications of a source are reached."""
    m = F.coalesce(F.nullif(method, F.lit("")), F.lit("unsupported"))
    return (
        F.when((m == "official_app") | F.coalesce(requires_app, F.lit(False)), "APP_REQUIRED")
        .when(m == "official_social", "SNS_ONLY")
        .when((m == "unsupported") | ~F.coalesce(supported, F.lit(False)), "UNSUPPORTED")
        .when(blank(lottery_url) != "", "WEB_FORM")
        .when((F.coalesce(channel, F.lit("")) == "physical") | (m == "store_only"), "STORE_DIRECT")
        .when(m.isin("product_search", "category", "reservation", "official_news"), "WEB_DIRECT")
        .otherwise("UNSUPPORTED")
    )
