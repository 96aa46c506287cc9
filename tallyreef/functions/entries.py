"""Texts of links, pictures and sentences as product rows, if a validator is sure enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreef.functions.rules import additive, bound
from tallyreef.functions.times import date_of, rolled_forward

# Words that an entry on a product has, and words of other news.
PRODUCT_WORDS = ("拡張パック", "強化拡張パック", "ブースターパック", "スターターセット", "スタートデッキ", "スターターデッキ", "構築デッキ", "プレミアムデッキセット", "デッキセット", "BOX", "ボックス")
OTHER_NEWS = ("大会", "イベント", "キャンペーン", "チャンピオンシップ", "プロモカード", "ルール", "カード検索")
# A date with or without a year, kinds of products, and how their names follow.
DATE = r"(?:(\d{4})[./年]\s*)?(\d{1,2})[./月]\s*(\d{1,2})日?"
KIND = "(強化拡張パック|拡張パック|ブースターパック|プレミアムデッキセット|構築デッキ|スターターセットex|スターターセット|スタートデッキ|スターターデッキ|デッキセット)"
QUOTED, PLAIN = KIND + r"\s*[「『]([^」』]{2,80})[」』]", KIND + r"\s*([^\n。！!]{2,80})"
COUNT, PLAIN_END = QUOTED + r"(.{0,20})", r"\d{1,2}月\d{1,2}日|発売|登場|収録カード"
RELEASED = r"(登場|発売|好評発売中)[。！!、\s]*$"
# Fixed values of the validator: terms of products, phrases that describe or invite, and evidence that names.
TERMS = (
    "強化拡張パック", "拡張パック", "ブースターパック", "ハイクラスパック", "スターターセットex", "スターターセット", "スタートデッキ", "スターターデッキ", "構築デッキ", "プレミアムデッキセット", "デッキセット", "デッキビルドパック", "ストラクチャーデッキ",
    "LIMITED PACK", "PREMIUM PACK", "WORLD PREMIERE PACK", "基本パック", "コンセプトパック", "スペシャルパック",
)
REJECTED = ("遊びです", "遊び方", "対戦する", "対戦をする", "参加する", "参加できます", "デッキを組んで", "デッキを組む", "その場で開封", "その場で構築", "プレイヤーでもすぐに参加", "イベント", "大会", "キャンペーン", "ルール", "カード検索", "収録カードを使って")
NAMING = ("h1", "h2", "title", "img_alt", "product_info")
ACCEPT, REVIEW = 0.72, 0.45
ENDS = r"^[ 、。！!]+|[ 、。！!]+$"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def name_score(name: Column, url: Column, evidence: str, release: Column) -> tuple[Column, Column]:
    """Confidence that a text, on one line, is a product's name, and the rules that held."""
    n, at = name, F.coalesce(url, F.lit(""))
    quoted = n.rlike(r"[「『][^」』]{2,80}[」』]")
    score, reasons = additive(
        0.0,
        [
            ("term", _any(n, TERMS), 0.35), ("quoted", quoted, 0.25), ("ex", ~quoted & n.rlike(r"(?U)(?:ex|EX)\b"), 0.10), ("naming", F.lit(evidence in NAMING), 0.20), ("evidence", F.lit(bool(evidence) and evidence not in NAMING), 0.05), ("dated", F.coalesce(release, F.lit("")) != "", 0.10),
            ("special page", at.contains("/ex/"), 0.10), ("information page", ~at.contains("/ex/") & at.contains("/info/"), -0.05), ("long", F.length(n) > 60, -0.30), ("sentences", F.size(F.regexp_extract_all(n, F.lit("([、。！？!?])"), F.lit(1))) >= 2, -0.25), ("rejected", _any(n, REJECTED), -0.55),
            ("sentence end", n.rlike("(です|ます|できます)$"), -0.20), ("how to play", n.contains("1つ"), -0.15),
        ],
    )
    return F.when(n == "", 0.0).otherwise(F.round(score, 6)), reasons


def clean_name(name: Column) -> Column:
    """A name on one line, without brackets at its ends and a date that follows, cut to 120."""
    value = F.regexp_replace(_one_line(name), r"^[「」『』\[\]【】 ]+|[「」『』\[\]【】 ]+$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(value, r"\s*(?:が|を)?\s*\d{1,2}月\d{1,2}日.*$", ""), ENDS, ""), 1, 120)


def entry_name(text: Column) -> Column:
    """The product that a text names: a kind with a quoted name and its count, a kind with what follows, else what stands before the date."""
    kind, quoted, after = (F.regexp_extract(text, COUNT, i) for i in (1, 2, 3))
    count = F.regexp_extract(after, r"(\d+)種", 1)
    full = F.substring(F.concat(kind, F.lit("「"), F.trim(quoted), F.lit("」"), F.when(count != "", F.concat(F.lit(" "), count, F.lit("種"))).otherwise("")), 1, 120)
    plain_kind = F.regexp_extract(text, PLAIN, 1)
    plain = F.regexp_replace(F.element_at(F.split(F.trim(F.regexp_extract(text, PLAIN, 2)), PLAIN_END, 2), 1), r"^[ 、。！!\-/]+|[ 、。！!\-/]+$", "")
    before = F.regexp_replace(F.regexp_replace(F.element_at(F.split(text, DATE, 2), 1), RELEASED, ""), ENDS, "")
    return (
        F.when(text.rlike(QUOTED), full).when((plain != "") & (plain != plain_kind), F.substring(F.concat_ws(" ", plain_kind, plain), 1, 120))
        .when(_any(before, PRODUCT_WORDS), F.right(before, F.lit(120))).otherwise("")
    )


def product_entries(df: DataFrame, text: str, url: str, source: Column, today: Column) -> DataFrame:
    """df's rows whose text tells a product and its date, with product_id, name, release_date and confidence.

    Texts below four characters, without a product's word, with words of other news, without
    a valid date or a name, and names that the validator is not sure of, are none.
    """
    words = tuple(w.lower() for w in PRODUCT_WORDS)

    def read(t: Column) -> Column:
        year, month, day = (F.nullif(F.regexp_extract(t, DATE, i), F.lit("")).cast("int") for i in (1, 2, 3))
        date = F.when(year.isNotNull(), date_of(year, month, day)).otherwise(rolled_forward(date_of(F.year(today), month, day), today)).cast("string")
        told = (F.length(t) >= 4) & _any(F.lower(t), words) & ~_any(t, OTHER_NEWS) & t.rlike(DATE)
        scored = bound(clean_name(entry_name(t)), lambda n: bound(date, lambda d: F.when((n != "") & d.isNotNull(), F.struct(n.alias("name"), d.alias("release_date"), name_score(n, F.col(url), "body_text", d)[0].alias("confidence")))))
        return F.when(told, scored)

    found = df.withColumn("__e", bound(_one_line(F.col(text)), read)).filter(F.col("__e.confidence") >= ACCEPT)
    made = F.concat(F.lit("source_"), F.substring(F.sha2(F.concat_ws("|", source, "name", "release_date"), 256), 1, 20))
    return found.select(*df.columns, "__e.*").withColumn("product_id", made)
