"""Rows read from shop and catalog pages, by patterns that a layout gives; all are column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreef.functions import extract
from tallyreef.functions.rules import first_match
from tallyreef.functions.text import blank, unescaped

# Words of the classes of articles, in the order in which they are tried.
TRADE = "買取情報|買取表|高価買取|買取価格|優勝デッキ|デッキレシピ|対戦結果|スタッフブログ"
MEETING, SALES_WORDS = "大会|イベント|交流会|トーナメント", "抽選販売|抽選予約|商品予約"
LOTTERY_WORDS, RESERVATION_WORDS, AGAIN = ("抽選", "応募期間", "当選発表", "対象商品"), ("予約受付", "予約期間", "店頭予約", "予約情報"), "再販"
# Labels of a period that ends at the next heading.
PERIOD_LABELS, PERIOD_STOPS = "キャンペーン参加期間|抽選参加期間|応募受付期間|受付期間", "当選発表|その他注意|応募方法"


def inner_text(fragment: Column) -> Column:
    """Text of a fragment on one line, markup removed and references decoded."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(F.coalesce(fragment, F.lit("")), r"(?s)<[^>]*>", " ")), r"(?U)\s+", " "))


def catalog_rows(df: DataFrame, html: str, keys: Sequence[str], item: str, fields: Mapping[str, str]) -> DataFrame:
    """A row for each item of a list page, in page order: ``item`` finds an item's markup, each field's pattern its value; items without a first field are none."""
    found = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(item), F.lit(0))).alias("ord", "__item"))
    rows = found.select(*keys, "ord", *[F.regexp_extract("__item", pattern, 1).alias(name) for name, pattern in fields.items()])
    # Fields are made plain all at once, so that references are decoded in one pass over the rows.
    plain = rows.select(*keys, "ord", *[inner_text(F.col(name)).alias(name) for name in fields])
    return plain.filter(F.col(next(iter(fields))) != "")


def table_rows(df: DataFrame, html: str, keys: Sequence[str]) -> DataFrame:
    """keys, ord and cells of the rows of all HTML tables of a page."""
    rows = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0))).alias("ord", "__row"))
    cells = rows.select(*keys, "ord", F.posexplode(F.regexp_extract_all("__row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("place", "__cell"))
    return cells.select(*keys, "ord", "place", inner_text(F.col("__cell")).alias("cell")).groupBy(*keys, "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "cell"))), lambda x: x["cell"]).alias("cells"))


def script_objects(df: DataFrame, html: str, keys: Sequence[str], pattern: str, schema: str) -> DataFrame:
    """Object literals within scripts as rows: the pattern's first group is JSON of the schema."""
    scripts = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), F.lit(1))
    found = df.select(*keys, F.explode(F.flatten(F.transform(scripts, lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(1))))).alias("__json"))
    return found.select(*keys, F.from_json("__json", schema).alias("x")).filter("x is not null").select(*keys, "x.*")


def supplemented(rows: DataFrame, details: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """List rows whose empty fields are filled from their detail pages."""
    named = details.groupBy(key).agg(*[F.max(c).alias(f"__{c}") for c in columns])
    return rows.join(named, key, "left").select(*[F.coalesce(F.nullif(blank(F.col(c)), F.lit("")), F.col(f"__{c}"), F.lit("")).alias(c) if c in columns else F.col(c) for c in rows.columns])


def article_class(title: Column, text: Column, category: Column) -> Column:
    """One of nine classes of articles, by the first rule that holds."""
    head, t = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.concat_ws("\n", title, text))
    count = lambda words: sum((t.contains(w).cast("int") for w in words), F.lit(0))
    lottery, reservation, again = count(LOTTERY_WORDS) >= 2, count(RESERVATION_WORDS) >= 2, t.contains(AGAIN)
    return first_match(
        [
            ("excluded", t.rlike(TRADE)),
            ("event", head.rlike(MEETING) & ~t.rlike(SALES_WORDS)),
            ("resale", (lottery | reservation) & again),
            ("lottery", lottery),
            ("reservation", reservation),
            ("general_news", (category == "unknown") & t.rlike("臨時休業|営業時間|移転|重要なお知らせ")),
            ("excluded", category == "unknown"),
            ("resale", again & t.rlike("発売日|新品|対象商品")),
            ("regular_sale", t.rlike("新品販売|通常販売|店頭販売|一般販売") & t.rlike("発売日|税込|新品")),
            ("product_info", t.contains("発売日") & t.rlike("税込|対象商品|商品名")),
            ("event", t.rlike("大会|イベント|交流会|エントリー")),
            ("general_news", t.rlike("お知らせ|更新|入荷")),
        ],
        "needs_review",
    )


def segment_period(text: Column) -> Column:
    """Struct of start and end of a labelled part of a text; a part that begins with a tilde tells an end only."""
    part = F.regexp_extract(text, rf"(?s)(?:{PERIOD_LABELS})\s*[:：](.*?)(?={PERIOD_STOPS}|$)", 1)
    date = r"(20\d{2})年\s*(\d{1,2})月\s*(\d{1,2})日(?:[^0-9]{0,12}(\d{1,2}):(\d{2}))?"
    found = F.regexp_extract_all(part, F.lit(r"20\d{2}年\s*\d{1,2}月\s*\d{1,2}日(?:[^0-9]{0,12}\d{1,2}:\d{2})?"), F.lit(0))

    def at(value: Column) -> Column:
        y, m, d, hour, minute = (F.nullif(F.regexp_extract(value, date, i), F.lit("")).cast("int") for i in range(1, 6))
        return F.try_make_timestamp_ntz(y, m, d, F.coalesce(hour, F.lit(0)), F.coalesce(minute, F.lit(0)), F.lit(0))

    valid = F.array_compact(F.transform(found, at))
    open_start = F.ltrim(part).rlike("^[～〜~]")
    return F.struct(F.when(~open_start, F.try_element_at(valid, F.lit(1))).alias("start"), F.try_element_at(valid, F.when(open_start, 1).otherwise(2)).alias("end"))


def article_record(title: Column, text: Column, category: Column, url: Column) -> Column:
    """An article as one record: id, class, product, period as told and as start and end, conditions, stock, prices; null for classes that are left out.

    Articles that trade, and those of no wanted class, give no record.
    """
    kind = article_class(title, text, category)
    span = segment_period(text)
    product = extract.labelled_value(text, ("商品名", "対象商品"))
    record = F.struct(
        F.concat(F.lit("article_"), F.substring(F.sha2(F.concat_ws("|", url, F.coalesce(title, F.lit(""))), 256), 1, 20)).alias("article_id"), kind.alias("class"), F.when(product != "", product).otherwise(F.trim(F.coalesce(title, F.lit("")))).alias("product"),
        extract.labelled_value(text, ("応募期間", "抽選期間", "受付期間")).alias("period"), span["start"].alias("start"), span["end"].alias("end"), extract.condition_labels(text).alias("conditions"), extract.stock(text).alias("stock"), extract.highest_price(text).alias("highest"), extract.first_price(text).alias("first"),
    )
    return F.when(~kind.isin("excluded", "needs_review"), record)
