"""Filters, sorts, set operations, unpivoting and unions of tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyreef.operators.windows import ranked

#: Sorts after every ISO date.
NO_DATE = "9999-99-99"


def snapshot(df: DataFrame, **wanted) -> DataFrame:
    """Conjunction of filters; None or "all" means no filter, a list means membership, a Column is a condition."""
    for name, value in wanted.items():
        if value is None or isinstance(value, str) and value == "all" or isinstance(value, (list, tuple)) and not value:
            continue
        if isinstance(value, Column):
            df = df.filter(value)
        elif isinstance(value, (list, tuple, set)):
            df = df.filter(F.col(name).isin(*value))
        else:
            df = df.filter(F.col(name) == value)
    return df


def any_state(state: str, *columns: str) -> Column:
    """The state is that of any of several columns."""
    return F.lit(True) if state == "all" else F.array_contains(F.array(*columns), state)


def keyword(word: str, *columns: str) -> Column:
    """Every term occurs, in any case and without wildcards, in the joined columns."""
    joined = F.lower(F.concat_ws(" ", *columns))
    held = F.lit(True)
    for term in word.lower().split():
        held = held & joined.contains(term)
    return held


def channel(mode: Column, wanted: str) -> Column:
    """Mixed rows belong to both channels, unknown ones to all only."""
    return {"online": mode.isin("ONLINE", "HYBRID"), "store": mode.isin("STORE", "HYBRID")}.get(wanted, F.lit(wanted == "all"))


def not_refused(confirmed: Column) -> Column:
    """Missing confirmation counts as given; only an explicit no excludes."""
    return ~confirmed.eqNullSafe(F.lit(False))


def wanted_by(preferences: Column, values: Column) -> Column:
    """An empty list of preferences is no constraint."""
    return F.when(F.size(preferences) == 0, True).otherwise(F.arrays_overlap(preferences, values))


def first_failing(checks: Sequence[tuple[str, Column]], passed: str = "eligible") -> Column:
    """Name of the first check that fails."""
    chain = F
    for name, holds in checks:
        chain = chain.when(~F.coalesce(holds, F.lit(False)), name)
    return chain.otherwise(passed)


def due(last: Column, now: Column, seconds: int) -> Column:
    """Never done, or that long ago; five minutes at least."""
    return last.isNull() | (F.timestamp_diff("SECOND", last, now) >= max(300, seconds))


def dated(column: Column) -> Column:
    return F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit(NO_DATE))


def rank_of(column: Column, order: Sequence[str], unknown: int = 9) -> Column:
    """Place of a state in a list; unknown ones last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), column), F.lit(0)), F.lit(unknown))


def unpivoted(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "event_type", value: str = "starts_at") -> DataFrame:
    """A row for each date that is there."""
    return df.unpivot(list(ids), list(columns), name, value).filter(F.col(value).isNotNull())


def task_union(tasks: Sequence[tuple[int, str, DataFrame]]) -> DataFrame:
    """Rows of several task tables with their priority and kind."""
    out = None
    for priority, kind, rows in tasks:
        rows = rows.withColumn("priority", F.lit(priority)).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def reminder(minutes: Column, offsets: Sequence[int]) -> Column:
    """Smallest offset that is not yet passed; null if it is too early or too late."""
    return F.when(minutes >= 0, F.array_min(F.filter(F.array(*[F.lit(o).cast("long") for o in offsets]), lambda o: minutes <= o)))


def search(groups: Sequence[tuple[str, DataFrame]], terms: str, most: int = 20) -> DataFrame:
    """Rows (id, title, body) of several tables that hold all terms, the first of each group."""
    out = None
    for name, rows in groups:
        held = rows.filter(keyword(terms, "title", "body")).select(F.lit(name).alias("result_group"), F.col("id").cast("long").alias("id"), "title")
        out = held if out is None else out.unionByName(held)
    return ranked(out, ["result_group"], [F.col("id"), F.col("title")], most)


def union_distinct(a: Column, b: Column) -> Column:
    """Union of two arrays, sorted; null counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))


def page_gaps(df: DataFrame, key: str, page: str) -> DataFrame:
    """key, first, last: the ranges of pages from 1 to the key's highest that were not seen."""
    seen = df.filter(F.col(page) >= 1).select(key, page).distinct()
    before = F.coalesce(F.lag(page).over(Window.partitionBy(key).orderBy(page)), F.lit(0))
    return seen.select(key, (before + 1).alias("first"), (F.col(page) - 1).alias("last")).filter("first <= last")


def expanded(df: DataFrame, keys: Sequence[str], items: str, name: str) -> DataFrame:
    """A row for each distinct item; a row without items stays with a null."""
    return df.withColumn(name, F.explode_outer(F.array_sort(F.array_distinct(items)))).drop(items)


# Kinds of products that a category releases, words of supplies and of cards, and words of pages that release nothing.
RELEASE_KINDS = {
    "onepiece": ("ブースターパック", "エクストラブースター", "スタートデッキ", "プレミアムカードコレクション", "プレミアム商品", "その他"),
    "gundam": ("ブースターパック", "スタートデッキ", "プレミアムバンダイ", "その他"),
    "union_arena": ("ブースターパック", "スタートデッキ", "構築済みデッキ", "プレミアム商品", "その他カード商品"),
    "dragon_ball_fusion_world": ("ブースターパック", "スタートデッキ", "プレミアム商品", "その他カード商品"),
}
SUPPLIES, CARDS, NO_RELEASE = "スリーブ|プレイマット|ケース|アクセサリー|sleeve|playmat|case", "カード|セット|コレクション|card|set|collection", "cardlist|event|rule|カードリスト|イベント|ルール"
UNDATED_ALLOWED = ("onepiece", "union_arena", "dragon_ball_fusion_world")
#: Days after a release that a product still counts as new and before it that it already does, and after which it is archived.
NEW_AFTER, NEW_BEFORE, ARCHIVED_AFTER = 45, 730, 183


def new_release(category: Column, kind: Column, name: Column, release: Column, official: Column, url: Column, today: Column) -> Column:
    """A product that may be released soon or just was; categories without a list take any that has a name."""
    listed = F.lit(False)
    for key, kinds in RELEASE_KINDS.items():
        listed = listed | ((category == key) & kind.isin(*kinds))
    low = F.lower(name)
    fits = (kind != "その他") | (~low.rlike(SUPPLIES) & low.rlike(CARDS))
    date = release.try_cast("date")
    age = F.date_diff(today, date)
    dated = F.when(F.coalesce(release, F.lit("")) == "", category.isin(*UNDATED_ALLOWED) & F.coalesce(official, F.lit(False))).otherwise(F.coalesce((age <= NEW_AFTER) & (age >= -NEW_BEFORE), F.lit(False)))
    plain = ~F.lower(F.concat_ws(" ", name, url)).rlike(NO_RELEASE)
    return F.when(~category.isin(*RELEASE_KINDS), F.trim(name) != "").otherwise(listed & fits & dated & url.startswith("https://") & plain)


def not_archived(release: Column, today: Column) -> Column:
    """Released at most ARCHIVED_AFTER days ago; what is no date stays."""
    return F.coalesce(F.date_diff(today, release.try_cast("date")) <= ARCHIVED_AFTER, F.lit(True))


def in_category(keys: Column, wanted: str) -> Column:
    """The wanted key is among a row's; "all" is any."""
    return F.lit(True) if wanted == "all" else F.array_contains(keys, wanted)


def same_span(date: Column, day: Column, span: str) -> Column:
    """In the month, or in the week from Monday on, of a day."""
    return F.date_trunc(span, date.cast("timestamp_ntz")) == F.date_trunc(span, day.cast("timestamp_ntz"))


def first_failing_counts(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """How many rows fail each check first, and how many none."""
    return df.groupBy(first_failing(checks).alias("reason")).agg(F.count("*").alias("n"))


def rotated(df: DataFrame, keys: Sequence[str], order: Sequence[Column], index: Column) -> DataFrame:
    """The row of each key that is next in turn: the one at the stored index modulo the rows of the key."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("__n", F.count("*").over(w)).withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1)
    return placed.filter(F.col("__i") == F.pmod(index, F.col("__n"))).drop("__n", "__i")
