"""Application periods in free Japanese text, and the states that follow from them.

All are column expressions. Dates are read by patterns whose groups are handed to
``try_make_timestamp``, so what the calendar does not have is null. Times are local
and without zone; ``now`` is always an argument.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreef.functions.text import blank
from tallyreef.functions.times import date_of, inferred_year

# Words of lines that may tell a period.
PERIOD_WORDS = ("応募", "抽選", "予約", "受付", "申込", "申し込み", "締切", "結果発表", "当選発表")
MOST_LINES = 80
DATE = r"(?:(20\d{2})年\s*)?(\d{1,2})月\s*(\d{1,2})日(?:\s*[（(][^）)]*[）)])?(?:\s*(\d{1,2}):(\d{2}))?"
RANGE = rf"{DATE}\s*(?:から|～|〜|~|－|―|-)\s*{DATE}"
END_LABEL = r"(?:応募|抽選|予約|申込|受付)?\s*(?:締切|終了)(?:日時)?|(?:応募|抽選|予約|申込|受付)[^。\n]{0,16}?まで"
START_LABEL = r"(?:応募|抽選|予約|申込|受付)(?:開始|開始日時|開始日|受付開始)"
RESULT_LABEL = r"(?:結果発表予定|抽選結果発表|結果発表|当選発表)(?:日時|日)?"
UNSETTLED = r"(?:受付|応募|申込)期間\s*[:：]?\s*未定"
# Labels of conditions and stores, and ways to apply in order of precedence.
CONDITION_LABELS = ("応募条件", "申込条件", "受付条件")
STORE_LABELS = ("対象店舗", "受付店舗", "実施店舗")
METHODS = ((r"アプリ", "アプリ受付"), (r"店頭", "店頭受付"), (r"抽選", "抽選"), (r"予約", "予約"), (r"先着", "先着"))
# Statuses that say a period is over, and how sentences say so.
END_STATUSES = ("終了済み", "受付終了", "応募終了", "予約終了", "抽選終了", "販売終了", "closed", "ended", "expired", "中止", "キャンセル", "受付中止", "抽選中止", "予約中止")
PLANNED_END = r"終了(?:する)?(?:予定|見込|見込み|予告)"
END_PHRASE = r"(?:応募受付|申込受付|申し込み受付|受付|応募|予約|抽選(?:販売)?|販売)(?:は|が|を)?(?:終了済み|終了しました|終了いたしました|終了しております|終了しています|終了となりました|終了となっています)"
# Fixed value: the label under which a stored end is read again.
STORED_LABEL = "応募締切"
#: A period's end that no time is told for, and the seconds of one that is.
LAST = (23, 59, 59)


def unified(text: Column) -> Column:
    """One notation of dates and times: ``2026年7月18日``, ``7月18日``, ``9:05``; runs of blanks as one."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\d)：(?=\d)", ":")
    text = F.regexp_replace(text, r"(\d{1,2})時\s*(\d)分", "$1:0$2")
    text = F.regexp_replace(text, r"(\d{1,2})時\s*(\d{2})分", "$1:$2")
    weekday = r"(?:\s*[（(][^）)]*[）)])?"
    text = F.regexp_replace(text, rf"(20\d{{2}})(?:年|[./-])(\d{{1,2}})[./-](\d{{1,2}}){weekday}", "$1年$2月$3日")
    text = F.regexp_replace(text, rf"(\d{{1,2}})[./-](\d{{1,2}}){weekday}", "$1月$2日")
    return F.regexp_replace(text, r"[\t\r ]+", " ")


def period_lines(text: Column) -> Column:
    """Trimmed lines that hold a period word, the first MOST_LINES."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))  # noqa: PLW0108
    return F.array_join(F.slice(F.filter(lines, lambda x: x.rlike("|".join(PERIOD_WORDS))), 1, MOST_LINES), "\n")


def moment(parts: list[Column], today: Column, release: Column, end: bool) -> Column:
    """A time from matched year, month, day, hour and minute; a missing year is inferred, a missing time is the day's first or last second."""
    year, month, day, hour, minute = (F.nullif(p, F.lit("")).cast("int") for p in parts)
    year = F.coalesce(year, inferred_year(month, day, today, release))
    if end:
        hour, minute, second = F.coalesce(hour, F.lit(LAST[0])), F.when(hour.isNull(), LAST[1]).otherwise(F.coalesce(minute, F.lit(0))), F.lit(LAST[2])
    else:
        hour, minute, second = F.coalesce(hour, F.lit(0)), F.coalesce(minute, F.lit(0)), F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, hour, minute, second)


def _groups(text: Column, pattern: str, first: int, n: int = 5) -> list[Column]:
    return [F.regexp_extract(text, pattern, first + i) for i in range(n)]


def _once(text: Column, pattern: str, n: int, make: Callable[[list[Column]], Column]) -> Column:
    """make of the first match's n groups as numbers, null where empty; the text is searched once, however often make reads them."""
    found = F.regexp_extract(text, pattern, 0)
    groups = F.split(F.regexp_replace(found, f"^(?:{pattern})$", "\u0001".join(f"${i}" for i in range(1, n + 1))), "\u0001")
    # A match is bound to a variable, so that it is not worked out anew for each group.
    return F.get(F.transform(F.array(groups), lambda g: make([F.when(F.size(g) == n, F.nullif(F.get(g, F.lit(i)), F.lit(""))).cast("int") for i in range(n)])), F.lit(0))


def _labelled(text: Column, label: str) -> tuple[list[Column], Column]:
    """Groups of the first date after a label, else of one before it, and whether there is any."""
    after = rf"(?:{label})\s*[:：]?\s*(?:は\s*)?{DATE}"
    before = rf"{DATE}\s*(?:まで)?[^。\n]{{0,12}}(?:{label})"
    is_after = text.rlike(after)
    parts = [F.when(is_after, a).otherwise(b) for a, b in zip(_groups(text, after, 1), _groups(text, before, 1), strict=True)]
    return parts, is_after | text.rlike(before)


def label_value(text: Column, labels: tuple[str, ...]) -> Column:
    """What follows the first label that is there, up to the end of the sentence; empty if none is."""
    chain = F
    for label in labels:
        found = F.regexp_extract(text, rf"{label}\s*[:：]?\s*([^\n。]{{2,200}})", 1)
        chain = chain.when(found != "", F.substring(F.trim(F.regexp_replace(found, r"\s+", " ")), 1, 300))
    return chain.otherwise("")


def method(text: Column) -> Column:
    chain = F
    for word, name in METHODS:
        chain = chain.when(text.contains(word), name)
    return chain.otherwise("")


def with_period(df: DataFrame, text: Column, now: Column, release: Column, name: str = "period") -> DataFrame:
    """df with a struct of start, end, result, method, conditions, store, unsettled and end_timed (the end's time is told), from free text.

    Lines, matched parts and times are columns of their own on the way, so that
    each is worked out once however often the next step reads it.
    """
    lines, today = F.col("__lines"), now.cast("date")
    found = df.withColumn("__lines", period_lines(unified(text)))
    parts = {"first": (_groups(lines, RANGE, 1), lines.rlike(RANGE)), "second": (_groups(lines, RANGE, 6), F.lit(True))} | {n: _labelled(lines, label) for n, label in (("end", END_LABEL), ("start", START_LABEL), ("result", RESULT_LABEL))}
    found = found.withColumn("__parts", F.struct(*[F.array(*groups, F.when(there, "x").otherwise("")).alias(n) for n, (groups, there) in parts.items()]))
    part = lambda n: [F.col(f"__parts.{n}")[i] for i in range(6)]
    told = {n: F.when(part(n)[5] != "", moment(part(n)[:5], today, release, n in ("second", "end", "result"))).alias(n) for n in parts}
    found = found.withColumn("__at", F.struct(*told.values()))
    start, end = F.col("__at.first"), F.col("__at.second")
    next_year = F.try_make_timestamp_ntz(F.year(end) + 1, F.month(end), F.dayofmonth(end), F.hour(end), F.minute(end), F.second(end).cast("int"))
    found = found.withColumn("__end", F.when((end < start) & (part("second")[0] == ""), next_year).otherwise(end))
    whole = (part("first")[5] != "") & start.isNotNull() & F.col("__end").isNotNull()
    out = F.struct(
        F.when(whole, start).otherwise(F.col("__at.start")).alias("start"),
        F.when(whole, F.col("__end")).otherwise(F.col("__at.end")).alias("end"),
        F.col("__at.result").alias("result"),
        method(lines).alias("method"),
        label_value(lines, CONDITION_LABELS).alias("conditions"),
        label_value(lines, STORE_LABELS).alias("store"),
        lines.rlike(UNSETTLED).alias("unsettled"),
        F.when(whole, part("second")[3] != "").otherwise(F.col("__at.end").isNotNull() & (part("end")[3] != "")).alias("end_timed"),
    )
    return found.withColumn(name, out).drop("__lines", "__parts", "__at", "__end")


def _timed(stored_end: Column) -> Column:
    """Whether a stored end is a time that counts as it stands."""
    return F.coalesce(stored_end.rlike(r"(?:T|\s)\d{1,2}(?::|時)\d{0,2}") & stored_end.try_cast("timestamp_ntz").isNotNull(), F.lit(False))


def overlay_text(text: Column, stored_end: Column) -> Column:
    """The text to read a period from: a stored end without a time stands as a deadline after what is told."""
    stored = blank(stored_end)
    told = F.coalesce(text, F.lit(""))
    return F.when(_timed(stored_end) | (stored == ""), told).otherwise(F.concat(told, F.lit(f"\n{STORED_LABEL} "), stored))


def overlaid(stored_end: Column, found: Column) -> tuple[Column, Column]:
    """End and whether its time is told, from the period of ``overlay_text``: a stored end with a time is never overwritten."""
    kept = _timed(stored_end)
    return F.when(kept, stored_end.try_cast("timestamp_ntz")).otherwise(found["end"]), kept | F.coalesce(found["end_timed"], F.lit(False))


def ended_status(status: Column) -> Column:
    """A status says that the period is over; a planned end does not."""
    text = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    bare = F.regexp_replace(text, r"^[※*＊・:：\-\s]+|[。.!！\s]+$", "")
    return (text != "") & ~text.rlike(PLANNED_END) & (bare.isin(*END_STATUSES) | bare.rlike(END_PHRASE))


def explicit_end(flags: dict[str, Column], statuses: dict[str, Column]) -> Column:
    """Name of the first flag or status field that says the period is over; statuses are arrays, the newest last or not; empty if none does."""
    chain = F
    for name, flag in flags.items():
        chain = chain.when(F.coalesce(flag, F.lit(False)), f"{name}=true")
    for name, values in statuses.items():
        said = F.filter(F.coalesce(values, F.array().cast("array<string>")), ended_status)
        chain = chain.when(F.size(said) > 0, F.concat(F.lit(f"{name}="), F.try_element_at(said, F.lit(1))))
    return chain.otherwise("")


def open_status(status: Column) -> Column:
    """``before`` or ``open`` where a status says so, else null."""
    text = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(text.rlike("受付前|受付予定|開始前"), "before").when(text.rlike("受付中|応募中|予約受付中|抽選受付中"), "open")


def loose_time(text: Column) -> Column:
    """An ISO time, else a date in one of three notations among the first ten characters; null if neither."""
    start = F.substring(F.trim(text), 1, 10)
    parts = [F.regexp_extract(start, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", i).try_cast("int") for i in (1, 2, 3)]
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}.*)?\s*$"), F.trim(text).try_cast("timestamp_ntz"))
    return F.coalesce(iso, date_of(*parts).cast("timestamp_ntz"))


def first_and_last(text: Column, year: Column) -> Column:
    """Struct of the first and last date of a text: years by the first that is told, else by the argument; an end without a time is 23:59."""
    pattern = F.lit(r"(?:20\d{2}\s*年\s*)?\d{1,2}\s*月\s*\d{1,2}\s*日(?:\([^)]*\))?\s*(?:\d{1,2}\s*[：:]\s*\d{2})?")
    groups = r"(?:(20\d{2})\s*年\s*)?(\d{1,2})\s*月\s*(\d{1,2})\s*日(?:\([^)]*\))?\s*(?:(\d{1,2})\s*[：:]\s*(\d{2}))?"
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    told = F.coalesce(F.nullif(F.regexp_extract(text, r"(20\d{2})\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日", 1), F.lit("")).cast("int"), year)

    def at(value: Column, end: bool) -> Column:
        return _once(value, groups, 5, lambda p: F.try_make_timestamp_ntz(F.coalesce(p[0], told), p[1], p[2], F.coalesce(p[3], F.lit(23 if end else 0)), F.coalesce(p[4], F.lit(59 if end else 0)), F.lit(0)))

    return F.struct(at(F.try_element_at(found, F.lit(1)), False).alias("start"), at(F.try_element_at(found, F.lit(-1)), True).alias("end"))


def release_date(text: Column, year: Column) -> Column:
    """A release date by the first pattern that gives a valid one."""
    patterns = (r"発売日\s*[：:]\s*(20\d{2})年(\d{1,2})月(\d{1,2})日", r"(20\d{2})年(\d{1,2})月(\d{1,2})日(?:\([^)]*\))?\s*発売")
    dates = [_once(text, p, 3, lambda x: date_of(*x)) for p in patterns]
    short = r"[【〖<＜](\d{1,2})月(\d{1,2})日発売[】〗>＞]"
    return F.coalesce(*dates, _once(text, short, 2, lambda x: date_of(year, *x)))


def labelled_dates(text: Column, reference: Column) -> Column:
    """Struct of start, end and result by their labels; else a period without years, carried into the next one; else ``until`` a time of the reference day."""
    fragment = r"(20\d{2})\s*[年/]\s*(\d{1,2})\s*[月/]\s*(\d{1,2})\s*日?\s*(?:\([^)]*\))?\s*(\d{1,2})\s*[:時]\s*(\d{0,2})"

    def by_label(label: str) -> Column:
        return _once(text, rf"(?:{label})\s*[:：]?\s*{fragment}", 5, lambda p: F.try_make_timestamp_ntz(*p[:4], F.coalesce(p[4], F.lit(0)), F.lit(0)))

    side = r"(?:(20\d{2})年)?\s*(\d{1,2})月(\d{1,2})日(?:\([^)]*\))?\s*(\d{1,2})[:時](\d{2})?"
    ranged = rf"(?:応募|申込|予約)(?:受付)?期間\s*[:：]?\s*{side}\s*[~～〜-]\s*{side}"
    parts = [F.nullif(F.regexp_extract(text, ranged, i), F.lit("")).cast("int") for i in range(1, 11)]
    start_year = F.coalesce(parts[0], F.year(reference))
    make = lambda y, i: F.try_make_timestamp_ntz(y, parts[i], parts[i + 1], parts[i + 2], F.coalesce(parts[i + 3], F.lit(0)), F.lit(0))
    start, end = make(start_year, 1), make(F.coalesce(parts[5], start_year), 6)
    end = F.when((end < start) & parts[5].isNull(), make(start_year + 1, 6)).otherwise(end)
    both = start.isNotNull() & end.isNotNull()
    until = [F.nullif(F.regexp_extract(text, r"当日\s*(\d{1,2})時(?:\s*(\d{1,2})分)?まで", i), F.lit("")).cast("int") for i in (1, 2)]
    same_day = F.try_make_timestamp_ntz(F.year(reference), F.month(reference), F.dayofmonth(reference), until[0], F.coalesce(until[1], F.lit(0)), F.lit(0))
    return F.struct(
        F.coalesce(by_label("(?:申込|申し込み|応募|予約)(?:受付)?開始"), F.when(both, start)).alias("start"),
        F.coalesce(by_label("(?:申込|申し込み|応募|予約)(?:受付)?終了|締切"), F.when(both, end), same_day).alias("end"),
        by_label("当選発表|結果発表").alias("result"),
    )


def post_dates(text: Column, year: Column) -> Column:
    """Struct of start and end: the first and second valid date of a post, years missing by the argument."""
    found = F.regexp_extract_all(text, F.lit(r"(?:20\d{2}年)?\s*\d{1,2}月\s*\d{1,2}日(?:\s*\d{1,2}[:時](?:\d{2})?分?)?"), F.lit(0))
    groups = r"(?:(20\d{2})年)?\s*(\d{1,2})月\s*(\d{1,2})日(?:\s*(\d{1,2})[:時](\d{2})?分?)?"

    def at(value: Column) -> Column:
        return _once(value, groups, 5, lambda p: F.try_make_timestamp_ntz(F.coalesce(p[0], year), p[1], p[2], F.coalesce(p[3], F.lit(0)), F.coalesce(p[4], F.lit(0)), F.lit(0)))

    valid = F.array_compact(F.transform(found, at))
    return F.struct(F.try_element_at(valid, F.lit(1)).alias("start"), F.try_element_at(valid, F.lit(2)).alias("end"))


def due(text: Column, today: Column) -> Column:
    """The first month and day of a text, of the year told or this one, is today or past; false without a valid one."""
    pattern = r"(?:(\d{4})[./年])?\s*(\d{1,2})[./月]\s*(\d{1,2})日?"
    return F.coalesce(_once(text, pattern, 3, lambda p: today >= date_of(F.coalesce(p[0], F.year(today)), p[1], p[2])), F.lit(False))


def temporal_state(ended: Column, start: Column, now: Column) -> Column:
    return F.when(ended, "EXPIRED").when(F.coalesce(now < start, F.lit(False)), "UPCOMING").otherwise("ACTIVE")


def dashboard_state(application: Column, result: Column, ended: Column, today: Column) -> Column:
    """Win and loss before an end, an end before all else; what is not applied for may end today."""
    return (
        F.when((application == "当選") | (result == "当選"), "当選")
        .when((application == "落選") | (result == "落選"), "落選")
        .when(F.coalesce(ended, F.lit(False)), "終了済み")
        .when(application == "未応募", F.when(F.coalesce(today, F.lit(False)), "本日締切").otherwise("未応募"))
        .when(application == "抽選結果待ち", "結果待ち")
        .otherwise("応募済み")
    )


def application_state(result: Column, applied: Column, result_due: Column) -> Column:
    """A final result as it is, else by the applied flag and whether the result is due."""
    final = ("当選", "落選", "予約完了", "注文受付", "キャンセル", "その他")
    return F.when(result.isin(*final), result).when(~F.coalesce(applied, F.lit(False)), "未応募").when(result_due, "抽選結果確認").otherwise("抽選受付完了")


def display_state(state: Column) -> Column:
    """Inner states as they are shown; unknown ones as others."""
    shown = ("未応募", "応募済み", "抽選結果待ち", "当選", "落選", "予約完了", "注文受付", "キャンセル", "その他")
    return F.when(state == "抽選受付完了", "応募済み").when(state.isin("抽選結果確認", "結果待ち候補"), "抽選結果待ち").when(state.isin(*shown), state).otherwise("その他")


def blank_or(column: Column, value: str) -> Column:
    return F.coalesce(F.nullif(blank(column), F.lit("")), F.lit(value))
