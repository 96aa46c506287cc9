"""Time functions. ``now`` is always an argument, never the clock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end of two timestamps without zone."""
    return F.expr("0L") + F.timestamp_diff("SECOND", start, end)


def local_time(text: Column, offset_hours: int = 9) -> Column:
    """ISO text as a zone-free local time; naive text is local already, bad text is null."""
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    utc = F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone())
    return F.when(zoned, (utc + F.make_interval(hours=F.lit(offset_hours))).cast("timestamp_ntz")).otherwise(text.try_cast("timestamp_ntz"))


def date_of(year: Column, month: Column, day: Column) -> Column:
    """A date, null where the calendar has none."""
    return F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def deadline_state(end: Column, now: Column, ended: Column | None = None, soon_hours: int = 72) -> Column:
    """expired, today, within_24h, within_72h, normal or unknown; the day is tested before the hours."""
    left = seconds_between(now, end)
    return (
        F.when(F.coalesce(ended, F.lit(False)) if ended is not None else F.lit(False), "expired")
        .when(end.isNull(), "unknown")
        .when(left < 0, "expired")
        .when(end.cast("date") == now.cast("date"), "today")
        .when(left <= 24 * 3600, "within_24h")
        .when(left <= soon_hours * 3600, f"within_{soon_hours}h")
        .otherwise("normal")
    )


def is_new(at: Column, now: Column, days: int) -> Column:
    """Not in the future and at most so many days old, both ends included."""
    return F.coalesce(seconds_between(at, now).between(0, days * 86400), F.lit(False))


def retained(end: Column, now: Column, days: int = 14) -> Column:
    """Ended at most so many days ago; a missing end stays."""
    return end.isNull() | (seconds_between(end, now) <= days * 86400)


def period_state(start: Column, end: Column, now: Column, explicit_end: Column, open_word: Column) -> Column:
    """ended, upcoming, open, today or unknown; a stated end comes before all dates."""
    return (
        F.when(explicit_end, "ended")
        .when(end.isNotNull() & (now > end), "ended")
        .when(start.isNotNull() & (now < start), "upcoming")
        .when(end.isNull(), F.coalesce(open_word, F.when(start.isNotNull(), "open").otherwise("unknown")))
        .when(end.cast("date") == now.cast("date"), "today")
        .otherwise("open")
    )


def remaining_text(start: Column, end: Column, ended: Column, now: Column) -> Column:
    """What is left of a period in words: over, when it starts, unknown, the hour of its last day, hours, or days."""
    seconds = F.timestamp_diff("SECOND", now, end)
    return (
        F.when(ended | F.coalesce(now > end, F.lit(False)), "受付終了")
        .when(start.isNotNull() & (now < start), F.concat(F.date_format(start, "MM/dd HH:mm"), F.lit("受付開始")))
        .when(end.isNull(), "締切日時不明")
        .when(end.cast("date") == now.cast("date"), F.concat(F.lit("本日"), F.date_format(end, "HH:mm"), F.lit("締切")))
        .when(seconds < 86400, F.concat(F.lit("あと"), F.greatest(F.lit(1), F.floor(seconds / 3600)).cast("string"), F.lit("時間")))
        .otherwise(F.concat(F.lit("あと"), F.greatest(F.lit(1), F.floor(seconds / 86400)).cast("string"), F.lit("日")))
    )


def remaining(minutes: Column) -> Column:
    """Minutes as days, hours and minutes."""
    return (
        F.when(minutes >= 1440, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))
        .when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.greatest(minutes, F.lit(0)).cast("string"), F.lit("m")))
    )


def inferred_year(month: Column, day: Column, today: Column, release: Column) -> Column:
    """The year of last, this, next and the release's that puts month and day nearest to the release, else to today; ties go to the smaller, and none fits 30 February.

    Dates over 120 days after or 400 before a release, and dates over 120 days
    past without one, count as farther.
    """
    years = F.array_distinct(F.array_compact(F.array(F.year(today) - 1, F.year(today), F.year(today) + 1, F.year(release))))

    def option(y: Column) -> Column:
        date = date_of(y, month, day)
        off = F.date_diff(date, release)
        far = F.when(release.isNotNull(), F.abs(off) + F.when((off > 120) | (off < -400), 1000).otherwise(0)).otherwise(F.abs(F.date_diff(date, today)) + F.when(F.date_diff(today, date) > 120, 365).otherwise(0))
        return F.struct(far.alias("far"), y.alias("year"))

    return F.array_min(F.filter(F.transform(years, option), lambda o: o["far"].isNotNull()))["year"]


def rolled_forward(date: Column, today: Column, days: int = 120) -> Column:
    """A date without a year that lies long past belongs to next year."""
    return F.when(F.date_diff(today, date) > days, F.add_months(date, 12)).otherwise(date)


def dates_in(text: Column) -> Column:
    """All valid year-month-day dates of a text, distinct and sorted."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})"), F.lit(1))
    part = lambda d, i: F.element_at(F.split(d, "[-/.]"), i).cast("int")
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda d: date_of(part(d, 1), part(d, 2), part(d, 3))))))


# A date with its year, and one without, which counts only where none has a year.
YEAR_DATE, DAY_DATE = r"(\d{4})[./年-]\s*(\d{1,2})[./月-]\s*(\d{1,2})日?", r"(\d{1,2})[./月]\s*(\d{1,2})日?"


def text_dates(text: Column, today: Column) -> Column:
    """All valid dates of a text, distinct and sorted; dates without a year count if none has one, and those over 120 days past are next year's."""

    def found(pattern: str, day: Callable[[Column], Column]) -> Column:
        return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), day))))

    def part(d: Column, pattern: str, i: int) -> Column:
        return F.regexp_extract(d, pattern, i).cast("int")

    def this_or_next(d: Column) -> Column:
        month, day = part(d, DAY_DATE, 1), part(d, DAY_DATE, 2)
        date = date_of(F.year(today), month, day)
        return F.when(F.date_diff(today, date) > 120, date_of(F.year(today) + 1, month, day)).otherwise(date)

    whole = found(YEAR_DATE, lambda d: date_of(*[part(d, YEAR_DATE, i) for i in (1, 2, 3)]))
    return F.when(F.size(whole) > 0, whole).otherwise(found(DAY_DATE, this_or_next))
