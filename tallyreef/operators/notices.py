"""Events and reminders of applications, made from rows and told once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreef.functions.text import blank, first_filled
from tallyreef.operators.shapes import not_refused, reminder

# Results after which nothing is told, and verifications that block.
FINAL_RESULTS = ("当選", "落選", "予約完了", "注文受付", "キャンセル")
BLOCKED = ("candidate", "pending", "confirming", "確認中", "rejected")
NOT_APPLIED, UNCHECKED = "未応募", "未確認"
# Types of events by their words, in order of precedence.
EVENT_WORDS = (("RESTOCK", "再販|再入荷|RESTOCK"), ("SALE_START", "販売開始"), ("RESERVATION_START", "予約"), ("APPLICATION_START", "抽選|応募|受付開始"))
#: Hours that an event stays fresh, and sent keys that are kept.
RECENT_HOURS, MOST_SENT = 48, 5000


def confirmed(verification: Column, of_site: Column, of_product: Column) -> Column:
    """No verification blocks and nobody said no; what is missing counts as given."""
    said = F.lower(F.coalesce(F.trim(verification), F.lit("confirmed")))
    return ~said.isin(*BLOCKED) & not_refused(of_site) & not_refused(of_product)


def suppressed(result: Column, application: Column, after_applied: bool = True) -> Column:
    """A final result, or, if wished, any application."""
    done = F.coalesce(result, F.lit(UNCHECKED)).isin(*FINAL_RESULTS)
    return done | (F.coalesce(application, F.lit(NOT_APPLIED)) != NOT_APPLIED) if after_applied else done


def sales_mode_wanted(mode: Column, wanted: Sequence[str]) -> Column:
    """An empty list wants all; a mixed mode serves either of its two."""
    if not wanted:
        return F.lit(True)
    return mode.isin(*wanted) | ((mode == "HYBRID") & F.lit(bool({"ONLINE", "STORE"} & set(wanted))))


def event_type(text: Column) -> Column:
    chain = F
    for name, words in EVENT_WORDS:
        chain = chain.when(F.coalesce(text, F.lit("")).rlike(words), name)
    return chain.otherwise("NEW_CONFIRMED")


def event_time(*columns: Column) -> Column:
    """The first of some times that can be read."""
    return F.coalesce(*[c.try_cast("timestamp_ntz") for c in columns])


def application_id(explicit: Column, product: Column, site: Column, url: Column) -> Column:
    """An explicit id, else 24 digits of the hash of product, site and address."""
    return first_filled(explicit, F.substring(F.sha2(F.concat_ws("|", blank(product), blank(site), blank(url)), 256), 1, 24))


def dedupe_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[blank(p) for p in parts]), 256)


def recent(at: Column, now: Column, hours: int = RECENT_HOURS) -> Column:
    """Not longer ago than some hours, that hour included."""
    return F.coalesce(F.timestamp_diff("MICROSECOND", at, now) <= hours * 3_600_000_000, F.lit(False))


def due_reminders(df: DataFrame, end: str, now: Column, offsets: Sequence[int], key: Sequence[str], sent: DataFrame) -> DataFrame:
    """Rows that end in future with the smallest offset not passed, less those whose (key, end, offset) was sent; ``sent`` has history_key."""
    minutes = F.greatest(F.lit(1), F.floor(F.timestamp_diff("SECOND", now, F.col(end)) / 60)).cast("long")
    found = df.filter(F.col(end) > now).withColumn("offset", reminder(minutes, sorted(offsets))).filter("offset is not null")
    found = found.withColumn("history_key", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key], F.col(end).cast("string"), F.col("offset").cast("string")), 256))
    return found.join(sent.select("history_key").distinct(), "history_key", "left_anti").withColumn("remaining", minutes)


def remaining_text(minutes: Column) -> Column:
    """Minutes as whole days, or hours and minutes, or minutes, in words."""
    m = F.greatest(minutes, F.lit(1))
    return F.when(m >= 1440, F.concat(F.lit("約"), F.floor(m / 1440), F.lit("日"))).when(m >= 60, F.concat(F.lit("約"), F.floor(m / 60), F.lit("時間"), m % 60, F.lit("分"))).otherwise(F.concat(F.lit("約"), m, F.lit("分")))


def mark_sent(sent: DataFrame, reminders: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """history_key and sent_at after reminders went out: each key once, the latest ``most``."""
    both = sent.select("history_key", "sent_at").unionByName(reminders.select("history_key", "sent_at"))
    return both.groupBy("history_key").agg(F.min("sent_at").alias("sent_at")).orderBy(F.desc("sent_at"), "history_key").limit(most)


def verification_priority(sources: Column, product: Column, store: Column, end: Column, now: Column, known_chain: Column) -> Column:
    """HIGH for two sources or an end within 72 hours or a known chain, LOW without product or store, else NORMAL."""
    return (
        F.when(sources >= 2, "HIGH").when((blank(product) == "") | (blank(store) == ""), "LOW")
        .when(F.coalesce(F.timestamp_diff("MICROSECOND", now, end) <= 72 * 3_600_000_000, F.lit(False)), "HIGH")
        .when(F.coalesce(known_chain, F.lit(False)), "HIGH").otherwise("NORMAL")
    )
