"""Queries over application periods, states, events and reminders. Texts are picked from lists; their SQL picks what each must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.functions import periods, times
from tallyreef.operators import notices, records
from tallyreef.plans.cases import pick, sql_pick
from tallyreef.sources.tables import table

NOW = "2026-07-18 12:00:00"
EVENTS_NOW = "2024-01-20 12:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


#: Days that bring the orders' dates into this century.
LATER = 10_000


def _day(days: int, form: str) -> Column:
    return F.date_format(F.date_add(F.col("o_orderdate").cast("date"), LATER + days), form)


def _told_periods() -> Column:
    """What an order's dates are told as: five wordings by priority."""
    long, short = "yyyy年M月d日", "yyyy/M/d"
    return (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("応募期間："), _day(0, long), F.lit(" 10:00から"), _day(9, long), F.lit(" 18:00\n当選発表："), _day(20, long), F.lit(" 12:00")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("抽選受付 "), _day(0, short), F.lit("(月) 12時00分～"), _day(9, short), F.lit(" 23:59 結果発表 "), _day(20, short)))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("お知らせ\n締切："), _day(9, long)))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("受付期間：未定"))
        .otherwise(F.concat(F.lit("対象店舗："), "o_custkey", F.lit("号店。応募条件：会員 "), "o_orderkey", F.lit("\n予約 "), _day(0, short), F.lit(" ～ "), _day(9, short)))
    )


def period_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Periods that free texts tell: start, end, result, way to apply, conditions, stores."""
    t = periods.with_period(table(spark, sf, "orders"), _told_periods(), _at(NOW), F.lit(None).cast("date"), "x")
    return t.select("o_orderkey", *[F.col(f"x.{c}").cast("string").alias(c) for c in ("start", "end", "result")], "x.method", "x.conditions", "x.store", "x.unsettled", "x.end_timed")


def period_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of rows after texts were read: a stored end with a time stays; one without counts where the text tells no end."""
    o = table(spark, sf, "orders").withColumn("stored", F.when(F.col("o_orderstatus") == "P", _day(30, "yyyy-MM-dd'T'18:00")).when(F.col("o_orderstatus") == "F", _day(30, "yyyy-MM-dd")))
    t = periods.with_period(o, periods.overlay_text(_told_periods(), F.col("stored")), _at(NOW), F.lit(None).cast("date"), "x")
    end, timed = periods.overlaid(F.col("stored"), F.col("x"))
    return t.select("o_orderkey", end.cast("string").alias("end"), timed.alias("timed"))


def text_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates that texts of several kinds tell, one kind a column."""
    long, short = "yyyy年M月d日", "M月d日"
    texts = {
        "span": F.concat(_day(0, long), F.lit(" 10:00〜"), _day(4, short), F.lit(" 18：30")), "release": F.concat(F.lit("商品 "), F.col("o_orderpriority"), F.lit(" 発売日："), _day(3, long)),
        "label": F.concat(F.lit("応募受付開始："), _day(0, long), F.lit(" 10:00 締切："), _day(7, long), F.lit(" 18時 当選発表 "), _day(9, "yyyy/M/d"), F.lit(" 12:30")), "post": F.concat(_day(0, short), F.lit(" 10時から "), _day(5, short), F.lit(" 18:30")), "due": _day(0, "M/d"),
        "loose": F.when(F.col("o_orderstatus") == "F", _day(0, "yyyy-MM-dd'T'12:30:00")).when(F.col("o_orderstatus") == "O", F.concat(_day(0, "yyyy/MM/dd"), F.lit(" x"))).otherwise(_day(0, "yyyy.M.d")),
    }
    today = F.lit("2026-07-18").cast("date")
    t = table(spark, sf, "orders").select("o_orderkey", _day(0, "yyyy").cast("int").alias("year"), *[c.alias(n) for n, c in texts.items()])
    span, label, post = periods.first_and_last(F.col("span"), F.lit(2026)), periods.labelled_dates(F.col("label"), today), periods.post_dates(F.col("post"), F.col("year"))
    return t.select(
        "o_orderkey", span["start"].cast("string").alias("span_start"), span["end"].cast("string").alias("span_end"), periods.release_date(F.col("release"), F.lit(2026)).cast("string").alias("released"),
        *[label[c].cast("string").alias(f"label_{c}") for c in ("start", "end", "result")], post["start"].cast("string").alias("post_start"), post["end"].cast("string").alias("post_end"),
        periods.due(F.col("due"), today).alias("due"), periods.loose_time(F.col("loose")).cast("string").alias("loose"),
    )


def _told_status() -> Column:
    """What an order's status is told as: wordings of ends, of what is open, of planned ends and begins, blank or missing."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    over = F.when(priority == "1-URGENT", "受付終了").when(priority == "2-HIGH", "CLOSED").when(priority == "3-MEDIUM", "キャンセル！").otherwise(F.concat(F.lit("※ 応募受付は終了しました"), F.when(priority == "5-LOW", F.concat(F.lit(" "), priority)).otherwise("。")))
    open_ = F.when(priority == "1-URGENT", "受付中").when(priority == "2-HIGH", "抽選受付中").when(priority == "3-MEDIUM", F.concat(_day(9, "M月d日"), F.lit("受付終了予定"))).when(priority == "4-NOT SPECIFIED", "")
    return F.when(status == "F", over).when(status == "O", open_).otherwise("受付予定")


def explicit_ends(spark: SparkSession, sf: str) -> DataFrame:
    """The first flag or status that says a period is over, and what the status says of its begin."""
    status = _told_status()
    found = periods.explicit_end({"is_closed": F.col("o_totalprice") > 400_000}, {"status": F.array(status), "status_history": F.array(F.lit("受付中"), F.when(F.col("o_totalprice") < 50_000, F.lit("中止")))})
    return table(spark, sf, "orders").select("o_orderkey", found.alias("ended"), periods.ended_status(status).alias("says_end"), periods.open_status(status).alias("says_open"))


_RESULTS = ("当選", "落選", "未確認", "予約完了", None)
_APPLICATIONS = ("未応募", "応募済み", "抽選結果待ち", "当選", "落選", "抽選受付完了", "結果待ち候補", "変")


def derived_states(spark: SparkSession, sf: str) -> DataFrame:
    """Dashboard, application and displayed states, counted."""
    application, result = pick(_APPLICATIONS, "o_orderkey"), F.coalesce(pick(_RESULTS, "o_custkey"), F.lit(""))
    ended, today = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P"
    o = table(spark, sf, "orders").select(periods.dashboard_state(application, result, ended, today).alias("dashboard"), periods.application_state(result, F.col("o_orderkey") % 3 > 0, today).alias("application"), periods.display_state(application).alias("shown"), periods.temporal_state(ended, F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp_ntz")).alias("active"))
    return o.groupBy(*o.columns).agg(F.count("*").alias("n"))


_WORDS = ("再販 予約", "予約 販売開始", "抽選受付開始", "お知らせ", None, "予約受付", "RESTOCK now", "受付開始")
_VERIFIED = ("confirmed", "Candidate", None, "rejected", "確認中", "official")


def application_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of confirmed applications of the last 48 hours that no result or application silences, each key once."""
    e = table(spark, sf, "events")
    verification, result, state = pick(_VERIFIED, "event_id"), pick(_RESULTS, "user_id"), pick(("未応募", None, "応募済み"), "event_id")
    at = notices.event_time(F.when(F.col("event_id") % 5 == 0, F.lit("bad")), F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("string")), F.col("ts").cast("string"))
    fresh = e.filter(notices.confirmed(verification, F.when(F.col("event_id") % 13 == 0, F.lit(False)), F.lit(None).cast("boolean")) & ~notices.suppressed(result, state) & notices.recent(at, _at(EVENTS_NOW)) & (F.col("ts") <= _at(EVENTS_NOW)))
    kind = notices.event_type(pick(_WORDS, "event_id"))
    key = notices.dedupe_key(notices.application_id(F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("app"), "user_id")), F.col("user_id"), F.lit("site"), F.lit("u")), kind)
    told = fresh.select(key.alias("dedupe_key"), kind.alias("type"), "event_id").filter(notices.sales_mode_wanted(pick(("ONLINE", "STORE", "HYBRID", "UNKNOWN"), "event_id"), ["ONLINE"]))
    return told.groupBy("dedupe_key").agg(F.min_by("type", "event_id").alias("type"), F.min("event_id").alias("event_id"))


def reminders_once(spark: SparkSession, sf: str) -> DataFrame:
    """Reminders that are due and were not sent, with the time left in words."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    none = e.sparkSession.createDataFrame([], "history_key string")
    all_due = notices.due_reminders(e, "ts", _at(EVENTS_NOW), [60, 1440, 4320], ["user_id", "event_id"], none)
    sent = all_due.filter("event_id % 3 = 0").select("history_key")
    return notices.due_reminders(e, "ts", _at(EVENTS_NOW), [60, 1440, 4320], ["user_id", "event_id"], sent).select("event_id", "offset", notices.remaining_text(F.col("remaining")).alias("left"))


def sent_history(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 latest keys after reminders were marked as sent; a key keeps its first time."""
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id", "event_type").alias("history_key"), F.col("ts").alias("sent_at"), "event_id")
    return notices.mark_sent(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), 50).select("history_key", F.col("sent_at").cast("string").alias("sent_at"))


def verification_priorities(spark: SparkSession, sf: str) -> DataFrame:
    """Priorities of candidates, counted."""
    e = table(spark, sf, "events")
    found = notices.verification_priority(F.col("user_id") % 4, F.when(F.col("event_id") % 5 > 0, F.col("event_type")), F.lit("s"), F.when(F.col("event_id") % 2 == 0, F.col("ts")), _at(EVENTS_NOW), F.col("event_type") == "click")
    return e.groupBy(found.alias("priority")).agg(F.count("*").alias("n"))


def sales_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Ways of selling, as they are told or as texts and addresses show them."""
    name, kind = F.col("p_name"), F.col("p_type")
    told = F.when(kind == "STANDARD", "online").when(kind == "MEDIUM", "chain").otherwise("")
    said = F.when(kind == "ECONOMY", F.concat(name, F.lit(" オンライン抽選"))).when(kind == "MEDIUM", F.concat(name, F.lit(" web"))).when(kind == "LARGE", F.concat(F.lit("店頭受付とWEB受付 "), name)).otherwise(name)
    url = F.when(kind == "PROMO", F.concat(F.lit("https://p-bandai.jp/"), "p_partkey")).otherwise("")
    return table(spark, sf, "part").select("p_partkey", records.sales_mode([told], [said], url, F.col("p_size") == 50).alias("mode"))


def application_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that are applications and no listings, and rows that the catalog shows, counted."""
    u = F.col("url")
    own = F.when(F.col("page_id") % 3 == 0, F.concat(u, F.when(u.contains("?"), "&").otherwise("?"), F.lit("utm_source=x"))).when(F.col("page_id") % 3 == 1, F.lit("https://apply.example/"))
    repeated = records.repeats_other_url(own, u)
    found = records.application_evidence(own, repeated, [F.when(F.col("page_id") % 11 == 0, F.lit("7月"))], F.when(F.col("page_id") % 7 == 0, F.lit("抽選")), [F.when(F.col("page_id") % 13 == 0, F.lit("受付中"))])
    product = records.is_product(F.when(F.col("page_id") % 17 == 0, F.lit("application")), [F.when(F.col("page_id") % 5 == 0, F.lit("x"))], pick(("抽選受付のお知らせ", "新パック", "案内"), "page_id"), F.lit(""), pick(("application", "official"), "page_id"))
    return table(spark, sf, "pages").groupBy(F.coalesce(repeated, F.lit(False)).alias("repeated"), found.alias("application"), product.alias("product")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (period_texts, period_overlay, text_dates, explicit_ends, derived_states, application_events, reminders_once, sent_history, verification_priorities, sales_modes, application_evidence)}


_PR = "left(o_orderpriority, 1)"
_D = f"(o_orderdate::DATE + {LATER})"
_TEXT_END = f"CASE WHEN {_PR} = '1' THEN {_D} + INTERVAL 9 DAY + INTERVAL 64859 SECOND WHEN {_PR} <> '4' THEN {_D} + INTERVAL 9 DAY + INTERVAL 86399 SECOND END"
_N = f"TIMESTAMP '{EVENTS_NOW}'"
_EV = f"SELECT *, {sql_pick(_VERIFIED, 'event_id')} AS v, {sql_pick(_RESULTS, 'user_id')} AS res, {sql_pick(('未応募', None, '応募済み'), 'event_id')} AS st, {sql_pick(_WORDS, 'event_id')} AS w FROM events"
_REM = f"SELECT *, greatest(1, floor(trunc(epoch(ts - {_N})) / 60))::BIGINT AS m FROM events WHERE ts > {_N}"

ORACLE_SQL = {
    "period_texts": f"""SELECT o_orderkey, CASE WHEN {_PR} = '1' THEN ({_D} + INTERVAL 10 HOUR)::VARCHAR WHEN {_PR} = '2' THEN ({_D} + INTERVAL 12 HOUR)::VARCHAR WHEN {_PR} = '5' THEN ({_D} + INTERVAL 0 HOUR)::VARCHAR END AS start, {_TEXT_END}::VARCHAR AS "end",
        CASE WHEN {_PR} = '1' THEN ({_D} + INTERVAL 20 DAY + INTERVAL 43259 SECOND)::VARCHAR WHEN {_PR} = '2' THEN ({_D} + INTERVAL 20 DAY + INTERVAL 86399 SECOND)::VARCHAR END AS result, CASE {_PR} WHEN '2' THEN '抽選' WHEN '5' THEN '予約' ELSE '' END AS method,
        CASE WHEN {_PR} = '5' THEN '会員 ' || o_orderkey ELSE '' END AS conditions, CASE WHEN {_PR} = '5' THEN o_custkey || '号店' ELSE '' END AS store, {_PR} = '4' AS unsettled, {_PR} IN ('1', '2') AS end_timed FROM orders""",
    "period_overlay": f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN {_D} + INTERVAL 30 DAY + INTERVAL 18 HOUR WHEN {_PR} <> '4' THEN {_TEXT_END} WHEN o_orderstatus = 'F' THEN {_D} + INTERVAL 30 DAY + INTERVAL 86399 SECOND END::VARCHAR AS "end", o_orderstatus = 'P' OR {_PR} IN ('1', '2') AS timed FROM orders""",
    "text_dates": f"""WITH x AS (SELECT o_orderkey, o_orderstatus AS s, {_D} AS d FROM orders), y AS (SELECT *, year(d) || '-' AS y FROM x)
        SELECT o_orderkey, (d + INTERVAL 10 HOUR)::VARCHAR AS span_start, (TRY_CAST(y || strftime(d + 4, '%m-%d') AS DATE) + INTERVAL 1110 MINUTE)::VARCHAR AS span_end, (d + 3)::VARCHAR AS released, (d + INTERVAL 10 HOUR)::VARCHAR AS label_start, (d + INTERVAL 7 DAY + INTERVAL 18 HOUR)::VARCHAR AS label_end, (d + INTERVAL 9 DAY + INTERVAL 750 MINUTE)::VARCHAR AS label_result,
        (d + INTERVAL 10 HOUR)::VARCHAR AS post_start, (TRY_CAST(y || strftime(d + 5, '%m-%d') AS DATE) + INTERVAL 1110 MINUTE)::VARCHAR AS post_end, coalesce(TRY_CAST('2026-' || strftime(d, '%m-%d') AS DATE) <= DATE '2026-07-18', false) AS due, (d + CASE WHEN s = 'F' THEN INTERVAL 750 MINUTE ELSE INTERVAL 0 MINUTE END)::VARCHAR AS loose FROM y""",
    "explicit_ends": f"""SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'is_closed=true' WHEN o_orderstatus = 'F' THEN 'status=' || CASE {_PR} WHEN '1' THEN '受付終了' WHEN '2' THEN 'CLOSED' WHEN '3' THEN 'キャンセル！' WHEN '4' THEN '※ 応募受付は終了しました。' ELSE '※ 応募受付は終了しました ' || o_orderpriority END WHEN o_totalprice < 50000 THEN 'status_history=中止' ELSE '' END AS ended,
        o_orderstatus = 'F' AS says_end, CASE WHEN o_orderstatus = 'O' AND {_PR} IN ('1', '2') THEN 'open' WHEN o_orderstatus = 'P' THEN 'before' END AS says_open FROM orders""",
    "derived_states": f"WITH x AS (SELECT {sql_pick(_APPLICATIONS, 'o_orderkey')} AS a, coalesce({sql_pick(_RESULTS, 'o_custkey')}, '') AS r, o_orderstatus AS s, o_orderkey AS k, o_orderdate AS d FROM orders) SELECT CASE WHEN a = '当選' OR r = '当選' THEN '当選' WHEN a = '落選' OR r = '落選' THEN '落選' WHEN s = 'F' THEN '終了済み' WHEN a = '未応募' THEN CASE WHEN s = 'P' THEN '本日締切' ELSE '未応募' END WHEN a = '抽選結果待ち' THEN '結果待ち' ELSE '応募済み' END AS dashboard, CASE WHEN r IN ('当選', '落選', '予約完了') THEN r WHEN k % 3 = 0 THEN '未応募' WHEN s = 'P' THEN '抽選結果確認' ELSE '抽選受付完了' END AS application, CASE a WHEN '抽選受付完了' THEN '応募済み' WHEN '結果待ち候補' THEN '抽選結果待ち' WHEN '変' THEN 'その他' ELSE a END AS shown, CASE WHEN s = 'F' THEN 'EXPIRED' WHEN d > '1996-01-01' THEN 'UPCOMING' ELSE 'ACTIVE' END AS active, count(*) AS n FROM x GROUP BY ALL",
    "application_events": f"WITH x AS ({_EV}), f AS (SELECT event_id, CASE WHEN regexp_matches(coalesce(w, ''), '再販|再入荷|RESTOCK') THEN 'RESTOCK' WHEN contains(w, '販売開始') THEN 'SALE_START' WHEN contains(w, '予約') THEN 'RESERVATION_START' WHEN regexp_matches(coalesce(w, ''), '抽選|応募|受付開始') THEN 'APPLICATION_START' ELSE 'NEW_CONFIRMED' END AS type, CASE WHEN user_id % 3 = 0 THEN 'app' || user_id ELSE left(sha256(user_id || '|site|u'), 24) END AS app FROM x WHERE lower(coalesce(v, 'confirmed')) NOT IN ('candidate', 'rejected', '確認中') AND event_id % 13 <> 0 AND coalesce(res, '') NOT IN ('当選', '落選', '予約完了') AND coalesce(st, '未応募') = '未応募' AND ts <= {_N} AND ts >= {_N} - INTERVAL 48 HOUR AND event_id % 4 IN (0, 2)) SELECT sha256(app || '|' || type) AS dedupe_key, any_value(type) AS type, min(event_id) AS event_id FROM f GROUP BY 1",
    "reminders_once": f"WITH m AS ({_REM}) SELECT event_id, CASE WHEN m <= 60 THEN 60 WHEN m <= 1440 THEN 1440 ELSE 4320 END AS \"offset\", CASE WHEN m >= 1440 THEN '約' || (m // 1440) || '日' WHEN m >= 60 THEN '約' || (m // 60) || '時間' || (m % 60) || '分' ELSE '約' || m || '分' END AS \"left\" FROM m WHERE m <= 4320 AND event_id % 3 <> 0",
    "sent_history": "SELECT 'u' || user_id || event_type AS history_key, min(ts)::VARCHAR AS sent_at FROM events GROUP BY 1 ORDER BY min(ts) DESC, 1 LIMIT 50",
    "verification_priorities": f"SELECT CASE WHEN user_id % 4 >= 2 THEN 'HIGH' WHEN event_id % 5 = 0 THEN 'LOW' WHEN event_id % 2 = 0 AND ts <= {_N} + INTERVAL 72 HOUR THEN 'HIGH' WHEN event_type = 'click' THEN 'HIGH' ELSE 'NORMAL' END AS priority, count(*) AS n FROM events GROUP BY 1",
    "sales_modes": "SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'ONLINE' WHEN 'MEDIUM' THEN 'STORE' WHEN 'LARGE' THEN 'HYBRID' WHEN 'SMALL' THEN CASE WHEN p_size = 50 THEN 'STORE' ELSE 'UNKNOWN' END ELSE CASE WHEN p_size = 50 THEN 'HYBRID' ELSE 'ONLINE' END END AS mode FROM part",
    "application_evidence": f"WITH x AS (SELECT page_id AS k, {sql_pick(('抽選受付のお知らせ', '新パック', '案内'), 'page_id')} AS nm FROM pages) SELECT k % 3 = 0 AS repeated, k % 3 = 1 OR k % 11 = 0 OR k % 7 = 0 OR k % 13 = 0 AS application, k % 17 <> 0 AND (k % 5 = 0 OR nm = '新パック' OR NOT (k % 2 = 0 AND nm LIKE '抽選%')) AS product, count(*) AS n FROM x GROUP BY 1, 2, 3",
}
