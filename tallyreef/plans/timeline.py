"""Queries over events and dates: latest rows, changes, deadlines, agendas, reminders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.functions import times
from tallyreef.operators import shapes, windows
from tallyreef.sources.tables import api_items, table

NOW = "2024-01-20 12:00:00"
TODAY = "1998-06-01"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def latest_event_per_user(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of each user within 14 days of now, both ends included."""
    past = _events(spark, sf).filter(F.col("ts") <= _now()).select("user_id", "event_id", "event_type", "ts")
    return windows.latest_by_key(past, ["user_id"], "ts", [F.desc("event_id")], _now(), 14).select("user_id", "event_id", "event_type")


def value_change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose type or large-value flag differs from the user's event before."""
    e = _events(spark, sf).select("user_id", "event_id", "ts", "event_type", (F.col("value") > 50).alias("large"))
    feed = windows.change_feed(e, ["user_id"], [F.col("ts"), F.col("event_id")], ["event_type", "large"], important=["large"])
    return feed.select("user_id", "event_id", F.array_join("changed", ",").alias("changed"), "important", "before_event_type")


def filled_change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of type where both sides are there; errors count as nothing."""
    e = _events(spark, sf).select("user_id", "event_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    return windows.change_feed(e, ["user_id"], [F.col("ts"), F.col("event_id")], ["kind"], filled_only=True).select("user_id", "event_id", "before_kind", "kind")


def edge_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Events at which a user's type becomes purchase."""
    return windows.edges(_events(spark, sf).select("user_id", "event_id", "ts", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "purchase").select("user_id", "event_id")


def title_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Runs and type changes of each user."""
    return windows.title_changes(_events(spark, sf), "user_id", [F.col("ts"), F.col("event_id")], "event_type")


def history_top50_per_user(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 50 events of each user."""
    e = _events(spark, sf).select("user_id", "event_id", "ts")
    return windows.ranked(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("user_id", "event_id")


def timeline_top20(spark: SparkSession, sf: str) -> DataFrame:
    """One entry a day, user and type, the newest 20."""
    e = _events(spark, sf).select(F.col("ts").cast("date").cast("string").alias("day"), "user_id", "event_type", "event_id")
    daily = e.groupBy("day", "user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return daily.orderBy(F.desc("event_id")).limit(20)


def throttled_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of each user that are notified, at most one in 720 minutes since the last notified one."""
    errors = _events(spark, sf).filter("event_type = 'error'")
    return windows.throttle(errors, "user_id", "ts", "event_id", 720).select("user_id", "event_id", "count", "notify")


def deadline_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Events as deadlines: state, newness and retention against now."""
    e = _events(spark, sf)
    state = times.deadline_state(F.col("ts"), _now(), F.col("event_type") == "error")
    return e.groupBy(state.alias("state"), times.is_new(F.col("ts"), _now(), 7).alias("fresh"), times.retained(F.col("ts"), _now(), 14).alias("kept")).agg(F.count("*").alias("n"))


def period_states(spark: SparkSession, sf: str) -> DataFrame:
    """Events as periods of a day: ended, upcoming, open, today or unknown."""
    e = _events(spark, sf)
    end = F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    state = times.period_state(F.col("ts"), end, _now(), F.col("value") > 90, F.when(F.col("event_type") == "view", F.lit("stated")))
    return e.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def remaining_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the period that begins with each event, in words, as it stands at its state."""
    e = _events(spark, sf)
    end = F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL 1 DAY") * F.floor(F.col("value") / 10))
    return e.select("event_id", times.remaining_text(F.col("ts"), end, F.col("value") > 90, _now()).alias("left"))


def loose_dates(spark: SparkSession, sf: str) -> DataFrame:
    """First and last date of texts with and without years; what is long past is next year's."""
    d = F.col("o_orderdate")
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.concat(F.date_format(d, "yyyy年M月d日"), F.lit(" 1/2 2月30日"))).otherwise(F.concat(F.date_format(d, "M月d日"), F.lit("から"), F.date_format(F.date_add(d, 3), "M/d"), F.lit(" 2月30日"))).alias("t"))
    found = times.text_dates(F.col("t"), F.lit("1998-08-02").cast("date"))
    return o.select("o_orderkey", F.try_element_at(found, F.lit(1)).cast("string").alias("start"), F.try_element_at(found, F.lit(-1)).cast("string").alias("end"))


def reminder_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Deadlines ahead with the smallest reminder offset that is not passed, and the time that is left."""
    e = _events(spark, sf).select("event_id", F.floor(times.seconds_between(_now(), F.col("ts")) / 60).alias("minutes"))
    e = e.withColumn("reminder", shapes.reminder(F.col("minutes"), [60, 180, 1440, 4320]))
    return e.filter("reminder is not null").select("event_id", "reminder", times.remaining(F.col("minutes")).alias("left"))


def seen_delta(spark: SparkSession, sf: str) -> DataFrame:
    """User and type pairs after a date that were not seen before it."""
    e = _events(spark, sf).select("user_id", "event_type", "ts")
    cut = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return e.filter(F.col("ts") >= cut).select("user_id", "event_type").distinct().join(e.filter(F.col("ts") < cut).select("user_id", "event_type").distinct(), ["user_id", "event_type"], "left_anti")


def props_json(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of a field of the JSON properties by type."""
    e = _events(spark, sf).select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.max("k").alias("top"))


def api_items_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Responses made of events: items without a name or of an excluded kind are left out."""
    made = _events(spark, sf).select(F.to_json(F.array(F.struct(F.col("event_type").alias("type"), F.when(F.col("value") > 50, F.col("user_id").cast("string")).alias("name")))).alias("body"))
    return api_items(made, "body", "struct<type:string,name:string>", ["name"], ["error"]).groupBy("type").agg(F.count("*").alias("n"))


def calendar_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates, due dates of open orders and follow-ups of large ones as events, counted by month."""
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf, "orders").select("o_orderkey", day.alias("ordered"), F.when(F.col("o_orderstatus") == "O", F.date_add(day, 30)).alias("due"), F.when(F.col("o_totalprice") > 400000, F.date_add(day, 7)).alias("follow_up"))
    flat = shapes.unpivoted(rows, ["o_orderkey"], ["ordered", "due", "follow_up"])
    return flat.groupBy("event_type", F.substring(F.col("starts_at").cast("string"), 1, 7).alias("month")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def agenda_union(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of the 30 days from a date, in four kinds with priorities, in order."""
    today = F.lit(TODAY).cast("date")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    due = lambda shift: F.date_add("day", shift)
    near = lambda d: d.between(today, F.date_add(today, 30))
    tasks = [
        (1, "pay", o.filter(F.col("o_orderstatus") == "O").select("o_orderkey", due(14).alias("due"))),
        (2, "check", o.filter(F.col("o_orderstatus") == "P").select("o_orderkey", due(3).alias("due"))),
        (3, "review", o.filter(F.col("o_totalprice") > 450000).select("o_orderkey", due(0).alias("due"))),
        (4, "collect", o.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000)).select("o_orderkey", due(7).alias("due"))),
    ]
    return shapes.task_union(tasks).filter(near(F.col("due"))).select("priority", "kind", "o_orderkey", F.col("due").cast("string").alias("due")).orderBy("priority", "due", "o_orderkey")


def date_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Year of a month and day without one, nearest to now or to a release, and long past dates rolled to next year; 29 February has the leap year or none."""
    today = F.lit("2024-01-20").cast("date")
    o = table(spark, sf, "orders").select("o_orderkey", F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"))
    year = times.inferred_year(F.col("m"), F.col("d"), today, F.lit(None).cast("date"))
    rolled = times.rolled_forward(times.date_of(F.lit(2023), F.col("m"), F.col("d")), today)
    near = times.inferred_year(F.col("m"), F.col("d"), today, F.lit("2026-03-01").cast("date"))
    return o.select("o_orderkey", year.alias("year"), near.alias("by_release"), rolled.cast("string").alias("rolled"))


QUERIES = {f.__name__: f for f in (latest_event_per_user, value_change_feed, filled_change_feed, edge_detect, title_changes, history_top50_per_user, timeline_top20, throttled_errors, deadline_buckets, period_states, remaining_texts, loose_dates, reminder_offsets, seen_delta, props_json, api_items_by_kind, calendar_unpivot, agenda_union, date_inference)}

_N = f"TIMESTAMP '{NOW}'"
ORACLE_SQL = {
    "latest_event_per_user": f"SELECT user_id, event_id, event_type FROM events WHERE ts <= {_N} AND ts >= {_N} - INTERVAL 14 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "value_change_feed": "WITH l AS (SELECT *, value > 50 AS large, lag(event_type) OVER w AS b, lag(value > 50) OVER w AS bl FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, concat_ws(',', CASE WHEN event_type <> b THEN 'event_type' END, CASE WHEN large <> bl THEN 'large' END) AS changed, large <> bl AS important, b AS before_event_type FROM l WHERE b IS NOT NULL AND (event_type <> b OR large <> bl)",
    "filled_change_feed": "SELECT user_id, event_id, b AS before_kind, event_type AS kind FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type <> 'error' AND b <> 'error' AND b <> event_type",
    "edge_detect": "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type = 'purchase' AND b <> 'purchase'",
    "title_changes": "SELECT user_id, count(*) AS runs, count_if(event_type <> b) AS changes, arg_max(event_type, (ts, event_id)) AS last_title FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY user_id",
    "history_top50_per_user": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50",
    "timeline_top20": "SELECT ts::DATE::VARCHAR AS day, user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2, 3 ORDER BY event_id DESC LIMIT 20",
    "throttled_errors": "WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'error'), f AS (SELECT user_id, event_id, r, ts AS last, true AS notify FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.event_id, e.r, CASE WHEN e.ts - f.last >= INTERVAL 720 MINUTE THEN e.ts ELSE f.last END, e.ts - f.last >= INTERVAL 720 MINUTE FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1) SELECT user_id, event_id, r AS count, notify FROM f",
    "deadline_buckets": f"SELECT CASE WHEN event_type = 'error' THEN 'expired' WHEN ts < {_N} - INTERVAL 1 SECOND + INTERVAL 1 MICROSECOND THEN 'expired' WHEN ts::DATE = {_N}::DATE THEN 'today' WHEN ts < {_N} + INTERVAL 24 HOUR + INTERVAL 1 SECOND THEN 'within_24h' WHEN ts < {_N} + INTERVAL 72 HOUR + INTERVAL 1 SECOND THEN 'within_72h' ELSE 'normal' END AS state, ts < {_N} + INTERVAL 1 SECOND AND ts > {_N} - INTERVAL 7 DAY - INTERVAL 1 SECOND AS fresh, ts > {_N} - INTERVAL 14 DAY - INTERVAL 1 SECOND AS kept, count(*) AS n FROM events GROUP BY ALL",
    "remaining_texts": f"""WITH x AS (SELECT event_id, ts, value, CASE WHEN event_type <> 'view' THEN ts + INTERVAL 1 DAY * floor(value / 10)::INT END AS e FROM events), y AS (SELECT *, trunc(epoch(e - {_N})) AS s FROM x)
        SELECT event_id, CASE WHEN value > 90 OR coalesce({_N} > e, false) THEN '受付終了' WHEN {_N} < ts THEN strftime(ts, '%m/%d %H:%M') || '受付開始' WHEN e IS NULL THEN '締切日時不明' WHEN e::DATE = {_N}::DATE THEN '本日' || strftime(e, '%H:%M') || '締切' WHEN s < 86400 THEN 'あと' || greatest(1, floor(s / 3600)::INT) || '時間' ELSE 'あと' || greatest(1, floor(s / 86400)::INT) || '日' END AS "left" FROM y""",
    "loose_dates": """WITH x AS (SELECT o_orderkey, o_orderstatus AS s, o_orderdate::DATE AS d, unnest([o_orderdate::DATE, o_orderdate::DATE + 3]) AS a FROM orders), y AS (SELECT o_orderkey, s, d, TRY_CAST('1998-' || strftime(a, '%m-%d') AS DATE) AS a, TRY_CAST('1999-' || strftime(a, '%m-%d') AS DATE) AS b FROM x),
        z AS (SELECT o_orderkey, s, d, CASE WHEN DATE '1998-08-02' - a > 120 THEN b ELSE a END AS a FROM y) SELECT o_orderkey, CASE WHEN any_value(s) = 'F' THEN any_value(d) ELSE min(a) END::VARCHAR AS start, CASE WHEN any_value(s) = 'F' THEN any_value(d) ELSE max(a) END::VARCHAR AS "end" FROM z GROUP BY 1""",
    "period_states": f"SELECT CASE WHEN value > 90 THEN 'ended' WHEN event_type <> 'view' AND {_N} > ts + INTERVAL 1 DAY THEN 'ended' WHEN {_N} < ts THEN 'upcoming' WHEN event_type = 'view' THEN 'stated' WHEN (ts + INTERVAL 1 DAY)::DATE = {_N}::DATE THEN 'today' ELSE 'open' END AS state, count(*) AS n FROM events GROUP BY 1",
    "reminder_offsets": f"WITH m AS (SELECT event_id, floor(trunc(epoch(ts - {_N})) / 60)::BIGINT AS minutes FROM events), r AS (SELECT *, CASE WHEN minutes < 0 THEN NULL WHEN minutes <= 60 THEN 60 WHEN minutes <= 180 THEN 180 WHEN minutes <= 1440 THEN 1440 WHEN minutes <= 4320 THEN 4320 END AS reminder FROM m) SELECT event_id, reminder, CASE WHEN minutes >= 1440 THEN (minutes // 1440) || 'd' WHEN minutes >= 60 THEN (minutes // 60) || 'h' ELSE minutes || 'm' END AS \"left\" FROM r WHERE reminder IS NOT NULL",
    "seen_delta": "SELECT DISTINCT user_id, event_type FROM events e WHERE ts >= '2024-01-10' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = e.event_type AND s.ts < '2024-01-10')",
    "props_json": "SELECT event_type, sum((props->>'$.k')::INT)::BIGINT AS total, max((props->>'$.k')::INT) AS top FROM events GROUP BY 1",
    "api_items_by_kind": "SELECT event_type AS type, count(*) AS n FROM events WHERE value > 50 AND event_type <> 'error' GROUP BY 1",
    "calendar_unpivot": "WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS d FROM orders), u AS (SELECT o_orderkey, 'ordered' AS event_type, d AS s FROM o UNION ALL SELECT o_orderkey, 'due', d + 30 FROM o WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'follow_up', d + 7 FROM o WHERE o_totalprice > 400000) SELECT event_type, strftime(s, '%Y-%m') AS month, count(*) AS n, min(o_orderkey) AS first FROM u GROUP BY 1, 2",
    "agenda_union": f"WITH o AS (SELECT *, o_orderdate::DATE AS d FROM orders), t AS (SELECT 1 AS priority, 'pay' AS kind, o_orderkey, d + 14 AS due FROM o WHERE o_orderstatus = 'O' UNION ALL SELECT 2, 'check', o_orderkey, d + 3 FROM o WHERE o_orderstatus = 'P' UNION ALL SELECT 3, 'review', o_orderkey, d FROM o WHERE o_totalprice > 450000 UNION ALL SELECT 4, 'collect', o_orderkey, d + 7 FROM o WHERE o_orderstatus = 'F' AND o_totalprice > 300000) SELECT priority, kind, o_orderkey, due::VARCHAR AS due FROM t WHERE due BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 30",
    "date_inference": "WITH o AS (SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders), y AS (SELECT o_orderkey, y, TRY_CAST(y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) AS c FROM o, (VALUES (2023), (2024), (2025), (2026)) t(y)), f AS (SELECT o_orderkey, y, abs(c - DATE '2024-01-20') + CASE WHEN DATE '2024-01-20' - c > 120 THEN 365 ELSE 0 END AS near, abs(c - DATE '2026-03-01') + CASE WHEN c - DATE '2026-03-01' > 120 OR c - DATE '2026-03-01' < -400 THEN 1000 ELSE 0 END AS rel FROM y WHERE c IS NOT NULL), g AS (SELECT o_orderkey, arg_min(y, (near, y)) FILTER (WHERE y < 2026) AS year, arg_min(y, (rel, y)) AS by_release FROM f GROUP BY 1), r AS (SELECT o_orderkey, TRY_CAST('2023-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) AS p FROM o) SELECT r.o_orderkey, year, by_release, (CASE WHEN DATE '2024-01-20' - p > 120 THEN p + INTERVAL 1 YEAR ELSE p END)::DATE::VARCHAR AS rolled FROM r LEFT JOIN g USING (o_orderkey)",
}
