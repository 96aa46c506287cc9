"""Periods that texts tell, case by case."""

from pyspark.sql import functions as F

from tallyreef.functions import periods, times

NOW = "2026-07-18 12:00:00"
#: Texts and what they tell: start, end, result, method, conditions, store, unsettled, end_timed.
_PERIODS = (
    ("応募期間：2026年7月18日 10:00から2026年7月25日 18:00\n当選発表：2026年7月30日 12:00", "2026-07-18 10:00:00", "2026-07-25 18:00:59", "2026-07-30 12:00:59", "", "", "", False, True),
    ("抽選受付 7/20(月) 12時00分～8/3 23:59 結果発表 8/10", "2026-07-20 12:00:00", "2026-08-03 23:59:59", "2026-08-10 23:59:59", "抽選", "", "", False, True),
    ("予約は12月28日から1月5日まで", "2026-12-28 00:00:00", "2027-01-05 23:59:59", None, "予約", "", "", False, False),
    ("締切：2026年7月31日", None, "2026-07-31 23:59:59", None, "", "", "", False, False),
    ("受付開始 2026年9月1日 9:00\n9月30日 21:00まで受付", "2026-09-01 09:00:00", None, None, "", "", "", False, False),
    ("応募締切は8月5日 18:00です。公式アプリから応募", None, "2026-08-05 18:00:59", None, "アプリ受付", "", "", False, True),
    ("受付期間：未定", None, None, None, "", "", "", True, False),
    ("お知らせ 7月20日から7月25日", None, None, None, "", "", "", False, False),
    ("対象店舗：東京 1号店、大阪店。応募条件：会員 限定\n抽選 2026/10/1 ～ 2026/10/3", "2026-10-01 00:00:00", "2026-10-03 23:59:59", None, "抽選", "会員 限定", "東京 1号店、大阪店", False, False),
    ("", None, None, None, "", "", "", False, False),
    ("応募：2月30日まで", None, None, None, "", "", "", False, False),
)

#: Texts with first and last date, release date, labelled dates, dates of a post, and whether a result is due.
_SPANS = (("2025年7月1日 10:00〜7月5日", "2025-07-01 10:00:00", "2025-07-05 23:59:00"), ("7月1日(水)〜7月9日 18：30", "2026-07-01 00:00:00", "2026-07-09 18:30:00"), ("2月30日〜3月1日", None, "2026-03-01 23:59:00"), ("なし", None, None), ("8月8日", "2026-08-08 00:00:00", "2026-08-08 23:59:00"))
_RELEASES = (("発売日：2026年8月1日", "2026-08-01"), ("2026年9月10日(金) 発売予定", "2026-09-10"), ("【3月15日発売】", "2026-03-15"), ("発売日：2026年2月30日 【4月1日発売】", "2026-04-01"), ("未定", None))
_LABELLED = (
    ("応募受付開始：2026年7月20日 10:00 締切：2026年7月27日 18時 当選発表 2026/8/1 12:30", "2026-07-20 10:00:00", "2026-07-27 18:00:00", "2026-08-01 12:30:00"), ("応募期間：12月20日 10:00~1月10日 23:59", "2026-12-20 10:00:00", "2027-01-10 23:59:00", None),
    ("当日 21時まで", None, "2026-07-18 21:00:00", None), ("予約受付期間 2026年8月1日(土)9時～8月5日(水)20:30", "2026-08-01 09:00:00", "2026-08-05 20:30:00", None), ("", None, None, None),
)
_POSTS = (("7月20日 10時から 8月1日 18:30", "2026-07-20 10:00:00", "2026-08-01 18:30:00"), ("2025年12月31日〆 1月32日 2月3日", "2025-12-31 00:00:00", "2026-02-03 00:00:00"), ("3月3日", "2026-03-03 00:00:00", None), ("x", None, None))
_DUE = (("7/18", True), ("2026年7月19日", False), ("2025/12/31", True), ("2/30", False), ("", False), ("12月1日", False))
_LOOSE = (("2026-07-18T12:30:00", "2026-07-18 12:30:00"), ("2026/07/08 x", "2026-07-08 00:00:00"), ("2026.7.8", "2026-07-08 00:00:00"), ("bad", None), ("2026-02-30", None), ("2026-07-18", "2026-07-18 00:00:00"))
#: Statuses, whether they say that a period is over, and what they say of its begin.
_STATUSES = (("受付終了", True, None), ("終了予定", False, None), ("※ 応募受付は終了しました。", True, None), ("受付中", False, "open"), ("受付予定", False, "before"), ("", False, None), (None, False, None), ("CLOSED", True, None), ("抽選受付中", False, "open"), ("キャンセル！", True, None))


def read(df, text):
    return periods.with_period(df, text, F.lit(NOW).cast("timestamp_ntz"), F.lit(None).cast("date"), "x")


def test_texts_tell_periods(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(_PERIODS)], "i int, t string")
    found = read(df, F.col("t")).select("i", *[F.col(f"x.{c}").cast("string").alias(c) for c in ("start", "end", "result")], "x.method", "x.conditions", "x.store", "x.unsettled", "x.end_timed").orderBy("i")
    assert [tuple(r)[1:] for r in found.collect()] == [c[1:] for c in _PERIODS]


def test_stored_ends_and_texts(spark):
    """A stored end with a time stays; one without is a deadline after what the text tells."""
    cases = [
        ("2026-07-20", "お知らせ", "2026-07-20 23:59:59", False), ("2026-07-20", "締切：2026年7月31日", "2026-07-31 23:59:59", False), ("2026-07-20T18:00", "締切：2026年7月31日 10:00", "2026-07-20 18:00:00", True), ("7月20日 18:00", None, "2026-07-20 18:00:59", True),
        ("", "締切：2026年7月31日 10:00", "2026-07-31 10:00:59", True), (None, "", None, False), ("2026-13-40T10:00", "", None, False), (" ", "x", None, False),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, stored string, t string")
    end, timed = periods.overlaid(F.col("stored"), F.col("x"))
    found = read(df, periods.overlay_text(F.col("t"), F.col("stored"))).select("i", end.cast("string").alias("end"), timed.alias("timed")).orderBy("i")
    assert [tuple(r)[1:] for r in found.collect()] == [c[2:] for c in cases]


def test_remaining_texts(spark):
    cases = [
        (None, None, True, "受付終了"), (None, "2026-07-18 11:59:59", False, "受付終了"), ("2026-07-20 09:05:00", "2026-08-01 00:00:00", False, "07/20 09:05受付開始"), (None, None, False, "締切日時不明"), (None, "2026-07-18 18:05:00", False, "本日18:05締切"),
        (None, "2026-07-19 00:30:00", False, "あと12時間"), (None, "2026-07-19 12:00:00", False, "あと1日"), ("2026-07-01 00:00:00", "2026-07-25 11:00:00", False, "あと6日"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, s string, e string, ended boolean")
    text = times.remaining_text(F.col("s").cast("timestamp_ntz"), F.col("e").cast("timestamp_ntz"), F.col("ended"), F.lit(NOW).cast("timestamp_ntz"))
    assert [r.x for r in df.select("i", text.alias("x")).orderBy("i").collect()] == [c[3] for c in cases]


def test_dates_without_a_year_roll_on(spark):
    cases = [("2026-08-01 2026/7/1 8月2日 7/5", "2026-07-01", "2026-08-01"), ("8月2日 7/5 1.5", "2026-07-05", "2027-01-05"), ("1月5日", "2027-01-05", "2027-01-05"), ("4月1日", "2026-04-01", "2026-04-01"), ("2月30日", None, None), (None, None, None), ("2026年12月31日〜1/3", "2026-12-31", "2026-12-31"), ("2026年2月30日 8/1", "2026-08-01", "2026-08-01")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    dates = times.text_dates(F.col("t"), F.lit("2026-07-18").cast("date"))
    found = df.select("i", F.try_element_at(dates, F.lit(1)).cast("string").alias("a"), F.try_element_at(dates, F.lit(-1)).cast("string").alias("b")).orderBy("i")
    assert [tuple(r)[1:] for r in found.collect()] == [c[1:] for c in cases]


def test_texts_tell_dates(spark):
    year, today = F.lit(2026), F.lit("2026-07-18").cast("date")

    def told(cases, *columns):
        df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
        return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]

    t = F.col("t")
    span, label, post = periods.first_and_last(t, year), periods.labelled_dates(t, today), periods.post_dates(t, year)
    shown = lambda x, *names: [x[n].cast("string").alias(n) for n in names]
    assert told(_SPANS, *shown(span, "start", "end")) == [c[1:] for c in _SPANS]
    assert told(_RELEASES, periods.release_date(t, year).cast("string")) == [c[1:] for c in _RELEASES]
    assert told(_LABELLED, *shown(label, "start", "end", "result")) == [c[1:] for c in _LABELLED]
    assert told(_POSTS, *shown(post, "start", "end")) == [c[1:] for c in _POSTS]
    assert told(_DUE, periods.due(t, today)) == [c[1:] for c in _DUE] and told(_LOOSE, periods.loose_time(t).cast("string")) == [c[1:] for c in _LOOSE]
    assert told(_STATUSES, periods.ended_status(t), periods.open_status(t)) == [c[1:] for c in _STATUSES]
