import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyreef.functions import money, rules, text, times, urls
from tallyreef.operators import components, joins, master, ordered_merge, resolve, searches, shapes, windows
from tallyreef.sources import sinks, staged, tables
from tallyreef.sources.scratch import written
from tallyreef.streaming import streams


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def value(df, column):
    return df.select(column.alias("y")).first().y


@pytest.mark.parametrize(
    ("url", "application", "discovery", "shop"),
    [
        ("HTTPS://Shop.Example.com/A/?b=2&utm_source=x&a=1#top", "https://shop.example.com/A?b=2&a=1", "https://shop.example.com/A?b=2&a=1", "https://shop.example.com/A/?a=1&b=2"),
        ("http://example.com/", "http://example.com/", "http://example.com", ""),
        ("ftp://example.com/x", "", "", ""),
        (None, "", "", ""),
        ("no address", "", "", ""),
    ],
)
def test_canonical_urls(spark, url, application, discovery, shop):
    df = one(spark, url)
    assert (value(df, urls.application_url(F.col("x"))), value(df, urls.discovery_url(F.col("x"))), value(df, urls.shop_url(F.col("x")))) == (application, discovery, shop)


@pytest.mark.parametrize(
    ("url", "error"),
    [("https://a.example/x", ""), ("http://a.example", "scheme"), ("https://u:p@a.example", "credentials"), ("https://a.example:444/", "port"), ("https://127.0.0.1/", "address"), ("https://localhost/", "local"), ("https://a.local", "local"), ("https://[::1]/", "address"), ("https://X.com/a", "social")],
)
def test_url_safety(spark, url, error):
    assert value(one(spark, url), urls.safety_error(F.col("x"))) == error


NOW = dt.datetime(2026, 7, 18, 12)


@pytest.mark.parametrize(
    ("hours", "state"),
    [(None, "unknown"), (-1, "expired"), (0, "today"), (11, "today"), (12, "within_24h"), (24, "within_24h"), (72, "within_72h"), (73, "normal")],
)
def test_deadline_states(spark, hours, state):
    end = None if hours is None else NOW + dt.timedelta(hours=hours)
    df = spark.createDataFrame([(end, NOW)], "e timestamp_ntz, n timestamp_ntz")
    assert value(df, times.deadline_state(F.col("e"), F.col("n"))) == state


def test_boundaries_are_inclusive(spark):
    df = spark.createDataFrame([(NOW - dt.timedelta(days=14), NOW)], "t timestamp_ntz, n timestamp_ntz")
    assert value(df, times.is_new(F.col("t"), F.col("n"), 14)) and value(df, times.retained(F.col("t"), F.col("n"), 14))
    assert not value(df, times.is_new(F.col("n"), F.col("t"), 14))


@pytest.mark.parametrize(
    ("shown", "hour"), [("2026-07-18T12:00:00Z", 21), ("2026-07-18T12:00:00+09:00", 12), ("2026-07-18T12:00:00", 12), ("2026-07-18 12:00", 12), ("2026-02-30T00:00:00", None), ("", None)]
)
def test_local_time(spark, shown, hour):
    found = value(one(spark, shown), times.local_time(F.col("x")))
    assert (found and found.hour) == hour


def test_prices(spark):
    df = one(spark, "about 5,405 yen")
    assert value(df, money.price(F.col("x"))) == 5405
    assert value(df, money.price(F.lit("25"), False)) == 28  # 27.5 goes to the even number
    assert value(df, money.price(F.lit("0"))) is None
    assert value(df, money.sale_price(F.lit("none"), F.lit("12"))) is None
    assert value(df, money.reference_price(F.lit("none"), F.lit("12"))) == 12


def test_accuracy_is_null_when_nothing_is_decided(spark):
    assert value(one(spark, "a"), money.accuracy(F.lit(0), F.lit(0))) is None


def test_text_forms(spark):
    df = one(spark, "ＢＯＸ　Ａbc　 d")
    assert value(df, text.search_text(F.col("x"))) == "box abc d"
    assert value(df, text.masked_reference(F.lit(None), F.lit("abcd"))) == "••••"
    broken = "価格".encode("cp932").decode("cp1252", errors="ignore")
    assert value(one(spark, "plain"), text.repair_mojibake(F.col("x"))) == "plain"
    assert value(one(spark, broken), text.repair_mojibake(F.col("x"))) is not None
    assert value(df, text.labelled(F.lit("a: 1\nend: 2 x\n"), "end")) == "2 x"
    assert value(df, text.tokens(F.lit("B a b, C"), ["c"])) == ["a", "b"]


def test_release_candidates_sort_before_releases(spark):
    df = spark.createDataFrame([("1.25.0",), ("1.25.0 RC5",), ("1.3.0",), ("1.24.9",)], "v string")
    assert [r.v for r in df.orderBy(text.version_order(F.col("v"))).collect()] == ["1.3.0", "1.24.9", "1.25.0 RC5", "1.25.0"]


def test_rules(spark):
    df = one(spark, "Restock of an application")
    assert value(df, rules.keyword_class(F.col("x"), [("RESTOCK", "restock"), ("APPLICATION", "application")], "NEWS")) == "RESTOCK"
    assert value(df, shapes.not_refused(F.lit(None).cast("boolean"))) is True
    assert value(df, shapes.not_refused(F.lit(False))) is False


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("k", 1, "a", "s"), ("k", 2, "b", "t")], "k string, ord int, v string, src string")
    assert resolve.first_wins(df, ["k"], ["ord"]).first().v == "a"
    last = resolve.last_wins(df, ["k"], ["ord"], ["src"]).first()
    assert last.v == "b" and last.src == ["s", "t"]


def test_greedy_merge_fills_and_then_matches(spark):
    df = spark.createDataFrame([("b", 1, "u", None), ("b", 2, "u", "n"), ("b", 3, None, "n"), (None, 4, "u", "n"), (None, 5, "u", None)], "b string, ord int, url string, num string")
    assert sorted(r.merged for r in resolve.greedy_merge(df, "b", "ord", [("url",), ("num",)], ["url", "num"]).collect()) == [2, 3]


def test_greedy_merge_equals_a_plain_fold(spark):
    """Against a scan of all rows held so far, on keys that often meet."""
    draw = random.Random(4)
    some = lambda n: draw.choice([None, "", *map(str, range(n))])
    rows = [(draw.choice("abc"), i, some(60), some(9), some(9)) for i in range(600)]
    expected = []
    for block in "abc":
        held = []
        for _, i, u, x, y in (r for r in rows if r[0] == block):
            same = next((h for h in held if u and h[1] == u or x and y and (h[2], h[3]) == (x, y)), None)
            if same is None:
                held.append([i, u, x, y, 1])
                continue
            same[4] += 1
            for at, v in ((1, u), (2, x), (3, y)):
                same[at] = same[at] or v
        expected += held
    df = spark.createDataFrame(rows, "b string, ord int, u string, x string, y string").repartition(5)
    found = resolve.greedy_merge(df, "b", "ord", [("u",), ("x", "y")], ["u", "x", "y"]).collect()
    assert sorted((r.ord, r.u or "", r.x or "", r.y or "", r.merged) for r in found) == sorted((i, u or "", x or "", y or "", n) for i, u, x, y, n in expected)


def test_linked_groups(spark):
    """A chain of links, rows that share a key with many, and rows without any."""
    rows = [(i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(40)] + [(100 + i, "hot", None) for i in range(30)] + [(200, None, ""), (201, "", None)]
    found = {r.i: r.label for r in components.linked_groups(spark.createDataFrame(rows, "i long, a string, b string"), "i", [("a",), ("b",)]).collect()}
    assert found == {i: 0 if i < 40 else 100 if i < 200 else i for i, _, _ in rows}


def test_containing_phrases_of_any_length(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta theta iota", "ALPHA  beta", "xalpha betax", "", None, "one two three four five six seven eight"]
    phrases = ["alpha beta", "alpha beta gamma delta epsilon", "pha beta gamma delta epsilon zeta eta theta", "a", "", " ", None, "beta gamma delta epsilon zeta eta thet", "four", "two three four five six seven eight", "eight nine"]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    p = spark.createDataFrame(list(enumerate(phrases)), "p long, phrase string")
    expected = {(i, k) for i, x in enumerate(texts) for k, y in enumerate(phrases) if x and y and y.strip() and y.lower() in x.lower()}
    for most in (10_000, 40):
        found = [tuple(r) for r in joins.containing(t, p, "i", "text", "p", "phrase", most).collect()]
        assert sorted(found) == sorted(expected)


def test_best_match_with_frequent_words(spark):
    """Against all pairs, whatever counts as frequent."""
    draw = random.Random(8)
    row = lambda i: (i, draw.sample(["a", "b", "c", "d1", "d2", "d3", "d4"], draw.randint(0, 4)), draw.randint(0, 2))
    left, right = [row(i) for i in range(30)], [row(i) for i in range(80)]
    a, b = (spark.createDataFrame(rows, f"{x}id int, {x}w array<string>, {x}n int") for rows, x in ((left, "l"), (right, "r")))
    expected = {}
    for i, w, n in left:
        best = max(((2 * len(set(w) & set(v)) + 3 * (n == m), -j) for j, v, m in right if set(w) & set(v)), default=(0, 0))
        expected[i] = (-best[1], best[0]) if best[0] >= 3 else (None, None)
    for frequent in (0, 20, 1000):
        found = {r.lid: (r.rid, r.score) for r in joins.best_match(a, b, "lid", "rid", "lw", "rw", 3, 2, [("ln", "rn", 3)], frequent).collect()}
        assert found == expected


def test_throttle_counts_from_the_last_notified(spark):
    rows = [("k", NOW + dt.timedelta(minutes=m), i) for i, m in enumerate((0, 6, 11, 15, 21))]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, ord int")
    found = windows.throttle(df, "k", "at", "ord", 10).orderBy("ord").collect()
    assert [r.notify for r in found] == [True, False, True, False, True] and [r["count"] for r in found] == [1, 2, 3, 4, 5]


def test_json_scan_keeps_bad_records_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"}]')
    (tmp_path / "b.json").write_text("{broken")
    from pyspark.sql.types import StringType, StructType

    good, bad = tables.json_rows(spark, str(tmp_path / "*.json"), StructType().add("id", StringType()))
    assert sorted(r.id for r in good.collect()) == ["1", "2"] and bad.count() == 1
    assert tables.json_state(good, bad) == "corrupt"


def test_feed_items(spark):
    xml = "<rss><item><link>https://A.example/u1?x=1#top</link><title>A</title><pubDate>d</pubDate></item><item><link>https://a.example/u1?x=1</link><title>B</title></item><item><link>https://a.example/u2</link><title><![CDATA[C]]></title></item></rss>"
    found = tables.feed_items(spark.createDataFrame([("f", xml)], "url string, xml string")).orderBy("ord").collect()
    assert [(r.link, r.title) for r in found] == [("https://a.example/u1?x=1", "A"), ("https://a.example/u2", "C")]
    sitemap = "<urlset><url><loc>https://a.example/p</loc><lastmod>2026</lastmod></url></urlset>"
    assert tables.feed_items(spark.createDataFrame([("f", sitemap)], "url string, xml string")).first().published == "2026"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, seen boolean")
    path = str(tmp_path / "t")
    sinks.guarded_overwrite(df, path, ["id"])
    with pytest.raises(ValueError, match="repeat"):
        sinks.guarded_overwrite(df.union(df), path, ["id"])
    assert not sinks.write_if_changed(df, str(tmp_path / "u"), spark.read.parquet(path))
    assert sinks.write_if_changed(df.limit(1), str(tmp_path / "u"), spark.read.parquet(path))
    assert sinks.replace_by_key(df, spark.createDataFrame([(2, True)], df.schema), ["id"]).filter("seen").count() == 2
    sinks.export_csv(df, str(tmp_path / "c"))
    assert "yes" in "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))


def test_ids_compare_as_numbers(spark):
    df = spark.createDataFrame([("9",), ("100",), ("x",)], "id string")
    assert [r.id for r in tables.since(df, "id", 50).collect()] == ["100"]


def rows_of_a_plugin():
    yield {"name": "n", "url": "u", "category": "a"}
    yield {"name": "m", "url": "v", "category": "b"}


def test_plugin_source(spark):
    spark.dataSource.register(tables.PluginSource)
    read = spark.read.format("plugin").option("plugins", "tests.test_functions:rows_of_a_plugin,tests.test_functions:rows_of_a_plugin")
    assert read.load().count() == 4 and [r.name for r in read.option("category", "b").load().collect()] == ["m", "m"]


def test_file_states(spark, tmp_path):
    from pyspark.sql.types import StringType, StructType

    schema = StructType().add("id", StringType())
    (tmp_path / "bak.json").write_text("[]")
    assert tables.file_state(spark, str(tmp_path / "a.json"), schema) == "missing"
    assert tables.file_state(spark, str(tmp_path / "a.json"), schema, str(tmp_path / "bak.json")) == "corrupt"
    (tmp_path / "a.json").write_text('\ufeff[{"id": "1"}]', encoding="utf-8")
    assert tables.file_state(spark, str(tmp_path / "a.json"), schema) == "valid"
    assert tables.file_state(spark, str(tmp_path / "bak.json"), schema) == "valid_empty"


def test_plugin_folder(spark, tmp_path):
    from pyspark.sql.types import StringType, StructType

    (tmp_path / "b.json").write_text('[{"id": "1", "url": "u"}, {"id": "2"}]')
    (tmp_path / "a.json").write_text('{"id": "3", "url": "w"}')
    (tmp_path / "c.json").write_text("{broken")
    found = tables.plugin_rows(spark, str(tmp_path), StructType().add("id", StringType()).add("url", StringType()), ["id", "url"])
    assert [(r.file, r.id, r.error) for r in found.collect()] == [("a.json", "3", ""), ("b.json", "1", ""), ("b.json", "2", "missing: url"), ("c.json", None, "missing: id,url")]


def test_versioned_catalog(spark):
    rows = spark.createDataFrame([("a", 2, None), ("b", 2, "x")], "id string, version int, kind string")
    defaults = spark.createDataFrame([("d",)], "kind string")
    assert sorted((r.id, r.kind) for r in tables.versioned_catalog(rows, defaults, "id", "version", 2).collect()) == [("a", "d"), ("b", "x")]
    for wrong in (rows.union(rows), rows.selectExpr("id", "3 as version", "kind")):
        with pytest.raises(ValueError, match="catalog"):
            tables.versioned_catalog(wrong, defaults, "id", "version", 2)


def test_log_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("INFO x\nERROR y\nINFO ERROR z\n")
    assert [r.line for r in tables.log_lines(spark, str(tmp_path), level="INFO").orderBy("line").collect()] == ["INFO ERROR z", "INFO x"]
    assert [r.line for r in tables.log_lines(spark, str(tmp_path), word="Y").collect()] == ["ERROR y"]


def test_posts_since_or_of_the_last_days(spark):
    posts = spark.createDataFrame([("9", "u", NOW), ("100", "v", NOW - dt.timedelta(days=8)), ("101", "w", NOW)], "id string, user string, at timestamp_ntz")
    users = spark.createDataFrame([("u", "U"), ("w", "W")], "user string, name string")
    now = F.lit(str(NOW)).cast("timestamp_ntz")
    assert sorted((r.id, r.name) for r in tables.recent_posts(posts, users, "id", "user", "at", 50, now).collect()) == [("100", None), ("101", "W")]
    assert sorted(r.id for r in tables.recent_posts(posts, users, "id", "user", "at", None, now).collect()) == ["101", "9"]


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, "x"), ("b", 2, "y")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 3, "z")], df.schema)
    assert [(r.k, r.v) for r in sinks.upsert_newest(df, new, ["k"], "at", 5).collect()] == [("a", "z"), ("b", "y")]
    assert sinks.repaired_overwrite(df.union(df), str(tmp_path / "r"), ["k"], "at") == 2 and spark.read.parquet(str(tmp_path / "r")).count() == 2
    with pytest.raises(ValueError, match="differ"):
        sinks.repaired_overwrite(df.union(spark.createDataFrame([("A", 9, "q")], df.schema)), str(tmp_path / "s"), ["k"], "at")
    left, excluded = sinks.remove_keys(df, df.filter("k = 'A'"), ["k"], spark.createDataFrame([("old",)], "k string"))
    assert left.count() == 1 and sorted(r.k for r in excluded.collect()) == ["A", "old"]
    sinks.export_csv(df, str(tmp_path / "c"), mark=True)
    assert any(p.read_text(encoding="utf-8").startswith("\ufeffk,at,v") for p in (tmp_path / "c").glob("*.csv"))


def test_restore_and_merge_write(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, "x"), ("b", 2, "y")], "k string, at int, v string")
    paths = [str(tmp_path / x) for x in ("table", "backup", "empty", "new")]
    df.write.parquet(paths[1])
    df.limit(0).write.parquet(paths[2])
    assert not sinks.restore(spark, paths[0], paths[2], df.schema, ["k"]) and sinks.restore(spark, paths[0], paths[1], df.schema, ["k"])
    sinks.merge_write(spark, paths[0], spark.createDataFrame([("B", 5, "z")], df.schema), ["k"], "at", 9, paths[3])
    assert sorted((r.k, r.v) for r in spark.read.parquet(paths[3]).collect()) == [("A", "x"), ("B", "z")]


def test_mail_text(spark):
    mixed = "MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/html\n\n<p>no &amp; no</p>\n--b\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n5b2T6YG4\n--b\nContent-Type: text/plain\nContent-Disposition: attachment\n\nfile\n--b--\n"
    assert value(one(spark, mixed), text.mail_text(F.col("x"))) == "当選"
    assert value(one(spark, "Content-Type: text/html\n\n<b>a</b>&lt;"), text.mail_text(F.col("x"))).split() == ["a", "<"]


def test_stream_upsert_survives_a_restart(spark, tmp_path):
    from tallyreef.streaming import streams

    paths = [str(tmp_path / x) for x in ("merge", "state")]
    seen = []

    def run():
        stream = spark.readStream.schema("k string, ord int, v string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        found = streams.upsert_batches(stream, "k", "ord", *paths, mark=lambda batch, n: seen.append(n), compact_every=2)
        return sorted(tuple(r) for r in found.collect())

    (tmp_path / "in").mkdir()
    for i, line in enumerate(('{"k": "a", "ord": 1, "v": "x"}', '{"k": "b", "ord": 2, "v": "y"}', '{"k": "a", "ord": 3, "v": "z"}')):
        (tmp_path / "in" / f"{i}.json").write_text(line)
    assert run() == [("a", 3, "z"), ("b", 2, "y")]
    (tmp_path / "in" / "4.json").write_text('{"k": "c", "ord": 4, "v": "w"}\n{"k": "b", "ord": 1, "v": "old"}')
    assert run() == [("a", 3, "z"), ("b", 2, "y"), ("c", 4, "w")] and seen == [0, 1, 2, 3]


def _plain_first_match(rows, keys, kept=()):
    """Rows (order, columns) folded one by one."""
    heads, out = list(kept), {}
    for i, *values in sorted(rows):
        mine = [tuple(values[c] for c in key) for key in keys]
        head = next((h for h, *other in heads if any(m == tuple(other[c] for c in key) and all(x not in (None, "") for x in m) for m, key in zip(mine, keys, strict=True))), None)
        if head is None:
            heads.append((i, *values))
        out[i] = i if head is None else head
    return out


@pytest.mark.parametrize("fold", [0, 15, 10_000])
def test_first_match_equals_a_plain_fold(spark, fold):
    """Rounds alone, rounds with folds of the first rows, and one fold."""
    draw = random.Random(fold)
    some = lambda n: draw.choice([None, "", *map(str, range(n))])
    rows = [(i, some(150), some(40), some(12), some(12)) for i in range(400)]
    kept = [(i - 100, some(150), some(40), some(12), some(12)) for i in range(20)]
    keys, names = [(0,), (1,), (2, 3)], "abcd"
    schema = "ord int, a string, b string, c string, d string"
    df, old = spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(kept, schema)
    for before in ((), kept):
        found = ordered_merge.first_match(df, "ord", [[names[c] for c in key] for key in keys], old if before else None, max(fold, 1))
        assert {r.ord: r["head"] for r in found.collect()} == _plain_first_match(rows, keys, before)


def test_first_match_of_a_chain_and_of_a_hot_key(spark):
    """Each row shares a key with the next only; and one key that half of the rows have."""
    chain = [(i, f"x{i // 2}", f"y{(i + 1) // 2}") for i in range(300)]
    hot = [(1000 + i, "hot" if i % 2 else None, None) for i in range(300)]
    df = spark.createDataFrame(chain + hot, "ord int, a string, b string").repartition(4)
    found = {r.ord: r["head"] for r in ordered_merge.first_match(df, "ord", [("a",), ("b",)], fold=50).collect()}
    assert found == _plain_first_match(chain + hot, [(0,), (1,)])
    assert ordered_merge.first_match(df.filter("ord < 0"), "ord", [("a",)]).count() == 0


def test_last_evidence_equals_a_plain_buffer(spark):
    draw = random.Random(1)
    rows = [(draw.choice([None, "g", "h"]), i, draw.choice("abcdefg"), draw.choice([None, "u"])) for i in range(400)]
    expected = []
    for group in (None, "g", "h"):
        held = []
        for r in (r for r in rows if r[0] == group):
            if r[2:] not in [h[2:] for h in held]:
                held = [*held, r][-5:]
        expected += [(*h, k) for k, h in enumerate(held)]
    found = ordered_merge.last_evidence(spark.createDataFrame(rows, "g string, i int, s string, u string").repartition(3), "g", ["i"], ["s", "u"], 5)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def _failing(frames):
    for i, frame in enumerate(frames):
        yield frame
        if i or 7 in set(frame["id"]):
            raise ValueError("a task fails")


def test_staged_tables_change_at_once_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "store")
    assert staged.read(spark, path, "t") is None and staged.manifest(path)["version"] == 0
    df = spark.range(20).repartition(4)
    staged.write(df, path, "t")
    before = staged.read(spark, path, "t")
    broken = df.filter("id < 8").repartition(4).mapInPandas(_failing, "id long")
    with pytest.raises(Exception, match="a task fails"):
        staged.write(broken, path, "t")
    with pytest.raises(Exception, match="a task fails"):
        staged.write_all({"t": df.limit(3), "u": broken}, path)
    assert staged.manifest(path)["version"] == 1 and staged.read(spark, path, "t").count() == 20 and staged.read(spark, path, "u") is None
    assert staged.vacuum(path) == 0  # what failed has left nothing
    # Rows that were read from the table may be written to it; who holds the old version still reads it.
    assert staged.write_all({"t": staged.read(spark, path, "t").filter("id < 5"), "u": spark.range(0)}, path) == 2
    assert before.count() == 20 and staged.read(spark, path, "t").count() == 5 and staged.read(spark, path, "u").count() == 0
    with pytest.raises(staged.StaleVersion):
        staged.write_all({"t": df}, path, began=1)
    assert staged.read(spark, path, "t").count() == 5 and staged.vacuum(path) > 0


def test_candidate_batches_equal_one_batch(spark):
    draw = random.Random(6)
    some = lambda n: draw.choice([None, *map(str, range(n))])
    rows = [(i, some(30), some(12), draw.random() * 1.4 - 0.2, f"t{i:03}", some(6), some(3)) for i in range(240)]
    hits = spark.createDataFrame(rows, "i int, host string, name string, confidence double, at string, source string, url string")
    stored = None
    for a, b in ((0, 50), (50, 51), (51, 200), (200, 240)):
        stored = written(ordered_merge.upsert_candidates(stored, hits.filter(f"i >= {a} and i < {b}"), "i", [("host",), ("name",)], "confidence", "at", ["source", "url"], 4), "stored")
    whole = ordered_merge.upsert_candidates(None, hits, "i", [("host",), ("name",)], "confidence", "at", ["source", "url"], 4)
    shown = lambda df: sorted(map(repr, df.select("i", "host", "name", "n", "confidence", "last_detected_at", "evidence").collect()))
    assert shown(stored) == shown(whole)
    heads = _plain_first_match([(r[0], r[1], r[2]) for r in rows], [(0,), (1,)])
    for r in whole.collect():
        members = [m for m in rows if heads[m[0]] == r.i]
        assert r.n == len(members) and r.confidence == max(min(1.0, max(0.0, m[3])) for m in members) and r.last_detected_at == members[-1][4]


def test_search_counters_come_with_the_job(spark):
    candidates = spark.createDataFrame([(1, "t", "a"), (2, "t", "b"), (3, None, "a")], "id int, term string, cat string")
    offers = spark.createDataFrame([("t", 1, "u", 0.9, 1), ("t", 2, "u", 0.9, 2), ("t", 2, "v", 0.1, 3), ("t", 2, "w", None, 4), ("t", 3, "x", 0.9, 5), (None, 1, "y", 0.9, 6)], "term string, plugin int, url string, sure double, o int")
    plugins = spark.createDataFrame([(1, 2, ["a"]), (2, 1, []), (3, 0, ["b"])], "plugin int, rank int, categories array<string>")
    hits = searches.fan_out(candidates, offers, plugins, "id", "cat", "term", ["o"], ["url"], "sure", 0.5, F.when(F.col("o") == 5, "dear"))
    shown, seen = searches.observed(hits, ["dear"])
    assert sorted((r.id, r.o, r.outcome) for r in shown.collect()) == [(1, 1, "duplicate"), (1, 2, "accepted"), (1, 3, "unsure"), (1, 4, "unsure"), (2, 2, "accepted"), (2, 3, "unsure"), (2, 4, "unsure"), (2, 5, "dear")]
    assert seen.get == {"hits": 8, "accepted": 2, "duplicate": 1, "unsure": 4, "dear": 1}
    assert searches.search_counters(hits, "id", "plugin").filter("id = 2").first().asDict(recursive=True) == {"id": 2, "hits": 4, "duplicates": 0, "unsure": 2, "excluded": 1, "accepted": 1, "found_shops": 2, "regular_shops": 1, "reasons": [{"outcome": "dear", "n": 1}]}


def test_details_are_read_for_the_first_likely_listings_alone(spark):
    listings = spark.createDataFrame([(1, f"a{i}", i, 0.6, None) for i in range(5)] + [(1, "a0", 9, 0.9, None), (1, "b", 10, 0.1, None), (2, None, 1, 0.9, "own")], "k int, address string, o int, look double, name string")
    details = spark.createDataFrame([("a0", "found", 0.9), ("a1", "", 0.2), ("a4", "late", 1.0)], "address string, name string, sure double")
    found = searches.staged(listings, details, "k", "address", ["o"], F.col("look"), 0.5, 3, ["name", "sure"], F.coalesce("sure", "look"), 0.8, searches.by_reason({"no name": F.col("name").isNull()}))
    assert sorted((r.k, r.o, r.name, r.outcome) for r in found.filter("k = 1").na.fill("-").collect()) == [(1, 0, "found", "accepted"), (1, 1, "-", "no name"), (1, 2, "-", "no name"), (1, 3, "-", "detail_limit"), (1, 4, "-", "detail_limit"), (1, 9, "-", "duplicate"), (1, 10, "-", "preliminary")]
    assert [(r.name, r.outcome) for r in found.filter("k = 2").collect()] == [("own", "accepted")]


def test_throttled_stream_does_not_depend_on_its_batches(spark, tmp_path):
    """Rows out of order within the delay, in files of one batch each, with a restart after every one."""
    draw = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = sorted((start + dt.timedelta(minutes=draw.randrange(4000)), i, draw.choice(["a", "b", None])) for i in range(300))
    df = spark.createDataFrame([(k, t, i) for t, i, k in rows], "k string, t timestamp, i int")
    expected = sorted(map(repr, (tuple(r) for r in windows.throttle(df, "k", "t", "i", 60).select("k", "i", "count", "notify").collect())))
    late = sorted(rows, key=lambda r: r[0] + dt.timedelta(minutes=draw.randrange(-20, 20)))
    source = tmp_path / "in"
    for n in range(0, 300, 100):
        spark.createDataFrame([(k, t, i) for t, i, k in late[n : n + 100]], df.schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    found = streams.throttled_to_end(stream, "k", "t", "i", 60, "1 hour")
    assert sorted(map(repr, (tuple(r) for r in found.select("k", "i", "count", "notify").collect()))) == expected


def test_links_of_several_keys_are_counted_once(spark):
    draw = random.Random(8)
    some = lambda n: draw.choice([None, "", *map(str, range(n))])
    left, right = ([(i, some(4), some(3), some(6)) for i in range(120)] for _ in range(2))
    keys, names = [(0, 1), (2,), (1, 2)], "abc"
    df = lambda rows: spark.createDataFrame(rows, "i int, a string, b string, c string")
    found = joins.same_case(df(left), df(right).withColumnRenamed("i", "j"), [[names[c] for c in key] for key in keys], "i", "j")
    agree = lambda x, y: any(all(x[c + 1] not in (None, "") and x[c + 1] == y[c + 1] for c in key) for key in keys)
    expected = [(x[0], len(met), min(met, default=None)) for x in left for met in [[y[0] for y in right if agree(x, y)]]]
    assert sorted(map(tuple, found.collect())) == expected


def test_ids_split_as_a_fold_would(spark):
    """Against rows taken one by one, each compared with all that kept the id."""
    draw = random.Random(12)
    rows = [(i, draw.choice(["p", "q", "", None]), f"n{i}", draw.choice(["", "a", "b"]), draw.choice(["", "", "x", "y"]), draw.choice([None, "1", "2"]), draw.choice([None, None, "3", "4"])) for i in range(300)]
    kept, expected = {}, {}
    for i, pid, _, *values in rows:
        if not pid:
            expected[i] = False
            continue
        held = kept.setdefault(pid, [])
        expected[i] = any(a and b and a != b for other in held for a, b in zip(values, other, strict=True))
        if not expected[i]:
            held.append(values)
    df = spark.createDataFrame(rows, "i int, pid string, m_strong string, m_kind string, m_brand string, m_jan string, m_product_code string").withColumn("m_category", F.lit("c"))
    for f in master.ID_FIELDS:
        if f"m_{f}" not in df.columns:
            df = df.withColumn(f"m_{f}", F.lit(None).cast("string"))
    found = master.split_conflicting_ids(df.repartition(3), "pid", "i").collect()
    assert {r.i: r.split for r in found} == expected and len(found) == 300
