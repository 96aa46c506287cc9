"""Queries that write files from the tables, read them back with the library's sources, and hold what the sinks leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tallyreef.functions import money, text
from tallyreef.sources import sinks, tables
from tallyreef.sources.scratch import scratch
from tallyreef.sources.tables import table

NOW = "2024-01-20 12:00:00"


def _lines(df: DataFrame, value: Column, name: str) -> str:
    """Write one line a row as text files; their folder."""
    path = scratch(df.sparkSession, name)
    df.select(value.alias("value")).write.text(path)
    return path


def _told(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _told_counts(spark: SparkSession, counts: dict[str, int | str]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in counts.items()], "what string, told string")


def json_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as JSON records, those in debt broken: the valid ones, with the broken ones counted and the state of the files."""
    c = table(spark, sf, "customer")
    record = F.when(F.col("c_acctbal") < 0, _told('{"id": ', F.col("c_custkey"), ', "name": ')).otherwise(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))))
    schema = StructType().add("id", LongType()).add("name", StringType())
    path = _lines(c, record, "json")
    good, bad = tables.json_rows(spark, f"{path}/*.txt", schema, multi_line=False)
    state, missing = tables.json_state(good, bad), tables.file_state(spark, f"{path}/none.json", schema)
    gone = tables.file_state(spark, f"{path}/none.json", schema, path)
    return good.select("id", "name", F.lit(state).alias("state"), F.lit(missing).alias("missing"), F.lit(gone).alias("gone"), F.lit(bad.count()).alias("broken"))


def feed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds of customers with their orders as entries, half of them as sitemaps: the first ten addresses of each."""
    o = table(spark, sf, "orders")
    site = F.col("c") % 2 == 1
    address = _told("https://Shop.example/o/", F.floor(F.col("o_orderkey") / 3), "#top")
    entry = F.when(F.col("o_custkey") % 2 == 1, _told("<url><loc>", address, "</loc><lastmod>", F.col("o_orderdate").cast("date"), "</lastmod></url>")).otherwise(_told("<item><title><![CDATA[", F.col("o_orderpriority"), "]]></title><link> ", address, " </link><dc:pubDate>", F.col("o_orderdate").cast("date"), "</dc:pubDate></item>"))
    feeds = o.select(F.col("o_custkey").alias("c"), F.struct("o_orderkey", entry.alias("e")).alias("x")).groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), "\n").alias("body"))
    feeds = feeds.select("c", F.when(site, _told("<urlset>", F.col("body"), "</urlset>")).otherwise(_told("<rss xmlns:dc='d'><channel>", F.col("body"), "</channel></rss>")).alias("xml"))
    return tables.feed_items(feeds, "xml", "c").select("c", "ord", "link", "title", "published")


def recent_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as posts: those after the last one read, and, where none was read yet, those of the last days, with their accounts."""
    posts = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("user"), F.col("ts").cast("timestamp_ntz").alias("at"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user"), F.col("c_name").alias("name"))
    now = F.lit(NOW).cast("timestamp_ntz")
    last = posts.agg(F.floor(F.max(F.col("id").cast("long")) * 0.9)).first()[0]
    new, first = (tables.recent_posts(posts, users, "id", "user", "at", since, now) for since in (last, None))
    return new.select(F.lit("new").alias("how"), "id", "name").unionByName(first.select(F.lit("first").alias("how"), "id", "name"))


def plugin_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as a folder of plugin definitions, a file for each nation: rows in order with what they lack."""
    s = table(spark, sf, "supplier")
    one = F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_acctbal") > 0, _told("https://x.example/", F.col("s_suppkey"))).alias("url")))
    files = s.select("s_nationkey", F.struct("s_suppkey", one.alias("d")).alias("x")).groupBy("s_nationkey").agg(_told("[", F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), ","), "]").alias("value"))
    path = scratch(spark, "plugins")
    files.write.partitionBy("s_nationkey").text(path)
    # A glob of folders reads all files; each nation has one.
    found = tables.plugin_rows(spark, f"{path}/*", StructType().add("id", StringType()).add("url", StringType()), ["id", "url"], pattern="*.txt")
    return found.select("ord", "error", "id", "url")


def log_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log lines: the INFO level leaves out lines that are errors only; and lines with a word, counted."""
    e = table(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", F.when(F.col("value") > 50, "ERROR").otherwise("INFO ERROR")).when(F.col("event_type") == "click", "WARNING").otherwise("INFO")
    path = _lines(e, _told(F.col("event_id"), " ", level, " user ", F.col("user_id"), " ", F.col("event_type")), "logs")
    out = None
    for name, found in (("INFO", tables.log_lines(spark, path, level="INFO")), ("ERROR", tables.log_lines(spark, path, level="ERROR")), ("word", tables.log_lines(spark, path, word="Click"))):
        counted = found.groupBy(F.lit(name).alias("filter"), F.regexp_extract("line", r"^\d+ ([A-Z ]+[A-Z]) ", 1).alias("level")).agg(F.count("*").alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


def versioned_stores(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as a catalog of the present version, what they leave open filled from the defaults; other versions and repeated keys are refused."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(2).alias("version"), F.when(F.col("s_nationkey") > 10, F.col("s_name")).alias("name"))
    defaults = table(spark, sf, "nation").filter("n_nationkey = 0").select(F.col("n_name").alias("name"))
    refused = 0
    for wrong in (rows.unionByName(rows), rows.withColumn("version", F.when(F.col("id") == 0, 1).otherwise(2))):
        try:
            tables.versioned_catalog(wrong, defaults, "id", "version", 2)
        except ValueError:
            refused += 1
    return tables.versioned_catalog(rows, defaults, "id", "version", 2).select("id", "name", F.lit(refused).alias("refused"))


def sink_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What guarded, repaired, changed and merged writes leave, told as counts and refusals."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    path, other, repaired, merged = (scratch(spark, f"sink-{n}") for n in ("table", "other", "repaired", "merged"))
    counts: dict[str, int | str] = {}

    def refused(write) -> str:
        try:
            write()
        except ValueError:
            return "refused"
        return "written"

    counts["guarded"] = refused(lambda: sinks.guarded_overwrite(c, path, ["k"]))
    counts["guarded twice the rows"] = refused(lambda: sinks.guarded_overwrite(c.unionByName(c), path, ["k"]))
    counts["after the refusal"] = spark.read.parquet(path).count()
    counts["unchanged"] = str(sinks.write_if_changed(c, other, spark.read.parquet(path))).lower()
    counts["changed"] = str(sinks.write_if_changed(c.filter("segment <> 'BUILDING'"), other, spark.read.parquet(path))).lower()
    counts["changed rows"] = spark.read.parquet(other).count()
    counts["repaired"] = sinks.repaired_overwrite(c.unionByName(c), repaired, ["k"], "k")
    counts["restored from nothing"] = str(sinks.restore(spark, path, repaired, c.schema, ["k"])).lower()
    new = c.filter("segment = 'MACHINERY'").select((F.col("k") + 1_000_000).alias("k"), F.upper("name").alias("name"), "segment")
    sinks.merge_write(spark, path, new, ["name"], "k", None, merged)
    held = spark.read.parquet(merged)
    counts["merged"], counts["merged in capitals"] = held.count(), held.filter("name = upper(name)").count()
    return _told_counts(spark, counts)


def account_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers as accounts: the newest of each name and nation, whatever the case; and without those that are deleted."""
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("tcg"), F.col("c_custkey").alias("at"))
    s = table(spark, sf, "supplier").select(F.regexp_replace(F.upper("s_name"), "SUPPLIER", "CUSTOMER").alias("name"), F.col("s_nationkey").alias("tcg"), (F.col("s_suppkey") + 10_000_000).alias("at"))
    merged = sinks.upsert_newest(c, s, ["name", "tcg"], "at")
    left, excluded = sinks.remove_keys(merged, merged.filter("at % 5 = 0"), ["name", "tcg"], c.limit(0).select("name", "tcg"))
    return left.withColumn("excluded", F.lit(excluded.count()))


def hashed_results(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as results put into a table of earlier ones: by id, which is a hash of customer and priority; the last of an id counts, and keeps the place of the one that it replaces."""
    o = table(spark, sf, "orders").select(F.lit("").alias("id"), "o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_orderkey").alias("ord"))
    middle = o.agg(F.floor(F.max("ord") / 2)).first()[0]
    empty = o.limit(0).select("id", "o_custkey", "o_orderpriority", "o_orderstatus", F.col("ord").alias("place"))
    first = sinks.upsert_hashed(empty, o.filter(F.col("ord") <= middle), ["o_custkey", "o_orderpriority"], "ord")
    held = first.select("id", "o_custkey", "o_orderpriority", "o_orderstatus", F.col("place.at").alias("place"))
    done = sinks.upsert_hashed(held, o.filter(F.col("ord") > middle), ["o_custkey", "o_orderpriority"], "ord")
    return done.select("id", "o_custkey", "o_orderpriority", "o_orderstatus", F.col("place.added").alias("added"), F.col("place.at").alias("place"))


def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """Customers exported as CSV and read back: flags are labels, texts are whole."""
    path = scratch(spark, "csv")
    c = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("name"), (F.col("c_acctbal") > 0).alias("solvent"))
    sinks.export_csv(c, path, ("済", "未"))
    return spark.read.option("header", True).option("escape", '"').csv(path)


def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the form in which texts are compared, as length and digest; and names that another code page garbled, put right."""
    d = table(spark, sf, "documents").select("doc_id", text.search_text(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t")).alias("digest"))


def ordered_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The first price of three fields of an offer, and the sale price, which stops at the first field that is there."""
    shown = F.when(F.col("l_tax") > 0.04, F.concat(F.format_number(F.floor("l_extendedprice"), 0), F.lit("円"))).when(F.col("l_tax") > 0.02, "未定")
    second, third = F.when(F.col("l_discount") > 0.05, F.floor("l_quantity").cast("string")), F.col("l_partkey").cast("string")
    line = table(spark, sf, "lineitem")
    return line.groupBy("l_suppkey").agg(F.sum(money.reference_price(shown, second, third)).alias("reference"), F.sum(money.sale_price(shown, second)).alias("sale"), F.count(money.sale_price(shown, second)).alias("n"))


def version_order(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as versions, with the numbers that they sort by: candidates come before the release of the same number."""
    p = table(spark, sf, "part").select("p_partkey", _told(F.col("p_size"), ".", F.col("p_partkey") % 7, ".0", F.when(F.col("p_type") == "PROMO", _told(" RC", F.col("p_partkey") % 13)).otherwise("")).alias("v"))
    return p.groupBy("v").agg(F.count("*").alias("n")).withColumn("o", text.version_order(F.col("v"))).select("v", "n", "o.*")


QUERIES = {f.__name__: f for f in (json_scan, feed_entries, recent_posts, plugin_folder, log_scan, versioned_stores, sink_outcomes, account_upserts, hashed_results, csv_export, text_forms, ordered_prices, version_order)}

ORACLE_SQL = {
    "json_scan": "SELECT c_custkey AS id, c_name AS name, CASE WHEN b > 0 THEN 'corrupt' ELSE 'valid' END AS state, 'missing' AS missing, 'corrupt' AS gone, b AS broken FROM customer, (SELECT count_if(c_acctbal < 0) AS b FROM customer) WHERE c_acctbal >= 0",
    "feed_entries": """WITH x AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, 'https://shop.example/o/' || (o_orderkey // 3) AS link, CASE WHEN o_custkey % 2 = 1 THEN '' ELSE o_orderpriority END AS title, o_orderdate::DATE::VARCHAR AS published FROM orders),
        y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY c, link ORDER BY ord) = 1) SELECT c, ord::INT AS ord, link, title, published FROM y QUALIFY row_number() OVER (PARTITION BY c ORDER BY ord) <= 10""",
    "recent_posts": f"""WITH n AS (SELECT floor(max(event_id) * 0.9) AS last FROM events), p AS (SELECT event_id, ts, c_name AS name FROM events LEFT JOIN customer ON c_custkey = user_id)
        SELECT 'new' AS how, event_id::VARCHAR AS id, name FROM p, n WHERE event_id > last UNION ALL SELECT 'first', event_id::VARCHAR, name FROM p WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY""",
    "plugin_folder": "SELECT (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS ord, CASE WHEN s_acctbal > 0 THEN '' ELSE 'missing: url' END AS error, s_suppkey::VARCHAR AS id, CASE WHEN s_acctbal > 0 THEN 'https://x.example/' || s_suppkey END AS url FROM supplier",
    "log_scan": """WITH x AS (SELECT CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'ERROR' ELSE 'INFO ERROR' END WHEN event_type = 'click' THEN 'WARNING' ELSE 'INFO' END AS level, event_type FROM events)
        SELECT 'INFO' AS filter, level, count(*) AS n FROM x WHERE level <> 'ERROR' GROUP BY 2 UNION ALL SELECT 'ERROR', level, count(*) FROM x WHERE contains(level, 'ERROR') GROUP BY 2 UNION ALL SELECT 'word', level, count(*) FROM x WHERE event_type = 'click' GROUP BY 2""",
    "versioned_stores": "SELECT s_suppkey AS id, CASE WHEN s_nationkey > 10 THEN s_name ELSE (SELECT n_name FROM nation WHERE n_nationkey = 0) END AS name, 2 AS refused FROM supplier",
    "sink_outcomes": """WITH n AS (SELECT count(*) AS n, count_if(c_mktsegment <> 'BUILDING') AS b, count_if(c_mktsegment = 'MACHINERY') AS m FROM customer)
        SELECT 'guarded' AS what, 'written' AS told UNION ALL SELECT 'guarded twice the rows', 'refused' UNION ALL SELECT 'unchanged', 'false' UNION ALL SELECT 'changed', 'true' UNION ALL SELECT 'restored from nothing', 'true'
        UNION ALL SELECT 'after the refusal', n::VARCHAR FROM n UNION ALL SELECT 'changed rows', b::VARCHAR FROM n UNION ALL SELECT 'repaired', n::VARCHAR FROM n UNION ALL SELECT 'merged', n::VARCHAR FROM n UNION ALL SELECT 'merged in capitals', m::VARCHAR FROM n""",
    "account_upserts": """WITH a AS (SELECT c_name AS name, c_nationkey AS tcg, c_custkey AS at_ FROM customer UNION ALL SELECT replace(upper(s_name), 'SUPPLIER', 'CUSTOMER'), s_nationkey, s_suppkey + 10000000 FROM supplier),
        m AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY lower(name), tcg ORDER BY at_ DESC) = 1) SELECT m.name, m.tcg, m.at_ AS at, (SELECT count(*) FROM (SELECT DISTINCT name, tcg FROM m WHERE at_ % 5 = 0)) AS excluded FROM m WHERE at_ % 5 <> 0""",
    "hashed_results": """WITH m AS (SELECT floor(max(o_orderkey) / 2) AS m FROM orders) SELECT left(sha256(o_custkey || '|' || o_orderpriority), 16) AS id, o_custkey, o_orderpriority, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, min(o_orderkey) > any_value(m) AS added, min(o_orderkey) AS place FROM orders, m GROUP BY o_custkey, o_orderpriority""",
    "csv_export": "SELECT c_custkey::VARCHAR AS c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS name, CASE WHEN c_acctbal > 0 THEN '済' ELSE '未' END AS solvent FROM customer",
    "text_forms": "WITH x AS (SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\s\\x0B]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM x",
    "version_order": "WITH x AS (SELECT p_size, p_partkey % 7 AS minor, CASE WHEN p_type = 'PROMO' THEN p_partkey % 13 END AS rc FROM part) SELECT p_size || '.' || minor || '.0' || CASE WHEN rc IS NOT NULL THEN ' RC' || rc ELSE '' END AS v, count(*) AS n, p_size::INT AS major, minor::INT AS minor, 0 AS patch, coalesce(rc, 1073741824)::INT AS candidate FROM x GROUP BY ALL",
    "ordered_prices": """WITH x AS (SELECT l_suppkey, CASE WHEN l_tax > 0.04 THEN floor(l_extendedprice)::BIGINT END AS a, l_tax > 0.02 AS there, CASE WHEN l_discount > 0.05 THEN floor(l_quantity)::BIGINT END AS b, nullif(l_partkey, 0) AS c FROM lineitem)
        SELECT l_suppkey, sum(coalesce(a, b, c))::BIGINT AS reference, sum(CASE WHEN there THEN a ELSE b END)::BIGINT AS sale, count(CASE WHEN there THEN a ELSE b END) AS n FROM x GROUP BY 1""",
}
