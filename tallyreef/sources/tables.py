"""Scans: parquet tables, validated JSON, feeds, logs, plugin folders."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tallyreef.functions.urls import article_url as canonical

BAD = "_bad"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_rows(spark: SparkSession, path: str, schema: StructType, *, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined records of JSON files; a byte order mark is tolerated."""
    read = spark.read.schema(StructType([*schema.fields]).add(BAD, "string")).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    read = read.withColumn("file", F.input_file_name())
    # A record is bad as a whole or not; asking for all columns keeps Spark from reading the mark alone, which it refuses.
    marked = read.withColumn("__all", F.to_json(F.struct(*[f.name for f in schema.fields])))
    return read.filter(F.col(BAD).isNull()).drop(BAD), marked.filter(F.col(BAD).isNotNull() & F.col("__all").isNotNull()).select("file", BAD)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def file_state(spark: SparkSession, path: str, schema: StructType, backup: str | None = None) -> str:
    """missing, corrupt, valid_empty or valid; a file that is gone while its backup is there counts as corrupt."""
    if not exists(spark, path):
        return "corrupt" if backup is not None and exists(spark, backup) else "missing"
    return json_state(*json_rows(spark, path, schema))


def json_state(valid: DataFrame, bad: DataFrame) -> str:
    """corrupt, valid_empty or valid, for a path that is there."""
    if not bad.isEmpty():
        return "corrupt"
    return "valid" if valid.take(1) else "valid_empty"


def with_defaults(stored: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """Stored rows win, missing keys are filled from defaults, and missing rows are appended."""
    columns = [c for c in defaults.columns if c != key]
    return stored.alias("s").join(defaults.alias("d"), key, "full_outer").select(key, *[F.coalesce(F.col(f"s.{c}"), F.col(f"d.{c}")).alias(c) for c in columns])


def missing_defaults(stored: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """Stored rows and those defaults whose key is not stored."""
    return stored.unionByName(defaults.join(stored.select(key).distinct(), key, "left_anti").select(*stored.columns))


def feed_items(feeds: DataFrame, xml: str = "xml", key: str = "url", most: int = 10) -> DataFrame:
    """key, ord, link (canonical), title, published of feed or sitemap entries, distinct by link, the first of each feed.

    Entries are cut by their tags, so namespaces and prefixes do not matter.
    """
    entries = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)(<(?:item|entry|url)\b.*?</(?:item|entry|url)>)"), F.lit(1))
    part = lambda names: F.trim(F.regexp_replace(F.regexp_extract("entry", rf"(?is)<(?:\w+:)?(?:{names})\b[^>]*>(.*?)</", 1), r"<!\[CDATA\[|\]\]>", ""))
    rows = feeds.select(key, F.posexplode(entries).alias("ord", "entry")).select(key, "ord", part("link|loc").alias("link"), part("title").alias("title"), part("pubDate|lastmod|published").alias("published"))
    first = Window.partitionBy(key, "link").orderBy("ord")
    place = Window.partitionBy(key).orderBy("ord")
    rows = rows.withColumn("link", canonical(F.col("link"))).filter("link <> ''").withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")
    return rows.withColumn("__p", F.row_number().over(place)).filter(F.col("__p") <= most).drop("__p")


def versioned_catalog(rows: DataFrame, defaults: DataFrame, key: str, version: str, current: int) -> DataFrame:
    """Rows of the present version with defaults for what they leave open; an error if another version or a key twice is there."""
    wrong = rows.filter(~F.col(version).eqNullSafe(F.lit(current))).limit(1).count()
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1 or " + f"`{key}` is null").limit(1).count()
    if wrong or twice:
        raise ValueError("the catalog has another version, or a key is missing or there twice")
    first = defaults.limit(1).select(*[F.col(c).alias(f"__{c}") for c in defaults.columns])
    return rows.join(F.broadcast(first)).select(*[F.coalesce(c, f"__{c}").alias(c) if c in defaults.columns else F.col(c) for c in rows.columns])


def plugin_rows(spark: SparkSession, folder: str, schema: StructType, required: list[str], pattern: str = "*.json") -> DataFrame:
    """Definitions of all JSON files of a folder, one object or an array each, in order of file name, with ``error`` for those that lack a required field or are none."""
    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in schema.fields)
    files = spark.read.text(f"{folder}/{pattern}", wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body"))
    listed = F.when(F.trim("body").startswith("["), F.from_json("body", f"array<struct<{fields}>>")).otherwise(F.array(F.from_json("body", f"struct<{fields}>")))
    rows = files.select("file", F.posexplode_outer(listed).alias("ord", "x"))
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(f"x.{f}").cast("string")), F.lit("")) == "", F.lit(f)) for f in required]))
    error = F.when(F.col("x").isNull(), "no definition").when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ","))).otherwise("")
    return rows.select("file", F.coalesce("ord", F.lit(0)).alias("ord"), error.alias("error"), "x.*").orderBy("file", "ord")


def recent_posts(posts: DataFrame, users: DataFrame, id_col: str, user_col: str, at: str, last_id: int | None, now, days: int = 7) -> DataFrame:
    """Posts after the last one read, or of the last days where none was read yet, with their users' columns."""
    new = since(posts, id_col, last_id) if last_id is not None else posts.filter(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))
    return new.join(users, user_col, "left")


def inventory(catalog: DataFrame, plugins: DataFrame, key: str, category: str, wanted: str | None = None) -> DataFrame:
    """Sources with the plugin of their id, those that support a category; ``class`` tells what reads them."""
    out = catalog if wanted is None else catalog.filter(F.array_contains(category, wanted))
    joined = out.join(plugins.select(key, F.lit(True).alias("__plugin")), key, "left")
    return joined.withColumn("class", F.when(F.col("__plugin"), "plugin").otherwise("manual")).drop("__plugin")


class PluginSource(DataSource):
    """Rows of Python plugins: ``plugins`` names callables as module:function, comma-separated; each is one task and yields rows of the schema."""

    @classmethod
    def name(cls) -> str:
        return "plugin"

    def schema(self) -> str:
        return "plugin string, name string, url string, category string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PluginReader(self.options["plugins"].split(","), self.options.get("category", ""))


class _PluginReader(DataSourceReader):
    def __init__(self, plugins: list[str], category: str):
        self.plugins, self.category = plugins, category

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.plugins]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, function = partition.value.split(":")
        for row in getattr(importlib.import_module(module), function)():
            if not self.category or row["category"] == self.category:
                yield partition.value, row["name"], row["url"], row["category"]


def log_lines(spark: SparkSession, path: str, word: str = "", level: str = "") -> DataFrame:
    """Lines of text logs with file and time of change; the INFO level drops only lines that are errors and not information."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("changed"), F.col("value").alias("line"))
    if word:
        lines = lines.filter(F.lower("line").contains(word.lower()))
    if level == "INFO":
        return lines.filter(~(F.col("line").contains("ERROR") & ~F.col("line").contains("INFO")))
    return lines.filter(F.col("line").contains(level)) if level else lines


def api_items(responses: DataFrame, body: str, schema: str, required: list[str], kinds_out: list[str], kind: str = "type") -> DataFrame:
    """Items of JSON responses that have all required fields and are of no excluded kind."""
    items = responses.select(F.explode(F.from_json(body, f"array<{schema}>")).alias("x")).select("x.*")
    for field in required:
        items = items.filter(F.coalesce(F.col(field).cast("string"), F.lit("")) != "")
    return items.filter(~F.coalesce(F.col(kind).isin(*kinds_out), F.lit(False))) if kinds_out else items


def since(posts: DataFrame, id_col: str, last_id: int | None) -> DataFrame:
    """Posts after the last one read; ids compare as numbers."""
    number = F.col(id_col).try_cast("decimal(38,0)")
    return posts if last_id is None else posts.filter(number > F.lit(last_id).cast("decimal(38,0)"))
