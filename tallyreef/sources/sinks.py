"""Sinks: guarded overwrite, write on change, keyed appends, CSV export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def differs(a: DataFrame, b: DataFrame) -> bool:
    """The tables hold other rows, or rows another number of times."""
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        return True
    counted = [df.select(*columns).withColumn("__side", F.lit(side)) for df, side in ((a, 1), (b, -1))]
    return not counted[0].union(counted[1]).groupBy(*columns).agg(F.sum("__side").alias("n")).filter("n <> 0").isEmpty()


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def guarded_overwrite(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Overwrite as Parquet, but never with rows that repeat a key or lack one."""
    broken = df.filter(" or ".join(f"`{k}` is null" for k in key))
    if not broken.isEmpty() or not duplicates(df, key).isEmpty():
        raise ValueError(f"rows repeat or lack a key of {list(key)}; nothing is written")
    df.write.mode("overwrite").parquet(path)


def write_if_changed(df: DataFrame, path: str, current: DataFrame | None) -> bool:
    """Write to a new path if the rows differ from the current table."""
    if current is not None and not differs(df, current):
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def append_new(current: DataFrame, incoming: DataFrame, key: str, newest: str, keep: int, ties: Sequence[str] = ()) -> DataFrame:
    """Rows whose key is not there are added once; the newest ``keep`` remain."""
    first = Window.partitionBy(key).orderBy(newest, *ties)
    once = incoming.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")
    fresh = once.join(current.select(key), key, "left_anti")
    return current.unionByName(fresh.select(*current.columns)).orderBy(F.desc(newest), *ties).limit(keep)


def replace_by_key(current: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows replace those of equal key."""
    return current.join(incoming.select(*key).distinct(), list(key), "left_anti").unionByName(incoming.select(*current.columns))


def upsert_newest(current: DataFrame, incoming: DataFrame, key: Sequence[str], newest: str, keep: int | None = None) -> DataFrame:
    """The newest row of each key, compared without case where it is text; the newest ``keep`` of all, if that is given."""
    both = current.unionByName(incoming.select(*current.columns))
    kinds = dict(current.dtypes)
    parts = [F.lower(k) if kinds[k] == "string" else F.col(k) for k in key]
    latest = Window.partitionBy(*parts).orderBy(F.desc(newest))
    once = both.withColumn("__r", F.row_number().over(latest)).filter("__r = 1").drop("__r")
    return once if keep is None else once.orderBy(F.desc(newest), *key).limit(keep)


def upsert_hashed(current: DataFrame, incoming: DataFrame, parts: Sequence[str], order: str, id_col: str = "id", length: int = 16) -> DataFrame:
    """The table after incoming rows replace those of their id, in place, or come after all others; an id is a hash of parts where a row has none.

    ``place`` is the row's place: that of the row it replaces, else after the last by ``order``; the last incoming row of an id counts.
    """
    made = F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, length)
    named = incoming.withColumn(id_col, F.coalesce(F.nullif(F.col(id_col), F.lit("")), made))
    rest = [c for c in named.columns if c not in (id_col, order)]
    last = named.groupBy(id_col).agg(F.max_by(F.struct(*rest), order).alias("new"), F.min(order).alias("__at"))
    old = current.select(id_col, "place", F.struct(*rest).alias("old"))
    both = old.join(last, id_col, "full_outer")
    return both.select(id_col, F.coalesce("new", "old").alias("x"), F.struct(F.col("place").isNull().alias("added"), F.coalesce("place", "__at").alias("at")).alias("place")).select(id_col, "x.*", "place")


def remove_keys(current: DataFrame, gone: DataFrame, key: Sequence[str], excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the exclusion list with the keys of those that went."""
    return current.join(gone.select(*key).distinct(), list(key), "left_anti"), excluded.select(*key).union(gone.select(*key)).distinct()


def repaired_overwrite(df: DataFrame, path: str, key: Sequence[str], order: str) -> int:
    """Overwrite after rows that repeat a key alike are dropped; an error if they differ. Returns how many were dropped."""
    rest = [c for c in df.columns if c not in key and c != order]
    differing = df.groupBy(*key).agg(F.count_distinct(F.struct(*rest)).alias("n")).filter("n > 1") if rest else df.limit(0)
    if not differing.isEmpty():
        raise ValueError(f"rows of one {list(key)} differ; nothing is written")
    once = df.groupBy(*key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("x")).select(*key, "x.*").select(*df.columns)
    dropped = df.count() - once.count()
    guarded_overwrite(once, path, key)
    return dropped


def export_csv(df: DataFrame, path: str, labels: tuple[str, str] = ("yes", "no"), mark: bool = False) -> None:
    """CSV with a header, quotes within values doubled; booleans are written as labels. ``mark`` puts a byte order mark before each file's header, as spreadsheets want it."""
    shown = [F.when(F.col(f"`{n}`"), labels[0]).otherwise(labels[1]).alias(n) if kind == "boolean" else F.col(f"`{n}`") for n, kind in df.dtypes]
    if mark:
        shown[0] = shown[0].alias("\ufeff" + df.columns[0])
    df.select(*shown).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def restore(spark: SparkSession, path: str, backup: str, schema: StructType, key: Sequence[str]) -> bool:
    """Put the backup in place of a table, if it can be read, has rows, and no key is missing or there twice."""
    held = spark.read.schema(schema).parquet(backup)
    if held.isEmpty():
        return False
    guarded_overwrite(held, path, key)
    return True


def merge_write(spark: SparkSession, path: str, incoming: DataFrame, key: Sequence[str], newest: str, keep: int | None, target: str) -> None:
    """Read, merge and write: incoming rows join those of a table and the newest of each key are written to the target; a table that cannot be read stops it."""
    upsert_newest(spark.read.schema(incoming.schema).option("mode", "FAILFAST").parquet(path), incoming, key, newest, keep).write.mode("errorifexists").parquet(target)
