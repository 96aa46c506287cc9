"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Code points that separate words in every contract of this subpackage; the same set that ``bytes.split()`` uses.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of df has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: bytes are split at ASCII white space only."""
    return utf8(text).split()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    It is only set here, to a temporary folder, where it is unset and Spark runs
    in one process (tests); on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallyreef-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_mod(column: Column, divisor: int) -> Column:
    """crc32(id as text) mod divisor: the fold that marks held-out rows; null ids fall in fold 0."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(divisor)), F.lit(0))


def in_sample(salt: str, key: Column, wanted: int, rows: int) -> Column:
    """Whether a row is among about ``wanted`` of ``rows``, by hash of its key; all rows where they are no more.

    The hash is cut to 53 bits, so the share taken does not fall to nothing
    before there are ``wanted`` times 2^53 rows.
    """
    if rows <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 53)) < F.lit(max(1, (wanted << 53) // rows))


def running_totals(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` over rows of a small bounded group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))
