"""Streaming forms: seen keys, windowed de-duplication, throttling, upserts and an outbox."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tallyreef.sources.scratch import scratch


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table as a stream of files; a pattern, since the table may be one file, which a stream does not take by name."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, write it as Parquet, and read it back."""
    spark = stream.sparkSession
    out = scratch(spark, "stream-out")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, whenever it comes; the state holds all keys."""
    return stream.select(*keys).dropDuplicates(keys)


def deduplicated(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """A key once within the delay; older state is dropped by the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


class _Throttle(StatefulProcessor):
    """Rows wait in state until the watermark has passed them, then they are judged in order of time."""

    def __init__(self, gap: int, order_type: str):
        self.gap, self.order_type = gap, order_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.judged = handle.getValueState("judged", "n long, last long")
        self.waiting = handle.getListState("waiting", f"micros long, o {self.order_type}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r["micros"], r["o"]) for r in rows]
        self.waiting.appendList(new)
        # A timer for the earliest new row is enough: what it leaves sets the next one.
        self.handle.registerTimer(min(m for m, _ in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [(m, o) for m, o in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] < passed), key=lambda r: (r[0], r[1] is not None, r[1]))
        if due:
            n, last = self.judged.get() if self.judged.exists() else (0, None)
            for micros, o in due:
                n += 1
                notify = last is None or micros - last >= self.gap
                last = micros if notify else last
                yield Row(k=key[0], o=o, count=n, notify=notify)
            self.judged.update((n, last))
        left = [r for r in rows if r[0] >= passed]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(min(m for m, _ in left) // 1000)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def throttled(stream: DataFrame, key: str, at: str, order: str, minutes: int, delay: str) -> DataFrame:
    """Rows with a running count of their key and whether they are notified: that long since the last notified row.

    Rows are judged by their times, not by when they come: each waits until the watermark,
    ``delay`` behind the latest time seen, has passed it, so any split of rows into batches
    gives what one batch gives. Later rows are dropped. State of a key is one count, one
    time, and the rows that wait. The query needs the RocksDB state store (``with_rocksdb``).
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    rows = stream.select(F.col(key).alias("k"), F.col(at).cast("timestamp").alias("at"), F.col(order).alias("o")).withWatermark("at", delay)
    rows = rows.filter(F.col("at") < F.lit(CLOSING).cast("timestamp")).withColumn("micros", F.unix_micros("at"))
    judged = rows.groupBy("k").transformWithState(_Throttle(max(1, minutes) * 60_000_000, kinds[order]), f"k {kinds[key]}, o {kinds[order]}, count long, notify boolean", "append", "EventTime")
    return judged.select(F.col("k").alias(key), F.col("o").alias(order), "count", "notify")


#: The time of a row that closes a stream: it moves the watermark past all others and is nothing itself.
CLOSING = "9999-01-01 00:00:00"


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def throttled_to_end(stream: DataFrame, key: str, at: str, order: str, minutes: int, delay: str) -> DataFrame:
    """All rows of a stream that has an end, judged: what is there is processed, then a closing row comes and the query goes on from its checkpoint."""
    spark = stream.sparkSession
    folder, out, state = (scratch(spark, f"throttle-{n}") for n in ("closing", "out", "state"))
    shown = stream.select(key, at, order)
    spark.createDataFrame([], shown.schema).write.parquet(folder)
    judged = throttled(shown.unionByName(spark.readStream.schema(shown.schema).parquet(folder)), key, at, order, minutes, delay)
    with with_rocksdb(spark):
        for closing in (False, True):
            if closing:
                end = [F.lit(CLOSING if f.name == at else None).cast(f.dataType).alias(f.name) for f in shown.schema.fields]
                spark.range(1).select(*end).write.mode("append").parquet(folder)
            query = judged.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(judged.schema).parquet(out)


#: Batches after which the merged table is written as a whole.
COMPACT_EVERY = 20


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished ``kind=n`` folders of a path, in any file system that Spark reads."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [status.getPath() for status in files.listStatus(root)]
    done = [p for p in found if p.getName().startswith(f"{kind}=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*").select(*rows.columns)


def merged_table(spark: SparkSession, schema: StructType, key: str, order: str, merge_path: str, before: int | None = None) -> DataFrame:
    """The newest row of each key in the table that upsert_batches keeps at a path, as it was before a batch."""
    held = lambda n: before is None or n < before
    whole = max((n for n in _numbers(spark, merge_path, "whole") if held(n)), default=None)
    parts = [f"{merge_path}/batch={n}" for n in _numbers(spark, merge_path, "batch") if held(n) and (whole is None or n > whole)]
    paths = parts if whole is None else [f"{merge_path}/whole={whole}", *parts]
    return _newest(spark.read.schema(schema).parquet(*paths), key, order) if paths else spark.createDataFrame([], schema)


def upsert_batches(stream: DataFrame, key: str, order: str, merge_path: str, checkpoint: str, mark: Callable[[DataFrame, int], None] | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Newest row of each key over all micro-batches, of this run and of those before it with the same paths.

    A batch adds the newest rows of its own keys under its number and leaves the
    rest of the table alone; every few batches the table is written as a whole. What
    is there is found in storage, so a restart goes on where the checkpoint stands,
    and a batch that runs again writes the same files. ``mark`` gets each batch
    before it counts as done, which delivers at least once.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        if mark is not None:
            mark(batch, number)
        _newest(batch, key, order).write.mode("overwrite").parquet(f"{merge_path}/batch={number}")
        if (number + 1) % compact_every == 0:
            merged_table(spark, stream.schema, key, order, merge_path, number + 1).write.mode("overwrite").parquet(f"{merge_path}/whole={number}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return merged_table(spark, stream.schema, key, order, merge_path)
