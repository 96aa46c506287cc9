"""A store of versioned tables: tasks write files of their own, and one rename makes all of them the current version.

A folder holds ``data`` with Parquet files that are never changed, and ``current.json``,
which names the files of each table. Writing puts new files beside the old ones; the
driver then replaces ``current.json`` in one step. Until that, and for ever if the job
fails, readers see the version before; files of a failed job are removed. A job that
began on another version than it ends on is refused, so no update is lost.

Any file system that pyarrow reaches will do, as long as driver and executors share it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

CURRENT = "current.json"


class StaleVersion(RuntimeError):
    """The store has moved on since the job began."""


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def manifest(path: str) -> dict:
    """The current version: its number and, by table, files, schema and rows; version 0 where nothing was written yet."""
    files, root = _opened(path)
    at = f"{root}/{CURRENT}"
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return {"version": 0, "tables": {}}
    with files.open_input_stream(at) as f:
        return json.loads(f.read())


def _publish(path: str, began: int, tables: dict[str, dict]) -> int:
    """Make the tables current, with all others as they stand."""
    files, root = _opened(path)
    now = manifest(path)
    if now["version"] != began:
        raise StaleVersion(f"version {began} was read, {now['version']} is current")
    new = {"version": began + 1, "tables": now["tables"] | tables}
    staged = f"{root}/{CURRENT}.{uuid.uuid4().hex}"
    with files.open_output_stream(staged) as f:
        f.write(json.dumps(new, ensure_ascii=False, indent=1).encode())
    files.move(staged, f"{root}/{CURRENT}")
    return began + 1


def _remove(path: str, batch: str) -> None:
    files, root = _opened(path)
    for info in files.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)):
        if info.base_name.startswith(batch):
            files.delete_file(info.path)


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


class _StagedWriter(DataSourceArrowWriter):
    """Files of one table; with a batch given, the files wait for ``publish`` of that batch."""

    def __init__(self, path: str, table: str, schema: StructType, batch: str | None):
        self.path, self.table, self.schema, self.waits = path, table, schema, batch is not None
        self.batch = f"{batch or uuid.uuid4().hex}-{table}"
        self.began = manifest(path)["version"]
        files, root = _opened(path)
        files.create_dir(f"{root}/data", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _opened(self.path)
        name, rows, out = f"data/{self.batch}-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if batch.num_rows:
                    out = out or pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=files)
                    out.write_batch(batch)
                    rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return _Written(name if rows else None, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [m for m in messages if m is not None]
        entry = {"files": sorted(m.file for m in done if m.file), "schema": self.schema.jsonValue(), "rows": sum(m.rows for m in done)}
        if self.waits:
            files, root = _opened(self.path)
            with files.open_output_stream(f"{root}/data/{self.batch}.staged.json") as f:
                f.write(json.dumps(entry).encode())
        else:
            try:
                _publish(self.path, self.began, {self.table: entry})
            except StaleVersion:
                _remove(self.path, self.batch)
                raise

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        # Tasks that failed have sent no message; their files have the batch's name as well.
        _remove(self.path, self.batch)


class StagedSource(DataSource):
    """Sink ``staged``: options path, table, and batch for files that a later ``publish`` makes current."""

    @classmethod
    def name(cls) -> str:
        return "staged"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("a table of the store is written whole: use mode overwrite")
        return _StagedWriter(self.options["path"], self.options["table"], schema, self.options.get("batch"))


def _write(df: DataFrame, path: str, table: str, batch: str | None) -> None:
    df.sparkSession.dataSource.register(StagedSource)
    writer = df.write.format("staged").mode("overwrite").option("path", path).option("table", table)
    (writer.option("batch", batch) if batch else writer).save()


def write(df: DataFrame, path: str, table: str) -> None:
    """Make the rows of df the table's current version."""
    _write(df, path, table, None)


def write_all(tables: dict[str, DataFrame], path: str, began: int | None = None) -> int:
    """Make the rows of several frames current at once, or none of them; ``began`` is the version that they were worked out from."""
    began = manifest(path)["version"] if began is None else began
    batch = uuid.uuid4().hex
    files, root = _opened(path)
    try:
        entries = {}
        for name, df in tables.items():
            _write(df, path, name, batch)
            at = f"{root}/data/{batch}-{name}.staged.json"
            with files.open_input_stream(at) as f:
                entries[name] = json.loads(f.read())
            files.delete_file(at)
        return _publish(path, began, entries)
    except BaseException:
        _remove(path, batch)
        raise


def read(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """The table's current version; None where it was never written. The files are fixed now, whatever is written later."""
    entry = manifest(path)["tables"].get(table)
    if entry is None:
        return None
    schema = StructType.fromJson(entry["schema"])
    if not entry["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in entry["files"]])


def vacuum(path: str) -> int:
    """Remove files that the current version does not name; only while no one writes or reads an older one."""
    files, root = _opened(path)
    named = {f for t in manifest(path)["tables"].values() for f in t["files"]}
    old = [i for i in files.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if f"data/{i.base_name}" not in named]
    for info in old:
        files.delete_file(info.path)
    return len(old)
