"""Files written by tasks: a folder of files, or the ordered parts of one text, that appears whole or not at all.

Tasks write into a temporary folder beside the target, which the commit renames; an attempt that is
repeated writes the same names again.  Paths are URIs of any file system that pyarrow knows, in a
place that driver and executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from ..functions import scalars
from . import scratch


class _FolderWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.work = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.header = options.get("header")

    def _put(self, name: str, chunks: Iterator[bytes]) -> None:
        """A file of the temporary folder, under its name only when it is whole."""
        fs, folder = pafs.FileSystem.from_uri(self.work)
        fs.create_dir(folder, recursive=True)
        attempt = f"{folder}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(attempt) as out:
            for c in chunks:
                out.write(c)
        fs.move(attempt, f"{folder}/{name}")

    def commit(self, messages: list) -> None:
        fs, folder = pafs.FileSystem.from_uri(self.work)
        fs.create_dir(folder, recursive=True)
        fs.move(folder, pafs.FileSystem.from_uri(self.path)[1])

    def abort(self, messages: list) -> None:
        fs, folder = pafs.FileSystem.from_uri(self.work)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


class _BlobWriter(_FolderWriter):
    def write(self, iterator: Iterator) -> WriterCommitMessage:
        for row in iterator:
            self._put(row.name, [bytes(row.content)])
        return WriterCommitMessage()


class _LinesWriter(_FolderWriter, DataSourceArrowWriter):
    """Every line comes with the break before it, so that none follows the last one."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        chunks = ("\r\n".join(["", *b.column(0).to_pylist()]).encode() for b in iterator if len(b))
        self._put(f"part-{TaskContext.get().partitionId() + 1:06d}", chunks)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        self._put("part-000000", [self.header.encode()])
        super().commit(messages)


class BlobFolder(DataSource):
    """Sink of rows (name, content): a file each."""

    @classmethod
    def name(cls) -> str:
        return "blob_folder"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BlobWriter(self.options)


class OrderedLines(DataSource):
    """Sink of rows (line) in the order of their partitions: one text in numbered parts, the header in the first."""

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LinesWriter(self.options)


def write_files(rows: DataFrame, path: str) -> None:
    """A new folder `path` with a file for each row (name, content); names are distinct."""
    rows.sparkSession.dataSource.register(BlobFolder)
    rows.select("name", "content").write.format("blob_folder").mode("append").save(path)


def write_csv(rows: DataFrame, headers: list[str], folder: str, name: str, day: str, order: tuple[str | Column, ...]) -> str:
    """RFC 4180 text in `folder`/`name`-`day`.csv: CRLF between rows, none after the last.

    The rows are sorted into ranges and each task writes its part; the parts in order of their names
    are the text, and nothing of it passes through the driver but the header.  Columns that begin
    with _ are for the order only.  Returns the path.
    """
    spark, path = rows.sparkSession, f"{folder}/{name}-{day}.csv"
    spark.dataSource.register(OrderedLines)
    cells = [F.col(c) for c in rows.columns if not c.startswith("_")]
    header = spark.range(1).select(scalars.csv_line(*[F.lit(h) for h in headers])).first()[0]
    rows = scratch.written(rows, "csv-rows")  # the ranges of the order are sampled first, so rows are read twice
    lines = rows.orderBy(*order).select(scalars.csv_line(*cells).alias("line"))
    lines.write.format("ordered_lines").option("header", header).mode("append").save(path)
    return path


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of all files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "modificationTime", "length")


def remove_files(paths: DataFrame) -> int:
    """Deletes the files (path), in tasks; returns how many there were."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.path:
                fs, file = pafs.FileSystem.from_uri(p.replace("file:///", "/").replace("file:/", "/"))
                if fs.get_file_info(file).type != pafs.FileType.NotFound:
                    fs.delete_file(file)
            yield pd.DataFrame({"n": [len(batch)]})

    return paths.select("path").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
