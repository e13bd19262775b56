"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every word rule of this package sees it: space and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a folder of our own is made on a single machine (tests); on a
    cluster that is an error, since executors would write to disks that others do not see.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Tables:
    """The intermediate tables of one owner, who drops them when nothing reads them any more."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def drop(self, spark: SparkSession) -> None:
        while self.paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_OWNER: ContextVar[Tables | None] = ContextVar("owner", default=None)


@contextmanager
def owned() -> Iterator[Tables]:
    """Tables written inside belong to the yielded owner; tables without an owner stay."""
    tables = Tables()
    token = _OWNER.set(tables)
    try:
        yield tables
    finally:
        _OWNER.reset(token)


@contextmanager
def settings(spark: SparkSession, **values) -> Iterator[None]:
    """Settings (with _ for .) that hold for the actions inside only."""
    names = {k.replace("_", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, arrow_rows: int = 10_000) -> DataFrame:
    """`df`, written as Parquet in the shared folder and read again.

    Cuts the lineage (a lost executor costs at most a re-read) and gives the planner the true
    size of the table, so that it broadcasts it only below its threshold.  The shuffle files of
    the write go when it ends.  `arrow_rows` bounds the rows of an Arrow batch, of which both
    sides hold one at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"
    if (owner := _OWNER.get()) is not None:
        owner.paths.append(path)
    with settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true", spark_sql_execution_arrow_maxRecordsPerBatch=arrow_rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words (maximal runs of non-space characters) of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with `value` evaluated once: it is bound as the variable of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the given columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def read_slices(batches, most: int = 4 << 20):
    """(ids, texts) of Arrow batches of two columns, in slices of at most `most` bytes of text.

    A longer text is a slice of its own, so what a task holds is bounded by its longest text.
    """
    import numpy as np

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            to = min(to, len(texts))
            yield ids.slice(at, to - at), texts.slice(at, to - at)
            at = to


def release() -> None:
    """Gives memory that is free in this worker back to the machine, which other workers share."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def text_bytes(texts):
    """The UTF-8 bytes of an Arrow string array, and the offsets of its texts in them."""
    import numpy as np

    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
