"""Pages of a listing from an index, whatever their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .. import config
from .repository import page


def newest() -> list[Column]:
    """The order of a listing: newest first, ids break ties."""
    return [F.desc("created_at"), F.asc("id")]


class PageIndex:
    """Rows sorted once into ranges, with the number of rows in and before each range.

    A page reads the ranges that it touches, one or two, and the exact total is the sum of the
    counts, so neither sorts nor counts the table again, and a page past the end has its total too.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, rows: DataFrame, path: str) -> PageIndex:
        """Writes the sorted rows (created_at, id, ...) and their index to the new folder `path`."""
        ordered = rows.orderBy(*newest()).withColumn("_range", F.spark_partition_id())
        ordered.write.partitionBy("_range").parquet(f"{path}/rows")
        rows.limit(0).write.parquet(f"{path}/columns")
        stored = rows.sparkSession.read.schema(ordered.schema).parquet(f"{path}/rows")
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        counts = stored.groupBy("_range").agg(F.count("*").alias("n"))  # a row a range
        counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(f"{path}/index")
        return cls(rows.sparkSession, path)

    def _index(self) -> DataFrame:
        return self.spark.read.schema("_range int, n long, before long").parquet(f"{self.path}/index")

    def _columns(self) -> StructType:
        return self.spark.read.parquet(f"{self.path}/columns").schema

    def total(self) -> int:
        return self._index().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, number: float | None = None, size: float | None = config.DEFAULT_PAGE_SIZE) -> DataFrame:
        """(page, exact_total, position, ...): the rows of a page with their positions from 0; of an empty
        page one row without them."""
        number, size = page(number, size)
        first, total = (number - 1) * size, self.total()
        head = self.spark.range(1).select(F.lit(number).alias("page"), F.lit(total).alias("exact_total"))
        if first >= total:
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._columns()]
            return head.select("page", "exact_total", F.lit(None).cast("long").alias("position"), *none)
        touched = self._index().where((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).orderBy("_range").collect()
        rows = self.spark.read.schema(self._columns().add("_range", IntegerType())).parquet(f"{self.path}/rows").where(F.col("_range").isin([t["_range"] for t in touched])).drop("_range")
        found = rows.orderBy(*newest()).offset(first - touched[0].before).limit(size)
        placed = found.withColumn("position", F.row_number().over(Window.orderBy(*newest())) - 1 + F.lit(first))  # a page at most
        return placed.select(F.lit(number).alias("page"), F.lit(total).alias("exact_total"), F.col("position").cast("long").alias("position"), *found.columns)
