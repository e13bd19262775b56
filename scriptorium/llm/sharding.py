"""Sharding by sampled splitters (DataFrame functions only).

Rows are ordered by a key that keeps equal texts together: (hash of the text, id).  A
size-weighted sample of the keys gives the quantile boundaries of many narrow key ranges; a
range that is overfull (a hot text) is subdivided by the hash of the id.  The exact byte
totals of these cells, in order, then say where each of the shards begins, so shards are equal
to within one document whatever the sample was.

Law: ``bytes``.  Edge cases: a null text has size 1 and checksum 0; null ids sort first;
repeated rows each get a place of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unit, written

#: Keys drawn for the boundaries; a fixed bound on what the driver gets.
SAMPLE = 16_384
#: Ranges: at least so many, more for large inputs (one for so many rows), never over the bound.
MIN_RANGES, ROWS_PER_RANGE, MAX_RANGES = 1_024, 50_000, 65_536


def _boundaries(keys: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of the text hash from a size-weighted Poisson sample."""
    step = F.lit(total / SAMPLE)
    drawn = (
        keys.where(unit(F.col("h"), F.col("doc_id"), F.lit("draw")) * step < F.col("size"))
        .groupBy("h")
        .agg(F.sum(F.greatest(F.col("size").cast("double"), step)).alias("w"))
        .orderBy("h")
        .collect()  # about SAMPLE rows, and at most SAMPLE more that are heavier than a step
    )
    whole, seen, out = sum(r.w for r in drawn), 0.0, []
    for r in drawn:
        if seen >= whole * (len(out) + 1) / ranges:
            out.append(r.h)
        seen += r.w
    return out


def _range_of(h: Column, bounds: list[int]) -> Column:
    """Number of boundaries at or below `h`, in two steps of about sqrt(n) comparisons each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    block = F.size(F.filter(lit([b[0] for b in blocks]), lambda b: b <= h))
    inside = F.size(F.filter(F.element_at(F.array(*map(lit, blocks)), F.greatest(block, F.lit(1))), lambda b: b <= h))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col(text_col)
    keys = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-keys",
    )
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MAX_RANGES, max(MIN_RANGES, n // ROWS_PER_RANGE))
    bounds = _boundaries(keys, total, ranges) if n else []
    keys = keys.withColumn("r", _range_of(F.col("h"), bounds))

    # Overfull ranges are cut into cells by the hash of the id; at most 1.5 cells a range.
    full = max(1, 2 * n // ranges)
    cuts = {x.r: -(-x.n // full) for x in keys.groupBy("r").agg(F.count("*").alias("n")).collect() if x.n > full}
    many = F.lit(1)
    if cuts:
        table = F.create_map(*[F.lit(v) for kv in cuts.items() for v in kv])
        many = F.coalesce(table[F.col("r")], F.lit(1))
    keys = keys.withColumn("c", F.floor(unit(F.col("doc_id"), F.lit("cell")) * many).cast("int"))

    order = Window.orderBy("r", "c").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        keys.groupBy("r", "c")
        .agg(F.count("*").alias("n"), F.sum("size").alias("b"))
        .select(
            "r",
            "c",
            F.coalesce(F.sum("n").over(order), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum("b").over(order), F.lit(0)).alias("bytes_before"),
        )
    )
    within = Window.partitionBy("r", "c").orderBy("h", "doc_id", "size")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = written(
        keys.withColumn("i", F.row_number().over(within) - 1)
        .withColumn("b", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(F.broadcast(cells), ["r", "c"])  # bounded: at most 1.5 * MAX_RANGES rows
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("rows_before") + F.col("i")).alias("row"),
            F.least(
                F.floor((F.col("bytes_before") + F.col("b")) * F.lit(float(shards)) / F.lit(float(max(total, 1)))).cast("int"),
                F.lit(shards - 1),
            ).alias("shard"),
        ),
        "shard-placed",
    )
    first = {x.shard: x.row for x in placed.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    starts = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.element_at(starts, F.col("shard") + 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of `docs`, all columns, under `path`/shard=N in the order of the slots.

    Rows are matched with their places by id and text.  Rows that agree in both (repeated rows, or
    null ids with one text) are numbered, so each gets one place; a column `shard` or `slot` of
    `docs` gives way to the new one.
    """
    same = Window.partitionBy("_id", "_crc", "_size").orderBy("_id")  # only rows that repeat meet here
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    rows = docs.select("*", F.col(id_col).alias("_id"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_crc"), size.alias("_size")).drop("shard", "slot")
    places = shard(docs, shards, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), "shard", "slot")
    left, right = (df.withColumn("_n", F.row_number().over(same)) for df in (rows, places))
    right = right.select(*[F.col(c).alias(f"{c}_") for c in ("_id", "_crc", "_size", "_n")], "shard", "slot")
    match = left["_id"].eqNullSafe(right["_id_"])
    for c in ("_crc", "_size", "_n"):
        match = match & (left[c] == right[f"{c}_"])
    out = left.join(right, match).select(*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
