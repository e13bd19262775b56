"""How filters of documents act on one another in every order (DataFrame functions only).

Five filters fail documents: A few words, B few distinct words, C many capitals, D symbols, E a
copy of the text of a smaller id.  One CUBE over the five failure flags and the part counts
everything: a row of it whose selected flags are all false holds the survivors of that subset of
filters.  A step of an order takes documents from the survivors of one subset to those of another
with one filter more, so each of its figures is a difference between two rows of the cube, and a
join of pairs of subsets gives all orders.

Texts are read once and never shuffled; copies meet by the SHA-256 digest of their text, which is
aggregated to its least id before it moves.  The digests of large groups of copies, fewer than
`graph.PARTS` of them, are joined by broadcast, so no group is gathered in a task.  The cube
runs over counts by (part, flags), at most 32 a part.

Edge cases: a null text is empty; a null source is the part "", together with an empty one; a
document without a label is neither good nor toxic, one with several is what any of them says; a
null id is no smaller id, no copy, and has no label; rows that repeat an id are no copies of one another; other
columns are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of, written
from .graph import PARTS

FILTERS = "ABCDE"
#: Bounds of the filters: words, distinct words in percent, capitals in percent.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> Column:
    """struct<A, B, C, D> of booleans: what a text fails by itself."""
    text = F.coalesce(text, F.lit(""))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))

    def flags(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        return F.struct(
            (n < MIN_WORDS).alias("A"),
            (100 * distinct < MIN_DISTINCT * n).alias("B"),
            (100 * capitals.cast("long") > MAX_CAPITALS * F.char_length(text)).alias("C"),
            text.rlike("[#$%&*|]").alias("D"),
        )

    return let(words_of(text), flags)


def _copies(rows: DataFrame) -> DataFrame:
    """Written `rows` (doc_id, digest, ...) with E: whether a smaller id has the same digest."""
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows"))
    groups = written(groups.where("first < last"), "audit-copies")
    bound = rows.count() // PARTS
    large = F.broadcast(groups.where(F.col("rows") > bound).select("digest", "first"))  # fewer than PARTS rows
    small = groups.where(F.col("rows") <= bound).select("digest", "first")
    rest = rows.join(large.select("digest"), "digest", "left_anti").join(small, "digest", "left")
    return rows.join(large, "digest").unionByName(rest).withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, A, B, C, D, E, good, toxic): one row a document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        text_failures(text).alias("f"),
    ).select("doc_id", "part", "digest", "f.*")
    said = labels.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = written(rows.join(said, "doc_id", "left").fillna(False, ["good", "toxic"]), "audit-flags")
    return _copies(rows).drop("digest", "first")


def survivors(flagged: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): how many pass all filters of each subset (bit k: filter k of
    FILTERS), zeros included, from rows as `failures` gives them.  A null part is the whole table."""
    flags = list(FILTERS)
    cells = flagged.groupBy("part", *flags).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    cube = cells.cube(*flags, "part").agg(F.grouping("part").alias("whole"), *[F.grouping(f).alias(f"_{f}") for f in flags], *[F.sum(c).alias(c) for c in COUNTS])
    chosen = reduce(lambda a, b: a + b, [(1 - F.col(f"_{f}").cast("int")) * (1 << k) for k, f in enumerate(flags)])
    passed = reduce(lambda a, b: a & b, [~F.coalesce(F.col(f), F.lit(False)) for f in flags])
    found = cube.where(passed).select("part", "whole", chosen.alias("subset"), *COUNTS)
    # A subset that nothing survives has no such row; the one without filters always has.
    spine = found.where("subset = 0").select("part", "whole", F.explode(F.sequence(F.lit(0), F.lit((1 << len(flags)) - 1))).alias("subset"))
    other = found.withColumnsRenamed({c: f"_{c}" for c in ("part", "whole", "subset")})
    same = spine["part"].eqNullSafe(other["_part"]) & (spine["whole"] == other["_whole"]) & (spine["subset"] == other["_subset"])
    return spine.join(other, same, "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def steps() -> list[tuple[str, int, str, int, int]]:
    """(filter_order, step, filter, before, after) of all orders, with the subsets of filters before and after: 600 rows."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    of = lambda fs: sum(bit[f] for f in fs)
    return [("".join(o), k + 1, o[k], of(o[:k]), of(o[: k + 1])) for o in permutations(FILTERS) for k in range(len(FILTERS))]


def audit(flagged: DataFrame) -> DataFrame:
    """One row a part, order and step: part (null: the whole table), filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley, from rows as `failures` gives them."""
    spark = flagged.sparkSession
    cube = written(survivors(flagged), "audit-cube")
    every, bit = (1 << len(FILTERS)) - 1, {f: 1 << k for k, f in enumerate(FILTERS)}

    def side(name: str) -> DataFrame:
        return cube.select(F.col("part").alias(f"{name}_part"), F.col("subset").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in COUNTS])

    def lost(pairs: DataFrame) -> DataFrame:
        """Joins (before, after), a bounded table, with the counts of both subsets, part by part."""
        first = side("before").join(F.broadcast(pairs), "before")
        second = side("after")
        return first.join(second.withColumnRenamed("after", "_after"), F.col("before_part").eqNullSafe(F.col("after_part")) & (F.col("after") == F.col("_after"))).drop("_after")

    # What depends on the filter alone: its failures, those of no other filter, and the sum over all orders.
    size = len(FILTERS)
    weighed = [
        (f, before, before | bit[f], factorial(before.bit_count()) * factorial(size - 1 - before.bit_count()), before == 0, before == every ^ bit[f])
        for f in FILTERS for before in range(every + 1) if not before & bit[f]
    ]
    removed = F.col("before_n") - F.col("after_n")
    pairs = lost(spark.createDataFrame(weighed, "filter string, before int, after int, weight long, first boolean, last boolean"))
    per_filter = pairs.groupBy(F.col("before_part").alias("own_part"), F.col("filter").alias("own")).agg(
        F.sum(F.when(F.col("first"), removed)).alias("fails"),
        F.sum(F.when(F.col("last"), removed)).alias("unique_fails"),
        F.sum(F.col("weight") * removed).alias("shapley"),
    )
    walked = lost(spark.createDataFrame(steps(), "filter_order string, step int, filter string, before int, after int"))
    joined = walked.join(per_filter, F.col("before_part").eqNullSafe(F.col("own_part")) & (F.col("filter") == F.col("own")))
    return joined.select(
        F.col("before_part").alias("part"), "filter_order", "step", F.col("after_n").alias("kept"), removed.alias("removed"),
        (F.col("fails") - removed).alias("redundant"), "unique_fails", (F.col("before_good") - F.col("after_good")).alias("good_lost"),
        (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), "shapley",
    )
