"""Evaluation: confusion, precision, field metrics, percentiles, reproducibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def confusion_matrix(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(actual, predicted, n) over all label pairs; pairs outside `labels` (label) are dropped."""
    counts = pairs.groupBy(F.col("expected").alias("actual"), "predicted").agg(F.count("*").alias("n"))
    grid = labels.select(F.col("label").alias("actual")).crossJoin(labels.select(F.col("label").alias("predicted")))
    return grid.join(counts, ["actual", "predicted"], "left").fillna(0, ["n"])


def accuracy(pairs: DataFrame, empty: float | None = None) -> DataFrame:
    """Share of correct pairs; `empty` for no pairs (null for a trainer, 0 for an evaluator)."""
    hit = F.avg((F.col("expected") == F.col("predicted")).cast("double"))
    return pairs.agg(F.count("*").alias("total"), F.count_if(F.col("expected") == F.col("predicted")).alias("correct"), F.coalesce(hit, F.lit(empty).cast("double")).alias("accuracy"))


def per_class_accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("expected").alias("label")).agg(F.count("*").alias("n"), F.avg((F.col("expected") == F.col("predicted")).cast("double")).alias("accuracy"))


def precision_recall(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall) from a confusion matrix, 0 for an empty denominator."""
    rows = matrix.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("row"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    columns = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("column"))
    share = lambda d: F.coalesce(F.try_divide(F.col("hit"), F.col(d)), F.lit(0.0))
    return rows.join(columns, "label").select("label", share("column").alias("precision"), share("row").alias("recall"))


def top_misclassifications(pairs: DataFrame, order: str, limit: int = 10) -> DataFrame:
    """(actual, predicted, n, place) of the most frequent confusions; ties go to the first seen."""
    wrong = pairs.where("expected <> predicted").groupBy(F.col("expected").alias("actual"), "predicted").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = wrong.orderBy(F.desc("n"), "first").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).drop("first")


def field_match(value_str, value_num, truth_str, truth_num):
    number = F.abs(value_num - truth_num) < config.NUMERIC_EPSILON
    return F.coalesce(F.when(truth_num.isNotNull(), number).otherwise(value_str == truth_str), F.lit(False))


def field_metrics(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for each of the six fields, also without documents."""
    t = truth.select("doc_id", "field", F.col("value_str").alias("ts"), F.col("value_num").alias("tn"))
    rows = found.join(t, ["doc_id", "field"])
    some = F.col("value_str").isNotNull() | F.col("value_num").isNotNull()
    hit = field_match(F.col("value_str"), F.col("value_num"), F.col("ts"), F.col("tn"))
    counts = rows.groupBy("field").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("tp"), F.count_if(some & ~hit).alias("fp"), F.count_if(~some).alias("fn"), F.avg("confidence").alias("confidence")
    )
    spark = found.sparkSession
    spine = spark.createDataFrame(list(enumerate(config.VALIDATION_FIELDS)), "position int, field string")
    out = spine.join(counts, "field", "left").fillna(0, ["n", "tp", "fp", "fn", "confidence"])
    rate = lambda a, b, empty: F.coalesce(F.try_divide(a, b), F.lit(empty))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = out.withColumns({"accuracy": rate(tp, F.col("n"), 0.0), "precision": rate(tp, tp + fp, 1.0), "recall": rate(tp, tp + fn, 1.0)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", rate(2 * p * r, p + r, 0.0))


def field_overall(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("accuracy").alias("overall_accuracy"), F.avg("f1").alias("overall_f1"))


def common_errors(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(field, error, frequency): fields that were missed or differ, most frequent first."""
    t = truth.select("doc_id", "field", F.col("value_str").alias("ts"), F.col("value_num").alias("tn"))
    rows = found.join(t, ["doc_id", "field"])
    none = F.col("value_str").isNull() & F.col("value_num").isNull()
    hit = field_match(F.col("value_str"), F.col("value_num"), F.col("ts"), F.col("tn"))
    error = F.when(none, "missing").when(~hit, "wrong")
    return rows.withColumn("error", error).where("error is not null").groupBy("field", "error").agg(F.count("*").alias("frequency"))


STAGES = ("preprocess", "segmentation", "recognition", "extraction")


def benchmark(timings: DataFrame) -> DataFrame:
    """One row from per-document stage times in ms; nearest-rank percentiles, first slowest stage."""
    total = F.col("total")
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by total)")
    m = timings.agg(F.count("*").alias("documents"), F.sum(total).alias("total_ms"), F.avg(total).alias("mean_ms"), *[F.avg(s).alias(s) for s in STAGES], disc(0.95).alias("p95"), disc(0.99).alias("p99"))
    top = F.greatest(*STAGES)
    slowest = F.lit("recognition")
    for s in reversed(STAGES):
        slowest = F.when(F.col(s) == top, s).otherwise(slowest)
    zero = [c for c in m.columns if c != "documents"]
    out = m.withColumn("bottleneck", slowest).withColumn("throughput", F.coalesce(F.try_divide(F.lit(1000.0), F.col("mean_ms")), F.lit(0.0)))
    return out.fillna(0, zero)


def run_means(timings: DataFrame) -> DataFrame:
    """Stage times averaged over the runs of each document (doc_id)."""
    return timings.groupBy("doc_id").agg(*[F.avg(c).alias(c) for c in (*STAGES, "total")])


def reproducibility(runs: DataFrame) -> DataFrame:
    """Per document over its runs (run from 0, raw_text, confidence, six values): agreement and variance.

    The runs are read once: the first run and the fields that all runs have are looked up within the
    document, and the variance over several fields is put together from their counts, means and variances.
    """
    values = F.struct(*[F.col(f) for f in config.VALIDATION_FIELDS])
    doc = Window.partitionBy("doc_id")
    first = F.max(F.when(F.col("run") == 0, F.struct(F.col("raw_text").alias("text0"), values.alias("values0")))).over(doc)
    rows = runs.withColumn("values", values).withColumn("first", first).where("first is not null")
    text, same = F.col("raw_text").eqNullSafe(F.col("first.text0")), F.col("values").eqNullSafe(F.col("first.values0"))
    numbers = config.NUMERIC_VALIDATION_FIELDS
    out = rows.groupBy("doc_id").agg(
        F.bool_and(text).alias("same_text"), F.bool_and(same).alias("same_fields"), F.avg((text & same).cast("double")).alias("score"), F.var_pop("confidence").alias("confidence_variance"),
        F.count("*").alias("_n"), *[F.count(f).alias(f"_n_{f}") for f in numbers], *[F.avg(f).alias(f"_m_{f}") for f in numbers], *[F.var_pop(f).alias(f"_v_{f}") for f in numbers],
    )
    moments = F.array(*[F.when(F.col(f"_n_{f}") == F.col("_n"), F.struct(F.col(f"_m_{f}").alias("m"), F.col(f"_v_{f}").alias("v"))) for f in numbers])
    out = out.withColumn("_all", F.array_compact(moments))  # of equal counts, so plain means of means
    total = lambda of: F.aggregate("_all", F.lit(0.0), lambda s, x: s + of(x))
    n = F.size("_all")
    out = out.withColumn("_mean", F.try_divide(total(lambda x: x["m"]), n))
    spread = F.try_divide(total(lambda x: x["v"] + (x["m"] - F.col("_mean")) * (x["m"] - F.col("_mean"))), n)
    return out.select("doc_id", "same_text", "same_fields", "score", "confidence_variance", F.coalesce(spread, F.lit(0.0)).alias("value_variance"))
