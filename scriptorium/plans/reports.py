"""Reports: documents, validations, descriptor drawings, the text of an evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars
from ..operators.repository import latest


def documents_report(docs: DataFrame, results: DataFrame, validations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Seven columns a document: latest confidence in percent, latest validation and who made it."""
    r = latest(results, "document_id", "created_at", "line_no", "part").select(F.col("document_id").alias("id"), "confidence")
    v = latest(validations, "document_id", "validated_at", "line_no", "part").select(F.col("document_id").alias("id"), "validated_by", "validated_at")
    v = v.join(profiles.select(F.col("id").alias("validated_by"), "email"), "validated_by", "left")
    return docs.join(r, "id", "left").join(v, "id", "left").select(
        "id", "document_type", scalars.status_label(F.col("status")).alias("status"), scalars.percent(F.col("confidence")).alias("accuracy"),
        "validated_at", F.coalesce("email", F.lit("")).alias("validator"), "created_at",
    )


def validations_report(validations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Six rows a validation: each field before and after, null as the empty string."""
    o, v = F.parse_json("original"), F.parse_json("validated")
    text = lambda data, f: F.coalesce(F.try_variant_get(data, f"$.{f}", "string"), F.lit(""))
    one = lambda i, f: F.struct(F.lit(i).alias("position"), F.lit(config.VALIDATION_FIELD_LABELS[f]).alias("field"), text(F.col("o"), f).alias("before"), text(F.col("v"), f).alias("after"))
    named = validations.join(profiles.select(F.col("id").alias("validated_by"), "email"), "validated_by", "left")  # a row a validation, not six
    return named.withColumns({"o": o, "v": v}).select(
        "document_id", "line_no", "part", F.inline(F.array(*[one(i, f) for i, f in enumerate(config.VALIDATION_FIELDS)])), F.coalesce("email", F.lit("")).alias("editor"), "validated_at"
    )


def hog_svg(descriptor, cols: int = config.HOG_GRID_COLS, rows: int = config.HOG_GRID_ROWS, bins: int = config.HOG_BINS, size: int = 120) -> str:
    """Drawing of a descriptor as one rose a region: its radius at an angle, and opposite to it, is the bin's value."""
    values = np.asarray(descriptor, float)
    if values.size != cols * rows * bins:
        raise ValueError(f"a descriptor of {cols} x {rows} x {bins} values is needed, this has {values.size}")
    turn = np.pi * np.arange(2 * bins) / bins
    radius = np.tile(np.clip(np.nan_to_num(values), 0, 1).reshape(rows * cols, bins), 2) / 2
    roses = []
    for k in np.flatnonzero(radius.any(1)):
        x, y = k % cols + 0.5 + radius[k] * np.cos(turn), k // cols + 0.5 + radius[k] * np.sin(turn)
        points = " ".join(f"{u:.3f},{v:.3f}" for u, v in zip(x, y, strict=True))
        roses.append(f'<polygon points="{points}"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {cols} {rows}" width="{size * cols // max(cols, rows)}"><g fill="teal" fill-opacity="0.7">{"".join(roses)}</g></svg>'


def _table(head: list[str], rows: list[tuple]) -> str:
    cell = lambda v: f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]])


def evaluation_report(name: str, day: str, characters: dict, fields: dict, speed: dict, repeat: dict) -> str:
    """Markdown text of an evaluation, from results that are already computed (a few rows each).

    characters: accuracy, correct, total, per_class {label: share}, confusions [(actual, predicted, n)];
    fields: accuracy, f1, documents, rows [(field, accuracy, precision, recall, f1, confidence)],
    errors [(field, error, n)]; speed: documents, mean, p95, p99, throughput, bottleneck, stages {name: ms};
    repeat: same_text, same_fields, score, confidence_variance, value_variance.
    """
    goals = [
        ("character accuracy", characters["accuracy"], ">=", config.TARGET_CHARACTER_ACCURACY),
        ("field accuracy", fields["accuracy"], ">=", config.TARGET_FIELD_ACCURACY),
        ("mean milliseconds a document", speed["mean"], "<", config.TARGET_MS),
        ("equal results of repeated runs", repeat["score"], ">=", config.TARGET_REPRODUCIBILITY),
    ]
    met = lambda v, how, goal: v < goal if how == "<" else v >= goal
    whole = sum(speed["stages"].values())
    figures = [
        ("characters right", f"{characters['correct']} of {characters['total']}"),
        ("documents with fields", fields["documents"]), ("field F1", float(fields["f1"])),
        ("documents timed", speed["documents"]), ("p95 ms", float(speed["p95"])), ("p99 ms", float(speed["p99"])), ("documents a second", float(speed["throughput"])),
        ("same text", repeat["same_text"]), ("same fields", repeat["same_fields"]),
        ("confidence variance", float(repeat["confidence_variance"])), ("value variance", float(repeat["value_variance"])),
    ]
    weak = sorted(characters["per_class"].items(), key=lambda x: (x[1], x[0]))
    parts = [
        f"# Evaluation of {name}, {day}",
        _table(["goal", "measured", "wanted", "met"], [(g, float(v), f"{how} {goal}", "yes" if met(v, how, goal) else "no") for g, v, how, goal in goals]),
        _table(["figure", "value"], figures),
        "## Classes, weakest first\n\n" + _table(["label", "share right"], [(k, float(v)) for k, v in weak]),
        "## Taken for another\n\n" + _table(["actual", "predicted", "times"], characters["confusions"]),
        "## Fields\n\n" + _table(["field", "accuracy", "precision", "recall", "F1", "confidence"], fields["rows"]),
        "## Field errors\n\n" + _table(["field", "error", "times"], fields["errors"]),
        "## Time by stage\n\n" + _table(["stage", "ms", "share"], [(k, float(v), v / whole if whole else 0.0) for k, v in sorted(speed["stages"].items(), key=lambda x: -x[1])]),
    ]
    return "\n\n".join(parts) + "\n"
