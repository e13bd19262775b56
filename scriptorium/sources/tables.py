"""Table scans and sinks: append-only storage, latest-wins views, exact CSV and JSON."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from . import files, scratch


def scan(spark: SparkSession, root: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root}/{table}")
    return df.select(*columns) if columns else df


def append(rows: DataFrame, root: str, table: str) -> None:
    rows.write.mode("append").parquet(f"{root}/{table}")


def read_model(models: DataFrame, document_type: str) -> DataFrame:
    """(sample_idx, label, descriptor) of the one active model of a type, from its JSON."""
    active = models.where((F.col("document_type") == document_type) & F.col("active"))
    parsed = F.from_json("model_data", "samples array<struct<descriptor:array<double>,label:string>>")
    many = F.count("*").over(Window.partitionBy("document_type")) > 1
    one = active.select(F.when(many, F.raise_error(F.lit("more than one active model"))).otherwise(parsed).alias("m"))
    rows = one.select(F.posexplode("m.samples").alias("sample_idx", "s"))
    return rows.select("sample_idx", "s.label", F.col("s.descriptor").cast("array<float>").alias("descriptor"))


def model_json(model: DataFrame) -> str:
    """The model in its JSON form, samples in order; a model is small by `knn.BROADCAST_VALUES`."""
    rows = model.orderBy("sample_idx").select("descriptor", "label").collect()
    return json.dumps({"samples": [{"descriptor": [float(v) for v in r.descriptor], "label": r.label} for r in rows]})


def documents_csv(report: DataFrame, folder: str, day: str) -> str:
    """The documents report as a download, newest first; returns its path."""
    newest = (F.desc("created_at"), "id")
    return files.write_csv(report, list(config.DOCUMENTS_REPORT_HEADERS), folder, config.DOCUMENTS_REPORT_NAME, day, newest)


def validations_csv(report: DataFrame, folder: str, day: str) -> str:
    """The validations report as a download, newest first, six rows a validation; returns its path."""
    rows = report.select("document_id", "field", "before", "after", "editor", "validated_at", *[F.col(c).alias(f"_{c}") for c in ("line_no", "part", "position")])
    newest = (F.desc("validated_at"), "document_id", "_line_no", "_part", "_position")
    return files.write_csv(rows, list(config.VALIDATIONS_REPORT_HEADERS), folder, config.VALIDATIONS_REPORT_NAME, day, newest)


def stats_json(dashboard: DataFrame, days: DataFrame) -> str:
    one = json.loads(dashboard.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    one["documents_per_day"] = [json.loads(r[0]) for r in days.orderBy("day").select(F.to_json(F.struct("*"))).collect()]
    return json.dumps(one, indent=2, ensure_ascii=False)


# --- writes with their rules ---


def save_unit(root: str, **entries: DataFrame) -> None:
    """Appends the rows of several tables in one write, whose commit makes all of them visible or none.

    A journal is partitioned by the table's name, and each table's row is one struct column.
    """
    parts = [df.select(F.struct("*").alias(name), F.lit(name).alias("kind")) for name, df in entries.items()]
    unit = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    unit.write.mode("append").partitionBy("kind").parquet(f"{root}/journal")


def entries(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows that units have appended to a table."""
    return spark.read.option("mergeSchema", True).parquet(f"{root}/journal/kind={table}").select(f"{table}.*")


def save_ocr_result(results: DataFrame, root: str) -> None:
    """Results of six fields, with the time rounded, and the status and audit rows that go with them, as one unit."""
    rows = results.withColumn("processing_ms", F.floor(F.col("processing_ms") + 0.5).cast("int")).withColumn("confidence", F.col("confidence").cast("decimal(4,3)"))
    save_unit(root, ocr_results=rows.drop("raw_ocr", "extraction_method"), status_events=_status(results, "processed"), audit_logs=_audit(results, F.lit("OCR_COMPLETED")))


def save_validation(rows: DataFrame, root: str) -> None:
    """Validations with their status and audit rows, as one unit."""
    action = F.when(F.col("manually_edited"), "OCR_CORRECTED").otherwise("OCR_VALIDATED")
    save_unit(root, document_validations=rows, status_events=_status(rows, "validated"), audit_logs=_audit(rows, action))


def _status(rows: DataFrame, value: str) -> DataFrame:
    if value not in config.DOCUMENT_STATUSES:
        raise ValueError(f"no such status: {value}")
    return rows.select(F.col("document_id").alias("id"), F.lit(value).alias("status"), F.current_timestamp().alias("at"))


def _audit(rows: DataFrame, action: Column) -> DataFrame:
    return rows.select("document_id", action.alias("action"), F.current_timestamp().alias("created_at"))


def status(rows: DataFrame, root: str, value: str) -> None:
    save_unit(root, status_events=_status(rows, value))


def audit(rows: DataFrame, root: str, action: str) -> bool:
    """Appends audit rows by themselves; a failure is reported, never raised."""
    if action not in config.AUDIT_ACTIONS:
        raise ValueError(f"no such action: {action}")
    try:
        save_unit(root, audit_logs=_audit(rows, F.lit(action)))
    except Exception as e:  # noqa: BLE001
        print(f"audit of {action} failed: {e}")
        return False
    return True


def save_samples(samples: DataFrame, root: str) -> int:
    """Appends labelled samples, all or none: labels are one character of the alphabet, partitions known."""
    bad = ~F.col("label").rlike("^[0-9A-Za-z]$") | ~F.col("dataset_partition").isin(*config.DATASET_PARTITIONS)
    if not samples.where(F.coalesce(bad, F.lit(True))).isEmpty():
        raise ValueError("a label or a partition is not valid; nothing was saved")
    n = samples.count()
    if n:
        append(samples, root, "ocr_training_samples")
    return n


def save_model(spark: SparkSession, root: str, document_type: str, version: str, data: str, synthetic: bool = False) -> str:
    version = ("synthetic-" if synthetic else "") + version
    row = spark.createDataFrame([(str(uuid.uuid4()), document_type, version, data, False)], "id string, document_type string, version string, model_data string, active boolean")
    append(row, root, "ocr_models")
    return version


def activate(spark: SparkSession, root: str, document_type: str, version: str, active: bool = True) -> None:
    """Appends an activation event; the last one of a type decides which model is active."""
    row = spark.createDataFrame([(document_type, version, active)], "document_type string, version string, active boolean")
    append(row.withColumn("at", F.current_timestamp()), root, "model_events")


#: Samples of a part of a stored model.
MODEL_PART = 1_024
_SAMPLES = "samples array<struct<sample_idx:bigint,descriptor:array<float>,label:string>>"


def save_model_parts(model: DataFrame, root: str, document_type: str, version: str) -> None:
    """Appends a model (sample_idx, label, descriptor) of any size as rows of JSON with up to MODEL_PART
    samples each, and a row (part -1) with their number and a checksum, in one write."""
    sample = F.struct(F.col("sample_idx").cast("long").alias("sample_idx"), F.col("descriptor").cast("array<float>").alias("descriptor"), "label")
    parts = model.groupBy(F.floor(F.col("sample_idx") / MODEL_PART).alias("part")).agg(F.array_sort(F.collect_list(sample)).alias("samples"))  # ids are distinct
    parts = scratch.written(parts.select("part", F.size("samples").cast("long").alias("samples"), F.to_json(F.struct("samples")).alias("payload")), "model-parts")
    total = parts.agg(F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"), F.coalesce(F.sum(_checksum()), F.lit(0)).alias("checksum"))
    head = total.select(F.lit(-1).cast("long").alias("part"), "samples", "checksum")
    rows = parts.unionByName(head, allowMissingColumns=True).select(F.lit(document_type).alias("document_type"), F.lit(version).alias("version"), "part", "samples", "checksum", "payload")
    append(rows, root, "ocr_model_parts")


def _checksum() -> Column:
    return F.crc32(F.concat_ws(":", F.col("part").cast("string"), F.col("samples").cast("string"), "payload").cast("binary"))


def read_model_parts(spark: SparkSession, root: str, document_type: str, version: str) -> DataFrame:
    """(sample_idx, label, descriptor) of a stored model; an error unless its parts are as they were written."""
    rows = scan(spark, root, "ocr_model_parts").where((F.col("document_type") == document_type) & (F.col("version") == version))
    head, body = F.col("part") == -1, F.col("part") >= 0
    said = rows.agg(
        F.count_if(head).alias("heads"), F.max(F.when(head, F.col("samples"))).alias("samples"), F.max(F.when(head, F.col("checksum"))).alias("checksum"),
        F.coalesce(F.sum(F.when(body, F.col("samples"))), F.lit(0)).alias("found"), F.coalesce(F.sum(F.when(body, _checksum())), F.lit(0)).alias("sum"),
    ).first()
    if (said.heads, said.samples, said.checksum) != (1, said.found, said.sum):
        raise ValueError(f"model {version} of {document_type} is not whole: {said.found} of {said.samples} samples, {said.heads} heads")
    samples = rows.where(body).select(F.inline(F.from_json("payload", _SAMPLES)["samples"]))
    return samples.select("sample_idx", "label", "descriptor")


def create_document(rows: DataFrame, root: str) -> None:
    """Uploads the files of new documents (id, name, content), if they have any, then inserts the
    documents; when the insert fails the files are left for `orphans`."""
    if "content" in rows.columns:
        folder = f"{root}/files/{uuid.uuid4().hex}"
        files.write_files(rows.select(F.col("name"), "content"), folder)
        rows = rows.withColumn("storage_path", F.concat(F.lit(f"{folder}/"), "name")).drop("content")
    append(rows.withColumn("status", F.lit("uploaded")), root, "documents")
    audit(rows.select(F.col("id").alias("document_id")), root, "DOCUMENT_CREATED")


def delete_document(rows: DataFrame, root: str) -> None:
    """Appends tombstones; reads leave out the documents and what belongs to them, and `orphans` finds their files."""
    append(rows.select("id"), root, "tombstones")
    audit(rows.select(F.lit(None).cast(rows.schema["id"].dataType).alias("document_id")), root, "DOCUMENT_DELETED")


def orphans(spark: SparkSession, root: str, documents: DataFrame, tombstones: DataFrame, before=None) -> DataFrame:
    """(path): files of no live document: of an insert that failed or of a deleted document.  Files that
    were written at `before` or later may belong to an upload under way and are left out."""
    found = files.list_files(spark, f"{root}/files")
    if before is not None:
        found = found.where(F.col("modificationTime") < F.lit(before))
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")  # noqa: E731  the scheme may be written in several ways
    live = documents.join(tombstones.select("id"), "id", "left_anti").select(plain("storage_path").alias("_live"))
    return found.join(live, plain("path") == F.col("_live"), "left_anti").select("path")


def sweep(spark: SparkSession, root: str, before=None) -> int:
    """Deletes the files of no live document; returns how many there were."""
    gone = scan(spark, root, "tombstones") if _there(spark, f"{root}/tombstones") else spark.createDataFrame([], scan(spark, root, "documents").select("id").schema)
    return files.remove_files(orphans(spark, root, scan(spark, root, "documents"), gone, before))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def png(gray: bytes, width: int, height: int) -> bytes:
    """An 8-bit grey PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + gray[y * width : (y + 1) * width] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_files(images: DataFrame) -> DataFrame:
    """(name, content) of images (name, width, height, gray), encoded in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b.name_, "content": [png(bytes(g), int(w), int(h)) for g, w, h in zip(b.gray, b.width, b.height, strict=True)]})

    return images.select(F.col("name").alias("name_"), "width", "height", "gray").mapInPandas(run, "name string, content binary")
