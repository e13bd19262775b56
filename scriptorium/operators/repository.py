"""Queries over the document tables: listing, latest rows, aggregates, row-level visibility."""

from __future__ import annotations

from dataclasses import dataclass
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars


@dataclass(frozen=True)
class Filters:
    owner_id: object = None
    status: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    document_id: str | None = None
    provider: str | None = None
    min_amount: float | None = None
    max_amount: float | None = None
    #: Whether `date_to`, a bare date, includes that whole day.
    inclusive_day: bool = False


def page(number: float | None = None, size: float | None = None) -> tuple[int, int]:
    """Page number from 1 and page size from 1 to 100."""
    number, size = int(number if number is not None else 1), int(size if size is not None else config.DEFAULT_PAGE_SIZE)
    return max(1, number), min(max(1, size), config.MAX_PAGE_SIZE)


def clamped(number: Column, size: Column) -> tuple[Column, Column]:
    """As `page`, for columns of what was asked."""
    whole = lambda c, none: F.coalesce(F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)), F.lit(none))
    return (
        F.greatest(F.lit(1), whole(number, 1)).cast("int").alias("page"),
        F.least(F.lit(config.MAX_PAGE_SIZE), F.greatest(F.lit(1), whole(size, config.DEFAULT_PAGE_SIZE))).cast("int").alias("size"),
    )


def filtered(docs: DataFrame, results: DataFrame, f: Filters, uuid_ids: bool = True) -> DataFrame:
    """Documents that pass all filters given; conditions on results must hold on one result row.

    Provider and amount are read from the JSON in `extracted_data` if the results have it (amounts
    compare as numbers, also when written as text), else from `proveedor` and `total`.
    """
    if f.owner_id is not None:
        docs = docs.where(F.col("owner_id") == f.owner_id)
    if f.status:
        docs = docs.where(F.col("status") == f.status)
    if f.date_from:
        docs = docs.where(F.col("created_at") >= F.lit(f.date_from).cast("timestamp"))
    if f.date_to:
        to = F.lit(f.date_to).cast("timestamp")
        docs = docs.where(F.col("created_at") < to + F.expr("interval 1 day") if f.inclusive_day else F.col("created_at") <= to)
    if f.document_id and (not uuid_ids or re.match(scalars.UUID, f.document_id.strip())):
        docs = docs.where(F.col("id").cast("string") == f.document_id.strip())
    provider, amount = F.col("proveedor") if "proveedor" in results.columns else None, F.col("total") if "total" in results.columns else None
    if "extracted_data" in results.columns:
        data = F.try_parse_json("extracted_data")
        provider, amount = scalars.field_value(data, "proveedor", "string"), scalars.field_value(data, "total", "decimal(38,10)")
    on: list[Column] = []
    if f.provider:
        on.append(provider.ilike(f"%{f.provider}%"))
    if f.min_amount is not None:
        on.append(amount >= f.min_amount)
    if f.max_amount is not None:
        on.append(amount <= f.max_amount)
    if on:
        for c in on:
            results = results.where(c)
        docs = docs.join(results.select(F.col("document_id").alias("id")), "id", "left_semi")
    return docs


def list_documents(docs: DataFrame, results: DataFrame, f: Filters = Filters(), number: int = 1, size: int = config.DEFAULT_PAGE_SIZE, uuid_ids: bool = True) -> DataFrame:
    """One page, newest first, ids break ties."""
    number, size = page(number, size)
    return filtered(docs, results, f, uuid_ids).orderBy(F.desc("created_at"), "id").offset((number - 1) * size).limit(size)


def list_with_total(docs: DataFrame, results: DataFrame, f: Filters = Filters(), number: int = 1, size: int = config.DEFAULT_PAGE_SIZE, uuid_ids: bool = True) -> DataFrame:
    """One page as `list_documents` gives it; `exact_total` counts the documents of all pages."""
    total = filtered(docs, results, f, uuid_ids).agg(F.count("*"))
    return list_documents(docs, results, f, number, size, uuid_ids).withColumn("exact_total", total.scalar())


def with_owner(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Documents with the e-mail of their owner, null if there is no profile."""
    return docs.join(profiles.select(F.col("id").alias("owner_id"), F.col("email").alias("owner_email")), "owner_id", "left")


def with_results(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Documents with all their results (confidence, created_at), an empty array if none."""
    own = results.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("created_at", "line_no", "part", "confidence"))).alias("ocr_results"))
    none = F.array().cast(own.schema["ocr_results"].dataType)
    return docs.join(own, "id", "left").withColumn("ocr_results", F.coalesce("ocr_results", none))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that comes last by `order`; pre-aggregated, no sort."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("_r")).select("_r.*")


# --- aggregates ---


def daily_buckets(rows: DataFrame, ts: str, days: int, now: str, edited: str | None = None) -> DataFrame:
    """(day, total[, edited_pct]) of the last `days` days up to the date `now`, zero-filled, in UTC."""
    last = F.lit(now).cast("date")
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    aggs = [F.count("*").alias("total")]
    if edited:
        aggs.append((F.avg(F.col(edited).cast("double")) * 100).alias("edited_pct"))
    counts = rows.where(F.to_date(ts).between(F.date_sub(last, days - 1), last)).groupBy(F.to_date(ts).alias("day")).agg(*aggs)
    return spine.join(counts, "day", "left").fillna(0)


def chart_maximum(buckets: DataFrame) -> DataFrame:
    """One row: the scale of a chart of `total`, 1 at least."""
    return buckets.agg(F.greatest(F.lit(1), F.coalesce(F.max("total"), F.lit(1))).cast("long").alias("maximum"))


def field_edits(validations: DataFrame) -> DataFrame:
    """One row: how often each field was edited (by typed JSON value), and in all."""
    v = validations.select(F.parse_json("original").alias("o"), F.parse_json("validated").alias("v"))
    one = v.agg(*[F.count_if(scalars.edited(F.col("o"), F.col("v"), f)).alias(f) for f in config.VALIDATION_FIELDS])
    return one.withColumn("total_edited", sum((F.col(f) for f in config.VALIDATION_FIELDS), F.lit(0)))


def fields_by_edits(validations: DataFrame) -> DataFrame:
    """(place, field, edits) of the six fields, most edited first; ties keep the order of the fields."""
    entry = F.array(*[F.struct((-F.col(f)).alias("k"), F.lit(i).alias("i"), F.lit(f).alias("field"), F.col(f).alias("edits")) for i, f in enumerate(config.VALIDATION_FIELDS)])
    return field_edits(validations).select(F.posexplode(F.array_sort(entry)).alias("place", "e")).select("place", "e.field", "e.edits")


def validation_totals(validations: DataFrame) -> DataFrame:
    """One row: validations, how many were edited by hand, and their percentage (0 if there are none)."""
    edited = F.count_if("manually_edited")
    return validations.agg(F.count("*").alias("total"), edited.alias("edited"), F.coalesce(F.try_divide(edited * 100.0, F.count("*")), F.lit(0.0)).alias("edited_pct"))


def validator_stats(validations: DataFrame, names: DataFrame) -> DataFrame:
    """(validated_by, email, total, edited), most validations first; the e-mail is looked up after the counts."""
    counts = validations.groupBy("validated_by").agg(F.count("*").alias("total"), F.count_if("manually_edited").alias("edited"))
    return counts.join(names.select(F.col("id").alias("validated_by"), "email"), "validated_by", "left").orderBy(F.desc("total"), "validated_by")


def dashboard(docs: DataFrame, results: DataFrame, validations: DataFrame, models: DataFrame) -> DataFrame:
    """One row of the eight figures but the daily counts (see `daily_buckets`)."""
    d = docs.agg(F.count("*").alias("total_documents"), F.count_if(F.col("status") == "validated").alias("validated_documents"), F.count_distinct("owner_id").alias("active_users"))
    r = results.agg(F.avg("confidence").cast("double").alias("average_confidence"))
    e = field_edits(validations).select(F.col("total_edited").alias("total_fields_edited"))
    m = models.agg(F.count_if("active").alias("active_models"))
    pct = F.coalesce(F.try_divide(F.col("validated_documents") * 100.0, F.col("total_documents")), F.lit(0.0))
    return d.crossJoin(r).crossJoin(e).crossJoin(m).withColumn("validation_pct", pct)  # one row each


def dataset_stats(samples: DataFrame) -> DataFrame:
    """(kind, key, n): all samples, by label, by partition."""
    sets = samples.groupingSets([["label"], ["dataset_partition"], []], "label", "dataset_partition").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "label").otherwise("partition")
    return sets.select(kind.alias("kind"), F.coalesce("label", "dataset_partition", F.lit("")).alias("key"), "n")


def pending_counts(items: DataFrame) -> DataFrame:
    """(label, n) of items (idx, label, discarded) that are labelled and not discarded."""
    return items.where("not discarded and label <> ''").groupBy("label").agg(F.count("*").alias("n"))


def class_progress(saved: DataFrame, pending: DataFrame, target: int = config.LABELING_TARGET_PER_CLASS) -> DataFrame:
    """(position, label, saved, pending, total, met) over the whole alphabet; inputs are (label, n)."""
    spine = saved.sparkSession.createDataFrame(list(enumerate(config.OCR_ALPHABET)), "position int, label string")
    out = spine.join(saved.withColumnRenamed("n", "saved"), "label", "left").join(pending.withColumnRenamed("n", "pending"), "label", "left").fillna(0, ["saved", "pending"])
    return out.withColumn("total", F.col("saved") + F.col("pending")).withColumn("met", F.col("total") >= target)


def numbered(rows: DataFrame, key: str, ranges: int = 64) -> DataFrame:
    """`rows` with idx, their place from 0 in the order of the number `key`, nulls first; equal keys in any order.

    Quantiles of the key cut the rows into ranges, which are counted and numbered apart, so where
    keys hardly repeat no task holds more than a few times its share.
    """
    cuts = sorted(set(rows.approxQuantile(key, [k / ranges for k in range(1, ranges)], 0.25 / ranges)))
    cell = sum((F.coalesce(F.col(key) >= c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    dealt = rows.withColumn("_cell", cell)
    counts = dealt.groupBy("_cell").agg(F.count("*").alias("_n"))  # a row a range at most
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_cell").orderBy(key))
    placed = dealt.withColumn("_own", own).join(F.broadcast(counts.select("_cell", before.alias("_before"))), "_cell")
    return placed.withColumn("idx", F.col("_before") + F.col("_own") - 1).drop("_cell", "_own", "_before")


def next_pending(items: DataFrame, after: int) -> DataFrame:
    """One row: the first unlabelled, undiscarded idx after `after`, around the end; null if there is none."""
    n = F.lit(items.count())
    open_ = items.where("not discarded and label = ''").select("idx", F.pmod(F.col("idx") - after - 1, n).alias("step"))
    return open_.agg(F.min_by("idx", "step").alias("next_idx"))


def validation_payload(fields: DataFrame) -> DataFrame:
    """Per document the JSON before and after and the edited fields, from rows
    (document_id, position, field, extracted, corrected, touched); null values differ from untouched ones."""
    edited = F.col("touched") & ~F.col("corrected").eqNullSafe(F.col("extracted"))
    value = F.when(edited, F.col("corrected")).otherwise(F.col("extracted"))
    rows = fields.withColumns({"edited": edited, "value": value})
    entry = F.array_sort(F.collect_list(F.struct("position", "field", "extracted", "value", "edited")))
    out = rows.groupBy("document_id").agg(entry.alias("e"))
    names = F.transform(F.filter("e", lambda x: x["edited"]), lambda x: x["field"])
    as_map = lambda c: F.map_from_entries(F.transform("e", lambda x: F.struct(x["field"], x[c])))
    return out.select("document_id", as_map("extracted").alias("original"), as_map("value").alias("validated"), names.alias("edited_fields"), (F.size(names) > 0).alias("manually_edited"))


def document_detail(docs: DataFrame, results: DataFrame, validations: DataFrame) -> DataFrame:
    """Documents with their latest result and latest validation."""
    r = latest(results, "document_id", "created_at", "line_no", "part").select(F.col("document_id").alias("id"), "confidence", "proveedor", "total", F.col("created_at").alias("result_at"))
    v = latest(validations, "document_id", "validated_at", "line_no", "part").select(F.col("document_id").alias("id"), "validated", "manually_edited", "validated_at")
    return docs.join(r, "id", "left").join(v, "id", "left")


def document_fields(results: DataFrame) -> DataFrame:
    """(document_id, position, field, value_str, value_num, confidence): the six fields in each document's
    latest result; a missing field has null and 0, a result without data has no rows."""
    last = latest(results, "document_id", "created_at", "line_no", "part").withColumn("data", F.try_parse_json("extracted_data")).where("data is not null")

    def row(i: int, f: str) -> Column:
        number = f in config.NUMERIC_VALIDATION_FIELDS
        text = F.lit(None).cast("string") if number else scalars.field_value(F.col("data"), f, "string")
        value = scalars.field_value(F.col("data"), f, "double") if number else F.lit(None).cast("double")
        confidence = F.coalesce(scalars.field_value(F.col("data"), f, "double", "confidence"), F.lit(0.0))
        return F.struct(F.lit(i).alias("position"), F.lit(f).alias("field"), text.alias("value_str"), value.alias("value_num"), confidence.alias("confidence"))

    return last.select("document_id", F.inline(F.array(*[row(i, f) for i, f in enumerate(config.VALIDATION_FIELDS)])))


# --- row-level visibility ---


def is_admin(profiles: DataFrame, uid: object) -> bool:
    return not profiles.where((F.col("id") == uid) & (F.col("role") == "ADMIN")).isEmpty()


def visible(rows: DataFrame, uid: object, admin: bool, owner: str = "owner_id") -> DataFrame:
    """Rows of their owner; all rows for an administrator."""
    return rows if admin else rows.where(F.col(owner) == uid)


def visible_via_parent(rows: DataFrame, docs: DataFrame, uid: object, admin: bool) -> DataFrame:
    """Rows of visible documents."""
    return rows if admin else rows.join(visible(docs, uid, admin).select(F.col("id").alias("document_id")), "document_id", "left_semi")


def admin_only(rows: DataFrame, admin: bool) -> DataFrame:
    return rows.where(F.lit(admin))


def path_visible(path: Column, uid: str, admin: bool) -> Column:
    """Files lie under a folder named by their owner."""
    return F.lit(admin) | (F.split(path, "/")[0] == uid)


def path_writable(path: Column, uid: str) -> Column:
    return F.split(path, "/")[0] == uid


def checked_insert(rows: DataFrame, column: str, uid: object) -> DataFrame:
    """`rows`, or an error when one is written in another's name."""
    bad = ~F.col(column).eqNullSafe(F.lit(uid))
    return rows.withColumn(column, F.when(bad, F.raise_error(F.lit(f"{column} must be the current user"))).otherwise(F.col(column)))


def without_deleted(rows: DataFrame, tombstones: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows whose document has no tombstone (id)."""
    return rows.join(tombstones.select(F.col("id").alias(key)), key, "left_anti")


def active_model(events: DataFrame) -> DataFrame:
    """(document_type, version) now active, from activation events (document_type, version, active, at);
    the last event of a type decides, so at most one is active."""
    return latest(events, "document_type", "at").where("active").select("document_type", "version")


def updated(docs: DataFrame, events: DataFrame) -> DataFrame:
    """Documents with the status of their last status event (id, status, at), and when that was."""
    last = latest(events, "id", "at").select("id", F.col("status").alias("_s"), F.col("at").alias("updated_at"))
    return docs.join(last, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def roles_kept(old: DataFrame, new: DataFrame, service: bool) -> DataFrame:
    """Profiles after an update; a role changes only in the hands of the service."""
    if service:
        return new
    kept = old.select("id", F.col("role").alias("_role"))
    return new.join(kept, "id", "left").withColumn("role", F.coalesce("_role", "role")).drop("_role")


def model_list(models: DataFrame, document_type: str) -> DataFrame:
    """Models of a type, newest first, without their samples."""
    heavy = [c for c in models.columns if c in ("model_data", "samples")]
    return models.where(F.col("document_type") == document_type).drop(*heavy).orderBy(F.desc("created_at"), "version")
