"""Scalar functions: grades, typed field values, labels, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_BLANK = r"[\s\x{A0}]"


def confidence_level(c: Column) -> Column:
    return F.when(c > 0.9, "high").when(c >= 0.75, "medium").otherwise("low")


def trimmed(raw: Column) -> Column:
    return F.regexp_replace(raw, rf"^{_BLANK}+|{_BLANK}+$", "")


def parse_field_value(field: Column, raw: Column) -> Column:
    """struct<ok, value_str, value_num>: blank is null, a numeric field that is no number is not ok.

    Numbers are decimal (with exponent), hexadecimal after 0x, or [+-]Infinity.
    """
    text = trimmed(raw)
    numeric = field.isin(*config.NUMERIC_VALIDATION_FIELDS)
    decimal = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    hexadecimal = F.when(text.rlike(r"^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(text, F.lit(3), F.char_length(text)), 16, 10).try_cast("double"))
    infinite = F.when(text.rlike(r"^[+-]?Infinity$"), F.when(text.startswith("-"), float("-inf")).otherwise(float("inf")))
    number = F.when(numeric & (text != ""), F.coalesce(decimal, hexadecimal, infinite))
    return F.struct(
        (~numeric | (text == "") | number.isNotNull()).alias("ok"), F.when(~numeric & (text != ""), text).alias("value_str"), number.alias("value_num")
    )


def _label(value: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return F.coalesce(table[value], value)


def status_label(status: Column) -> Column:
    return _label(status, config.DOCUMENT_STATUS_LABELS)


def type_label(kind: Column) -> Column:
    return _label(kind, config.DOCUMENT_TYPE_LABELS)


def field_label(field: Column) -> Column:
    return _label(field, config.VALIDATION_FIELD_LABELS)


def local_time(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, config.DISPLAY_ZONE), "dd/MM/yyyy, HH:mm")


def percent(c: Column) -> Column:
    """One decimal and a percent sign; null becomes the empty string."""
    return F.when(c.isNull(), "").otherwise(F.format_string("%.1f%%", c.cast("double") * 100))


def is_uuid(s: Column) -> Column:
    return s.rlike(UUID)


def internal_path(path: Column, default: str = "/") -> Column:
    """The path if it stays within the site, else the default."""
    return F.when(path.startswith("/") & ~path.startswith("//"), path).otherwise(default)


def csv_cell(value: Column) -> Column:
    """One RFC 4180 cell: quoted only if it holds a comma, a quote or a line break; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *map(csv_cell, values))


def field_json(data: Column, field: str) -> Column:
    """Canonical JSON of one field of a VARIANT object, with its type; a missing field is null."""
    return F.coalesce(F.to_json(F.try_variant_get(data, f"$.{field}", "variant")), F.lit("null"))


def field_value(data: Column, field: str, kind: str, part: str = "value") -> Column:
    """Value (or another part) of one extracted field of a VARIANT object; null if missing or not of that kind."""
    return F.try_variant_get(data, f"$.{field}.{part}", kind)


def edited(original: Column, validated: Column, field: str) -> Column:
    """Whether a field differs, by value and type."""
    return field_json(original, field) != field_json(validated, field)
