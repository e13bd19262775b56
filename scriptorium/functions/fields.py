"""Extraction of the six invoice fields from recognised text, as column expressions.

Input rows have `raw_text` (lines joined by newlines) and `lines`, an array of
struct<text, bbox struct<x, y, width, height>, confidence>.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config

# The patterns and keywords decide which text is a field.
NIT_PATTERN = r"\d{1,3}\.\d{3}\.\d{3}-\d{1}|\d{9,11}"
FECHA_PATTERN = r"\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{4}"
MONEY_PATTERN = r"\d+[.,]\d{2}"
NIT_KEYWORDS = ("NIT", "N.I.T")
FECHA_KEYWORDS = ("Fecha", "Emisión", "Emision", "Date")
IVA_KEYWORDS = ("IVA", "Impuesto")
VALOR_KEYWORDS = ("Valor", "Subtotal")
TOTAL_KEYWORDS = ("Total",)
PROVEEDOR_KEYWORDS = ("Proveedor", "Emisor", "Razón Social", "Razon Social", "Señor", "Senor")

STRING_FIELDS = {"nit": (NIT_PATTERN, NIT_KEYWORDS), "fecha": (FECHA_PATTERN, FECHA_KEYWORDS)}
MONEY_FIELDS = {"iva": IVA_KEYWORDS, "valor": VALOR_KEYWORDS, "total": TOTAL_KEYWORDS}
#: White space of the engine's trims: ASCII and the no-break space.
_BLANK = r"[\s\x{A0}]"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def keyword_pattern(keywords: tuple[str, ...]) -> str:
    """Any of the keywords between ASCII word borders, in any case (also of accented letters)."""
    either = lambda k: re.sub(r"[^\x00-\x7f]", lambda c: f"[{c[0].lower()}{c[0].upper()}]", re.escape(k).replace(r"\ ", " "))
    return r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(map(either, keywords)) + r")(?![A-Za-z0-9_])"


def running_sums(numbers: Column) -> Column:
    """Sums of all numbers up to each one, by doubling: step k adds what lies 2^k places before, so
    n numbers take log2(n) passes over the array."""
    powers = F.array(*[F.lit(1 << k) for k in range(31)])
    places = F.slice(powers, F.lit(1), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int"))
    add = lambda acc, d: F.transform(acc, lambda v, i: v + F.when(i >= d, F.get(acc, i - d)).otherwise(0))
    return F.aggregate(places, numbers, add)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<value, start>> of all matches, left to right; start counts from 0."""

    def placed(gaps: Column, found: Column) -> Column:
        """A match ends where the lengths of the gaps and matches so far end."""
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.char_length(g) + F.char_length(m))
        return F.zip_with(found, running_sums(lengths), lambda m, end: F.struct(m.alias("value"), (end - F.char_length(m)).alias("start")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: _let(F.split(text, pattern, -1), lambda g: placed(g, m)))


def keyword_ends(text: Column, keywords: tuple[str, ...]) -> Column:
    return F.transform(matches(text, keyword_pattern(keywords)), lambda k: k["start"] + F.char_length(k["value"]))


_MATCH = pa.struct([("value", pa.string()), ("confidence", pa.float64()), ("start", pa.int32())])


def _best(text: str | None, pattern: re.Pattern, keys: re.Pattern) -> dict | None:
    """One sweep over the matches and the ends of keywords, in order of place: the only keywords that
    count for a match are the last end before it and the first end after it."""
    found = list(pattern.finditer(text or ""))
    ends = [k.end() for k in keys.finditer(text)] if found else []
    at, least, near, confidence = 0, None, found[0] if found else None, 0.5
    for m in found if ends else ():
        while at < len(ends) and ends[at] <= m.start():
            at += 1
        if at and m.start() - ends[at - 1] <= config.ADJACENT_WINDOW:
            near, confidence = m, 0.95
            break
        d = min(abs(m.start() - e) for e in ends[max(at - 1, 0) : at + 1])
        if least is None or d < least:
            least, near, confidence = d, m, 0.7
    return near and {"value": near[0], "confidence": confidence, "start": near.start()}


def best_match(text: Column, pattern: str, keywords: tuple[str, ...]) -> Column:
    """struct<value, confidence, start>, null without a match: right after a keyword 0.95, nearest
    to one 0.7, the first without any keyword 0.5.  Texts go through Arrow, a batch at a time."""
    sought, keys = re.compile(pattern, re.ASCII), re.compile(keyword_pattern(keywords), re.ASCII)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_best(t, sought, keys) for t in texts.to_pylist()], _MATCH)

    return F.arrow_udf(run, "value string, confidence double, start int")(text)


def region_at(lines: Column, start: Column) -> Column:
    """Box of the line that holds an offset of the joined text; a newline belongs to the line before it."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(-1).alias("hit"), start.cast("int").alias("start"))

    def step(acc: Column, line: Column) -> Column:
        end = acc["at"] + F.char_length(line["text"])
        hit = F.when((acc["hit"] < 0) & (end >= acc["start"]), acc["i"]).otherwise(acc["hit"])
        return F.struct((end + 1).alias("at"), (acc["i"] + 1).alias("i"), hit.alias("hit"), acc["start"].alias("start"))

    hit = F.aggregate(lines, zero, step, lambda acc: acc["hit"])
    return _let(hit, lambda i: _region(F.get(lines, i)["bbox"]))


def _region(b: Column) -> Column:
    return F.when(b.isNotNull(), F.struct(b["x"].alias("x"), b["y"].alias("y"), b["width"].alias("w"), b["height"].alias("h")))


def _field(value: Column, confidence: Column, region: Column) -> Column:
    return F.struct(value.alias("value"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"), region.alias("source_region"))


def string_field(text: Column, lines: Column, pattern: str, keywords: tuple[str, ...]) -> Column:
    m = best_match(text, pattern, keywords)
    return _field(m["value"], m["confidence"], region_at(lines, m["start"]))


def money_field(text: Column, lines: Column, keywords: tuple[str, ...]) -> Column:
    m = best_match(text, MONEY_PATTERN, keywords)
    return _field(F.replace(m["value"], F.lit(","), F.lit(".")).cast("double"), m["confidence"], region_at(lines, m["start"]))


def proveedor_field(lines: Column) -> Column:
    """What follows a supplier keyword in its line (0.9), else the first line with a word (0.5)."""

    def after(line: Column) -> Column:
        rests = [F.regexp_extract(line["text"], keyword_pattern((k,)) + rf"{_BLANK}*[:.]?{_BLANK}*((?s:.*))$", 1) for k in PROVEEDOR_KEYWORDS]
        rests = [F.regexp_replace(r, rf"^{_BLANK}+|{_BLANK}+$", "") for r in rests]
        return F.struct(F.coalesce(*[F.nullif(r, F.lit("")) for r in rests]).alias("value"), line["bbox"].alias("b"))

    keyed = F.filter(lines, lambda line: line["text"].rlike(keyword_pattern(PROVEEDOR_KEYWORDS)))
    named = F.get(F.filter(F.transform(keyed, after), lambda r: r["value"].isNotNull()), 0)
    guess = F.get(F.filter(lines, lambda line: line["text"].rlike("[A-Za-z]{3,}")), 0)
    other = lambda g: _field(g["text"], F.when(g.isNotNull(), 0.5), _region(g["bbox"]))
    return _let(named, lambda n: F.when(n.isNotNull(), _field(n["value"], F.lit(0.9), _region(n["b"]))).otherwise(_let(guess, other)))


def extract_fields(ocr: DataFrame) -> DataFrame:
    """`ocr` with a struct<value, confidence, source_region> for each of the six fields."""
    text, lines = F.col("raw_text"), F.col("lines")
    found = {"proveedor": proveedor_field(lines)}
    found |= {k: string_field(text, lines, *v) for k, v in STRING_FIELDS.items()}
    found |= {k: money_field(text, lines, v) for k, v in MONEY_FIELDS.items()}
    return ocr.withColumns(found)


def long_fields(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, position, field, value_str, value_num, confidence, source_region): six rows a document."""
    one = lambda i, f: F.struct(
        F.lit(i).alias("position"),
        F.lit(f).alias("field"),
        (F.lit(None).cast("string") if f in config.NUMERIC_VALIDATION_FIELDS else F.col(f)["value"]).alias("value_str"),
        (F.col(f)["value"] if f in config.NUMERIC_VALIDATION_FIELDS else F.lit(None).cast("double")).alias("value_num"),
        F.col(f)["confidence"].alias("confidence"),
        F.col(f)["source_region"].alias("source_region"),
    )
    return rows.select(key, F.inline(F.array(*[one(i, f) for i, f in enumerate(config.VALIDATION_FIELDS)])))
