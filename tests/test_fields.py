import random
import re
import time

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import fields, scalars
from scriptorium.operators import metrics


def extract(spark, *lines):
    boxed = [(t, (0, 25 * i, 100, 20), 0.9) for i, t in enumerate(lines)]
    schema = "raw_text string, lines array<struct<text:string,bbox:struct<x:int,y:int,width:int,height:int>,confidence:double>>"
    return fields.extract_fields(spark.createDataFrame([("\n".join(lines), boxed)], schema)).first()


def test_labelled_fields(spark):
    r = extract(spark, "Proveedor: Acme SAS", "NIT: 900.123.456-7", "Fecha: 2024-05-06", "IVA: 19,00", "Valor: 100.00", "Total: 119.00")
    assert [r[f].value for f in ("proveedor", "nit", "fecha", "iva", "valor", "total")] == ["Acme SAS", "900.123.456-7", "2024-05-06", 19.0, 100.0, 119.0]
    assert [r[f].confidence for f in ("proveedor", "nit", "fecha", "iva", "valor", "total")] == [0.9] + [0.95] * 5
    assert r.total.source_region.y == 125 and r.proveedor.source_region.w == 100


def test_grades(spark):
    r = extract(spark, "Compra 10.00 y 20.00")
    assert (r.iva.value, r.valor.value, r.total.value, r.total.confidence) == (10.0, 10.0, 10.0, 0.5)
    r = extract(spark, "5.00 Total con mucho texto en medio 7.00")
    assert (r.total.value, r.total.confidence) == (5.0, 0.7)
    r = extract(spark, "Subtotal: 1.00", "Total: 2.00")
    assert (r.valor.value, r.total.value) == (1.0, 2.0)
    r = extract(spark, "sin datos")
    assert r.nit.value is None and r.nit.confidence == 0 and r.nit.source_region is None and (r.proveedor.value, r.proveedor.confidence) == ("sin datos", 0.5)
    r = extract(spark, "12", "34")
    assert r.proveedor.value is None and r.proveedor.confidence == 0


def test_borders_and_accents(spark):
    assert extract(spark, "éTotal 3.00").total.confidence == 0.95  # the border is ASCII
    assert extract(spark, "xTotal 3.00").total.confidence == 0.5
    assert extract(spark, "FECHA DE EMISIÓN 01/02/2024").fecha.confidence == 0.95
    assert extract(spark, "SEÑOR: Juan").proveedor.value == "Juan"
    r = extract(spark, "Proveedor:", "Emisor: Beta")
    assert (r.proveedor.value, r.proveedor.source_region.y) == ("Beta", 25)


def test_offsets(spark):
    row = spark.createDataFrame([("a1b22c333",)], "t string").select(fields.matches(F.col("t"), r"\d+").alias("m")).first()
    assert [(m.value, m.start) for m in row.m] == [("1", 1), ("22", 3), ("333", 6)]


def plain_best(found, ends):
    """Index and confidence by comparing every match with every keyword end."""
    if not found:
        return None
    after = [i for i, s in enumerate(found) if any(0 <= s - e <= 15 for e in ends)]
    if after:
        return after[0], 0.95
    near = min(((abs(s - e), i) for i, s in enumerate(found) for e in ends), default=None)
    return (near[1], 0.7) if near else (0, 0.5)


def test_best_match_equals_all_pairs(spark):
    rng = random.Random(1)
    texts = ["", "1.00", "Total"] + ["".join(rng.choice(["Total", "1.23", "77,10 ", " ", "x" * 9, " y " * 6, "\n", "ñ🙂 "]) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fields.best_match(F.col("t"), fields.MONEY_PATTERN, ("Total",)).alias("b")).collect()
    kinds = set()
    for r in rows:
        t = texts[r.i]
        found = [(m.group(), m.start()) for m in re.finditer(r"[0-9]+[.,][0-9]{2}", t)]
        want = plain_best([s for _, s in found], [m.end() for m in re.finditer(r"(?<![A-Za-z0-9_])Total(?![A-Za-z0-9_])", t)])
        kinds.add(want and want[1])
        assert (r.b and tuple(r.b)) == (want and (found[want[0]][0], want[1], found[want[0]][1])), t
    assert kinds == {None, 0.95, 0.7, 0.5}


def test_best_match_is_linear_in_the_text(spark):
    """Eight times as many matches and keywords take far less than 64 times as long."""

    def seconds(n):
        text = "y Total " + "z" * 30 + " 12.34 " + "w" * 40
        rows = spark.createDataFrame([(text * n,)], "t string").cache()
        query = rows.select(fields.best_match(F.col("t"), fields.MONEY_PATTERN, ("Total",)).alias("b"))
        took = []
        for _ in range(3):
            began = time.perf_counter()
            assert query.first().b.confidence == 0.7
            took.append(time.perf_counter() - began)
        return min(took)

    seconds(100)
    small, large = seconds(2_000), seconds(16_000)
    assert large < 24 * small


def test_metrics_of_fields(spark):
    found = [(1, "nit", "9", None, 0.9), (2, "nit", "8", None, 0.8), (3, "nit", None, None, 0.0), (1, "iva", None, 1.0049, 0.5), (2, "iva", None, 1.006, 0.5), (3, "iva", None, None, 0.0)]
    truth = [(d, f, "9" if f == "nit" else None, None if f == "nit" else 1.0) for d in (1, 2, 3) for f in ("nit", "iva")]
    schema = "doc_id int, field string, value_str string, value_num double"
    m = metrics.field_metrics(spark.createDataFrame(found, schema + ", confidence double"), spark.createDataFrame(truth, schema))
    rows = {r.field: r for r in m.collect()}
    assert (rows["nit"].precision, rows["nit"].recall, rows["nit"].f1, rows["nit"].accuracy) == (0.5, 0.5, 0.5, pytest.approx(1 / 3))
    assert (rows["iva"].tp, rows["iva"].fp, rows["iva"].fn) == (1, 1, 1)
    assert (rows["total"].precision, rows["total"].recall, rows["total"].accuracy) == (1, 1, 0)


def test_never_found(spark):
    schema = "doc_id int, field string, value_str string, value_num double"
    m = metrics.field_metrics(spark.createDataFrame([(1, "iva", None, None, 0.0)], schema + ", confidence double"), spark.createDataFrame([(1, "iva", None, 2.0)], schema))
    r = m.where("field = 'iva'").first()
    assert (r.precision, r.recall, r.f1) == (1, 0, 0)


def test_benchmark(spark):
    t = spark.createDataFrame([(10.0, 20.0, 100.0, 5.0, 135.0), (10.0, 30.0, 105.0, 5.0, 150.0), (10.0, 10.0, 95.0, 5.0, 120.0), (20.0, 20.0, 200.0, 10.0, 250.0)], "preprocess double, segmentation double, recognition double, extraction double, total double")
    r = metrics.benchmark(t).first()
    assert (r.mean_ms, r.p95, r.p99, r.bottleneck) == (163.75, 250, 250, "recognition")
    r = metrics.benchmark(t.where("false")).first()
    assert (r.documents, r.mean_ms, r.throughput, r.bottleneck) == (0, 0, 0, "recognition")


def test_scalars(spark):
    df = spark.createDataFrame([("total", " 1e3 "), ("total", "x"), ("nit", " a "), ("iva", ""), ("iva", "0x10"), ("valor", "1,5")], "f string, v string")
    got = [(r.p.ok, r.p.value_str, r.p.value_num) for r in df.select(scalars.parse_field_value(F.col("f"), F.col("v")).alias("p")).collect()]
    assert got == [(True, None, 1000.0), (False, None, None), (True, "a", None), (True, None, None), (True, None, 16.0), (False, None, None)]
    one = spark.range(1).select(
        scalars.local_time(F.lit("2026-08-11 22:53:00").cast("timestamp")).alias("t"), scalars.percent(F.lit(0.0)).alias("zero"), scalars.percent(F.lit(None).cast("double")).alias("none"),
        scalars.percent(F.lit(0.87)).alias("p"), scalars.csv_line(F.lit('a"b'), F.lit("x,y"), F.lit(None), F.lit(1.5), F.lit("l\nm")).alias("c"), scalars.internal_path(F.lit("//x")).alias("i"),
    ).first()
    assert tuple(one) == ("11/08/2026, 17:53", "0.0%", "", "87.0%", '"a""b","x,y",,1.5,"l\nm"', "/")
    levels = spark.createDataFrame([(0.9,), (0.91,), (0.75,), (0.74,)], "c double").select(scalars.confidence_level(F.col("c")))
    assert [r[0] for r in levels.collect()] == ["medium", "high", "medium", "low"]
