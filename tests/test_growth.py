"""What a task holds and how often inputs are read, as inputs grow."""

import tracemalloc

import numpy as np
import pandas as pd

from scriptorium.functions import kernels
from scriptorium.operators import knn, metrics
from scriptorium.plans import ocr, script


def test_a_search_holds_a_tile_of_distances():
    rng = np.random.default_rng(0)
    x, q = rng.random((60_000, 8)).astype(np.float32), rng.random((256, 8)).astype(np.float32)
    x[500:900] = x[:400]  # ties
    model = kernels.Neighbours(x, ["a"] * len(x))
    tracemalloc.start()
    near = model.nearest(np.concatenate([q, x[:40]]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    for v, (ids, d) in zip(np.concatenate([q, x[:40]]).astype(float), near, strict=True):
        plain = np.sqrt(((v - x.astype(float)) ** 2).sum(1))
        assert ids.tolist() == np.lexsort((np.arange(len(x)), plain))[:3].tolist() and np.allclose(d, plain[ids])


def test_a_query_is_sent_to_a_shelf_once(spark):
    rng = np.random.default_rng(1)
    model = spark.createDataFrame([(i, "l", rng.random(6).tolist()) for i in range(1000)], "sample_idx long, label string, descriptor array<float>")
    asked = spark.createDataFrame([(i, rng.random(6).tolist()) for i in range(30)], "q long, descriptor array<float>")
    blocks = knn.Blocks(model, 10)
    assert len(blocks.rows) > 50
    for limits in (asked.selectExpr("q", "descriptor", "1e9 limit"),):  # nothing is ruled out
        assert blocks._shelved(limits, 3, True).count() == 30


def test_queries_leave_for_many_shelves_a_few_at_a_time():
    import pyarrow as pa

    n, shelves = 1000, 40
    asked = pa.RecordBatch.from_pydict({"q": pa.array(range(n), pa.int64()), "descriptor": pa.array([[float(i), 0.5] for i in range(n)], pa.list_(pa.float32()))})
    shelf = np.repeat(np.arange(shelves, dtype=np.int32), 2)  # of two blocks each
    q, block = np.nonzero(np.random.default_rng(3).random((n, 2 * shelves)) < 0.9)
    sent = list(knn._sent(asked, q, block, shelf))
    assert max(len(b) for b in sent) <= knn.QUERY_ROWS < sum(len(b) for b in sent)
    rows = [r for b in sent for r in b.to_pylist()]
    assert len({(r["q"], r["shelf"]) for r in rows}) == len(rows) and all(r["descriptor"] == [float(r["q"]), 0.5] for r in rows)
    assert [(r["q"], b) for r in rows for b in r["blocks"]] == list(zip(q.tolist(), block.tolist(), strict=True))
    assert all(shelf[b] == r["shelf"] for r in rows for b in r["blocks"])
    assert list(knn._sent(asked, q[:0], block[:0], shelf)) == []


def test_stacked_descriptors_are_those_of_each_image():
    stack = np.random.default_rng(2).integers(0, 256, (9, 32, 32)).astype(np.uint8)
    assert (kernels.hogs(stack) == np.array([kernels.hog(g) for g in stack])).all()


def test_runs_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [(d, k, "t" if d else f"t{k}", 0.5 + k * d / 8, "p", "n", None, 1.0 + k * d, 2.0 if d < 2 or k else None, 3.0) for d in range(3) for k in range(3)]
    rows.append((9, 1, "t", 0.5, "p", "n", None, 1.0, 2.0, 3.0))  # without a first run
    kind = "doc_id long, run int, raw_text string, confidence double, proveedor string, nit string, fecha string, iva double, valor double, total double"

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    got = {r.doc_id: r for r in metrics.reproducibility(spark.createDataFrame(rows, kind).mapInPandas(count, kind)).collect()}
    assert seen.value == len(rows) and sorted(got) == [0, 1, 2]
    assert [got[d].same_text for d in range(3)] == [False, True, True]
    assert [got[d].same_fields for d in range(3)] == [True, False, False]
    for d in range(3):
        own = pd.DataFrame([r[7:] for r in rows if r[0] == d], columns=["iva", "valor", "total"]).dropna(axis=1).to_numpy()
        assert abs(got[d].value_variance - own.var()) < 1e-12
        assert abs(got[d].confidence_variance - np.var([r[3] for r in rows if r[0] == d])) < 1e-12


def test_pages_and_results_leave_tasks_a_few_at_a_time(spark):
    docs = spark.createDataFrame([(i, f"A{i}") for i in range(40)], "doc_id long, raw_text string").coalesce(1)
    sizes = script.png_pages(docs).selectExpr("name", "hex(substring(content, 17, 8)) size").collect()
    assert len({r.name for r in sizes}) == 40
    page = script.page(["A7"])
    assert {r.name: r.size for r in sizes}["7.png"] == f"{page.shape[1]:08X}{page.shape[0]:08X}"
    assert script.PAGES <= 16 and ocr.IMAGES <= 16


def test_fields_are_found_without_sweeps_of_expressions(spark):
    from pyspark.sql import functions as F

    from scriptorium.functions import fields

    rows = spark.createDataFrame([(1, "x 1.00 Total 2.00"), (2, "é 3.00"), (3, None), (4, "5.00 ááááááááááááááááááááá TOTAL"), (5, "")], "i int, t string")
    found = rows.select("i", fields.best_match(F.col("t"), fields.MONEY_PATTERN, ("Total",)).alias("b"))
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.i: r.b and tuple(r.b) for r in found.collect()} == {1: ("2.00", 0.95, 13), 2: ("3.00", 0.5, 2), 3: None, 4: ("5.00", 0.7, 0), 5: None}


def test_small_groups_share_batches_and_large_ones_span_them(spark):
    import pyarrow as pa

    from scriptorium.operators import pixels

    calls = spark.sparkContext.accumulator(0)

    def run(t):
        calls.add(1)
        return pa.table({"k": t["k"][:1], "n": pa.array([len(t)], pa.int64()), "total": pa.array([sum(t["v"].to_pylist())], pa.int64())})

    rows = spark.range(25_000).selectExpr("case when id < 21000 then 0 when id = 24999 then null else id div 7 end k", "id v")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        found = {r.k: (r.n, r.total) for r in pixels.by_group(rows, ["k"], run, "k long, n long, total long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r.k: (r.n, r.total) for r in rows.groupBy("k").agg({"*": "count", "v": "sum"}).toDF("k", "a", "b").selectExpr("k", "least(a, b) n", "greatest(a, b) total").collect()}
    assert found == want and calls.value == len(want)


def test_validations_are_dealt_out_before_they_are_parsed(spark):
    from scriptorium.plans import fixtures

    v = fixtures.validations(spark, "/root/testdata/sf0.001")
    assert v.rdd.getNumPartitions() >= 1 and "Exchange" in v._jdf.queryExecution().executedPlan().toString()
