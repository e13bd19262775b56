import datetime
import json
import random
import re
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import metrics, paging, repository, training
from scriptorium.plans import reports
from scriptorium.sources import files, images, tables
from scriptorium.streaming import ingest, profiles


def test_pages():
    assert [repository.page(), repository.page(0, 500), repository.page(2.9, 3.7), repository.page(-1, 0)] == [(1, 20), (1, 100), (2, 3), (1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a", 1, "uploaded", "2020-01-01 00:00:00"), ("b", 1, "processed", "2020-06-01 10:00:00"), ("c", 2, "failed", "2020-12-31 00:00:00")], "id string, owner_id int, status string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame([("b", 1, 1, 0.87, "2020-06-01", "Acme Corp", 150000.0), ("b", 1, 2, 0.5, "2020-05-01", "Beta", 5.0)], "document_id string, line_no int, part int, confidence double, created_at string, proveedor string, total double")


def test_filters(docs, results):
    ids = lambda **k: [r.id for r in repository.list_documents(docs, results, repository.Filters(**k), uuid_ids=k.pop("uuid", True)).collect()]
    assert ids() == ["c", "b", "a"] and ids(status="failed") == ["c"] and ids(owner_id=1) == ["b", "a"]
    assert ids(date_from="2020-06-01") == ["c", "b"] and ids(date_to="2020-06-01") == ["a"] and ids(date_to="2020-06-01", inclusive_day=True) == ["b", "a"]
    assert ids(provider="acme") == ["b"] and ids(provider="nobody") == [] and ids(min_amount=0) == ["b"] and ids(min_amount=10, provider="beta") == []
    assert ids(document_id="not a uuid") == ["c", "b", "a"]
    assert [len(r.ocr_results) for r in repository.with_results(docs, results).orderBy("id").collect()] == [0, 2, 0]


def test_pages_of_an_index(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"t{i % 3}", datetime.datetime(2024, 1, 1 + rng.randrange(5))) for i in range(237)]
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[2].timestamp(), r[0]))]
    df = spark.createDataFrame(rows, "id long, kind string, created_at timestamp")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index = paging.PageIndex.build(df.repartition(3), str(tmp_path / "a"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index._index().count() > 2 and index.total() == 237
    for number in range(1, 9):
        got = index.page(number, 30).orderBy("position").collect()
        assert [r.id for r in got] == want[30 * number - 30 : 30 * number] and {r.exact_total for r in got} == {237}
        assert [r.position for r in got] == list(range(30 * number - 30, min(237, 30 * number)))
    assert [tuple(r) for r in index.page(99, 30).collect()] == [(99, 237, None, None, None, None)]
    scans = [x for x in index.page(5, 30)._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    assert len(scans) == 1 and re.search(r"PartitionFilters: \[[^\]]*_range", scans[0])
    none = paging.PageIndex.build(df.where("false"), str(tmp_path / "b"))
    assert [tuple(r) for r in none.page(1, 10).collect()] == [(1, 0, None, None, None, None)]


def test_latest_and_detail(docs, results, spark):
    assert repository.latest(results, "document_id", "created_at").first().confidence == 0.87
    v = spark.createDataFrame([], "document_id string, line_no int, part int, original string, validated string, manually_edited boolean, validated_by int, validated_at timestamp")
    assert [r.confidence for r in repository.document_detail(docs, results, v).orderBy("id").collect()] == [None, 0.87, None]


def test_edits_are_typed(spark):
    v = spark.createDataFrame([('{"nit":"10","total":1}', '{"nit":10,"total":1.0}'), ('{"iva":null}', "{}"), ('{"iva":2}', '{"iva":3}')], "original string, validated string")
    r = repository.field_edits(v).first()
    assert (r.nit, r.iva, r.total, r.total_edited) == (1, 1, 0, 2)


def test_buckets(spark):
    rows = spark.createDataFrame([("2024-01-05 23:59:00", True), ("2024-01-05 00:00:00", False), ("2024-01-07 12:00:00", False)], "t string, e boolean").withColumn("t", F.to_timestamp("t"))
    out = [(str(r.day), r.total, r.edited_pct) for r in repository.daily_buckets(rows, "t", 3, "2024-01-07", "e").orderBy("day").collect()]
    assert out == [("2024-01-05", 2, 50.0), ("2024-01-06", 0, 0.0), ("2024-01-07", 1, 0.0)]


def test_rows_are_numbered_in_order(spark):
    keys = [None, 5, -3, 5, 1 << 40, 0, None, *range(100, 400, 3)]
    rows = spark.createDataFrame([(k, "x") for k in keys], "k long, other string").repartition(5)
    got = {r.idx: r.k for r in repository.numbered(rows, "k", 7).collect()}
    assert [got[k] for k in range(len(keys))] == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert repository.numbered(rows.limit(0), "k").columns == ["k", "other", "idx"] and repository.numbered(rows.limit(0), "k").isEmpty()


def test_progress_and_pending(spark):
    items = spark.createDataFrame([(0, "a", False), (1, "", True), (2, "", False), (3, "", False)], "idx long, label string, discarded boolean")
    assert [repository.next_pending(items, k).first().next_idx for k in (0, 2, 3)] == [2, 3, 2]
    assert repository.next_pending(items.where("label = 'a'"), 0).first().next_idx is None
    saved = spark.createDataFrame([("a", 99)], "label string, n long")
    r = repository.class_progress(saved, repository.pending_counts(items)).where("label = 'a'").first()
    assert (r.saved, r.pending, r.total, r.met) == (99, 1, 100, True)


def test_visibility(docs, results, spark):
    assert [r.id for r in repository.visible(docs, 2, False).collect()] == ["c"] and repository.visible(docs, 2, True).count() == 3
    assert repository.visible_via_parent(results, docs, 2, False).count() == 0 and repository.visible_via_parent(results, docs, 1, False).count() == 2
    assert repository.admin_only(docs, False).count() == 0
    with pytest.raises(Exception, match="owner_id"):
        repository.checked_insert(docs, "owner_id", 1).collect()
    old = spark.createDataFrame([(1, "USER")], "id int, role string")
    new = spark.createDataFrame([(1, "ADMIN")], "id int, role string")
    assert repository.roles_kept(old, new, False).first().role == "USER" and repository.roles_kept(old, new, True).first().role == "ADMIN"


def test_confusion(spark):
    pairs = spark.createDataFrame([("1", "1", 0), ("7", "1", 1), ("7", "7", 2), ("9", "1", 3)], "expected string, predicted string, i int")
    labels = spark.createDataFrame([("1",), ("7",)], "label string")
    m = {(r.actual, r.predicted): r.n for r in metrics.confusion_matrix(pairs, labels).collect()}
    assert m == {("1", "1"): 1, ("1", "7"): 0, ("7", "1"): 1, ("7", "7"): 1}
    assert metrics.accuracy(pairs).first().accuracy == 0.5 and metrics.accuracy(pairs.where("false")).first().accuracy is None and metrics.accuracy(pairs.where("false"), 0.0).first().accuracy == 0
    assert [(r.actual, r.predicted, r.n) for r in metrics.top_misclassifications(pairs, "i").collect()] == [("7", "1", 1), ("9", "1", 1)]


def test_split_and_training(spark):
    rows = [(i, "A" if i < 10 else "B", [100.0 * (i < 10), float(i)]) for i in range(14)]
    s = spark.createDataFrame(rows, "sample_idx long, label string, descriptor array<float>")
    n = {(r.label, r.train): r["count"] for r in training.stratified_split(s).groupBy("label", "train").count().collect()}
    assert n == {("A", True): 8, ("A", False): 2, ("B", True): 3, ("B", False): 1}
    for bad in (0, 1):
        with pytest.raises(ValueError):
            training.stratified_split(s, bad)
    done = training.train(s)
    assert done["accuracy"] == 1.0 and done["warning"] is None and done["matrix"].count() == 4
    parts = s.withColumn("dataset_partition", F.lit("train"))
    assert training.train_on_partitions(parts)[1] is None
    with pytest.raises(ValueError):
        training.evaluate_active(s, parts)


def test_synthesis_repeats_itself(spark):
    a, b = (training.synthesize(spark, ["1", "A"], 3, fonts=("Arial",)).orderBy("sample_idx").collect() for _ in range(2))
    assert a == b and len(a) == 6 and all(len(r.gray) == 32 * 32 for r in a) and a[0].source_document.startswith("synthetic:Arial:rot")


def test_storage(spark, tmp_path):
    root = str(tmp_path)
    s = spark.createDataFrame([(0, "a", [0.5], "train")], "sample_idx long, label string, descriptor array<float>, dataset_partition string")
    assert tables.save_samples(s, root) == 1 and tables.save_samples(s.where("false"), root) == 0
    with pytest.raises(ValueError):
        tables.save_samples(s.withColumn("label", F.lit("ab")), root)
    data = tables.model_json(s)
    assert json.loads(data) == {"samples": [{"descriptor": [0.5], "label": "a"}]}
    version = tables.save_model(spark, root, "invoice_es", "v1", data, synthetic=True)
    assert version == "synthetic-v1"
    models = tables.scan(spark, root, "ocr_models").withColumn("active", F.lit(True))
    assert [(r.sample_idx, r.label, r.descriptor) for r in tables.read_model(models, "invoice_es").collect()] == [(0, "a", [0.5])]
    with pytest.raises(Exception, match="more than one active"):
        tables.read_model(models.union(models), "invoice_es").collect()
    tables.activate(spark, root, "invoice_es", "v1")
    tables.activate(spark, root, "invoice_es", "v2")
    assert [r.version for r in repository.active_model(tables.scan(spark, root, "model_events")).collect()] == ["v2"]
    tables.activate(spark, root, "invoice_es", "v2", active=False)
    assert repository.active_model(tables.scan(spark, root, "model_events")).count() == 0
    v = spark.createDataFrame([("d", True)], "document_id string, manually_edited boolean")
    tables.save_validation(v, root)
    assert [r.action for r in tables.entries(spark, root, "audit_logs").collect()] == ["OCR_CORRECTED"]
    tables.save_ocr_result(spark.createDataFrame([("d", 0.8765, 12.5)], "document_id string, confidence double, processing_ms double"), root)
    r = tables.entries(spark, root, "ocr_results").first()
    assert (str(r.confidence), r.processing_ms) == ("0.877", 13)
    assert tables.audit(v, "/proc/none", "LOGIN") is False
    gone = spark.createDataFrame([("d",)], "id string")
    tables.delete_document(gone, root)
    assert repository.without_deleted(tables.entries(spark, root, "ocr_results"), tables.scan(spark, root, "tombstones")).count() == 0
    tables.create_document(gone, root)
    assert tables.scan(spark, root, "documents").first().status == "uploaded"


def test_a_unit_that_fails_half_way_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(40).repartition(8).select(F.concat(F.lit("d"), "id").alias("document_id"), (F.col("id") % 4 == 0).alias("manually_edited"))
    tables.save_validation(rows, root)
    counts = lambda: {t: tables.entries(spark, root, t).count() for t in ("document_validations", "status_events", "audit_logs")}
    assert set(counts().values()) == {40}
    assert {(r.action, r.n) for r in tables.entries(spark, root, "audit_logs").groupBy("action").agg(F.count("*").alias("n")).collect()} == {("OCR_CORRECTED", 10), ("OCR_VALIDATED", 30)}
    bad = rows.withColumn("manually_edited", F.when(F.col("document_id") == "d33", F.raise_error(F.lit("half-way")).cast("boolean")).otherwise(F.col("manually_edited")))
    with pytest.raises(Exception, match="half-way"):
        tables.save_validation(bad, root)
    assert set(counts().values()) == {40}
    with pytest.raises(Exception, match="half-way"):
        tables.save_ocr_result(bad.select(F.when(F.col("manually_edited"), "x").otherwise("y").alias("document_id"), F.lit(0.5).alias("confidence"), F.lit(1.0).alias("processing_ms")), root)
    assert not (tmp_path / "journal" / "kind=ocr_results").exists() and set(counts().values()) == {40}


def test_models_of_many_parts(spark, tmp_path):
    root = str(tmp_path)
    model = spark.range(0, 9000, 3).select(F.col("id").alias("sample_idx"), F.when(F.col("id") % 2 == 0, 'a"').otherwise("b").alias("label"), F.array(F.rand(3), F.lit(-1e-7), F.col("id") / 7).cast("array<float>").alias("descriptor"))
    model = spark.createDataFrame(model.collect(), model.schema).repartition(3)
    tables.save_model_parts(model, root, "invoice_es", "v1")
    tables.save_model_parts(model.limit(10), root, "invoice_es", "v2")
    assert tables.scan(spark, root, "ocr_model_parts").where("version = 'v1'").count() == 10
    as_set = lambda df: {(r.sample_idx, r.label, *r.descriptor) for r in df.collect()}
    assert as_set(tables.read_model_parts(spark, root, "invoice_es", "v1")) == as_set(model)
    whole = tables.scan(spark, root, "ocr_model_parts").where("version = 'v1'")
    for k, damaged in enumerate((whole.where("part <> 4"), whole.where("part <> -1"), whole.withColumn("payload", F.replace("payload", F.lit("1"), F.lit("2"))), whole.union(whole))):
        damaged.write.parquet(f"{root}/{k}/ocr_model_parts")
        with pytest.raises(ValueError, match="not whole"):
            tables.read_model_parts(spark, f"{root}/{k}", "invoice_es", "v1")


def test_files_of_no_live_document_are_swept(spark, tmp_path):
    root = str(tmp_path)
    new = spark.createDataFrame([(k, f"{k}.png", bytes([k])) for k in range(6)], "id long, name string, content binary")
    tables.create_document(new.where("id < 4"), root)
    with pytest.raises(Exception, match="refused"):
        tables.create_document(new.where("id >= 4").withColumn("id", F.when(F.col("id") == 5, F.raise_error(F.lit("refused")).cast("long")).otherwise(F.col("id"))), root)
    tables.delete_document(new.where("id = 2").select("id"), root)
    documents, gone = tables.scan(spark, root, "documents"), tables.scan(spark, root, "tombstones")
    assert {r.status for r in documents.collect()} == {"uploaded"} and documents.count() == 4
    name = lambda rows: sorted(Path(r.path).name for r in rows.collect())
    assert name(tables.orphans(spark, root, documents, gone)) == ["2.png", "4.png", "5.png"]
    assert name(tables.orphans(spark, root, documents, gone, datetime.datetime(2000, 1, 1))) == []
    assert tables.sweep(spark, root) == 3 and tables.sweep(spark, root) == 0
    assert name(files.list_files(spark, f"{root}/files")) == ["0.png", "1.png", "3.png"]


def test_text_outputs(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'a"b', None), (1, "x,y", "z")], "n int, s string, t string")
    for many in (rows.repartition(5), rows.coalesce(1)):
        path = files.write_csv(many, ["N", "S, quoted", "T"], str(tmp_path), f"r{uuid.uuid4().hex}", "2024-01-01", ("n",))
        assert path.endswith("-2024-01-01.csv")
        assert b"".join(p.read_bytes() for p in sorted(Path(path).iterdir())) == b'N,"S, quoted",T\r\n1,"x,y",z\r\n2,"a""b",'
    empty = files.write_csv(rows.where("false"), ["N"], str(tmp_path), "none", "2024-01-01", ("n",))
    assert b"".join(p.read_bytes() for p in sorted(Path(empty).iterdir())) == b"N"
    big = spark.range(5000).select("id", F.lit("é\n").alias("t")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = files.write_csv(big, ["ID", "T"], str(tmp_path), "big", "2024-01-01", (F.desc("id"),))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(path).iterdir())) > 2
    assert b"".join(p.read_bytes() for p in sorted(Path(path).iterdir())).decode() == "ID,T" + "".join(f'\r\n{i},"é\n"' for i in reversed(range(5000)))
    with pytest.raises(Exception, match="broken"):
        files.write_csv(big.withColumn("t", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise("x")), ["ID", "T"], str(tmp_path), "bad", "2024-01-01", ("id",))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("bad")]
    one = json.loads(tables.stats_json(spark.range(1).select(F.lit(3).alias("total")), spark.sql("select date'2024-01-01' day, 2 total")))
    assert one == {"total": 3, "documents_per_day": [{"day": "2024-01-01", "total": 2}]}
    svg = reports.hog_svg([0.5] + [0.0] * 107)
    assert svg.count("<polygon") == 1 and svg.startswith("<svg")
    with pytest.raises(ValueError):
        reports.hog_svg([1.0])
    text = reports.evaluation_report(
        "synthetic", "2024-01-01", {"accuracy": 0.9, "correct": 9, "total": 10, "per_class": {"1": 1.0}, "confusions": [("7", "1", 1)]},
        {"accuracy": 0.5, "f1": 0.5, "documents": 2, "rows": [("nit", 0.5, 1, 0.5, 0.6, 0.9)], "errors": []},
        {"documents": 2, "mean": 100.0, "p95": 120.0, "p99": 120.0, "throughput": 10.0, "bottleneck": "recognition", "stages": {"recognition": 90.0}},
        {"same_text": True, "same_fields": True, "score": 1.0, "confidence_variance": 0.0, "value_variance": 0.0},
    )
    assert "| character accuracy | 0.9 | >= 0.85 | yes |" in text and "| field accuracy | 0.5 | >= 0.8 | no |" in text and "| 7 | 1 | 1 |" in text


def test_images(spark, tmp_path):
    data = tables.png(bytes(range(6)), 3, 2)
    (tmp_path / "a.png").write_bytes(data)
    (tmp_path / "b.png").write_bytes(b"no")
    rows = {r.path[-5:]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert bytes(rows["a.png"].gray) == bytes(range(6)) and (rows["a.png"].width, rows["a.png"].height) == (3, 2)
    assert rows["b.png"].error and rows["b.png"].gray is None
    df = spark.createDataFrame([(2, 2, b"1234"), (2, 2, b"123")], "w int, h int, g binary")
    with pytest.raises(Exception, match="fit"):
        df.select(images.from_pixels(F.col("w"), F.col("h"), F.col("g"))).collect()


def test_streams_equal_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    q = ingest.stream_uploads(spark, str(tmp_path / "in")).select("length").writeStream.format("memory").queryName("up").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.length for r in spark.table("up").collect()] == [3]
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "x"), ("2024-01-01 11:00:00", "x"), ("2024-01-04 00:00:00", "y")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "ev"))
    stream = ingest.daily_actions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev")))
    q = stream.writeStream.format("memory").outputMode("complete").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(str(r.day), r.event_type, r.n) for r in spark.table("days").collect()} == {("2024-01-01", "x", 2), ("2024-01-04", "y", 1)}


def test_profiles_from_a_stream_survive_replays(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, datetime.datetime(2024, 1, 1 + rng.randrange(20), rng.randrange(24)), rng.choice([None, *range(12)]), rng.choice("abc")) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    want = {tuple(r) for r in profiles.profiles(profiles.fold(events)).collect()}
    first = {}
    for i, at, user, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        if user is not None:
            first.setdefault(user, (at, kind))
    assert {(r[0], r[2], r[3]) for r in want} == {(u, *v) for u, v in first.items()}
    for k in range(3):  # the third file repeats the first
        events.where(f"event_id % 2 = {k % 2}").coalesce(1).write.parquet(str(tmp_path / f"{k}"))
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "[0-9]"))
        profiles.start(source, str(tmp_path / "out"), availableNow=True).awaitTermination()
    assert {tuple(r) for r in profiles.stored(spark, str(tmp_path / "out")).collect()} == want
    written = spark.read.parquet(str(tmp_path / "out" / "folds"))
    written.write.mode("append").parquet(str(tmp_path / "again"))
    written.write.mode("append").parquet(str(tmp_path / "again"))
    assert {tuple(r) for r in profiles.profiles(spark.read.parquet(str(tmp_path / "again"))).collect()} == want
