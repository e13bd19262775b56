import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(lower)


def brute(text, items):
    """n_words, hit word numbers and matching ids, by comparing every window with every place."""
    words, hit, ids = words_of(text), set(), set()
    for item, own in items:
        own = words_of(own)
        m = min(len(own), dc.WINDOW)
        for k in range(len(own) - m + 1) if m else []:
            for p in range(len(words) - m + 1):
                if words[p : p + m] == own[k : k + m]:
                    hit |= set(range(p, p + m))
                    ids.add(item)
    return len(words), hit, sorted(str(i) for i in ids if i is not None)


def random_case(seed):
    rng = random.Random(seed)
    alphabet = rng.choice([["a", "bb"], ["x", "yé", "z9", "ß"], [f"w{i}" for i in range(30)]])
    make = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(alphabet) for _ in range(n))
    items = [(i % 7 if i else None, make(rng.choice([0, 1, 3, 9, 10, 11, 25, 60]))) for i in range(9)]
    texts = [make(rng.choice([0, 1, 5, 12, 80])).replace("a", rng.choice("aA")) for _ in range(12)] + ["", "Ünïcode only", None]
    for k in range(4):  # passages of items, in other clothes
        texts[k] = f"{make(7)} qq {items[k + 4][1].upper() if k % 2 == 0 else items[k + 4][1]}. qq {make(3)}"
    return items, texts


def table(items):
    pieces = [(None if i is None else str(i), words_of(t)) for i, t in items if words_of(t)]
    return pa.table({"item_id": pa.array([p[0] for p in pieces], pa.string()), "words": pa.array([p[1] for p in pieces], pa.list_(pa.string()))})


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("sizes", [(4 << 20, 1 << 20), (16, 7)])
def test_search_equals_brute_force_whatever_the_sizes(monkeypatch, seed, sizes):
    monkeypatch.setattr(dc, "CHUNK_BYTES", sizes[0])
    monkeypatch.setattr(dc, "SHARD_WORDS", sizes[1])
    items, texts = random_case(seed)
    data = [(t or "").encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    found = dc._find(np.frombuffer(b"".join(data), np.uint8), offsets, dc.make_block(table(items)))
    n_words, spans, ids = (a.to_pylist() for a in found)
    for k, text in enumerate(texts):
        want = brute(text, items)
        covered = {p for s in spans[k] for p in range(s["start"], s["end"])}
        assert (n_words[k], covered, sorted(ids[k])) == want
        assert all(a["end"] < b["start"] for a, b in zip(spans[k], spans[k][1:], strict=False))


@pytest.mark.parametrize("block_words", [1 << 21, 40])
def test_report_and_removal(spark, block_words):
    items, texts = random_case(3)
    texts += [texts[1], " ".join(texts[0] or "" for _ in range(3))]
    rows = [(k % 9 if k else None, t, "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.report(docs, bench, block_words=block_words)
    want = []
    for key, text, *_ in rows:
        n, hit, ids = brute(text, items)
        want.append((key, n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    assert sorted(map(str, got.drop("spans").collect())) == sorted(str(r) for r in spark.createDataFrame(want, got.drop("spans").schema).collect())
    clean = dc.decontaminate(docs, bench, block_words=block_words)
    assert clean.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in clean.collect()))) == sorted(str(r) for r, w in zip(rows, want, strict=True) if not w[-1])


def test_pieces_of_a_long_item_have_all_windows(spark, monkeypatch):
    monkeypatch.setattr(dc, "PIECE_WORDS", 8)
    words = [f"w{i}" for i in range(50)]
    pieces = dc._pieces(spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"), "item_id", "text").collect()
    windows = [tuple(p.words[k : k + 10]) for p in pieces for k in range(len(p.words) - 9)]
    assert sorted(windows) == sorted(tuple(words[k : k + 10]) for k in range(41))


def test_odd_documents_and_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and"), (2, None), (None, "12 mail3")], "item_id long, text string")
    rows = dc.report(odd, bench).collect()
    assert len(rows) == odd.count()
    assert sorted((r.n_hit, r.n_items) for r in rows if r.contaminated) == [(2, 0), (10, 1), (10, 1)]
    assert dc.report(none, bench).count() == 0
    assert not any(r.contaminated for r in dc.report(odd, bench.where("false")).collect())
    assert dc.decontaminate(odd, bench).count() == odd.count() - 3
    assert dc.decontaminate(odd.withColumn("_digest", F.lit(1)), bench).count() == odd.count() - 3
