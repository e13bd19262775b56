import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.llm import ann, ngram_join, sharding
from scriptorium.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = list(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {d: len(s) for d, s in sets.items()}, roots(ids, links)


def check_join(spark, rows):
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes, names = brute(rows)
    assert {r.doc_id: r.n_shingles for r in out} == sizes
    assert {r.doc_id: r.component_id for r in out} == names
    return names


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)]
    edges = [e for e in edges if e[0] != e[1]]
    nodes = {n for e in edges for n in e}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == roots(nodes, edges)


def test_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [f"shared{i}" for i in range(60)]
    rows, k = [], 0
    for size in (1, 1, 2, 3, 5, 40):  # groups of near copies, one of many
        for _ in range(6 if size < 40 else 2):
            base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 8, 40, 90)))]
            for _ in range(size):
                words = list(base)
                for _ in range(rng.randrange(0, 4)):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
                if rng.random() < 0.3:
                    words[:0] = passage
                text = " ".join(w.upper() if rng.random() < 0.1 else w for w in words)
                rows.append((k, text))
                k += 1
    for n in range(30):  # short documents that consist mostly of a passage
        rows.append((k + n, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))])))
    monkeypatch.setattr(ngram_join, "LEAST", 4)
    names = check_join(spark, rows)
    assert len(set(names.values())) < len(rows)


def test_join_of_odd_rows(spark, odd, none):
    rows = [(1, "a b c d e f g h"), (2, "A B c d e f g h"), (3, "a b c"), (4, "A  b\tc"), (5, None), (6, ""), (7, " \n "), (8, "a b c"), (9, "x " * 5000), (10, "y " * 3)]
    check_join(spark, rows)
    out = ngram_join.join(odd).collect()
    assert len(out) == odd.count()
    assert {r.component_id for r in out if r.doc_id in (5, 6)} == {5}
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in out if r.doc_id in (2, 3, 4))
    assert ngram_join.join(none).count() == 0
    kept = [r.doc_id for r in ngram_join.keep_one(odd).collect()]
    assert kept.count(1) == 1 and kept.count(5) == 1 and 6 not in kept and {2, 3, 4} <= set(kept) and None in kept


def test_open_lists_keep_pairs_of_all_sizes(spark):
    """The bound of open lists holds for each size of partner, by brute force."""
    need = lambda n, m, t: -(-t * (n + m) // (100 + t))
    rest = lambda n, t: -(-t * n // 100) - 1
    for t in (75, 50, 90):
        cases = [(n, low, high) for n in [*range(1, 60), 399, 980] for low in range(-(-t * n // 100), 100 * n // t + 1, 1 + n // 12) for high in range(low, 100 * n // t + 1, 1 + n // 24)]
        rows = spark.createDataFrame(cases, "n long, low long, high long").select("*", ngram_join._least_missing(F.col("n"), F.col("low"), F.col("high"), t).alias("k")).collect()
        for r in rows:
            assert r.k <= min(need(r.n, m, t) - max(rest(r.n, t), rest(m, t)) for m in range(r.low, r.high + 1)), (t, r)


def test_open_lists_of_a_pair_whose_shared_lists_are_longest(spark):
    a, b = 1, 2  # of 21 and 23 n-grams, 19 shared: two of them in the prefixes of six, in the longest lists
    postings = [(g, a) for g in (10, 11, 12, 13)] + [(g, b) for g in (20, 21, 22, 23)] + [(g, x) for g in (90, 91) for x in (a, b)]
    postings += [(g, 100 + 10 * g + i) for g in (10, 11, 12, 13, 20, 21, 22, 23) for i in range(6)] + [(g, 100 + 10 * g + i) for g in (90, 91) for i in range(9)]
    sizes = {a: 21, b: 23} | {x: 19 + i % 6 for i, x in enumerate(sorted({x for _, x in postings} - {a, b}))}
    nodes = spark.createDataFrame([(x, n, 1 << 62, 6 if x in (a, b) else 1, [0] * 16) for x, n in sizes.items()], "node long, n long, last long, u long, bits array<long>")
    roots = spark.createDataFrame([], "node long, component long")
    kept = ngram_join._listed(spark.createDataFrame(postings, "gram long, node long"), nodes, roots, 75).collect()
    lists = {x: {r.gram for r in kept if r.node == x} for x in (a, b)}
    assert lists[a] & lists[b]


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 32)).astype(np.float32)
    x[100:400] = x[100] + rng.normal(scale=0.08, size=(300, 32))  # many near copies
    x[400:430] = x[5]  # copies
    labels = rng.integers(0, 2, 900)
    labels[100:430] = 1
    rows = [(int(i), [float(v) for v in x[i]], int(labels[i])) for i in range(900)]
    odd = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, rows[3][1], None), (904, [], 0), (905, [None, *rows[1][1][1:]], 0), (906, [1.0, 2.0], 0)]
    monkeypatch.setattr(ann, "SHARD", 250)
    out = ann.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).toPandas().set_index("vec_id")
    v = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (v @ v.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    assert out.n_links[:900].sum() >= 0.97 * link.sum() and (out.n_links.reindex(range(900)).to_numpy() <= link.sum(1)).all()
    names = roots(range(900), list(zip(*np.nonzero(link))))
    got = out.component_id.reindex(range(900)).to_numpy()
    assert (got == np.array([names[i] for i in range(900)])).mean() > 0.98
    assert (out.kept == (out.index == out.component_id)).all()
    for k in range(900, 907):
        assert out.n_links[k] == 0 and out.component_id[k] == k


def test_no_vectors(spark):
    assert ann.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_audited_search_finds_wide_groups():
    rng = np.random.default_rng(4)
    x = ann._unit(np.vstack([rng.normal(size=(600, 16)), 1 + rng.normal(scale=0.05, size=(300, 16))])).astype(np.float32)
    graph = ann.Graph(x, rng.integers(0, 1 << 62, 900).astype(np.uint64))
    q, hit = ann.matches(graph, x, x, 0.98)
    true = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.98))}
    found = set(zip(q.tolist(), hit.tolist()))
    assert found <= true and len(found) >= 0.97 * len(true)


def test_large_group_of_near_copies_is_not_listed_whole():
    """Counts and components by brute force, of one shard and of two, within memory that the list of pairs exceeds."""
    rng = np.random.default_rng(6)
    v = np.vstack([1 + rng.normal(scale=0.05, size=(1500, 16)), rng.normal(size=(100, 16))])
    node, many = rng.integers(-1 << 63, (1 << 63) - 1, 1600), rng.integers(1, 4, 1600)
    unit = ann._unit(v)
    true = unit @ unit.T >= 0.98
    np.fill_diagonal(true, False)
    for side in (np.zeros(1600, int), rng.integers(0, 2, 1600)):
        link = true if not side.any() else true & (side[:, None] != side[None, :])
        left, right = (ann.Shard(node[side == k], many[side == k], unit[side == k]) for k in (0, side.max()))
        right = left.build() if not side.any() else ann.Shard.load(*right.build().dump())
        tracemalloc.start()
        out = pa.table(ann._linked(left, right, 0.98)).to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
        assert out[-1]["recall"] >= ann.RECALL and [r["recall"] for r in out[:-1]] == [None] * (len(out) - 1)
        out = out[:-1]
        tracemalloc.stop()
        got = {r["a"]: r["links"] for r in out if r["b"] is None}
        whole = dict(zip(node.tolist(), (link @ many).tolist()))
        assert all(got.get(n, 0) <= c for n, c in whole.items()) and sum(got.values()) >= 0.99 * sum(whole.values())
        edges = [(r["a"], r["b"]) for r in out if r["b"] is not None]
        names, wanted = roots(node.tolist(), edges), roots(node.tolist(), [(int(node[i]), int(node[j])) for i, j in zip(*np.nonzero(link))])
        assert sum(names[n] == wanted[n] for n in wanted) >= 0.99 * len(wanted)
        assert peak < 45e6, peak


def test_a_failed_audit_falls_back_to_a_scan(monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 16))
    v = np.concatenate([v, v[:90] + rng.normal(size=(90, 16)) * 0.01])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    shard = ann.Shard(np.arange(390), np.ones(390, np.int64), v).build()
    want = (v @ v.T >= 0.98).sum() - 390
    assert want >= 180
    monkeypatch.setattr(ann.Graph, "blocks", lambda *a, **k: iter([]))
    monkeypatch.setattr(ann, "audited", lambda *a, **k: (ann.BEAM, 0.5))
    out = ann._linked(shard, shard, 0.98)
    assert sum(x for x in out["links"].to_pylist()) == want
    assert [x for x in out["recall"].to_pylist() if x is not None] == [1.0]


def test_columns_of_other_names_do_not_clash(spark, odd):
    """Extra columns named like those of the plans change nothing."""
    names = ("node", "h", "n", "gram", "c", "component_id", "n_shingles", "least", "many", "f", "links", "s", "kind", "shard", "slot", "r")
    docs = odd.withColumns({c: F.lit("x") for c in names})
    key = lambda df: sorted(map(str, df.collect()))
    assert key(ngram_join.join(docs)) == key(ngram_join.join(odd))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and key(kept.select("doc_id", "text")) == key(ngram_join.keep_one(odd).select("doc_id", "text"))
    assert key(sharding.shard(docs)) == key(sharding.shard(odd))
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, None, 1), (None, [1.0, 0.0], 1), (5, [1.0, 0.0], None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert key(ann.near_duplicates(vectors.withColumns({c: F.lit("x") for c in names}))) == key(ann.near_duplicates(vectors))
