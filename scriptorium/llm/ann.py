"""Near duplicates among embeddings by hierarchical navigable small-world graphs.

1. Equal vectors of a label are one class; a class is indexed once and weighs as many vectors.
2. The classes of a label are dealt out to shards of about SHARD by hash, and each shard gets a
   graph: layers of geometrically fewer nodes, each node linked to near and diverse neighbours.
   Graphs are built once and written.
3. The classes of every shard query the graph of their own shard and those of the later shards of
   their label, a pair of shards in a task.  A query whose beam is full of matches is repeated with
   a wider beam; in each task an audit compares probes at the threshold's distance and a sample of
   queries with brute force, and the beam of all is widened until the audit passes or holds the
   whole shard.
4. Matches are verified by cosine in double precision.  A task returns the number of vectors
   that each class links with and a spanning forest of the links, never the links themselves, and
   lists no more matches at once than those of BLOCK vectors;
   the forests are united into components.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and those
with a null label, link with nothing; vectors of different lengths never link; equal vectors
(and repeated rows) link with one another; null ids name no component unless all are null; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import owned, written
from .graph import components, named_by_component

THRESHOLD = 0.98
#: Classes of a shard; links of a node (twice as many in the lowest layer); beams; audited queries.
SHARD, LINKS, BUILD_BEAM, BEAM, AUDIT, RECALL = 4_000, 12, 48, 24, 48, 0.99
BATCH, ABREAST, EXPAND = 256, 512, 4
#: Vectors of which the matches are listed, and pairs that are verified, at a time.
BLOCK, VERIFY = 64, 65_536
#: Single precision finds candidates down to this much below the threshold.
SLACK = 1e-4


def _beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best nodes of each query, and their similarities, by beam search from `start`; -1 fills up."""
    b, n = len(queries), len(x)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    seen[rows, start] = True
    ids = np.full((b, size), n)
    ids[:, : start.shape[1]] = start[:, :size]
    padded = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    sims = np.einsum("bd,bkd->bk", queries, padded[ids])
    sims[ids == n] = -2
    done, at_once = ids == n, min(size, max(EXPAND, size // 8))
    while True:
        rank = np.where(done, -3, sims)
        top = np.argpartition(-rank, at_once - 1, axis=1)[:, :at_once]
        go = ~np.take_along_axis(done, top, 1)
        if not go.any():
            break
        np.put_along_axis(done, top, True, 1)
        near = np.where(go, np.take_along_axis(ids, top, 1), n)
        near = np.concatenate([links, np.full((1, links.shape[1]), n)])[near].reshape(b, -1)
        near = np.where(seen[rows, near], n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        width = int((near < n).sum(1).max(initial=0))
        if not width:
            continue
        near.sort(axis=1)
        near = near[:, :width]
        seen[rows, near] = True
        found = np.einsum("bd,bkd->bk", queries, padded[near])
        found[near == n] = -2
        ids, sims, done = np.hstack([ids, near]), np.hstack([sims, found]), np.hstack([done, near == n])
        if ids.shape[1] > size:
            keep = np.argpartition(-sims, size - 1, axis=1)[:, :size]
            ids, sims, done = (np.take_along_axis(v, keep, 1) for v in (ids, sims, done))
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(sims > -2, ids, -1), sims


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 fills up) at most `most`: those that are nearer to
    the node than to those chosen before, then the best of the rest."""
    g = x[ids]
    g = np.matmul(g, g.transpose(0, 2, 1))
    keep = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        near = (keep[:, :k] & (g[:, k, :k] > sims[:, k, None])).any(1)
        keep[:, k] = ~near & (ids[:, k] >= 0) & (keep.sum(1) < most)
    rank = np.where(ids < 0, 2, np.where(keep, 0, 1))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


class Graph:
    """Layers from the lowest up; `links` has as many columns as a node may have neighbours, n fills up."""

    def __init__(self, x: np.ndarray, seed: np.ndarray):
        """`x`: unit vectors; `seed`: a hash of each, which gives its level and order."""
        n = len(x)
        unit = (seed.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        level = np.minimum((-np.log(np.maximum(unit, 1e-12)) / np.log(LINKS)).astype(int), 8)
        level[np.argmax(level)] += 1
        self.order = np.lexsort((seed, -level))
        self.x = x[self.order]
        level = level[self.order]
        self.sizes = [int((level >= k).sum()) for k in range(level.max() + 1)] if n else []
        self.links: list[np.ndarray] = [None] * len(self.sizes)
        for k in range(len(self.sizes) - 1, -1, -1):
            self.links[k] = self._layer(k)

    def _start(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """Entry nodes of `layer` for each query, from the layers above."""
        start = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.sizes) - 1, layer, -1):
            ids, _ = _beam(self.x[: self.sizes[k]], self.links[k], queries, start, EXPAND)
            start = np.where(ids < 0, ids[:, :1], ids)
        return start

    def _layer(self, k: int) -> np.ndarray:
        n, most = self.sizes[k], LINKS * (2 if k == 0 else 1)
        links = np.full((n, most), -1, np.int64)
        at = 0
        while at < n:
            to = min(n, max(at + BATCH, 64) if at else max(self.sizes[k + 1] if k + 1 < len(self.sizes) else 0, min(64, n)))
            new = self.x[at:to]
            own = new @ new.T
            np.fill_diagonal(own, -2)
            ids = np.where(own > -2, np.arange(at, to)[None, :], -1)
            sims = own
            if at:
                safe = np.where(links[:at] < 0, at, links[:at])
                old, near = _beam(self.x[:at], safe, new, self._start(new, k), BUILD_BEAM)
                ids, sims = np.hstack([ids, old]), np.hstack([sims, near])
            best = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            ids = np.where(sims > -2, ids, -1)
            links[at:to] = _diverse(self.x, ids, sims, most)
            self._back(links, at, to, most)
            at = to
        return np.where(links < 0, n, links)

    def _back(self, links: np.ndarray, at: int, to: int, most: int) -> None:
        """Links from the new nodes' neighbours back to them; full lists keep a diverse choice."""
        source = np.repeat(np.arange(at, to), most)
        target = links[at:to].ravel()
        source, target = source[target >= 0], target[target >= 0]
        sims = np.einsum("ij,ij->i", self.x[source], self.x[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        nodes, first = np.unique(target, return_index=True)
        rank = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        few = rank < BUILD_BEAM
        fresh = np.full((len(nodes), min(BUILD_BEAM, int(rank.max(initial=0)) + 1)), -1)
        fresh[np.searchsorted(nodes, target[few]), rank[few]] = source[few]
        for a in range(0, len(nodes), BATCH):
            part = nodes[a : a + BATCH]
            ids = np.hstack([links[part], fresh[a : a + BATCH]])
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("bd,bkd->bk", self.x[part], self.x[ids])
            sims[ids < 0] = -2
            best = np.argsort(-sims, axis=1, kind="stable")[:, : most + BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            links[part] = _diverse(self.x, ids, sims, most)

    def search(self, queries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (as in the given order of vectors) and similarities of each query, best first.

        A beam that is to hold most of the shard is a scan of it.
        """
        if 2 * size >= len(self.x):
            sims = queries @ self.x.T
            best = np.argsort(-sims, axis=1, kind="stable")
            return self.order[best], np.take_along_axis(sims, best, 1)
        ids, sims = _beam(self.x, self.links[0], queries, self._start(queries, 0), min(size, len(self.x)))
        return np.where(ids < 0, -1, self.order[ids]), sims

    def within(self, queries: np.ndarray, least: float, size: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) whose similarity is at least `least`."""
        none = np.zeros(0, np.int64)
        left, right = zip((none, none), *self.blocks(queries, least, size), strict=True)
        return np.concatenate(left), np.concatenate(right)

    def blocks(self, queries: np.ndarray, least: float, size: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of `within`, those of a few queries at a time; beams full of matches are widened."""
        todo = np.arange(len(queries))
        while len(todo):
            again = []
            step = max(1, ABREAST * BEAM // size)
            for a in range(0, len(todo), step):
                part = todo[a : a + step]
                ids, sims = self.search(queries[part], size)
                full = (sims[:, -1] >= least) & (2 * size < len(self.x))
                hit = (sims >= least) & (ids >= 0) & ~full[:, None]
                row, col = np.nonzero(hit)
                yield part[row], ids[row, col]
                again.append(part[full])
            todo, size = np.concatenate(again), min(4 * size, len(self.x))


def audited(graph: Graph, x: np.ndarray, queries: np.ndarray, least: float, same: bool = False) -> tuple[int, float]:
    """The least beam that passes the audit, and the recall that the audit measured with it.

    Audited are probes, which lie as far from vectors of the shard as a link just allows, and
    queries; their links are found by an exact scan.  If `same`, queries are the shard itself and
    a vector's own hit does not count.
    """
    at = np.unique(np.linspace(0, len(x) - 1, min(AUDIT, len(x))).astype(int))
    own = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
    away = np.random.default_rng(len(x)).normal(size=(len(at), x.shape[1]))
    away -= (away * x[at]).sum(1, keepdims=True) * x[at]
    near = least + 0.05 * (1 - least)
    probes = near * x[at] + np.sqrt(1 - near * near) * away / np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-9)
    sample = np.vstack([probes.astype(np.float32), queries[own]])
    true = sample @ x.T >= least
    if same:
        true[len(at) + np.arange(len(own)), own] = False
    size = BEAM
    while True:
        q, hit = graph.within(sample, least, size)
        recall = float(true[q, hit].sum() / max(1, true.sum()))
        if recall >= RECALL or not true.any() or 2 * size >= len(x):
            return size, recall if true.any() else 1.0
        size *= 2


def scanned(x: np.ndarray, queries: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (query, node) whose similarity is at least `least`, those of some queries at a time."""
    for at in range(0, len(queries), BATCH):
        q, node = np.nonzero(queries[at : at + BATCH] @ x.T >= least)
        yield q + at, node


def matches(graph: Graph, x: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs found with the least beam that passes the audit."""
    return graph.within(queries, least, audited(graph, x, queries, least)[0])


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node of the component of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


LINKS_OUT = "kind long, s int, shards int, a long, b long, links long, recall double, vectors binary, graph binary"


class Shard:
    """Classes of a shard: names, numbers of vectors, unit vectors, and the graph once it is built."""

    def __init__(self, node: np.ndarray, many: np.ndarray, v: np.ndarray):
        self.node, self.many, self.v, self.single = node, many, v, v.astype(np.float32)
        self.graph: Graph | None = None

    def build(self) -> Shard:
        self.graph = Graph(self.single, self.node.view(np.uint64))
        return self

    def dump(self) -> tuple[bytes, bytes]:
        """The vectors and the graph, apart, since those that only query need no graph."""
        vectors, graph = BytesIO(), BytesIO()
        np.savez(vectors, node=self.node, many=self.many, v=self.v)
        np.savez(graph, order=self.graph.order, sizes=self.graph.sizes, **{f"links{k}": x.astype(np.int32) for k, x in enumerate(self.graph.links)})
        return vectors.getvalue(), graph.getvalue()

    @classmethod
    def load(cls, vectors: bytes, graph: bytes | None = None) -> Shard:
        with np.load(BytesIO(vectors)) as x:
            shard = cls(x["node"], x["many"], x["v"])
        if graph is not None:
            with np.load(BytesIO(graph)) as x:
                shard.graph = Graph.__new__(Graph)
                shard.graph.order, shard.graph.sizes = x["order"], x["sizes"].tolist()
                shard.graph.x = shard.single[shard.graph.order]
                shard.graph.links = [x[f"links{k}"].astype(np.int64) for k in range(len(shard.graph.sizes))]
        return shard


def _linked(left: Shard, right: Shard, threshold: float) -> dict[str, pa.Array]:
    """Links of the classes of `left` with those of `right` (a shard with a graph, or `left` itself),
    a spanning forest of them, and the recall that the audit measured; where it is under RECALL, all
    pairs are compared instead.

    Matches are marked in a matrix of one byte for each pair, so that a pair found from both ends
    counts once; they are listed, verified and united for BLOCK of its rows at a time.
    """
    same, least = left is right, threshold - SLACK
    half = len(left.node)
    size, recall = audited(right.graph, right.single, left.single, least, same)
    found = np.zeros((half, len(right.node)), bool)
    searched = right.graph.blocks(left.single, least, size)
    if recall < RECALL:  # no beam passed the audit: every pair is compared
        searched, recall = scanned(right.single, left.single, least), 1.0
    for q, hit in searched:
        found[(np.minimum(q, hit), np.maximum(q, hit)) if same else (q, hit)] = True
    if same:
        np.fill_diagonal(found, False)
    node, many, v = (x if same else np.concatenate([x, y]) for x, y in ((left.node, right.node), (left.many, right.many), (left.v, right.v)))
    links, root = np.zeros(len(node)), np.arange(len(node))
    for at in range(0, half, BLOCK):
        x, y = np.nonzero(found[at : at + BLOCK])
        x, y = x + at, y + (0 if same else half)
        good = np.concatenate([np.zeros(0, bool), *[np.einsum("ij,ij->i", v[x[k : k + VERIFY]], v[y[k : k + VERIFY]]) >= threshold for k in range(0, len(x), VERIFY)]])
        x, y = x[good], y[good]
        if not len(x):
            continue
        links += np.bincount(x, many[y], len(node)) + np.bincount(y, many[x], len(node))
        new = root[x] != root[y]
        if new.any():
            root = _forest(np.concatenate([x[new], np.arange(len(node))]), np.concatenate([y[new], root]), len(node))
    linked, child = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(node)))
    first = np.arange(len(linked) + len(child)) < len(linked)
    return {
        "a": pa.array(np.append(np.concatenate([node[linked], node[child]]), 0), mask=np.append(np.zeros(len(first), bool), True)),
        "b": pa.array(np.concatenate([np.zeros(len(linked), np.int64), node[root[child]], np.zeros(1, np.int64)]), mask=np.append(first, True)),
        "links": pa.array(np.concatenate([links[linked].astype(np.int64), np.zeros(len(child) + 1, np.int64)])),
        "recall": pa.array(np.append(np.zeros(len(first)), recall), mask=np.append(np.ones(len(first), bool), False)),
    }


def _within_shard(threshold: float):
    """Builds the graph of a shard, searches it by its own classes, and passes it on if the label has other shards."""

    def run(table: pa.Table) -> pa.Table:
        v = table["embedding"].combine_chunks()
        shard = Shard(table["node"].to_numpy(), table["many"].to_numpy(), _unit(v.flatten().to_numpy().reshape(table.num_rows, -1))).build()
        out = _linked(shard, shard, threshold)
        kind, s, shards = (table[c][0].as_py() for c in ("kind", "s", "shards"))
        n, blobs = len(out["a"]), shard.dump() if shards > 1 else (None, None)
        return pa.table(
            {"kind": pa.array([kind] * n, pa.int64()), "s": pa.array([s] * n, pa.int32()), "shards": pa.array([shards] * n, pa.int32())}
            | out
            | {c: pa.array([None] * (n - 1) + [x], pa.binary()) for c, x in zip(("vectors", "graph"), blobs, strict=True)}
        )

    return run


def _across(threshold: float):
    """Queries the graph of one shard by the classes of another; a row is a pair of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                queries, vectors, graph = (batch.column(c)[k].as_py() for c in ("queries", "vectors", "graph"))
                yield pa.RecordBatch.from_pydict(_linked(Shard.load(queries), Shard.load(vectors, graph), threshold))

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall: one row per vector.

    `audited_recall` is the least recall that any audit measured, the same in all rows.
    """
    v = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col("label").isNotNull() & F.coalesce(~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    rows = rows.withColumn("fine", fine)
    rows = rows.withColumn("node", F.when(F.col("fine"), F.xxhash64("label", F.transform("embedding", lambda x: x + 0.0))))
    classes = (
        rows.where("fine")
        .groupBy("node")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    )
    with owned() as work:
        classes = written(classes.withColumn("kind", F.xxhash64("label", F.size("embedding"))), "vector-classes")
        shards = written(classes.groupBy("kind").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards")), "shards")
        dealt = classes.join(shards, "kind").withColumn("s", F.pmod(F.xxhash64("node", F.lit("shard")), F.col("shards")).cast("int"))
        within = written(dealt.groupBy("kind", "s").applyInArrow(_within_shard(threshold), LINKS_OUT), "links-within")
        # Each pair of shards of a label: the first queries the graph of the second.
        built = within.where("vectors is not null")
        queries = built.where("s < shards - 1").select("kind", "s", F.explode(F.sequence(F.col("s") + 1, F.col("shards") - 1)).alias("t"), F.col("vectors").alias("queries"))
        graphs = built.where("s > 0").select("kind", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("s"), F.col("s").alias("t"), "vectors", "graph")
        pairs = queries.join(graphs, ["kind", "s", "t"]).select("queries", "vectors", "graph")
        across = written(pairs.mapInArrow(_across(threshold), "a long, b long, links long, recall double"), "links-across", 1)
        found = within.select("a", "b", "links", "recall").unionByName(across)
        links = found.where("a is not null and b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        roots = written(components(found.where("b is not null").select("a", "b")), "roots")
        known = classes.select("node", "least", "many").join(links, "node", "left").join(roots, "node", "left")
        known = known.select("node", "least", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c"))
        known = named_by_component(written(known, "known")).select("node", "n_links", "component_id")
        recall = found.agg(F.min("recall")).first()[0]
    known = written(known, "named-vectors")
    work.drop(vectors.sparkSession)
    out = rows.select("vec_id", "node").join(known, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"))
    return out.withColumns({"kept": F.col("vec_id").eqNullSafe(F.col("component_id")), "audited_recall": F.lit(recall).cast("double")})
