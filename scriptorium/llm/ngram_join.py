"""Similarity join of documents by Jaccard of word n-grams, with vertical partitioning.

1. Each text becomes a set of 64-bit hashes of its word 5-grams.  Equal sets are one node, named
   by a 64-bit hash of the set, so copies are never compared with one another.
2. The global n-gram order puts rare n-grams first: those that no task saw twice, by hash, then
   the frequent ones by count.  Two sets that reach the threshold share an n-gram among the
   first n - ceil(threshold * n) + 1 of each (its prefix).
3. The order is cut into fragments.  Each fragment finds the pairs that share its prefix
   n-grams and counts their partial overlaps there; the counts are summed per pair.  An n-gram
   that many nodes share (a hot passage, a large group of near copies) emits no pairs: its
   nodes are compared with one leader each, and later only with nodes of other components.
4. Candidates are verified on whole sets, again fragment by fragment: partial overlaps of all
   n-grams are counted separately and summed per pair.

Every pair that could link is verified unless its nodes are already in one component, so the
components are exact.  Edge cases: fewer than five words are one n-gram; null texts and texts
without words have an empty set and are linked with nothing; repeated rows and copies share a
component; rows with a null id belong to their component, which is named by its least id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import owned, read_slices, text_bytes, written
from .graph import components, named_by_component

WORDS, THRESHOLD = 5, 75
#: N-grams after which a task counts what it has seen twice; bound on the frequent n-grams that
#: get a place of their own in the order; least count of such.
BLOCK, FREQUENT, LEAST = 1_000_000, 1_000_000, 16
#: Prefix n-grams of a fragment, about, and least number of fragments.
PER_FRAGMENT, FRAGMENTS = 1_000_000, 64
#: An n-gram shared by more nodes than this emits no pairs in its fragment.
FEW = 8
#: Fragments in which pairs are verified.
SEGMENTS = 8
#: Bits of the sketch that bounds the overlap of two sets, and to how many it is folded in open lists.
PARITY, FOLDED = 1_024, 256
#: Rows (of some 200 bytes) up to which a counted table is broadcast, and ids (of 8) likewise; larger ones are shuffled.
SMALL, SMALL_IDS = 1 << 17, 1 << 20
#: Rows of an Arrow batch and bytes of text hashed at a time; they bound a task's memory.
ROWS, SLICE = 1_024, 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_STEP = _RNG.integers(0, 1 << 64, WORDS + 1, np.uint64) | np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, ASCII letters lower-cased, and the offsets of the texts."""
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    begin = ~space
    begin[1:] &= space[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begin[edge] |= ~space[edge]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    run = np.diff(np.append(at, len(data)))
    place = np.arange(at[0], len(data)) - np.repeat(at, run)
    powers = np.full(place.max() + 1, _POWER, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    value = _BYTE[_LOWER[data[at[0] :]]] * powers[place]
    value[space[at[0] :]] = 0
    return _mix(np.add.reduceat(value, at - at[0])), np.searchsorted(at, offsets)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    words, offsets = word_hashes(texts)
    n = len(words) - WORDS + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(WORDS):
        if n > 0:
            grams += words[k : k + n] * _STEP[k]
    grams = _mix(grams)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            few = (words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(_mix(few + _STEP[WORDS : WORDS + 1] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(grams: np.ndarray) -> int:
    """Name of a set: a signed 64-bit hash."""
    total = _mix(grams + _STEP[0]).sum(dtype=np.uint64, keepdims=True) + _STEP[1:2] * np.uint64(len(grams))
    return int(_mix(total).view(np.int64)[0])


def parity_bits(grams: np.ndarray) -> np.ndarray:
    """PARITY bits as signed 64-bit words: each says whether an odd number of the set's n-grams fall on it.

    Two sets differ in at least as many n-grams as their bits differ.
    """
    odd = np.bincount((grams & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - (threshold * n + 99) // 100 + 1


class Order:
    """The frequent n-grams, which come last, and their ranks among themselves."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        sort = np.argsort(grams)
        self.grams = grams[sort]
        self.ranks = np.empty(len(grams), np.int64)
        self.ranks[np.lexsort((self.grams, counts[sort]))] = np.arange(len(grams))

    def prefix(self, grams: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """The rare n-grams of a set's prefix, and the ranks of the frequent ones in it."""
        p = prefix_length(len(grams), threshold)
        if not len(self.grams):
            return grams[:p], np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        often = self.grams[at] == grams
        rare = grams[~often]
        if len(rare) >= p:
            return rare[:p], np.zeros(0, np.int64)
        return rare, np.sort(self.ranks[at[often]])[: p - len(rare)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))


def _first_pass(texts: DataFrame) -> DataFrame:
    """Rows of two kinds: (false, doc_id, size of the set, node), and (true, null, count, n-gram)
    for the n-grams that several nodes of one block of a task hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "doc_id", "n", "h"]
        seen: set[int] = set()
        block: list[np.ndarray] = []

        def twice() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(block), return_counts=True)
            grams, counts = grams[counts > 1], counts[counts > 1]
            block.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(grams), bool)), pa.nulls(len(grams), pa.int64()), pa.array(counts.astype(np.int64)), _signed(grams)], names=names
            )

        for ids, part in read_slices(batches, SLICE):
            sets = shingle_sets(part)
            nodes = [node_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), bool)), ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())], names=names
            )
            for node, s in zip(nodes, sets, strict=True):
                if node is not None and node not in seen:
                    seen.add(node)
                    block.append(s)
            if sum(map(len, block)) >= BLOCK:
                yield twice()
        if block:
            yield twice()

    return texts.mapInArrow(run, "gram boolean, doc_id long, n long, h long")


def _order(first: DataFrame) -> Order:
    """Order by the counts of the n-grams seen twice; as many of the most frequent as the bound allows."""
    counts = written(first.where("gram").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST), "frequent")
    level = F.floor(F.log2("n")).cast("int")
    levels, least, total = counts.groupBy(level.alias("level")).agg(F.count("*").alias("many")).orderBy(F.desc("level")).collect(), None, 0
    for x in levels:
        total += x.many
        if total > FREQUENT:
            break
        least = x.level
    if least is None:
        return Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rows = counts.where(level >= least).toArrow()  # at most FREQUENT rows
    return Order(rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy())


def _fragments(texts: DataFrame, order: Order, fragments: int, threshold: int) -> DataFrame:
    """Blobs of prefix n-grams by fragment, compact because they are what is shuffled most.

    Kind 0: rare n-grams as 32-bit numbers within their fragment (a chance match only adds a
    candidate), places in the blob's table of nodes, that table, and the sizes of the sets.
    Kind 1: frequent n-grams, their nodes and sizes.  Kind 2: for each node the place in the order
    of the last n-gram of its prefix, its parity bits, and its size.  Kinds 1 and 2 are dealt out by hash.
    """
    bits = np.uint64(fragments.bit_length() - 1)
    whole, low = np.uint64(64), np.uint64(0xFFFFFFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["f", "kind", "grams", "places", "nodes", "sizes"]
        docs: list[tuple] = []
        seen: set[int] = set()

        def cut(f: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
            sort = np.argsort(f, kind="stable")
            edge = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(np.diff(f[sort])) + 1, np.full(1, len(f))])
            return sort, list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if len(f) else []

        def flush() -> pa.RecordBatch:
            nodes, sizes = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int32)
            rows: list[list] = [[] for _ in names]

            def add(*row):
                for column, v in zip(rows, row, strict=True):
                    column.append(v)

            g = np.concatenate([d[2] for d in docs])
            place = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d[2]) for d in docs])
            f = (g >> (whole - bits)).astype(np.int32)
            sort, parts = cut(f)
            g, place, f = ((g << bits) >> np.uint64(32)).astype(np.uint32)[sort], place[sort], f[sort]
            for x, y in parts:
                used, at = np.unique(place[x:y], return_inverse=True)
                add(int(f[x]), 0, g[x:y].tobytes(), at.astype(np.int32).tobytes(), nodes[used].tobytes(), sizes[used].tobytes())
            last, bits_of = np.array([d[4] for d in docs], np.int64), np.array([d[5] for d in docs])
            rank = np.concatenate([d[3] for d in docs])
            owner = np.repeat(np.arange(len(docs)), [len(d[3]) for d in docs])
            for kind, key, own in ((1, -1 - rank, owner), (2, last, np.arange(len(docs)))):
                f = -1 - (_mix(nodes[own].view(np.uint64) ^ key.view(np.uint64)) % np.uint64(fragments)).astype(np.int32)
                sort, parts = cut(f)
                for x, y in parts:
                    pick = sort[x:y]
                    extra = bits_of[pick].tobytes() if kind == 2 else b""
                    add(int(f[pick[0]]), kind, key[pick].tobytes(), extra, nodes[own[pick]].tobytes(), sizes[own[pick]].tobytes())
            docs.clear()
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)

        for _, part in read_slices(batches, SLICE):
            for s in shingle_sets(part):
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    rare, often = order.prefix(s, threshold)
                    last = (1 << 62) + int(often[-1]) if len(often) else int(rare[-1] >> np.uint64(2))
                    docs.append((node, len(s), rare, often, last, parity_bits(s)))
            if sum(len(d[2]) + len(d[3]) for d in docs) >= BLOCK:
                yield flush()
        if docs:
            yield flush()

    return texts.mapInArrow(run, "f int, kind int, grams binary, places binary, nodes binary, sizes binary")


def _join_fragment(threshold: int):
    """Rows (kind, x, y, c, bits) of a fragment: 0 pairs of nodes with their partial overlap, 1 postings
    (n-gram, node, size) of n-grams that many nodes share, 2 nodes (node, last place, size, bits)."""

    def run(table: pa.Table) -> pa.Table:
        f = int(table["f"][0].as_py())
        if f < 0:
            out: list[list[np.ndarray]] = [[], [], [], []]
            words: list[np.ndarray] = []
            for kind, g, bits, d, n in zip(*(table[c].to_pylist() for c in ("kind", "grams", "places", "nodes", "sizes")), strict=True):
                g, d, n = np.frombuffer(g, np.int64), np.frombuffer(d, np.int64), np.frombuffer(n, np.int32).astype(np.int64)
                x, y = (g, d) if kind == 1 else (d, g)
                for column, v in zip(out, (np.full(len(g), kind, np.int32), x, y, n), strict=True):
                    column.append(v)
                words.append(np.frombuffer(bits, np.int64) if kind == 2 else np.zeros(0, np.int64))
            kinds = np.concatenate(out[0])
            ends = np.cumsum(np.where(kinds == 2, PARITY // 64, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(words)))
            return pa.table(dict(zip(("kind", "x", "y", "c"), map(np.concatenate, out), strict=True)) | {"bits": lists})
        blobs = [[np.frombuffer(table[c][k].as_py(), t) for c, t in (("grams", np.uint32), ("places", np.int32), ("nodes", np.int64), ("sizes", np.int32))] for k in range(table.num_rows)]
        g = np.concatenate([b[0] for b in blobs])
        d = np.concatenate([b[2][b[1]] for b in blobs])
        n = np.concatenate([b[3][b[1]] for b in blobs])
        sort = np.lexsort((d, g))
        g, d, n = g[sort], d[sort], n[sort]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])  # the same node from several tasks
        g, d, n = g[new], d[new], n[new]
        start = np.flatnonzero(np.concatenate([np.ones(1, bool), g[1:] != g[:-1]]))
        size = np.diff(np.append(start, len(g)))
        many = np.repeat(size, size)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for off in range(1, min(FEW, len(g))):
            i = np.flatnonzero((g[off:] == g[:-off]) & (many[off:] <= FEW))
            a, b = n[i].astype(np.int64), n[i + off].astype(np.int64)
            i = i[100 * np.minimum(a, b) >= threshold * np.maximum(a, b)]
            left.append(d[i])
            right.append(d[i + off])
        x, y = np.concatenate(left), np.concatenate(right)
        sort = np.lexsort((y, x))
        x, y = x[sort], y[sort]
        first = np.flatnonzero(np.concatenate([np.ones(1, bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(x)))
        big = many > FEW
        return pa.table(
            {
                "kind": np.concatenate([np.zeros(len(first), np.int32), np.ones(big.sum(), np.int32)]),
                "x": np.concatenate([x[first], (f << 32) + g[big].astype(np.int64)]),
                "y": np.concatenate([y[first], d[big]]),
                "c": np.concatenate([count, n[big].astype(np.int64)]),
                "bits": pa.nulls(len(first) + int(big.sum()), pa.list_(pa.int64())),
            }
        )

    return run


def _small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """`df` (a written table) marked for broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def _segments(texts: DataFrame, owners: DataFrame) -> DataFrame:
    """(node, f, n, grams) of the texts whose ids are in `owners`: whole sets, cut into SEGMENTS fragments of the order.

    Texts without an id are all taken, since only their text names them.  A node may come several
    times, from such texts or where ids repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, part in read_slices(batches, SLICE):
            out: list[list] = [[], [], [], []]
            for s in shingle_sets(part):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                cut = np.append(np.searchsorted(s, edges), len(s))
                for f in range(SEGMENTS):
                    if cut[f] < cut[f + 1]:
                        for column, v in zip(out, (node, f, len(s), s[cut[f] : cut[f + 1]].view(np.int64)), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))],
                names=["node", "f", "n", "grams"],
            )

    edges = np.array([k << (64 - (SEGMENTS.bit_length() - 1)) for k in range(SEGMENTS)], np.uint64)
    wanted = texts.join(_small(owners, SMALL_IDS), "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))
    return wanted.mapInArrow(run, "node long, f int, n long, grams array<long>")


def _verified(pairs: DataFrame, segments: DataFrame, threshold: int) -> DataFrame:
    """Those pairs (a, b) that reach the threshold: overlaps are counted per fragment and summed.

    A node that comes several times in `segments` gives equal counts, of which the set keeps one.
    """
    right = segments.select(F.col("node").alias("b"), "f", F.col("n").alias("nb"), F.col("grams").alias("gb"))
    left = segments.select(F.col("node").alias("a"), "f", F.col("n").alias("na"), F.col("grams").alias("ga"))
    parts = right.join(_small(pairs), "b").join(left, ["a", "f"])
    parts = parts.select("a", "b", "na", "nb", F.struct("f", F.size(F.array_intersect("ga", "gb")).alias("o")).alias("part"))
    whole = parts.groupBy("a", "b").agg(F.collect_set("part").alias("parts"), F.max("na").alias("na"), F.max("nb").alias("nb"))  # SEGMENTS parts at most
    overlap = F.aggregate("parts", F.lit(0), lambda t, x: t + x["o"])
    return whole.where(100 * overlap >= threshold * (F.col("na") + F.col("nb") - overlap)).select("a", "b")


def _need(na: Column, nb: Column, threshold: int) -> Column:
    """Least overlap of sets of these sizes that reaches the threshold."""
    return F.floor((threshold * (na + nb) + 99 + threshold) / (100 + threshold))


def _rest(n: Column, threshold: int) -> Column:
    """N-grams of a set beyond its prefix."""
    return F.floor((threshold * n + 99) / 100) - 1


def _missing(threshold: int) -> Column:
    """Overlap that the prefixes of a pair (na, lasta), (nb, lastb) must have at least.

    Let a's prefix end no later in the order than b's.  What a's prefix shares with b lies in
    b's prefix too; the rest of a adds at most its own size.
    """
    rest = F.when(F.col("lasta") <= F.col("lastb"), _rest(F.col("na"), threshold)).otherwise(_rest(F.col("nb"), threshold))
    return _need(F.col("na"), F.col("nb"), threshold) - rest


def _least_missing(n: Column, low: Column, high: Column, threshold: int) -> Column:
    """A lower bound of `_missing` of a set of n and any partner of low to high n-grams.

    With the rest of n it grows with the partner.  With the partner's rest it falls by
    threshold^2 / (100 * (100 + threshold)) a size, but both terms are rounded, so a smaller
    partner may need one less; none that is so far below the largest that it falls by 1.
    """
    low, high = F.least(low, n), F.greatest(high, n)
    sizes = [F.greatest(high - k, low) for k in range(-(-100 * (100 + threshold) // threshold**2))]
    return F.least(_need(n, low, threshold) - _rest(n, threshold), *[_need(n, m, threshold) - _rest(m, threshold) for m in sizes])


def _alike(threshold: int) -> Column:
    return 100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")


def _can_reach(x: str, threshold: int) -> Column:
    """Whether the parity bits (x + "a", x + "b") leave a pair the overlap that it needs."""
    differ = F.aggregate(F.zip_with(x + "a", x + "b", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, v: t + v)
    return F.col("na") + F.col("nb") - differ >= 2 * _need(F.col("na"), F.col("nb"), threshold)


def _possible(pairs: DataFrame, nodes: DataFrame, threshold: int, counted: bool = False) -> DataFrame:
    """Those pairs (a, b) of a written table that can still reach the threshold by their parity bits.

    If `counted`, c is their overlap in rare prefix n-grams of few nodes, and they share at most
    min(ua, ub) n-grams of many nodes.
    """
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-nodes")
    facts = _small(written(nodes.join(_small(ids, SMALL_IDS), "node", "left_semi"), "pair-facts"))
    side = lambda k: facts.select(F.col("node").alias(k), *[F.col(c).alias(c + k) for c in ("n", "last", "u", "bits")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_alike(threshold) & _can_reach("bits", threshold))
    if counted:
        both = both.where(F.col("c") + F.least("ua", "ub") >= _missing(threshold))
    return both.select("a", "b")


def _listed(postings: DataFrame, nodes: DataFrame, roots: DataFrame, threshold: int) -> DataFrame:
    """Open lists of n-grams of many nodes: (gram, low, pos, node, n, last, u, c, fold).

    A list is open while its nodes lie in several components.  u is the number of such n-grams of
    the node, `pos` the place of `gram` among them, those of short lists first.  A pair must share
    k of them, so its first shared one is among the first u - k + 1 of either; a node stays only
    in lists where that can hold for some size of partner.
    """
    words = FOLDED // 64
    fold = F.array(*[reduce(Column.bitwiseXOR, [F.col("bits")[k] for k in range(w, PARITY // 64, words)]) for w in range(words)])
    comps = nodes.where("u > 0").select("node", "n", "last", fold.alias("fold")).join(roots, "node", "left")
    comps = comps.select("node", "n", "last", F.coalesce("component", "node").alias("c"), "fold")
    size = postings.join(comps, "node").groupBy("gram").agg(F.count("*").alias("many"), F.min("c").alias("low"), F.max("c").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    lists = written(size.where("low < high"), "open-lists")
    order = F.array_sort(F.collect_list(F.struct("many", "gram", "low", "least", "most")))
    own = postings.join(_small(lists), "gram").groupBy("node").agg(order.alias("lists")).join(comps, "node")
    rows = own.select("node", "n", "last", F.size("lists").alias("u"), "c", "fold", F.posexplode("lists").alias("pos", "l"))
    n = F.col("n")
    low = F.greatest(F.col("l.least"), F.ceil(n * threshold / 100))
    high = F.least(F.col("l.most"), F.floor(n * 100 / threshold))
    kept = rows.where(F.col("pos") <= F.col("u") - F.greatest(_least_missing(n, low, high, threshold), F.lit(1)))
    return written(kept.select(F.col("l.gram").alias("gram"), F.col("l.low").alias("low"), "pos", "node", "n", "last", "u", "c", "fold"), "open-postings")


class _Verifier:
    """Verifies pairs against segments of whole sets, which it reads for nodes when first needed.

    `owners` has (node, doc_id): the least id among the texts of a node.
    """

    def __init__(self, texts: DataFrame, owners: DataFrame, threshold: int):
        self.texts, self.owners, self.threshold, self.parts, self.nodes = texts, owners, threshold, None, None

    def __call__(self, pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        want = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidates")
        new = want if self.nodes is None else written(want.join(self.nodes, "node", "left_anti"), "candidates-new")
        ids = written(self.owners.join(_small(new, SMALL_IDS), "node", "left_semi").where("doc_id is not null").select("doc_id"), "owners")
        fresh = written(_segments(self.texts, ids), "segments", ROWS)
        self.parts = fresh if self.parts is None else self.parts.unionByName(fresh)
        self.nodes = new if self.nodes is None else self.nodes.unionByName(new)
        parts = self.parts.join(_small(want, SMALL_IDS), "node", "left_semi")
        return written(_verified(pairs, parts, self.threshold), "links")


def _united(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    if roots is not None:
        links = roots.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
    return written(components(links), "roots")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose nodes are in different components."""
    for k in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(k), F.col("component").alias("c" + k)), k, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def node_components(texts: DataFrame, first: DataFrame, owners: DataFrame, threshold: int) -> DataFrame:
    """(node, component) of the nodes whose component is another node."""
    order = _order(first)
    total = first.where("not gram").agg(F.sum("n")).first()[0] or 0
    fragments = max(FRAGMENTS, 1 << (total * (100 - threshold) // 100 // PER_FRAGMENT).bit_length())
    blobs = _fragments(texts, order, fragments, threshold)
    found = written(blobs.groupBy("f").applyInArrow(_join_fragment(threshold), "kind int, x long, y long, c long, bits array<long>"), "fragments", ROWS)
    postings = found.where("kind = 1").select(F.col("x").alias("gram"), F.col("y").alias("node"))
    postings = written(postings.distinct(), "postings")
    nodes = found.where("kind = 2").groupBy(F.col("x").alias("node")).agg(F.max("c").alias("n"), F.max("y").alias("last"), F.first("bits").alias("bits"))
    shared = postings.groupBy("node").agg(F.count("*").alias("u"))
    nodes = written(nodes.join(shared, "node", "left").withColumn("u", F.coalesce("u", F.lit(0))), "nodes")
    # The leader of an n-gram is the node of which the largest share of the prefix is shared by
    # many: the one nearest to the middle of a group of near copies, so most link with it at once.
    share = F.col("u") / (F.col("n") - F.floor((threshold * F.col("n") + 99) / 100) + 1)
    ranked = postings.join(nodes.where("u > 0").select("node", F.struct(share.alias("share"), "node").alias("l")), "node")
    leaders = ranked.groupBy("gram").agg(F.max("l").alias("l"), F.count("*").alias("many")).where("many > 1").select("gram", "l")
    leaders = written(leaders, "leaders")
    best = postings.join(_small(leaders), "gram").groupBy("node").agg(F.max("l").alias("l"), F.collect_set("l.node").alias("all"))
    best = written(best.select("node", F.col("l.node").alias("leader"), "all"), "best-leaders")

    # Partial overlaps are summed per pair; nodes of much shared n-grams meet their leaders.
    pair = lambda x: (F.least(x, "node").alias("a"), F.greatest(x, "node").alias("b"))
    light = found.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"), "c")
    stars = best.select("node", F.explode("all").alias("leader")).where("leader <> node").select(*pair("leader")).distinct().withColumn("c", F.lit(0))
    met = written(light.union(stars).groupBy("a", "b").agg(F.sum("c").alias("c")), "pairs-met")
    pairs = written(_possible(met, nodes, threshold, counted=True), "pairs")
    verify = _Verifier(texts, owners, threshold)

    # First one pair of each node, then those of the others that are not yet in one component.
    some = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(best.where("leader <> node").select(*pair("leader")))
    some = written(pairs.join(some.distinct(), ["a", "b"], "left_semi"), "pairs-first")
    roots = _united(None, verify(some))
    others = written(_apart(pairs.join(some, ["a", "b"], "left_anti"), roots), "pairs-others")
    if not others.isEmpty():
        roots = _united(roots, verify(others))

    # N-grams of many nodes that lie in several components: more leaders, then what is left.
    # These pairs have no rare n-gram in common, or they would be among those above, so they must
    # share enough of the others.  Where two nodes meet, their parity bits bound their overlap,
    # and only pairs that can reach the threshold leave the join.
    facts = ("pos", "n", "last", "u", "c", "fold")
    done = pairs
    for last in (False, False, True):
        rest = _listed(postings, nodes, roots, threshold)
        if rest.isEmpty():
            break
        b = rest.select("gram", F.col("node").alias("b"), *[F.col(x).alias(x + "b") for x in facts])
        if last:
            a = rest.select("gram", F.col("node").alias("a"), *[F.col(x).alias(x + "a") for x in facts])
        else:
            lead = rest.where("c > low").groupBy("gram").agg(F.max(F.struct("u", "node", *[x for x in facts if x != "u"])).alias("l"))
            a = written(lead.select("gram", F.col("l.node").alias("a"), *[F.col(f"l.{x}").alias(x + "a") for x in facts]), "leaders")
        apart = F.col("ca") < F.col("cb") if last else F.col("ca") != F.col("cb")
        k = F.greatest(_missing(threshold), F.lit(1))
        first = (F.col("posa") <= F.col("ua") - k) & (F.col("posb") <= F.col("ub") - k)
        more = b.join(a if last else _small(a), (b["gram"] == a["gram"]) & apart & _alike(threshold) & first & _can_reach("fold", threshold))
        more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = written(more.join(done, ["a", "b"], "left_anti"), "pairs-more")
        if more.isEmpty():
            continue
        done = done.unionByName(more)
        roots = _united(roots, verify(written(_possible(more, nodes, threshold), "pairs-possible")))
    return roots


def join(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document.

    `threshold` is in hundredths; two documents link when 100 * intersection >= threshold * union.
    """
    texts = _texts(docs, id_col, text_col)
    first = written(_first_pass(texts), "sets", ROWS)
    rows = first.where("not gram").select("doc_id", "n", F.col("h").alias("node"))
    with owned() as work:
        owners = written(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "node-owners")
        roots = node_components(texts, first, owners, threshold)
        classes = owners.join(roots, "node", "left").select("node", F.col("doc_id").alias("least"), F.coalesce("component", "node").alias("c"))
        named = named_by_component(written(classes, "classes")).select("node", "component_id")
    named = written(named, "components")
    work.drop(docs.sparkSession)
    return rows.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, but of each component only the row with its least id.

    Ids name documents: of rows that repeat the least id one stays.  Rows without words and rows
    with a null id all stay.
    """
    found = join(docs, threshold, id_col, text_col)
    gone = written(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "dropped")
    twice = found.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("many")).where("many > 1")
    gone = gone.withColumnRenamed("doc_id", "dropped_id")
    rest = docs.join(_small(gone, SMALL_IDS), docs[id_col] == gone["dropped_id"], "left_anti")
    twice = written(twice.select("doc_id"), "repeated")
    if twice.isEmpty():
        return rest
    twice = twice.withColumnRenamed("doc_id", "repeated_id")
    single = rest.join(twice, rest[id_col] == twice["repeated_id"], "left_anti")
    again = rest.join(twice, rest[id_col] == twice["repeated_id"], "left_semi")
    return single.unionByName(again.dropDuplicates([id_col]))
