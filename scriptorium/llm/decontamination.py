"""Documents that repeat passages of a benchmark, by suffix arrays of the documents' words.

Words are maximal runs of [0-9a-z] and non-ASCII characters after A-Z are lower-cased.  A window is
WINDOW consecutive words of a benchmark item; an item of fewer words, but not none, is one window.

Every shard of documents (some megabytes of text in a task) gets a suffix array: its word positions,
sorted by the words that follow them.  Each test suffix (the item words from a window's start on)
is searched in it by bisection, a word deeper at a time, so the range of equal suffixes narrows
until it is empty or the window's words are all matched; what is left of the range are the places
of verbatim matches.  Positions from which no window can match, because a word is not in
the vocabulary of the benchmark, are left out of the array.  Words are looked up by a 64-bit hash
and compared byte by byte, so results are exact.

The benchmark is cut into blocks of about BLOCK_WORDS words, of which one at a time is gathered and
sent to all tasks; a larger benchmark is more blocks, and each is searched in every shard.  Long
items are cut into overlapping pieces, long texts into shards of SHARD_WORDS positions, and the
only shuffles are of small rows: merging the findings of several blocks.

Edge cases: a null text has no words and no match; null and repeated document ids get a row each;
a null item id counts for hits, but not among the items; items that share an id are one item;
without documents the result is empty, without benchmark words nothing is contaminated; other
columns are not looked at, and `decontaminate` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_slices, text_bytes, written

WINDOW = 10
#: Words of a block of the benchmark, and of a piece of a long item.
BLOCK_WORDS, PIECE_WORDS = 1 << 21, 1 << 16
#: Bytes tokenised at a time, and positions of a suffix array.
CHUNK_BYTES, SHARD_WORDS = 4 << 20, 1 << 20
#: Bits of the table that tells most words outside the vocabulary apart.
FILTER_BITS = 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Whether a byte is inside a word, once lower-cased.
INSIDE = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hashes(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Hash of each word (low[start : start + length]); what lies beyond `powers` is taken times the last one."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    at = place + np.repeat(starts, lengths)
    values = (low[at].astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, len(powers) - 1)]
    return np.add.reduceat(values, first)


@dataclass
class Block:
    """A block of the benchmark: its vocabulary, its distinct windows, and the items of each."""

    powers: np.ndarray
    keys: np.ndarray  # hashes of the vocabulary, ascending
    ids: np.ndarray  # the word (from 1) of each key
    filter: np.ndarray
    text: np.ndarray  # bytes of the vocabulary, word after word
    at: np.ndarray  # where each word begins in them, one entry more than words
    words: np.ndarray  # words of all pieces, then WINDOW zeros
    windows: np.ndarray  # where each distinct window begins in `words`
    lengths: np.ndarray
    item_at: np.ndarray  # items of window w: items[item_at[w] : item_at[w + 1]]
    items: np.ndarray
    names: np.ndarray

    @property
    def shortest(self) -> int:
        return int(self.lengths.min())


def _fold(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(_MULTIPLIERS[0])) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def make_block(pieces: pa.Table) -> Block | None:
    """The block of pieces (item_id, words: at least one); None without pieces."""
    if not len(pieces):
        return None
    lists = pieces["words"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    words = np.concatenate([coded.indices.to_numpy().astype(np.int32) + 1, np.zeros(WINDOW, np.int32)])
    encoded = [w.encode() for w in coded.dictionary.to_pylist()]
    sizes = np.array([len(w) for w in encoded])
    at = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(b"".join(encoded), np.uint8)
    for base in _MULTIPLIERS:  # until no two words of the vocabulary have one hash
        powers = _powers(base, int(sizes.max()) + 1)
        hashes = _hashes(text, at[:-1], sizes, powers)
        if len(np.unique(hashes)) == len(hashes):
            break
    else:
        raise ValueError("words of the benchmark cannot be told apart by their hashes")
    order = np.argsort(hashes)
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[_fold(hashes)] = True

    n = np.diff(lists.offsets.to_numpy().astype(np.int64))
    begin = np.cumsum(n) - n
    many = np.maximum(n - WINDOW + 1, 1)
    piece = np.repeat(np.arange(len(n)), many)
    starts = begin[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
    lengths = np.minimum(n, WINDOW)[piece]
    columns = [np.where(lengths > k, words[starts + k], 0) for k in range(WINDOW)]
    by = np.lexsort(columns[::-1])
    new = np.concatenate([[True], np.any([c[by][1:] != c[by][:-1] for c in columns], axis=0)])
    window = np.cumsum(new) - 1
    names, item = np.unique(np.array([x if x is not None else "" for x in pieces["item_id"].to_pylist()], object), return_inverse=True)
    known = pieces["item_id"].is_valid().to_numpy()
    pairs = np.unique((window * len(names) + item[piece[by]])[known[piece[by]]])
    item_at = np.searchsorted(pairs, np.arange(int(window[-1]) + 2) * len(names))
    return Block(powers, hashes[order], (order + 1).astype(np.int32), bits, text, at, words, starts[by][new], lengths[by][new], item_at, (pairs % len(names)).astype(np.int32), names)


def _chunks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK_BYTES bytes that do not cut words."""
    a = 0
    while a < len(data):
        b = min(a + CHUNK_BYTES, len(data))
        while b < len(data):
            free = np.flatnonzero(~INSIDE[LOWER[data[b : b + 4096]]])
            if len(free):
                b += int(free[0])
                break
            b = min(b + 4096, len(data))
        yield a, b
        a = b


def _look_up(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: Block) -> np.ndarray:
    """Number of each word in the vocabulary, 0 if it is not there."""
    out = np.zeros(len(starts), np.int32)
    short = np.flatnonzero(lengths < len(block.powers))
    hashes = _hashes(low, starts[short], lengths[short], block.powers)
    passed = block.filter[_fold(hashes)]
    short, hashes = short[passed], hashes[passed]
    k = np.minimum(np.searchsorted(block.keys, hashes), len(block.keys) - 1)
    word = block.ids[k]
    same = (block.keys[k] == hashes) & (np.diff(block.at)[word - 1] == lengths[short])
    short, word = short[same], word[same]
    if len(short):
        n = lengths[short]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = low[place + np.repeat(starts[short], n)] == block.text[place + np.repeat(block.at[word - 1], n)]
        word = np.where(np.logical_and.reduceat(equal, first), word, 0)
        out[short] = word
    return out


def tokens(data: np.ndarray, offsets: np.ndarray, block: Block | None) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary numbers of the words of all texts, and where each text's words begin among them."""
    found, first, total = [], np.zeros(len(offsets), np.int64), 0
    for a, b in _chunks(data):
        low = LOWER[data[a:b]]
        inside = INSIDE[low]
        texts = slice(np.searchsorted(offsets, a), np.searchsorted(offsets, b))
        cut = np.zeros(b - a + 1, bool)  # a text begins here
        cut[offsets[texts] - a] = True
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        first[texts] = total + np.searchsorted(starts, offsets[texts] - a)
        found.append(_look_up(low, starts, ends - starts, block) if block is not None else np.zeros(len(starts), np.int32))
        total += len(starts)
    first[np.searchsorted(offsets, len(data)) :] = total
    return (np.concatenate(found) if found else np.zeros(0, np.int32)), first


def suffix_array(words: np.ndarray, first: np.ndarray, low: int, high: int, shortest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in [low, high) that at least `shortest` words of the vocabulary follow in their text,
    sorted by the next WINDOW words, and these words, 0 beyond the run."""
    at = low + np.flatnonzero(words[low:high])
    reach = words[low : high + WINDOW]
    stops = np.union1d(low + np.flatnonzero(reach == 0), np.append(first[np.searchsorted(first, low) : np.searchsorted(first, high + WINDOW)], low + len(reach)))
    run = stops[np.searchsorted(stops, at, "right")] - at
    at, run = at[run >= shortest], run[run >= shortest]
    columns = [np.where(run > k, words[np.minimum(at + k, len(words) - 1)], 0).astype(np.int64) for k in range(WINDOW)]
    order = np.lexsort([columns[k] << 32 | columns[k + 1] for k in range(WINDOW - 2, -1, -2)])
    return at[order], [c[order] for c in columns]


def search(columns: list[np.ndarray], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, low, high): the range of the suffix array that begins with each window that occurs."""
    base = np.int64(len(block.at) + 1)
    there = np.zeros(len(block.at), bool)
    there[columns[0]] = True
    window = np.flatnonzero(there[block.words[block.windows]])
    rank, own, out = np.zeros(len(columns[0]), np.int64), np.zeros(len(window), np.int64), []
    for k, column in enumerate(columns):
        keys = rank * base + column  # ascending, since the suffixes are sorted
        wanted = own * base + block.words[block.windows[window] + k]
        low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
        some = low < high
        window, low, high = window[some], low[some], high[some]
        whole = block.lengths[window] == k + 1
        out.append((window[whole], low[whole], high[whole]))
        rank = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
        window, own = window[~whole], rank[low[~whole]]
        if not len(window):
            break
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matches(words: np.ndarray, first: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word is inside a match, and the distinct (text, window) pairs as text * windows + window."""
    depth, pairs = np.zeros(len(words) + 1, np.int32), [np.zeros(0, np.int64)]
    for low in range(0, len(words), SHARD_WORDS):
        at, columns = suffix_array(words, first, low, min(low + SHARD_WORDS, len(words)), block.shortest)
        if not len(at):
            continue
        window, lo, hi = search(columns, block)
        n = hi - lo
        place = at[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        window = np.repeat(window, n)
        np.add.at(depth, place, 1)
        np.add.at(depth, place + block.lengths[window], -1)
        text = np.searchsorted(first, place, "right") - 1
        pairs.append(np.unique(text * len(block.windows) + window))
    return np.cumsum(depth[:-1]) > 0, np.unique(np.concatenate(pairs))


FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _find(data: np.ndarray, offsets: np.ndarray, block: Block | None) -> list[pa.Array]:
    """Arrow columns of FOUND for each text: hit stretches of words, and the items that match."""
    words, first = tokens(data, offsets, block)
    n = len(offsets) - 1
    hit, pairs = _matches(words, first, block) if block is not None else (np.zeros(len(words), bool), np.zeros(0, np.int64))
    cut = np.zeros(len(words) + 1, bool)
    cut[first] = True
    before, after = np.concatenate([[False], hit[:-1]]), np.concatenate([hit[1:], [False]])
    start = np.flatnonzero(hit & (~before | cut[:-1]))
    end = np.flatnonzero(hit & (~after | cut[1:])) + 1
    span_at = np.searchsorted(start, first)
    own = np.repeat(first[:-1], np.diff(span_at))
    spans = pa.StructArray.from_arrays([pa.array(start - own), pa.array(end - own)], ["start", "end"])
    items, item_at = [], np.zeros(n + 1, np.int64)
    if block is not None:
        texts, windows = np.divmod(pairs, len(block.windows))
        bounds = np.searchsorted(texts, np.arange(n + 1))
        for k in np.flatnonzero(np.diff(bounds)):  # contaminated texts only
            own = [block.items[block.item_at[w] : block.item_at[w + 1]] for w in windows[bounds[k] : bounds[k + 1]]]
            items.append(np.unique(np.concatenate(own)))
            item_at[k + 1] = len(items[-1])
    names = block.names[np.concatenate(items)] if items else []
    as_list = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
    return [pa.array(np.diff(first)), as_list(span_at, spans), as_list(np.cumsum(item_at), pa.array(names, pa.string()))]


def _pieces(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words) of all items: WINDOW - 1 words of a piece are also in the next one of its item."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_extract_all(F.translate(text_col, capitals, capitals.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), words.alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1)), F.lit(PIECE_WORDS))
    return rows.select("item_id", "words", F.explode(starts).alias("s")).select("item_id", F.slice("words", F.col("s"), PIECE_WORDS + WINDOW - 1).alias("words"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _search_block(docs: DataFrame, block: Block | None) -> DataFrame:
    """(key, n_words, spans, items) of rows (key, text); the block is of bounded size."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        for batch in batches:
            for keys, texts in read_slices([batch]):
                data, offsets = text_bytes(texts)
                found = _find(data, offsets, sent.value)
                yield pa.RecordBatch.from_arrays([keys, *found], ["key", "n_words", "spans", "items"])

    key = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {key}, {FOUND}")


def _merged(spans: Column) -> Column:
    """Stretches in order, those that overlap or touch united."""
    zero = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), zero, step)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document: doc_id, digest (SHA-256 of the text), n_words, spans (hit stretches of
    words, from 0, the end excluded), and items, the distinct ids of items that match, in order."""
    pieces = written(_pieces(benchmark, item_col, item_text_col), "benchmark-pieces")
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    dealt = F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(F.col(id_col).alias("doc_id"), _digest(F.col(text_col)).alias("digest")).alias("key"), text.alias("text"))
    found = [_search_block(keyed, make_block(pieces.where(dealt == b).toArrow())).select("key.*", "n_words", "spans", "items") for b in range(blocks)]
    if blocks == 1:
        return found[0].withColumn("items", F.array_sort("items"))
    # What the blocks found in a text is united; rows that repeat are found once and joined again.
    parts = [written(f, "benchmark-found") for f in found]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    united = rows.groupBy(F.col("digest").alias("_digest")).agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    united = united.where(F.size("spans") > 0).select("_digest", _merged(F.col("spans")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    none = parts[0].drop("spans", "items")
    joined = none.join(united, F.col("digest") == F.col("_digest"), "left")
    empty = lambda c: F.coalesce(c, F.array().cast(parts[0].schema[c].dataType)).alias(c)
    return joined.select("doc_id", "digest", "n_words", empty("spans"), empty("items"))


def report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans of hit words."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rows = find(docs, benchmark, **names)
    return rows.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The rows of `docs`, all columns, whose texts repeat no window of the benchmark."""
    bad = find(docs, benchmark, text_col=text_col, **names).where(F.size("spans") > 0).select(F.col("digest").alias("_digest")).distinct()
    return docs.join(bad, _digest(docs[text_col]) == bad["_digest"], "left_anti")
