"""Best-two-fit packing of tokenized documents into sequences of fixed length.

1. `tokenize` turns each text into ids plus an end id and cuts what is longer than a sequence
   into pieces (Arrow batches, no shuffle).
2. The counts of pieces by length (at most one row per possible length) are all that the
   packing itself needs.  `plan` fills one pattern after another greedily, largest piece that
   fits first; then, while a gap is left, it replaces the smallest piece of the pattern with
   two unpacked pieces that fit the expanded gap more tightly.  A pattern is used as often as
   the counts allow, so the plan is short and covers the pieces of all tasks together.
3. Pieces are numbered within their length, in salted cells, and take the places of the plan.

Edge cases: a null text counts as empty (its only id is the end id); repeated rows and null
ids are packed like others; an empty table gives an empty result; other columns of the documents
are not looked at, whatever their names.
"""

from __future__ import annotations

import bisect
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_slices, release, written

LENGTH, END = 2048, 0
#: Words kept in a worker's cache of encoded words, bytes of text encoded at a time, rows of an Arrow batch.
CACHE, SLICE, ROWS = 600_000, 4 << 20, 4_096
#: Rows of a cell in which pieces of one length are numbered, about; cells a length at most.
PER_CELL, MAX_CELLS = 256, 65_536


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts by a lower-casing tokenizer whose tokens never cross ASCII white space.

    A word (run without ASCII white space) is lower-cased, parted from ASCII punctuation that
    follows its last letter or digit, and each part is encoded once and cached.  Words that could
    hold a special token are encoded as they are.
    """

    #: Tail: ASCII punctuation but for the apostrophe, after a letter or digit.
    PARTS = r"^(?P<core>.*[\p{L}\p{N}])(?P<tail>[!-&(-/:-@\[-`{-~]+)$"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}

    def _bytes(self, words: pa.Array) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known = {"": b""}
        special = pc.match_substring(words, "<|")
        words = pc.if_else(special, words, pc.ascii_lower(words))
        parts = pc.extract_regex(words, self.PARTS)
        parts = pc.if_else(special, pa.scalar(None, parts.type), parts)
        core = pc.coalesce(pc.struct_field(parts, "core"), words).to_pylist()
        tail = pc.fill_null(pc.struct_field(parts, "tail"), "").to_pylist()
        known = self.known
        new = list({w for w in core if w not in known} | {w for w in tail if w not in known})
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
        return [known[c] + known[t] if t else known[c] for c, t in zip(core, tail, strict=True)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the offsets of the texts in them."""
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten().dictionary_encode()
        made = self._bytes(flat.dictionary)
        pool, size = np.frombuffer(b"".join(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made)) // 4
        codes = flat.indices.to_numpy(zero_copy_only=False)
        each = size[codes]
        ends = np.cumsum(each)
        begin = (np.cumsum(size) - size)[codes] - (ends - each) if len(codes) else each
        ids = pool[np.repeat(begin, each) + np.arange(ends[-1] if len(ends) else 0)]
        words = np.cumsum([0, *pc.list_value_length(lists).to_numpy(zero_copy_only=False)])
        return ids, np.append(0, ends)[words]


_READY: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """Encoder of a vocabulary file; one a process, so that its cache serves all tasks of a worker."""
    if path not in _READY:
        _READY[path] = WordEncoder(path)
    return _READY[path]


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def tokenize(
    docs: DataFrame, vocabulary_path: str | None = None, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids (little-endian 32-bit)."""
    path = vocabulary_path or vocabulary()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for doc_ids, texts in read_slices(batches, SLICE):
            ids, at = encode(texts)
            rows: list[list] = [[], [], [], [], []]
            for k, doc in enumerate(doc_ids.to_pylist()):
                own = np.append(ids[at[k] : at[k + 1]], np.uint32(end)).astype("<u4")
                for n, start in enumerate(range(0, len(own), length)):
                    cut = own[start : start + length]
                    for column, x in zip(rows, (doc, n, start, len(cut), cut.tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=PIECES.names
            )
            del ids, rows
            release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(pieces, PIECES)


class Stock:
    """Pieces not yet packed, by length."""

    def __init__(self, counts: dict[int, int]):
        self.left, self.lengths = dict(counts), sorted(counts)

    def largest(self, most: int) -> int:
        """Largest length at most `most` of which a piece is left; 0 if there is none."""
        k = bisect.bisect_right(self.lengths, most)
        return self.lengths[k - 1] if k else 0

    def take(self, n: int, times: int = 1) -> None:
        self.left[n] -= times
        if not self.left[n]:
            del self.left[n]
            self.lengths.pop(bisect.bisect_left(self.lengths, n))

    def put(self, n: int) -> None:
        if n not in self.left:
            self.left[n] = 0
            bisect.insort(self.lengths, n)
        self.left[n] += 1

    def best_two(self, gap: int, over: int) -> tuple[int, int] | None:
        """Two pieces whose sum is at most `gap`, over `over`, and the largest such."""
        best = None
        for a in reversed(self.lengths[: bisect.bisect_right(self.lengths, gap - 1)]):
            if 2 * a <= over:
                break
            b = self.largest(min(gap - a, a))
            if b == a and self.left[a] < 2:
                b = self.largest(a - 1)
            if b and a + b > over:
                best, over = (a, b), a + b
                if over == gap:
                    break
        return best


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times used, {piece length: pieces}) that use up the counted pieces."""
    stock, out = Stock(counts), []
    while stock.lengths:
        bin_, gap = [], length
        while n := stock.largest(gap):
            many = min(stock.left[n], gap // n)
            stock.take(n, many)
            bin_ += [n] * many
            gap -= n * many
        while gap and (two := stock.best_two(gap + bin_[-1], bin_[-1])):
            stock.put(small := bin_.pop())
            for n in two:
                stock.take(n)
            bin_ = sorted([*bin_, *two], reverse=True)
            gap += small - sum(two)
        uses = {n: bin_.count(n) for n in dict.fromkeys(bin_)}
        more = min(stock.left.get(n, 0) // k for n, k in uses.items())
        if more:
            for n, k in uses.items():
                stock.take(n, k * more)
        out.append((1 + more, uses))
    return out


def _places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length, runs of places: first rank, pieces a sequence, first sequence, first offset."""
    runs: dict[int, list] = {}
    first, ranks = 0, {}
    for times, uses in patterns:
        offset = 0
        for n, k in uses.items():
            runs.setdefault(n, []).append((ranks.get(n, 0), k, first, offset))
            ranks[n] = ranks.get(n, 0) + times * k
            offset += n * k
        first += times
    return {n: np.array(x, np.int64) for n, x in runs.items()}


def assign(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """`pieces` (doc_id, piece, start, length and any other columns) with sequence_id and offset, which
    take the place of columns of these names."""
    counts = {x.length: x.n for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(plan(counts, length))  # bounded by the number of lengths, whatever the input
    cells = min(MAX_CELLS, max(16, sum(counts.values()) // PER_CELL))
    cell, n, before, rank = (f"_{uuid.uuid4().hex}" for _ in range(4))  # no column of the caller's has these names
    pieces = pieces.withColumn(cell, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)))
    earlier = Window.partitionBy("length").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("length", cell).agg(F.count("*").alias(n)).select("length", cell, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy("length", cell).orderBy("doc_id", "piece", "start")
    ranked = pieces.join(starts, ["length", cell]).withColumn(rank, F.col(before) + F.row_number().over(within) - 1).drop(cell, before)
    kept = [f for f in ranked.schema.fields if f.name not in ("sequence_id", "offset")]
    ranked = ranked.select(*[F.col(f"`{f.name}`") for f in kept])
    out = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, nth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", rank))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for v in np.unique(size):
                own, runs = np.flatnonzero(size == v), places[int(v)]
                run = runs[np.searchsorted(runs[:, 0], nth[own], "right") - 1]
                k = nth[own] - run[:, 0]
                sequence[own], offset[own] = run[:, 2] + k // run[:, 1], run[:, 3] + k % run[:, 1] * v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=out.names)

    return ranked.mapInArrow(place, out).drop(rank)


def pack(docs: DataFrame, vocabulary_path: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece lies: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenize(docs, vocabulary_path, length, id_col=id_col, text_col=text_col)
    pieces = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces", ROWS)
    return assign(pieces, length).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, vocabulary_path: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of int), doc_ids in order."""
    pieces = written(tokenize(docs, vocabulary_path, length, id_col=id_col, text_col=text_col), "pieces", ROWS)
    placed = assign(pieces, length).withColumn("part", F.struct("offset", "doc_id", "ids"))
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))  # a sequence is at most `length` ids

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sid]), pa.array([ids], pa.list_(pa.int32())), pa.array([[p["doc_id"] for p in parts]], pa.list_(pa.int64()))],
                    names=["sequence_id", "ids", "doc_ids"],
                )

    return rows.select("sequence_id", "parts").mapInArrow(join, "sequence_id long, ids array<int>, doc_ids array<long>")
