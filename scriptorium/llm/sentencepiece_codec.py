"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a run of spaces and what follows up to the next space; no piece
crosses that border) are joined into one text.  Its suffixes are sorted as far as the longest
piece, every piece is binary-searched for its range of occurrences, and the occurrences become
edges (start, end, piece).  Sorted by end position they are relaxed over all units at once.

For a BPE model an edge may extend a prefix when its piece is compatible with the last piece of
the prefix's own encoding, that is, when BPE of the two together leaves both as they are.
Exactly one edge does at each position, so relaxation gives exactly the ids of BPE.
Characters without a piece become byte pieces (or one unknown id a run, without byte fallback).

Only BPE models with identity normalisation are read; others are refused.  Edge cases: a null
text gives null ids, an empty one no ids; null ids decode to null; repeated rows are encoded
like others.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_slices

SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHE, SLICE, UNITS = 600_000, 4 << 20, 40_000
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
#: Code points a sort key holds, bits of each.
PER_KEY, BITS = 3, 21
MOST = (1 << BITS) - 1


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Vocabulary:
    """Pieces of a model file, with the merge that makes each multi-character piece.

    `order` ranks pieces as BPE makes them: single characters first, then by falling score.
    """

    def __init__(self, data: bytes):
        self.pieces, self.kinds, scores = [], [], []
        kind, self.fallback, self.dummy, self.squeeze, charsmap = 1, False, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                spec = dict(_fields(value))
                kind, self.fallback = spec.get(3, 1), bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                charsmap, self.dummy, self.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if kind != 2 or charsmap:
            raise ValueError("only BPE models with identity normalisation are supported")
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.bytes_ids = np.full(256, self.unknown, np.int32)
        for k, (p, t) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if t == BYTE:
                self.bytes_ids[int(p[3:5], 16)] = k
        ids = [k for k, t in enumerate(self.kinds) if t in (NORMAL, USER)]
        ids.sort(key=lambda k: (len(self.pieces[k]) > 1, -scores[k] if len(self.pieces[k]) > 1 else 0, k))
        self.ids = np.array(ids, np.int32)
        strings = [self.pieces[k] for k in ids]
        # Unless a piece has a space after another character, units can be encoded apart.
        self.apart = not any(SPACE in s.lstrip(SPACE) for s in strings)
        self._merges(strings)
        self.strings = strings
        self.bytes = [
            bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() if t in (NORMAL, USER) else " ⁇ ".encode() if t == UNKNOWN else b""
            for p, t in zip(self.pieces, self.kinds, strict=True)
        ]

    def _merges(self, strings: list[str]) -> None:
        """Left and right part of each piece (itself for a character, -1 if BPE never makes it)."""
        place, n = {s: k for k, s in enumerate(strings)}, len(strings)
        left, right, pairs = list(range(n)), list(range(n)), {}

        def compatible(a: int, b: int) -> bool:
            limit = n
            while True:
                made = pairs.get((a, b))
                if made is not None and made < limit:
                    return False
                down_a = a > b
                for _ in range(2):
                    if down_a:
                        limit, a2 = a, right[a]
                        if a2 != a:
                            a = a2
                            break
                    else:
                        limit, b2 = b + 1, left[b]
                        if b2 != b:
                            b = b2
                            break
                    down_a = not down_a
                else:
                    return True

        for k, s in enumerate(strings):
            if len(s) == 1:
                continue
            left[k] = right[k] = -1
            for cut in range(1, len(s)):
                a, b = place.get(s[:cut], n), place.get(s[cut:], n)
                if a < k and b < k and left[a] >= 0 and left[b] >= 0 and compatible(a, b):
                    left[k], right[k], pairs[a, b] = a, b, k
                    break
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        sort = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[sort], np.array(list(pairs.values()), np.int64)[sort]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the pieces a and b, side by side, as they are; elementwise.

        Merges are undone, latest first, on either side of the border; whenever the two pieces
        at the border could merge earlier than what was just undone, BPE would have done so.
        """
        n = len(self.ids)
        ok, open_ = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), n, np.int64)
        while len(open_):
            key = a * n + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_made[at] < limit) if len(self.pair_keys) else np.zeros(len(a), bool)
            ok[open_[bad]] = False
            a_parts, b_parts = self.right[a] != a, self.left[b] != b
            down_a = np.where(a > b, a_parts, a_parts & ~b_parts)
            down_b = ~down_a & b_parts
            go = ~bad & (down_a | down_b)
            limit = np.where(down_a, a, b + 1)[go]
            a, b = np.where(down_a, self.right[a], a)[go], np.where(down_b, self.left[b], b)[go]
            open_ = open_[go]
        return ok


def _keys(points: np.ndarray) -> np.ndarray:
    """For each position, PER_KEY code points in one number (zeros beyond the end)."""
    x = np.concatenate([points.astype(np.int64), np.zeros(PER_KEY, np.int64)])
    out = np.zeros(len(points), np.int64)
    for k in range(PER_KEY):
        out = out << BITS | x[k : k + len(points)]
    return out


class Index:
    """Suffix array of a text, sorted as far as `depth` code points."""

    def __init__(self, points: np.ndarray, depth: int):
        self.levels = -(-depth // PER_KEY)
        key = _keys(points)
        self.padded = np.concatenate([key, np.zeros(self.levels * PER_KEY, np.int64)])
        # Sort by the first key, then double the length that the ranks tell apart.
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        reach = PER_KEY
        while reach < depth and len(rank) and rank.max() + 1 < len(rank):
            ahead = np.concatenate([rank[reach:] + 1, np.zeros(min(reach, len(rank)), np.int64)])[: len(rank)]
            rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
            reach *= 2
        self.order = np.argsort(rank)

    def _bound(self, level: int, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
        """First place in [lo, hi) whose key at `level` is not below (right: is above) `want`."""
        lo, hi = lo.copy(), hi.copy()
        while (go := lo < hi).any():
            mid = (lo + hi) // 2
            key = self.padded[self.order[np.minimum(mid, len(self.order) - 1)] + level * PER_KEY]
            below = (key <= want if right else key < want) & go
            lo = np.where(below, mid + 1, lo)
            hi = np.where(go & ~below, mid, hi)
        return lo

    def ranges(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each piece; low and high are its keys, padded with
        the least and the greatest code point."""
        lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), len(self.order), np.int64)
        for level in range(self.levels):
            go = np.flatnonzero((sizes > level * PER_KEY) & (lo < hi))
            left = self._bound(level, low[go, level], lo[go], hi[go], False)
            hi[go] = self._bound(level, high[go, level], left, hi[go], True)
            lo[go] = left
        return lo, hi


class Codec:
    """Encoder and decoder of one vocabulary, with a cache of encoded units."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.known: dict[str, bytes] = {}
        made = np.flatnonzero(v.left >= 0)
        self.made, self.sizes = made, np.array([len(v.strings[k]) for k in made], np.int64)
        self.depth = int(self.sizes.max())
        width = -(-self.depth // PER_KEY) * PER_KEY
        low, high = np.zeros((len(made), width), np.int64), np.full((len(made), width), MOST, np.int64)
        for row, k in enumerate(made):
            s = v.strings[k]
            low[row, : len(s)] = high[row, : len(s)] = [ord(c) for c in s]
        pack = lambda m: (m[:, 0::3] << (2 * BITS)) | (m[:, 1::3] << BITS) | m[:, 2::3]
        self.low, self.high = pack(low), pack(high)
        self.made_bytes = np.frombuffer(b"".join(v.bytes), np.uint8)
        self.byte_sizes = np.array([len(x) for x in v.bytes], np.int64)

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units, as bytes of 32-bit numbers."""
        v, n = self.v, len(self.v.ids)
        joined = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(u) for u in units], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        index = Index(joined, self.depth)
        lo, hi = index.ranges(self.low, self.high, self.sizes)
        many = hi - lo
        piece = np.repeat(np.arange(len(many)), many)
        start = index.order[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        end, piece = start + self.sizes[piece], self.made[piece]
        # A character that no piece covers alone is an edge to the unknown piece n.
        alone = np.zeros(len(joined), bool)
        alone[start[end == start + 1]] = True
        inside = np.ones(len(joined), bool)
        inside[begin + size] = False
        odd = np.flatnonzero(inside & ~alone)
        start, end, piece = np.concatenate([start, odd]), np.concatenate([end, odd + 1]), np.concatenate([piece, np.full(len(odd), n)])
        unit = np.repeat(np.arange(len(units)), size + 1)[start]
        at = end - begin[unit]
        fits = at <= size[unit]  # a NUL within a unit is a character like others
        order = np.argsort(at[fits].astype(np.uint16) if len(at) and at.max() < 1 << 16 else at[fits], kind="stable")
        start, end, piece, unit, at = (x[fits][order] for x in (start, end, piece, unit, at))
        last = np.full(len(joined) + 1, -1, np.int64)  # piece that ends here in its prefix's encoding
        first = start == begin[unit]
        cuts = np.flatnonzero(np.diff(np.concatenate([[-1], at, [-1]])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, p = start[a:b], piece[a:b]
            before = last[s]
            good = first[a:b].copy()
            test = np.flatnonzero(~good & (before >= 0))
            free = (before[test] == n) | (p[test] == n)
            good[test[free]] = True
            test = test[~free]
            good[test] = v.compatible(before[test], p[test])
            last[end[a:b][good]] = p[good]
        # Walk back from the ends of all units at once.
        length = np.append(np.array([len(s) for s in v.strings], np.int64), 1)
        out: list[list[np.ndarray]] = []
        alive, pos = np.arange(len(units)), begin + size
        while len(alive):
            p = last[pos]
            pos = pos - length[p]
            out.append([alive, p, pos])
            more = pos > begin[alive]
            alive, pos = alive[more], pos[more]
        owner, tokens, where = (np.concatenate([o[k] for o in out[::-1]]) for k in range(3))
        sort = np.lexsort((where, owner))
        owner, tokens, where = owner[sort], tokens[sort], where[sort]
        ids = np.append(v.ids, v.unknown)[tokens]
        if (tokens == n).any():
            owner, ids = self._unknown(owner, tokens == n, ids, joined[where])
        cut = np.searchsorted(owner, np.arange(len(units) + 1)) * 4
        data = ids.astype("<i4").tobytes()
        return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _unknown(self, owner: np.ndarray, odd: np.ndarray, ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners and ids with each character that has no piece as its bytes, or a run of them as one id."""
        if not self.v.fallback:
            same = odd.copy()
            same[1:] &= odd[:-1] & (owner[1:] == owner[:-1])
            same[:1] = False
            return owner[~same], ids[~same]
        chars, which = np.unique(points[odd], return_inverse=True)
        table = [self.v.bytes_ids[list(chr(c).encode("utf-8", "replace"))] for c in chars.tolist()]
        size, pool = np.array([len(t) for t in table], np.int64), np.concatenate(table)
        many = np.ones(len(ids), np.int64)
        many[odd] = size[which]
        ends = np.cumsum(many)
        out, place = np.repeat(ids, many), np.repeat(odd, many)
        inside = np.arange(ends[-1]) - np.repeat(ends - many, many)
        first = np.zeros(len(ids), np.int64)
        first[odd] = (np.cumsum(size) - size)[which]
        out[place] = pool[(np.repeat(first, many) + inside)[place]]
        return np.repeat(owner, many), out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each as bytes of little-endian 32-bit numbers."""
        v = self.v
        if len(self.known) > CACHE:
            self.known.clear()
        rows = []
        for text in texts:
            if v.squeeze:
                text = " ".join(x for x in text.split(" ") if x)
            text = (" " if v.dummy and text else "") + text
            text = text.replace(" ", SPACE)
            rows.append(UNIT.findall(text) if v.apart else [text] if text else [])
        new = sorted({u for r in rows for u in r if u not in self.known})
        for at in range(0, len(new), UNITS):
            part = new[at : at + UNITS]
            self.known.update(zip(part, self._encode_units(part), strict=True))
        known = self.known
        return [b"".join([known[u] for u in r]) for r in rows]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of runs of ids; ids[offsets[k]:offsets[k + 1]] is the k-th."""
        size = self.byte_sizes[ids]
        ends = np.cumsum(size)
        begin = (np.cumsum(self.byte_sizes) - self.byte_sizes)[ids] - (ends - size)
        data = self.made_bytes[np.repeat(begin, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cut = np.concatenate([[0], ends])[offsets]
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return [t[1:] if self.v.dummy and t.startswith(" ") else t for t in out]


_READY: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """Codec of a model file; built once a process."""
    path = path or vocabulary()
    if path not in _READY:
        with open(path, "rb") as f:
            _READY[path] = Codec(Vocabulary(f.read()))
    return _READY[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int; null for a null text)."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)  # of the worker, with the cache of its former tasks
        for ids, texts in read_slices(batches, SLICE):
            values = texts.to_pylist()
            rows = model.encode([t or "" for t in values])
            flat = np.frombuffer(b"".join(rows), "<i4")
            ends = np.cumsum([0, *[len(r) // 4 for r in rows]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            if texts.null_count:
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=texts.is_null())
            yield pa.RecordBatch.from_arrays([ids, lists], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """`rows` with their column of ids replaced by `text`, which takes the place of a column of that name."""
    path = path or vocabulary()
    names = [c for c in rows.columns if c not in (ids_col, "text")]
    out = T.StructType([*[f for f in rows.schema.fields if f.name in names], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = batch.column(batch.schema.get_field_index(ids_col))
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.nan_to_num(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
                texts = pa.array(model.decode(flat, np.cumsum([0, *sizes])), pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], texts], names=[*names, "text"])

    return rows.mapInArrow(run, out)
