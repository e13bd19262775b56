"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades are ordered: 0 low quality, 1 good but toxic, 2 good and clean.  One weight vector over
hashed byte 4-grams (and one weight for the share of words that repeat the word before) is
shared by all grades; ordered thresholds cut the line into grades:
P(grade <= k) = sigmoid(threshold_k - f(text)).  A text gets its expected grade and the tail
probability P(grade >= 1), by which documents are selected.

Trained on the driver on at most SAMPLE labelled texts of at most SAMPLE_BYTES bytes; all
texts are scored whole, on Arrow buffers, in tasks that hold one slice of text at a time.

Edge cases: a null or empty text has f = 0; rows whose grade is not known (quality null, or
quality 1 with toxic null) or that lack a document are not learned from; equal labels repeated for
a document count once, different ones each; without labels every document has
tail probability 1 and the highest grade.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_slices, text_bytes

#: Hash buckets (the last one is for repeated words), grams that smooth short texts.
BUCKETS, SMOOTH = 8_192, 40
#: Bounds on what the driver learns from.
SAMPLE, SAMPLE_BYTES = 3_000, 16_384
GRADES, STEPS, RATE, DECAY = 3, 150, 0.3, 1e-4
#: Texts whose n-grams the driver holds at a time.
AT_ONCE = 64


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 4-gram that starts at each byte; which of them lie within one text."""
    x = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    gram = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    bucket = ((gram * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
    bucket[bucket == BUCKETS - 1] = 0
    inside = np.ones(len(data), bool)
    for k in (1, 2, 3):
        cut = offsets[1:] - k
        inside[cut[cut >= offsets[:-1]]] = False
    return bucket, inside


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values of each text; 0 for an empty one."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of the words of each text that equal the word before."""
    space = data <= 32
    begin = ~space
    begin[1:] &= space[:-1]
    begin[offsets[:-1][offsets[:-1] < len(data)]] |= ~space[offsets[:-1][offsets[:-1] < len(data)]]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.zeros(len(offsets) - 1)
    mixed = np.where(space, np.uint64(0), data.astype(np.uint64) + np.uint64(1))
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(at.astype(np.uint64), np.diff(np.append(at, len(data)))) if at[0] == 0 else None
    if place is None:
        run = np.diff(np.append(at, len(data)))
        place = np.concatenate([np.zeros(at[0], np.uint64), np.arange(at[0], len(data), dtype=np.uint64) - np.repeat(at.astype(np.uint64), run)])
    word = np.add.reduceat(mixed * (place * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)), at)
    doc = np.searchsorted(offsets, at, "right") - 1
    same = np.concatenate([[False], (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])])
    words = np.bincount(doc, minlength=len(offsets) - 1)
    return np.bincount(doc, same, len(offsets) - 1) / np.maximum(words, 10)


def features(texts: pa.Array) -> np.ndarray:
    """Dense feature rows (for training), made of a few texts at a time."""
    x = np.zeros((len(texts), BUCKETS), np.float32)
    for at in range(0, len(texts), AT_ONCE):
        data, offsets = text_bytes(texts.slice(at, AT_ONCE))
        bucket, inside = _grams(data, offsets)
        for k, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), at):
            own = np.bincount(bucket[begin:end][inside[begin:end]], minlength=BUCKETS)
            x[k] = own / (own.sum() + SMOOTH)
        x[at : at + AT_ONCE, -1] = _repeats(data, offsets)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights and thresholds of the cumulative-link regression."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def line(self, texts: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(texts)
        bucket, inside = _grams(data, offsets)
        grams = _sums(inside, offsets) + SMOOTH
        return _sums(self.weights[bucket] * inside, offsets) / grams + self.weights[-1] * _repeats(data, offsets)

    def tails(self, line: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return _sigmoid(line[:, None] - self.thresholds)


def fit(x: np.ndarray, grade: np.ndarray, grades: int = GRADES) -> Model:
    """Maximum likelihood by Adam over all rows; thresholds stay ordered as sums of positive gaps."""
    n = len(grade)
    if not n:
        return Model(np.zeros(BUCKETS), np.full(grades - 1, -40.0))
    share = np.clip([(grade <= k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    gaps = np.concatenate([[first[0]], np.log(np.maximum(np.diff(first), 0.1))])
    parts = [np.zeros(x.shape[1]), gaps]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
    for step in range(1, STEPS + 1):
        w, g = parts
        th = np.concatenate([[-np.inf], np.cumsum(np.concatenate([g[:1], np.exp(g[1:])])), [np.inf]])
        f = x @ w.astype(np.float32)
        hi, lo = _sigmoid(th[grade + 1] - f), _sigmoid(th[grade] - f)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p / n, lo * (1 - lo) / p / n  # d log p by each end
        df = -(dhi - dlo)
        dth = np.zeros(grades + 1)
        np.add.at(dth, grade + 1, dhi)
        np.add.at(dth, grade, -dlo)
        dth = dth[1:-1]
        up = np.cumsum(dth[::-1])[::-1]
        grads = [-(x.T @ df.astype(np.float32)) + DECAY * w / 100, -np.concatenate([up[:1], up[1:] * np.exp(g[1:])])]
        for k, grad in enumerate(grads):
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            parts[k] = parts[k] - RATE * (10 if k == 0 else 0.1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, g = parts
    return Model(w, np.cumsum(np.concatenate([g[:1], np.exp(g[1:])])))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Model from the labelled rows whose ids have the least hashes."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rated = labels.where("doc_id is not null and (quality = 0 or quality = 1 and toxic in (0, 1))").select("doc_id", grade.alias("grade"))
    drawn = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .where(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(drawn), "doc_id")  # at most `sample` rows of two numbers
        .groupBy("doc_id", "grade")
        .agg(F.min("text").alias("text"))  # ids that repeat count once
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("grade", "ascending")])
        .combine_chunks()
    )
    if not rows.num_rows:
        return fit(np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64))
    texts = rows["text"].combine_chunks() if isinstance(rows["text"], pa.ChunkedArray) else rows["text"]
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    return fit(features(texts.cast(pa.string())), rows["grade"].to_numpy().astype(np.int64))


SCORES = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability = P(grade >= 1), kept = tail_probability >= cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in read_slices(batches):
            tails = model.tails(model.line(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(tails.sum(1)), pa.array(tails[:, 0])], names=["doc_id", "expected_grade", "tail_probability"])

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    out = rows.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), *SCORES.fields]))
    return out.withColumn("kept", F.col("tail_probability") >= cut)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose tail probability is at least `cut`."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = names.index(text_col)
        for batch in batches:
            texts = batch.column(k).fill_null("")
            places = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], names=["at", "text"])
            good = [np.zeros(0, np.int64)]
            for at, part in read_slices([places]):
                good.append(at.to_numpy()[model.tails(model.line(part))[:, 0] >= cut])
            yield batch.take(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)
