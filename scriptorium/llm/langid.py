"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of WINDOW bytes that cover the whole text, labels
every position with a probability of each language, and a text's probabilities are the means
over all its positions.  It is trained in numpy by back-propagation through time, on windows
of a bounded sample of texts whose language is known.

Edge cases: a null text, or one without a letter, is `und` with score 0; with no known
language to learn from, all are `und`; null ids and repeated rows are predicted like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_slices, text_bytes, unit

#: Size of the state of each direction, bytes of a window, windows run side by side.
STATE, WINDOW, ABREAST = 8, 128, 4096
#: Bounds on the training sample: texts a language, bytes of each, bytes of a training window.
TEXTS, SLICE, TRAIN_WINDOW = 400, 240, 48
BATCH, STEPS, RATE, SEED = 192, 160, 0.03, 7
UND = "und"


class Network:
    """Byte embeddings already multiplied by the input weights, two gated units, one linear layer.

    Gate rows are ordered update, reset, candidate.  Arrays are (rows, windows).
    """

    NAMES = ("inputs", "recurrent", "bias", "read")

    def __init__(self, langs: list[str], state: int = STATE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n, self.langs = state, list(langs)
        self.inputs = rng.normal(0, 0.3, (2, 3 * n, 256)).astype(np.float32)
        self.recurrent = rng.normal(0, 1 / np.sqrt(n), (2, 3 * n, n)).astype(np.float32)
        self.bias = np.zeros((2, n, 1), np.float32)  # of the candidate's recurrent part
        self.read = rng.normal(0, 0.3, (2, len(langs), n)).astype(np.float32)

    def _cell(self, way: int, h: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, ...]:
        n = h.shape[0]
        x = np.take(self.inputs[way], byte, axis=1, mode="clip")
        u = self.recurrent[way] @ h
        gates = x[: 2 * n]
        gates += u[: 2 * n]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:n], gates[n:]
        inner = u[2 * n :]
        inner += self.bias[way]
        c = x[2 * n :]
        c += r * inner
        np.tanh(c, out=c)
        return c + z * (h - c), z, r, c, inner

    def label(self, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums over the positions of each window of the language probabilities, (langs, windows)."""
        steps, b = windows.shape
        n = self.recurrent.shape[2]
        forward = np.empty((steps, len(self.langs), b), np.float32)
        h = np.zeros((n, b), np.float32)
        for t in range(steps):
            h = self._cell(0, h, windows[t])[0]
            forward[t] = self.read[0] @ h
        total, h = np.zeros((len(self.langs), b), np.float32), np.zeros((n, b), np.float32)
        shortest = sizes.min() if b else 0
        for t in range(steps - 1, -1, -1):
            h = self._cell(1, h, windows[t])[0]
            if t >= shortest:
                h *= t < sizes
            p = forward[t]
            p += self.read[1] @ h
            np.exp(np.minimum(p, 30, out=p), out=p)
            p /= p.sum(0)
            if t >= shortest:
                p *= t < sizes
            total += p
        return total

    def _gradients(self, windows: np.ndarray, lang: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy of all positions."""
        steps, b = windows.shape
        n = self.recurrent.shape[2]
        kept: list[list] = [[None] * steps, [None] * steps]
        states = np.zeros((2, steps, n, b), np.float32)
        order = (range(steps), range(steps - 1, -1, -1))
        for way in (0, 1):
            h = np.zeros((n, b), np.float32)
            for t in order[way]:
                new, *rest = self._cell(way, h, windows[t])
                kept[way][t] = (h, *rest)
                states[way, t] = h = new
        logits = np.einsum("wln,wtnb->tlb", self.read, states, optimize=True)
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[:, lang, np.arange(b)] -= 1
        p /= steps * b
        g = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        g["read"] = np.einsum("tlb,wtnb->wln", p, states, optimize=True)
        for way in (0, 1):
            carry = np.zeros((n, b), np.float32)
            for t in reversed(order[way]):
                h, z, r, c, inner = kept[way][t]
                d = carry + self.read[way].T @ p[t]
                dc = d * (1 - z) * (1 - c * c)
                dz = d * (h - c) * z * (1 - z)
                dr = dc * inner * r * (1 - r)
                gates = np.concatenate([dz, dr, dc])
                du = np.concatenate([dz, dr, dc * r])
                g["recurrent"][way] += du @ h.T
                g["bias"][way] += (dc * r).sum(1, keepdims=True)
                hot = np.zeros((256, b), np.float32)
                hot[windows[t], np.arange(b)] = 1
                g["inputs"][way] += gates @ hot.T
                carry = d * z + self.recurrent[way].T @ du
        return g

    def fit(self, texts: list[bytes], langs: np.ndarray) -> Network:
        """Adam on windows drawn evenly from the languages."""
        rng = np.random.default_rng(SEED)
        by = [np.flatnonzero(langs == k) for k in range(len(self.langs))]
        m = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in self.NAMES}
        for step in range(1, STEPS + 1):
            lang = rng.integers(len(by), size=BATCH)
            picked = [texts[by[k][rng.integers(len(by[k]))]] for k in lang]
            rows = []
            for x in picked:
                at = rng.integers(max(1, len(x) - TRAIN_WINDOW + 1))
                x = x[at : at + TRAIN_WINDOW]
                rows.append(np.frombuffer((x * (TRAIN_WINDOW // len(x) + 1))[:TRAIN_WINDOW], np.uint8))
            g = self._gradients(np.array(rows).T.astype(np.intp), lang)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v / max(1.0, norm)
                first, second = m[k]
                first += 0.1 * (v - first)
                second += 0.01 * (v * v - second)
                setattr(self, k, getattr(self, k) - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7))
        return self

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Mean probabilities of the languages over all positions of each text, (texts, langs)."""
        data, offsets = text_bytes(texts)
        size = np.diff(offsets)
        many = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), many)
        start = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
        sizes = np.minimum(offsets[doc + 1] - start, WINDOW)
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        total = np.zeros((len(size), len(self.langs)))
        for k in range(0, len(doc), ABREAST):
            part = slice(k, k + ABREAST)
            windows = padded[start[part][None, :] + np.arange(WINDOW)[:, None]].astype(np.intp)
            np.add.at(total, doc[part], self.label(windows, sizes[part]).T)
        return total / np.maximum(size, 1)[:, None]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Network:
    """Network from a sample: at most TEXTS texts of each language, chosen by the hash of the id, SLICE characters of each.

    The bytes are taken at a place that depends on the id, so not only beginnings are seen.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), text.alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    at = F.pmod(F.col("h"), F.greatest(F.char_length("text") - SLICE, F.lit(1))).cast("int") + 1
    rows = rows.select("lang", "h", F.substring("text", at, F.lit(SLICE)).alias("text"))
    known = {x.lang: x.n for x in docs.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect() if x.lang is not None}
    rates = F.create_map(*[F.lit(v) for lang, n in known.items() for v in (lang, min(1.0, 1.5 * TEXTS / n))]) if known else None
    drawn = rows.where(unit(F.col("h")) < rates[F.col("lang")]).select("lang", "h", "text").limit(2 * TEXTS * len(known)).collect() if known else []
    drawn = sorted((x.lang, x.h, x.text) for x in drawn)
    drawn = [(lang, text) for k, (lang, _, text) in enumerate(drawn) if k < TEXTS or drawn[k - TEXTS][0] != lang]
    langs = sorted({lang for lang, _ in drawn})
    if not langs:
        return Network([])
    names = np.array([langs.index(x) for x, _ in drawn])
    return Network(langs).fit([t.encode() for _, t in drawn], names)


def identify(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*network.langs, UND], object)
        for ids, texts in read_slices(batches):
            if network.langs:
                p = network.probabilities(texts)
                best, top = p.argmax(1), p.max(1)
            else:
                best, top = np.zeros(len(ids), int), np.zeros(len(ids))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names[best], pa.string()), pa.array(np.clip(top, 0, 1).astype(float))], names=["doc_id", "lang_pred", "score"])

    letters = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).otherwise("")
    kind = docs.schema[id_col].dataType
    out = docs.select(F.col(id_col).alias("doc_id"), letters.alias("text")).mapInArrow(
        run, T.StructType([T.StructField("doc_id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    )
    und = F.col("score") == 0
    return out.select("doc_id", F.when(und, UND).otherwise(F.col("lang_pred")).alias("lang_pred"), "score")
