"""Toxicity by a support vector machine with a subsequence string kernel and Nystroem landmarks.

The kernel of two strings counts their common subsequences of ORDER characters, each weighted
by DECAY to the power of the lengths that it spans in both, and is normalised; so an insult
with gaps or inserted characters still resembles the plain one.  LANDMARKS strings, words that are
much more frequent in toxic texts than in clean ones and clean words that are like them, give every unit of text (a word, or a run of one-letter words) its
Nystroem features.  The machine is trained on sentences, each by its strongest unit: those of
clean texts are negative; of a toxic text's sentences the strongest is positive, and those beyond
the margin.  The strongest units are chosen anew by the machine of each round.  A text's score is a logistic function of its largest
margin and of how many units lie beyond the margin.

Learning is bounded: at most SAMPLE labelled texts of at most SAMPLE_BYTES bytes.  All texts
are scored whole; each distinct unit is scored once and cached by its task.

Edge cases: null and empty texts have the score of a text without units; null labels are not
learned from; without labels of both kinds all scores are 0; repeated rows get equal scores; very
long texts are scored whole; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_slices

ORDER, DECAY = 3, 0.6
LANDMARKS, CLEAN_LANDMARKS = 28, 28
SAMPLE, SAMPLE_BYTES = 5_000, 16_384
#: Longer units are scored in overlapping parts of UNIT characters.
UNIT, OVERLAP = 24, 8
#: Stands before the first character of a unit, so that beginnings resemble beginnings.
START = "\x02"
CACHE = 600_000
#: Frequent clean words among which landmarks are sought; rounds of training; cost that equal sentence
#: rows have at most; margin that a toxic text's strongest sentence needs to be positive; ridge.
#: Chosen by three-fold cross-validation on learning rows.
COMMON, ROUNDS, MOST_EQUAL, WITNESS, RIDGE = 4_000, 4, 100, 0.0, 0.1
PUNCTUATION = r"[!-/:-@\[-`{-~]+"
SENTENCE = re.compile(r"[.!?\n]+\s+|\n")
THRESHOLD = 0.3


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.int32)
    for k, w in enumerate(words):
        points = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)[:width]
        out[k, : len(points)] = points
    return out


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """Gap-weighted subsequence kernel of order ORDER, (words, others), not normalised.

    Reads the words character by character, all pairs at once; `level[p]` holds, for every place
    in the other string, the weight of common subsequences of p + 1 characters before it.
    """
    if not words or not others:
        return np.zeros((len(words), len(others)))
    width, many = max(map(len, others)), len(others)
    b = _codes(others, width).T[:, None, :]  # (place, 1, other)
    out = np.zeros((len(words), many))
    order, decay = np.argsort([len(w) for w in words], kind="stable"), np.float32(DECAY)
    for at in range(0, len(words), 128):
        pick = order[at : at + 128]
        a = _codes([words[k] for k in pick], max(len(words[k]) for k in pick) or 1)
        shape = (width, len(pick), many)
        level = np.zeros((ORDER - 1, *shape), np.float32)
        total, ahead = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
        for t in range(a.shape[1]):
            c = a[None, :, t, None]
            match = ((c == b) & (c != 0)).astype(np.float32)
            match *= decay * decay
            total += match * level[-1]
            for p in range(ORDER - 2, -1, -1):
                found = match * level[p - 1] if p else match
                for j in range(1, width):  # decayed over the places of the other string
                    np.multiply(ahead[j - 1], decay, out=ahead[j])
                    ahead[j] += found[j - 1]
                level[p] *= decay
                level[p] += ahead
        out[pick] = total.sum(0)
    return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points) of the words of each length, in slices of bounded size."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size[size > 0]).tolist():
        same, most = np.flatnonzero(size == n), max(16, (1 << 21) // max(n * n, math.comb(n, ORDER)))
        for at in range(0, len(same), most):
            places = same[at : at + most]
            points = "".join([words[k] for k in places.tolist()]).encode("utf-32-le", "surrogatepass")
            yield places, np.frombuffer(points, np.uint32).reshape(-1, n)


def _own(words: list[str]) -> np.ndarray:
    """Square roots of the kernel of each word with itself."""
    out = np.zeros(len(words))
    for places, codes in _by_length(words):
        out[places] = _self_kernel(codes)
    return np.sqrt(np.maximum(out, 1e-12))


def _self_kernel(a: np.ndarray) -> np.ndarray:
    """Kernel of each word with itself, for the code points of words of one length."""
    n = a.shape[1]
    match = ((a[:, :, None] == a[:, None, :]) & (a[:, :, None] != 0)) * DECAY**2
    gap = np.tril(DECAY ** np.maximum(np.arange(n)[:, None] - np.arange(n)[None, :] - 1, 0), -1)
    found = match
    for _ in range(ORDER - 1):
        # All factors are symmetric, so two products of flat tables give gap @ found @ gap.T.
        half = (found.reshape(-1, n) @ gap.T).reshape(-1, n, n).transpose(0, 2, 1)
        found = match * (half.reshape(-1, n) @ gap.T).reshape(-1, n, n)
    return found.sum((1, 2))


@lru_cache(maxsize=None)  # one entry for each length, at most UNIT + 1
def _triples(n: int) -> tuple[np.ndarray, ...]:
    """First and second places of all pairs in n places; pair, third place and weight of all triples."""
    first, second = np.triu_indices(n, 1)
    pair, third = np.nonzero(second[:, None] < np.arange(n)[None, :])
    return first, second, pair, third, DECAY ** (third - first[pair] + 1.0)


def parts_of(unit: str) -> list[str]:
    """The unit with START before it; a long one in overlapping parts."""
    if len(unit) <= UNIT:
        return [START + unit]
    return [("" if c else START) + unit[c : c + UNIT] for c in range(0, len(unit) - OVERLAP, UNIT - OVERLAP)]


class Expansion:
    """The sum of weighted kernels with the landmarks, as weights of subsequences.

    The kernel is a sum over subsequences of three characters (ORDER), so a weighted sum of
    kernels is linear in the subsequences of the other string: no landmark is visited again.
    """

    def __init__(self, landmarks: list[str], weights: np.ndarray):
        points = np.frombuffer("".join(landmarks).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet = np.unique(points[points > 0])
        self.letters = len(self.alphabet) + 1  # 0 stands for all other characters
        keys, thirds, values = [], [], []
        for places, codes in _by_length(landmarks):
            a = self.numbers(codes)
            first, second, pair, third, decay = _triples(a.shape[1])
            known = (a[:, first][:, pair] > 0) & (a[:, second][:, pair] > 0) & (a[:, third] > 0)
            keys.append((a[:, first] * self.letters + a[:, second])[:, pair][known])
            thirds.append(a[:, third][known])
            values.append((weights[places][:, None] * decay)[known])
        keys, thirds, values = (np.concatenate(v) if v else np.zeros(0, int) for v in (keys, thirds, values))
        pairs, pair = np.unique(keys, return_inverse=True)
        self.pair = np.zeros(self.letters**2, np.int32)
        self.pair[pairs] = np.arange(1, len(pairs) + 1)
        self.value = np.bincount((pair + 1) * self.letters + thirds, values, (len(pairs) + 1) * self.letters)

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of code points in the alphabet of the landmarks."""
        if not len(self.alphabet):
            return np.zeros(codes.shape, np.int32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0).astype(np.int32)

    def normalised(self, words: list[str]) -> np.ndarray:
        """The weighted sum of each word, divided by the word's own length in the kernel's space."""
        out = np.zeros(len(words))
        for places, codes in _by_length(words):
            if codes.shape[1] < ORDER:
                continue
            a = self.numbers(codes)
            first, second, pair, third, decay = _triples(a.shape[1])
            row = self.pair[a[:, first] * self.letters + a[:, second]] * self.letters
            total = self.value[row[:, pair] + a[:, third]] @ decay
            out[places] = total / np.sqrt(np.maximum(_self_kernel(codes), 1e-12))
        return out


class Model:
    """Landmarks, the weights of their normalised kernels, and the logistic function of a text."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float):
        self.landmarks, self.weights, self.bias = landmarks, weights, bias
        self.expansion = Expansion(landmarks, weights / _own(landmarks))
        self.final, self.known = np.zeros(4), {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def margins(self, units: list[str]) -> np.ndarray:
        """Margin of each unit; a long one has that of its strongest part."""
        own = [parts_of(u) for u in units]
        parts, of = [p for ps in own for p in ps], np.repeat(np.arange(len(units)), [len(ps) for ps in own])
        out = np.full(len(units), -np.inf)
        np.maximum.at(out, of, self.expansion.normalised(parts) + self.bias)
        return out

    def of(self, units: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        new = [u for u in units if u not in self.known]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self.known.update(zip(part, self.margins(part).tolist(), strict=True))
        return np.array([self.known[u] for u in units])

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Per text: 1, largest margin, log of 1 + units beyond the margin (5 at most), log of their share."""
        flat, doc = units_of(texts)
        n = len(texts)
        coded = flat.dictionary_encode()
        margin = self.of(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0)
        top = np.full(n, -2.0)
        np.maximum.at(top, doc, margin)
        beyond, many = np.bincount(doc, margin > 0, n), np.bincount(doc, minlength=n)
        share = np.log((beyond + 0.05) / (many + 20))
        return np.stack([np.ones(n), np.clip(top, -1, 1), np.log1p(np.minimum(beyond, 5)), share + 5], 1)

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.landmarks:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts) @ self.final, -30, 30)))


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All units, one after the other, and the text of each.

    Units are the lower-cased words without ASCII punctuation, and in addition each run of three
    or more one-character words, joined.
    """
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten().dictionary_encode()
    words = pc.replace_substring_regex(flat.dictionary, pattern=PUNCTUATION, replacement="").cast(pa.string())
    codes = flat.indices.to_numpy(zero_copy_only=False)
    single = (pc.utf8_length(words).to_numpy(zero_copy_only=False) == 1)[codes] if len(codes) else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    runs, run_doc = [], []
    for b, e in zip(begin[end - begin >= 3], end[end - begin >= 3], strict=True):
        for k in np.unique(doc[b:e]):
            own = np.flatnonzero(doc[b:e] == k) + b
            if len(own) >= 3:
                runs.append("".join(words.take(pa.array(codes[own])).to_pylist()))
                run_doc.append(k)
    flat = words.take(pa.array(codes)) if len(codes) else pa.array([], pa.string())
    if runs:
        flat, doc = pa.concat_arrays([flat, pa.array(runs, pa.string())]), np.concatenate([doc, run_doc])
    return flat, doc


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps with line search; y in -1, 1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        return float((cost * np.maximum(0, 1 - y * (z @ w)) ** 2).sum() + ridge * w @ w)

    for _ in range(50):
        slack = 1 - y * (z @ w)
        on = slack > 0
        grad = -z[on].T @ (cost[on] * y[on] * slack[on]) + ridge * w
        step = np.linalg.solve((z[on].T * cost[on]) @ z[on] + ridge * np.eye(len(w)), grad)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now - 1e-4 * size * float(grad @ step):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Model from whole labelled texts."""
    if not len(texts) or toxic.min() == toxic.max():
        return Model([], np.zeros(0), 0.0)
    sentences = [(s, k) for k, t in enumerate(texts) for s in SENTENCE.split(t) if s.strip()]
    flat, of = units_of(pa.array([s for s, _ in sentences], pa.string()))
    coded = flat.dictionary_encode()
    distinct, place = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    text = np.array([k for _, k in sentences] or [0])
    owner = text[of]
    # Parts of units stand for them, as they do when texts are scored.
    own_parts = [parts_of(u) for u in distinct]
    seen: dict[str, set] = {}
    beside: dict[str, set] = {}
    for before, u, k in zip([-1, *place.tolist()], place.tolist(), owner, strict=False):
        if len(distinct[u]) >= ORDER:
            for p in own_parts[u]:
                seen.setdefault(p, set()).add(int(k))
                if toxic[k]:
                    beside.setdefault(p, set()).add(before)
    bad = int(toxic.sum())
    good = len(texts) - bad
    weight = {}
    for p, ks in seen.items():
        # In copies of one text a word stands beside the same word; that counts once.
        t = min(sum(toxic[k] for k in ks), len(beside.get(p, ())))
        weight[p] = (t, np.log((t + 0.2) / (bad + 1)) - np.log((sum(1 - toxic[k] for k in ks) + 0.2) / (good + 1)))
    # The words that tell most: often in toxic texts, hardly in clean ones; then all others by their lift.
    plain = {u for u, (t, lift) in weight.items() if t > 2 + 0.01 * bad and lift > 2}
    telling = sorted(plain, key=lambda u: (-weight[u][0] * weight[u][1], u))
    telling += sorted((u for u in weight if u not in plain), key=lambda u: (-weight[u][1], -weight[u][0], u))
    common = sorted((u for u, (t, lift) in weight.items() if lift < 0.5), key=lambda u: (-len(seen[u]), u))[:COMMON]
    if not telling:  # no text has a word of ORDER characters
        telling = ["\x03" * ORDER]
    # Landmarks: the most telling words that are not too like those chosen before.
    telling = telling[: 12 * LANDMARKS]
    own = _own(telling)
    alike = kernel(telling, telling) / own / own[:, None]
    chosen: list[int] = []
    for k in range(len(alike)):
        if len(chosen) < LANDMARKS and (not chosen or alike[k, chosen].max() < 0.6):
            chosen.append(k)
    # And the clean words that are most like them, so that the machine can tell those apart.
    landmarks = [telling[k] for k in chosen]
    likeness = kernel(common, landmarks) / _own(landmarks) / _own(common)[:, None]
    like = [k for rank in np.argsort(-likeness, axis=0)[:2] for k in rank] + np.argsort(-likeness.max(1)).tolist() if common else []
    landmarks += [common[k] for k in list(dict.fromkeys(like))[:CLEAN_LANDMARKS]]
    own = _own(landmarks)
    among = kernel(landmarks, landmarks) / own / own[:, None]
    value, vector = np.linalg.eigh((among + among.T) / 2 + 1e-6 * np.eye(len(landmarks)))
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    parts, part = np.unique([p for ps in own_parts for p in ps] or [START], return_inverse=True)
    parts, many = parts.tolist(), np.array([len(ps) for ps in own_parts], int)
    x = kernel(parts, landmarks)
    x /= own
    x /= _own(parts)[:, None]
    first = np.array([t * lift if lift > 0 else lift for t, lift in (weight.get(p, (0, -9.0)) for p in parts)])
    if len(place):  # each occurrence of a unit is one of each of its parts
        n, begin = many[place], np.cumsum(many) - many
        place = part[np.repeat(begin[place], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        of = np.repeat(of, n)
    del seen, beside, owner, own_parts
    w, b = _sentence_machine(x @ root, place, of, text, toxic, first)
    model = Model(landmarks, root @ w, b)
    model.final = _logistic(model.evidence(pa.array(texts, pa.string())), toxic.astype(float))
    return model


def _sentence_machine(x: np.ndarray, unit: np.ndarray, sentence: np.ndarray, text: np.ndarray, toxic: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the machine whose rows are sentences.

    `x` has the features of each distinct unit; `unit` and `sentence` say which unit each
    occurrence is and where; `text` is the text of each sentence, `toxic` the label of each text.
    A sentence's row is that of its strongest unit: at first by `first`, then by the machine of the
    round before.  Sentences of clean texts are negative.  A toxic text's label says only that some
    sentence of it is toxic: its strongest one is positive, in later rounds if its margin is over
    WITNESS, and so are all that lie beyond the margin.
    """
    w, b, strength = np.zeros(x.shape[1]), 0.0, first
    if not len(unit):
        return w, b
    bad = toxic[text].astype(bool)
    for _ in range(ROUNDS):
        order = np.lexsort((unit, -strength[unit], sentence))
        top = order[np.concatenate([[True], np.diff(sentence[order]) > 0])]
        rows, where = unit[top], sentence[top]  # a row of x for each sentence that has units
        best = np.full(len(toxic), -np.inf)
        np.maximum.at(best, text[where], strength[rows])
        strongest = strength[rows] >= best[text[where]]
        positive = bad[where] & (strongest if strength is first else (strongest & (strength[rows] > WITNESS)) | (strength[rows] > 1))
        used = positive | ~bad[where]
        # Equal sentence rows are one row with a cost.
        key, many = np.unique(rows[used] * 2 + positive[used], return_counts=True)
        y, cost = np.where(key % 2, 1.0, -1.0), np.minimum(many, MOST_EQUAL).astype(float)
        if not (y > 0).any():
            break
        cost[y > 0] *= max(1.0, cost[y < 0].sum() / cost[y > 0].sum())
        w, b = _svm(x[key // 2], y, cost, RIDGE)
        strength = x @ w + b
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Model from at most `sample` labelled rows, those whose ids have the least hashes."""
    rated = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic")
    drawn = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .where(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(drawn), "doc_id")  # at most `sample` rows of two numbers
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))  # ids that repeat count once
        .collect()
    )
    rows = sorted(((r.doc_id, r.toxic, r.text) for r in rows), key=lambda r: (zlib.crc32(str(r[0]).encode()), *r))
    return fit([t for _, _, t in rows], np.array([x for _, x, _ in rows], int))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in read_slices(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.score(texts))], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    out = rows.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
