"""Raster kernels: numpy functions on one image (2-D uint8, row-major) or a stack of them.

They hold what column expressions cannot: convolution, resampling, components, descriptors.
"""

from __future__ import annotations

from math import floor

import numpy as np

from .. import config


def half_up(x):
    """Round half toward plus infinity."""
    return np.floor(np.asarray(x, np.float64) + 0.5)


def grayscale(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.float64) for k in range(3))
    return half_up(0.299 * r + 0.587 * g + 0.114 * b).astype(np.uint8)


def stretch(img: np.ndarray) -> np.ndarray:
    lo, hi = int(img.min()), int(img.max())
    if lo == hi:
        return img.copy()
    return half_up(np.clip(np.arange(256.0) - lo, 0, hi - lo) / (hi - lo) * 255).astype(np.uint8)[img]


def gaussian_weights(sigma: float = 1.0) -> np.ndarray:
    d = np.arange(-1, 2)
    w = np.exp(-(d[:, None] ** 2 + d[None, :] ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def blur(img: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    w, p = gaussian_weights(sigma), np.pad(img.astype(np.float64), 1, mode="edge")
    h, v = img.shape
    total, part = np.zeros(img.shape), np.empty(img.shape)
    for dy in range(3):  # row-major order of the sum
        for dx in range(3):
            total += np.multiply(p[dy : dy + h, dx : dx + v], w[dy, dx], out=part)
    total += 0.5
    return np.clip(np.floor(total, out=total), 0, 255, out=total).astype(np.uint8)


def median(img: np.ndarray, size: int = 3) -> np.ndarray:
    r = size // 2
    p = np.pad(img, r, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(p, (size, size)).reshape(*img.shape, -1)
    return np.sort(windows, axis=-1)[..., size * size // 2]


def otsu_threshold(img: np.ndarray) -> int:
    counts = np.bincount(img.ravel(), minlength=256).astype(np.int64)
    n, total = counts.sum(), (counts * np.arange(256)).sum()
    w0 = np.concatenate([[0], np.cumsum(counts)[:-1]])  # strictly below t
    s0 = np.concatenate([[0], np.cumsum(counts * np.arange(256))[:-1]])
    w1, s1 = n - w0, total - s0
    ok = (w0 > 0) & (w1 > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where(ok, w0 / n * (w1 / n) * (s0 / w0 - s1 / w1) ** 2, 0)
    if between.max() <= 0:
        return 128
    best = np.flatnonzero(between == between.max())
    return int(half_up((best[0] + best[-1]) / 2))


def binarize(img: np.ndarray, multiplier: float = 1.0) -> np.ndarray:
    return np.where(img >= otsu_threshold(img) * multiplier, 255, 0).astype(np.uint8)


def text_as_foreground(binary: np.ndarray) -> np.ndarray:
    return 255 - binary if (binary == 255).sum() * 2 > binary.size else binary


def resample(img: np.ndarray, sx: np.ndarray, sy: np.ndarray, background: int = 255) -> np.ndarray:
    """Value of the source pixel nearest to (sx, sy) for each output pixel."""
    h, w = img.shape
    x, y = half_up(sx).astype(np.int64), half_up(sy).astype(np.int64)
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    return np.where(inside, img[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)], background).astype(np.uint8)


def _grid(img: np.ndarray):
    h, w = img.shape
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    return x, y, w / 2, h / 2


def rotate(img: np.ndarray, degrees: float, background: int = 255) -> np.ndarray:
    x, y, cx, cy = _grid(img)
    a = -degrees * np.pi / 180
    c, s = np.cos(a), np.sin(a)
    return resample(img, cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c, background)


def scale(img: np.ndarray, factor: float, background: int = 255) -> np.ndarray:
    x, y, cx, cy = _grid(img)
    return resample(img, cx + (x - cx) / factor, cy + (y - cy) / factor, background)


def skew(img: np.ndarray, dx: float, dy: float, background: int = 255) -> np.ndarray:
    x, y, cx, cy = _grid(img)
    return resample(img, x - dx * ((y - cy) / cy), y - dy * ((x - cx) / cx), background)


def salt_pepper(img: np.ndarray, p: float, rng: np.random.Generator) -> np.ndarray:
    return np.where(rng.random(img.shape) < p, 255 - img, img).astype(np.uint8)


def crop_foreground(binary: np.ndarray) -> np.ndarray:
    y, x = np.nonzero(binary == 255)
    if not len(x):
        return np.zeros((1, 1), np.uint8)
    return np.where(binary == 255, 255, 0).astype(np.uint8)[y.min() : y.max() + 1, x.min() : x.max() + 1]


def fit_square(img: np.ndarray, size: int = config.CHAR_SIZE) -> np.ndarray:
    """Nearest resize that keeps the aspect, centred on black."""
    h, w = img.shape
    ratio = w / h
    nw = max(1, size if ratio >= 1 else floor(size * ratio + 0.5))
    nh = max(1, floor(size / ratio + 0.5) if ratio >= 1 else size)
    sy, sx = np.minimum(h - 1, np.arange(nh) * h // nh), np.minimum(w - 1, np.arange(nw) * w // nw)
    out = np.zeros((size, size), np.uint8)
    oy, ox = (size - nh) // 2, (size - nw) // 2
    out[oy : oy + nh, ox : ox + nw] = img[sy[:, None], sx]
    return out


def components(binary: np.ndarray) -> np.ndarray:
    """Labels of the 8-connected components of value 255, numbered in raster order; -1 is background.

    Runs of each row are joined to touching runs of the row above: the larger of two roots is hung
    below the smaller one, for all pairs at once, until no pair has two roots.
    """
    h, w = binary.shape
    out = np.full((h, w), -1, np.int64)
    on = np.zeros((h, w + 2), np.int8)
    on[:, 1:-1] = binary == 255
    edge = np.diff(on, axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    if not len(row):
        return out
    above = (row - 1) * (w + 2)  # places of the row above, in one order over all rows
    first = np.searchsorted(row * (w + 2) + end, above + start)
    count = np.maximum(np.searchsorted(row * (w + 2) + start, above + end, "right") - first, 0)
    q = np.repeat(np.arange(len(row)), count)
    p = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + first[q]
    root = np.arange(len(row))
    while len(p):
        a, b = root[p], root[q]
        two = a != b
        p, q, a, b = p[two], q[two], a[two], b[two]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    ids = np.unique(root, return_inverse=True)[1]
    out[binary == 255] = np.repeat(ids, end - start)
    return out


def runs(counts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of positions whose count is at least `least`, both ends included."""
    edge = np.diff(np.concatenate([[0], (counts >= least).astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def _slopes(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences across each pixel of an image or a stack, to the right and down."""
    p = np.pad(img.astype(np.int16), [(0, 0)] * (img.ndim - 2) + [(1, 1)] * 2, mode="edge")
    return p[..., 1:-1, 2:] - p[..., 1:-1, :-2], p[..., 2:, 1:-1] - p[..., :-2, 1:-1]


def _polar(gx: np.ndarray, gy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gx, gy = gx.astype(np.float64), gy.astype(np.float64)
    angle = np.arctan2(gy, gx) * 180 / np.pi
    return np.sqrt(gx * gx + gy * gy), np.where(angle < 0, angle + 180, angle)


def gradient(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude and angle in degrees in [0, 180]."""
    return _polar(*_slopes(img))


def hogs(stack: np.ndarray, cols: int = config.HOG_GRID_COLS, rows: int = config.HOG_GRID_ROWS, bins: int = config.HOG_BINS, eps: float = config.HOG_EPSILON) -> np.ndarray:
    """Descriptors, of cols * rows * bins numbers each, of images of one size; sums are single
    precision, row-major in a region."""
    n, h, w = stack.shape
    gx, gy = _slopes(stack)
    steep = np.flatnonzero(gx | gy)  # the others add nothing
    magnitude, angle = _polar(gx.ravel()[steep], gy.ravel()[steep])
    which = half_up(angle / (180 / bins)).astype(np.int64) % bins
    region = lambda k, size: np.searchsorted([i * size // k for i in range(1, k)], np.arange(size), "right")
    place = (region(rows, h)[:, None] * cols + region(cols, w)).ravel()
    which += (place[steep % (h * w)] + steep // (h * w) * (rows * cols)) * bins
    sums = np.zeros(n * rows * cols * bins, np.float32)
    np.add.at(sums, which, magnitude.astype(np.float32))
    v = sums.astype(np.float64).reshape(n, rows * cols, bins)
    return (v / np.sqrt((v * v).sum(-1, keepdims=True) + eps * eps)).astype(np.float32).reshape(n, -1)


def hog(img: np.ndarray, cols: int = config.HOG_GRID_COLS, rows: int = config.HOG_GRID_ROWS, bins: int = config.HOG_BINS, eps: float = config.HOG_EPSILON) -> np.ndarray:
    """Descriptor of one image."""
    return hogs(img[None], cols, rows, bins, eps)[0]


#: Queries and samples that are compared at a time, and pairs whose distances are computed anew.
TILE_QUERIES, TILE_SAMPLES, TILE_PAIRS = 256, 4_096, 16_384


def unfound(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest of n queries before any sample is seen."""
    return np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.inf)


def improve(ids: np.ndarray, best: np.ndarray, q: np.ndarray, x: np.ndarray, names: np.ndarray) -> None:
    """Puts the samples `x`, named `names`, among the k nearest so far (`unfound`) of each query, lower name first in a tie.

    A matrix product narrows a tile of queries and samples to a superset; the distances of that are
    computed anew in double precision, so order and ties are those of the plain scan.  However many
    samples there are, one tile of distances is held.
    """
    k = ids.shape[1]
    for at in range(0, len(q), TILE_QUERIES):
        to = slice(at, at + TILE_QUERIES)
        part, known, far = q[to].astype(np.float64), ids[to], best[to]
        own = (part * part).sum(1)
        for low in range(0, len(x), TILE_SAMPLES):
            tile, tile_names = x[low : low + TILE_SAMPLES].astype(np.float64), names[low : low + TILE_SAMPLES]
            d2 = own[:, None] + (tile * tile).sum(1) - 2 * part @ tile.T
            limit = far[:, -1] ** 2 + 1e-6 * (1 + own)
            close = d2 <= limit[:, None]
            if len(tile) > k and close.sum() > 4 * k * len(part):
                close &= d2 <= (np.partition(d2, k - 1, axis=1)[:, k - 1] + 1e-6 * (1 + own))[:, None]
            row, near = np.nonzero(close)
            if not len(row):
                continue
            d = np.empty(len(row))
            for i in range(0, len(row), TILE_PAIRS):
                pair = slice(i, i + TILE_PAIRS)
                diff = part[row[pair]] - tile[near[pair]]
                d[pair] = np.sqrt(np.add.accumulate(diff * diff, axis=1)[:, -1])
            rows = np.unique(row)
            d, name = np.concatenate([far[rows].ravel(), d]), np.concatenate([known[rows].ravel(), tile_names[near]])
            row = np.concatenate([np.repeat(rows, k), row])
            order = np.lexsort((name, d, row))
            order = order[np.searchsorted(row[order], rows)[:, None] + np.arange(k)]
            known[rows], far[rows] = name[order], d[order]


class Neighbours:
    """k nearest of a fixed set of descriptors, and the weighted vote of their labels; order and ties
    are those of the plain scan (lower index first)."""

    def __init__(self, descriptors: np.ndarray, labels: list[str], k: int = config.KNN_K, eps: float = config.KNN_EPSILON):
        if not len(descriptors):
            raise ValueError("the model has no samples")
        if len(descriptors) != len(labels):
            raise ValueError("as many labels as descriptors are needed")
        self.x, self.labels, self.k, self.eps = np.asarray(descriptors, np.float32), labels, k, eps

    def nearest(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        q = np.asarray(q, np.float32)
        if q.shape[1] != self.x.shape[1]:
            raise ValueError("descriptors differ in length")
        ids, best = unfound(len(q), min(self.k, len(self.x)))
        improve(ids, best, q, self.x, np.arange(len(self.x)))
        return list(zip(ids, best, strict=True))

    def predict(self, q: np.ndarray) -> list[tuple[str, float, list[float], list[tuple[str, float]]]]:
        """Label, confidence, distances, and all labels with their shares, for each query."""
        out = []
        for ids, d in self.nearest(q):
            votes: dict[str, float] = {}
            for i, v in zip(ids.tolist(), d.tolist(), strict=True):
                votes[self.labels[i]] = votes.get(self.labels[i], 0.0) + 1 / (v + self.eps)
            whole = sum(votes.values())
            ranked = sorted(votes.items(), key=lambda t: -t[1])
            out.append((ranked[0][0], ranked[0][1] / whole, d.tolist(), [(n, w / whole) for n, w in ranked]))
        return out


def preprocess(gray: np.ndarray) -> np.ndarray:
    return text_as_foreground(binarize(blur(stretch(gray))))


def characters(binary: np.ndarray, line_least: int = config.HORIZONTAL_VALLEY_THRESHOLD, word_least: int = config.VERTICAL_VALLEY_THRESHOLD, low: int = config.CHAR_MIN_HEIGHT, high: int = config.CHAR_MAX_HEIGHT) -> list[dict]:
    """Characters in reading order: line, word, box and own pixels.

    A component belongs to every line and word whose range it overlaps; word ranges count the
    pixels of a line's components in all rows.
    """
    label = components(binary)
    n = int(label.max()) + 1
    if not n:
        return []
    at = np.flatnonzero(binary == 255)
    y, x = np.divmod(at, binary.shape[1])
    own = label.ravel()[at]
    order = np.argsort(own, kind="stable")
    y, x, own = y[order], x[order], own[order]
    cut = np.searchsorted(own, np.arange(n + 1))
    x0, x1 = np.minimum.reduceat(x, cut[:-1]), np.maximum.reduceat(x, cut[:-1])
    y0, y1 = np.minimum.reduceat(y, cut[:-1]), np.maximum.reduceat(y, cut[:-1])
    out = []
    for line, (top, bottom) in enumerate(runs((binary == 255).sum(1), line_least)):
        members = np.flatnonzero((y0 <= bottom) & (y1 >= top))
        columns = np.zeros(binary.shape[1], np.int64)
        for c in members:
            columns += np.bincount(x[cut[c] : cut[c + 1]], minlength=len(columns))
        for word, (left, right) in enumerate(runs(columns, word_least)):
            inside = [c for c in members if x0[c] <= right and x1[c] >= left and low <= y1[c] - y0[c] + 1 <= high]
            for c in sorted(inside, key=lambda c: (x0[c], c)):
                part = np.s_[cut[c] : cut[c + 1]]
                raster = np.zeros((y1[c] - y0[c] + 1, x1[c] - x0[c] + 1), np.uint8)
                raster[y[part] - y0[c], x[part] - x0[c]] = 255
                out.append({"line": line, "word": word, "top": top, "bottom": bottom, "left": left, "right": right, "component": int(c), "x": int(x0[c]), "y": int(y0[c]), "raster": raster})
    return out
