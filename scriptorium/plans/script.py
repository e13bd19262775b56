"""An invented script, so that pages with known text can be drawn and read.

A character is one connected stroke: a stem with a foot to the left and an arm to the right, which
carry it into the columns of its neighbours without touching them, and short branches at eight
places of the stem, an even number of them, which tell characters apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions import kernels
from ..sources.tables import png

#: The characters that can be written, in order.
CHARACTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz.:#-"
WIDTH, HEIGHT, SPACE, PITCH, MARGIN = 20, 32, 10, 48, 10
PAPER, INK = 230, 20


def glyph(character: str) -> np.ndarray:
    """Ink (True) of a character."""
    code = CHARACTERS.index(character)
    bits = [code >> k & 1 for k in range(7)]
    bits.append(sum(bits) % 2)
    g = np.zeros((HEIGHT, WIDTH), bool)
    g[:, 8:11] = True
    g[24:32, 0] = g[26:29, :8] = True
    g[0:8, 19] = g[3:6, 11:] = True
    for k in range(4):
        g[6 * k : 6 * k + 3, 3:8] |= bool(bits[k])
        g[6 * k + 11 : 6 * k + 14, 11:16] |= bool(bits[4 + k])
    return g


def page(lines: list[str]) -> np.ndarray:
    """Grey page of lines of text."""
    width = lambda t: sum(SPACE if c == " " else WIDTH for c in t)
    out = np.full((2 * MARGIN + PITCH * len(lines), 2 * MARGIN + max(map(width, lines), default=0)), PAPER, np.uint8)
    for k, line in enumerate(lines):
        x = MARGIN
        for c in line:
            if c != " ":
                out[MARGIN + PITCH * k : MARGIN + PITCH * k + HEIGHT, x : x + WIDTH][glyph(c)] = INK
            x += SPACE if c == " " else WIDTH
    return out


#: Pages that a task holds at a time.
PAGES = 16


def png_pages(documents: DataFrame) -> DataFrame:
    """(name, content): PNG files of the pages of documents (doc_id, raw_text), drawn and encoded in
    tasks, a few at a time; raw pages do not leave the task."""

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), PAGES):
                b = whole.iloc[at : at + PAGES]
                pages = [page(t.split("\n")) for t in b.raw_text]
                yield pd.DataFrame({"name": [f"{i}.png" for i in b.doc_id], "content": [png(p.tobytes(), p.shape[1], p.shape[0]) for p in pages]})

    return documents.select("doc_id", "raw_text").mapInPandas(run, "name string, content binary")


def model(spark: SparkSession) -> DataFrame:
    """(sample_idx, label, descriptor) of the script's characters."""
    rows = []
    for k, c in enumerate(CHARACTERS):
        found = kernels.characters(kernels.preprocess(page([c * 8])))
        rows.append((k, c, kernels.hog(kernels.fit_square(found[3]["raster"])).tolist()))
    return spark.createDataFrame(rows, "sample_idx long, label string, descriptor array<float>")

