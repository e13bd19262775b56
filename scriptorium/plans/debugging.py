"""The debug report of images: lines, words and characters, with what was seen and read in each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import kernels
from ..operators import knn, pixels
from ..sources import scratch


def described(parts: DataFrame, chars: DataFrame) -> DataFrame:
    """(img, component, descriptor) of the components (img, x, y, component) that are characters (img, component)."""
    kind = dict(parts.dtypes)["img"]
    own = parts.join(chars.select("img", "component").distinct(), ["img", "component"])

    def describe(table: pa.Table) -> pa.Table:
        x, y = table["x"].to_numpy(), table["y"].to_numpy()
        raster = np.zeros((int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1), np.uint8)
        raster[y - y.min(), x - x.min()] = 255
        out = table.select(["img", "component"]).slice(0, 1)
        return out.append_column("descriptor", pa.array([kernels.hog(kernels.fit_square(raster)).tolist()], pa.list_(pa.float32())))

    return own.groupBy("img", "component").applyInArrow(describe, f"img {kind}, component int, descriptor array<float>")


def debug_report(
    px: DataFrame, model: DataFrame, line_least: int = config.HORIZONTAL_VALLEY_THRESHOLD, word_least: int = config.VERTICAL_VALLEY_THRESHOLD,
    low: int = config.CHAR_MIN_HEIGHT, high: int = config.CHAR_MAX_HEIGHT,
) -> DataFrame:
    """One row an image of the binary pixels (img, x, y, v): width, height, white, and its lines.

    lines: array of (line, low, high, words); words: array of (word, low, high, characters);
    characters: array of (char, component, x0, x1, y0, y1, descriptor, label, confidence).
    A line without words, a word without characters and an image without lines have empty arrays.
    The report of one image is one row; everything below it is joined by image, line and word.
    """
    kind = dict(px.dtypes)["img"]
    parts = scratch.written(pixels.components(px), "debug-parts")
    lines = scratch.written(pixels.lines(px, line_least), "debug-lines")
    members = pixels.line_components(lines, pixels.boxes(parts))
    words = scratch.written(pixels.words(lines, parts, word_least), "debug-words")
    chars = scratch.written(pixels.fit_height(pixels.word_components(words, members), low, high), "debug-chars")
    seen = scratch.written(described(parts, chars).withColumn("q", F.monotonically_increasing_id()), "debug-seen")
    read = knn.predict(seen.select("q", "descriptor"), model).select("q", "label", "confidence")
    known = seen.join(read, "q").drop("q")

    whole = chars.select("img", "line", "word", "char", "component", "x0", "x1", "y0", "y1").join(known, ["img", "component"])
    character = F.struct("char", "component", "x0", "x1", "y0", "y1", "descriptor", "label", "confidence")
    in_word = whole.groupBy("img", "line", "word").agg(F.array_sort(F.collect_list(character)).alias("characters"))
    none = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c)
    word = words.join(in_word, ["img", "line", "word"], "left")
    word = word.select("img", "line", F.struct("word", "low", "high", none("characters", in_word)).alias("w"))
    in_line = word.groupBy("img", "line").agg(F.array_sort(F.collect_list("w")).alias("words"))
    line = lines.join(in_line, ["img", "line"], "left").select("img", F.struct("line", "low", "high", none("words", in_line)).alias("l"))
    in_image = line.groupBy("img").agg(F.array_sort(F.collect_list("l")).alias("lines"))
    size = px.groupBy("img").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count_if(F.col("v") == 255).alias("white"))
    return size.join(in_image, "img", "left").select(F.col("img").cast(kind).alias("img"), "width", "height", "white", none("lines", in_image))
