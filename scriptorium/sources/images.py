"""Image sources and checks of uploads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import kernels

IMAGE = "path string, width int, height int, gray binary, error string"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, gray, error) of PNG and JPEG files; a corrupt file keeps its row."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    def gray(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for origin, h, w, n, data in zip(batch.origin, batch.height, batch.width, batch.nChannels, batch.data, strict=True):
                if h < 0:
                    rows.append((origin, None, None, None, "the image cannot be decoded"))
                    continue
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                px = px[..., 0] if n == 1 else kernels.grayscale(px[..., 2::-1])  # stored blue first
                rows.append((origin, w, h, px.tobytes(), None))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "gray", "error"])

    return raw.mapInPandas(gray, IMAGE)


def from_pixels(width: Column, height: Column, gray: Column) -> Column:
    """Image struct of a raw buffer; a buffer of another size is an error."""
    bad = F.octet_length(gray) != width * height
    return F.when(bad, F.raise_error(F.lit("the buffer does not fit width and height"))).otherwise(F.struct(width.alias("width"), height.alias("height"), gray.alias("gray")))


def sniff_mime(content: Column) -> Column:
    """MIME type by magic bytes, PNG first; null if neither."""
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", "image/png").when(F.hex(F.substring(content, 1, 3)) == "FFD8FF", "image/jpeg")


def upload_error(content: Column, length: Column, declared: Column) -> Column:
    """First check that an upload fails; null if it passes."""
    return (
        F.when(content.isNull() | (F.coalesce(length, F.lit(0)) == 0), "FILE_MISSING")
        .when(length > config.MAX_UPLOAD_BYTES, "FILE_TOO_LARGE")
        .when(declared.isNull() | ~declared.isin(*config.ALLOWED_MIME_TYPES), "MIME_NOT_ALLOWED")
        .when(~sniff_mime(content).eqNullSafe(declared), "MIME_MISMATCH")
    )


def extension(mime: Column) -> Column:
    return F.when(mime == "image/png", "png").otherwise("jpg")


def enough_resolution(width: Column, height: Column) -> Column:
    return width.cast("long") * height >= config.MIN_CAPTURE_AREA
