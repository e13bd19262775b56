"""Training data and models: synthesis, splits, training, evaluation, activation."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import kernels
from ..sources import scratch
from . import knn, metrics


@dataclass(frozen=True)
class Distortions:
    rotation: float = config.ROTATION_RANGE
    scale: float = config.SCALE_RANGE
    noise: float = config.NOISE_LEVEL
    skew: float = config.SKEW_RANGE


SAMPLE = "sample_idx long, label string, source_document string, confidence double, width int, height int, gray binary"


def render_glyphs(spark: SparkSession, characters: list[str], fonts: list[str], size: int) -> dict[tuple[str, str], np.ndarray]:
    """Grey glyphs, black on white, centred, drawn by the JVM; few and small, so on the driver."""
    awt = spark._jvm.java.awt
    spark._jvm.java.lang.System.setProperty("java.awt.headless", "true")
    names = {"Times New Roman": "Serif", "Courier New": "Monospaced"}
    out = {}
    for font in fonts:
        face = awt.Font(names.get(font, "SansSerif"), 0, int(size * 0.7))
        for c in characters:
            image = awt.image.BufferedImage(size, size, 10)
            g = image.createGraphics()
            g.setColor(awt.Color.WHITE)
            g.fillRect(0, 0, size, size)
            g.setColor(awt.Color.BLACK)
            g.setFont(face)
            m = g.getFontMetrics()
            g.drawString(c, int((size - m.stringWidth(c)) / 2), int((size - m.getHeight()) / 2) + m.getAscent())
            g.dispose()
            data = bytes(image.getRaster().getDataBuffer().getData())
            out[c, font] = np.frombuffer(data, np.uint8).reshape(size, size)
    return out


def distort(glyph: np.ndarray, d: Distortions, rng: np.random.Generator) -> tuple[np.ndarray, float, float]:
    """A distorted, cropped, squared sample of a glyph, and its rotation and scale."""
    between = lambda r: -r + rng.random() * 2 * r
    rotation, factor, dx, dy = between(d.rotation), 1 + between(d.scale), between(d.skew), between(d.skew)
    img = kernels.skew(kernels.scale(kernels.rotate(glyph, rotation), factor), dx, dy)
    img = kernels.text_as_foreground(kernels.binarize(kernels.salt_pepper(img, d.noise, rng)))
    return kernels.fit_square(kernels.crop_foreground(img), glyph.shape[0]), rotation, factor


def synthesize(
    spark: SparkSession, characters: list[str], per_character: int = config.SAMPLES_PER_CHARACTER, size: int = config.CHAR_SIZE,
    fonts: tuple[str, ...] = config.FONTS, distortions: Distortions = Distortions(), seed: int = 0, renderer: Callable | None = None,
) -> DataFrame:
    """Labelled samples; each is drawn by a generator seeded by (seed, character, index), so a
    sample is the same wherever and however often its task runs."""
    fonts = list(fonts)
    glyphs = {(c, f): renderer(c, f, size) for c in characters for f in fonts} if renderer else render_glyphs(spark, characters, fonts, size)
    spine = spark.createDataFrame(list(enumerate(characters)), "c long, label string").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_character - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for c, label, i in zip(batch.c, batch.label, batch.i, strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(label.encode()), int(i)])
                font = fonts[int(rng.random() * len(fonts))]
                img, rotation, factor = distort(glyphs[label, font], distortions, rng)
                rows.append((int(c) * per_character + int(i), label, f"synthetic:{font}:rot{rotation:.1f}:scale{factor:.2f}", 1.0, size, size, img.tobytes()))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SAMPLE.split(", ")])

    return spine.mapInPandas(run, SAMPLE)


def label_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label").agg(F.count("*").alias("n"))


def stratified_split(samples: DataFrame, ratio: float = config.TRAIN_TEST_SPLIT) -> DataFrame:
    """Adds `train`: of each label the first round(n * ratio) samples by sample_idx."""
    if not 0 < ratio < 1:
        raise ValueError("the ratio must be between 0 and 1")
    by = Window.partitionBy("label")
    return samples.withColumn("train", F.row_number().over(by.orderBy("sample_idx")) <= F.floor(F.count("*").over(by) * ratio + 0.5))


def predictions(test: DataFrame, model: DataFrame, k: int = config.KNN_K) -> DataFrame:
    """(sample_idx, expected, predicted, confidence)."""
    found = knn.predict(test.select(F.col("sample_idx").alias("q"), "descriptor"), model, k)
    truth = test.select(F.col("sample_idx").alias("q"), F.col("label").alias("expected"))
    return truth.join(found, "q").select(F.col("q").alias("sample_idx"), "expected", F.col("label").alias("predicted"), "confidence")


def train(samples: DataFrame, k: int = config.KNN_K, ratio: float = config.TRAIN_TEST_SPLIT) -> dict:
    """Splits, memorises and evaluates: the model frame, accuracy, matrix, precision and recall, warning."""
    split = stratified_split(samples, ratio)
    model = split.where("train").drop("train")
    if model.isEmpty():
        raise ValueError("there is nothing to train on")
    pairs = scratch.written(predictions(split.where("not train"), model, k), "training-pairs")  # read for accuracy and matrix
    matrix = metrics.confusion_matrix(pairs, model.select("label").distinct())
    share = metrics.accuracy(pairs).first().accuracy
    low = share is not None and share < config.MIN_ACCURACY_THRESHOLD
    return {"model": model, "accuracy": share, "matrix": matrix, "by_label": metrics.precision_recall(matrix), "warning": "accuracy is under the threshold" if low else None}


def train_on_partitions(samples: DataFrame, k: int = config.KNN_K) -> tuple[DataFrame, float | None]:
    """Model of partition `train` and its accuracy on `test` (None without test samples)."""
    model = samples.where("dataset_partition = 'train'")
    if model.isEmpty():
        raise ValueError("there is nothing to train on")
    return model, metrics.accuracy(predictions(samples.where("dataset_partition = 'test'"), model, k)).first().accuracy


def evaluate_active(model: DataFrame, samples: DataFrame, k: int = config.KNN_K) -> DataFrame:
    """(sample_idx, expected, predicted, confidence) of the test partition; an error without model or test."""
    test = samples.where("dataset_partition = 'test'")
    if model.isEmpty() or test.isEmpty():
        raise ValueError("an active model and a test partition are needed")
    return predictions(test, model, k)
