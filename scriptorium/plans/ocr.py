"""From images to text: one Arrow-batched stage per document batch, no shuffle."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields, kernels
from ..functions.kernels import Neighbours
from ..operators.knn import collect_model
from ..operators.metrics import field_metrics

BOX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "width", "height")])
LINE = T.StructType([T.StructField("text", T.StringType()), T.StructField("bbox", BOX), T.StructField("confidence", T.DoubleType())])
TIMING = T.StructType([T.StructField(n, T.DoubleType()) for n in ("preprocess", "segmentation", "recognition", "total")])
RESULT = [
    T.StructField("raw_text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("lines", T.ArrayType(LINE)),
    T.StructField("timing", TIMING),
    T.StructField("error", T.StringType()),
]
STAGES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("gray", T.BinaryType())]))


#: Images whose results a task holds at a time.
IMAGES = 16


def recognise(gray: np.ndarray, model: Neighbours, **limits: int) -> dict:
    """Text of one image, its lines with boxes and confidences, and the times of the stages."""
    t0 = time.perf_counter()
    binary = kernels.preprocess(gray)
    t1 = time.perf_counter()
    chars = kernels.characters(binary, **limits)
    t2 = time.perf_counter()
    found = model.predict(kernels.hogs(np.array([kernels.fit_square(c["raster"]) for c in chars]))) if chars else []
    lines, scores = [], [f[1] for f in found]
    for n in dict.fromkeys(c["line"] for c in chars):
        own = [k for k, c in enumerate(chars) if c["line"] == n]
        words: dict[int, str] = {}
        for k in own:
            words[chars[k]["word"]] = words.get(chars[k]["word"], "") + found[k][0]
        left = min(chars[k]["x"] for k in own)
        right = max(chars[k]["x"] + chars[k]["raster"].shape[1] for k in own)
        top, bottom = chars[own[0]]["top"], chars[own[0]]["bottom"]
        box = {"x": left, "y": top, "width": right - left, "height": bottom - top + 1}
        lines.append({"text": " ".join(words.values()), "bbox": box, "confidence": float(np.mean([scores[k] for k in own]))})
    t3 = time.perf_counter()
    ms = lambda a, b: (b - a) * 1000
    timing = {"preprocess": ms(t0, t1), "segmentation": ms(t1, t2), "recognition": ms(t2, t3), "total": ms(t0, t3)}
    text = "\n".join(x["text"] for x in lines)
    return {"raw_text": text, "confidence": float(np.mean(scores)) if scores else 0.0, "lines": lines, "timing": timing, "error": None}


def ocr_documents(images: DataFrame, model: DataFrame, key: str = "path", debug: bool = False, **limits: int) -> DataFrame:
    """(key, raw_text, confidence, lines, timing, error[, stages]) of images (key, width, height, gray).

    The model is sent once, behind a check of its size.  A bad image becomes a row with an error.
    """
    neighbours = collect_model(model)
    if neighbours is None:
        raise ValueError("the model is too large to send to all executors; describe the characters and use `knn.topk`")
    out = T.StructType([images.schema[key], *RESULT, *([T.StructField("stages", STAGES)] if debug else [])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[at : at + IMAGES] for b in batches for at in range(0, len(b), IMAGES)):
            rows = []
            for k, w, h, data in zip(batch[key], batch.width, batch.height, batch.gray, strict=True):
                try:
                    gray = np.frombuffer(data, np.uint8).reshape(int(h), int(w))
                    row = recognise(gray, neighbours, **limits)
                    if debug:
                        row["stages"] = stages(gray)
                except (TypeError, ValueError) as e:
                    row = dict.fromkeys(out.names) | {"error": str(e)}
                rows.append(row | {key: k})
            yield pd.DataFrame(rows, columns=out.names, dtype=object)

    return images.select(key, "width", "height", "gray").mapInPandas(run, out)


def stages(gray: np.ndarray) -> list[dict]:
    """The image after each step of preprocessing."""
    steps = [("gray", gray), ("stretch", kernels.stretch(gray))]
    steps.append(("blur", kernels.blur(steps[-1][1])))
    steps.append(("binary", kernels.binarize(steps[-1][1])))
    steps.append(("foreground", kernels.text_as_foreground(steps[-1][1])))
    return [{"name": n, "width": v.shape[1], "height": v.shape[0], "gray": v.tobytes()} for n, v in steps]


def descriptors(images: DataFrame, key: str = "path") -> DataFrame:
    """(key, descriptor) of character images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [kernels.hog(np.frombuffer(g, np.uint8).reshape(int(h), int(w))).tolist() for g, w, h in zip(b.gray, b.width, b.height, strict=True)]
            yield pd.DataFrame({key: b[key], "descriptor": rows})

    return images.select(key, "width", "height", "gray").mapInPandas(run, T.StructType([images.schema[key], T.StructField("descriptor", T.ArrayType(T.FloatType()))]))


def repeat_runs(images: DataFrame, model: DataFrame, runs: int = 5, key: str = "path") -> DataFrame:
    """Results of `runs` runs of each image (doc_id, run, raw_text, lines, confidence)."""
    if runs < 1:
        raise ValueError("at least one run is needed")
    many = images.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("_key", F.struct(key, "run"))
    out = ocr_documents(many, model, "_key")
    return out.select(F.col(f"_key.{key}").alias("doc_id"), "_key.run", "raw_text", "lines", "confidence", "timing")


def evaluate_fields(images: DataFrame, model: DataFrame, truth: DataFrame, key: str = "path") -> DataFrame:
    """Metrics of the six fields from images to values, against truth (doc_id, field, value_str, value_num)."""
    read = ocr_documents(images, model, key).where("error is null").withColumnRenamed(key, "doc_id")
    return field_metrics(fields.long_fields(fields.extract_fields(read)), truth)
