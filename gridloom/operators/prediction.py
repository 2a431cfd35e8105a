"""The model boundary: images through a detector in Python workers, and the tables that come of it.

A detector is loaded once per worker by a function that workers can import or unpickle, and is called with batches of paths.
Everything around it is joins and projections.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geometry, text
from gridloom.operators import suppression


@dataclass(frozen=True)
class Found:
    """One image's detections, in the detector's order: corners, class and confidence each."""

    width: int
    height: int
    boxes: list[tuple[float, float, float, float]]
    classes: list[int]
    confidences: list[float]


@dataclass(frozen=True)
class Options:
    """What settings ask of a run: boxes of more than this confidence, overlap at which boxes of a class rule each other out, image size, images a call, device."""

    confidence: float = 0.25
    overlap: float = 0.7
    size: int = 640
    batch: int = 16
    device: str | None = None

    @classmethod
    def of(cls, section: dict, **instead: float) -> Options:
        """Of a section of the settings; ``instead`` stands for what it doesn't say."""
        known = {"confidence": "confidence", "overlap": "iou", "size": "imgsz", "batch": "batch", "device": "device"}
        own = instead | {field: section[name] for field, name in known.items() if section.get(name) is not None}
        return cls(**own | ({"device": str(own["device"])} if "device" in own else {}))


class Detector(Protocol):
    """May also have ``configure(options)``, called once before it predicts, and ``device``, the name of what it runs on."""

    names: dict[int, str]

    def predict(self, paths: list[str]) -> list[Found]: ...


RAW = "ordinal long, path string, width int, height int, boxes array<struct<xmin:double,ymin:double,xmax:double,ymax:double,class_id:int,confidence:double>>, milliseconds double, device string"


def predict(images: DataFrame, load: Callable[[], Detector], options: Options | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """``ordinal, path, width, height, boxes, milliseconds, device`` for ``images`` (ordinal, path); a result that lacks images or parts is an error.

    ``options`` reach the detector if it takes them, and their thresholds hold whether it does or not: weak boxes go, then those that a
    stronger box of their class rules out, and the rest come by falling confidence. Without options boxes are as the detector gives them.
    ``profile`` asks the cluster for executors with what a detector needs, such as GPUs, for this stage alone.
    """
    batch = options.batch if options else 16

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = load()
        if options and hasattr(detector, "configure"):
            detector.configure(options)
        device = getattr(detector, "device", None) or (options and options.device)
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                began = time.perf_counter()
                results = detector.predict(part["path"].tolist())
                each = 1000 * (time.perf_counter() - began) / len(part)
                if len(results) != len(part):
                    raise RuntimeError(f"{len(results)} results for {len(part)} images")
                rows = []
                for ordinal, path, r in zip(part["ordinal"], part["path"], results, strict=True):
                    if not len(r.boxes) == len(r.classes) == len(r.confidences):
                        raise RuntimeError(f"incomplete result for {path}")
                    boxes = [dict(zip(("xmin", "ymin", "xmax", "ymax"), map(float, b), strict=True), class_id=int(c), confidence=float(p)) for b, c, p in zip(r.boxes, r.classes, r.confidences, strict=True)]
                    rows.append((ordinal, path, r.width, r.height, boxes, each, device and str(device)))
                yield pd.DataFrame(rows, columns=["ordinal", "path", "width", "height", "boxes", "milliseconds", "device"])

    raw = images.select("ordinal", "path").mapInPandas(run, RAW, profile=profile)
    return raw.withColumn("boxes", suppression.kept_boxes(F.col("boxes"), options.confidence, options.overlap)) if options else raw


def run_facts(raw: DataFrame) -> dict:
    """Mean time of an image, and how many images each device took."""
    rows = raw.groupBy("device").agg(F.count("*").alias("n"), F.sum("milliseconds").alias("ms")).collect()  # a row per kind of device
    n = sum(r.n for r in rows)
    return {"speed_ms_per_image": {"inference": sum(r.ms for r in rows) / n if n else 0.0}, "devices": {r.device or "unknown": r.n for r in rows}}


def with_image_id(raw: DataFrame, dataset_id: str) -> DataFrame:
    """``image_id``: the dataset's safe name, six digits of the place in the source, the stem."""
    safe = text.safe_name(F.lit(dataset_id))
    return raw.withColumn("image_id", F.format_string("%s_%06d_%s", safe, "ordinal", text.stem(F.col("path"))))


def class_name(class_id: Column, names: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[class_id]


def image_table(named: DataFrame, dataset_id: str, split: Column, ground_truth_count: Column) -> DataFrame:
    return named.select("image_id", F.lit(dataset_id).alias("dataset_id"), F.col("path").alias("source_image_path"), split.alias("source_split"), F.col("width").alias("image_width"), F.col("height").alias("image_height"), F.size("boxes").alias("prediction_count"), ground_truth_count.cast("int").alias("ground_truth_count"))


def detection_table(named: DataFrame, names: dict[int, str]) -> DataFrame:
    """One row per detection, moved into its image and numbered in the detector's order."""
    rows = named.select("image_id", "width", "height", F.posexplode("boxes").alias("index", "b"))
    corners = geometry.clamped(geometry.box("b."), F.col("width"), F.col("height"))
    return rows.select(text.numbered(F.col("image_id"), "det", F.col("index")).alias("detection_id"), "image_id", F.col("b.class_id").alias("predicted_class_id"), class_name(F.col("b.class_id"), names).alias("predicted_class_name"), F.col("b.confidence").alias("confidence"), *[c.alias(n) for n, c in corners.items()])


def ground_truth_table(boxes: DataFrame, names: dict[int, str]) -> DataFrame:
    """Of ``image_id, index, class_id`` and corners; a class that the model doesn't know raises."""
    name = class_name(F.col("class_id").cast("int"), names)
    guard = F.when(name.isNull(), F.raise_error(F.concat(F.lit("ground-truth class unknown to the model: "), F.col("class_id").cast("string")))).otherwise(name)
    return boxes.select(text.numbered(F.col("image_id"), "gt", F.col("index")).alias("ground_truth_id"), "image_id", F.col("class_id").cast("int").alias("class_id"), guard.alias("class_name"), "xmin", "ymin", "xmax", "ymax")
