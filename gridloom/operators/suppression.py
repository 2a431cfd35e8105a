"""Non-maximum suppression: of boxes of one class that overlap too much, the most confident stays.

An image's boxes are taken by falling confidence. A box goes if one that was kept before has its class and overlaps it by more than a threshold.
The fold is an expression over an array, so where a row holds an image's boxes, as after a model, nothing is shuffled. Thousands
of boxes an image are fine. Applied twice with the same thresholds, the second time changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geometry

CORNERS = ("xmin", "ymin", "xmax", "ymax")


def _check(confidence: float, overlap: float) -> None:
    if not (0 <= confidence <= 1 and 0 <= overlap <= 1):
        raise ValueError("confidence and overlap thresholds lie between 0 and 1")


def is_strong(confidence: Column, least: float) -> Column:
    """More than the threshold; null and nan never are."""
    return F.coalesce((confidence > least) & ~F.isnan(confidence), F.lit(False))


def _fold(ranked: Column, overlap: float, by_class: bool) -> Column:
    """Of boxes ``r.box`` in order, those that no earlier kept one rules out."""

    def ruled_out(kept: Column, box: Column) -> Column:
        corners = lambda b: tuple(b[c] for c in CORNERS)
        alike = lambda k: (k["box"]["class_id"] == box["class_id"]) if by_class else F.lit(True)
        return F.exists(kept, lambda k: alike(k) & (geometry.iou(corners(k["box"]), corners(box)) > overlap))

    return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda kept, r: F.when(ruled_out(kept, r["box"]), kept).otherwise(F.array_append(kept, r)))


def kept_boxes(boxes: Column, confidence: float, overlap: float, by_class: bool = True) -> Column:
    """Of an array of boxes (corners, class_id, confidence) those that stay, by falling confidence, ties in the array's order."""
    _check(confidence, overlap)
    strong = F.filter(boxes, lambda b: is_strong(b["confidence"], confidence))
    ranked = F.array_sort(F.transform(strong, lambda b, k: F.struct((-b["confidence"]).alias("minus"), k.alias("place"), b.alias("box"))))
    return F.transform(_fold(ranked, overlap, by_class), lambda r: r["box"])


def suppressed(detections: DataFrame, confidence: float, overlap: float, by_class: bool = True) -> DataFrame:
    """The rows of ``detections`` that stay, with all their columns; ties of confidence go by ``detection_id``.

    Weak boxes go before anything is shuffled. A box without image or without class is compared with none.
    """
    _check(confidence, overlap)
    strong = detections.filter(is_strong(F.col("confidence"), confidence))
    box = F.struct(*[c.cast("double").alias(n) for c, n in zip(geometry.box(), CORNERS, strict=True)], F.col("predicted_class_id").alias("class_id"))
    row = F.struct((-F.col("confidence")).alias("minus"), F.col("detection_id").cast("string").alias("place"), box.alias("box"), F.struct(*[detections[c] for c in detections.columns]).alias("row"))
    placed = strong.filter("image_id is not null").select(F.col("image_id").alias("key"), row.alias("r")).groupBy("key").agg(F.array_sort(F.collect_list("r"), _by_confidence).alias("ranked"))
    rows = placed.select(F.explode(_fold(F.col("ranked"), overlap, by_class)).alias("r")).select("r.row.*")
    return rows.unionByName(strong.filter("image_id is null"))


def _by_confidence(a: Column, b: Column) -> Column:
    """Only these two are compared: rows may hold columns that have no order."""
    return F.when(a["minus"] < b["minus"], -1).when(a["minus"] > b["minus"], 1).when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)
