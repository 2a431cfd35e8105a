"""One-to-one matching of detections to ground truth by overlap, image by image.

Pairs of one image that overlap enough are taken by falling overlap, ties by the ids, as long as
neither side is taken. What is left over is a false positive or a false negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geometry, text
from gridloom.schemas import STATUSES

CORNERS = ("xmin", "ymin", "xmax", "ymax")
#: A pair of boxes, in the order in which pairs are taken.
PAIR = "struct<minus:double,detection_id:string,ground_truth_id:string,same_class:boolean>"


def candidate_pairs(detections: DataFrame, ground_truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``image_id, detection_id, ground_truth_id, iou, same_class`` for pairs with at least ``threshold``: an equi-join with a residual condition."""
    if not 0 < threshold <= 1:
        raise ValueError("the overlap threshold must lie in (0, 1]")
    pairs = detections.alias("d").join(ground_truth.alias("g"), "image_id")
    overlap = geometry.iou(geometry.box("d."), geometry.box("g."))
    return (
        pairs.select("image_id", "detection_id", "ground_truth_id", overlap.alias("iou"), (F.col("predicted_class_id") == F.col("class_id")).alias("same_class"))
        .filter(F.col("iou") >= threshold)
    )


def _walk(pairs: Column) -> Column:
    """An image's sorted pairs ``(minus, detection_id, ground_truth_id, same_class)`` in one pass: the ids ``d`` and ``g`` that are taken, and the pairs ``taken``."""
    empty = F.expr(f"named_struct('d', cast(array() as array<string>), 'g', cast(array() as array<string>), 'taken', cast(array() as array<{PAIR}>))")

    def take(state: Column, pair: Column) -> Column:
        free = ~F.array_contains(state["d"], pair["detection_id"]) & ~F.array_contains(state["g"], pair["ground_truth_id"])
        more = F.struct(
            F.array_append(state["d"], pair["detection_id"]).alias("d"),
            F.array_append(state["g"], pair["ground_truth_id"]).alias("g"),
            F.array_append(state["taken"], pair).alias("taken"),
        )
        return F.when(free, more).otherwise(state)

    return F.aggregate(pairs, empty, take)


def greedy(pairs: DataFrame) -> DataFrame:
    """``image_id, rank, detection_id, ground_truth_id, iou, same_class``: the pairs taken, by rank from 0 within the image.

    One sorted array per image and one pass over it, in the JVM. An image's pairs must fit a task, which a
    few thousand boxes do; the arrays hold ids and overlaps only.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("minus"), "detection_id", "ground_truth_id", "same_class")))
    keyed = pairs.select("image_id", F.col("detection_id").cast("string").alias("detection_id"), F.col("ground_truth_id").cast("string").alias("ground_truth_id"), "iou", "same_class")
    taken = keyed.groupBy("image_id").agg(ordered.alias("pairs")).select("image_id", _walk(F.col("pairs"))["taken"].alias("taken"))
    rows = taken.select("image_id", F.posexplode("taken").alias("rank", "t"))
    return rows.select("image_id", "rank", "t.detection_id", "t.ground_truth_id", (-F.col("t.minus")).alias("iou"), "t.same_class")


def matches(detections: DataFrame, ground_truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    return greedy(candidate_pairs(detections, ground_truth, threshold))


def false_positives(detections: DataFrame, matched: DataFrame) -> DataFrame:
    return left_over(detections, matched, "detection_id").select("image_id", "detection_id")


def false_negatives(ground_truth: DataFrame, matched: DataFrame) -> DataFrame:
    return left_over(ground_truth, matched, "ground_truth_id").select("image_id", "ground_truth_id")


def left_over(side: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """Rows of a side that no match has. Ids need be unique within an image only; the join's keys begin with the image, by which matches are dealt already."""
    taken = matched.select(F.col("image_id").alias("_image"), F.col(key).alias("_id"))
    return side.join(taken, (F.col("image_id") == F.col("_image")) & (F.col(key).cast("string") == F.col("_id")), "left_anti")


def _by_image(df: DataFrame, key: str, kind: str, column: str) -> DataFrame:
    """``image_id`` and the array ``column`` of its boxes in input order: by ``ordinal``, or else by id."""
    place = F.col("ordinal").cast("long") if "ordinal" in df.columns else F.lit(0).cast("long")
    box = F.struct(place.alias("place"), F.col(key).cast("string").alias("id"), F.col(kind).alias("kind"), *[c.cast("double").alias(n) for c, n in zip(geometry.box(), CORNERS, strict=True)])
    return df.select("image_id", box.alias("box")).groupBy("image_id").agg(F.array_sort(F.collect_list("box")).alias(column))


def comparisons(detections: DataFrame, ground_truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per match, then per detection and ground truth left over, numbered within the image in that order.

    The side that is missing is an empty string, and the overlap null. ``ordinal`` of both inputs, or else their ids, give the input order.
    Boxes without image id match nothing, and each side numbers its own.
    Each side is grouped by image once, and one join brings an image's arrays together; all else is a pass over them, without another shuffle.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the overlap threshold must lie in (0, 1]")
    both = _by_image(detections, "detection_id", "predicted_class_id", "ds").join(_by_image(ground_truth, "ground_truth_id", "class_id", "gs"), "image_id", "full")
    corners = lambda b: tuple(b[c] for c in CORNERS)

    def overlapping(d: Column) -> Column:
        pairs = F.transform("gs", lambda g: F.struct((-geometry.iou(corners(d), corners(g))).alias("minus"), d["id"].alias("detection_id"), g["id"].alias("ground_truth_id"), (d["kind"] == g["kind"]).alias("same_class")))
        return F.filter(pairs, lambda p: p["minus"] <= -threshold)

    none = F.expr(f"cast(array() as array<{PAIR}>)")
    met = both.withColumn("pairs", F.array_sort(F.coalesce(F.flatten(F.transform("ds", overlapping)), none)))  # an image that one side lacks has none
    walked = met.select("image_id", "ds", "gs", _walk(F.col("pairs")).alias("w"))
    row = lambda d, g, iou, status: F.struct(d.alias("detection_id"), g.alias("ground_truth_id"), iou.cast("double").alias("iou"), status.alias("status"))
    blank, null = F.lit(""), F.lit(None)
    ids = lambda side: F.coalesce(F.transform(side, lambda b: b["id"]), F.expr("cast(array() as array<string>)"))
    free = lambda side, taken: F.filter(ids(side), lambda i: ~F.coalesce(F.array_contains(taken, i), F.lit(False)))
    parts = F.concat(
        F.transform("w.taken", lambda t: row(t["detection_id"], t["ground_truth_id"], -t["minus"], F.when(t["same_class"], STATUSES[0]).otherwise(STATUSES[1]))),
        F.transform(free("ds", F.col("w.d")), lambda d: row(d, blank, null, F.lit(STATUSES[2]))),
        F.transform(free("gs", F.col("w.g")), lambda g: row(blank, g, null, F.lit(STATUSES[3]))),
    )
    rows = walked.select("image_id", F.posexplode(parts).alias("k", "r"))
    return rows.select(text.numbered(F.col("image_id"), "cmp", F.col("k")).alias("comparison_id"), "image_id", "r.detection_id", "r.ground_truth_id", "r.iou", "r.status")


def status_counts(compared: DataFrame) -> DataFrame:
    """``status, n`` for all four, 0 where there is none."""
    named = compared.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = compared.groupBy("status").agg(F.count("*").alias("n"))
    return F.broadcast(named).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
