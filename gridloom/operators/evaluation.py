"""Precision, recall and average precision of detections, from the tables alone.

Within an image and class, detections are taken by falling confidence (ties by id, unknown confidence last); each takes the free ground truth that it
overlaps most, if that is enough (ties to the smaller id), and is then a hit. Average precision is the area under the precision
envelope. These formulas are ours.

One join by image and class finds all overlaps, and every threshold is a fold over an image's pairs. Ranks run within stretches of
the order by class, confidence and ids, with sums of the stretches before and maxima of those after. A stretch has a bounded number of rows, and
tasks are as many as the rows ask for, so neither a frequent class or confidence nor the session's number of partitions makes a task large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom import staging
from gridloom.functions import geometry

CORNERS = ("xmin", "ymin", "xmax", "ymax")
#: Overlaps at which metrics are averaged.
THRESHOLDS = tuple(0.5 + 0.05 * k for k in range(10))
#: Detections of a task, about.
ROWS = 200_000


def _confidence(c: Column) -> Column:
    """Unknown ones come last."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(float("-inf")))


def _walk(pairs: Column, threshold: float) -> Column:
    """Ids of the detections that take a ground truth, of an image's sorted pairs of a class."""
    state = F.expr("named_struct('ids', cast(array() as array<string>), 'truths', cast(array() as array<string>))")

    def take(s: Column, p: Column) -> Column:
        free = ~F.array_contains(s["truths"], p["truth"]) & ~F.array_contains(s["ids"], p["id"])
        return F.when(free, F.struct(F.array_append(s["ids"], p["id"]).alias("ids"), F.array_append(s["truths"], p["truth"]).alias("truths"))).otherwise(s)

    return F.aggregate(F.filter(pairs, lambda p: p["less"] <= -threshold), state, take)["ids"]


def hits(detections: DataFrame, ground_truth: DataFrame, thresholds: tuple[float, ...] = (0.5,), rows: int | None = None) -> DataFrame:
    """``image_id, detection_id, class_id, confidence, hits``: for each threshold 1 where the detection takes a ground truth, else 0.

    Ids need be unique within an image only, and come back as text. A detection without image or class takes none.
    One join finds all overlaps; it deals both sides by image and class, as the folds need them. ``rows`` are those of both sides, which are counted unless given.
    """
    corners = lambda: [c.cast("double").alias(n) for c, n in zip(geometry.box(), CORNERS, strict=True)]
    named = detections.select("image_id", F.col("predicted_class_id").alias("class_id"), F.col("detection_id").cast("string").alias("id"), "confidence", *corners())
    whole = F.col("image_id").isNotNull() & F.col("class_id").isNotNull()
    truth = ground_truth.filter(whole).select("image_id", "class_id", F.col("ground_truth_id").cast("string").alias("truth"), *corners())
    parts = tasks(detections.count() + ground_truth.count() if rows is None else rows)
    d, g = (side.repartition(parts, "image_id", "class_id").alias(name) for side, name in ((named.filter(whole), "d"), (truth, "g")))
    overlap = geometry.iou(geometry.box("d."), geometry.box("g."))
    met = d.join(g, (F.col("d.image_id") == F.col("g.image_id")) & (F.col("d.class_id") == F.col("g.class_id")) & (overlap >= min(thresholds)), "left")
    pair = F.struct((-_confidence(F.col("confidence"))).alias("minus"), "id", F.when(F.col("truth").isNotNull(), -overlap).alias("less"), "truth", "confidence")
    grouped = met.select("d.image_id", "d.class_id", pair.alias("pair")).groupBy("image_id", "class_id").agg(F.array_sort(F.collect_list("pair")).alias("pairs"))
    walked = grouped.select("image_id", "class_id", "pairs", *[_walk(F.col("pairs"), t).alias(f"w{k}") for k, t in enumerate(thresholds)])
    each = walked.select("image_id", "class_id", "pairs", *[f"w{k}" for k in range(len(thresholds))], F.posexplode("pairs").alias("k", "p"))
    first = each.filter((F.col("k") == 0) | (F.get("pairs", F.col("k") - 1)["id"] != F.col("p.id")))
    found = F.array(*[F.array_contains(f"w{k}", F.col("p.id")).cast("int") for k in range(len(thresholds))])
    bare = named.filter(~whole).select("image_id", F.col("id").alias("detection_id"), "class_id", "confidence", F.array_repeat(F.lit(0), len(thresholds)).alias("hits"))
    return first.select("image_id", F.col("p.id").alias("detection_id"), "class_id", "p.confidence", found.alias("hits")).unionByName(bare)


def tasks(rows: int) -> int:
    """How many tasks these rows ask for."""
    return max(1, -(-rows // ROWS))


def _ranked(scored: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Every detection of a class with its rank, hits so far ``t0..`` and precisions ``p0..``; and ``class_id, range, n, s0..`` of each range.

    A range is a class's part of a stretch of the whole order. Matching is staged, so it runs once, and so are stretches, whose bounds are sampled.
    Hits travel as the bits of one number, and counts of all thresholds are made where they are summed.
    """
    if count > 63:
        raise ValueError("63 thresholds at most")
    least = _confidence(F.col("confidence"))
    mask = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a * 2 + x)  # the first threshold is the highest bit
    rows = staging.staged(scored.filter("class_id is not null").select("class_id", (-least).alias("minus"), F.col("detection_id").cast("string").alias("id"), F.col("image_id").cast("string").alias("image"), mask.alias("mask")))
    parts = tasks(rows.count())
    key = staging.staged(rows.repartitionByRange(parts, "class_id", "minus", "id", "image").withColumn("range", F.spark_partition_id()))
    here = Window.partitionBy("class_id", "range").orderBy("minus", "id", "image").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = lambda k: F.getbit("mask", F.lit(count - 1 - k)).cast("long")
    dealt = key.repartitionById(parts, F.col("range"))  # a stretch is a task: dealt by hash, several would meet in one, the more the larger the table
    local = dealt.withColumns({"r": F.count("*").over(here)} | {f"l{k}": F.sum(hit(k)).over(here) for k in range(count)}).drop("minus", "id", "image")
    sums = key.groupBy("class_id", "range").agg(F.count("*").alias("n"), *[F.sum(hit(k)).alias(f"s{k}") for k in range(count)])
    before = Window.partitionBy("class_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = sums.select("class_id", "range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in ("n", *(f"s{k}" for k in range(count)))])
    whole = local.join(F.broadcast(starts), ["class_id", "range"]).withColumns({"rank": F.col("r") + F.col("b_n")} | {f"t{k}": F.col(f"l{k}") + F.col(f"b_s{k}") for k in range(count)})
    return whole.withColumns({f"p{k}": F.col(f"t{k}") / F.col("rank") for k in range(count)}), sums


def _positives(ground_truth: DataFrame) -> DataFrame:
    return ground_truth.filter("class_id is not null").groupBy("class_id").agg(F.count("*").alias("positives"))


def curve(scored: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """``class_id, rank, precision, recall`` after each detection of a class that has ground truth, by falling confidence, at the first threshold; ties by id, then image."""
    points = _ranked(scored, 1)[0].join(_positives(ground_truth), "class_id")
    return points.select("class_id", F.col("rank").cast("int").alias("rank"), F.col("p0").alias("precision"), (F.col("t0") / F.col("positives")).alias("recall"))


def _areas(points: DataFrame, count: int) -> DataFrame:
    """``class_id, areas``: for each threshold the best precision from each hit on, summed over the hits."""
    onward = Window.partitionBy("class_id", "range").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("class_id").orderBy("range").rowsBetween(1, Window.unboundedFollowing)  # a row per range
    best = points.groupBy("class_id", "range").agg(*[F.max(f"p{k}").alias(f"m{k}") for k in range(count)])
    later = best.select("class_id", "range", *[F.coalesce(F.max(f"m{k}").over(after), F.lit(0.0)).alias(f"m{k}") for k in range(count)])
    steps = points.select("class_id", "range", "mask", *[F.max(f"p{k}").over(onward).alias(f"e{k}") for k in range(count)]).join(F.broadcast(later), ["class_id", "range"])
    return steps.groupBy("class_id").agg(F.array(*[F.sum(F.getbit("mask", F.lit(count - 1 - k)) * F.greatest(f"e{k}", f"m{k}")) for k in range(count)]).alias("areas"))


def average_precision(scored: DataFrame, ground_truth: DataFrame, count: int = 1) -> DataFrame:
    """``class_id, ap`` of the classes that have ground truth and detections: for each of ``count`` thresholds, each hit's step of recall times the best precision from there on."""
    rows = _areas(_ranked(scored, count)[0], count).join(_positives(ground_truth), "class_id")
    return rows.select("class_id", F.transform("areas", lambda a: a / F.col("positives")).alias("ap"))


def per_class(detections: DataFrame, ground_truth: DataFrame, names: dict[int, str] | None = None, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """The metrics of classes after one matching for all thresholds."""
    return class_metrics(hits(detections, ground_truth, thresholds), ground_truth, len(thresholds), names)


def class_metrics(scored: DataFrame, ground_truth: DataFrame, count: int = 1, names: dict[int, str] | None = None) -> DataFrame:
    """``class_id, class_name, instances, precision, recall, AP50, AP50_95`` of the classes that have ground truth or detections; ``instances`` is null without ground truth.

    Precision and recall are those at the first of ``count`` thresholds with all detections; ``AP50`` is at the first, ``AP50_95`` the mean of all.
    """
    points, sums = _ranked(scored, count)
    found = sums.groupBy("class_id").agg(F.sum("s0").alias("tp"), F.sum("n").alias("n"))
    rows = _positives(ground_truth).join(found, "class_id", "full").join(_areas(points, count), "class_id", "left")
    name = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("class_id")) if names else F.lit(None).cast("string")
    ratio = lambda above, below: F.coalesce(above / F.nullif(F.col(below), F.lit(0)), F.lit(0.0))
    mean = F.aggregate("areas", F.lit(0.0), lambda a, x: a + x / F.col("positives")) / count
    return rows.select("class_id", name.alias("class_name"), F.col("positives").cast("int").alias("instances"), ratio(F.col("tp"), "n").alias("precision"), ratio(F.col("tp"), "positives").alias("recall"), ratio(F.get("areas", F.lit(0)), "positives").alias("AP50"), F.coalesce(mean, F.lit(0.0)).alias("AP50_95"))


def mean_average_precision(detections: DataFrame, ground_truth: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> dict[str, float]:
    """AP50 and AP50-95 over the classes that have ground truth."""
    means = per_class(detections, ground_truth, None, thresholds).filter("instances is not null").agg(F.avg("AP50").alias("a"), F.avg("AP50_95").alias("b")).first()
    return {"mAP50": means.a or 0.0, "mAP50_95": means.b or 0.0}


def precision_recall(compared: DataFrame) -> DataFrame:
    """Overall precision and recall from the statuses of a comparison."""
    n = {s: F.count_if(F.col("status") == s) for s in ("true_positive", "class_error", "false_positive", "false_negative")}
    found, wrong, extra, lost = n.values()
    return compared.agg((found / F.nullif(found + wrong + extra, F.lit(0))).alias("precision"), (found / F.nullif(found + wrong + lost, F.lit(0))).alias("recall"))
