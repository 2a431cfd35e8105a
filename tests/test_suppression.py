"""Suppression against a plain loop, and rows that lack a key."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import suppression


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def plain(boxes, confidence, most, by_class=True):
    """``(corners, class, confidence, id)`` that stay, by falling confidence."""
    kept = []
    for box in sorted((b for b in boxes if b[2] is not None and b[2] > confidence), key=lambda b: (-b[2], b[3])):
        if not any((not by_class or box[1] == k[1]) and overlap(box[0], k[0]) > most for k in kept):
            kept.append(box)
    return kept


def some_boxes(rng, n):
    def box():
        x, y = rng.randint(0, 12), rng.randint(0, 12)
        return float(x), float(y), float(x + rng.randint(0, 9)), float(y + rng.randint(0, 9))

    return [(box(), rng.randint(0, 2), rng.choice([0.1, 0.3, 0.3, 0.5, 0.9, None]), f"d{k:03}") for k in range(n)]


SCHEMA = "image_id string, detection_id string, predicted_class_id int, confidence double, xmin double, ymin double, xmax double, ymax double, box map<string,int>"


@pytest.mark.parametrize(("confidence", "most", "by_class"), [(0.2, 0.3, True), (0.0, 0.0, True), (0.3, 1.0, True), (0.0, 0.2, False)])
def test_rows_as_a_plain_loop(spark, confidence, most, by_class):
    rng = random.Random(4)
    images = {f"i{k}": some_boxes(rng, rng.randint(0, 25)) for k in range(30)}
    rows = [(i, d, c, p, *b, {"x": 1}) for i, boxes in images.items() for b, c, p, d in boxes]
    alone = [(None, "n", 0, 0.9, 0.0, 0.0, 5.0, 5.0, None), (None, "n", 0, 0.9, 0.0, 0.0, 5.0, 5.0, None), (None, "weak", 0, 0.0, 0.0, 0.0, 5.0, 5.0, None)]
    df = spark.createDataFrame(rows + alone, SCHEMA)
    out = suppression.suppressed(df.repartition(5), confidence, most, by_class)
    assert out.columns == df.columns
    want = sorted((i, b[3]) for i, boxes in images.items() for b in plain(boxes, confidence, most, by_class))
    assert sorted((r.image_id, r.detection_id) for r in out.filter("image_id is not null").collect()) == want
    assert out.filter("image_id is null").count() == 2
    again = suppression.suppressed(out, confidence, most, by_class)
    assert again.count() == out.count()


def test_arrays_as_a_plain_loop(spark):
    rng = random.Random(5)
    images = [some_boxes(rng, n) for n in (0, 1, 2, 9, 30)]
    box = "array<struct<xmin:double,ymin:double,xmax:double,ymax:double,class_id:int,confidence:double>>"
    df = spark.createDataFrame([(k, [(*b, c, p) for b, c, p, _ in boxes]) for k, boxes in enumerate(images)], f"k int, boxes {box}")
    out = df.select("k", suppression.kept_boxes(F.col("boxes"), 0.2, 0.3).alias("kept"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        assert [tuple(b) for b in r.kept] == [(*b, c, p) for b, c, p, _ in plain(images[r.k], 0.2, 0.3)]


def test_unusual_values(spark):
    df = spark.createDataFrame([("i", "a", None, 0.9, 0.0, 0.0, 5.0, 5.0, None), ("i", "b", None, 0.8, 0.0, 0.0, 5.0, 5.0, None), ("i", "c", 1, float("nan"), 0.0, 0.0, 5.0, 5.0, None), ("i", "d", 1, None, 0.0, 0.0, 5.0, 5.0, None)], SCHEMA)
    assert sorted(r.detection_id for r in suppression.suppressed(df, 0.0, 0.5).collect()) == ["a", "b"]
    assert suppression.suppressed(df.limit(0), 0.5, 0.5).collect() == []
    for bad in ((-0.1, 0.5), (0.5, 1.1)):
        with pytest.raises(ValueError, match="thresholds"):
            suppression.suppressed(df, *bad)
