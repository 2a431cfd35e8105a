"""Ranks and average precision in stretches of the whole order."""

from pyspark.sql import functions as F

from gridloom.operators import evaluation
from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_one_confidence_is_many_tasks(spark, monkeypatch):
    """A class whose detections all have one confidence is cut, and ranks, hits and areas are those of the whole order."""
    monkeypatch.setattr(evaluation, "ROWS", 25, raising=False)
    taken = {(c, k): [int((k * 7 + c) % 3 == 0), int((k * 5 + c) % 4 == 0)] for c in (1, 2) for k in range(120 if c == 1 else 30)}
    rows = [("i", f"{k:03}", c, 0.5 if c == 1 else (k % 10) / 10, h) for (c, k), h in taken.items()]
    scored = spark.createDataFrame(rows, "image_id string, detection_id string, class_id int, confidence double, hits array<int>")
    points, sums = evaluation._ranked(scored, 2)
    assert sums.filter("class_id = 1").count() > 2
    assert sums.agg(F.max("n")).first()[0] < 100
    order = {c: [k for _, k in sorted((-(0.5 if c == 1 else (k % 10) / 10), k) for d, k in taken if d == c)] for c in (1, 2)}
    so_far = {c: [(n, *[sum(taken[c, k][t] for k in order[c][:n]) for t in (0, 1)]) for n in range(1, len(order[c]) + 1)] for c in order}
    assert {c: sorted((r["rank"], r.t0, r.t1) for r in points.collect() if r.class_id == c) for c in (1, 2)} == so_far
    truth = spark.createDataFrame([(c,) for c in (1, 2) for _ in range(60)], "class_id int")
    for r in evaluation.average_precision(scored, truth, 2).collect():
        hit = [[taken[r.class_id, k][t] for k in order[r.class_id]] for t in (0, 1)]
        precision = [[sum(h[: n + 1]) / (n + 1) for n in range(len(h))] for h in hit]
        assert [round(a, 9) for a in r.ap] == [round(sum(x * max(p[n:]) for n, x in enumerate(h)) / 60, 9) for h, p in zip(hit, precision, strict=True)]


def test_a_stretch_is_a_task(spark, monkeypatch):
    """Stretches don't meet in a task, so its rows are bounded whatever the size of the table."""
    monkeypatch.setattr(evaluation, "ROWS", 25, raising=False)
    scored = spark.range(500).select(F.lit("i").alias("image_id"), F.col("id").alias("detection_id"), F.lit(1).alias("class_id"), (F.col("id") % 10 / 10).alias("confidence"), F.array(F.lit(1)).alias("hits"))
    points, _ = evaluation._ranked(scored, 1)
    tasks = points.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("range").alias("stretches")).collect()
    assert len(tasks) > 10
    assert {t.stretches for t in tasks} == {1}


def test_numbering_has_tasks_as_rows_ask_for(spark, monkeypatch):
    """Line items are numbered in more tasks than the session has partitions, with the same numbers; what needs no numbers deals nothing."""
    whole = sorted(catalogue.lines(spark, SF).collect())
    monkeypatch.setattr(evaluation, "ROWS", 200, raising=False)
    dealt = catalogue.lines(spark, SF)
    assert sorted(dealt.collect()) == whole
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) < 600
    assert "Exchange" not in catalogue.boxes(spark, SF, numbered=False)._jdf.queryExecution().toString()
