"""Matching: the four statuses, ties, thresholds, and images with one side only."""

import pytest

from gridloom.operators import matching

DET = "image_id string, detection_id string, predicted_class_id int, xmin double, ymin double, xmax double, ymax double"
GT = "image_id string, ground_truth_id string, class_id int, xmin double, ymin double, xmax double, ymax double"


def compare(spark, det, gt, threshold=0.5):
    out = matching.comparisons(spark.createDataFrame(det, DET), spark.createDataFrame(gt, GT), threshold)
    return {(r.detection_id, r.ground_truth_id): (r.status, r.iou) for r in out.collect()}


def test_four_statuses(spark):
    det = [("i", "d1", 0, 0.0, 0.0, 10.0, 10.0), ("i", "d2", 9, 20.0, 20.0, 30.0, 30.0), ("i", "d3", 0, 40.0, 40.0, 50.0, 50.0)]
    gt = [("i", "g1", 0, 0.0, 0.0, 10.0, 10.0), ("i", "g2", 1, 20.0, 20.0, 30.0, 30.0), ("i", "g3", 2, 60.0, 60.0, 70.0, 70.0)]
    assert compare(spark, det, gt) == {("d1", "g1"): ("true_positive", 1.0), ("d2", "g2"): ("class_error", 1.0), ("d3", ""): ("false_positive", None), ("", "g3"): ("false_negative", None)}


def test_ties_go_by_id_and_threshold_counts(spark):
    det = [("i", "d2", 0, 0.0, 0.0, 10.0, 10.0), ("i", "d1", 0, 0.0, 0.0, 10.0, 10.0), ("j", "d3", 0, 0.0, 0.0, 10.0, 10.0)]
    gt = [("i", "g1", 0, 0.0, 0.0, 10.0, 10.0), ("k", "g2", 0, 0.0, 0.0, 10.0, 10.0)]
    assert compare(spark, det, gt, 1.0) == {("d1", "g1"): ("true_positive", 1.0), ("d2", ""): ("false_positive", None), ("d3", ""): ("false_positive", None), ("", "g2"): ("false_negative", None)}


def test_boxes_without_area_never_match(spark):
    assert compare(spark, [("i", "d", 0, 1.0, 1.0, 1.0, 1.0)], [("i", "g", 0, 1.0, 1.0, 1.0, 1.0)]) == {("d", ""): ("false_positive", None), ("", "g"): ("false_negative", None)}


def test_threshold_must_be_a_share(spark):
    with pytest.raises(ValueError):
        matching.candidate_pairs(spark.createDataFrame([], DET), spark.createDataFrame([], GT), 0.0)


def test_empty_tables_have_all_statuses(spark):
    out = matching.comparisons(spark.createDataFrame([], DET), spark.createDataFrame([], GT))
    assert {r.status: r.n for r in matching.status_counts(out).collect()} == dict.fromkeys(("true_positive", "class_error", "false_positive", "false_negative"), 0)


def test_rows_without_image_or_id_stay_and_match_nothing(spark):
    det = [(None, "d1", 0, 0.0, 0.0, 10.0, 10.0), ("i", None, 0, 0.0, 0.0, 10.0, 10.0)]
    gt = [(None, "g1", 0, 0.0, 0.0, 10.0, 10.0), ("i", "g2", 0, 0.0, 0.0, 10.0, 10.0)]
    nothing = {("d1", ""): ("false_positive", None), ("", "g1"): ("false_negative", None)}
    assert compare(spark, det, gt) == nothing | {(None, ""): ("false_positive", None), ("", "g2"): ("false_negative", None)}


def test_numbers_follow_matches_then_each_side(spark):
    det = [("i", "d2", 0, 0.0, 0.0, 10.0, 10.0), ("i", "d1", 0, 50.0, 50.0, 60.0, 60.0)]
    gt = [("i", "g1", 0, 0.0, 0.0, 10.0, 10.0), ("i", "g0", 0, 80.0, 80.0, 90.0, 90.0)]
    rows = matching.comparisons(spark.createDataFrame(det, DET), spark.createDataFrame(gt, GT)).orderBy("comparison_id").collect()
    assert [(r.comparison_id, r.detection_id, r.ground_truth_id) for r in rows] == [("i_cmp_0000", "d2", "g1"), ("i_cmp_0001", "d1", ""), ("i_cmp_0002", "", "g0")]
    with pytest.raises(ValueError):
        matching.comparisons(spark.createDataFrame(det, DET), spark.createDataFrame(gt, GT), 0.0)
