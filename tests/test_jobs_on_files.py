"""Whole jobs on a small tree."""

import json

import pytest
import yaml

from gridloom.jobs import cli, config
from gridloom.operators import audit, matching, prediction, splits
from gridloom.operators.constraints import ConstraintError
from gridloom.plans import jobs
from gridloom.schemas import CLASS_NAMES
from gridloom.sources import files as sources
from tests.test_files import png


class OneBox:
    names = dict(enumerate(CLASS_NAMES))

    def __init__(self, checkpoint=None):
        pass

    def predict(self, paths):
        return [prediction.Found(10, 10, [(1.0, 1.0, 5.0, 5.0)], [0], [0.9]) for _ in paths]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "set"
    (root / "ground truth").mkdir(parents=True)
    for k in range(1, 21):
        png(root / "positive image set" / f"{k:03}.png", 10, 10)
        png(root / "negative image set" / f"{k:03}.png", 10, 10 + k)
        (root / "ground truth" / f"{k:03}.txt").write_text(f"(1,1),(5,5),{k % 2 + 1}\n")
    return root


def test_prepare(spark, tree, tmp_path):
    report = jobs.prepare(spark, str(tree), f"{tmp_path}/manifest.csv", f"{tmp_path}/export", CLASS_NAMES, splits.SplitConfig(0.6, 0.2, 0.2), f"{tmp_path}/audit.json", {"expected_images": 40, "expected_objects": 20})
    assert report == {"images": 40, "labels": 40, "backgrounds": 20, "objects": 20, "class_counts": {0: 10, 1: 10}, "issues": [], "valid": True}
    profile = jobs.audit_report(spark, str(tree))
    assert profile["objects_per_image"] == {"0": 20, "1": 20} and len(profile["duplicate_groups"]) == 1 and profile["issues"] == []
    with pytest.raises(ConstraintError):
        jobs.check_expected(profile, {"expected_images": 41})


def test_predictions_with_ground_truth(spark, tree, tmp_path):
    source = str(tree / "positive image set")
    out = jobs.export_predictions(spark, source, "d", OneBox, {0: "airplane", 1: "ship"}, f"{tmp_path}/run", truth=str(tree / "ground truth"), truth_format="nwpu")
    assert (out["images"], out["detections"], out["true_positive"], out["class_error"], out["false_negative"]) == (20, 20, 10, 10, 0)
    with pytest.raises(ConstraintError, match="allow_test"):
        jobs.export_predictions(spark, source, "d", OneBox, {0: "airplane"}, f"{tmp_path}/no", split="test")


def test_sources_and_ground_truth_of_one_file(spark, tree, tmp_path):
    image, truth = str(tree / "positive image set" / "001.png"), str(tree / "ground truth" / "001.txt")
    assert [tuple(r) for r in sources.source_images(spark, image).collect()] == [(0, image)]
    assert sources.source_images(spark, f"{tree}/positive image set/00*.png").count() == 9
    with pytest.raises(ValueError, match="supported"):
        sources.source_images(spark, truth)
    with pytest.raises(FileNotFoundError):
        sources.source_images(spark, f"{tree}/none")
    out = jobs.export_predictions(spark, image, "d", OneBox, {0: "airplane", 1: "ship"}, f"{tmp_path}/one", truth=truth, truth_format="nwpu")
    assert (out["images"], out["class_error"]) == (1, 1)
    with pytest.raises(config.ConfigError, match="one image"):
        jobs.export_predictions(spark, str(tree / "positive image set"), "d", OneBox, {0: "airplane"}, f"{tmp_path}/x", truth=truth, truth_format="nwpu")
    with pytest.raises(config.ConfigError, match="coco"):
        jobs.export_predictions(spark, image, "d", OneBox, {0: "airplane"}, f"{tmp_path}/x", truth=truth, truth_format="coco")


def test_commands(spark, tree, tmp_path, capsys, monkeypatch):
    (tmp_path / "model.pt").write_text("")
    settings = {
        "experiment": {"name": "e", "seed": 1}, "model": {}, "training": {}, "prediction": {}, "classes": [*CLASS_NAMES], "detector": {"backend": "ultralytics", "loader": "tests.test_jobs_on_files:OneBox", "checkpoint": "model.pt"},
        "data": {"adapter": "nwpu", "raw_root": str(tree), "archive_path": "none.zip", "audit": {"enabled": True, "reuse_report": True, "fail_on_issues": True, "report_path": "audit.json", "expected_images": 40}},
        "split": {"strategy": "multilabel", "train": 0.6, "val": 0.2, "test": 0.2, "manifest_path": "manifest.csv", "reuse_manifest": True},
        "export": {"format": "yolo", "output_root": "export", "expected_images": 40, "expected_objects": 20, "expected_backgrounds": 20},
        "evaluation": {"split": "val"}, "outputs": {"evaluation_root": "evaluated", "prediction_root": "predicted"},
    }
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(settings))
    monkeypatch.setenv("JOB_LOG_ROOT", str(tmp_path / "logs"))
    common = ["--config", str(tmp_path / "a.yaml"), "--root", str(tmp_path)]
    assert cli.main(["prepare", *common])["images"] == 40 and "Total images: 40" in capsys.readouterr().out
    assert cli.main(["prepare", *common])["objects"] == 20
    folder = cli.main(["evaluate", *common])
    overall = json.loads((folder / "overall_metrics.json").read_text())
    assert overall["split"] == "val" and 0 < overall["mAP50"] <= 1
    rows = (folder / "per_class_metrics.csv").read_text().splitlines()
    assert rows[0].startswith("class_id,class_name,instances") and rows[1].startswith("0,airplane,")
    found = cli.main(["predict", *common, "--source", str(tree / "positive image set")])
    assert spark.read.parquet(f"{found}/detections").count() == 20
    with pytest.raises(SystemExit):
        cli.main(["evaluate", *common, "--checkpoint", "absent.pt"])
    with pytest.raises(ValueError, match="delete"):
        jobs.clear_export("/")
    run = {"run": {"name": "r"}, "detector": settings["detector"], "source": {"path": str(tree / "positive image set"), "dataset_id": "d"}, "inference": {"confidence": 0.1, "iou": 0.7}, "outputs": {"root": "runs"}, "ground_truth": {"format": "nwpu", "path": str(tree / "ground truth")}}
    (tmp_path / "b.yaml").write_text(yaml.safe_dump(run))
    done = cli.main(["export", "--config", str(tmp_path / "b.yaml"), "--root", str(tmp_path)])
    assert (done["images"], done["true_positive"]) == (20, 10)
    states = [json.loads(p.read_text())["status"] for p in (tmp_path / "logs").glob("*/*/job.json")]
    assert sorted(states) == ["failed", *["succeeded"] * 5]


def test_inventory_and_sample(spark, tree):
    files = sources.listing(spark, str(tree))
    assert {(r.kind, r.stem): r.n for r in audit.inventory(files).collect()} == {("other", "numeric"): 40, ("txt", "numeric"): 20}
    assert audit.first_files(files, 3).count() == 3
    assert audit.seeded_sample(files, "path").collect() == audit.seeded_sample(files.repartition(3), "path").collect()


def test_ids_that_two_images_share(spark):
    box = {"xmin": 0.0, "ymin": 0.0, "xmax": 10.0, "ymax": 10.0}
    d = spark.createDataFrame([{"image_id": i, "detection_id": "d", "predicted_class_id": 0, **box} for i in ("a", "b")])
    g = spark.createDataFrame([{"image_id": "a", "ground_truth_id": "g", "class_id": 0, **box}])
    assert {(r.image_id, r.status) for r in matching.comparisons(d, g).collect()} == {("a", "true_positive"), ("b", "false_positive")}
    assert [r.image_id for r in matching.false_positives(d, matching.matches(d, g)).collect()] == ["b"]
