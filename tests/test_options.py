"""Settings that reach a run: thresholds, batches, guards, names, and what a run says of itself."""

import json

import pytest
import yaml

from gridloom.jobs import cli, runs
from gridloom.operators import constraints, prediction
from gridloom.operators.constraints import ConstraintError
from gridloom.plans import jobs
from gridloom.schemas import CLASS_NAMES
from gridloom.sinks import files as sinks
from tests.test_files import png


class Crowd:
    """Three boxes of a class on one place, one of another class, one that is weak; as many images a call as it was told."""

    names, device = dict(enumerate(CLASS_NAMES)), "stub:0"

    def __init__(self, checkpoint=None):
        self.batch = None

    def configure(self, options):
        self.batch = options.batch

    def predict(self, paths):
        assert self.batch is None or len(paths) <= self.batch
        near = [(1.0, 1.0, 5.0, 5.0), (1.0, 1.0, 5.0, 5.5), (1.0, 1.0, 5.0, 6.0), (1.0, 1.0, 5.0, 5.0), (6.0, 6.0, 9.0, 9.0)]
        return [prediction.Found(10, 10, near, [0, 0, 0, 1, 0], [0.5, 0.9, 0.7, 0.6, 0.2]) for _ in paths]


@pytest.fixture
def tree(tmp_path):
    for k in range(1, 6):
        png(tmp_path / "set" / "positive image set" / f"{k:03}.png", 10, 10)
        png(tmp_path / "set" / "negative image set" / f"{k:03}.png", 10, 10)
        (tmp_path / "set" / "ground truth").mkdir(exist_ok=True)
        (tmp_path / "set" / "ground truth" / f"{k:03}.txt").write_text("(1,1),(5,5),1\n")
    return tmp_path / "set"


def settings(tree, **inference):
    return {"run": {"name": "r"}, "detector": {"backend": "ultralytics", "loader": "tests.test_options:Crowd", "checkpoint": "model.pt"}, "source": {"path": str(tree / "positive image set"), "dataset_id": " my set! ", "split": " External "}, "inference": {"confidence": 0.05, "iou": 0.7, "batch": 2, "imgsz": 640, "device": 0} | inference, "outputs": {"root": "runs"}, "ground_truth": {"format": "nwpu", "path": str(tree / "ground truth")}}


@pytest.mark.parametrize(("asked", "each"), [({}, 3), ({"confidence": 0.3}, 2), ({"iou": 1.0}, 5), ({"confidence": 0.65, "iou": 1.0}, 2), ({"confidence": 0.95}, 0)])
def test_thresholds_of_the_settings(spark, tree, tmp_path, asked, each):
    out = jobs.export_by_settings(spark, settings(tree, **asked), tmp_path, Crowd, Crowd.names)
    assert (out["images"], out["detections"]) == (5, 5 * each)
    folder = tmp_path / "runs" / "r_my_set_external"
    assert out["folder"] == str(folder)
    said = json.loads((folder / "inference_metadata.json").read_text())
    assert said["iou"] == asked.get("iou", 0.7) and said["devices"] == {"stub:0": 5} and said["speed_ms_per_image"]["inference"] >= 0
    assert (said["ground_truth_matched_files"], said["manifest_unmatched_images"]) == (5, 5)
    assert (folder / "tables" / "detections.csv").is_file()
    rows = spark.read.parquet(f"{folder}/tables/detections.parquet").orderBy("detection_id").collect()
    assert len(rows) == 5 * each and all(a.confidence >= b.confidence for a, b in zip(rows, rows[1:], strict=False) if a.image_id == b.image_id)


def test_options_of_a_section():
    assert prediction.Options.of({}) == prediction.Options(0.25, 0.7, 640, 16, None)
    assert prediction.Options.of({"confidence": 0, "iou": 0.1, "imgsz": 32, "batch": 1, "device": 0}) == prediction.Options(0, 0.1, 32, 1, "0")
    assert prediction.Options.of({"imgsz": 64}, confidence=0.001).confidence == 0.001


@pytest.mark.parametrize("split", ["test", "TEST", " test", "Test\n"])
def test_no_spelling_passes_the_guard(spark, tree, split):
    calls = []
    with pytest.raises(ConstraintError, match="allow_test"):
        jobs.export_predictions(spark, str(tree / "positive image set"), "d", lambda: calls.append(1), {}, "/nowhere", split=split)
    assert not calls
    images = spark.createDataFrame([("a",), ("b",)], "path string")
    manifest = spark.createDataFrame([("a", split), ("b", "train")], "path string, split string")
    assert [r.path for r in constraints.held_out(images, manifest, "path").collect()] == ["a"]
    assert constraints.held_out(images, manifest, "path", allow_test=True).collect() == []


def test_negative_images_take_no_label_of_one_file(spark, tree, tmp_path):
    truth = str(tree / "ground truth" / "001.txt")
    run = lambda kind, out: jobs.export_predictions(spark, str(tree / kind / "002.png"), "d", Crowd, Crowd.names, f"{tmp_path}/{out}", truth=truth, truth_format="nwpu", options=prediction.Options())
    assert run("negative image set", "n")["ground_truths"] == 0 and run("positive image set", "p")["ground_truths"] == 1


def test_paths_with_a_scheme(spark, tree, tmp_path):
    out = jobs.export_predictions(spark, f"file:{tree}/positive image set", "d", Crowd, Crowd.names, f"{tmp_path}/out", truth=f"{tree}/ground truth", truth_format="nwpu", options=prediction.Options())
    assert (out["class_error"], out["false_positive"], out["false_negative"]) == (5, 5, 0)


def test_free_prediction(spark, tree, tmp_path):
    (tmp_path / "model.pt").write_text("")
    own = {"experiment": {"name": "e", "seed": 1}, "data": {"adapter": "nwpu"}, "split": {"strategy": "multilabel", "train": 0.6, "val": 0.2, "test": 0.2}, "export": {"format": "yolo"}, "classes": [*CLASS_NAMES], "model": {}, "training": {}, "evaluation": {"split": "val"}, "prediction": {"confidence": 0.25, "iou": 0.7, "imgsz": 640}, "outputs": {"prediction_root": "predicted"}}
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(own | {"detector": settings(tree)["detector"]}))
    folder = cli.main(["predict", "--config", str(tmp_path / "a.yaml"), "--root", str(tmp_path), "--source", str(tree)])
    assert spark.read.parquet(f"{folder}/detections").count() == 10 * 2
    said = json.loads((folder / "prediction_metadata.json").read_text())
    assert (said["confidence"], said["iou"], said["devices"]) == (0.25, 0.7, {"stub:0": 10})


def test_single_files_are_whole_or_absent(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "é,\"x\"")], "a int, b string").orderBy("a")
    sinks.write_csv(df, f"{tmp_path}/t.csv")
    assert (tmp_path / "t.csv").read_bytes().decode().split("\r\n") == ["a,b", '1,"é,\\"x\\""', "2,", ""]
    with pytest.raises(FileExistsError):
        sinks.write_csv(df, f"{tmp_path}/t.csv")
    sinks.write_csv(df.limit(0), f"{tmp_path}/t.csv", overwrite=True)
    with pytest.raises(Exception):
        sinks.write_csv(df.selectExpr("raise_error('no') AS a"), f"{tmp_path}/u.csv")
    assert not (tmp_path / "u.csv").exists() and not [p for p in tmp_path.iterdir() if p.is_dir()]


def test_safe_components():
    assert runs.safe_component(" a b/c. ") == "a_b_c"
    with pytest.raises(ValueError, match="folder"):
        runs.safe_component("..")


@pytest.mark.parametrize("spelled", ["test", "TEST", " Test "])
def test_evaluation_of_test_images_needs_confirmation_however_it_is_spelled(spelled):
    with pytest.raises(ConstraintError, match="confirm_test"):
        jobs.evaluate(None, None, spelled)
