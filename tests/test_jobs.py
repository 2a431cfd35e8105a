"""Settings, job records and archives."""

import json
import zipfile

import pytest

from gridloom.jobs import config, runs

GOOD = {"run": {"name": "r"}, "detector": {"checkpoint": "c", "backend": "ultralytics"}, "source": {"path": "p", "dataset_id": "d"}, "inference": {"confidence": 0.1, "iou": 0.7}, "outputs": {"root": "o"}}


def test_environment_names(tmp_path, monkeypatch):
    (tmp_path / "a.yaml").write_text("a: ['${ONE}/x']\nb: {c: '${TWO}'}\n")
    with pytest.raises(config.ConfigError, match="ONE, TWO"):
        config.load(tmp_path / "a.yaml")
    monkeypatch.setenv("ONE", "1")
    monkeypatch.setenv("TWO", "2")
    loaded = config.load(tmp_path / "a.yaml")
    assert loaded["a"] == ["1/x"] and loaded["b"] == {"c": "2"}
    assert "_config_path" not in config.save(loaded, tmp_path / "b.yaml").read_text()


@pytest.mark.parametrize(("change", "message"), [({"inference": {"confidence": 2, "iou": 0.7}}, "inference.confidence"), ({"ground_truth": {"format": "x", "path": "p"}}, "ground_truth.format"), ({"ground_truth": {"format": "yolo", "path": "p", "iou_threshold": 0}}, "iou_threshold"), ({"source": {"path": "p", "dataset_id": "d", "manifest": "m"}}, "dataset_root"), ({"run": {}}, "run.name")])
def test_prediction_rules(change, message):
    assert config.inference_rules(GOOD) == []
    with pytest.raises(config.ConfigError, match=message):
        config.checked(GOOD | change, config.inference_rules)


def test_training_rules():
    good = {"experiment": {}, "model": {}, "training": {}, "prediction": {}, "outputs": {}, "data": {"adapter": "nwpu"}, "export": {"format": "yolo"}, "classes": ["x"] * 10, "detector": {"backend": "ultralytics"}, "evaluation": {"split": "val"}, "split": {"train": 0.7, "val": 0.15, "test": 0.15, "strategy": "multilabel"}}
    assert config.detection_rules(good) == []
    assert config.detection_rules(good | {"split": {"train": 0.7, "val": 0.3, "test": 0.15, "strategy": "multilabel"}}) == ["split: the ratios [0.7, 0.3, 0.15] sum to 1"]
    assert config.detection_rules({k: v for k, v in good.items() if k != "model"}) == ["section model is needed"]
    assert [b.split(":")[0] for b in config.detection_rules(good | {"detector": {"backend": "x"}, "data": {}})] == ["detector.backend", "data.adapter"]


def test_settings_of_a_dataset(tmp_path):
    folder = tmp_path / "configs" / "datasets"
    folder.mkdir(parents=True)
    (folder / "a.yaml").write_text("dataset: {name: a}\nclasses: [x]\nextensions: [.jpg]\n")
    (folder / "b.yaml").write_text("dataset: {name: b}\n")
    assert config.load_dataset("a", tmp_path)["classes"] == ["x"]
    with pytest.raises(config.ConfigError, match="classes"):
        config.load_dataset("b", tmp_path)
    with pytest.raises(FileNotFoundError):
        config.load_dataset("c", tmp_path)


def test_job_states(tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("JOB_LOG_ROOT", str(tmp_path))
    assert runs.logged("job", lambda: print("said") or 7) == 7
    with pytest.raises(SystemExit):
        runs.logged("bad", lambda: 1 / 0)
    states = {p.parts[-3]: json.loads(p.read_text()) for p in tmp_path.glob("*/*/job.json")}
    assert (states["job"]["status"], states["bad"]["status"], states["bad"]["exit_code"]) == ("succeeded", "failed", 1)
    assert "said" in next(tmp_path.glob("job/*/run.log")).read_text() and "ZeroDivisionError" in next(tmp_path.glob("bad/*/run.log")).read_text()


def test_archives_stay_inside(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.txt", "x")
    assert (runs.extract(tmp_path / "a.zip", tmp_path / "out") / "in/x.txt").read_text() == "x"
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        runs.extract(tmp_path / "b.zip", tmp_path / "out")
