"""Commands: ``python -m gridloom.jobs.cli prepare|evaluate|export|predict --config settings.yaml``.

A detector is named in the settings as ``detector.loader``, ``module:function``: called with the checkpoint, it gives an object with ``names``
and ``predict(paths)``. Training is out of scope.
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable, Sequence
from functools import partial
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from gridloom.jobs import config, runs
from gridloom.operators import audit, prediction
from gridloom.operators.prediction import Detector
from gridloom.plans import jobs
from gridloom.session import ship


def named_detector(loader: str, checkpoint: str) -> Detector:
    """Made in the worker that uses it."""
    module, _, function = loader.partition(":")
    return getattr(importlib.import_module(module), function)(checkpoint)


def detector_of(settings: dict, root: Path, checkpoint: str | None) -> tuple[Callable[[], Detector], dict[int, str]]:
    """How workers load the detector, and its classes; the checkpoint must exist."""
    given = checkpoint or settings["detector"].get("checkpoint")
    if not given:
        raise config.ConfigError("detector.checkpoint: is needed")
    at = config.resolved(given, root)
    if not at.is_file():
        raise FileNotFoundError(f"no checkpoint at {at}")
    if not settings["detector"].get("loader"):
        raise config.ConfigError("detector.loader: is needed, as module:function")
    settings["detector"]["checkpoint"] = str(at)
    load = partial(named_detector, settings["detector"]["loader"], str(at))
    return load, dict(load().names)


def run(spark: SparkSession, args: argparse.Namespace) -> Any:
    root = Path(args.root).resolve()
    settings = config.load(args.config, "inference" if args.command == "export" else "detection")
    if args.command == "prepare":
        done = jobs.prepare_by_settings(spark, settings, root, args.force)
        report = config.resolved(settings["data"]["audit"]["report_path"], root)
        if report.is_file():
            print(audit.summary(json.loads(report.read_text(encoding="utf-8"))))
        return done
    load, names = detector_of(settings, root, args.checkpoint)
    if args.command == "evaluate":
        return jobs.evaluate_by_settings(spark, settings, root, load, names, args.confirm_test)
    if args.command == "export":
        return jobs.export_by_settings(spark, settings, root, load, names)
    if not args.source:
        raise config.ConfigError("--source: is needed")
    out = jobs.new_folder(config.resolved(settings["outputs"]["prediction_root"], root), f"{settings['experiment']['name']}_predict")
    return jobs.predict_free(spark, args.source, load, names, out, prediction.Options.of(settings["prediction"]))


def arguments(given: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="gridloom", description="Jobs over detection datasets.")
    parser.add_argument("command", choices=("prepare", "evaluate", "export", "predict"))
    parser.add_argument("--config", required=True, help="settings, as YAML")
    parser.add_argument("--root", default=".", help="where relative paths of the settings begin")
    parser.add_argument("--checkpoint", help="instead of the settings' one")
    parser.add_argument("--source", help="an image, a folder or a glob (predict)")
    parser.add_argument("--force", action="store_true", help="make anew what is there (prepare)")
    parser.add_argument("--confirm-test", action="store_true", help="needed to evaluate the test split")
    return parser.parse_args(given)


def main(given: Sequence[str] | None = None) -> Any:
    args = arguments(given)
    spark = SparkSession.builder.appName(f"gridloom {args.command}").getOrCreate()
    ship(spark)
    done = runs.logged(f"gridloom-{args.command}", partial(run, spark, args), spark)
    print(done if isinstance(done, Path) else json.dumps(done, indent=2))
    return done


if __name__ == "__main__":
    main()
