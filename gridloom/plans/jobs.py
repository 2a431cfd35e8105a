"""Whole jobs: prepare a dataset, export a prediction run's tables, evaluate them."""

from __future__ import annotations

import csv
import json
import shutil
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import staging
from gridloom.functions import text
from gridloom.jobs import config, runs
from gridloom.operators import audit, constraints, evaluation, matching, prediction, splits
from gridloom.sinks import files as sinks
from gridloom.sources import archives
from gridloom.sources import files as sources

#: Boxes of more than this confidence are evaluated, where the settings say nothing: nearly all, so that curves reach high recall.
EVALUATED = 0.001


#: Figures of a report that are one number, and those that are a number by key.
TOTALS = ("total_images", "positive_images", "background_images", "readable_images", "total_objects")
COUNTS = ("class_counts", "size_counts", "dimension_counts", "mode_counts", "objects_per_image")


def audit_tables(spark: SparkSession, root: str, held: str) -> dict[str, DataFrame]:
    """``profile``, ``duplicates``, ``issues`` and ``box_records`` of a source tree. Files are read once, into tables below ``held``."""
    items = staging.staged(sources.discover_items(sources.listing(spark, root)), f"{held}/items")
    images = staging.staged(sources.image_headers(spark, root), f"{held}/images").withColumnRenamed("path", "image_path")
    parsed = staging.staged(sources.parsed_annotations(sources.annotation_lines(sources.contents(spark, root, "*.txt"))), f"{held}/parsed")
    sized = items.join(images, "image_path")
    boxes = sources.annotation_boxes(parsed).join(sized.filter("not is_background").select("annotation_path", "image_path", "width", "height"), "annotation_path")
    measured = staging.staged(audit.measured(boxes), f"{held}/measured")
    readable, bad = sized.filter("width >= 0"), sources.annotation_errors(parsed).withColumnRenamed("path", "annotation_path")
    counted = readable.filter("is_background or annotation_path is not null").join(bad, "annotation_path", "left_anti")
    return {
        "profile": audit.profile(sized, measured, audit.objects_per_image(counted, measured)),
        "duplicates": readable.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("ordinal", "image_path"))).alias("l")).filter(F.size("l") > 1).select("sha256", F.transform("l", lambda x: x["image_path"]).alias("members")),
        "issues": audit.item_issues(items, images.select("image_path", "width"), bad).unionByName(audit.box_issues(measured)),
        "box_records": audit.box_records(measured),
    }


def audit_report(spark: SparkSession, root: str, tables: str | None = None) -> dict:
    """The profile of a source tree: totals, histograms, duplicate groups, issues and box records; the last three also as Parquet below ``tables``.

    The report is one JSON document, so its lists come to the driver; data sets whose boxes don't fit there are read from the tables.
    """
    with staging.scratch(spark) as held:
        found = audit_tables(spark, root, held)
        if tables:
            for name in ("duplicates", "issues", "box_records"):
                found[name].write.mode("overwrite").parquet(f"{tables}/{name}")
        counts = {figure: {} for figure in (*TOTALS, *COUNTS)}
        for r in found["profile"].collect():
            counts[r.figure][r.key] = r.n
        in_order = lambda own: dict(sorted(own.items(), key=lambda kv: (not (kv[0] or "").isdigit(), int(kv[0]) if (kv[0] or "").isdigit() else 0, kv[0] or "")))
        return {k: counts[k].get("", 0) for k in TOTALS} | {k: in_order(counts[k]) for k in COUNTS} | {
            "duplicate_groups": sorted(r.members for r in found["duplicates"].collect()),
            "issues": [r.asDict() for r in found["issues"].orderBy("image", "type", "message").collect()],
            "box_records": [r.asDict() for r in found["box_records"].orderBy("image", "xmin", "ymin", "xmax", "ymax").collect()],
        }


def check_expected(report: dict, expected: dict) -> None:
    """Totals that the settings name must be those of the report."""
    for key, name in (("total_images", "expected_images"), ("total_objects", "expected_objects"), ("background_images", "expected_backgrounds")):
        want = expected.get(name)
        if want is not None and report[key] != want:
            raise constraints.ConstraintError(f"expected {want} for {key}, found {report[key]}")


def reusable_report(spark: SparkSession, root: str, path: str | Path, reuse: bool) -> dict:
    """The report at ``path`` if it may be reused and is there, else a new one, written there."""
    at = Path(path)
    if reuse and at.is_file():
        return json.loads(at.read_text(encoding="utf-8"))
    profile = audit_report(spark, root)
    runs.write_json(profile, at)
    return profile


def clear_export(path: str | Path) -> None:
    """Delete an earlier export; the root of a store, and a folder that this process or its user lives in, are refused."""
    at = Path(path).resolve()
    if at == Path(at.anchor) or at in (Path.home().resolve(), Path.cwd().resolve(), *Path.home().resolve().parents, *Path.cwd().resolve().parents):
        raise ValueError(f"not a folder to delete: {at}")
    shutil.rmtree(at)


def prepare_by_settings(spark: SparkSession, settings: dict, root: str | Path, force: bool = False) -> dict:
    """Unpack if need be, audit, check, split, export and validate as the settings say; what is there is reused unless forced."""
    place = lambda value: str(config.resolved(value, root))
    data, split, export = settings["data"], settings["split"], settings["export"]
    raw, out, check = place(data["raw_root"]), place(export["output_root"]), data["audit"]
    if not sources.has_items(spark, raw):
        archives.unpack(spark, place(data["archive_path"]), raw)
    if check["enabled"]:
        profile = reusable_report(spark, raw, place(check["report_path"]), bool(check.get("reuse_report")) and not force)
        check_expected(profile, check)
        if check["fail_on_issues"] and profile["issues"]:
            raise constraints.ConstraintError(f"the audit found {len(profile['issues'])} issues")
    there = Path(out).exists() and any(Path(out).iterdir())
    if there and force:
        clear_export(out)
    if force or not there:
        shares = splits.SplitConfig(split["train"], split["val"], split["test"], settings["experiment"]["seed"])
        ensure_manifest(spark, raw, place(split["manifest_path"]), shares, force=force or not split.get("reuse_manifest", True))
        export_tree(spark, raw, place(split["manifest_path"]), out, tuple(settings["classes"]))
    return validated(spark, out, **{k: export.get(k) for k in ("expected_images", "expected_objects", "expected_backgrounds")})


def dataset_yaml(settings: dict, root: str | Path) -> Path:
    """The description of the prepared dataset, which must be there."""
    at = config.resolved(settings["export"]["output_root"], root) / "dataset.yaml"
    if not at.is_file():
        raise FileNotFoundError(f"the dataset isn't prepared: {at}")
    return at


def _source_boxes(spark: SparkSession, root: str) -> DataFrame:
    return sources.annotation_boxes(sources.parsed_annotations(sources.annotation_lines(sources.contents(spark, root, "*.txt"))))


def ensure_manifest(spark: SparkSession, root: str, manifest: str, shares: splits.SplitConfig | None = None, force: bool = False) -> None:
    """A manifest of the source tree at ``manifest``: one that is there stays unless forced."""
    if not force and Path(manifest).exists():
        return
    items = sources.discover_items(sources.listing(spark, root))
    boxes = _source_boxes(spark, root).join(items.select("annotation_path", "image_path"), "annotation_path")
    if first := splits.target_violations(items, boxes).first():
        raise constraints.ConstraintError(f"{first.image_path}: {first.message}")
    split = splits.stratified(splits.multilabel_targets(items, boxes), shares).join(items, "image_path")
    sinks.save_manifest(split, manifest, root, shares, overwrite=force)


def export_tree(spark: SparkSession, root: str, manifest: str, export: str, names: tuple[str, ...]) -> dict:
    """The tree of images and labels that a manifest names, in its order. Of images only headers are read."""
    split = sources.read_manifest(spark, manifest, root, sources.listing(spark, root))
    return sinks.export_labels(split, _source_boxes(spark, root), sources.image_headers(spark, root, digest=False), export, names)


def validated(spark: SparkSession, export: str, **expected: int | None) -> dict:
    """Totals of an exported tree, if nothing is wrong with it."""
    return sinks.validate_label_tree(sources.label_tree(sources.listing(spark, export)), sources.contents(spark, f"{export}/labels", "*.txt"), **expected)


def prepare(spark: SparkSession, root: str, manifest: str, export: str, names: tuple[str, ...], shares: splits.SplitConfig | None = None, report: str | None = None, expected: dict | None = None, force: bool = False) -> dict:
    """Audit, split, write the manifest, export from the manifest's order, validate. Existing manifests are reused unless forced."""
    profile = audit_report(spark, root)
    if report:
        runs.write_json(profile, report)
    check_expected(profile, expected or {})
    ensure_manifest(spark, root, manifest, shares, force)
    export_tree(spark, root, manifest, export, names)
    return validated(spark, export)


def export_predictions(spark: SparkSession, source: str, dataset_id: str, load: Callable[[], prediction.Detector], names: dict[int, str], out: str, split: str = "external", manifest: DataFrame | None = None, truth: str | None = None, truth_format: str = "yolo", threshold: float = 0.5, allow_test: bool = False, options: prediction.Options | None = None) -> dict:
    """Images through the detector, joined to ground truth, matched, validated and written. Test images stop it before the model runs.

    The detector's results are staged, so that it sees every image once. Returns the counts, the mean time of an image and the devices.
    """
    split, images = constraints.split_name(split), sources.source_images(spark, source)
    one = False
    if truth is not None:
        if truth_format not in config.TRUTH_FORMATS:
            raise config.ConfigError(f"ground truth is {' or '.join(config.TRUTH_FORMATS)}, not {truth_format}")
        one, truth = sources.is_file(spark, truth), sources.absolute(spark, truth)
        if one and not sources.is_file(spark, source):
            raise config.ConfigError("one file of ground truth needs one image as its source")
    known = manifest if manifest is not None else spark.createDataFrame([], "path string, split string")
    constraints.guard_held_out(images, known, "path", split, allow_test)
    with staging.scratch(spark) as held:
        raw = staging.staged(prediction.predict(images, load, options), f"{held}/raw")
        named = splits.effective_split(prediction.with_image_id(raw, dataset_id), known, "path", split)
        found = prediction.detection_table(named, names)
        facts = prediction.run_facts(raw) | {f"manifest_{k}_images": n for k, n in splits.matched_counts(images, known, "path").first().asDict().items()}
        if truth is None:
            table = prediction.image_table(named, dataset_id, F.col("split"), F.lit(None))
            return sinks.write_inference_tables(out, table, found) | facts
        labels = spark.createDataFrame([(truth,)], "path string") if one else sources.listing(spark, truth, "*.txt")
        placed = sources.label_of(named, labels, sources.absolute(spark, source), truth, truth_format == "nwpu", one)
        sized = placed.filter("annotation_path is not null").select("image_id", F.col("annotation_path").alias("path"), F.col("width").alias("_w"), F.col("height").alias("_h"))
        lines = sources.annotation_lines(sources.contents(spark, truth, "*" if one else "*.txt")).join(sized, "path")
        if truth_format == "yolo":
            boxes = sources.label_boxes(sources.parsed_labels(lines), F.col("_w"), F.col("_h")).join(sized.select("image_id", "path"), "path")
        else:
            own = sources.annotation_boxes(sources.parsed_annotations(lines)).withColumnRenamed("annotation_path", "path").join(sized, "path")
            boxes = sources.source_ground_truth(own, F.col("_w"), F.col("_h")).withColumn("index", F.col("box_number") - 1)
        truths = staging.staged(prediction.ground_truth_table(boxes, names), f"{held}/truths")
        counts = truths.groupBy("image_id").agg(F.count("*").alias("_n"))
        table = prediction.image_table(named.join(counts, "image_id", "left"), dataset_id, F.col("split"), F.coalesce("_n", F.lit(0)))
        files = placed.agg(F.count("annotation_path").alias("matched"), F.count_if(F.col("annotation_path").isNull()).alias("lacking")).first()
        compared = staging.staged(matching.comparisons(found, truths, threshold), f"{held}/compared")
        return sinks.write_inference_tables(out, table, found, truths, compared) | facts | {"ground_truth_matched_files": files.matched, "ground_truth_unmatched_images": files.lacking}


def evaluate(detections: DataFrame, ground_truth: DataFrame, split: str, confirm_test: bool = False) -> dict:
    """AP50 and AP50-95; a test split needs confirmation."""
    if constraints.split_name(split) == "test" and not confirm_test:
        raise constraints.ConstraintError("evaluating the test split needs confirm_test")
    return evaluation.mean_average_precision(detections, ground_truth)


def evaluate_by_settings(spark: SparkSession, settings: dict, root: str | Path, load: Callable[[], prediction.Detector], names: dict[int, str], confirm_test: bool = False) -> Path:
    """A detector over one split of the prepared dataset: ``overall_metrics.json``, ``per_class_metrics.csv``, the settings and what ran, in a new folder."""
    split = settings["evaluation"]["split"]
    if split == "test" and not confirm_test:
        raise constraints.ConstraintError("evaluating the test split needs confirm_test")
    export = str(dataset_yaml(settings, root).parent)
    images = sources.discover_images(sources.label_tree(sources.listing(spark, export)).filter((F.col("split") == split) & (F.col("kind") == "images")))
    options = prediction.Options.of(settings["evaluation"], confidence=EVALUATED)
    scratch = staging.folder(spark)
    raw = staging.staged(prediction.predict(images, load, options), f"{scratch}/raw").withColumn("image_id", text.stem(F.col("path")))
    sized = raw.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
    lines = sources.annotation_lines(sources.contents(spark, f"{export}/labels/{split}", "*.txt")).withColumn("image_id", text.stem(F.col("path"))).join(sized, "image_id")
    boxes = sources.label_boxes(sources.parsed_labels(lines), F.col("_w"), F.col("_h")).withColumn("image_id", text.stem(F.col("path")))
    rows = evaluation.per_class(prediction.detection_table(raw, names), prediction.ground_truth_table(boxes, names), names).orderBy("class_id").collect()  # a row per class
    facts = prediction.run_facts(raw)
    staging.delete(spark, scratch)
    real = [r for r in rows if r.instances]
    mean = lambda key: sum(r[key] for r in real) / len(real) if real else 0.0
    overall = {"split": split, "checkpoint": settings["detector"].get("checkpoint"), "precision": mean("precision"), "recall": mean("recall"), "mAP50": mean("AP50"), "mAP50_95": mean("AP50_95"), "speed_ms_per_image": facts["speed_ms_per_image"]}
    out = new_folder(config.resolved(settings["outputs"]["evaluation_root"], root), f"{settings['experiment']['name']}_{split}")
    runs.write_json(overall, out / "overall_metrics.json")
    with (out / "per_class_metrics.csv").open("w", encoding="utf-8", newline="") as file:
        table = csv.DictWriter(file, ["class_id", "class_name", "instances", "precision", "recall", "AP50", "AP50_95"])
        table.writeheader()
        table.writerows(r.asDict() for r in rows)
    config.save(settings, out / "resolved_config.yaml")
    runs.write_json(runs.runtime_metadata(root) | {"stage": "evaluation", "devices": facts["devices"]} | overall, out / "evaluation_metadata.json")
    return out


def new_folder(root: Path, name: str) -> Path:
    """``root/name``, or the first of ``name2``, ``name3``, ... that isn't there."""
    k, at = 1, root / name
    while at.exists():
        k, at = k + 1, root / f"{name}{k + 1}"
    at.mkdir(parents=True)
    return at


def predict_free(spark: SparkSession, source: str, load: Callable[[], prediction.Detector], names: dict[int, str], out: str | Path, options: prediction.Options | None = None) -> Path:
    """Detections over an image, a folder, a glob or a URL, without ground truth or splits: a Parquet table and what ran."""
    folder = Path(out)
    with staging.scratch(spark) as held:
        raw = staging.staged(prediction.predict(sources.source_images(spark, source), load, options), f"{held}/raw")
        prediction.detection_table(prediction.with_image_id(raw, "prediction"), names).write.parquet(f"{folder}/detections")
        facts = prediction.run_facts(raw)
    asked = {"confidence": options.confidence, "iou": options.overlap} if options else {}
    runs.write_json(runs.runtime_metadata(Path.cwd()) | {"stage": "prediction", "source": source} | asked | facts, folder / "prediction_metadata.json")
    return folder


def export_by_settings(spark: SparkSession, settings: dict, root: str | Path, load: Callable[[], prediction.Detector], names: dict[int, str]) -> dict:
    """A prediction run's tables as the settings say, with the settings beside them, in a folder named by the run, its dataset and its split."""
    source, truth = settings["source"], settings.get("ground_truth") or {}
    place = lambda value: value and str(config.resolved(value, root))
    manifest = None
    if source.get("manifest"):
        manifest = sources.read_manifest(spark, place(source["manifest"]), place(source["dataset_root"])).select(F.col("image_path").alias("path"), "split")
    options, split = prediction.Options.of(settings["inference"]), constraints.split_name(source.get("split"))
    name = f"{settings['run']['name']}_{runs.safe_component(str(source['dataset_id']).strip())}_{runs.safe_component(split)}"
    at = place(source["path"]) if "://" not in source["path"] else source["path"]
    out = new_folder(Path(place(settings["outputs"]["root"])), name)
    done = export_predictions(spark, at, str(source["dataset_id"]).strip(), load, names, f"{out}/tables", split, manifest, place(truth.get("path")), truth.get("format", "yolo"), truth.get("iou_threshold") or 0.5, source.get("allow_test") or False, options)
    config.save(settings, out / "resolved_config.yaml")
    asked = {"dataset_id": source["dataset_id"], "source_split": split, "source": at, "manifest": place(source.get("manifest")), "compare_ground_truth": bool(truth), "ground_truth_format": truth.get("format"), "ground_truth_path": place(truth.get("path")), "confidence": options.confidence, "iou": options.overlap, "checkpoint": settings["detector"].get("checkpoint")}
    runs.write_json(runs.runtime_metadata(root) | {"stage": "inference_export"} | asked | done, out / "inference_metadata.json")
    return done | {"folder": str(out)}
