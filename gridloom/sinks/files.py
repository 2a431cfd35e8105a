"""Manifests, label trees and prediction tables."""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom import staging
from gridloom.functions import geometry, text
from gridloom.operators import audit, constraints, matching, splits
from gridloom.schemas import CLASSES, SPLITS
from gridloom.sources import archives, walk
from gridloom.sources import files as sources


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One CSV file of that very name, with a header, in the order of ``df``; empty and null are both written as nothing.

    It is written beside its place and renamed once it is whole, in any store: nobody reads half a file. The Parquet tables beside such files are the form for large ones.
    """
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(context._jsc.hadoopConfiguration())
    if store.exists(at) and not overwrite:
        raise FileExistsError(f"already there: {path}")
    beside = context._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    try:
        df.coalesce(1).write.option("header", "true").option("lineSep", "\r\n").option("emptyValue", "").csv(beside.toString())
        part = next(f.getPath() for f in store.listStatus(beside) if f.getPath().getName().startswith("part-"))
        store.delete(at, True)
        if not store.rename(part, at):
            raise OSError(f"cannot write {path}")
    finally:
        store.delete(beside, True)


def relative_to(path, root: str):
    """The path below ``root``; a path outside raises."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).when(path.isNull(), F.lit("")).otherwise(F.raise_error(F.concat(F.lit("path outside the dataset: "), path)))


def manifest(split: DataFrame, root: str, config: splits.SplitConfig) -> DataFrame:
    """The rows of a manifest, by split and image id. ``split``: image_path, annotation_path, is_background, split."""
    rows = split.select(
        F.concat_ws("_", text.kind_of(F.col("is_background")), text.stem(F.col("image_path"))).alias("image_id"),
        relative_to(F.col("image_path"), root).alias("image_path"),
        relative_to(F.col("annotation_path"), root).alias("annotation_path"),
        "is_background",
        "split",
        *[F.lit(getattr(config, c)).alias(c) for c in ("seed", "train_ratio", "val_ratio", "test_ratio")],
    )
    return rows.orderBy("split", "image_id")


def save_manifest(split: DataFrame, path: str, root: str, config: splits.SplitConfig | None = None, overwrite: bool = False) -> None:
    """Validate the splits, then write one file: a manifest is read in its order."""
    constraints.raise_first(constraints.split_violations(split))
    write_csv(manifest(split, root, config or splits.SplitConfig()), path, overwrite)


def export_rows(split: DataFrame, boxes: DataFrame, images: DataFrame) -> DataFrame:
    """``output_id, split, source_image, source_annotation, is_background, object_count, label``: what an export writes, per image.

    ``split`` has an ordinal, ``boxes`` annotation_path and box_number, ``images`` path, width and height. A background's label is empty.
    """
    placed = sources.with_ordinal(split, [F.col("split"), F.col("ordinal")], "_place")
    starts = placed.groupBy("split").agg(F.min("_place").alias("_first"))  # a row per split
    index = F.col("_place") - F.col("_first")
    named = placed.join(starts, "split").withColumn("output_id", F.format_string("%s_%04d_%s_%s", "split", index, text.kind_of(F.col("is_background")), text.stem(F.col("image_path"))))
    sized = named.filter("not is_background").join(boxes, "annotation_path").join(images.select(F.col("path").alias("image_path"), F.col("width").alias("_w"), F.col("height").alias("_h")), "image_path")
    columns = geometry.to_normalised_strict(geometry.box(), F.col("class_id"), F.col("_w"), F.col("_h"))
    line = geometry.label_line(columns.pop("class_id"), columns)
    labels = sized.select("output_id", "box_number", line.alias("line")).groupBy("output_id").agg(F.array_sort(F.collect_list(F.struct("box_number", "line"))).alias("l"))
    lines = F.coalesce(F.transform("l", lambda x: x["line"]), F.array().cast("array<string>"))
    label = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return named.join(labels, "output_id", "left").select("output_id", "split", F.col("image_path").alias("source_image"), F.coalesce("annotation_path", F.lit("")).alias("source_annotation"), "is_background", F.size(lines).alias("object_count"), label.alias("label"))


def export_labels(split: DataFrame, boxes: DataFrame, images: DataFrame, out: str, class_names: Iterable[str]) -> dict:
    """Write the tree: images copied, label files, dataset.yaml, export_manifest.csv, export_summary.json; returns the summary.

    The tree is built beside its place and renamed when it is whole: ``out`` is a complete export or isn't there. Files of it are renamed
    into place, too, so that a task that runs twice does no harm. Images come from any store that tasks can open, and ``out`` may lie in
    one. It must be empty, names must be ten, positives need annotations.
    """
    names, spark = [*class_names], split.sparkSession
    if len(names) != CLASSES:
        raise ValueError(f"expected {CLASSES} class names")
    constraints.raise_first(constraints.split_violations(split))
    lacking = split.filter("not is_background and annotation_path is null").select("image_path").first()
    if lacking:
        raise ValueError(f"positive image without annotation: {lacking.image_path}")
    root = out.rstrip("/") if "://" in out else str(Path(out).resolve())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(path(root)) and len(store.listStatus(path(root))):
        raise FileExistsError(f"not empty: {root}")
    partial = f"{root}.partial-{uuid.uuid4().hex}"
    try:
        with staging.scratch(spark) as held:
            rows = staging.staged(export_rows(split, boxes, images), f"{held}/rows")
            rows.repartition(max(1, -(-rows.count() // walk.TASK_FILES), spark.sparkContext.defaultParallelism)).foreachPartition(_copies(partial))
            write_csv(rows.drop("label").orderBy("split", "output_id"), f"{partial}/export_manifest.csv")
        named, own = split.withColumn("path", F.col("annotation_path")), boxes.withColumnRenamed("annotation_path", "path")
        per, classes = splits.split_summary(named, own, "path").collect(), splits.objects_by_class(named.filter("path is not null"), own, "path").collect()
        by_class = lambda s: {str(c.class_id): c.n for c in sorted(classes, key=lambda c: c.class_id) if c.split == s}
        summary = {"dataset_yaml": f"{root}/dataset.yaml", "export_manifest": f"{root}/export_manifest.csv", "splits": {r.split: {"images": r.images, "backgrounds": r.backgrounds, "objects": r.objects, "objects_by_class": by_class(r.split)} for r in per}}
        described = [f"path: {root}", *(f"{s}: images/{s}" for s in SPLITS), "names:", *(f"  {k}: {n}" for k, n in enumerate(names))]
        target, inner, _ = walk.opened(partial)
        for name, said in (("dataset.yaml", "\n".join(described) + "\n"), ("export_summary.json", json.dumps(summary, indent=2) + "\n")):
            archives.put(target, f"{inner}/{name}", lambda file, said=said: file.write(said.encode()))
        store.delete(path(root), True)  # empty, or not there
        if not store.rename(path(partial), path(root)):
            raise OSError(f"cannot write {root}")
    finally:
        store.delete(path(partial), True)
    return summary


def _copies(root: str) -> Callable[[Iterable[Row]], None]:
    """For foreachPartition over ``export_rows``: images copied as a stream, labels written."""

    def write(part: Iterable[Row]) -> None:
        store, inner, _ = walk.opened(root)
        for s in SPLITS:
            for kind in ("images", "labels"):
                store.create_dir(f"{inner}/{kind}/{s}", recursive=True)
        for r in part:
            source, image, _ = walk.opened(r.source_image)
            suffix = PurePosixPath(image).suffix.lower()
            with source.open_input_file(image) as file:
                archives.put(store, f"{inner}/images/{r.split}/{r.output_id}{suffix}", lambda to, file=file: shutil.copyfileobj(file, to, 1 << 20))
            archives.put(store, f"{inner}/labels/{r.split}/{r.output_id}.txt", lambda to, r=r: to.write(r.label.encode()))

    return write


def label_tree_issues(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """``place, message`` for everything wrong with an exported tree. ``labels``: path, content of its label files."""
    stems = tree.groupBy("split", "stem").agg(F.collect_set("kind").alias("kinds")).filter(F.size("kinds") < 2).groupBy("split").agg(F.count("*").alias("n"))
    rows = sources.annotation_lines(labels)
    number = F.row_number().over(Window.partitionBy("path").orderBy("line"))  # blank lines don't count here
    lines = sources.parsed_labels(rows.withColumn("line", number))
    per_line = lines.select(F.concat_ws(":", "path", F.col("line").cast("string")).alias("place"), F.explode("issues").alias("message"))
    return stems.select(F.col("split").alias("place"), F.lit("image/label stem mismatch").alias("message")).unionByName(per_line)


def label_tree_totals(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """``figure, key, n`` of an exported tree: images, labels, backgrounds (labels without a line) and the objects of each class, in one job. Figures of nothing have no row.

    Label files are read once: a file's blank lines stay, so that one without objects still has a row that tells a background.
    """
    nothing = ~text.decoded(F.col("content")).rlike(r"\S")
    rows = labels.select(nothing.alias("nothing"), F.posexplode_outer(text.lines(text.decoded(F.col("content")))).alias("line", "raw"))
    lines = sources.parsed_labels(rows.select("nothing", "line", F.trim("raw", F.lit(" \t")).alias("said")))
    background = F.col("nothing") & (F.coalesce("line", F.lit(0)) == 0)
    found = lines.select(F.when(background, "backgrounds").when(F.col("usable"), "class").alias("figure"), F.when(F.col("usable"), F.col("class_id")).alias("key"))
    files = tree.select(F.col("kind").alias("figure"), F.lit(None).cast("long").alias("key"))
    counts = files.unionByName(found.filter("figure is not null")).groupBy("figure", "key").agg(F.count("*").alias("n"))
    return counts.select("figure", F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "n")


def validate_label_tree(tree: DataFrame, labels: DataFrame, expected_images: int | None = None, expected_objects: int | None = None, expected_backgrounds: int | None = None) -> dict:
    """Totals of an exported tree; raises with the first 20 issues if there are any. Totals of nothing are left out, as no file counted them."""
    rows = label_tree_totals(tree, labels).collect()  # a row per kind and class
    classes = {int(r.key): r.n for r in sorted((r for r in rows if r.figure == "class"), key=lambda r: int(r.key))}
    counts = {r.figure: r.n for r in rows if r.figure != "class"}
    totals = {"images": counts.get("images", 0), "labels": counts.get("labels", 0)}
    totals |= {k: n for k, n in (("backgrounds", counts.get("backgrounds", 0)), ("objects", sum(classes.values()))) if n}
    issues = [f"{r.place}: {r.message}" for r in label_tree_issues(tree, labels).orderBy("place", "message").limit(20).collect()]
    issues += [f"expected {want} {k}, found {totals.get(k, 0)}" for k, want in (("images", expected_images), ("objects", expected_objects), ("backgrounds", expected_backgrounds)) if want is not None and totals.get(k, 0) != want]
    if totals["images"] != totals["labels"]:
        issues.append("image and label counts differ")
    if issues:
        raise ValueError("label tree: " + "; ".join(issues[:20]))
    return totals | {"class_counts": classes, "issues": [], "valid": True}


def write_inference_tables(out: str, images: DataFrame, detections: DataFrame, ground_truth: DataFrame | None = None, compared: DataFrame | None = None) -> dict:
    """Validate, then write the tables of a prediction run, each as CSV and as Parquet; returns their counts, with all four statuses if there is a comparison."""
    constraints.raise_first(constraints.inference_violations(images, detections))
    summary = constraints.inference_totals(images, detections).first().asDict()
    tables = {"inference_images.csv": images.orderBy("image_id"), "detections.csv": detections.orderBy("detection_id")}
    if ground_truth is not None:
        tables["ground_truth.csv"] = ground_truth.orderBy("ground_truth_id")
        summary["ground_truths"] = ground_truth.count()
    if compared is not None:
        tables["prediction_comparison.csv"] = compared.orderBy("comparison_id")
        summary |= {r.status: r.n for r in matching.status_counts(compared).collect()}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{out.rstrip('/')}/{name.removesuffix('.csv')}.parquet")
        write_csv(df, f"{out.rstrip('/')}/{name}")
    return summary


