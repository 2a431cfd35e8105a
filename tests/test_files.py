"""Sources and sinks on small trees of real files."""

import re
import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.operators import prediction, splits
from gridloom.operators.constraints import ConstraintError
from gridloom.schemas import CLASS_NAMES
from gridloom.sinks import files as sinks
from gridloom.sources import files as sources


def png(path: Path, width: int, height: int) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    raw = b"".join(b"\0" + b"\x80" * (3 * width) for _ in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def tree(tmp_path):
    for k in range(1, 5):
        png(tmp_path / "set" / "Positive Image Set" / f"{k:03}.png", 10, 10)
        png(tmp_path / "set" / "negative image set" / f"{k:03}.png", 10, 10)
        (tmp_path / "set" / "ground truth").mkdir(exist_ok=True)
        (tmp_path / "set" / "ground truth" / f"{k:03}.txt").write_text("( 1, 1),(5,5), 1\n\n(2,2),(6,8),10 \n")
    (tmp_path / "set" / "ground truth" / "readme.txt").write_text("no annotation")
    return tmp_path / "set"


def test_items_join_by_stem_and_background_has_none(spark, tree):
    items = sources.discover_items(sources.listing(spark, str(tree))).orderBy("ordinal").collect()
    assert [r.ordinal for r in items] == [*range(8)]
    assert [r.is_background for r in items] == [False] * 4 + [True] * 4
    assert all(r.annotation_path.endswith(f"ground truth/{k:03}.txt") for k, r in enumerate(items[:4], 1)) and all(r.annotation_path is None for r in items[4:])


def test_annotations_count_blank_lines_and_bad_ones_reject_the_file(spark, tree):
    (tree / "ground truth" / "002.txt").write_text("(1,1),(5,5),1\n(1;1),(2,2),3\n")
    files = sources.contents(spark, str(tree / "ground truth"), "0*.txt")
    parsed = sources.parsed_annotations(sources.annotation_lines(files))
    boxes = sources.annotation_boxes(parsed)
    assert {(r.box_number, r.xmin, r.ymax, r.class_id) for r in boxes.collect()} == {(1, 1, 5, 1), (2, 2, 8, 10)} and boxes.count() == 6
    assert [r.error.split("002.txt")[1] for r in sources.annotation_errors(parsed).collect()] == [":2: (1;1),(2,2),3"]


def test_image_headers_and_unreadable(spark, tree):
    (tree / "Positive Image Set" / "009.png").write_bytes(b"no image")
    rows = {Path(r.path).name: r for r in sources.image_headers(spark, str(tree / "Positive Image Set")).collect()}
    assert (rows["001.png"].width, rows["001.png"].height, rows["001.png"].mode) == (10, 10, "RGB") and rows["009.png"].width == -1
    assert rows["001.png"].sha256 == rows["002.png"].sha256


def test_labels_scale_and_name_their_faults(spark):
    files = spark.createDataFrame([("a.txt", bytearray(b"2 0.5 0.5 0.2 0.4\n")), ("b.txt", bytearray(b"1 2 3\n1 inf 0 1 1\n1_0 0.5 0.5 0.1 0.1"))], "path string, content binary")
    parsed = sources.parsed_labels(sources.annotation_lines(files))
    good = sources.label_boxes(parsed.filter("path = 'a.txt'"), F.lit(100), F.lit(80)).first()
    assert (good.class_id, good.xmin, good.ymin, good.xmax, good.ymax) == (2, 40, 24, 60, 56)
    assert {(r.line, *r.issues) for r in parsed.filter("path = 'b.txt'").collect()} == {(1, "expected 5 fields"), (2, "non-finite value"), (3, "non-numeric value")}
    with pytest.raises(Exception, match="b.txt:1"):
        sources.label_boxes(parsed, F.lit(100), F.lit(80)).collect()


def test_export_and_validate_a_tree(spark, tree, tmp_path):
    items = sources.discover_items(sources.listing(spark, str(tree)))
    split = items.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test"), F.lit("train")), (F.col("ordinal") % 4 + 1).cast("int")))
    parsed = sources.parsed_annotations(sources.annotation_lines(sources.contents(spark, str(tree / "ground truth"), "0*.txt")))
    boxes, images = sources.annotation_boxes(parsed), sources.image_headers(spark, str(tree))
    summary = sinks.export_labels(split, boxes, images, str(tmp_path / "out"), CLASS_NAMES)
    assert summary["splits"]["train"] == {"images": 4, "backgrounds": 2, "objects": 4, "objects_by_class": {"0": 2, "9": 2}}
    assert (tmp_path / "out/labels/train/train_0000_positive_001.txt").read_text() == "0 0.30000000 0.30000000 0.40000000 0.40000000\n9 0.40000000 0.50000000 0.40000000 0.60000000\n"
    exported = sources.label_tree(sources.listing(spark, str(tmp_path / "out")))
    labels = sources.contents(spark, str(tmp_path / "out/labels"), "*.txt")
    report = sinks.validate_label_tree(exported, labels, 8, 8, 4)
    assert report["valid"] and report["class_counts"] == {0: 4, 9: 4}
    with pytest.raises(ValueError, match="expected 9 images"):
        sinks.validate_label_tree(exported, labels, 9)
    with pytest.raises(FileExistsError):
        sinks.export_labels(split, boxes, images, str(tmp_path / "out"), CLASS_NAMES)


def test_manifest_round_trip_and_faults(spark, tree, tmp_path):
    items = sources.discover_items(sources.listing(spark, str(tree)))
    split = items.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test"), F.lit("train")), (F.col("ordinal") % 4 + 1).cast("int")))
    path = f"{tmp_path}/manifest.csv"
    sinks.save_manifest(split, path, str(tree), splits.SplitConfig())
    with pytest.raises(Exception):
        sinks.save_manifest(split, path, str(tree))
    back = sources.read_manifest(spark, path, str(tree), sources.listing(spark, str(tree)))
    assert {(r.image_path, r.annotation_path, r.is_background, r.split) for r in back.collect()} == {(r.image_path, r.annotation_path, r.is_background, r.split) for r in split.collect()}
    bad = tmp_path / "bad.csv"
    bad.write_text("image_path,annotation_path,is_background,split\na.png,,true,train\nb.png,,maybe,val\n")
    with pytest.raises(ConstraintError, match="row 3"):
        sources.read_manifest(spark, str(bad), str(tree))


class Stub:
    names = {0: "airplane"}

    def predict(self, paths):
        return [prediction.Found(100, 80, [(1.0, 2.0, 200.0, 30.0)], [0], [0.9]) for _ in paths]


def test_model_boundary_clamps_and_numbers(spark):
    images = spark.createDataFrame([(0, "/x/a.png"), (1, "/x/b.png")], "ordinal long, path string")
    named = prediction.with_image_id(prediction.predict(images, Stub), "my set!")
    rows = {r.detection_id: r for r in prediction.detection_table(named, Stub.names).collect()}
    assert [*rows] and rows["my_set_000001_b_det_0000"].xmax == 100.0 and rows["my_set_000000_a_det_0000"].predicted_class_name == "airplane"
    table = prediction.image_table(named, "my set!", F.lit("external"), F.lit(None)).collect()
    assert {r.prediction_count for r in table} == {1} and {r.ground_truth_count for r in table} == {None}


def test_stratified_needs_unique_paths(spark):
    with pytest.raises(ConstraintError):
        splits.stratified(spark.createDataFrame([("a", [1]), ("a", [1])], "image_path string, targets array<int>"))
    with pytest.raises(ValueError):
        splits.SplitConfig(0.5, 0.5, 0.5)


def test_ordinals_over_many_ranges(spark):
    paths = [(f"/a{k % 7}/b{k % 13}.{k}/c{k}.png",) for k in range(500)]
    out = sources.with_ordinal(spark.createDataFrame(paths, "path string").repartition(5), [F.split("path", "/")], rows=40).collect()
    assert [r.path for r in sorted(out, key=lambda r: r.ordinal)] == sorted((p for (p,) in paths), key=lambda p: p.split("/"))
    assert sorted(r.ordinal for r in out) == [*range(500)]


def explained(df, mode):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_totals_read_label_files_once(spark, tmp_path):
    """The text of a file with none, blank and several lines; one line isn't usable."""
    texts = {"a": "", "b": " \n\t\n", "c": "\n1 0.5 0.5 0.2 0.2\n\n12 0.5 0.5 0.2 0.2", "d": "1 0.5 0.5 0.2 1e-1\n1 nan 0.5 0.2 0.2\n3 0.5 0.5 0.2", "e": "\u0085", "f": None}
    rows = [(f"/out/labels/train/{k}.txt", v if v is None else bytearray(v.encode())) for k, v in texts.items()]
    spark.createDataFrame(rows, "path string, content binary").write.parquet(str(tmp_path / "labels"))
    labels = spark.read.parquet(str(tmp_path / "labels"))
    tree = spark.createDataFrame([(p,) for p, _ in rows[:4]] + [("/out/images/val/a.png",)], "path string")
    totals = sinks.label_tree_totals(sources.label_tree(tree), labels)
    assert explained(totals, "simple").count("FileScan parquet") == 1
    assert {(r.figure, r.key): r.n for r in totals.collect()} == {("labels", ""): 4, ("images", ""): 1, ("backgrounds", ""): 2, ("class", "1"): 2, ("class", "12"): 1}


def test_label_parsing_stays_in_compiled_methods(spark, tmp_path):
    """The JVM only interprets methods of more than 8000 bytes, whole stages of Spark among them."""
    said = ["1 0.5 0.5 0.2 0.2", "+1 .5 5e-1 0.2 0.2", "1 -0.5 0.5 0.2 0.2", "1 inf 0.5 0.2 0.2", "x 0.5 0.5 0.2 0.2", "1 0.5 0.5 0.2", "12\t0.9 0.5  0.4 0.2", "1 0.5 0.5 0.2 0.2d"]
    spark.createDataFrame([("p", k, s) for k, s in enumerate(said)], "path string, line int, said string").write.parquet(str(tmp_path / "lines"))
    parsed = sources.parsed_labels(spark.read.parquet(str(tmp_path / "lines")))
    assert [(r.class_id, r.x_center, r.usable, r.issues) for r in parsed.orderBy("line").collect()] == [
        (1, 0.5, True, []),
        (1, 0.5, True, []),
        (1, -0.5, True, ["normalized value outside range", "box outside image"]),
        (1, float("inf"), False, ["non-finite value"]),
        (None, 0.5, False, ["non-numeric value"]),
        (None, None, False, ["expected 5 fields"]),
        (12, 0.9, True, ["invalid class", "box outside image"]),
        (1, 0.5, False, ["non-numeric value"]),
    ]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # code is shown for plans that are final
    try:
        code = explained(sources.label_boxes(sources.parsed_labels(sources.annotation_lines(spark.createDataFrame([("p", bytearray(b"1"))], "path string, content binary"))), F.lit(200), F.lit(200)), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 4000
