"""Archives by tasks, and exports that are whole or absent."""

import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.schemas import CLASS_NAMES
from gridloom.sinks import files as sinks
from gridloom.sources import archives
from gridloom.sources import files as sources
from tests.test_files import png


def test_members_and_unpacking(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(50):
            z.writestr(f"set/d{k % 3}/_x {k}.txt", f"said {k}" * k)
        z.writestr("set/none/", "")
        z.writestr("./set/./y.txt", "y")
    found = {r.name: r for r in archives.members(spark, str(tmp_path / "a b.zip")).collect()}
    assert len(found) == 52 and found["set/none/"].is_folder and found["set/d1/_x 4.txt"].size == 4 * len("said 4")
    (tmp_path / "out" / "set" / "d0").mkdir(parents=True)
    (tmp_path / "out" / "set" / "d0" / "_x 3.txt").write_text("mine")
    archives.unpack(spark, str(tmp_path / "a b.zip"), str(tmp_path / "out"))
    files = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert files == {f"set/d{k % 3}/_x {k}.txt": f"said {k}" * k for k in range(50)} | {"set/y.txt": "y", "set/d0/_x 3.txt": "mine"} and (tmp_path / "out/set/none").is_dir()
    archives.unpack(spark, str(tmp_path / "a b.zip"), str(tmp_path / "out"), overwrite=True)
    assert (tmp_path / "out" / "set" / "d0" / "_x 3.txt").read_text() == "said 3" * 3


@pytest.mark.parametrize("name", ["../evil.txt", "a/../../evil.txt", "/evil.txt", "..\\evil.txt", "C:/evil.txt"])
def test_members_stay_inside(spark, tmp_path, name):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("good.txt", "x")
        z.writestr(name, "x")
    with pytest.raises(ValueError, match="outside"):
        archives.unpack(spark, str(tmp_path / "b.zip"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    with pytest.raises(FileNotFoundError):
        archives.unpack(spark, str(tmp_path / "none.zip"), str(tmp_path / "out"))


def test_exports_are_whole_or_absent(spark, tmp_path):
    for k in range(1, 4):
        png(tmp_path / "set" / "positive image set" / f"{k}.png", 10, 10)
        png(tmp_path / "set" / "negative image set" / f"{k}.png", 10, 10)
        (tmp_path / "set" / "ground truth").mkdir(exist_ok=True)
        (tmp_path / "set" / "ground truth" / f"{k}.txt").write_text("(1,1),(5,5),1\n")
    items = sources.discover_items(sources.listing(spark, str(tmp_path / "set")))
    split = items.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("ordinal") % 3 + 1).cast("int")))
    boxes = sources.annotation_boxes(sources.parsed_annotations(sources.annotation_lines(sources.contents(spark, str(tmp_path / "set"), "*.txt"))))
    images = sources.image_headers(spark, str(tmp_path / "set"), digest=False)
    broken = split.withColumn("image_path", F.when(F.col("ordinal") == 2, F.concat("image_path", F.lit(".gone"))).otherwise(F.col("image_path")))
    gone = images.withColumn("path", F.when(F.col("path").endswith("positive image set/3.png"), F.concat("path", F.lit(".gone"))).otherwise(F.col("path")))
    with pytest.raises(Exception, match="gone"):
        sinks.export_labels(broken, boxes, gone, str(tmp_path / "out"), CLASS_NAMES)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["set"]
    (tmp_path / "out").mkdir()
    sinks.export_labels(split, boxes, images, str(tmp_path / "out"), CLASS_NAMES)
    names = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert len(names) == 15 and "labels/val/val_0000_positive_2.txt" in names and "images/val/val_0001_background_2.png" in names
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out", "set"]
    assert Path(tmp_path / "out" / "export_manifest.csv").read_text().count("\n") == 7
