"""Listings, contents and image headers: all names, every level, damaged files."""

import hashlib
import io
import os
import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.sources import files as sources
from gridloom.sources import imageheads, walk


def png_bytes(width, height, depth=8, colour=2):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return imageheads.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + chunk(b"IDAT", b"x" * 50) + chunk(b"IEND", b"")


def jpeg_bytes(width, height, parts=3, frame=0xC0, before=b""):
    segment = lambda code, body: bytes([0xFF, code]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\xff\xc0" * 20) + before + segment(frame, struct.pack(">BHHB", 8, height, width, parts) + b"\0" * 3 * parts) + segment(0xDA, b"\0") + b"data\xff\xd9"


def bmp_bytes(width, height, bits=24, table=b"", colours=0, packing=0, masks=b""):
    body = struct.pack("<IiiHHIIiiII", 40 + len(masks), width, height, 1, bits, packing, 0, 0, 0, colours, 0) + masks
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 14 + len(body) + len(table)) + body + table + b"\0" * 9


def tiff_bytes(width, height, order="<", bits=(8, 8, 8), photo=2, extra=(), real=False):
    tags = [(256, 4, [width]), (257, 3, [height]), (258, 3, list(bits)), (262, 3, [photo]), (277, 3, [len(bits)])]
    tags += [(338, 3, list(extra))] if extra else []
    tags += [(339, 3, [3])] if real else []
    far, data, at = [], b"", 8
    for tag, kind, values in tags:
        value = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(value) > 4:
            data, value = data + value, struct.pack(f"{order}I", at + len(data))
        far.append(struct.pack(f"{order}HHI", tag, kind, len(values)) + value.ljust(4, b"\0"))
    start = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at + len(data))
    return start + data + struct.pack(f"{order}H", len(far)) + b"".join(far) + b"\0" * 4


GRAY = b"".join(bytes([k, k, k, 0]) for k in range(256))
GOOD = {
    "rgb.png": (png_bytes(7, 9), 7, 9, "RGB"), "gray.png": (png_bytes(1, 2, 8, 0), 1, 2, "L"), "bit.png": (png_bytes(1, 2, 1, 0), 1, 2, "1"), "deep.png": (png_bytes(1, 2, 16, 0), 1, 2, "I;16"), "palette.png": (png_bytes(3, 3, 4, 3), 3, 3, "P"), "la.png": (png_bytes(3, 3, 16, 4), 3, 3, "LA"), "rgba.png": (png_bytes(3, 3, 8, 6), 3, 3, "RGBA"),
    "a.jpg": (jpeg_bytes(640, 480), 640, 480, "RGB"), "progressive.jpeg": (jpeg_bytes(5, 4, 1, 0xC2, b"\xff\xff\xff\xe1\0\x04xx"), 5, 4, "L"), "cmyk.JPG": (jpeg_bytes(5, 4, 4), 5, 4, "CMYK"),
    "a.bmp": (bmp_bytes(6, -3), 6, 3, "RGB"), "gray.bmp": (bmp_bytes(6, 3, 8, GRAY), 6, 3, "L"), "p.bmp": (bmp_bytes(6, 3, 8, GRAY[::-1]), 6, 3, "P"), "bit.bmp": (bmp_bytes(6, 3, 1, b"\0\0\0\0\xff\xff\xff\0"), 6, 3, "1"), "alpha.bmp": (bmp_bytes(2, 2, 32, packing=3, masks=struct.pack("<IIII", 1, 2, 4, 8)), 2, 2, "RGBA"),
    "a.tif": (tiff_bytes(70000, 5), 70000, 5, "RGB"), "m.tiff": (tiff_bytes(4, 5, ">", (8, 8, 8, 8), 2, (2,)), 4, 5, "RGBA"), "g.tif": (tiff_bytes(4, 5, ">", (16,), 1), 4, 5, "I;16"), "f.tif": (tiff_bytes(4, 5, "<", (32,), 1, real=True), 4, 5, "F"), "c.tif": (tiff_bytes(4, 5, "<", (8, 8, 8, 8), 5), 4, 5, "CMYK"), "b.tif": (tiff_bytes(4, 5, "<", (1,), 0), 4, 5, "1"),
}
whole = png_bytes(7, 9)
BAD = {"empty.png": b"", "text.png": b"no image at all", "cut.png": whole[:30], "damaged.png": whole[:45] + b"?" + whole[46:], "cut.jpg": jpeg_bytes(5, 4)[:30], "scan.jpg": b"\xff\xd8\xff\xda\0\x04xx", "none.bmp": bmp_bytes(0, 4), "odd.bmp": bmp_bytes(5, 4, 7), "cut.tif": tiff_bytes(4, 5)[:20], "colour.png": png_bytes(3, 3, 8, 5)}


@pytest.mark.parametrize("name", sorted(GOOD))
def test_headers_of_all_kinds(name):
    data, *want = GOOD[name]
    assert [*imageheads.head(io.BytesIO(data), verify=True)] == want


@pytest.mark.parametrize("name", sorted(BAD))
def test_damaged_files_say_so(name):
    width, height, mode, digest, error = imageheads.inspected(io.BytesIO(BAD[name]), len(BAD[name]), True)
    assert (width, height, mode, digest) == (-1, -1, None, hashlib.sha256(BAD[name]).hexdigest()) and error


def test_headers_read_little():
    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            self.total += len(out)
            return out

    file = Counting(jpeg_bytes(5, 4) + b"\0" * 10_000_000)
    assert imageheads.inspected(file, 10_000_000, False)[:3] == (5, 4, "RGB") and file.total < 1000


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "a set"
    for name, (data, *_) in GOOD.items():
        at = root / ("_hidden" if name.startswith("a.") else "x.y") / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    for name, data in BAD.items():
        (root / ".dot" / "deep" / "er").mkdir(parents=True, exist_ok=True)
        (root / ".dot" / "deep" / "er" / name).write_bytes(data)
    (root / "_note.txt").write_text("1 0.5 0.5 0.1 0.1\n")
    (root / ".empty.txt").write_text("")
    (root / "empty folder").mkdir()
    return root


@pytest.mark.parametrize("entries", [None, 0, 3])
def test_all_names_at_every_level(spark, tree, entries):
    want = sorted((str(Path(d) / f), os.path.getsize(Path(d) / f)) for d, _, fs in os.walk(tree) for f in fs)
    assert sorted(map(tuple, walk.listing(spark, str(tree), entries=entries).collect())) == want
    assert {Path(r.path).name for r in walk.listing(spark, str(tree), "*.txt", entries=entries).collect()} == {"_note.txt", ".empty.txt"}
    assert walk.listing(spark, str(tree), "a*.png", entries=entries).count() == 0


def test_one_file_globs_and_nothing(spark, tree):
    assert [r.path for r in sources.listing(spark, str(tree / "_note.txt")).collect()] == [str(tree / "_note.txt")]
    assert walk.listing(spark, f"{tree}/x.*/*.png").count() == sum(n.endswith(".png") for n in GOOD)
    assert walk.listing(spark, str(tree / "empty folder")).collect() == []
    assert {Path(r.path).name: bytes(r.content) for r in sources.contents(spark, str(tree), "*.txt").collect()} == {"_note.txt": b"1 0.5 0.5 0.1 0.1\n", ".empty.txt": b""}
    with pytest.raises(FileNotFoundError):
        walk.listing(spark, str(tree / "none"))


def test_headers_of_a_tree(spark, tree):
    headers = sources.image_headers(spark, str(tree))
    plan = headers._jdf.queryExecution().executedPlan().toString()
    assert "BinaryFile" not in plan and "Join" not in plan
    rows = {Path(r.path).name: r for r in headers.collect()}
    assert set(rows) == set(GOOD) | set(BAD)
    for name, (data, *want) in GOOD.items():
        assert [rows[name].width, rows[name].height, rows[name].mode] == want and rows[name].sha256 == hashlib.sha256(data).hexdigest() and rows[name].error is None
    assert all(rows[name].width == -1 and rows[name].error for name in BAD)
    bare = {Path(r.path).name: r for r in sources.image_headers(spark, str(tree), digest=False).collect()}
    assert bare["a.tif"].width == 70000 and bare["a.tif"].sha256 is None and bare["cut.jpg"].width == -1


def test_stores_that_only_spark_reads(spark, tree, monkeypatch):
    monkeypatch.setattr(walk, "is_open", lambda path: False)
    monkeypatch.setattr(walk, "ENTRIES", 4)
    names = {Path(f).name for _, _, fs in os.walk(tree) for f in fs}
    assert {Path(r.path).name for r in walk.listing(spark, str(tree)).collect()} == names
    rows = {Path(r.path).name: r for r in sources.image_headers(spark, str(tree / "x.y")).collect()}
    assert (rows["rgb.png"].width, rows["rgb.png"].mode) == (7, "RGB")
    assert {Path(r.path).name for r in sources.contents(spark, f"{tree}/x.y", "*.png").collect()} == {n for n in GOOD if n.endswith(".png")}


def test_discovery_sees_hidden_names(spark, tree):
    found = sources.source_images(spark, str(tree)).collect()
    assert {Path(r.path).name for r in found} == set(GOOD) | set(BAD)
    assert [r.path.split("/") for r in sorted(found, key=lambda r: r.ordinal)] == sorted(r.path.split("/") for r in found)
    assert [tuple(r) for r in sources.source_images(spark, "https://host/a.jpg").collect()] == [(0, "https://host/a.jpg")]
    assert sources.has_items(spark, str(tree)) is False and sources.has_items(spark, str(tree / "none")) is False


def test_ordinals_of_equal_and_many_rows(spark):
    df = spark.range(1000).select(F.lit("a").alias("path"))
    for rows in (10_000, 90):
        assert sorted(r.ordinal for r in sources.with_ordinal(df, [F.col("path")], rows=rows).collect()) == [*range(1000)]
