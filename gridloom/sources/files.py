"""Image trees, annotations, labels and manifests as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom import staging
from gridloom.functions import geometry, text
from gridloom.operators.constraints import ConstraintError
from gridloom.schemas import CLASSES, FIRST_CLASS, IMAGE_SUFFIXES, SPLITS
from gridloom.sources import walk

#: Folder names of the source layout, and the form of a line of its annotations.
POSITIVE, NEGATIVE, TRUTH = "positive image set", "negative image set", "ground truth"
ANNOTATION = r"^\(\s*(\d+)\s*,\s*(\d+)\s*\),\(\s*(\d+)\s*,\s*(\d+)\s*\),\s*(\d+)\s*$"
#: A label line of five numbers without exponents, nan or inf.
PLAIN_LABEL = r"^[0-9]+(?:\s+-?[0-9]+\.[0-9]+){4}$"


def listing(spark: SparkSession, source: str, pattern: str = "*") -> DataFrame:
    """``path`` of all files below a folder, of those that a glob names, or one file, without opening them."""
    return walk.listing(spark, source, pattern).select("path")


def contents(spark: SparkSession, source: str, pattern: str = "*") -> DataFrame:
    """``path, content``; a file is one row, and an empty one has empty content."""
    return walk.contents(spark, source, pattern)


def is_image(path: Column) -> Column:
    return text.suffix(path).isin(*IMAGE_SUFFIXES)


def with_ordinal(df: DataFrame, order: list[Column], column: str = "ordinal", rows: int = 100_000) -> DataFrame:
    """Numbers from 0 in a global order. More than ``rows`` rows are dealt by ranges and staged; each range is numbered after those before it."""
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{k}") for k, c in enumerate(order)]))
    n = keyed.count()
    if n <= rows:
        return keyed.withColumn(column, (F.row_number().over(Window.orderBy("_key")) - 1).cast("long")).drop("_key")
    ranged = staging.staged(keyed.repartitionByRange(-(-n // rows) + 1, "_key").withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per range
    local = F.row_number().over(Window.partitionBy("_range").orderBy("_key")) - 1
    return ranged.withColumn(column, local).join(before, "_range").withColumn(column, (F.col(column) + F.col("_before")).cast("long")).drop("_key", "_range", "_before")


def discover_items(files: DataFrame) -> DataFrame:
    """Items of a source tree, from its listing: positives in path order with their annotation, then backgrounds.

    The folder of each kind is the smallest path whose last component has its name, whatever case; its direct children count.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    placed = files.withColumn("folder", folder).withColumn("kind", F.lower(text.name(F.col("folder"))))
    kinds = placed.filter(F.col("kind").isin(POSITIVE, NEGATIVE, TRUTH)).groupBy("kind").agg(F.min("folder").alias("folder"))
    found = {r.kind: r.folder for r in kinds.collect()}
    if lacking := [k for k in (POSITIVE, NEGATIVE, TRUTH) if k not in found]:
        raise FileNotFoundError(f"no folder named: {', '.join(lacking)}")
    inside = lambda k: placed.filter(F.col("folder") == found[k])
    truth = inside(TRUTH).filter((text.suffix(F.col("path")) == ".txt") & text.stem(F.col("path")).rlike(r"^\d+$")).select(text.stem(F.col("path")).alias("stem"), F.col("path").alias("annotation_path"))
    positives = inside(POSITIVE).filter(is_image(F.col("path"))).select("path", text.stem(F.col("path")).alias("stem")).join(truth, "stem", "left").select("path", "annotation_path", F.lit(False).alias("is_background"))
    negatives = inside(NEGATIVE).filter(is_image(F.col("path"))).select("path", F.lit(None).cast("string").alias("annotation_path"), F.lit(True).alias("is_background"))
    both = positives.unionByName(negatives)
    return with_ordinal(both, [F.col("is_background"), text.components(F.col("path"))]).select("ordinal", F.col("path").alias("image_path"), "annotation_path", "is_background")


def has_items(spark: SparkSession, root: str) -> bool:
    """Whether a source tree is there: all three folders, by names alone."""
    try:
        files = listing(spark, root)
    except FileNotFoundError:
        return False
    kind = F.lower(text.parent(F.col("path")))
    return files.filter(kind.isin(POSITIVE, NEGATIVE, TRUTH)).select(kind.alias("kind")).distinct().count() == 3


def discover_images(files: DataFrame) -> DataFrame:
    """``ordinal, path`` of the images of a listing, in path order; none is an error."""
    images = files.filter(is_image(F.col("path"))).select("path")
    if images.isEmpty():
        raise FileNotFoundError("no supported images")
    return with_ordinal(images, [text.components(F.col("path"))])


def source_images(spark: SparkSession, source: str) -> DataFrame:
    """``ordinal, path`` of a source: one image, all images below a folder, those that a glob names, in path order, or a URL, which the detector fetches.

    A source that isn't there, holds no image or is a file of another kind raises.
    """
    if re.match("https?://", source):
        return spark.createDataFrame([(0, source)], "ordinal long, path string")
    found = walk.roots(spark, source)
    if len(found) == 1 and not found[0][2]:
        path = found[0][0]
        if not path.lower().endswith(IMAGE_SUFFIXES):
            raise ValueError(f"not a supported image: {path}")
        return spark.createDataFrame([(0, path)], "ordinal long, path string")
    return discover_images(listing(spark, source))


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store is a file; one that doesn't exist raises."""
    return not walk.roots(spark, path)[0][2]


def absolute(spark: SparkSession, path: str) -> str:
    """A path as listings give it, relative ones below the working folder; one that doesn't exist raises."""
    return walk.roots(spark, path)[0][0]


def image_headers(spark: SparkSession, root: str, digest: bool = True) -> DataFrame:
    """``path, width, height, mode, sha256, error`` of the images below a folder, read once; width and height are -1 where a file is no image.

    Without ``digest`` only their first bytes are read.
    """
    return walk.heads_below(spark, root, is_image, digest)


def annotation_lines(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """``path, line, said``: non-blank lines, stripped, with their number from 1; blank ones count."""
    rows = files.select(F.col(path).alias("path"), F.posexplode(text.lines(text.decoded(F.col(content)))).alias("k", "raw"))
    # of white space only these can end a line that is cut already
    return rows.select("path", (F.col("k") + 1).alias("line"), F.trim("raw", F.lit(" \t")).alias("said")).filter("said != ''")


def parsed_annotations(lines: DataFrame) -> DataFrame:
    """``path, line, said, valid`` and the five numbers, null where the line has another form."""
    said = F.col("said")
    valid = said.rlike(ANNOTATION)
    numbers = {c: F.when(valid, F.regexp_extract(said, ANNOTATION, k).try_cast("long")) for k, c in enumerate(("xmin", "ymin", "xmax", "ymax", "class_id"), 1)}
    return lines.withColumn("valid", valid).withColumns(numbers)


def annotation_errors(parsed: DataFrame) -> DataFrame:
    """``path, error``: the first line of each file that doesn't parse. Such a file is rejected whole."""
    bad = parsed.filter("not valid").groupBy("path").agg(F.min(F.struct("line", "said")).alias("b"))
    return bad.select("path", F.concat(F.lit("invalid annotation in "), "path", F.lit(":"), F.col("b.line").cast("string"), F.lit(": "), F.col("b.said")).alias("error"))


def annotation_boxes(parsed: DataFrame) -> DataFrame:
    """Boxes of the files that parse, numbered from 1 in line order."""
    good = parsed.join(annotation_errors(parsed).select("path"), "path", "left_anti")
    number = F.row_number().over(Window.partitionBy("path").orderBy("line")).cast("int")
    return good.select(F.col("path").alias("annotation_path"), number.alias("box_number"), "xmin", "ymin", "xmax", "ymax", "class_id")


def parsed_labels(lines: DataFrame) -> DataFrame:
    """Label lines with class, centre and size, and ``issues``: everything that is wrong with a line."""
    f, five = F.col("_f"), F.size("_f") == 5
    # one lambda for the four numbers: with all of them written out, the method that Spark generates for a stage passes 8000 bytes and the JVM only interprets it.
    # most lines are plain decimals, which one look at the line tells
    shares = F.when(F.col("said").rlike(PLAIN_LABEL), F.slice(f, 2, 4).try_cast("array<double>")).otherwise(F.transform(F.slice(f, 2, 4), text.number))
    values = [F.when(five, text.integer(F.get(f, F.lit(0)))).alias("class_id"), F.when(five, shares).alias("shares")]
    # fields are cut once, and the generator keeps the optimiser from copying the parsing into each of the checks below
    cut = lines.withColumn("_f", F.split(F.regexp_replace("said", r"\s+", " "), " ")).select(*lines.columns, five.alias("_five"), F.explode(F.array(F.struct(*values))).alias("_v"))
    out = cut.select(*lines.columns, "_five", "_v.class_id", *[F.get("_v.shares", F.lit(k)).alias(c) for k, c in enumerate(("x_center", "y_center", "width", "height"))])
    x, y, w, h = (F.col(c) for c in ("x_center", "y_center", "width", "height"))
    numeric = F.col("class_id").isNotNull() & x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    finite = text.is_finite(x) & text.is_finite(y) & text.is_finite(w) & text.is_finite(h)
    in_range = x.between(0, 1) & y.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1)
    said = lambda test, message: F.when(test, message)
    five = F.col("_five")
    usable = five & numeric & finite
    issues = (
        F.when(~five, F.array(F.lit("expected 5 fields")))
        .when(~numeric, F.array(F.lit("non-numeric value")))
        .when(~finite, F.array(F.lit("non-finite value")))
        .when(F.col("class_id").between(0, CLASSES - 1) & in_range & geometry.in_unit_square(x, y, w, h), F.array().cast("array<string>"))
        .otherwise(F.array_compact(F.array(said(~F.col("class_id").between(0, CLASSES - 1), "invalid class"), said(~in_range, "normalized value outside range"), said(~geometry.in_unit_square(x, y, w, h), "box outside image"))))
    )
    return out.withColumns({"usable": usable, "issues": issues}).drop("_five")


def label_boxes(parsed: DataFrame, width: Column, height: Column) -> DataFrame:
    """``path, index, class_id`` and corners in pixels; any issue but an unusual class raises, as does a class below 0."""
    wrong = F.array_except("issues", F.array(F.lit("invalid class")))
    some = F.when(F.size("issues") > 0, F.size(wrong) > 0).otherwise(F.lit(False))
    guard = F.when(some | (F.col("class_id") < 0), F.raise_error(F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.coalesce(F.get(wrong, F.lit(0)), F.lit("class below 0")))).cast("long")).otherwise(F.col("class_id"))
    corners = geometry.from_normalised(F.col("x_center"), F.col("y_center"), F.col("width"), F.col("height"), width, height)
    index = F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1
    return parsed.select("path", index.alias("index"), guard.alias("class_id"), *[c.alias(n) for n, c in corners.items()])


def source_ground_truth(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes of source annotations as ground truth: classes from 0; unknown classes and boxes outside raise."""
    b = geometry.box()
    fits = geometry.known_class(F.col("class_id")) & geometry.is_valid(b, width, height)
    guard = F.when(~F.coalesce(fits, F.lit(False)), F.raise_error(F.concat(F.lit("class or box outside its range: "), F.to_json(F.struct("*")))).cast("long")).otherwise(F.col("class_id") - FIRST_CLASS)
    return boxes.withColumn("class_id", guard).withColumns({c: F.col(c).cast("double") for c in ("xmin", "ymin", "xmax", "ymax")})


def label_of(images: DataFrame, labels: DataFrame, root: str, truth_root: str, source_layout: bool, one: bool = False) -> DataFrame:
    """``images`` with ``annotation_path``: the label with the image's relative path, or else with its stem; none for negatives of the source layout.

    With ``one`` the file ``truth_root`` is the label, whatever its name.
    """
    relative = F.regexp_replace(F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 30), r"\.[^./]*$", "")
    keyed = labels.filter(text.suffix(F.col("path")) == ".txt").select(F.regexp_replace(F.substring(F.col("path"), len(truth_root.rstrip("/")) + 2, 1 << 30), r"\.txt$", "").alias("_key"), F.col("path").alias("_label"))
    by_path = keyed.select(F.col("_key").alias("_rel"), F.col("_label").alias("_a"))
    by_stem = keyed.filter(~F.col("_key").contains("/")).select(F.col("_key").alias("_stem"), F.col("_label").alias("_b"))
    negative = F.exists(F.split(F.lower("path"), "/"), lambda p: p == NEGATIVE) if source_layout else F.lit(False)
    if one:
        return images.withColumn("annotation_path", F.when(~negative, F.lit(truth_root)))
    joined = images.withColumns({"_rel": relative, "_stem": text.stem(F.col("path"))}).join(by_path, "_rel", "left").join(by_stem, "_stem", "left")
    return joined.withColumn("annotation_path", F.when(~negative, F.coalesce("_a", "_b"))).drop("_rel", "_stem", "_a", "_b")


def read_manifest(spark: SparkSession, path: str, root: str, files: DataFrame | None = None) -> DataFrame:
    """``ordinal, image_path, annotation_path, is_background, split`` of a manifest, paths below ``root``.

    Every value is read as text and converted here. Missing columns, unknown splits and flags raise, and, if a listing is
    given, so do files that don't exist. Rows count from 2 in messages.
    """
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if lacking := [c for c in ("image_path", "annotation_path", "is_background", "split") if c not in raw.columns]:
        raise ConstraintError(f"manifest lacks columns: {', '.join(lacking)}")
    numbered = raw.withColumn("ordinal", F.monotonically_increasing_id())  # a multi-line file is one partition, in file order
    split, flag = text.stripped(F.col("split")), text.flag(F.col("is_background"))
    bad = numbered.filter(~F.coalesce(split.isin(*SPLITS), F.lit(False)) | flag.isNull()).orderBy("ordinal").first()
    if bad:
        raise ConstraintError(f"row {bad.ordinal + 2}: split {bad.split!r}, is_background {bad.is_background!r}")
    full = lambda c: F.concat(F.lit(root.rstrip("/") + "/"), c)
    annotation = text.stripped(F.coalesce("annotation_path", F.lit("")))
    out = numbered.select("ordinal", full(text.stripped(F.col("image_path"))).alias("image_path"), F.when(annotation != "", full(annotation)).alias("annotation_path"), flag.alias("is_background"), split.alias("split"))
    if files is not None:
        named = out.select("ordinal", F.explode(F.array_compact(F.array("image_path", "annotation_path"))).alias("path"))
        if gone := named.join(files.select("path"), "path", "left_anti").orderBy("ordinal").first():
            raise FileNotFoundError(f"row {gone.ordinal + 2}: {gone.path}")
    return out


def label_tree(files: DataFrame) -> DataFrame:
    """``split, kind, stem, path`` of the images and labels of an exported tree (.../images/<split>/..., .../labels/<split>/...)."""
    where = F.regexp_extract("path", r"/(images|labels)/(train|val|test)/[^/]+$", 0)
    part = F.split(where, "/")
    rows = files.withColumn("_w", where).filter("_w != ''").select(part[2].alias("split"), part[1].alias("kind"), text.stem(F.col("path")).alias("stem"), "path")
    return rows.filter(((F.col("kind") == "images") & is_image(F.col("path"))) | ((F.col("kind") == "labels") & (text.suffix(F.col("path")) == ".txt")))
