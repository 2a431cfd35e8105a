"""Profile of a dataset: what is wrong with it, and what is in it.

``items`` (ordinal, image_path, is_background), ``boxes`` (image_path, box_number, corners, class_id) and ``images``
(image_path, width, height, mode, sha256) are read once each; every figure is an aggregate of their joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geometry, text
from gridloom.schemas import SIZES

ISSUE = ("image", "type", "message")


def measured(boxes: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """``boxes`` with box_width, box_height, relative_area, size, is_known and is_valid."""
    b, w, h = geometry.box(), F.col(width), F.col(height)
    out = boxes.withColumns({"box_width": b[2] - b[0], "box_height": b[3] - b[1], "relative_area": geometry.relative_area(b, w, h), "is_valid": geometry.is_valid(b, w, h), "is_known": geometry.known_class(F.col("class_id"))})
    return out.withColumn("size", geometry.size_class(F.col("relative_area")))


def box_records(measured_boxes: DataFrame) -> DataFrame:
    """Boxes with an area inside their image, whatever their class."""
    return measured_boxes.filter("is_valid").select(text.name(F.col("image_path")).alias("image"), "class_id", "xmin", "ymin", "xmax", "ymax", "box_width", "box_height", "relative_area", "size")


def box_issues(measured_boxes: DataFrame, image: Column | None = None, width: str = "width", height: str = "height") -> DataFrame:
    """Rows for unknown classes and for invalid boxes; a box may have both."""
    number, corners = F.col("box_number"), F.concat_ws(",", "xmin", "ymin", "xmax", "ymax")
    found = F.array_compact(
        F.array(
            F.when(~F.col("is_known"), F.struct(F.lit("unknown_class").alias("type"), F.format_string("Box %d: class %d", number, F.col("class_id")).alias("message"))),
            F.when(~F.col("is_valid"), F.struct(F.lit("invalid_box").alias("type"), F.format_string("Box %d: (%s), image size=%dx%d", number, corners, F.col(width), F.col(height)).alias("message"))),
        )
    )
    return measured_boxes.select((F.col("image_path") if image is None else image).alias("image"), F.explode(found).alias("i")).select("image", "i.type", "i.message")


def item_issues(items: DataFrame, images: DataFrame, parsed: DataFrame) -> DataFrame:
    """The first of: unreadable image, no annotation for a positive, an annotation that doesn't parse. ``parsed``: annotation_path, error."""
    joined = items.join(images, "image_path", "left").join(parsed, "annotation_path", "left")
    kind = (
        F.when(F.coalesce(F.col("width"), F.lit(-1)) < 0, "unreadable_image")
        .when(~F.col("is_background") & F.col("annotation_path").isNull(), "missing_annotation")
        .when(~F.col("is_background") & F.col("error").isNotNull(), "annotation_parse_error")
    )
    message = F.when(kind == "unreadable_image", "image cannot be decoded").when(kind == "missing_annotation", "positive image without an annotation file").otherwise(F.col("error"))
    return joined.select(F.col("image_path").alias("image"), kind.alias("type"), message.alias("message")).filter("type is not null")


def totals(items: DataFrame, readable: Column | None = None) -> DataFrame:
    """total_images, positive_images, background_images, readable_images."""
    can = F.lit(True) if readable is None else readable
    return items.agg(F.count("*").alias("total_images"), F.count_if(~F.col("is_background")).alias("positive_images"), F.count_if("is_background").alias("background_images"), F.count_if(can).alias("readable_images"))


def class_counts(boxes: DataFrame) -> DataFrame:
    """Over all boxes that parse, invalid ones too."""
    return boxes.groupBy("class_id").agg(F.count("*").alias("n"))


def size_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("size").agg(F.count("*").alias("n"))


def size_counts_in_order(records: DataFrame) -> DataFrame:
    """All three sizes, smallest first, 0 where there is none."""
    order = records.sparkSession.createDataFrame([(k, s) for k, s in enumerate(SIZES)], "place int, size string")
    return F.broadcast(order).join(size_counts(records), "size", "left").select("place", "size", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_imbalance(counts: DataFrame) -> DataFrame:
    """Most and fewest boxes of a class, and their ratio."""
    return counts.agg(F.max("n").alias("most"), F.min("n").alias("fewest"), (F.max("n") / F.min("n")).alias("ratio"))


def dimension_histogram(images: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    return images.groupBy(F.concat_ws("x", F.col(width).cast("string"), F.col(height).cast("string")).alias("dimensions")).agg(F.count("*").alias("n"))


def most_common(counts: DataFrame, key: str, n: int) -> DataFrame:
    """The n largest counts, ties by key: a top-k report."""
    return counts.orderBy(F.desc("n"), key).limit(n)


def mode_histogram(images: DataFrame) -> DataFrame:
    """How many images have which mode; those that can't be read have none and aren't counted."""
    return images.filter("mode is not null").groupBy("mode").agg(F.count("*").alias("n"))


def objects_per_image(images: DataFrame, boxes: DataFrame, key: str = "image_path") -> DataFrame:
    """How many images have how many boxes; ``images``: those whose annotation parsed, or that need none."""
    per = boxes.groupBy(key).agg(F.count("*").alias("objects"))
    counted = images.select(key).join(per, key, "left").withColumn("objects", F.coalesce("objects", F.lit(0)).cast("long"))
    return counted.groupBy("objects").agg(F.count("*").alias("images"))


def area_stats(records: DataFrame) -> DataFrame:
    return records.agg(F.min("relative_area").alias("least"), F.max("relative_area").alias("most"), F.avg("relative_area").alias("mean"))


def duplicate_groups(files: DataFrame, content: Column, name: str, order: str) -> DataFrame:
    """``sha256, members, copies`` of contents that occur more than once; members in input order.

    Only hashes and names meet in a group, never contents. Counts come first, so that unique contents don't collect.
    """
    hashed = files.select(F.sha2(content, 256).alias("sha256"), F.col(order).alias("o"), F.col(name).alias("m"))
    return hashed.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("o", "m"))).alias("l")).filter(F.size("l") > 1).select("sha256", F.transform("l", lambda x: x["m"]).alias("members"), F.size("l").cast("long").alias("copies"))


def duplicate_totals(files: DataFrame, content: Column) -> DataFrame:
    """Unique contents, and copies beyond the first of each."""
    per = files.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("unique_contents"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_copies"))


def missing_and_orphan(images: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Images without annotation, and annotations without image."""
    a = images.select(key).join(annotations.select(key), key, "left_anti").select(key, F.lit("missing").alias("kind"))
    b = annotations.select(key).join(images.select(key), key, "left_anti").select(key, F.lit("orphan").alias("kind"))
    return a.unionByName(b)


def suffix_histogram(files: DataFrame, path: str = "path") -> DataFrame:
    """How many files have which suffix."""
    kind = text.suffix(F.col(path))
    return files.groupBy(F.when(kind == "", "[no extension]").otherwise(kind).alias("suffix")).agg(F.count("*").alias("n"))


def corner_checks(boxes: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Two looser checks, as flags: corners in the wrong order, and corners outside the image."""
    x0, y0, x1, y1 = geometry.box()
    return boxes.withColumns({"reversed": (x0 >= x1) | (y0 >= y1), "outside": (x0 < 0) | (y0 < 0) | (x1 > F.col(width)) | (y1 > F.col(height))})


def inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """``kind, n`` of all files: JPEG images, text files and others, and within each whether the stem is a number."""
    suffix = text.suffix(F.col(path))
    kind = F.when(suffix.isin(".jpg", ".jpeg"), "jpg").when(suffix == ".txt", "txt").otherwise("other")
    stem = F.when(text.stem(F.col(path)).rlike("^[0-9]+$"), "numeric").otherwise("named")
    return files.groupBy(kind.alias("kind"), stem.alias("stem")).agg(F.count("*").alias("n"))


def first_files(files: DataFrame, n: int = 40, path: str = "path") -> DataFrame:
    """The first paths, component by component."""
    return files.orderBy(text.components(F.col(path))).limit(n).select(path)


def seeded_sample(rows: DataFrame, key: str, n: int = 6, seed: int = 42) -> DataFrame:
    """``n`` rows by a seeded hash of their key: the same ones however the rows are dealt."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def profile(sized: DataFrame, measured_boxes: DataFrame, objects: DataFrame) -> DataFrame:
    """``figure, key, n``: all counts of an audit at once; figures without parts have an empty key.

    ``sized``: is_background, width (-1 where unreadable), height, mode; ``measured_boxes``: of ``measured``; ``objects``: of ``objects_per_image``. Every row
    names the counts that it adds to, and these are summed before anything is shuffled: each input is read once.
    """
    mark = lambda figure, key="": F.struct(F.lit(figure).alias("figure"), (F.lit(key) if isinstance(key, str) else key.cast("string")).alias("key"), F.lit(1).cast("long").alias("n"))
    readable, size = F.col("width") >= 0, F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    image = [mark("total_images"), F.when(F.col("is_background"), mark("background_images")).otherwise(mark("positive_images")), F.when(readable, mark("readable_images")), F.when(readable, mark("dimension_counts", size)), F.when(readable, mark("mode_counts", F.col("mode")))]
    box = [mark("class_counts", F.col("class_id")), F.when(F.col("is_valid"), mark("total_objects")), F.when(F.col("is_valid"), mark("size_counts", F.col("size")))]
    marks = [df.select(F.explode(F.array_compact(F.array(*own))).alias("m")).select("m.*") for df, own in ((sized, image), (measured_boxes, box))]
    marks.append(objects.select(F.lit("objects_per_image").alias("figure"), F.col("objects").cast("string").alias("key"), F.col("images").alias("n")))
    return reduce(DataFrame.unionByName, marks).groupBy("figure", "key").agg(F.sum("n").alias("n"))


def summary(report: dict) -> str:
    """A report's totals, classes and sizes as text for a console."""
    # What a report is known by, and how that is said.
    said = {"total_images": "Total images", "positive_images": "Positive images", "background_images": "Background images", "readable_images": "Readable images", "total_objects": "Total objects"}
    lines = [f"{words}: {report[key]}" for key, words in said.items()]
    lines += [f"Issues: {len(report['issues'])}", f"Duplicate groups: {len(report['duplicate_groups'])}"]
    for key, words in (("class_counts", "Class counts"), ("size_counts", "Object sizes")):
        lines += [f"{words}:", *(f"  {name}: {n}" for name, n in report[key].items())]
    return "\n".join(lines)
