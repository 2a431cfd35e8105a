"""Constraints as rows that violate them. Callers take all rows, or raise on the first.

``rule`` says which check of the list failed, ``place`` where, so that the first violation is the same on every run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geometry, text
from gridloom.schemas import SPLITS


class ConstraintError(ValueError):
    """A constraint is violated."""


def split_name(given: str | None) -> str:
    """A source's split as it is compared, written and named: in lower case, without white space around it, ``external`` if there is none."""
    return (given or "").strip().lower() or "external"


def _rows(df: DataFrame, rule: int, place: Column, message: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), place.cast("string").alias("place"), message.alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def raise_first(violations: DataFrame) -> None:
    """Raise the violation that comes first by rule and place."""
    if first := violations.orderBy("rule", "place", "message").first():
        raise ConstraintError(first.message)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """``key, n`` of values that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def unresolved(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key isn't in the other table."""
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_anti")


def count_mismatch(parents: DataFrame, children: DataFrame, key: str, claimed: str) -> DataFrame:
    """``key, claimed, actual`` where the number that a parent claims isn't that of its children."""
    actual = children.groupBy(key).agg(F.count("*").alias("actual"))
    joined = parents.select(key, F.col(claimed).cast("long").alias("claimed")).join(actual, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)).cast("long"))
    return joined.filter("claimed is distinct from actual")


def overlaps(split: DataFrame, key: str) -> DataFrame:
    """``first, second, shared``: how many keys each two splits share; pairs that share none don't appear.

    One group per key collects its distinct splits, three at most, so no self-join is needed.
    """
    order = F.create_map(*[x for k, s in enumerate(SPLITS) for x in (F.lit(s), F.lit(k))])
    held = split.filter(F.col("split").isin(*SPLITS)).groupBy(key).agg(F.collect_set("split").alias("held")).filter(F.size("held") > 1)
    pairs = [(a, b) for k, a in enumerate(SPLITS) for b in SPLITS[k + 1 :]]
    both = F.array_compact(F.array(*[F.when(F.array_contains("held", a) & F.array_contains("held", b), F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"))) for a, b in pairs]))
    return held.select(F.explode(both).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("shared")).orderBy(order[F.col("first")], order[F.col("second")])


def split_violations(split: DataFrame, expected_total: int | None = None, require_backgrounds: bool = True) -> DataFrame:
    """Of ``image_path, is_background, split``: wrong names, empty splits, repeats, no backgrounds, overlaps, wrong total."""
    spark = split.sparkSession
    names = spark.createDataFrame([(k, s) for k, s in enumerate(SPLITS)], "k int, split string")
    per = split.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("image_path").alias("unique"), F.count_if("is_background").alias("backgrounds"))
    known = F.broadcast(names).join(per, "split", "left")
    out = [
        _rows(per.join(F.broadcast(names), "split", "left_anti"), 0, F.col("split"), F.concat(F.lit("unknown split: "), F.coalesce("split", F.lit("null")))),
        _rows(known.filter("n is null"), 1, F.col("k"), F.concat(F.lit("split is empty: "), "split")),
        _rows(known.filter("unique < n"), 2, F.col("k"), F.concat(F.lit("repeated image paths in split: "), "split")),
        _rows(overlaps(split, "image_path"), 4, F.concat("first", F.lit(" "), "second"), F.concat_ws(" ", "first", F.lit("and"), "second", F.lit("share"), F.col("shared").cast("string"), F.lit("images"))),
    ]
    if require_backgrounds:
        out.append(_rows(known.filter("n is not null and backgrounds = 0"), 3, F.col("k"), F.concat(F.lit("no background images in split: "), "split")))
    if expected_total is not None:
        total = split.agg(F.count("*").alias("n")).filter(F.col("n") != expected_total)
        out.append(_rows(total, 5, F.lit(0), F.concat(F.lit(f"expected {expected_total} images, found "), F.col("n").cast("string"))))
    return union(out)


def inference_violations(images: DataFrame, detections: DataFrame) -> DataFrame:
    """Of the tables of a prediction run: repeated ids, missing names, impossible numbers, unknown images, boxes outside, wrong counts."""
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    image, detection = F.col("image_id"), F.col("detection_id")
    joined = detections.join(images.select("image_id", "image_width", "image_height"), "image_id", "left")
    box = geometry.is_valid(geometry.box(), F.col("image_width"), F.col("image_height"))
    known = joined.filter("image_width is not null")
    return union(
        [
            _rows(repeated(images, "image_id"), 0, image, said("image id is not unique: ", image)),
            _rows(repeated(detections, "detection_id"), 1, detection, said("detection id is not unique: ", detection)),
            _rows(images.filter("coalesce(dataset_id, '') = ''"), 2, image, said("no dataset id: ", image)),
            _rows(images.filter("coalesce(source_split, '') = ''"), 3, image, said("no source split: ", image)),
            _rows(images.filter("not (image_width > 0 and image_height > 0)"), 4, image, said("impossible dimensions: ", image)),
            _rows(images.filter("prediction_count < 0"), 5, image, said("impossible prediction count: ", image)),
            _rows(unresolved(detections, "image_id", images, "image_id"), 6, detection, said("detection of an unknown image: ", detection)),
            _rows(known.filter("predicted_class_id < 0"), 7, detection, said("impossible class: ", detection)),
            _rows(known.filter("coalesce(predicted_class_name, '') = ''"), 8, detection, said("no class name: ", detection)),
            _rows(known.filter(~F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False))), 9, detection, said("impossible confidence: ", detection)),
            _rows(known.filter(~F.coalesce(box, F.lit(False))), 10, detection, said("box outside its image: ", detection)),
            _rows(count_mismatch(images, detections, "image_id", "prediction_count"), 11, image, said("prediction count of ", image, ": ", F.col("claimed"), " claimed, ", F.col("actual"), " found")),
        ]
    )


def inference_totals(images: DataFrame, detections: DataFrame) -> DataFrame:
    """images, detections, images_without_detections."""
    n = detections.agg(F.count("*").alias("detections"))
    return images.agg(F.count("*").alias("images"), F.count_if(F.col("prediction_count") == 0).alias("images_without_detections")).join(F.broadcast(n)).select("images", "detections", "images_without_detections")


def held_out(sources: DataFrame, manifest: DataFrame, key: str, source_split: str = "external", allow_test: bool = False) -> DataFrame:
    """Source rows that the manifest keeps for testing; none where that is allowed. All rows if the whole source is a test split.

    Names of splits count whatever their case and the white space around them.
    """
    if allow_test:
        return sources.limit(0)
    if split_name(source_split) == "test":
        return sources
    return sources.join(manifest.filter(F.lower(text.stripped(F.col("split"))) == "test").select(key), key, "left_semi")


def guard_held_out(sources: DataFrame, manifest: DataFrame, key: str, source_split: str = "external", allow_test: bool = False) -> None:
    """Raise before any image of a test split reaches a model, unless that was asked for."""
    if not held_out(sources, manifest, key, source_split, allow_test).isEmpty():
        raise ConstraintError("test images need source.allow_test=true")
