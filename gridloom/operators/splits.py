"""Stratified splits of items with several labels each, and the joins of split manifests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.schemas import CLASSES, FIRST_CLASS, SPLITS
from gridloom.operators.constraints import ConstraintError


@dataclass(frozen=True)
class SplitConfig:
    """Shares of the splits, which sum to one, and the seed of the placement."""

    train_ratio: float = 0.70
    val_ratio: float = 0.15
    test_ratio: float = 0.15
    seed: int = 42

    def __post_init__(self) -> None:
        ratios = (self.train_ratio, self.val_ratio, self.test_ratio)
        if any(r <= 0 for r in ratios):
            raise ValueError("split ratios must be positive")
        if abs(sum(ratios) - 1) > 1e-9:
            raise ValueError("split ratios must sum to 1")


def multilabel_targets(items: DataFrame, boxes: DataFrame, key: str = "image_path", first: int = FIRST_CLASS, classes: int = CLASSES) -> DataFrame:
    """``key, targets``: for each class whether it occurs (0 or 1), and last whether the item is background."""
    held = boxes.groupBy(key).agg(F.collect_set("class_id").alias("held"))
    joined = items.select(key, "is_background").join(held, key, "left")
    flags = [F.when(F.coalesce(F.array_contains("held", F.lit(first + k).cast("long")), F.lit(False)), 1).otherwise(0) for k in range(classes)]
    return joined.select(key, F.array(*flags, F.when(F.col("is_background"), 1).otherwise(0)).alias("targets"))


def target_violations(items: DataFrame, boxes: DataFrame, key: str = "image_path", first: int = FIRST_CLASS, classes: int = CLASSES) -> DataFrame:
    """Positives without annotation, and boxes whose class isn't one of the classes."""
    a = items.filter("not is_background and annotation_path is null").select(key, F.lit("positive image without an annotation file").alias("message"))
    b = boxes.filter(~F.col("class_id").between(first, first + classes - 1)).select(key, F.concat(F.lit("class out of range: "), F.col("class_id").cast("string")).alias("message"))
    return a.unionByName(b)


def _shares(counts: DataFrame, config: SplitConfig) -> DataFrame:
    """``_c, _train, _val, _n``: how many items of each label combination go where.

    Combinations stand in a row by their rarest label, rarest first, and every boundary between splits is the rounded share of the
    items up to it. So each combination, all combinations of one rarest label, and the whole are within one item of their shares.
    Rows are label combinations here, not items.
    """
    label = counts.select("_c", "_n", F.posexplode(F.split("_c", "")).alias("_k", "_set")).filter("_set = '1'")
    sizes = label.groupBy("_k").agg(F.sum("_n").alias("_size"))
    rarest = label.join(sizes, "_k").groupBy("_c").agg(F.min(F.struct("_size", "_k")).alias("_rarest"))
    row = Window.orderBy(F.col("_rarest").isNull(), "_rarest", "_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rounded = lambda total, share: F.floor(total * F.lit(share) + F.lit(0.5)).cast("long")
    ordered = counts.join(rarest, "_c", "left").withColumn("_upto", F.sum("_n").over(row))
    first = ordered.withColumn("_train", rounded(F.col("_upto"), config.train_ratio) - rounded(F.col("_upto") - F.col("_n"), config.train_ratio))
    second = first.withColumn("_rest", F.col("_n") - F.col("_train")).withColumn("_upto", F.sum("_rest").over(row))
    share = config.val_ratio / (config.val_ratio + config.test_ratio)
    return second.select("_c", "_n", "_train", (rounded(F.col("_upto"), share) - rounded(F.col("_upto") - F.col("_rest"), share)).alias("_val"))


def stratified(targets: DataFrame, config: SplitConfig | None = None, key: str = "image_path", bucket: int = 10_000) -> DataFrame:
    """``key, split``: every item in one split, label shares near the ratios, the same for the same keys and seed.

    First training against the rest, then the rest into validation and test, by whole counts per label combination (``_shares``). Within its
    combination an item's place is its rank by a seeded MD5 of its key, then the key. Combinations with more items than ``bucket`` are
    ranked in ranges of that hash, so that a frequent one isn't one task.
    """
    config = config or SplitConfig()
    if not repeated_keys(targets, key).isEmpty():
        raise ConstraintError("repeated image paths")
    named = targets.select(key, F.concat_ws("", F.transform("targets", lambda x: x.cast("string"))).alias("_c"))
    counts = named.groupBy("_c").agg(F.count("*").alias("_n"))
    if counts.isEmpty():
        raise ConstraintError("no items to split")
    table = _shares(counts, config).withColumn("_buckets", F.ceil(F.col("_n") / bucket)).drop("_n")
    hashed = named.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(config.seed)))))
    start = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")  # ranges of the hash, in its order
    dealt = hashed.join(table, "_c").withColumn("_b", F.shiftright(start * F.col("_buckets"), 32))
    sizes = dealt.groupBy("_c", "_b").agg(F.count("*").alias("_m"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_m").over(Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    ranked = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_c", "_b").orderBy("_h", key)) - 1).join(before, ["_c", "_b"])
    place = F.col("_k") + F.col("_before")
    split = F.when(place < F.col("_train"), SPLITS[0]).when(place < F.col("_train") + F.col("_val"), SPLITS[1]).otherwise(SPLITS[2])
    return ranked.select(key, split.alias("split"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)


def effective_split(sources: DataFrame, manifest: DataFrame, key: str, source_split: str = "external") -> DataFrame:
    """Every source row with the manifest's split, or else the source's own."""
    return sources.join(manifest.select(key, F.col("split").alias("_s")), key, "left").withColumn("split", F.coalesce("_s", F.lit(source_split))).drop("_s")


def matched_counts(sources: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """matched, unmatched."""
    joined = sources.select(key).join(manifest.select(key, F.lit(True).alias("hit")), key, "left")
    return joined.agg(F.count_if("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"))


def split_summary(items: DataFrame, boxes: DataFrame, key: str = "image_path") -> DataFrame:
    """``split, images, backgrounds, objects``."""
    per = boxes.groupBy(key).agg(F.count("*").alias("objects"))
    return items.join(per, key, "left").groupBy("split").agg(F.count("*").alias("images"), F.count_if("is_background").alias("backgrounds"), F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"))


def objects_by_class(items: DataFrame, boxes: DataFrame, key: str = "image_path") -> DataFrame:
    """``split, class_id, n`` with classes counted from 0."""
    return items.select(key, "split").join(boxes.select(key, (F.col("class_id") - FIRST_CLASS).alias("class_id")), key).groupBy("split", "class_id").agg(F.count("*").alias("n"))
