"""Connected components of a graph whose links stay distributed.

Rounds of large-star and small-star: every node passes its least neighbour on to the others, so that
trees flatten until each node hangs on the least node of its component. Before that,
each task joins what it can see of the links, which leaves few rounds. Hot nodes are harmless:
minima are pre-aggregated, and the join back is one that Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import remove, shared_dir, written

SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block as (node, least node of its tree within the block)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            u, v = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=SCHEMA)


def _settled(table: DataFrame) -> bool:
    """Whether each node hangs on one node that hangs on none. Counts are pre-aggregated, so hot nodes are harmless."""
    ends = F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), F.struct(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    nodes = table.select(F.explode(ends).alias("e")).select("e.*").groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not nodes.filter("hangs > 1 OR (hangs = 1 AND holds = 1)").limit(1).count()


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """``node, component`` (the least id reachable) for every node of ``links`` (``a``, ``b``: long) that isn't the least itself.

    Links to itself and repeated links don't matter; nodes without links don't appear. An empty table gives none.
    """
    spark = links.sparkSession
    root = shared_dir(spark)
    start = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    table = written(start.mapInArrow(_forests, "u long, v long").distinct(), "0", root)
    for turn in range(1, limit):
        if _settled(table):
            return table.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = both.withColumn("m", F.least("u", "v")).groupBy("u").agg(F.min("m").alias("m"))
        large = both.filter("v > u").join(ends, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l")).select("l.*").filter("u > v").distinct()
        table = written(small, str(turn), root)
        if turn > 1:
            remove(spark, f"{root}/{turn - 2}")
    raise RuntimeError(f"components did not settle in {limit} rounds")


def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with the group of each side, ``ga`` and ``gb``; a node without links is its own group."""
    for side in ("a", "b"):
        named = labels.select(F.col("node").alias(side), F.col("component").alias(f"g{side}"))
        pairs = pairs.join(named, side, "left").withColumn(f"g{side}", F.coalesce(f"g{side}", side))
    return pairs


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """What ``components`` gives for the links behind ``labels`` and for ``links`` together.

    Rounds see groups and the links between them only; a group's id is its least node, so the least group is the least node.
    """
    groups = components(labelled(links, labels).select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    moved = groups.select(F.col("node").alias("component"), F.col("component").alias("to"))
    renamed = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(renamed.unionByName(groups), "extended", shared_dir(links.sparkSession))
