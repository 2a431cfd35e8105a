"""Mixing sources to target weights by Pfair scheduling.

Each source is a task whose share of the output is its weight. The fluid schedule gives each source its exact
share at every moment; when a source runs out, the rest go on with their weights in proportion. A source's
j-th block is released in the slot in which its fluid amount leaves j - 1, and due when it reaches j; of the released
blocks the one due first goes next. The fluid schedule keeps these windows and never idles, so earliest deadlines first
does, too: at every moment each source is less than one block from its fluid amount, however long the run and
however many the sources. Weights are the exact values of the given numbers, and all sums are whole numbers.

The driver orders the blocks, about BLOCKS at most (and one more for each source) whatever the corpus: blocks of a larger corpus
hold more documents. A document's slot is then looked up by its block's number, so documents are placed in parallel.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents per block at least, and blocks at most, so that the driver's part is bounded; blocks of a source whose slots travel as one
#: row; documents per bucket for ranks.
BLOCK, BLOCKS, PERIOD, BUCKET = 32, 1 << 20, 1000, 4096
#: Blocks whose slots (8 bytes each), and sources whose names, are broadcast; more are joined.
SMALL = 1 << 20


@dataclass(frozen=True)
class Span:
    """A source's blocks: first.. of a source take slots start + (n // share) * period + offsets[n % share]."""

    source: int
    first: int
    blocks: int
    start: int
    share: int
    period: int
    offsets: Sequence[int]


def exact(weights: Sequence[float | Fraction]) -> list[int]:
    """Whole numbers in the same proportions."""
    given = [Fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in given))
    whole = [w.numerator * (scale // w.denominator) for w in given]
    common = math.gcd(*whole)
    return [w // common for w in whole]


def dealt(blocks: Sequence[int], weights: Sequence[float | Fraction]) -> list[array]:
    """The slots of each source's blocks, in order: earliest deadline first among released blocks, ties to the earlier source."""
    out = [array("q") for _ in blocks]
    if not any(blocks):
        return out
    live = [k for k, n in enumerate(blocks) if n]
    weigh = dict(zip(live, exact([weights[k] for k in live]), strict=True))
    # the fluid schedule in pieces: a source of weight w has w * v at moment gone + rate * v, until v reaches the piece's end n / w
    live.sort(key=lambda k: Fraction(blocks[k], weigh[k]))
    gone, rate = 0, sum(weigh.values())
    pieces = []
    for k in live:
        pieces.append((gone, rate, blocks[k], weigh[k]))
        gone, rate = gone + blocks[k], rate - weigh[k]
    at = dict.fromkeys(live, 0)  # the piece in which each source's last block came due

    def window(k: int, j: int) -> tuple[int, int, int, int]:
        """Release and deadline of block j; its piece is sought from that of the block before, where it is released."""
        w, low = weigh[k], at[k]
        gone, rate, _, _ = pieces[low]
        release = gone + rate * (j - 1) // w
        step, high = 1, low  # mostly the same piece; else steps double until one is passed, and halves find the first that lasts long enough
        while j * pieces[high][3] > pieces[high][2] * w:
            low, high, step = high + 1, min(high + step, len(pieces) - 1), 2 * step
        p = at[k] = bisect_left(pieces, True, low, high, key=lambda piece: j * piece[3] <= piece[2] * w)
        gone, rate, _, _ = pieces[p]
        return release, gone - (-rate * j // w), k, j

    waiting = [window(k, 1) for k in live]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            _, due, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, k, j))
        _, k, j = heapq.heappop(ready)
        out[k].append(slot)
        if j < blocks[k]:
            heapq.heappush(waiting, window(k, j + 1))
    return out


def schedule(blocks: Sequence[int], weights: Sequence[float | Fraction], period: int = PERIOD) -> list[Span]:
    """Spans that together give each block of each source a slot, without gaps; of ``period`` blocks of a source at most."""
    slots = dealt(blocks, weights)
    total = sum(blocks)
    return [Span(k, at, len(part), 0, len(part), total, part) for k, own in enumerate(slots) for at in range(0, len(own), period) if (part := own[at : at + period])]


def mix(docs: DataFrame, weights: Mapping[str | None, float | Fraction] | None = None, block: int | None = None, period: int = PERIOD, seed: int = 0, keep: bool = False) -> DataFrame:
    """Place every document in the mixed order.

    Returns ``doc_id, source, block, slot, position``, or with ``keep`` all columns of ``docs`` and these last
    three: the block's number within its source, the slot that the schedule gives it, and ``slot * block`` plus
    the place within the block, by which to sort. Within a source the order is by a seeded hash of the id.
    ``weights``: target weight of each source, above 0; sources not named, and all if it is None, weigh the
    square root of their number of documents, scaled so that the named ones keep their ratio to the mean.
    They may be Fractions, too; any number of sources keeps within a block of its exact share. ``period``: slots per row of the table
    in which they travel. ``block``: documents per block, by default BLOCK or as many as keep the number of blocks near BLOCKS. Null is a source of its own. Rows that repeat are placed one after another. No row is dropped or repeated.

    Shuffles: one count per source and bucket of hashes, and one by bucket to rank rows; a source of any size is spread over its buckets.
    """
    own = (docs if keep else docs.select("doc_id", "source")).drop("block", "slot", "position")
    mark = "_"
    while any(c.lower().startswith(mark) for c in own.columns):  # names of columns in between must not clash
        mark += "_"
    key, bucket, part, slots, n, hashed, rank, ahead, label = (mark + c for c in ("k", "bucket", "part", "slots", "n", "hash", "rank", "ahead", "source"))
    named = own.withColumn(hashed, F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)))
    sizes = named.groupBy("source").agg(F.count("*").alias("n")).collect()
    spark = docs.sparkSession
    if not sizes:
        return own.withColumns({c: F.lit(0).cast("long") for c in ("block", "slot", "position")})
    sizes.sort(key=lambda r: (r.source is None, r.source or ""))
    block = block or max(BLOCK, -(-sum(r.n for r in sizes) // BLOCKS))
    given = dict(weights or {})
    if any(w <= 0 for w in given.values()):
        raise ValueError("weights must be above 0")
    root = [r.n**0.5 for r in sizes]
    scale = float(sum(given.values())) / len(given) / (sum(root) / len(root)) if given else 1.0
    weigh = [given.get(r.source, x * scale) for r, x in zip(sizes, root, strict=True)]
    spans = schedule([-(-r.n // block) for r in sizes], weigh, period)
    small = spark.createDataFrame([(r.source, k, -(-r.n // BUCKET)) for k, r in enumerate(sizes)], f"{label} string, {key} int, {bucket}s long")
    table = spark.createDataFrame(pa.table({key: pa.array([s.source for s in spans], pa.int32()), part: pa.array([s.first // period for s in spans], pa.int64()), slots: pa.array([np.frombuffer(s.offsets, np.int64) for s in spans], pa.list_(pa.int64()))}))
    if len(sizes) <= SMALL:
        small = F.broadcast(small)
    if sum(s.blocks for s in spans) <= 2 * SMALL:
        table = F.broadcast(table)
    spread = named.join(small, F.col("source").eqNullSafe(F.col(label))).drop(label).withColumn(bucket, F.pmod(F.shiftrightunsigned(hashed, 20), F.col(f"{bucket}s")))
    # how many rows of the source come in buckets before: a row per BUCKET documents, so not broadcast but joined
    full = spread.groupBy(key, bucket).agg(F.count("*").alias(n))
    before = full.withColumn(ahead, F.sum(n).over(Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))).select(key, bucket, F.coalesce(ahead, F.lit(0)).alias(ahead))
    place = Window.partitionBy(key, bucket).orderBy(hashed, "doc_id")
    ranked = spread.withColumn(rank, F.row_number().over(place) - 1).join(before, [key, bucket]).withColumn(rank, F.col(ahead) + F.col(rank))
    ranked = ranked.withColumn("block", F.floor(F.col(rank) / block)).withColumn(part, F.floor(F.col("block") / period)).join(table, [key, part])
    out = ranked.withColumn("slot", F.get(slots, (F.col("block") % period).cast("int"))).withColumn("position", F.col("slot") * block + F.col(rank) % block)
    return out.select(*own.columns, "block", "slot", "position")
