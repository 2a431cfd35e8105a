"""Near-duplicate vectors, and exact top-k by inner product.

Near duplicates: in each of several tables a vector's key is the signs of its products with random
hyperplanes. Vectors with equal label and key meet in a bucket, are compared exactly, and a pair counts in
the first table where it meets. Equal vectors are one for all of this. Buckets larger than a tile are cut
into tiles of block against block; a bucket gives counts and a few links, never all its pairs.

Top-k: vectors are packed into blocks that know the least and greatest value of each dimension.
A query visits only blocks whose bound, the sum of each dimension's best product, reaches its k-th score.
Queries travel in chunks, packs in lanes of a few; every chunk meets every lane in a task of its own, which holds one
pack and one chunk at a time. Only numbers of chunks and lanes are broadcast.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import arrow_schema, remove, shared_dir, written
from gridloom.llm.components import components, forest

#: Tables and signs per key: at a cosine of 0.98 a pair meets in a table with probability 0.936 ** 16 = 0.35, in any of 20 with 0.9998.
TABLES, SIGNS = 20, 16
#: Vectors of one side of a tile.
TILE = 1024
#: Vectors per pack and per block of a pack, queries per chunk, and packs per lane.
PACK, BLOCK, CHUNK, LANE = 4096, 64, 16384, 16
#: Components of a pack or chunk at most, so that long vectors travel in smaller ones.
CELLS = 1 << 20


def usable(vector: str) -> Column:
    """Not null, and all components finite numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def hyperplanes(dimensions: int, tables: int, signs: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * signs, dimensions))


def _keys(vectors: list[np.ndarray], labels: list, tables: int, signs: int, seed: int) -> np.ndarray:
    """A key per vector and table, from label, dimension, table and signs."""
    out = np.zeros((len(vectors), tables), np.uint64)
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        own = np.stack([vectors[r] for r in rows])
        sides = (own / np.abs(own).max(1, initial=1e-300)[:, None]) @ hyperplanes(size, tables, signs, seed).T >= 0
        bits = np.packbits(sides.reshape(len(rows), tables, signs), axis=2)
        for k, r in enumerate(rows):
            out[r] = [xxhash.xxh3_64_intdigest(b"%d|%d|%d|" % (labels[r], size, t) + bits[k, t].tobytes()) for t in range(tables)]
    return out


def near_duplicates(table: DataFrame, least: float = 0.98, tables: int = TABLES, signs: int = SIGNS, seed: int = 7, salt: int = 0) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: links to other rows with equal, non-null label and a cosine
    (in double precision) of ``least`` or more.

    Null and zero vectors, those with null or non-finite components, and rows without label link with nothing. Vectors of different
    length don't link. Rows that repeat a vec_id are rows of their own for links, and one node for components. No
    pair below ``least`` links; of those above, all whose keys agree in a table are found (0.9998 of pairs at
    exactly 0.98, more above). Other columns are not read.
    """
    spark = table.sparkSession
    root = shared_dir(spark)
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    able = usable("v") & F.col("label").isNotNull() & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are one value; equal vectors are one class
    named = rows.withColumn("able", F.coalesce(able, F.lit(False))).withColumn("v", F.when(F.col("able"), F.transform("v", lambda x: x + F.lit(0.0))))
    named = written(named.withColumn("class", F.when(F.col("able"), F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.concat_ws(",", F.transform("v", lambda x: x.cast("string")))), 256))), "rows", root)
    classes = named.filter("able").groupBy("class").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("label").alias("label"))
    cid = F.xxhash64("class", F.lit(salt)) if salt else F.xxhash64("class")
    classes = written(classes.select("class", cid.alias("cid"), "id", "n", "v", "label"), "classes", root)
    if classes.groupBy("cid").count().filter("count > 1").limit(1).count():  # two classes with one number: number them anew
        remove(spark, root)
        return near_duplicates(table, least, tables, signs, seed, salt + 1)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v, float) for v in batch.column("v").to_pylist()]
            found = _keys(vectors, batch.column("label").to_pylist(), tables, signs, seed)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([*found.view(np.int64)], pa.list_(pa.int64()))], names=["cid", "keys"])

    keyed = written(classes.select("cid", "v", "label").mapInArrow(keys, "cid long, keys array<long>"), "keys", root)
    exploded = keyed.select("cid", F.explode("keys").alias("key"))
    # buckets of one are most of them, and go before vectors travel
    sizes = exploded.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    met = exploded.join(sizes, "key").withColumn("blocks", F.ceil(F.col("m") / TILE).cast("int"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    tile = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("r"), F.greatest(own, o).alias("c")))
    tiles = met.withColumn("own", own).withColumn("tile", F.explode(tile)).select("cid", "key", "own", "tile.r", "tile.c")
    dealt = tiles.join(classes.select("cid", "n", "v").join(keyed, "cid"), "cid").repartition("key", "r", "c").sortWithinPartitions("key", "r", "c", "cid")
    ddl = "a long, b long, links long"
    schema = arrow_schema(ddl)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, null, links): how many rows a class links to here. Rows (a, b, null): links that connect."""
        now, held = None, []

        def bucket() -> list[pa.RecordBatch]:
            (key, r, c), out = now, []
            cid, own, n = (np.array([h[k] for h in held]) for k in (0, 1, 2))
            v, all_keys = np.stack([h[3] for h in held]), np.stack([h[4] for h in held])
            v = v / np.abs(v).max(1)[:, None]  # else squares of very large or small components leave a double's range
            v = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
            turn = int(np.flatnonzero(all_keys[0] == key)[0])
            left, right = (np.arange(len(cid)), np.arange(len(cid))) if r == c else (np.flatnonzero(own == r), np.flatnonzero(own == c))
            links, parts = np.zeros(len(cid), np.int64), []
            for at in range(0, len(left), 256):
                part = left[at : at + 256]
                hit = v[part] @ v[right].T >= least
                if r == c:
                    hit &= right[None, :] > part[:, None]
                a, b = np.nonzero(hit)
                a, b = part[a], right[b]
                first = ~(all_keys[a, :turn] == all_keys[b, :turn]).any(1)
                a, b = a[first], b[first]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                if len(a):
                    parts.append(forest(cid[a], cid[b]))
            some = np.flatnonzero(links)
            if len(some):
                a, b = forest(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
                nothing = lambda k: pa.nulls(k, pa.int64())
                out.append(pa.RecordBatch.from_arrays([pa.array(cid[some]), nothing(len(some)), pa.array(links[some])], schema=schema))
                out.append(pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), nothing(len(a))], schema=schema))
            return out

        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(c)) for c in ("key", "r", "c", "cid", "own", "n", "v", "keys")]
            heads = list(zip(*(c.to_pylist() for c in columns[:6]), strict=True))
            for k, (key, r, c, cid, own, n) in enumerate(heads):
                if (key, r, c) != now:
                    if len(held) > 1:
                        yield from bucket()
                    now, held = (key, r, c), []
                held.append((cid, own, n, np.array(columns[6][k].values, float), np.array(columns[7][k].values, np.int64)))
        if len(held) > 1:
            yield from bucket()

    found = written(dealt.mapInArrow(compare, ddl), "found", root)
    counts = found.filter("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    labels = components(found.filter("b is not null").select("a", "b"))
    grouped = classes.select("class", "cid", "id", "n").join(counts, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("g", F.coalesce("component", "cid"))
    least_id = grouped.groupBy("g").agg(F.min("id").alias("component_id"))
    grouped = grouped.join(least_id, "g").select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = named.select("vec_id", "class").join(grouped, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


# -- top-k ----------------------------------------------------------------------------------

SHAPE = struct.Struct("<III")
#: What stands for no candidate: below all scores, and above all ids. Scores beyond a long's range count as its ends.
LOWEST, HIGHEST, NO_ID = -(1 << 63), (1 << 63) - 1, (1 << 63) - 1


def pack(ids: np.ndarray, values: np.ndarray) -> bytes:
    """Ids and values, in as few bytes per value as the largest needs."""
    most = max(int(values.max()), -int(values.min()) - 1) if values.size else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return SHAPE.pack(*values.shape, width) + ids.astype("<i8").tobytes() + values.astype(f"<i{width}").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, d, width = SHAPE.unpack_from(raw)
    ids = np.frombuffer(raw, "<i8", n, SHAPE.size)
    return ids, np.frombuffer(raw, f"<i{width}", n * d, SHAPE.size + 8 * n).reshape(n, d).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: in floats or doubles while no sum can leave their exact range, else in whole numbers of 64 bits, else of any size."""
    if a.dtype == b.dtype == np.float32:  # as ``light`` found
        return a @ b.T
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LOWEST + 1, HIGHEST).astype(np.int64)


def light(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats if none of their products, partial sums too, leaves the whole numbers that these hold; else as they are."""
    longest = lambda v: float(np.sqrt(np.square(v.astype(float)).sum(1).max(initial=0)))
    return (a.astype(np.float32), b.astype(np.float32)) if longest(a) * longest(b) < 2**24 - 1 else (a, b)


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of longs that stay at the ends of their range."""
    out = a.astype(float) + b.astype(float)
    return np.where(out >= 2.0**62, HIGHEST, np.where(out <= -(2.0**62), LOWEST + 1, a + b))


class Pack:
    """Vectors in blocks of like ones, each with the range of every dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, block: int = BLOCK):
        # like vectors together: by the signs of their strongest dimensions in the pack, then by the strongest of all
        spread = np.argsort(-values.astype(float).var(0), kind="stable")[:12] if len(values) else np.zeros(0, int)
        middle = np.median(values[:, spread], 0) if len(values) else 0
        order = np.lexsort((values[:, spread] > middle).T[::-1]) if len(spread) else np.arange(len(ids))
        self.ids, self.values = ids[order], values[order]
        begins = np.arange(0, len(ids), block)
        self.begins, self.ends = begins, np.minimum(begins + block, len(ids))
        self.most = np.maximum.reduceat(self.values, begins, 0) if len(ids) else self.values
        self.least = np.minimum.reduceat(self.values, begins, 0) if len(ids) else self.values

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No vector of a block scores higher: each dimension's best product, summed."""
        return plus(products(np.maximum(queries, 0), self.most), products(np.minimum(queries, 0), self.least))


class Best:
    """The k best of each query so far: score descending, then id ascending."""

    def __init__(self, ids: np.ndarray, k: int):
        self.queries = ids
        self.scores = np.full((len(ids), k), LOWEST)
        self.ids = np.full((len(ids), k), NO_ID)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """ids, scores: candidates by row."""
        all_scores = np.concatenate([self.scores[rows], scores], 1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], 1)
        order = np.lexsort((all_ids, ~all_scores), axis=1)[:, : self.scores.shape[1]]
        self.scores[rows] = np.take_along_axis(all_scores, order, 1)
        self.ids[rows] = np.take_along_axis(all_ids, order, 1)


def search(pack_: Pack, queries: np.ndarray, best: Best) -> int:
    """Offer to each query what the pack may add; returns how many block visits that took.

    A query's first visit is the block with its highest bound. Then blocks come one by one, for the queries whose k-th score their bound
    reaches, and only scores that enter a query's best are offered.
    """
    if not len(pack_.begins) or not len(queries):
        return 0
    bounds = pack_.bounds(queries)
    first = bounds.argmax(1)
    asked, values = light(queries, pack_.values)
    visits = 0

    def visit(b: int, live: np.ndarray) -> None:
        nonlocal visits
        visits += len(live)
        cut = slice(pack_.begins[b], pack_.ends[b])
        ids, scores = pack_.ids[cut], products(asked[live], values[cut])
        worst = best.scores[live, -1]
        # floats hold all scores that they came from; what is below these stands below -(1 << 24)
        least = np.maximum(worst, -(1 << 25)).astype(np.float32) if scores.dtype == np.float32 else worst
        rows, columns = np.nonzero(scores >= least[:, None])
        enters = (scores[rows, columns] > least[rows]) | (worst[rows] == LOWEST) | (ids[columns] < best.ids[live[rows], -1])
        enters &= ids[columns] != best.queries[live[rows]]
        some = np.unique(rows[enters])
        if len(some):
            offered, own = scores[some].astype(np.int64), ids[None, :] == best.queries[live[some]][:, None]
            best.offer(live[some], np.where(own, NO_ID, ids[None, :]), np.where(own, LOWEST, offered))

    for b in np.unique(first):
        live = np.flatnonzero((first == b) & (bounds[:, b] >= best.scores[:, -1]))
        if len(live):
            visit(b, live)
    for b in range(len(pack_.begins)):
        live = np.flatnonzero((first != b) & (bounds[:, b] >= best.scores[:, -1]))
        if len(live):
            visit(b, live)
    return visits


def top_k(table: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, pack_rows: int = PACK, chunk_rows: int = CHUNK, lane_packs: int = LANE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``queries`` holds, the ``k`` other rows with the highest inner
    product of components floor(scale * x), ties to the smaller id; fewer if there are no more.

    Vectors that are null or hold null or non-finite components take no part, neither do rows without vec_id. Shorter vectors count as padded with 0.
    A query's own row is every row with its id. Repeated rows are candidates each, and one query: of rows that share an id but not the
    vector the least vector asks. Scaled components and scores beyond a long's range count as its ends. Other columns are not read.

    Every pack meets every chunk of queries; bounds spare the products of blocks that can't reach a query's k-th score. How many that are is up to the
    data: vectors that point in all directions alike leave every bound above it, and then this is a plain product in blocks. A chunk of
    ``chunk_rows`` queries meets a lane of ``lane_packs`` packs in one task; components travel in as few bytes as they need.
    """
    spark = table.sparkSession
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))
    rows = table.filter("vec_id is not null").filter(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), queries.alias("q"))
    ddl = "lane long, raw binary"

    def packed(size: int, packs: int):
        """Packs as rows; each ``packs`` of a task have a number, from 0, of their own."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, values, held, wide, done = [], [], 0, 0, 0

            def full() -> pa.RecordBatch:
                nonlocal held, wide, done
                raw = pack(np.concatenate(ids), np.concatenate([np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in values]))
                ids.clear()
                values.clear()
                held, wide, done = 0, 0, done + 1
                return pa.RecordBatch.from_arrays([pa.array([(done - 1) // packs]), pa.array([raw])], schema=arrow_schema(ddl))

            for batch in batches:
                names, ends, flat = batch.column(0).to_numpy(), batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
                if not len(names):
                    continue
                cuts = [0, *(np.flatnonzero(np.diff(ends, 2)) + 1).tolist(), len(names)]  # stretches of vectors of one length
                for at, to in zip(cuts, cuts[1:], strict=False):
                    same = flat[ends[at] : ends[to]].reshape(to - at, int(ends[at + 1] - ends[at]))
                    while at < to:
                        most = min(size, max(1, CELLS // max(1, wide, same.shape[1])))
                        if held >= most:
                            yield full()
                            continue
                        take = min(to - at, most - held)
                        ids.append(names[at : at + take])
                        values.append(same[len(same) - (to - at) :][:take])
                        at, held, wide = at + take, held + take, max(wide, same.shape[1])
            if held:
                yield full()

        return run

    root = shared_dir(spark)
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    spread = F.xxhash64("vec_id")
    # a task makes the packs of about a lane, fewer where cores would idle
    tasks = lambda m, size: max(1, -(-m // (size * lane_packs)), min(-(-m // size), spark.sparkContext.defaultParallelism))
    docs = rows.select("vec_id", "v").repartition(tasks(n, pack_rows), spread).mapInArrow(packed(pack_rows, lane_packs), ddl)
    chunks = rows.filter("q").groupBy("vec_id").agg(F.min("v").alias("v")).repartition(max(1, -(-asked // (chunk_rows * lane_packs))), spread).mapInArrow(packed(chunk_rows, 1), ddl)
    number = (F.spark_partition_id().cast("long") * (1 << 32) + F.col("lane"))
    docs = written(docs.select(number.alias("lane"), "raw"), "packs", root)
    chunks = written(chunks.select(number.alias("chunk"), "raw"), "chunks", root)
    # every chunk goes to every lane once, every pack to every chunk; numbers alone are broadcast
    lanes, numbers = docs.select("lane").distinct(), chunks.select("chunk").distinct()
    meetings = lanes.count() * numbers.count()
    sent = chunks.crossJoin(F.broadcast(lanes)).select("chunk", "lane", F.lit(True).alias("asks"), "raw")
    came = docs.crossJoin(F.broadcast(numbers)).select("chunk", "lane", F.lit(False).alias("asks"), "raw")
    # more tasks than meetings, so that few share one
    pairs = sent.unionByName(came).repartition(max(1, 4 * meetings), "chunk", "lane").sortWithinPartitions("chunk", "lane", F.desc("asks"))
    found_ddl = "query_id long, vec_id long, score long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(found_ddl)
        best, values = None, None

        def done() -> pa.RecordBatch:
            some = best.ids != NO_ID
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(best.queries, some.sum(1))), pa.array(best.ids[some]), pa.array(best.scores[some])], schema=schema)

        for batch in batches:
            for asks, raw in zip(batch.column(2), batch.column(3), strict=True):
                ids, own = unpack(raw.as_buffer())
                if asks.as_py():  # the chunk comes first, then the packs of its lane
                    if best is not None:
                        yield done()
                    values, best = own, Best(ids, k)
                    continue
                wide = max(values.shape[1], own.shape[1])
                pad = lambda a: np.pad(a, ((0, 0), (0, wide - a.shape[1])))  # noqa: E731, B023
                search(Pack(ids, pad(own)), pad(values), best)
        if best is not None:
            yield done()

    found = pairs.mapInArrow(run, found_ddl)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
