"""Exact Jaccard self-join of documents' word n-gram sets, and the groups that its links form.

Candidates come by the pigeonhole principle. For the sizes of a band, two sets that reach the
threshold differ in at most H elements. Hashing cuts the universe of elements into segments;
a segment of weight 1 is given as its exact content, one of weight 2 as its content and
as all contents with one element left out. If the weights sum to more than H, two
such sets agree on a segment, or on one with an element left out of one of them. Documents
meet in the band of the larger one. How many segments get weight 2 is decided per band by a
cost estimate: left-out neighbourhoods write more rows, exact segments let more strangers meet.

An empty segment says nothing, so it isn't given; a few segments more than needed make up for it,
and a set with too many empty ones gives those, too, to meet its like.

Sets stand for all documents that have them, by a hash of the set that is checked against a second
one. Within a bucket each set meets one pivot first; sets that verified links leave in
different groups then meet each other, so no link is lost and groups of copies stay linear.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SLICE, arrow_schema, kept, release, remove, shared_dir, texts_of, written
from gridloom.llm.components import components, extended, labelled
from gridloom.llm.wordhash import mix, word_hashes

#: Cost of a row that is shuffled, of a pair that is verified, and elements that unrelated documents share on average.
ROW, PAIR, SHARED = 1.0, 20.0, 0.05
#: Bytes of text per word, to estimate how many sets a band has.
WORD_BYTES = 6
#: Sets that a task remembers to have given (100 bytes each).
REMEMBERED = 300_000
#: Bits of the filter by which only sets with candidates are fetched; beyond its capacity it lets more through.
FILTER_BITS = 1 << 23
#: Signatures that a task gathers before it writes blocks, and bytes of text whose signatures make a part.
GATHERED, PART_BYTES = 600_000, 16 << 20
#: Sets of one side of a tile.
TILE = 1024
#: Classes of elements in the sketch of a set of up to FEW elements, and twice as many for each doubling of these.
SKETCH, FEW = 1024, 1500
#: Pairs up to this number (16 bytes each) are broadcast to their sets.
SMALL = 1 << 18

#: Fixed value: an odd multiplier of a public 64-bit mixing function.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of the runs of ``n`` words; fewer words are one run. A-Z count as a-z; ASCII white space separates."""
    hashes, counts = word_hashes(texts)
    end = 0
    for count in counts.tolist():
        begin, end = end, end + count
        size = min(n, count)
        if not size:
            yield np.zeros(0, np.uint64)
            continue
        run = np.full(count - size + 1, size, np.uint64)
        for k in range(size):
            run = run * MULTIPLIER + hashes[begin + k : end - size + 1 + k]
        run = np.sort(mix(run))
        yield run[np.r_[True, run[1:] != run[:-1]]]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return next(shingle_sets([text], n))


@dataclass(frozen=True)
class Threshold:
    """Two sets link when ``whole * intersection >= part * union``."""

    part: int
    whole: int

    def holds(self, both: int, a: int, b: int) -> bool:
        return self.whole * both >= self.part * (a + b - both)

    def differ(self, total: int) -> int:
        """Most elements in which sets of ``total`` elements together may differ."""
        return total * (self.whole - self.part) // (self.whole + self.part)


@dataclass(frozen=True)
class Band:
    """The larger set has ``low`` to ``high`` elements; ``double`` segments of weight 2 come first, then ``single`` ones."""

    low: int
    high: int
    smallest: int
    single: int
    double: int


@lru_cache(maxsize=4)
def limits(t: Threshold, largest: int) -> tuple[tuple[int, int], ...]:
    """Bands of sizes: each as wide as the threshold squared allows."""
    out, low = [], 1
    while low <= largest:
        high = max(low, low * t.whole * t.whole // (t.part * t.part))
        out.append((low, high))
        low = high + 1
    return tuple(out)


def allocate(low: int, high: int, sets: int, t: Threshold) -> Band:
    """Segments for one band: the split between weights 1 and 2 that costs least."""
    h = t.differ(2 * high)
    smallest = -(-low * t.part // t.whole)
    if h == 0:  # only equal sets link
        return Band(low, high, smallest, 0, 0)
    need = h + 2 + h // 64
    typical = (low + high) / 2

    def cost(double: int) -> float:
        single = need - 2 * double
        rate = typical / need  # elements of a segment of weight 1; one of weight 2 gets twice as many
        rows = single + double * (1 + 2 * rate)
        meet = single / need * math.exp(-2 * rate) + 2 * double / need * math.exp(-4 * rate) * (1 + 4 * rate)
        return sets * rows * ROW + sets * (sets - 1) / 2 * SHARED * meet * PAIR

    most = need // 2
    double = min(sorted({0, most // 4, most // 2, 3 * most // 4, most}), key=cost)
    return Band(low, high, smallest, need - 2 * double, double)


class Signatures:
    """Signatures of sets. The last two bits: 1 for the smaller side of a band, 2 for a content with an element left out."""

    def __init__(self, bands: list[Band], t: Threshold):
        self.bands, self.t = bands, t
        self.low = np.array([b.low for b in bands])

    def roles(self, size: int) -> list[tuple[int, int]]:
        """(band, 0 for the larger side or 1 for the smaller)."""
        own = int(np.searchsorted(self.low, size, "right")) - 1
        out = [(own, 0)]
        for b in range(own + 1, len(self.bands)):
            if self.bands[b].smallest > size:
                break
            out.append((b, 1))
        return [(b, r) for b, r in out if self.bands[b].single + self.bands[b].double]

    def of(self, tokens: np.ndarray, b: int, role: int) -> np.ndarray:
        band = self.bands[b]
        double, segments = band.double, band.double + band.single
        seed = np.uint64((b + 1) * int(MULTIPLIER) & (1 << 64) - 1)
        h = mix(tokens ^ seed)
        place = (h % np.uint64(2 * double + band.single)).astype(np.int64)
        segment = np.where(place < 2 * double, place >> 1, place - double)
        order = np.argsort(segment, kind="stable")
        segment, h = segment[order], mix(h[order] + MULTIPLIER)
        begins = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        filled = segment[begins]
        sums = np.add.reduceat(h, begins)
        counts = np.diff(np.r_[begins, len(h)])
        salt = mix((np.arange(segments, dtype=np.uint64) + np.uint64(1)) * MULTIPLIER ^ seed)
        out = [self._flag(mix(sums ^ salt[filled]), role)]
        many = np.zeros(segments, np.int64)
        many[filled] = counts
        partner = min(band.high, len(tokens) * self.t.whole // self.t.part)
        void = int((many[double:] == 0).sum()) + 2 * int((many[:double] <= 1).sum())
        if short := band.single + 2 * double - void <= self.t.differ(len(tokens) + partner):
            out.append(self._flag(mix(salt[many == 0]), role))
        if double:
            cut = segment < double
            at = np.repeat(np.arange(len(begins)), counts)[cut]
            left = sums[at] - h[cut]
            kept = (counts[at] > 1) | short
            out.append(self._flag(mix(left[kept] ^ salt[segment[cut][kept]]), role | 2))
        return np.concatenate(out)

    @staticmethod
    def _flag(h: np.ndarray, flag: int) -> np.ndarray:
        return h & ~np.uint64(3) | np.uint64(flag)


def identity(tokens: np.ndarray, seed: int) -> tuple[int, int]:
    """Two hashes of a set, as signed 64-bit numbers."""
    both = xxhash.xxh3_128_intdigest(tokens.tobytes(), seed)
    a, b = both & (1 << 64) - 1, both >> 64
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def pack_block(sigs: np.ndarray, sids: np.ndarray) -> bytes:
    """Ascending signatures as differences, and their sets by number: both with bytes of one weight together."""
    table, number = np.unique(sids, return_inverse=True)
    gaps = np.diff(sigs, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    numbers = number.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(sigs).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(gaps + numbers + table.astype("<i8").tobytes())


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, raw = int.from_bytes(block[:8], "little"), np.frombuffer(zstandard.ZstdDecompressor().decompress(block[8:]), np.uint8)
    gaps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    number = np.ascontiguousarray(raw[8 * n : 12 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint64), raw[12 * n :].view("<i8")[number]


def _signatures(docs: DataFrame, n: int, t: Threshold, bands: list[Band], parts: int, seed: int) -> DataFrame:
    """``part, block``: signatures by range, each set once per task."""
    maker = Signatures(bands, t)
    ddl = "part int, block binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("sets", dict)  # what other operators kept in this worker goes
        given: set[int] = set()
        sigs, sids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            sig, sid = np.concatenate(sigs), np.concatenate(sids)
            sigs.clear()
            sids.clear()
            order = np.argsort(sig, kind="stable")
            sig, sid = sig[order], sid[order]
            part = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True]) + 1
            spans = [*zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[ends - 1], pa.int32()), pa.array([pack_block(sig[a:b], sid[a:b]) for a, b in spans])], schema=schema)

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                for tokens in shingle_sets(batch.column(0).slice(k, SLICE).to_pylist(), n):
                    if not len(tokens):
                        continue
                    sid, _ = identity(tokens, seed)
                    if sid in given:
                        continue
                    if len(given) < REMEMBERED:
                        given.add(sid)
                    for b, role in maker.roles(len(tokens)):
                        sigs.append(maker.of(tokens, b, role))
                        sids.append(np.full(len(sigs[-1]), sid, np.int64))
                        held += len(sigs[-1])
                if held > GATHERED:
                    yield flush()
                    held = 0
        if sigs:
            yield flush()

    return docs.select("text").mapInArrow(run, ddl)


def _met(blocks: DataFrame, parts: int) -> DataFrame:
    """``bucket, a, b, flag``: in each bucket the pivot ``a`` and each other set ``b`` that may link to it.

    An exact content of a larger side is the pivot; without one, an exact content of a smaller side, for left-out contents of larger ones
    and, where there are such, for the other smaller sides, which meet them as members of one pivot.
    """
    ddl = "bucket long, a long, b long, flag int"
    schema = arrow_schema(ddl)

    def buckets(pieces: list[bytes]) -> pa.RecordBatch:
        sig, sid = (np.concatenate(x) for x in zip(*map(unpack_block, pieces), strict=True))
        order = np.lexsort((sid, sig))
        sig, sid = sig[order], sid[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])]
        sig, sid = sig[new], sid[new]
        bucket, flag = sig >> np.uint64(2), (sig & np.uint64(3)).astype(np.int32)
        begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        first = np.repeat(begins, np.diff(np.r_[begins, len(sig)]))
        pivot, kind = sid[first], flag[first]
        cut = np.repeat(np.logical_or.reduceat(flag == 2, begins), np.diff(np.r_[begins, len(sig)]))
        keep = np.flatnonzero((pivot != sid) & ((kind == 0) | ((kind == 1) & cut & (flag <= 2))))
        return pa.RecordBatch.from_arrays([pa.array(bucket[keep].view(np.int64)), pa.array(pivot[keep]), pa.array(sid[keep]), pa.array(flag[keep])], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped_rows(_rows(batches, ("part", "block"), 16), 1):
            yield buckets([block for _, block in rows])

    return blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, ddl)


def width(size: np.ndarray) -> np.ndarray:
    """Classes in the sketch of a set: about one for each element, else sketches of unlike large sets would look alike."""
    return SKETCH << np.searchsorted(FEW << np.arange(40), size)


def sketch(tokens: np.ndarray) -> bytes:
    """The set's size, and for each of some classes of elements whether their number is odd.

    Two sets differ in at least as many elements as their sketches in bits, and so they do when the wider one is folded.
    """
    classes = int(width(np.array(len(tokens))))
    odd = np.bincount((tokens & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return len(tokens).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (a row of words each) with as many classes as ``words`` have: the class of a hash is its last bits."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _may_link(t: Threshold, a: bytes, b: bytes) -> bool:
    m, n = int.from_bytes(a[:8], "little"), int.from_bytes(b[:8], "little")
    if t.whole * min(m, n) < t.part * max(m, n):
        return False
    x, y = np.frombuffer(a, "<u8", -1, 8), np.frombuffer(b, "<u8", -1, 8)
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= t.differ(m + n)


def _do_link(t: Threshold, a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    return t.holds(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))


def _filter_bits(ids: DataFrame) -> np.ndarray:
    """A bit for each id's last digits: FILTER_BITS at most, whatever the number of ids."""
    low = F.col("sid").bitwiseAND(FILTER_BITS - 1)
    words = ids.select(F.shiftright(low, 6).alias("w"), F.expr("shiftleft(1L, cast(sid & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in words:
        out[r.w] = r.b & (1 << 64) - 1
    return out


def _sets(docs: DataFrame, n: int, bits: np.ndarray, seed: int) -> DataFrame:
    """A row per document: ``doc_id, n, sid, second``, and ``tokens`` and their ``sketch`` where the filter lets the set through, once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, sid long, second long, tokens binary, sketch binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("sets", dict)
        bits, given = shared.value, set()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                sizes, sids, seconds, all_tokens, sketches = [], [], [], [], []
                for tokens in shingle_sets(part.column(1).to_pylist(), n):
                    sid, second = identity(tokens, seed)
                    low = sid & FILTER_BITS - 1
                    own = len(tokens) and sid not in given and int(bits[low >> 6]) >> (low & 63) & 1
                    if own and len(given) < REMEMBERED:
                        given.add(sid)
                    sizes.append(len(tokens))
                    sids.append(sid)
                    seconds.append(second)
                    all_tokens.append(tokens.tobytes() if own else None)
                    sketches.append(sketch(tokens) if own else None)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, f.type) for v, f in zip((sizes, sids, seconds, all_tokens, sketches), [*schema][1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def _passing(pairs: DataFrame, sets: DataFrame, column: str, test: Callable[[bytes, bytes], bool], few: bool) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose contents pass. Each cell is a pivot ``a`` with its partners; one pivot's content is held at a time."""
    wanted = pairs.select(F.col("a").alias("cell"), F.explode(F.array("a", "b")).alias("sid")).distinct()
    content = sets.filter(F.col(column).isNotNull()).select("sid", F.col(column).alias("content"))
    if few:
        met = content.join(F.broadcast(wanted), "sid")  # counted: at most 2 * SMALL rows
    else:
        met = content.groupBy("sid").agg(F.first("content").alias("content")).join(wanted, "sid")
    # large cells are dealt over several tasks, and the pivot to each of them
    spread = pairs.groupBy(F.col("a").alias("cell")).agg(F.ceil(F.count("*") / 512).alias("parts"))
    met = met.join(F.broadcast(spread) if few else spread, "cell")
    part = F.when(F.col("cell") == F.col("sid"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("sid"), F.col("parts"))))
    met = met.withColumn("part", F.explode(part)).drop("parts")
    dealt = met.repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("sid") != F.col("cell"), "sid")
    schema = arrow_schema("a long, b long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, pivot = None, b""
        for batch in batches:
            a, b = [], []
            cells, sids, contents = (batch.column(batch.schema.names.index(c)) for c in ("cell", "sid", "content"))
            for c, s, own in zip(cells.to_pylist(), sids.to_pylist(), contents, strict=True):
                if c == s:
                    cell, pivot = c, own.as_py()
                elif cell == c and test(pivot, own.as_py()):
                    a.append(c)
                    b.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, t: Threshold, root: str, name: str, sift: bool) -> DataFrame:
    """The ``a, b`` of ``pairs`` that link, written; with ``sift`` sketches first tell most of those that can't."""
    if sift:
        pairs = written(_passing(pairs, sets, "sketch", lambda a, b: _may_link(t, a, b), pairs.count() <= SMALL), f"{name}-sifted", root)
    return written(_passing(pairs, sets, "tokens", lambda a, b: _do_link(t, a, b), pairs.count() <= SMALL), f"{name}-links", root)


def pack_members(rows: list[tuple[int, int, bytes]]) -> bytes:
    """Set, group and sketch of the members of one block of a cell."""
    return len(rows).to_bytes(8, "little") + np.array([r[:2] for r in rows], "<i8").T.tobytes() + b"".join(r[2] for r in rows)


def unpack_members(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Sets, groups, sizes, and for each width of sketches the members and their sketches (a row of words each)."""
    n = int.from_bytes(raw[:8], "little")
    sid, group = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(2, n)
    words, size, at, places = np.frombuffer(raw, "<u8", -1, 8 + 16 * n), np.zeros(n, np.int64), 0, np.zeros(n, np.int64)
    for k in range(n):
        size[k], places[k] = int(words[at]), at + 1
        at += 1 + int(width(size[k])) // 64
    wide = width(size) // 64
    return sid, group, size, [(own := np.flatnonzero(wide == w), words[places[own][:, None] + np.arange(w)]) for w in np.unique(wide)]


def tile_pairs(r: bytes, c: bytes | None, t: Threshold, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sets of two blocks (or of one) that are of different groups and may link by their sketches; with ``nearest`` for each the nearest only."""
    sid, group, size, sketches = unpack_members(r)
    others, their_group, their_size, their_sketches = unpack_members(c) if c is not None else (sid, group, size, sketches)
    far = 1 << 40
    found, best, their_best = [np.zeros((2, 0), np.int64)], np.full((2, len(sid)), far), np.full((2, len(others)), far)
    for (rows, left), (columns, right) in product(sketches, their_sketches):
        words = min(left.shape[1], right.shape[1])
        left, right = folded(left, words), folded(right, words)
        step = max(1, (1 << 19) // right.size)
        for at in range(0, len(rows), step):
            x = rows[at : at + step]
            apart = np.bitwise_count(left[at : at + step][:, None, :] ^ right[None, :, :]).sum(2, dtype=np.int64)
            m, n = size[x][:, None], their_size[columns][None, :]
            may = (group[x][:, None] != their_group[columns][None, :]) & (apart <= (m + n) * (t.whole - t.part) // (t.whole + t.part)) & (t.whole * np.minimum(m, n) >= t.part * np.maximum(m, n))
            if not nearest:
                i, j = np.nonzero(may)
                found.append(np.stack([sid[x[i]], others[columns[j]]]))
                continue
            apart = np.where(may, apart, far)
            for ids, theirs, d, kept in ((x, columns, apart, best), (columns, x, apart.T, their_best)):
                place = d.argmin(1)
                now = d[np.arange(len(place)), place]
                closer = now < kept[0, ids]
                kept[:, ids[closer]] = now[closer], theirs[place[closer]]
    if nearest:
        i, j = np.flatnonzero(best[0] < far), np.flatnonzero(their_best[0] < far)
        found = [np.stack([sid[i], others[best[1, i]]]), np.stack([sid[their_best[1, j]], others[j]])]
    a, b = np.concatenate(found, 1)
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)


def _grouped_rows(rows: Iterable[tuple], key: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first ``key`` fields."""
    held: list[tuple] = []
    for row in rows:
        if held and row[:key] != held[0][:key]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _rows(batches: Iterable[pa.RecordBatch], names: tuple[str, ...], size: int = SLICE) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            part = batch.slice(k, size)
            yield from zip(*(part.column(part.schema.names.index(c)).to_pylist() for c in names), strict=True)


def _unresolved(met: DataFrame, labels: DataFrame, sets: DataFrame, t: Threshold, nearest: bool) -> DataFrame:
    """Pairs of sets of different groups that met one pivot and may link by their sketches: all, or for each set the nearest one.

    Of two such sets one at least isn't in the pivot's group. So the sets of one pivot that are apart from it are compared with
    each other and with those in its group, in tiles of block against block. A block travels as one row for each tile; what leaves a
    tile is only what sketches can't tell apart.
    """
    named = labelled(met, labels).withColumn("apart", F.col("ga") != F.col("gb"))
    sizes = named.groupBy("a").agg(F.count_if("apart").alias("n"), F.count_if(~F.col("apart")).alias("m")).filter("n > 0 AND n + m > 1")
    sizes = sizes.select("a", F.ceil(F.col("n") / TILE).cast("int").alias("n"), F.ceil(F.col("m") / TILE).cast("int").alias("m"))
    members = named.join(sizes, "a").withColumn("own", F.when(F.col("apart"), F.pmod(F.xxhash64("b"), "n")).otherwise(F.col("n") + F.pmod(F.xxhash64("b"), F.greatest("m", F.lit(1)))).cast("int"))
    sketches = sets.filter("sketch is not null").groupBy("sid").agg(F.first("sketch").alias("sketch"))
    held = members.select("a", "own", "n", "m", F.col("b").alias("sid"), F.col("gb").alias("g")).join(sketches, "sid")
    block_ddl = "a long, own int, n int, m int, raw binary"

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(block_ddl)
        for run in _grouped_rows(_rows(batches, ("a", "own", "n", "m", "sid", "g", "sketch")), 2):
            row = (*run[0][:4], pack_members([r[4:] for r in run]))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    packed = held.repartition("a", "own").sortWithinPartitions("a", "own", "sid").mapInArrow(blocks, block_ddl)
    last = F.when(F.col("own") < F.col("n"), F.col("n") + F.col("m")).otherwise(F.col("n")) - 1
    tiled = packed.withColumn("o", F.explode(F.sequence(F.lit(0), last))).select("a", F.least("own", "o").alias("r"), F.greatest("own", "o").alias("c"), "own", "raw")
    dealt = tiled.repartition("a", "r", "c").sortWithinPartitions("a", "r", "c", "own")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _grouped_rows(_rows(batches, ("a", "r", "c", "own", "raw"), 16), 3):
            (_, r, c, *_), raws = run[0], [x[4] for x in run]
            if r == c or len(raws) > 1:  # a block that hashing left empty has no row
                a, b = tile_pairs(raws[0], None if r == c else raws[1], t, nearest)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def join(docs: DataFrame, n: int = 5, part: int = 80, whole: int = 100, seed: int = 0) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the size of the document's set of ``n``-word runs, and the least id
    reachable by links, where two documents link when ``whole * |A & B| >= part * |A | B|``.

    Null, empty and blank texts have no set and link with nothing; fewer than ``n`` words are one run. Equal texts link. Repeated
    rows give a row each. Other columns are not read. All links between different sets are found, and
    groups follow from them exactly.
    """
    t = Threshold(part, whole)
    spark = docs.sparkSession
    docs = texts_of(docs)
    root = shared_dir(spark)
    size = F.octet_length("text")
    bins = F.floor(F.log(F.greatest(F.ceil(size / WORD_BYTES), F.lit(1))) / math.log(1.1))  # a histogram of 250 bins at most
    histogram = docs.filter("text is not null").groupBy(bins.alias("k")).agg(F.count("*").alias("n"), F.max(size).alias("longest"), F.sum(size).alias("bytes")).collect()
    sizes = limits(t, 1 + max((r.longest for r in histogram), default=0))  # a set has no more elements than its text has bytes
    edges = np.array([low for low, _ in sizes])
    sets_in = [0] * len(sizes)
    for r in histogram:
        sets_in[int(np.searchsorted(edges, int(round(1.1**r.k)), "right")) - 1] += r.n
    bands = [allocate(low, high, max(1, count), t) for (low, high), count in zip(sizes, sets_in, strict=True)]

    parts = max(1, -(-sum(r.bytes for r in histogram) // PART_BYTES))
    met = written(_met(_signatures(docs, n, t, bands, parts, seed), parts), "met", root)

    # every set meets the pivot with which it shares most buckets
    counted = met.groupBy("a", "b").agg(F.count("*").alias("n"))
    best = counted.groupBy("b").agg(F.max(F.struct("n", F.col("a").alias("x"))).alias("best")).select(F.col("best.x").alias("a"), "b")
    first = written(best, "first", root)
    ids = met.select(F.explode(F.array("a", "b")).alias("sid"))
    sets = written(_sets(docs, n, _filter_bits(ids), seed), "sets", root)
    clash = sets.filter("n > 0").groupBy("sid").agg((F.min("second") != F.max("second")).alias("clash")).filter("clash").limit(1).count()
    if clash:
        remove(spark, root)
        return join(docs, n, part, whole, seed + 1)
    labels = components(_verified(first, sets, t, root, "first", False))

    # pairs of pivot and member whose groups are still apart
    release(spark)
    tested = first
    apart = written(labelled(counted.select("a", "b"), labels).filter("ga != gb").select("a", "b").join(tested, ["a", "b"], "left_anti"), "apart", root)
    if apart.limit(1).count():
        labels = extended(labels, _verified(apart, sets, t, root, "apart", True))

    # sets that met one pivot and that it doesn't hold together: first each with its nearest of another group, then what is left
    for nearest in (True, False):
        release(spark)
        name = "nearest" if nearest else "rest"
        rest = written(_unresolved(counted.select("a", "b"), labels, sets, t, nearest), name, root)
        if not rest.limit(1).count():  # a set that may link to any has a nearest one, so there is nothing left, either
            break
        labels = extended(labels, _verified(rest, sets, t, root, name, False))

    members = sets.select("doc_id", "n", "sid").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("g", F.coalesce("component", "sid")).select("doc_id", "n", "g")
    least = members.filter("n > 0").groupBy("g").agg(F.min("doc_id").alias("component_id"))
    return members.join(least, "g", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
