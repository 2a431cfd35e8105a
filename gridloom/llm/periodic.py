"""Periodic runs of words: stretches that repeat with a period at least twice, found by naming stretches of power-of-two lengths.

Karp, Miller and Rosenberg's naming gives stretches of 1, 2, 4, ... words equal numbers exactly when they are equal: words are numbered by
a dictionary, and pairs of names are numbered by rank. A longest common extension descends these levels, for many
pairs of places at once. A run of period q keeps words equal to those q further over a stretch, so it meets a grid whose step fits that
stretch; grid places whose names of four words agree are extended both ways. There are n log n grid places of a text, and no pairs of all.

No shuffle: a text is one row's work. A text without a repeated stretch of four words, as most, is dismissed with its neighbours at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_schema, texts_of
from gridloom.llm.wordhash import pieces

#: Words of the shortest run, of the stretches whose names are compared on the grid (2 to this power), grid places held at once, and bytes of texts that are named together.
LEAST, SEED, PLACES, TOGETHER = 12, 2, 1 << 20, 1 << 20
#: Words that are joined at once.
JOINED = 1 << 16

RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def names(words: np.ndarray) -> list[np.ndarray]:
    """``[k][i]`` numbers the ``2**k`` words from i; levels end where all are different or longer than the text."""
    levels = [words]
    while 2 << (len(levels) - 1) <= len(words):
        before, half = levels[-1], 1 << (len(levels) - 1)
        pairs = before[:-half].astype(np.int64) * (int(before.max()) + 1) + before[half:]
        known, name = np.unique(pairs, return_inverse=True)
        levels.append(name.astype(np.int32))
        if len(known) == len(name):
            break
    return levels


def extension(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from places i and j on (or before them, with ``back``) are equal; i < j."""
    n, found = len(levels[0]), np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        name, size = levels[k], 1 << k
        if back:
            a, b = i - found - size, j - found - size
            inside = a >= 0
        else:
            a, b = i + found, j + found
            inside = b + size <= n
        same = inside & (name[np.where(inside, a, 0)] == name[np.where(inside, b, 0)])
        found += same * size
    return found


def grid(n: int, least: int, places: int = PLACES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods to try: of period q every step-th place, so that each run of it is met by a whole seed."""
    seed = 1 << SEED
    periods = np.arange(1, n // 2 + 1)
    steps = np.maximum(least - periods, periods) - seed + 1
    counts = np.maximum(0, -(-(n - periods - seed + 1) // steps))
    ends = np.cumsum(counts)
    at = 0
    while at < len(periods):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + places, "right")))
        own = counts[at:last]
        nth = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        yield nth * np.repeat(steps[at:last], own), np.repeat(periods[at:last], own)
        at = last


def runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows ``start, length, period`` of all runs of numbered words, by start, then period; ``least`` is 9 at least."""
    none, n = np.zeros((0, 3), np.int64), len(words)
    if n < least:
        return none
    levels = names(words)
    if len(levels) <= SEED:
        return none
    seeds, found = levels[SEED], none
    for i, q in grid(n, least):
        alike = seeds[i] == seeds[i + q]
        i, q = i[alike], q[alike]
        before = extension(levels, i, i + q, back=True)
        length = before + extension(levels, i, i + q) + q
        long = length >= np.maximum(least, 2 * q)
        if long.any():
            found = np.unique(np.concatenate([found, np.stack([(i - before)[long], length[long], q[long]], 1)]), axis=0)
    # a stretch that is met with multiples of its period counts with the smallest, which sorts first
    first = np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)] if len(found) else np.zeros(0, bool)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which words no run contains after its own first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where and with which period a tenth of the texts repeats itself to its end, by a checksum of the id; None elsewhere, and without id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _repeating(numbered: list[np.ndarray]) -> np.ndarray:
    """Which of several texts, numbered by one dictionary, hold some four words twice."""
    sizes = np.array([len(x) for x in numbered])
    text, words = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(numbered)
    out = np.zeros(len(sizes), bool)
    if len(words) < 4:
        return out
    _, pairs = np.unique(words[:-1] * (int(words.max()) + 1) + words[1:], return_inverse=True)
    inside = text[:-3] == text[3:]
    fours = pairs[:-2][inside] * len(pairs) + pairs[2:][inside]
    keyed = np.sort(text[:-3][inside] * len(pairs) ** 2 + fours)
    out[keyed[1:][keyed[1:] == keyed[:-1]] // len(pairs) ** 2] = True
    return out


def _digest(words: list[bytes], numbers: np.ndarray) -> str:
    """SHA-256 of the words joined by one space."""
    digest, space = hashlib.sha256(), b""
    for at in range(0, len(numbers), JOINED):
        digest.update(space + b" ".join(map(words.__getitem__, numbers[at : at + JOINED].tolist())))
        space = b" "
    return digest.hexdigest()


def collapse(ids: list[int | None], texts: list[bytes | None], plant: Callable[[int | None, int], tuple[int, int] | None] | None, least: int) -> list[tuple]:
    """The rows RESULT of a few texts."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    numbered = []
    for raw in texts:
        parts = [np.fromiter(map(known.__getitem__, own), np.int64, len(own)) for a, b in pieces(raw or b"") if (own := raw[a:b].split())]
        numbered.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    words, repeating, out = list(known), _repeating(numbered), []
    for k, (doc_id, x) in enumerate(zip(ids, numbered, strict=True)):
        where = plant(doc_id, len(x)) if plant else None
        if where:
            a, p = where
            place = np.arange(len(x))
            place[a:] = a + (place[a:] - a) % p
            x = x[place]
        found = runs(np.unique(x, return_inverse=True)[1], least) if where or repeating[k] else np.zeros((0, 3), np.int64)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
        best = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2])) if len(found) else None
        said = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        left = x[kept_words(len(x), found)] if len(found) else x
        out.append((doc_id, len(found), *said, hashlib.sha256(listed.encode()).hexdigest(), _digest(words, left)))
    return out


def collapsed(docs: DataFrame, plant: Callable[[int | None, int], tuple[int, int] | None] | None = None, least: int = LEAST) -> DataFrame:
    """One row per document: the number of its runs, the longest, a digest of all and of the text without repetitions.

    Words are what ASCII white space separates. A run is a maximal stretch with smallest period q and ``max(least, 2 * q)`` words or more; of a run only
    the first period stays. Ties of the longest go to the smallest start, then period; without run its four columns are null.
    Null and empty texts have no words. Rows are independent: repeated and null ids are rows like others. ``plant`` may
    repeat texts before they are searched, for tests with known runs.
    """
    schema = arrow_schema(RESULT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list, texts: list) -> pa.RecordBatch:
            rows = zip(*collapse(ids, texts, plant, least), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, schema, strict=True)], schema=schema)

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(doc_id)
                texts.append(raw.as_py())
                size += len(texts[-1] or b"") + 64
                if size >= TOGETHER:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield done(ids, texts)

    own = texts_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.mapInArrow(run, RESULT)
