"""An n-gram language model in a trie of Elias-Fano levels, learned from and applied to whole documents.

Level 1 holds the words by hash, and counts as differences of a monotone sequence. A node of level k is a word
after a node of level k - 1. Levels are cut into shards; within one, a child is stored relative to where its
context's children begin, so that all children are one ascending sequence, and is found by a search for
the successor from there. Beside it stand its quantised smoothed probability and, if it has children, the
quantised weight that it leaves to shorter contexts. Monotone pointers say where a context's children begin.

Smoothing interpolates: p(w | h) = c(hw) / (c(h) + m) + m / (c(h) + m) * p(w | shorter h) with
m = fixed + relative * c(h); words alone have the add-half estimate. So the probabilities of all words
after a context sum to one (but for the rounding of codes, 1 part in 4000).

Counts travel as compressed blocks of sorted keys, one per task and shard; a shard is built by one task and
holds a bounded number of n-grams: contexts with many followers are cut by follower. Shards
are files of the shared folder, which workers map into memory and load page by page as lookups need them. In a store that isn't mounted
shards are read whole, into memory and never to a worker's disk.
"""

from __future__ import annotations

import json
import math
import mmap
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_schema, kept, shared_dir, texts_of
from gridloom.llm.eliasfano import EliasFano
from gridloom.llm.wordhash import word_hashes

#: Steps per decade of quantised probabilities.
STEPS = 4096
#: (fixed, relative) weight of shorter contexts, for contexts of one word, of two, and so on.
SMOOTHING = ((5.0, 2.0), (3.0, 1.0), (3.0, 1.0), (3.0, 1.0))
#: N-gram occurrences of a shard, and those that a task gathers before it writes blocks.
SHARD, GATHERED = 3_000_000, 2_000_000
#: Documents, and characters of theirs, that are looked up together: the more, the fewer visits to each shard.
TOGETHER, CHARACTERS = 1024, 6 << 20
#: Shards that a worker keeps open, and bytes of them in its memory where the shared folder can't be mapped.
OPEN, HELD = 4096, 512 << 20
#: The hash of a text's end.
END = np.uint64(0xE11D0F7E87)


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text's with its end, and their numbers."""
    hashes, counts = word_hashes(texts)
    return np.insert(hashes, np.cumsum(counts), END), counts + 1


def groups(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows that are looked up together."""
    for whole in batches:
        for k in range(0, whole.num_rows, TOGETHER):
            part = whole.slice(k, TOGETHER)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False)) // CHARACTERS
            begins = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]]).tolist()
            for a, b in zip(begins, [*begins[1:], part.num_rows], strict=True):
                yield part.slice(a, b - a)


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each shard."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    ends = np.flatnonzero(np.r_[shard[order][1:] != shard[order][:-1], True]) + 1 if len(order) else np.zeros(0, np.int64)
    for begin, end in zip(np.r_[0, ends[:-1]].astype(int).tolist(), ends.tolist(), strict=False):
        yield int(shard[order[begin]]), order[begin:end]


def code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEPS), 0, 65535).astype(np.uint16)


DECODED = 10.0 ** (-np.arange(65536) / STEPS)


def pack_block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, and counts; bytes of one weight lie together, which compresses well."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    raw = gaps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    gaps, counts = (np.ascontiguousarray(half.reshape(8, -1).T).view("<u8").ravel() for half in np.split(raw, 2))
    return np.cumsum(gaps, dtype=np.uint64), counts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(counts, begins) if len(keys) else counts


# -- files of the shared folder -------------------------------------------------------------


def save(uri: str, meta: dict, arrays: dict[str, np.ndarray]) -> None:
    """One file: the length of a JSON head, the head, and arrays at multiples of 8. It appears whole or not at all."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    at, places = 0, {}
    for name, a in arrays.items():
        places[name] = (at, len(a), a.dtype.str)
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"meta": meta, "arrays": places}).encode()
    head += b" " * (-len(head) % 8)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    store.move(part, path)


def load(uri: str) -> tuple[dict, dict[str, np.ndarray], int]:
    """A file's fields, and how many bytes of it are in memory: none of a mounted store's, which is mapped, and all of another one's."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        with open(path, "rb") as file:
            held, taken = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), 0
    else:
        with store.open_input_stream(path) as file:
            held = file.read()
        taken = len(held)
    size = int.from_bytes(held[:8], "little")
    head = json.loads(held[8 : 8 + size])
    return head["meta"], {name: np.frombuffer(held, np.dtype(kind), n, 8 + size + at) for name, (at, n, kind) in head["arrays"].items()}, taken


def fields(name: str, ef: EliasFano) -> tuple[dict, dict[str, np.ndarray]]:
    return {name: [ef.n, ef.bits]}, {f"{name}.{f}": getattr(ef, f) for f in EliasFano.FIELDS}


def restored(name: str, meta: dict, arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano(*meta[name], *(arrays[f"{name}.{f}"] for f in EliasFano.FIELDS))


# -- the model ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    """How a level k > 1 is cut: contexts in ``cold`` equal ranges; each of ``hot`` (ascending) has parts of its own, by follower."""

    contexts: int
    cold: int
    hot: tuple[int, ...] = ()
    parts: tuple[int, ...] = ()
    #: first node of each shard; known once it is built
    first: tuple[int, ...] = ()
    nodes: int = 0

    @property
    def shards(self) -> int:
        return self.cold + sum(self.parts)

    def low(self, shard: int) -> int:
        return -(-shard * self.contexts // self.cold)

    def route(self, context: np.ndarray, child: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard and key within it."""
        shard = context * self.cold // max(1, self.contexts)
        low = -(-shard * self.contexts // self.cold)
        key = (context - low) * words + child
        if self.hot:
            hot = np.array(self.hot)
            at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
            own = hot[at] == context
            parts = np.array(self.parts)
            begin = self.cold + np.cumsum(parts) - parts
            shard = np.where(own, begin[at] + child * parts[at] // words, shard)
            key = np.where(own, child, key)
        return shard, key.astype(np.uint64)


@dataclass
class Model:
    """Where the levels lie, and their sizes. Small whatever the corpus: a number per shard, and at most two per hot context."""

    root: str
    tokens: int = 0
    words: int = 0
    shard_bits: int = 0
    first_word: tuple[int, ...] = ()
    levels: list[Level] = field(default_factory=list)
    #: occurrences of the hot contexts of the level in hand
    hot_counts: tuple[int, ...] = ()

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.words + 1))


def shares(order: int) -> tuple[float, float]:
    """fixed, relative for contexts of ``order`` words."""
    return SMOOTHING[min(order, len(SMOOTHING)) - 1]


class Reader:
    """The mapped levels of a model, in one worker."""

    def __init__(self, model: Model):
        self.model = model
        self._shards: OrderedDict[tuple[int, int], tuple[dict, dict, EliasFano, int]] = OrderedDict()
        self._taken = 0

    def shard(self, level: int, k: int) -> tuple[dict, dict[str, np.ndarray], EliasFano]:
        """A shard's fields and keys; those used least lately go when there are more than OPEN, or more than HELD bytes in memory."""
        if (level, k) in self._shards:
            self._shards.move_to_end((level, k))
        else:
            meta, arrays, taken = load(f"{self.model.root}/level-{level}/{k}")
            self._taken += taken
            while self._shards and (len(self._shards) >= OPEN or self._taken > HELD):
                self._taken -= self._shards.popitem(last=False)[1][3]
            self._shards[level, k] = meta, arrays, restored("keys", meta, arrays), taken
        return self._shards[level, k][:3]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1 if unknown) and count of distinct words, by hash."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        if not self.model.words:
            return ids, counts
        shard = (h >> np.uint64(64 - self.model.shard_bits)).astype(np.int64) if self.model.shard_bits else np.zeros(len(h), np.int64)
        for k, rows in by_shard(shard):
            if self.model.first_word[k] == self.model.first_word[k + 1]:
                continue
            meta, arrays, keys = self.shard(1, k)
            at, same = keys.successor(h[rows] & np.uint64((1 << 64 - self.model.shard_bits) - 1))
            rows, at = rows[same], at[same]
            sums = restored("sums", meta, arrays)
            ids[rows] = self.model.first_word[k] + at
            counts[rows] = (sums.get(at + 1) - sums.get(at)).astype(np.int64)
        return ids, counts

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and counts of all tokens, one after another, and the number of tokens of each text."""
        hashes, sizes = tokens_of(texts)
        distinct, at = np.unique(hashes, return_inverse=True)
        ids, counts = self.look_up(distinct)
        return ids[at], counts[at], sizes

    def find(self, level: int, context: np.ndarray, child: np.ndarray, inner: bool | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs of context and word: the node's number (-1 if there is none), its share of probability, and what it leaves; with ``inner`` None only the numbers."""
        node, share, leaves = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.ones(len(context))
        cut = self.model.levels[level - 2]
        if not len(context) or not cut.nodes:
            return node, share, leaves
        shard, key = cut.route(context, child, self.model.words)
        for k, rows in by_shard(shard):
            if cut.first[k] == cut.first[k + 1]:
                continue
            _, arrays, keys = self.shard(level, k)
            distinct, back = np.unique(key[rows], return_inverse=True)
            at, same = keys.successor(distinct)
            found = np.flatnonzero(same[back])
            at = at[back][found]
            node[rows[found]] = cut.first[k] + at
            if inner is None:
                continue
            share[rows[found]] = DECODED[arrays["share"][at]]
            if inner:
                leaves[rows[found]] = DECODED[arrays["leaves"][at]]
        return node, share, leaves

    def children(self, level: int, context: int) -> np.ndarray:
        """Words that follow a context, by the pointers; for contexts that have no parts of their own."""
        cut = self.model.levels[level - 2]
        k = context * cut.cold // cut.contexts
        meta, arrays, keys = self.shard(level, k)
        pointers = restored("pointers", meta, arrays)
        local = context - cut.low(k)
        begin, end = pointers.get(np.array([local, local + 1])).astype(np.int64)
        return keys.get(np.arange(begin, end)).astype(np.int64) - local * self.model.words

    def contexts(self, ids: np.ndarray, begins: np.ndarray, order: int) -> np.ndarray:
        """The node of the ``order`` words before each place, or -1; ``begins``: place in its document."""
        context = np.r_[-1, ids[:-1]][: len(ids)]
        context = np.where(begins >= 1, context, -1)
        for level in range(2, order + 1):  # node of (context of length level - 1 one place earlier, word before)
            earlier = np.where(begins >= level, np.r_[-1, self._previous[:-1]][: len(ids)], -1) if level > 2 else np.where(begins >= 2, np.r_[-1, -1, ids[:-2]][: len(ids)], -1)
            last = np.r_[-1, ids[:-1]][: len(ids)]
            valid = np.flatnonzero((earlier >= 0) & (last >= 0))
            context = np.full(len(ids), -1, np.int64)
            context[valid] = self.find(level, earlier[valid], last[valid], None)[0]
            self._previous = context
        return context


def reader(model: Model) -> Reader:
    """One reader per worker, for the model as built so far."""
    return kept(("model", model.root, len(model.levels)), lambda: Reader(model))


BLOCKS = "shard int, block binary"


def _blocks(shard: np.ndarray, key: np.ndarray, counts: np.ndarray | None = None) -> pa.RecordBatch:
    """Occurrences as a block per shard."""
    shards, blocks = [], []
    for k, rows in by_shard(shard):
        shards.append(k)
        if counts is None:
            blocks.append(pack_block(*np.unique(key[rows], return_counts=True)))
        else:
            blocks.append(pack_block(*summed(key[rows], counts[rows])))
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blocks, pa.binary())], schema=arrow_schema(BLOCKS))


def _count_words(docs: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            held.clear()
            shard = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            return _blocks(shard, h & np.uint64((1 << 64 - bits) - 1))

        for part in groups(batches, 0):
            held.append(tokens_of(part.column(0).to_pylist())[0])
            if sum(map(len, held)) > GATHERED:
                yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, BLOCKS)


def _count_level(docs: DataFrame, model: Model, level: int, cut: Level) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader(model)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            shard, key = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            held.clear()
            return _blocks(shard, key)

        for part in groups(batches, 0):
            ids, _, sizes = own.of_texts(part.column(0).to_pylist())
            begins = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            context = own.contexts(ids, begins, level - 1)
            valid = np.flatnonzero(context >= 0)
            held.append(cut.route(context[valid], ids[valid], model.words))
            if sum(len(h[0]) for h in held) > GATHERED:
                yield flush()
        if held and any(len(h[0]) for h in held):
            yield flush()

    return docs.select("text").mapInArrow(run, BLOCKS)


BUILT = "shard int, n long, total long, hot array<long>, hot_n array<long>"


def _build(blocks: DataFrame, model: Model, level: int, shards: int, limit: int, cut: Level | None, inner: bool) -> list:
    """Merge the blocks of each shard, write its file, and report its size and the nodes with at least ``limit`` occurrences."""
    root, words, bits = model.root, model.words, model.shard_bits
    totals = dict(zip(cut.hot, model.hot_counts, strict=True)) if cut else {}
    owners = [c for c, n in zip(cut.hot, cut.parts, strict=True) for _ in range(n)] if cut else []

    def build(shard: int, pieces: list[bytes]) -> tuple[int, int, int, list[int], list[int]]:
        keys, counts = (np.concatenate(x) for x in zip(*map(unpack_block, pieces), strict=True))
        keys, counts = summed(keys, counts)
        n = len(keys)
        if level == 1:
            ef, sums = EliasFano.encode(keys, 1 << 64 - bits), EliasFano.encode(np.r_[np.uint64(0), np.cumsum(counts, dtype=np.uint64)], int(counts.sum()) + 1)
            meta, arrays = (a | b for a, b in zip(fields("keys", ef), fields("sums", sums), strict=True))
        else:
            fixed, relative = shares(level - 1)
            if shard < cut.cold:
                span = cut.low(shard + 1) - cut.low(shard)
                context = (keys // np.uint64(words)).astype(np.int64)
                of_context = np.bincount(context, counts.astype(float), span)[context]
                pointers = np.searchsorted(context, np.arange(span + 1))
            else:
                span, of_context = 1, float(totals[owners[shard - cut.cold]])
                pointers = np.array([0, n])
            share = counts / (of_context * (1 + relative) + fixed)
            meta, arrays = (a | b for a, b in zip(fields("keys", EliasFano.encode(keys, span * words)), fields("pointers", EliasFano.encode(pointers.astype(np.uint64), n + 1)), strict=True))
            arrays["share"] = code(share)
            if inner:
                fixed, relative = shares(level)
                weight = fixed + relative * counts
                arrays["leaves"] = code(weight / (counts + weight))
        save(f"{root}/level-{level}/{shard}", meta, arrays)
        hot = np.flatnonzero(counts >= limit)
        return shard, n, int(counts.sum()), hot.tolist(), counts[hot].astype(np.int64).tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, rows = None, [], []
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now and pieces:
                    rows.append(build(now, pieces))
                    pieces = []
                now = shard
                pieces.append(block)
        if pieces:
            rows.append(build(now, pieces))
        schema = arrow_schema(BUILT)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    dealt = blocks.repartition(shards, "shard").sortWithinPartitions("shard")
    return sorted(dealt.mapInArrow(run, BUILT).collect(), key=lambda r: r.shard)


def train(docs: DataFrame, use: Column | None = None, order: int = 3, shard: int = SHARD) -> Model:
    """Learn from the rows where ``use`` holds, all of them and whole (null texts: empty). ``shard``: occurrences per shard, about.

    The driver sees a few numbers per shard. Words are told apart by a 64-bit hash.
    """
    own = texts_of(docs).filter(F.lit(True) if use is None else use)
    spark = docs.sparkSession
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / 6 / shard / 8))))  # words repeat, so a shard of words may see more occurrences
    model = Model(shared_dir(spark), shard_bits=bits)
    built = {r.shard: r for r in _build(_count_words(own, bits), model, 1, 1 << bits, max(1, shard // 4), None, True)}
    ends = np.cumsum([0, *(built[k].n if k in built else 0 for k in range(1 << bits))]).tolist()
    model.first_word = tuple(ends)
    model.words, model.tokens = ends[-1], sum(r.total for r in built.values())
    hot = {ends[r.shard] + k: n for r in built.values() for k, n in zip(r.hot, r.hot_n, strict=True)}
    contexts = model.words
    for level in range(2, order + 1):
        named = sorted(hot)
        cut = Level(contexts, max(1, -(-model.tokens // shard)), tuple(named), tuple(-(-hot[c] // shard) + 1 for c in named))
        model.hot_counts = tuple(hot[c] for c in named)
        rows = {}
        if contexts:
            rows = {r.shard: r for r in _build(_count_level(own, model, level, cut), model, level, cut.shards, max(1, shard // 4), cut, level < order)}
        ends = np.cumsum([0, *(rows[k].n if k in rows else 0 for k in range(cut.shards))]).tolist()
        model.levels.append(Level(cut.contexts, cut.cold, cut.hot, cut.parts, tuple(ends), ends[-1]))
        hot = {ends[r.shard] + k: n for r in rows.values() for k, n in zip(r.hot, r.hot_n, strict=True)}
        contexts = ends[-1]
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row's whole text, in the input's partitions.

    A null or empty text is its end alone. ``base_score`` and ``score`` are sums of log10 probabilities:
    of the words alone, and of the words after their contexts. A model of an empty corpus knows no words.
    """
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader(model)
        for part in groups(batches, 1):
            ids, counts, sizes = own.of_texts(part.column(1).to_pylist())
            starts = np.cumsum(sizes) - sizes
            begins = np.arange(len(ids)) - np.repeat(starts, sizes)
            base = model.base(counts)
            p = base.copy()
            # the node of the words before each place, and what it leaves to shorter contexts
            context = np.where(begins >= 1, np.r_[-1, ids[:-1]], -1)
            fixed, relative = shares(1)
            before = np.r_[0, counts[:-1]]
            leaves = (fixed + relative * before) / (before + fixed + relative * before)
            for level in range(2, len(model.levels) + 2):
                valid = np.flatnonzero(context >= 0)
                known = valid[ids[valid] >= 0]
                node, share, onward = own.find(level, context[known], ids[known], level <= len(model.levels))
                gained = np.zeros(len(ids))
                gained[known] = share
                p[valid] = gained[valid] + leaves[valid] * p[valid]
                nodes, onwards = np.full(len(ids), -1, np.int64), np.ones(len(ids))
                nodes[known], onwards[known] = node, onward
                context, leaves = np.where(begins >= level, np.r_[-1, nodes[:-1]], -1), np.r_[1, onwards[:-1]]
            columns = [sizes, np.add.reduceat(counts > 0, starts, dtype=np.int64), np.full(len(sizes), model.tokens, np.int64), np.add.reduceat(np.log10(base), starts), np.add.reduceat(np.log10(p), starts)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, [*schema][1:], strict=True))], schema=schema)

    return texts_of(docs).mapInArrow(run, ddl)
