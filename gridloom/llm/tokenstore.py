"""Token ids in a file format for short documents.

Every document's id array is its own zstandard frame, made with one dictionary that was trained on
a bounded sample of serialized arrays. Shards hold documents in ascending ``doc_id``; each
shard names its dictionary by hash and has an index of frame offsets, so that one document is
read without touching its neighbours.

Documents without ``doc_id`` come last.

Shard layout, little-endian: magic (8 bytes), dictionary hash (8), bytes per id (1), documents n (4), of these with a ``doc_id`` (4),
then ``doc_id`` int64[n], ids per document uint32[n], frame offsets uint64[n + 1], frames.
Shards are rows of a Parquet table and so live in any store that Spark writes; the dictionary is
a one-row table beside them.
"""

from __future__ import annotations

import contextlib
import json
import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import byte_symbols
from gridloom.llm.common import SLICE, arrow_schema, by_slices, kept, shared_dir, texts_of, written

MAGIC = b"GLTOKEN2"
HEAD = struct.Struct("<8sQBII")
#: Documents sampled for the dictionary, its size, and a shard's limits.
SAMPLE_DOCS, DICTIONARY_BYTES, SHARD_DOCS, SHARD_BYTES = 1000, 65536, 16384, 4 << 20
LEVEL = 3
#: Entries that the lookup of chunks may hold before it starts anew.
CACHED = 400_000
#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Marks that are a pre-token of their own between letters and the end or a line. Letters below this have been letters for long.
MARKS, LATIN = ".,\n", "\u0250"


class Odd(Exception):
    """A piece that white space touches, or an empty one: the space before it may not begin a pre-token."""


class Chunks(dict):
    """Serialized ids of chunks that follow a space, each made once."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED:  # what came first is what comes often
            some = dict(islice(self.items(), CACHED // 2))
            self.clear()
            self.update(some)
        ids = self[chunk] = self.make(chunk)
        return ids


class ChunkEncoder:
    """The tokenizers library, asked once for each chunk between single spaces.

    A space with no white space on either side always begins a pre-token, so the chunks
    that begin there encode independently; any other space stays inside its chunk. That holds for byte-level
    vocabularies without a normaliser; a file that says otherwise is refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        before = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or said["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in said.get("added_tokens", ())]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.model, self.fast = self.tokenizer.model, self._merges(said["model"])
        self.symbols = {b: c for b, c in enumerate(byte_symbols()) if chr(b) != c}
        self.marks = {m: self._whole(m) for m in MARKS}
        self.known = Chunks(self._chunk)
        self.odd = Chunks(lambda chunk: self._whole(" " + chunk))
        self.heads = Chunks(self._whole)

    def _merges(self, model: dict) -> tiktoken.Encoding | None:
        """The file's own merges for tiktoken, which ranks them by id; None where ids aren't in the order of merges."""
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        symbol = {c: b for b, c in enumerate(byte_symbols())}
        known = {bytes(symbol[c] for c in token): k for token, k in model["vocab"].items() if token not in self.special}
        return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=known, special_tokens={}) if merged == sorted(merged) else None

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        """By the library's whole way."""
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str, space: str) -> bytes:
        """Ids of a word of Latin letters, which is one pre-token: the merges alone, after its byte symbols."""
        if self.fast is not None and len(word) < 500:
            return self._bytes(self.fast.encode_ordinary(" " + word if space else word))
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.symbols)
        return self._bytes([t.id for t in self.model.tokenize(space + word)])

    def _chunk(self, chunk: str) -> bytes:
        """Most chunks are a word, a word and a mark, or two of these with a line between; the library takes the others whole."""
        if chunk.isalpha():
            return self._word(chunk, self.symbols[32]) if max(chunk) < LATIN else self._whole(" " + chunk)
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Odd
        first, line, second = chunk.partition("\n")
        bare = first[:-1] if first[-1:] in (".", ",") else first
        if not (bare.isalpha() and max(bare) < LATIN):
            return self._whole(" " + chunk)
        ids = self.known.get(bare) or self._word(bare, self.symbols[32])
        if bare is not first:
            ids += self.marks[first[-1]]
        if line:
            last = second[:-1] if second[-1:] in (".", ",") else second
            if not (last.isalpha() and max(last) < LATIN):
                return self._whole(" " + chunk)
            ids += self.marks["\n"] + self._word(last, "")
            if last is not second:
                ids += self.marks[second[-1]]
        return ids

    @staticmethod
    def _cut(pieces: list[str]) -> list[str]:
        """Pieces joined again wherever the space between them doesn't begin a pre-token."""
        out = [[pieces[0]]]
        for piece in pieces[1:]:
            before = out[-1][-1]
            if piece and before and not piece[0].isspace() and not before[-1].isspace():
                out.append([piece])
            else:
                out[-1].append(piece)
        return [" ".join(p) for p in out]

    def array(self, text: str | None) -> bytes:
        """The serialized ids of a text."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._whole(text)
        head, *pieces = text.split(" ")
        if not pieces or (head and not head[-1].isspace()):
            with contextlib.suppress(Odd):
                return self.heads[head] + b"".join(map(self.known.__getitem__, pieces))
        head, *chunks = self._cut([head, *pieces])
        return self.heads[head] + b"".join([self.odd[c] if c[-1].isspace() or " " in c else self.known[c] for c in chunks])

    def arrays(self, texts: list[str | None]) -> list[bytes]:
        return [self.array(t) for t in texts]


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker and file."""
    return kept(("encoder", path), lambda: ChunkEncoder(path))


#: ``before``: ids of the part before this shard.
STORE = "part int, seq int, before long, n_docs long, n_tokens long, blob binary"


def train_dictionary(docs: DataFrame, tokenizer: str, sample_docs: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from about ``sample_docs`` documents, chosen by a hash of their id; empty if there are too few."""
    total = docs.count()
    share = min(1.0, sample_docs / max(total, 1))
    picked = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def arrays(rows: dict[str, list]) -> dict[str, list]:
        return {"ids": encoder(tokenizer).arrays(rows["text"])}

    sample = [r.ids for r in picked.mapInArrow(by_slices(arrays, arrow_schema("ids binary")), "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, [bytes(s) for s in sample if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on
        return b""


def pack(dictionary: bytes, width: int, ids: list[int | None], counts: list[int], frames: list[bytes]) -> bytes:
    """One shard from frames in ascending document order, those without id last."""
    offsets = np.zeros(len(frames) + 1, "<u8")
    np.cumsum([len(f) for f in frames], out=offsets[1:])
    head = HEAD.pack(MAGIC, xxhash.xxh64_intdigest(dictionary), width, len(frames), len(ids) - ids.count(None))
    return b"".join([head, np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), *frames])


class Shard:
    """Reads single documents of a shard."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, digest, width, n, self.named = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        if digest != xxhash.xxh64_intdigest(dictionary):
            raise ValueError("the shard was written with another dictionary")
        self.blob, self.dtype, at = blob, np.dtype(f"<u{width}"), HEAD.size
        self.doc_ids = np.frombuffer(blob, "<i8", n, at)
        self.nameless = np.arange(n) >= self.named
        self.counts = np.frombuffer(blob, "<u4", n, at + 8 * n)
        self.offsets = np.frombuffer(blob, "<u8", n + 1, at + 12 * n).astype(np.int64)
        self.base = at + 12 * n + 8 * (n + 1)
        self._zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the shard's k-th document; only its frame is read."""
        frame = memoryview(self.blob)[self.base + self.offsets[k] : self.base + self.offsets[k + 1]]
        return np.frombuffer(self._zstd.decompress(frame), self.dtype)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Encode whole texts (null: empty), end each with ``end_id``, and write shards in ascending ``doc_id``.

    Rows that share an id keep one row each, ordered by a hash of their frames, by which many of them are dealt, too; those without id come last.
    Encoding is done once, into a table of frames; only frames travel to their range of ids.
    """
    spark, docs = docs.sparkSession, texts_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    dictionary = train_dictionary(docs, tokenizer)
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    def compress(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end = np.array([end_id], own.dtype).tobytes()
        given = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=given)

        def frames(rows: dict[str, list]) -> dict[str, list]:
            arrays = [a + end for a in own.arrays(rows["text"])]
            return {"doc_id": rows["doc_id"], "n_tokens": [len(a) // own.dtype.itemsize for a in arrays], "frame": [zstd.compress(a) for a in arrays]}

        yield from by_slices(frames, arrow_schema(frame_ddl))(batches)

    frame_ddl = "doc_id long, n_tokens long, frame binary"
    table = written(docs.mapInArrow(compress, frame_ddl), "frames", path)
    parts = max(1, -(-table.count() // SHARD_DOCS))
    shard_ddl = STORE
    width = encoder(tokenizer).dtype.itemsize

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, held = [], [], [], 0

        def full() -> pa.RecordBatch:
            row = [[part], [seq], [before], [len(ids)], [sum(counts)], [pack(shared.value, width, ids, counts, frames)]]
            schema = arrow_schema(shard_ddl)
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                for doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    ids.append(doc_id)
                    counts.append(n)
                    frames.append(frame)
                    held += len(frame)
                    if len(ids) >= SHARD_DOCS or held >= SHARD_BYTES:
                        yield full()
                        before += sum(counts)
                        ids, counts, frames, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield full()

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("frame")]
    ordered = table.repartitionByRange(parts, *order).sortWithinPartitions(*order, "frame")
    ordered.mapInArrow(shards, shard_ddl).write.mode("overwrite").parquet(f"{path}/shards")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")


def read(spark: SparkSession, path: str, digests_only: bool = False) -> DataFrame:
    """Documents of a store: ``doc_id, start`` (ids before it), ``n_tokens, ids``; or a CRC-32 of the ids as uint32 instead of them.

    Only one total per range of ids (a range per ``SHARD_DOCS`` documents) comes to the driver.
    """
    store = spark.read.schema(STORE).parquet(f"{path}/shards")
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()[0])
    starts, before = {}, 0
    for row in store.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        starts[row.part] = before
        before += row.n
    shared = spark.sparkContext.broadcast((dictionary, starts))
    ddl = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests_only else "ids array<long>")

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, starts = shared.value
        schema = arrow_schema(ddl)
        for batch in batches:
            for k in range(batch.num_rows):
                part, before, blob = (batch.column(c)[k].as_py() for c in range(3))
                shard = Shard(blob, dictionary)
                counts = shard.counts.astype(np.int64)
                first = starts[part] + before + np.cumsum(counts) - counts
                for at in range(0, len(counts), 1024):
                    span = range(at, min(at + 1024, len(counts)))
                    arrays = [shard.ids(k).astype("<u4") for k in span]
                    last = [zlib.crc32(a.tobytes()) for a in arrays] if digests_only else [a.astype(np.int64) for a in arrays]
                    cut = slice(span.start, span.stop)
                    ids = pa.array(shard.doc_ids[cut], pa.int64(), mask=shard.nameless[cut])
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([ids, first[cut], counts[cut], last], schema, strict=True)], schema=schema)

    return store.select("part", "before", "blob").mapInArrow(documents, ddl)


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to a store and read it back: ``doc_id, start, n_tokens, ids_crc32``."""
    path = path or shared_dir(docs.sparkSession) + "/tokens"
    write(docs, tokenizer, path, end_id)
    return read(docs.sparkSession, path, digests_only=True)
