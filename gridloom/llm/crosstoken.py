"""Alignment of two tokenizers: groups of tokens between shared byte offsets, and how often ids of both end together.

A (a byte-level vocabulary) reads a space and the text, B (sentence pieces with byte fallback) the text, to which it adds that space, so
both cut the same bytes. Where a space stands between two characters that aren't white space, both begin a token, so chunks between such spaces are
encoded and aligned once and looked up afterwards.

Links are counted in blocks of documents first. A block's distinct pairs go to stripes of B's ids (id modulo the number of stripes, so frequent ids
are spread), where a dense matrix of a stripe's rows by A's ids takes them with ``np.add.at``; a row's maximum is the best count of its B id. Counts meet the
blocks' pairs by id pair, and then their documents by block, so no key has more rows than there are blocks, however frequent a pair is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import byte_symbols
from gridloom.llm.common import arrow_schema, kept, shared_dir, texts_of, written
from gridloom.llm.tokenstore import LATIN, ChunkEncoder, Odd

#: Documents and distinct pairs of documents in a block, characters that are taken at once, entries of the lookup of chunks, stripes, pairs in a row.
BLOCK_DOCS, BLOCK_PAIRS, STRETCH, CACHED, STRIPES, ROW_PAIRS = 4096, 2 << 20, 1 << 20, 500_000, 512, 1 << 15
#: Characters of texts whose unknown chunks are encoded together.
TOGETHER = 1 << 19
#: How B writes a space.
MARK = "▁"

#: A document's row, or (with ``codes``) a part of its block's pairs. ``own`` are places in the block's sorted pairs.
LINKS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own array<int>, times array<int>, codes array<long>, counts array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Differs(Exception):
    """B's pieces don't give the text's bytes."""


class Aligner(dict):
    """Chunk that follows a space to its entry: how many tokens of A and of B it has, its groups and links.

    A's merges are in the order of its ids, so words of Latin letters, marks and ASCII go to tiktoken with that vocabulary; any other chunk, or a long one, goes to the tokenizers library.
    """

    def __init__(self, a_path: str, b_path: str):
        super().__init__()
        import sentencepiece

        self.a = ChunkEncoder(a_path)
        special = set(self.a.special)
        self.a.tokenizer.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_a, self.n_b = self.a.tokenizer.get_vocab_size(), self.b.get_piece_size()
        symbol = {c: b for b, c in enumerate(byte_symbols())}
        known = {bytes(symbol[c] for c in token): k for token, k in self.a.tokenizer.get_vocab().items() if token not in special}
        self.fast = self.a.fast
        pieces = [self.b.id_to_piece(k) for k in range(self.n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"pieces of {b_path} reach across spaces")
        self.size_a, self.size_b = np.zeros(self.n_a, np.int64), np.array([len(x) for x in self.bytes_b])
        self.size_a[list(known.values())] = [len(x) for x in known]
        #: Ids as they stand in the groups: inside and at the end of A's part, inside and at the end of B's.
        self.said = [f"{k}{end}".encode() for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for end in ends for k in range(n)]

    def plain(self, chunk: str) -> bool:
        return self.fast is not None and len(chunk) < 500 and (chunk.isascii() or max(chunk) < LATIN) and not chunk[:1].isspace() and not chunk[-1:].isspace()

    def ids_a(self, chunks: list[str]) -> np.ndarray:
        """A's ids of a space and each chunk; runs of plain ones are one text to tiktoken."""
        out: list[int] = []
        for plain, run in groupby(chunks, self.plain):
            if plain:
                out += self.fast.encode_ordinary(" ".join(["", *run]))
            else:
                for chunk in run:
                    out += self.a.tokenizer.encode(" " + chunk, add_special_tokens=False).ids
        return np.array(out, np.int64)

    def entries(self, chunks: list[str]) -> list[tuple[int, int, bytes, bytes] | None]:
        """Tokens of A and of B, groups (each ended by ``;``) and codes of linked pairs of some chunks, aligned together; None where B's bytes differ."""
        a, ids_b = self.ids_a(chunks), self.b.encode(chunks)
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        n_b = np.array([len(x) for x in ids_b])
        b = np.fromiter(chain.from_iterable(ids_b), np.int64, n_b.sum())
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        upto_a, upto_b = np.searchsorted(ends_a, ends) + 1, np.cumsum(n_b)
        n_a = np.diff(upto_a, prepend=0)
        equal = n_b.all() and np.array_equal(ends_b[upto_b - 1], ends) and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == " ".join(["", *chunks]).encode()
        if not equal:
            half = len(chunks) // 2
            return self.entries(chunks[:half]) + self.entries(chunks[half:]) if half else [None]
        met = np.searchsorted(ends_b, ends_a)  # both end with every chunk
        last_a, last_b = ends_b[met] == ends_a, np.zeros(len(b), bool)
        last_b[met[last_a]] = True
        # a token's place among all: after the tokens of the other side whose groups come before
        groups_a, groups_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        place_a, place_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        said = np.empty(len(a) + len(b), np.int64)
        said[np.arange(len(a)) + np.r_[0, place_b][groups_a]] = a + self.n_a * last_a
        said[np.arange(len(b)) + place_a[groups_b]] = b + self.n_b * last_b + 2 * self.n_a
        words, codes = list(map(self.said.__getitem__, said.tolist())), (a[last_a] * self.n_b + b[last_b]).tobytes()
        text, link = (upto_a + upto_b).tolist(), (8 * np.cumsum(last_a)[upto_a - 1]).tolist()
        return [(x, y, b"".join(words[t:u]), codes[k:m]) for x, y, t, u, k, m in zip(n_a.tolist(), n_b.tolist(), [0, *text], text, [0, *link], link, strict=False)]

    def learn(self, texts: list[str | None]) -> None:
        """The chunks of some texts that aren't known yet, together."""
        if len(self) >= CACHED:  # what came first is what comes often
            for key in list(self)[CACHED // 2 :]:
                del self[key]
        new = {p for t in texts if t and MARK not in t for part in stretches(t) for p in part.split(" ")}
        if chunks := [p for p in new if p and p not in self and not p[0].isspace() and not p[-1].isspace()]:
            self.update(zip(chunks, self.entries(chunks), strict=True))

    def __missing__(self, chunk: str) -> tuple[int, int, bytes, bytes] | None:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Odd
        return self.entries([chunk])[0]

    def align(self, text: str) -> tuple[int, int, bytes, np.ndarray]:
        """Both encodings of a space and ``text``, as of one entry."""
        pieces = text.split(" ")
        try:
            found = list(map(self.__getitem__, pieces))
        except Odd:
            found = [self[c] if c and not c[0].isspace() and not c[-1].isspace() else self.entries([c])[0] for c in ChunkEncoder._cut(pieces)]
        if None in found:
            raise Differs
        a, b, groups, links = zip(*found, strict=True)
        return sum(a), sum(b), b"".join(groups), np.frombuffer(b"".join(links), np.int64)


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A text in parts of about ``size`` characters, without the spaces between them, at which both tokenizers begin a token."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        while end > 0 and (end + 1 >= len(text) or text[end - 1].isspace() or text[end + 1].isspace()):
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


#: What a text without tokens gives.
NO_TOKENS = (0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def document(aligner: Aligner, text: str | None, size: int = STRETCH) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
    """Tokens of A and of B, links, digest of the groups, distinct pair codes and how often each occurs."""
    if not text or MARK in text:  # B takes the mark for a space, so its bytes differ
        return NO_TOKENS
    n_a = n_b = n_links = 0
    digest, between, codes, times = hashlib.sha256(), b"", [], []
    try:
        for part in stretches(text, size):
            a, b, groups, links = aligner.align(part)
            n_a, n_b, n_links = n_a + a, n_b + b, n_links + len(links)
            digest.update(between + groups[:-1])
            between = b";"
            own, n = np.unique(links, return_counts=True)
            codes.append(own)
            times.append(n)
    except Differs:
        return NO_TOKENS
    if len(codes) > 1:
        own, place = np.unique(np.concatenate(codes), return_inverse=True)
        codes, times = [own], [np.bincount(place, np.concatenate(times), len(own)).astype(np.int64)]
    return n_a, n_b, n_links, digest.hexdigest(), codes[0], times[0]


def read_ahead(aligner: Aligner, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    """``doc_id, text``, after the chunks of some texts have been learned together."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= TOGETHER:
                aligner.learn(texts)
                yield from zip(ids, texts, strict=True)
                ids, texts, size = [], [], 0
        aligner.learn(texts)
        yield from zip(ids, texts, strict=True)


def _block(block: int, docs: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A block's rows: its documents, then its pairs."""
    every = np.concatenate([d[5] for d in docs])
    codes, place = np.unique(every, return_inverse=True)
    counts = np.bincount(place, np.concatenate([d[6] for d in docs]), len(codes)).astype(np.int64)
    sizes = [len(d[5]) for d in docs]
    places, none = np.split(place.astype(np.int32), np.cumsum(sizes)[:-1]), [None] * len(docs)
    columns = [[block] * len(docs), *(list(c) for c in zip(*((d[0], d[1], d[2], d[3], d[3], d[4]) for d in docs), strict=True)), places, [d[6].astype(np.int32) for d in docs], none, none]
    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)
    cuts = range(0, len(codes), ROW_PAIRS)
    if cuts:
        none = [None] * len(cuts)
        columns = [[block] * len(cuts), *[none] * 8, [codes[c : c + ROW_PAIRS] for c in cuts], [counts[c : c + ROW_PAIRS] for c in cuts]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)


def linked(docs: DataFrame, a_path: str, b_path: str, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows LINKS of all documents, in blocks."""
    schema = arrow_schema(LINKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))
        block, rows, pairs = TaskContext.get().partitionId() << 32, [], 0
        for doc_id, text in read_ahead(aligner, batches):
            rows.append((doc_id, *document(aligner, text)))
            pairs += len(rows[-1][5])
            if len(rows) >= block_docs or pairs >= BLOCK_PAIRS:
                yield from _block(block, rows, schema)
                block, rows, pairs = block + 1, [], 0
        if rows:
            yield from _block(block, rows, schema)

    return docs.mapInArrow(run, LINKS)


COUNTED = "code long, total long, best boolean"


def counted(pairs: DataFrame, n_a: int, n_b: int, stripes: int = STRIPES) -> DataFrame:
    """``code, total, best`` of every pair of ids that is linked anywhere: sums of ``code, n``, and whether it is the highest of its B id.

    A task holds one stripe's matrix at a time: as many rows as B ids fall to a stripe, a column for each A id.
    """
    schema, high = arrow_schema(COUNTED), -(-n_b // stripes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now = np.zeros((high, n_a), np.int64), None

        def full() -> Iterator[pa.RecordBatch]:
            rows = np.flatnonzero(matrix.any(1))
            some = matrix[rows]
            row, a = np.nonzero(some)
            total = some[row, a]
            yield pa.RecordBatch.from_arrays([pa.array(a * n_b + rows[row] * stripes + now), pa.array(total), pa.array(total == some.max(1)[row])], schema=schema)
            matrix[rows] = 0

        for batch in batches:
            stripe, code, n = (batch.column(c).to_numpy() for c in range(3))
            edges = [0, *(np.flatnonzero(stripe[1:] != stripe[:-1]) + 1).tolist(), len(stripe)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                if stripe[start] != now:
                    if now is not None:
                        yield from full()
                    now = int(stripe[start])
                a, b = np.divmod(code[start:end], n_b)
                np.add.at(matrix, (b // stripes, a), n[start:end])
        if now is not None:
            yield from full()

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    striped = pairs.select((F.col("code") % n_b % stripes).cast("int").alias("stripe"), "code", "n")
    return striped.repartition(min(parts, stripes), "stripe").sortWithinPartitions("stripe").mapInArrow(run, COUNTED)


def _scored(key: tuple, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the corpus-wide counts of their links."""
    pairs = pairs.sort_by("code")
    total, best = pairs.column("total").to_numpy(), pairs.column("best").to_numpy()
    n_best, sums = [], []
    for own, times in zip(docs.column("own"), docs.column("times"), strict=True):
        own, times = own.values.to_numpy(), times.values.to_numpy().astype(np.int64)
        n_best.append(int(times[best[own]].sum()) if len(own) else 0)
        sums.append(int((total[own] * times).sum()) if len(own) else 0)
    columns = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(columns | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups_sha256": docs.column("groups_sha256")})


def alignment(docs: DataFrame, a_path: str, b_path: str, root: str | None = None, block_docs: int = BLOCK_DOCS, stripes: int = STRIPES) -> DataFrame:
    """One row per document: its tokens of either kind, groups, links, and what its links count over all documents.

    A link is a token of A and one of B that end at the same byte; tokens have bytes, so every group ends in one link. A text that is null or empty, or that B's pieces
    don't give back (it holds B's mark for a space), has no tokens, zeros, and '' as digest. Rows are independent: repeated and null ids are rows like others.
    """
    root = root or shared_dir(docs.sparkSession) + "/aligned"
    own = texts_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    table = written(linked(own, a_path, b_path, block_docs), "links", root)
    pairs = table.filter("codes is not null").select("block", F.explode(F.arrays_zip("codes", "counts")).alias("p")).select("block", F.col("p.codes").alias("code"), F.col("p.counts").alias("n"))
    aligner = Aligner(a_path, b_path)
    totals = written(counted(pairs, aligner.n_a, aligner.n_b, stripes), "totals", root)
    met = pairs.select(F.col("block").alias("of"), "code").join(totals, "code")
    rows = table.filter("codes is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "own", "times")
    return rows.groupBy("block").cogroup(met.groupBy("of")).applyInArrow(_scored, RESULT)
