"""Byte-pair encoding and decoding by a segment tree over the ranks of adjacent pairs.

Each leaf holds the rank of the pair that begins at a symbol; each inner node
the least of its children, ties to the left. So the root is the leftmost merge
of lowest rank. A merge changes three leaves, each update walks one path to the
root, and encoding ends when the root shows no pair that can merge.

The trees of many short words grow side by side, as rows of one array. Long words
get a tree of their own. Words are encoded once per worker and then looked up,
in caches of bounded size that start anew when full.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from gridloom.llm.common import arrow_schema, by_slices, kept, texts_of

#: Above this many symbols a word has its own tree.
SIDE_BY_SIDE = 32
#: Entries that a cache may hold (some 400 bytes each) before it keeps only the first half: what came first is what comes often.
CACHED_CHUNKS, CACHED_WORDS = 300_000, 150_000
NEVER = np.int64(1) << 62

#: Fixed values of the public file: its special tokens, the white space of its normaliser, its word pattern.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\x85\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class SegmentTreeBPE:
    """Encodes words (as bytes) with the merges of a vocabulary file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        model = model["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + suffix] for s in symbols], np.int64)
        self.tokens = {i: s for s, i in (ids | self.special).items()}
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault(ids[a] << 32 | ids[b], (rank, ids[a + b]))
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.pair_rank = np.array([self.ranks[k][0] for k in self.pairs.tolist()], np.int64)
        self.pair_id = np.array([self.ranks[k][1] for k in self.pairs.tolist()], np.int64)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; an empty word has none."""
        out: list[list[int]] = [[] for _ in words]
        by_size: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if len(word) > SIDE_BY_SIDE:
                out[k] = self._one(word)
            elif word:
                by_size.setdefault(max(1, (len(word) - 1).bit_length()), []).append(k)
        for levels, rows in by_size.items():
            for at in range(0, len(rows), 8192):
                part = rows[at : at + 8192]
                for k, ids in zip(part, self._many([words[k] for k in part], 1 << levels), strict=True):
                    out[k] = ids
        return out

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], -1), self.pair_id[at]

    def _many(self, words: list[bytes], width: int) -> list[list[int]]:
        """Trees of ``width`` leaves, one row for each word. A node holds rank * width + place, so the least is leftmost."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        symbols = np.full((n, width + 1), -1, np.int64)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        inside = np.arange(width) < sizes[:, None]
        symbols[:, :width][inside] = self.inner[raw[inside]]
        symbols[np.arange(n), sizes - 1] = self.last[raw[np.arange(n), sizes - 1]]
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), NEVER, np.int64)
        rank, _ = self._look_up(symbols[:, :-1], np.maximum(symbols[:, 1:], 0))
        fits = (rank >= 0) & (symbols[:, 1:] >= 0) & inside
        tree[:, width:][fits] = (rank * width + np.arange(width))[fits]
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        symbols_1, after_1, before_1, tree_1 = symbols.ravel(), after.ravel(), before.ravel(), tree.ravel()  # views

        def put(base: np.ndarray, place: np.ndarray, value: np.ndarray | np.int64) -> None:
            """base: where each row's tree begins."""
            node = place + width
            tree_1[base + node] = value
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                at = base + node
                left = at + node
                tree_1[at] = np.minimum(tree_1[left], tree_1[left + 1])

        def pair(base: np.ndarray, place: np.ndarray) -> np.ndarray:
            """base: where each row's symbols begin."""
            at = base + place
            right = symbols_1[base + after_1[at]]
            rank, _ = self._look_up(symbols_1[at], np.maximum(right, 0))
            return np.where((rank >= 0) & (right >= 0), rank * width + place, NEVER)

        rows = np.flatnonzero(tree[:, 1] < NEVER)
        while len(rows):
            trees, base = rows * (2 * width), rows * (width + 1)
            place = tree_1[trees + 1] & (width - 1)
            here = base + place
            gone = after_1[here]
            there = base + gone
            _, merged = self._look_up(symbols_1[here], symbols_1[there])
            symbols_1[here] = merged
            symbols_1[there] = -1
            then = after_1[there]
            after_1[here] = then
            before_1[base + np.minimum(then, width)] = place
            put(trees, gone, NEVER)
            put(trees, place, pair(base, place))
            prior = before_1[here]
            some = np.flatnonzero(prior >= 0)
            put(trees[some], prior[some], pair(base[some], prior[some]))
            rows = rows[tree_1[trees + 1] < NEVER]
        live = symbols >= 0
        flat = symbols[live].tolist()
        ends = np.cumsum(live.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _one(self, word: bytes) -> list[int]:
        """One tree, for a long word."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        symbols = [*self.inner[np.frombuffer(word, np.uint8)].tolist()]
        symbols[-1] = int(self.last[word[-1]])
        after, before, never = [*range(1, n + 1)], [*range(-1, n - 1)], (1 << 62, 0)
        ranks = self.ranks

        def pair(place: int) -> tuple[int, int]:
            found = ranks.get(symbols[place] << 32 | symbols[after[place]]) if after[place] < n else None
            return (found[0], place) if found else never

        tree = [never] * width + [pair(k) for k in range(n)] + [never] * (width - n)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(place: int, value: tuple[int, int]) -> None:
            node = place + width
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] != never:
            place = tree[1][1]
            gone = after[place]
            symbols[place] = ranks[symbols[place] << 32 | symbols[gone]][1]
            symbols[gone] = -1
            after[place] = after[gone]
            if after[gone] < n:
                before[after[gone]] = place
            put(gone, never)
            put(place, pair(place))
            if before[place] >= 0:
                put(before[place], pair(before[place]))
        return [s for s in symbols if s >= 0]


class TextCodec:
    """Whole texts to ids and back: normalise, split into words, encode each once."""

    def __init__(self, path: str):
        self.bpe = SegmentTreeBPE(path)
        #: Decimal ids and decoded form, of words and of whole chunks.
        self.words: dict[str, tuple[str, str]] = {}
        self.known: dict[str, tuple[str, str]] = {}
        self.special = re.compile("(" + "|".join(map(re.escape, self.bpe.special)) + ")") if self.bpe.special else None

    def chunks(self, text: str) -> list[str]:
        """The parts between white space. Words never span them, and neither do the normaliser's changes."""
        if any(s in text for s in self.bpe.special):
            return [c for part in self.special.split(text) for c in ([part] if part in self.bpe.special else self._plain(part))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # str.split() takes them for white space
            return [c for c in SPACES.split(text) if c]
        return text.split()

    @staticmethod
    def _split(chunk: str) -> list[str]:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # each letter is lowered on its own
        chunk = chunk.lower()
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and (word := chunk[:-1]).isalpha():
            return [word, chunk[-1]]
        return WORDS.findall(chunk)

    def _learn(self, chunks: set[str]) -> None:
        words, known, tokens = self.words, self.known, self.bpe.tokens
        if len(words) > CACHED_WORDS:
            words = self.words = dict(islice(words.items(), CACHED_WORDS // 2))
        split = self._split
        parts = [(c, split(c)) for c in chunks if c not in self.bpe.special]
        new = [*{w for _, ws in parts for w in ws if w not in words}]
        for word, ids in zip(new, self.bpe.encode([w.encode() for w in new]), strict=True):
            words[word] = (" ".join([str(i) for i in ids]), " ".join([tokens[i] for i in ids]))
        for chunk, ws in parts:
            if len(ws) == 1:
                known[chunk] = words[ws[0]]
            else:
                both = [words[w] for w in ws]
                known[chunk] = (" ".join([x[0] for x in both]), " ".join([x[1] for x in both]))
        known.update({word: (str(i), word) for word, i in self.bpe.special.items() if word in chunks})

    def encode_all(self, texts: list[str | None]) -> tuple[list[str], list[str]]:
        """For each text its decimal ids joined by spaces, and its decoded form."""
        cut = [self.chunks(t) if t else [] for t in texts]
        known = self.known
        if missing := set().union(*cut) - known.keys():
            if len(known) + len(missing) > CACHED_CHUNKS:
                known = self.known = dict(islice(known.items(), CACHED_CHUNKS // 2))
                missing = set().union(*cut) - known.keys()
            self._learn(missing)
        ids, back = [], []
        for chunks in cut:
            a, b = zip(*map(known.__getitem__, chunks), strict=True) if chunks else ((), ())
            ids.append(" ".join(a))
            back.append(" ".join(b))
        return ids, back


def codec(path: str) -> TextCodec:
    """One codec per worker and file."""
    return kept(("codec", path), lambda: TextCodec(path))


def encode_decode(docs: DataFrame, tokenizer: str, digests_only: bool = False, place: str | None = None) -> DataFrame:
    """Encode each whole text and decode it again.

    Returns ``doc_id, n_tokens, ids (array<int>), decoded`` in the input's partitions, with no
    shuffle; with ``digests_only``, the SHA-256 of the decimal ids and of the decoded text instead
    of those two. A null text counts as empty: no tokens, and an empty string back. Repeated rows
    each give a row. Other columns are not read, but the long column ``place``, if named, is returned
    last. ``tokenizer`` is the vocabulary file's path on every machine.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = "ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string"
    schema = f"doc_id {kind}, n_tokens long, {extra}" + (f", {place} long" if place else "")
    arrow = arrow_schema(schema)

    def encode(rows: dict[str, list]) -> dict[str, list]:
        ids, back = codec(tokenizer).encode_all(rows["text"])
        out = {"doc_id": rows["doc_id"], "n_tokens": [i.count(" ") + 1 if i else 0 for i in ids]} | ({place: rows[place]} if place else {})
        if digests_only:
            return out | {"ids_sha256": [hashlib.sha256(i.encode()).hexdigest() for i in ids], "decoded_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in back]}
        return out | {"ids": [[*map(int, i.split())] for i in ids], "decoded": back}

    own = texts_of(docs, place) if place else texts_of(docs)
    return own.mapInArrow(by_slices(encode, arrow), schema)
