"""Language identification by unigram pieces, summed over all segmentations of each word.

For every language each piece of a fixed public vocabulary has a probability. A word's
probability is the sum, over all ways to cut it into pieces, of the products of theirs: a forward
pass gives it without listing them. Expectation-maximisation over the same passes learns
the probabilities. A character that is no piece is spelled by the vocabulary's byte pieces.

Words are what white space separates, in training as in prediction. They are scored side by side, those of one length
together, and each once per worker; a long one is scored alone, in logarithms, and learned in stretches.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SLICE, arrow_schema, kept, texts_of, with_text

#: Training documents per language (expected; chosen by a hash of the id) and rounds of learning.
PER_LANG, ROUNDS = 400, 2
#: Share of each language's probability that is spread evenly over all pieces.
FLOOR = 0.02
#: Longer words are scored one at a time. Training cuts longer words into stretches of so many characters, or of the second
#: number where characters are spelled by bytes, whose probabilities are small.
SIDE_BY_SIDE, SPELLED = 48, 12
#: Bytes that a worker's lookup of words may take, those of a batch's forward sums, and words that are summed together.
CACHE_BYTES, FORWARD_BYTES, TOGETHER = 80 << 20, 16 << 20, 200_000
#: Below this a probability is near the end of what a double can say.
TINY = 1e-250
#: More languages raise: the model has a number for each of them and each piece.
MAX_LANGS = 512
STRIP = ".,;:!?\"'()[]«»|"
UNKNOWN = "und"


class Pieces:
    """The vocabulary, as hashes of its pieces that a lookup over many substrings can find."""

    BASE = np.uint64(1_000_003)

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        texts, self.byte_row = [], np.zeros(256, np.int64)
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                self.byte_row[int(model.id_to_piece(i)[3:-1], 16)] = len(texts)
                texts.append(None)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                texts.append(model.id_to_piece(i))
        self.n = len(texts)
        self.longest = max(len(t) for t in texts if t)
        rows = [k for k, t in enumerate(texts) if t]
        hashes = np.array([self._hash(texts[k]) for k in rows], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], np.array(rows, np.int64)[order]
        self.characters = {t for t in texts if t and len(t) == 1}

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(self.BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    def find(self, codes: np.ndarray) -> list[np.ndarray]:
        """codes: a row per word. For each length k - 1, the piece that begins at each place, or n where there is none."""
        n, size = codes.shape
        prefix = np.zeros((n, size + 1), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size):
                prefix[:, j + 1] = prefix[:, j] * self.BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
            out, power = [], np.uint64(1)
            for k in range(1, min(self.longest, size) + 1):
                power = power * self.BASE
                h = prefix[:, k:] - prefix[:, :-k] * power
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                out.append(np.where(self.hashes[at] == h, self.rows[at], self.n))
        return out


class Known:
    """Scores of words that a worker has met: a row of numbers each, row 0 for words without a letter."""

    def __init__(self, langs: int):
        self.room = max(1, CACHE_BYTES // (160 + 8 * langs))
        self.langs = langs
        self.start()

    def start(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((1024, self.langs))
        self.used = 1

    def add(self, scores: np.ndarray) -> range:
        while self.used + len(scores) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        rows = range(self.used, self.used + len(scores))
        self.scores[self.used : rows.stop] = scores
        self.used = rows.stop
        return rows


def words_of(text: str | None) -> list[str]:
    """What white space separates, in lower case."""
    return text.lower().split() if text else []


def bare(word: str) -> str:
    """A word without the marks around it; empty if it has no letter. Lone halves of surrogate pairs become question marks."""
    word = word.strip(STRIP)
    return word.encode("utf-8", "replace").decode() if any(map(str.isalpha, word)) else ""


@dataclass
class Model:
    """p: piece by language."""

    vocabulary: str
    langs: list[str]
    p: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    _pieces: Pieces | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "langs": self.langs, "p": self.p, "name": self.name}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    @property
    def pieces(self) -> Pieces:
        if self._pieces is None:
            self._pieces = Pieces(self.vocabulary)
        return self._pieces

    @property
    def batch(self) -> int:
        """Words that are scored side by side, by the memory that their sums take."""
        return max(16, min(4096, FORWARD_BYTES // (8 * (SIDE_BY_SIDE + 2) * max(1, len(self.langs)))))

    #: Every piece's probability is raised by this for each of its characters, and so each segmentation of a word by the same power.
    RAISE = 16.0

    def _edges(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[str]]:
        """Piece at each place and length; the raised probabilities by piece, with a row for no piece and one per spelled character."""
        pieces = self.pieces
        size = len(words[0])
        codes = np.array("".join(words)).reshape(1).view(np.uint32).reshape(len(words), size)
        found = pieces.find(codes)
        spelled = np.unique(codes[found[0] == pieces.n])
        rows = np.array([np.prod(self.p[pieces.byte_row[[*chr(c).encode("utf-8", "replace")]]], 0) for c in spelled]).reshape(len(spelled), len(self.langs))
        if len(spelled):
            gaps = found[0] == pieces.n
            found[0][gaps] = pieces.n + 1 + np.searchsorted(spelled, codes[gaps])
        table = np.concatenate([self.p, np.zeros((1, len(self.langs))), rows])
        return found, table, [chr(c) for c in spelled]

    def _forward(self, found: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        n, size = found[0].shape
        alpha = np.zeros((size + 1, n, len(self.langs)))
        alpha[0] = 1
        for j in range(1, size + 1):
            for k in range(1, min(j, len(found)) + 1):
                alpha[j] += alpha[j - k] * (table[found[k - 1][:, j - k]] * self.RAISE**k)
        return alpha

    def _same_size(self, words: list[str]) -> np.ndarray:
        found, table, _ = self._edges(words)
        p = self._forward(found, table)[-1]
        out = np.log(np.maximum(p, TINY)) - len(words[0]) * math.log(self.RAISE)
        for k in np.flatnonzero((p <= TINY).any(1)).tolist():
            out[k] = self._long(words[k])
        return out

    def _long(self, word: str) -> np.ndarray:
        """One word in logarithms: only the last few forward sums are kept, and only pieces that occur are looked at."""
        reach = self.pieces.longest
        kept_sums = [np.zeros(len(self.langs))]
        for at in range(0, len(word), 1 << 15):  # stretches that end at this many characters more, with their beginnings' reach
            begin = max(0, at - reach)
            found, table, _ = self._edges([word[begin : at + (1 << 15)]])
            with np.errstate(divide="ignore"):
                logs = np.log(table)
            none = self.pieces.n
            into: list[list[tuple[int, int]]] = [[] for _ in range(found[0].shape[1] + 1)]
            for k, f in enumerate(found, 1):
                for place in np.flatnonzero(f[0] != none).tolist():
                    into[place + k].append((k, int(f[0, place])))
            for j in range(at - begin + 1, len(into)):
                now = np.logaddexp.reduce([kept_sums[-k] + logs[row] for k, row in into[j]], axis=0)
                kept_sums.append(now)
            kept_sums = kept_sums[-reach:]
        return kept_sums[-1]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log P(word | language), a row per word; the word's start counts as a character."""
        out = np.zeros((len(words), len(self.langs)))
        by_size: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_size.setdefault(len(word), []).append(k)
        for size, rows in by_size.items():
            if size > SIDE_BY_SIDE:
                for k in rows:
                    out[k] = self._long("▁" + words[k])
                continue
            for at in range(0, len(rows), self.batch):
                part = rows[at : at + self.batch]
                out[part] = self._same_size(["▁" + words[k] for k in part])
        return out

    def _learn(self, known: Known, missing: set[str]) -> None:
        core = {w: bare(w) for w in missing}
        said = [*{b for b in core.values() if b}]
        rows = dict(zip(said, known.add(self.word_scores(said)), strict=True)) | {"": 0}
        known.row.update({w: rows[b] for w, b in core.items()})

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """log P(text | language) by row, and the number of words with a letter."""
        known: Known = kept(("languages", self.name), lambda: Known(len(self.langs)))
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def add() -> None:
            missing = set().union(*(w for _, w in held)) - known.row.keys()
            if known.used + len(missing) > known.room:
                known.start()
                missing = set().union(*(w for _, w in held))
            if missing:
                self._learn(known, missing)
            row = np.fromiter(map(known.row.__getitem__, chain.from_iterable(w for _, w in held)), np.int64, size)
            of = np.repeat([k for k, _ in held], [len(w) for _, w in held])
            begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            total[of[begins]] += np.add.reduceat(known.scores[row], begins)
            n[of[begins]] += np.add.reduceat((row > 0).astype(np.int64), begins)
            held.clear()

        for k, text in enumerate(texts):
            words = words_of(text)
            for at in range(0, len(words), TOGETHER):
                held.append((k, words[at : at + TOGETHER]))
                size += len(held[-1][1])
                if size >= TOGETHER:
                    add()
                    size = 0
        if held:
            add()
        return total, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each whole text, and its posterior with languages equally likely before."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, n = self.sums(texts)
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1)[:, None]).sum(1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, score, 0.0).tolist()


def stretches(word: str, pieces: Pieces) -> list[str]:
    """A word with its start, or, if it is long, stretches of it that training sums over one by one."""
    whole = "▁" + word
    size = SIDE_BY_SIDE + 1 if sum(c not in pieces.characters for c in whole) <= SPELLED else SPELLED
    return [whole[k : k + size] for k in range(0, len(whole), size)]


def fit(counts: dict[str, dict[str, int]], vocabulary: str, rounds: int = ROUNDS) -> Model:
    """Learn from the words of each language and how often each occurs, long ones in stretches."""
    langs = sorted(counts)
    pieces = Pieces(vocabulary)
    uses_of: dict[str, np.ndarray] = {}
    for at, lang in enumerate(langs):
        for word, times in sorted(counts[lang].items()):
            for part in stretches(word, pieces):
                uses_of.setdefault(part, np.zeros(len(langs)))[at] += times
    words = [*uses_of]
    weight = np.array([*uses_of.values()]).reshape(len(words), len(langs))
    by_size: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        by_size.setdefault(len(word), []).append(k)
    model = Model(vocabulary, langs, np.full((pieces.n, len(langs)), 1 / pieces.n), _pieces=pieces)
    for turn in range(rounds + 1):
        uses = np.zeros((pieces.n + 1, len(langs)))
        for rows in by_size.values():
            for at in range(0, len(rows), model.batch):
                part = rows[at : at + model.batch]
                found, table, spelled = model._edges([words[k] for k in part])
                size, share = found[0].shape[1], weight[part]
                if turn == 0:  # before any probabilities: how often each piece occurs at all
                    for f in found:
                        for place in range(f.shape[1]):
                            np.add.at(uses, np.minimum(f[:, place], pieces.n), share)
                    continue
                alpha = model._forward(found, table)
                beta = np.zeros_like(alpha)
                beta[size] = 1
                for j in range(size - 1, -1, -1):
                    for k in range(1, min(size - j, len(found)) + 1):
                        beta[j] += beta[j + k] * (table[found[k - 1][:, j]] * model.RAISE**k)
                share = share / np.maximum(alpha[size], 1e-300)
                for k, f in enumerate(found, 1):
                    for j in range(size - k + 1):
                        used = alpha[j] * table[f[:, j]] * model.RAISE**k * beta[j + k] * share
                        own = f[:, j] <= pieces.n
                        np.add.at(uses, f[own, j], used[own])
                        for row, amount in zip(f[~own, j], used[~own], strict=True):
                            for b in spelled[row - pieces.n - 1].encode("utf-8", "replace"):
                                uses[pieces.byte_row[b]] += amount
        uses = uses[: pieces.n]
        model.p = (1 - FLOOR) * uses / np.maximum(uses.sum(0), 1e-300) + FLOOR / pieces.n
    return model


def train(docs: DataFrame, vocabulary: str, use: Column | None = None, per_lang: int = PER_LANG, rounds: int = ROUNDS) -> Model:
    """Fit on about ``per_lang`` documents of each language: rows where ``use`` holds, and text and lang aren't null.

    The sample is stratified by a hash of ``doc_id`` and text, so that rows without id or with one id are sampled like others, and only its words reach the driver. More than MAX_LANGS languages raise.
    """
    labelled = texts_of(docs, "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if use is None else use))
    totals = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(totals) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not totals:
        return Model(vocabulary, [], np.zeros((Pieces(vocabulary).n, 0)))
    span = 1 << 30
    share = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(min(span, int(span * per_lang / n) + 1)))])
    picked = labelled.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(span)) < share[F.col("lang")])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                for lang, text in zip(*(batch.column(c).slice(k, SLICE).to_pylist() for c in (0, 1)), strict=True):
                    seen.update((lang, b) for w in words_of(text) if (b := bare(w)))
        rows = [*seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([w[0] for w, _ in rows], pa.string()), pa.array([w[1] for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], schema=arrow_schema("lang string, word string, n long"))

    words = picked.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in totals}
    for r in words.collect():
        counts[r.lang][r.word] = r.n
    return fit(counts, vocabulary, rounds)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, and ``lang_pred, score`` of each row's whole text, in the input's partitions.

    The score is the posterior of the whole text: long texts are near 1, and 1 / languages is the least. Texts of any length are
    summed a bounded number of words at a time. A null text, or one without a letter, gives ``und`` and 0. Empty tables give none. Repeated rows
    each give a row. lang, source and doc_id take no part. The model that travels has one number per
    piece and language. Input columns named ``lang_pred`` or ``score`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_text(docs, lambda texts: shared.value.predict(texts), "lang_pred string, score double")
