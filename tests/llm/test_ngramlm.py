"""Elias-Fano sequences, and scores against counts in plain dictionaries."""

import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from gridloom.llm import ngramlm
from gridloom.llm.eliasfano import EliasFano
from gridloom.llm.wordhash import word_hashes


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (5, 5), (1000, 1 << 60), (1000, 1500), (5000, 100_000), (1000, (1 << 63) - 1)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n).astype(np.uint64))
    coded = EliasFano.encode(values, universe)
    assert np.array_equal(coded.get(np.arange(n)), values)
    keys = np.concatenate([values, rng.integers(0, universe, 300).astype(np.uint64)])
    at, same = coded.successor(keys)
    assert np.array_equal(at, np.searchsorted(values, keys)) and np.array_equal(same, np.isin(keys, values))


DOCS = [(k, " ".join(f"w{(k * j * j + j) % 23}" for j in range(k % 40))) for k in range(120)] + [(200, None), (201, ""), (202, "unseen Words w1 w2"), (203, "the THE the " * 200), (203, "the"), (204, "é\xa0è ÉÈ")]


def plain(docs, trained):
    counts = [Counter(), Counter(), Counter()]
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    for _, text in trained:
        w = words(text)
        for k in range(3):
            counts[k].update(zip(*(w[j:] for j in range(k + 1)), strict=False))
    n, v = sum(counts[0].values()), len(counts[0])
    for doc_id, text in docs:
        w, base, score, known = words(text), 0.0, 0.0, 0
        for j, x in enumerate(w):
            p = (counts[0][(x,)] + 0.5) / (n + 0.5 * (v + 1))
            base, known = base + math.log10(p), known + (counts[0][(x,)] > 0)
            for k in (1, 2):
                h = tuple(w[j - k : j])
                if j < k or not counts[k - 1][h]:
                    break
                m = ngramlm.shares(k)[0] + ngramlm.shares(k)[1] * counts[k - 1][h]
                p = (counts[k][(*h, x)] + m * p) / (counts[k - 1][h] + m)
            score += math.log10(p)
        yield doc_id, len(w), known, n, base, score


@pytest.mark.parametrize("shard", [50, 100_000])
def test_scores(spark, shard):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    trained = [d for d in DOCS if d[0] % 5]
    model = ngramlm.train(docs, F.col("doc_id") % 5 != 0, shard=shard)
    found = sorted(tuple(r) for r in ngramlm.score(docs, model).collect())
    expected = sorted(plain(DOCS, trained))
    assert [f[:4] for f in found] == [e[:4] for e in expected]
    for f, e in zip(found, expected, strict=True):
        assert abs(f[4] - e[4]) < 1e-6 and abs(f[5] - e[5]) < 5e-4 * e[1]


def test_children_by_pointers(spark):
    docs = spark.createDataFrame([(1, "a b a c a b d")], "doc_id long, text string")
    model = ngramlm.train(docs)
    reader = ngramlm.Reader(model)
    ids, counts = reader.look_up(word_hashes(["a b c d x"])[0])
    assert counts.tolist() == [3, 2, 1, 1, 0] and ids[4] == -1
    assert sorted(reader.children(2, int(ids[0]))) == sorted(ids[1:3].tolist())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = ngramlm.score(docs, ngramlm.train(docs, F.lit(False))).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score == row.base_score == 0.0
    assert ngramlm.score(docs.limit(0), ngramlm.train(docs.limit(0))).count() == 0


@pytest.mark.parametrize("mounted", [True, False])
def test_few_shards_are_held(spark, monkeypatch, mounted):
    model = ngramlm.train(spark.createDataFrame(DOCS, "doc_id long, text string"), shard=50)
    texts = [text for _, text in DOCS]
    whole, few = ngramlm.Reader(model), ngramlm.Reader(model)
    expected = [x.tolist() for x in whole.of_texts(texts)]
    if mounted:
        monkeypatch.setattr(ngramlm, "OPEN", 2)
    else:  # a store that Python can't map: files are read into memory, of which there is little
        monkeypatch.setattr(ngramlm, "fs", SimpleNamespace(FileSystem=fs.FileSystem, LocalFileSystem=()))
        monkeypatch.setattr(ngramlm, "HELD", 1)
    assert [x.tolist() for x in few.of_texts(texts)] == expected
    for level, cut in enumerate(model.levels, 2):
        children = [few.shard(level, k)[2].n for k in range(cut.shards) if cut.first[k] < cut.first[k + 1]]
        assert sum(children) == cut.nodes and len(few._shards) <= 2 and few._taken >= 0
    assert (few._taken == 0) == mounted
