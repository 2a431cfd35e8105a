"""Runs against a search of all stretches, the digests of rows, and texts that were made periodic."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gridloom.llm import periodic


def brute(words, least):
    """All runs by extending every stretch of every period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > start and end + q - start >= max(least, 2 * q):
                found.setdefault((start, end + q - start), q)
            start = end + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [9, 12])
def test_same_runs_as_a_search_of_all(least, monkeypatch):
    rng = random.Random(13)
    for trial in range(1500):
        n, kinds = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5, 40])
        words = [rng.randrange(kinds) for _ in range(n)]
        if trial % 3 == 0 and n:
            a, p = rng.randrange(n), rng.randint(1, 12)
            words = [words[a + (k - a) % p] if k >= a and a + p <= n else w for k, w in enumerate(words)]
        monkeypatch.setattr(periodic, "PLACES", rng.choice([1, 10, 1 << 20]))
        assert [tuple(r) for r in periodic.runs(np.array(words, np.int64), least).tolist()] == brute(words, least), words


def test_long_text_of_one_word():
    assert periodic.runs(np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]


def row(doc_id, text, plant):
    words = [w for w in (text or "").encode().replace(b"\x0b", b" ").split()]
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
    found = brute(words, 12)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + length for s, length, q in found)]
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    said = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *said, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


@pytest.mark.parametrize("plant", [True, False])
def test_rows_of_a_table(spark, plant, monkeypatch):
    rng = random.Random(31)
    rows = [(None, None), (None, "a " * 30), (1, ""), (1, " \n\t\x0b\x0c"), (1, "a"), (2, "É é é " * 12), (2, "\x1c x\xa0y " * 20), (3, "no run here at all " * 2)]
    rows += [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120)))) for k in range(4, 160)]
    rows += [(k, rng.choice(["line one\nline two\n", "x y z "]) * rng.randint(1, 30) + " ".join(map(str, range(k)))) for k in range(160, 220)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, length string").repartition(3)
    out = periodic.collapsed(docs, periodic.planted if plant else None)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted((row(d, t, plant) for d, t in rows), key=str)
    monkeypatch.setattr(periodic, "JOINED", 3)
    assert periodic.collapse([r[0] for r in rows], [r[1] and r[1].encode() for r in rows], periodic.planted if plant else None, 12) == [row(d, t, plant) for d, t in rows]


def test_empty_table(spark):
    assert periodic.collapsed(spark.createDataFrame([], "doc_id int, text string")).collect() == []
