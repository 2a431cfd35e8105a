"""Hashes of words are a function of the word alone, wherever it stands."""

import random

from gridloom.llm import wordhash
from gridloom.llm.wordhash import LONG, lowered, word_hashes


def test_words_wherever_they_stand(monkeypatch):
    rng = random.Random(4)
    words = ["a", "B", "b", "é", "É", "the", "x" * 200, "x" * 201, "y" * LONG, "y" * (LONG + 1), "z" * (3 * LONG), "q\xa0r", "\x1cs", "\ud800", "0"]
    texts = [None, "", " \t\n\x0b\x0c\r", "a"] + ["".join(rng.choice([" ", "\n", "  ", "\t"]) + rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts.append(" ".join(rng.choice(words) for _ in range(3000)))
    seen: dict[bytes, int] = {}
    for buffer in (wordhash.BUFFER, 5000, 64):
        monkeypatch.setattr(wordhash, "BUFFER", buffer)
        hashes, counts = word_hashes(texts)
        split = [lowered(t).split() for t in texts]
        assert counts.tolist() == [*map(len, split)]
        for word, h in zip([w for ws in split for w in ws], hashes.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen) == len({w.encode("utf-8", "surrogatepass").lower() for w in words})
    assert len(word_hashes([])[0]) == 0


def test_hashes_differ():
    words = [f"w{k}" for k in range(200_000)] + [f"{k}w" for k in range(200_000)]
    hashes, _ = word_hashes([" ".join(words)])
    assert len(set(hashes.tolist())) == len(words)
