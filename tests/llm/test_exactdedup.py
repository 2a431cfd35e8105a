"""Exact duplicates against a plain grouping, on hostile rows, with frequent texts and tries that give subtrees back."""

import hashlib
import random
import re

import pytest

from gridloom.llm import exactdedup

SCHEMA = "doc_id long, text string, keep_id string, content int, block string"


def expected(rows):
    groups = {}
    for place, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, place, doc_id))
    out = []
    for said, members in groups.items():
        keep = min(members)
        out += [(m[4], keep[4], len(members), hashlib.sha256(said.encode()).hexdigest()) for m in members]
    return sorted(out, key=str), len(groups)


def hostile():
    rng = random.Random(11)
    rows = [(None, None), (None, "a b"), (7, ""), (7, " \n\t"), (7, "ab"), (7, "ab"), (3, "a\x0bb "), (4, "　ab"), (5, "\x1cab"), (6, "ab\x00"), (8, "🎉 é"), (9, "🎉é ")]
    rows += [(rng.randint(0, 400), "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 6)))) for _ in range(300)]
    rows += [(1000 + k, "hot text " * 3 + " " * (k % 5)) for k in range(200)]
    rows += [(2000 + k, "long " * 50_000 + str(k % 4)) for k in range(9)]
    return rows


@pytest.mark.parametrize("options", [{}, {"block_rows": 7, "frequent": 2}, {"block_rows": 5, "trie_bytes": 3000, "frequent": 3}, {"block_bytes": 10, "trie_bytes": 1, "part_bytes": 2000}])
def test_same_as_a_plain_grouping(spark, options):
    rows = hostile()
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)
    out = exactdedup.dedup(docs, **options).collect()
    want, groups = expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == want
    assert sum(r.kept for r in out) == groups == len({r.text_sha256 for r in out if r.kept})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_empty_table(spark):
    assert exactdedup.dedup(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_trie_keeps_and_gives_back():
    rng = random.Random(5)
    keys = {bytes(rng.choices(b"ab", k=rng.randint(0, 40))) for _ in range(2000)} | {b"", b"a" * 500, b"a" * 501}
    trie = exactdedup.Trie()
    for key in [*keys, *keys]:
        trie.insert(key).held.append(key)
    assert dict((k, e.held) for k, e in trie.below(trie.root, b"")) == {k: [k, k] for k in keys}
    gone = dict(trie.give_back(trie.size // 2))
    left = {k for k, _ in trie.below(trie.root, b"")}
    assert gone and left and left | set(gone) == keys and not left & set(gone)
    for key in keys:
        assert (trie.insert(key) is None) == (key in gone)
    while list(trie.give_back(1)):
        pass
    assert len(list(trie.below(trie.root, b""))) >= 1
