"""Candidates by pigeonhole, sketches, components and the join against brute force."""

import random

import numpy as np
import pytest

from gridloom.llm import setjoin
from gridloom.llm.components import components, extended
from gridloom.llm.setjoin import Signatures, Threshold, allocate, limits


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("t", [Threshold(85, 100), Threshold(80, 100), Threshold(60, 100)])
@pytest.mark.parametrize("sets", [10, 100_000])
def test_similar_sets_share_a_signature(t, sets):
    rng = np.random.default_rng(5)
    maker = Signatures([allocate(a, b, sets, t) for a, b in limits(t, 600)], t)
    tried = 0
    for _ in range(400):
        n = int(rng.integers(1, 40)) if rng.random() < 0.6 else int(rng.integers(1, 500))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = a[rng.permutation(len(a))[int(rng.integers(0, int(n * (1 - t.part / t.whole)) + 1)) :]]
        more = 0
        while t.holds(len(b), len(a), len(b) + more + 1) and rng.random() < 0.97:
            more += 1
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 62, more).astype(np.uint64)]))
        if not len(b) or np.array_equal(a, b) or not t.holds(len(np.intersect1d(a, b)), len(a), len(b)):
            continue
        tried += 1
        given = [{} for _ in range(2)]
        for side, x in zip(given, (a, b), strict=True):
            for band, role in maker.roles(len(x)):
                for s in maker.of(x, band, role).tolist():
                    side.setdefault(s >> 2, set()).add(s & 3)
        assert any(f & g == 0 for k, fs in given[0].items() for f in fs for g in given[1].get(k, ()))
        assert setjoin._may_link(t, setjoin.sketch(a), setjoin.sketch(b))
    assert tried > 100


@pytest.mark.parametrize("nearest", [False, True])
def test_tiles_against_all_pairs(nearest):
    rng = np.random.default_rng(7)
    t = Threshold(80, 100)
    sets = []
    for size in [1, 3, 10, 40, 300, 1400, 1499, 1501, 1600, 2990, 3100, 9000]:
        base = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        sets += [base, np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))]
        for share in (0.02, 0.1, 0.18):
            sets.append(np.unique(np.r_[base[: len(base) - int(len(base) * share)], rng.integers(0, 1 << 63, int(size * 0.01)).astype(np.uint64)]))
    rows = [(k, 5 if k % 7 == 0 else 100 + k, setjoin.sketch(x)) for k, x in enumerate(sets)]
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if rows[i][1] != rows[j][1] and t.holds(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert len(linked) > 30 and all(setjoin._may_link(t, rows[i][2], rows[j][2]) for i, j in linked)
    halves = [setjoin.pack_members(rows[a::2]) for a in (0, 1)]
    found = set()
    for r, c in ((halves[0], None), (halves[1], None), (halves[0], halves[1])):
        found |= {(max(p), min(p)) for p in zip(*(x.tolist() for x in setjoin.tile_pairs(r, c, t, nearest)), strict=True)}
    if nearest:
        assert {k for p in found for k in p} >= {k for p in linked for k in p} and len(found) <= 4 * len(sets)
    else:
        assert found >= linked and len(found) <= len(linked) + 3  # sketches of unlike sets differ, large ones too
        assert found == {(i, j) for i in range(len(sets)) for j in range(i) if rows[i][1] != rows[j][1] and setjoin._may_link(t, rows[i][2], rows[j][2])}


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    sigs, sids = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64)), rng.integers(-5, 5, 500)
    a, b = setjoin.unpack_block(setjoin.pack_block(sigs, sids))
    assert np.array_equal(a, sigs) and np.array_equal(b, sids)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(40)] + [(5, 5)]
    nodes = {x for p in links for x in p}
    expected = {n: r for n, r in roots(links, nodes).items() if n != r}
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_more_links_extend_components(spark):
    rng = np.random.default_rng(5)
    chain = [(k, k + 1) for k in range(100, 160)]
    first = [*zip(rng.integers(0, 90, 40).tolist(), rng.integers(0, 90, 40).tolist(), strict=True), *chain[::2]]
    more = [*zip(rng.integers(0, 90, 30).tolist(), rng.integers(0, 90, 30).tolist(), strict=True), *chain[1::2], (7, 7), (300, 5)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    told = lambda labels: sorted((r.node, r.component) for r in labels.collect())
    labels = components(table(first))
    assert told(extended(labels, table(more))) == told(components(table(first + more)))
    assert told(extended(labels, table([]))) == told(labels)
    assert told(extended(components(table([])), table(more))) == told(components(table(more)))


def corpus():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    docs, n = [], 0
    passage = [rng.choice(words) for _ in range(30)]
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 20, 60, 200]))]
        if family % 3 == 0:
            base = base[:10] + passage + base[10:]
        for _ in range(rng.choice([1, 2, 5, 14])):
            copy = [w if rng.random() > 0.02 else rng.choice(words) for w in base]
            docs.append((n, " ".join(copy)))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, "one two three"), (n + 6, docs[0][1]), (n + 6, docs[0][1])]
    return docs


def test_join_against_brute_force(spark):
    docs = corpus()
    sets = {}
    for i, text in docs:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = roots(pairs, sets)
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as component_id").repartition(3)
    rows = setjoin.join(table).collect()
    assert len(rows) == len(docs)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(i, len(s), expected[i]) for i, s in sets.items()}


def test_one_large_family_at_the_contract_of_the_query(spark, monkeypatch):
    """Thousands of sets, most in one family whose members no pivot holds together, with small tiles and segments left out, against brute force."""
    monkeypatch.setattr(setjoin, "TILE", 64)
    monkeypatch.setattr(setjoin, "allocate", lambda low, high, sets, t: doubled(low, high, sets, t) if low % 3 else allocate(low, high, sets, t))
    rng = random.Random(21)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    docs = []
    for _ in range(1500):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        docs.append(" ".join(copy[rng.randint(0, 3) :]))
    for _ in range(150):
        other = [rng.choice(words) for _ in range(rng.choice([3, 12, 40, 90]))]
        docs += [" ".join(other), " ".join(other[rng.randint(0, 2) :] + [rng.choice(words)])]
    rng.shuffle(docs)
    sets = {}
    for i, text in enumerate(docs):
        own = text.split()
        sets[i] = {tuple(own[k : k + 4]) for k in range(len(own) - 3)} or {tuple(own)}
    holding = {}
    for i, x in sets.items():
        for e in x:
            holding.setdefault(e, []).append(i)
    pairs = []
    for i, x in sets.items():
        shared = {}
        for e in x:
            for j in holding[e]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        pairs += [(j, i) for j, n in shared.items() if 100 * n >= 85 * (len(x) + len(sets[j]) - n)]
    table = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string").repartition(5)
    rows = setjoin.join(table, n=4, part=85, whole=100).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(i, len(sets[i]), c) for i, c in roots(pairs, sets).items()}


def test_empty_table(spark):
    assert setjoin.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def with_decoys(name, rng):
    """Texts of Q, R = Q and one word more in each double segment, and for each segment a lesser smaller-side set that has Q's content of it."""
    t = Threshold(80, 100)
    at, band = next((k, doubled(*b, 1, t)) for k, b in enumerate(limits(t, 100)) if b[0] <= 21 <= b[1])
    assert band.low > 17 >= band.smallest and band.double == 4 and not band.single
    seed = np.uint64((at + 1) * int(setjoin.MULTIPLIER) & (1 << 64) - 1)
    by_segment = [[] for _ in range(4)]
    for k in range(400):
        word = f"{name}{k}"
        place = int((setjoin.mix(setjoin.shingle_set(word, 1) ^ seed) % np.uint64(8))[0])
        by_segment[place >> 1].append(word)
    q = [by_segment[k][: 4 + (k == 0)] for k in range(4)]
    texts = [" ".join(sum(q, [])), " ".join(sum(q, []) + [words[5] for words in by_segment])]
    own, _ = setjoin.identity(setjoin.shingle_set(texts[0], 1), 0)
    for k in range(4):
        others = [w for j in range(4) if j != k for w in by_segment[j][6:]]
        tries = (" ".join(q[k] + rng.sample(others, 12)) for _ in range(3000))
        decoy = next((x for x in tries if setjoin.identity(setjoin.shingle_set(x, 1), 0)[0] < own), None)
        if decoy is None:
            return None
        texts.append(decoy)
    return texts


def doubled(low, high, sets, t):
    band = allocate(low, high, sets, t)
    need = band.single + 2 * band.double
    return setjoin.Band(low, high, band.smallest, need % 2, need // 2)


def test_smaller_sides_behind_a_pivot(spark, monkeypatch):
    rng = random.Random(8)
    docs = [x for k in range(5) for x in with_decoys(f"v{k}x", rng) or []]
    assert docs
    words = [f"u{k}" for k in range(60)]
    for _ in range(25):
        base = rng.sample(words, rng.randint(10, 30))
        docs += [" ".join(base), " ".join(base[rng.randint(0, 3) :] + [rng.choice(words)])]
    sets = {i: set(x.split()) for i, x in enumerate(docs)}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    monkeypatch.setattr(setjoin, "allocate", doubled)
    rows = setjoin.join(spark.createDataFrame([*enumerate(docs)], "doc_id long, text string"), n=1).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {*roots(pairs, sets).items()}
