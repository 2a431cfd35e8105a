"""Pfair schedules: deviation below one block, every block once, every row once."""

import random
import time
from bisect import bisect_left
from fractions import Fraction

import pytest

from gridloom.llm import mixing


def test_slots_without_gaps():
    rng = random.Random(2)
    for _ in range(60):
        blocks = [rng.randint(0, 900) for _ in range(rng.randint(1, 9))]
        spans = mixing.schedule(blocks, [rng.random() + 0.01 for _ in blocks], 200)
        slots = [s.start + x // s.share * s.period + s.offsets[x % s.share] for s in spans for x in range(s.blocks)]
        assert sorted(slots) == [*range(sum(blocks))]


def test_rows(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 4}") for k in range(900)] + [(1, "hot"), (1, "hot"), (None, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "'x' as block")
    out = mixing.mix(docs, {"hot": 1, "s0": 2}, block=8, period=50).collect()
    assert len(out) == len(rows) == len({r.position for r in out})
    assert sorted((r.doc_id or -1, r.source or "") for r in out) == sorted((i or -1, s or "") for i, s in rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    kept = mixing.mix(docs, block=8, keep=True)
    assert kept.count() == len(rows) and set(docs.columns) <= set(kept.columns)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"hot": 0})


def test_weights_hold_while_sources_last(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'a' else 'b' end as source")
    out = mixing.mix(docs, {"a": 3, "b": 1}, block=10, period=40)
    first = out.filter("slot < 200").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in first} == {"a": 1500, "b": 500}


def fluid(blocks, weights):
    """The exact share of each source at a moment, as a function: the given weights, in proportion among those that last."""
    order = sorted((k for k, n in enumerate(blocks) if n), key=lambda k: blocks[k] / weights[k])
    gone, rate, ends = 0, sum(weights[k] for k in order), []
    lines = []
    for k in order:
        lines.append((gone, rate))
        ends.append(gone + rate * (blocks[k] / weights[k]))
        gone, rate = gone + blocks[k], rate - weights[k]

    def at(k, t):
        g, r = lines[bisect_left(ends, t)]
        return min(blocks[k], weights[k] * (t - g) / r)

    return at


def deviation(blocks, weights):
    """The largest at any moment: it grows linearly between a source's blocks, so their slots tell."""
    weights = [Fraction(w) for w in weights]
    share, worst, slots = fluid(blocks, weights), 0, []
    own = {}
    for s in mixing.schedule(blocks, weights):
        own.setdefault(s.source, []).extend(s.start + x // s.share * s.period + s.offsets[x % s.share] for x in range(s.blocks))
    for k, at in own.items():
        assert at == sorted(at) and len(at) == blocks[k]
        slots += at
        for j, slot in enumerate(at):
            worst = max(worst, abs(j - share(k, slot)), abs(j + 1 - share(k, slot + 1)))
    assert sorted(slots) == [*range(sum(blocks))]
    return worst


def test_deviation_from_the_given_weights():
    assert deviation([10_000, 20_000], [Fraction(1, 3), Fraction(2, 3)]) < 1
    assert deviation([10_003, 19_000], [1 / 3, 2 / 3]) < 1
    assert deviation([29_994, 3, 3], [9998, 1, 1]) < 1
    hot = [31_250] + [63] * 999
    assert deviation(hot, [n**0.5 for n in [1_000_000] + [2000] * 999]) < 1
    rng = random.Random(4)
    assert deviation([rng.randint(0, 9) for _ in range(2500)], [rng.random() + 0.001 for _ in range(2500)]) < 1
    for _ in range(60):
        n = rng.randint(1, 40)
        assert deviation([rng.randint(0, 60) for _ in range(n)], [rng.random() ** 4 + 1e-6 for _ in range(n)]) < 1


def test_more_sources_than_a_period(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('s', id % 1500) as source")
    out = mixing.mix(docs, block=1).collect()
    assert sorted(r.position for r in out) == [*range(6000)]
    assert len({r.source for r in out if r.position < 1500}) == 1500


def test_many_sources_take_little_time():
    rng = random.Random(5)
    blocks = [rng.randint(1, 12) for _ in range(20_000)]
    begun = time.perf_counter()
    slots = mixing.dealt(blocks, [rng.random() + 0.01 for _ in blocks])
    assert time.perf_counter() - begun < 20
    assert [len(own) for own in slots] == blocks and sorted(x for own in slots for x in own) == [*range(sum(blocks))]
