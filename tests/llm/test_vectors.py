"""Links and groups of vectors, and exact top-k, against brute force and SQL."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import registry, vectors

SF = "/root/testdata/sf0.001"


def vectors_table(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for family in range(8):
        base = rng.standard_normal(16)
        for _ in range(12):
            v = base + rng.standard_normal(16) * (0.03 if family % 2 else 0.12)
            rows.append((n, [float(x) for x in v.astype(np.float32)], family % 3))
            n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 1), (n + 2, rows[0][1], None), (n + 3, None, 0), (n + 4, [0.0] * 16, 0), (n + 5, [math.nan] + [1.0] * 15, 0), (n + 6, [None] + [1.0] * 15, 0), (n + 7, [math.inf] + [1.0] * 15, 0), (n + 8, [1.0], 0), (n + 9, [], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 5)
    rows, table = vectors_table(spark)
    able = {i: (np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _, _ in rows}
    for a, (v, lab) in able.items():
        for b, (w, other) in able.items():
            if a != b and lab == other and len(v) == len(w) and v @ w >= 0.98 * math.sqrt(v @ v) * math.sqrt(w @ w):
                links[a].add(b)
    group = {}
    for i in sorted(links):
        if i not in group:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = i
                    todo += links[x]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(table).collect()}
    assert sum(len(s) for s in links.values()) > 100
    assert found == {i: (len(s), group[i], group[i] == i) for i, s in links.items()}
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_top_k(spark):
    rows, table = vectors_table(spark)
    whole = {i: np.array([math.floor(256 * x) for x in v] + [0] * (16 - len(v)), np.int64) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = vectors.top_k(table, F.col("vec_id") % 10 == 0, k=4, pack_rows=20, chunk_rows=3).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = {}
    for q in whole:
        if q % 10 == 0:
            best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:4]
            expected[q] = [(i, -s) for s, i in best]
    assert found == expected
    few = vectors.top_k(table.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert {(r.rank, r.vec_id) for r in few} <= {(1, 1), (2, 2), (1, 2), (2, 1)} and len(few) == 2
    assert vectors.top_k(table.limit(0), F.lit(True)).count() == 0


def test_top_k_broadcasts_numbers_only(spark):
    """What a broadcast holds passes the driver; vectors of every meeting of a chunk with a lane are the square of the table."""
    rows = [(i, [float((i // 3 * k) % 7 - 3) / 8 for k in range(6)]) for i in range(90)]  # three of each, so that ties cross lanes
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out = vectors.top_k(table, F.col("vec_id") % 4 == 0, k=5, pack_rows=7, chunk_rows=5)
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    whole = {i: np.array([math.floor(256 * x) for x in v]) for i, v in rows}
    assert found == {q: sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5] for q in whole if q % 4 == 0}
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines()
    broadcast = [plan[k + 1] for k, line in enumerate(plan) if ") BroadcastExchange" in line]
    assert broadcast
    assert not [line for line in broadcast if "raw" in line or "asked" in line]


def test_products_are_exact_at_the_end_of_floats():
    for most in (2047, 2048, 4095, 1 << 20, 1 << 33):
        a = np.array([[most, most - 1, 1], [-most, 1, 0], [1, 0, 0]])
        asked, values = vectors.light(a, a)
        assert vectors.products(asked, values).astype(object).tolist() == (a.astype(object) @ a.astype(object).T).clip(-(1 << 63) + 1, (1 << 63) - 1).tolist()
        assert (asked.dtype == np.float32) == (most < 4095 and 2 * most * most < 2**24)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    centres = rng.integers(-100, 100, (8, 12))
    values = centres[rng.integers(0, 8, 800)] + rng.integers(-5, 5, (800, 12))
    pack, queries = vectors.Pack(np.arange(800), values, 32), values[:20]
    bounds = pack.bounds(queries)
    for b, (i, j) in enumerate(zip(pack.begins, pack.ends, strict=True)):
        assert (bounds[:, b] >= (queries @ pack.values[i:j].T).max(1)).all()
    best = vectors.Best(np.full(20, -1), 5)
    assert vectors.search(pack, queries, best) < 20 * len(pack.begins) / 2


def test_queries_give_the_rows_of_their_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    for name, sql in registry.oracle_sql().items():
        registry.queries()[name](spark, SF).write.parquet(f"{tmp_path}/{name}")
        con.sql(f"CREATE OR REPLACE TABLE a AS {sql}")
        q = ", ".join(r[0] for r in con.sql("DESCRIBE a").fetchall())
        assert con.sql(f"(SELECT {q} FROM a EXCEPT ALL SELECT {q} FROM '{tmp_path}/{name}/*.parquet') UNION ALL (SELECT {q} FROM '{tmp_path}/{name}/*.parquet' EXCEPT ALL SELECT {q} FROM a)").fetchall() == []
