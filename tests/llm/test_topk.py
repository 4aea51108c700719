import random

import duckdb
import numpy as np

from sessionlens.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, score int"


def brute(rows, ids, k):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in {i: v for i, v in good if i in ids}.items():
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good if i != q and len(y) == len(x))[:k]
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)}
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(1, 450)]
    rows += [(1000 + k, rows[3][1]) for k in range(90)]  # ties
    rows += [(2000, None), (2001, []), (2002, [1.0, None] * 4), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (None, [1.0] * 8), (2050, [1.0, 2.0]), (2100, [3.0, 4.0]), (2150, [0.0] * 8)]
    vectors = spark.createDataFrame([(i, v, 0, 7) for i, v in rows], SCHEMA)
    got = {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()}
    assert got == brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)


def test_bounds_prune():
    rng = np.random.default_rng(0)
    centres = rng.integers(-400, 400, (20, 16))
    x = (centres[rng.integers(0, 20, 4000)] + rng.integers(-5, 6, (4000, 16))).astype(np.int64)
    s = topk.Search(x, np.arange(4000), x[:40], np.arange(40), np.full(40, topk.LOWEST), 5).run()
    want = x[:40] @ x.T
    want[np.arange(40), np.arange(40)] = topk.LOWEST
    assert (np.sort(want, 1)[:, ::-1][:, :5] == s.scores).all() and s.entered < 40 * 60


def test_large_numbers_stay_exact():
    x = np.array([[2**31, 2**30 + 1], [2**31 - 1, 3], [-(2**31), 7]], np.int64)
    s = topk.Search(x, np.arange(3), x, np.arange(3), np.full(3, topk.LOWEST), 1).run()
    assert s.scores[0, 0] == int(x[0] @ x[1])


def test_empty(spark):
    vectors = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(vectors, vectors, 5).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert {tuple(r) for r in topk.op1_topk(spark, sf).collect()} == set(duckdb.sql(topk.ORACLE).fetchall())


def test_repeated_ids(spark):
    """The smallest vector of an id asks; all rows of another id are found."""
    rows = [(50, [2.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [3.0, 0.0]), (7, [3.0, 0.0]), (7, [1.0, 5.0]), (8, [2.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, 0, 7) for i, v in rows], SCHEMA)
    got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 3).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(50, 1, 7, 3 * 65536), (50, 2, 7, 3 * 65536), (50, 3, 8, 2 * 65536)]

