import numpy as np
import pytest

from sessionlens.llm import lattice

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep int, n_links string, h1 int"
SURE = 1 - 1e-9


def near(x, cosine, rng):
    z = rng.normal(size=len(x))
    z -= z @ x / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def brute(rows, cosine=0.9):
    vectors = {}
    for i, v in rows:
        if i is not None:
            vectors.setdefault(i, []).append(v)
    good, parent = {}, {i: i for i in vectors}
    for i, listed in vectors.items():
        v = min((v for v in listed if v is not None), default=None)
        if v and all(c is not None and np.isfinite(np.float32(c)) for c in v) and any(np.float32(c) for c in v):
            good[i] = np.array(v, np.float32).astype(float)
    links = dict.fromkeys(vectors, 0)

    def find(i):
        return i if parent[i] == i else find(parent[i])

    ids = sorted(good)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = good[i], good[j]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {(i, links[i], find(i), find(i) == i) for i in vectors}


def some_rows(seed):
    """Loners, pairs at many cosines, chains, a group of near copies, equal rows."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=16) for _ in range(150)]
    out += [near(out[k], c, rng) for k, c in enumerate(np.linspace(0.85, 0.999, 60))]
    for _ in range(25):
        out.append(near(out[-1], 0.93, rng))
    centre = rng.normal(size=16)
    out += [near(centre, c, rng) for c in rng.uniform(0.96, 0.999, 120)] + [near(centre, 0.93, rng) for _ in range(10)]
    out += [out[3]] * 40 + [2 * out[4]] * 3
    return [(int(k), [float(np.float32(c)) for c in v]) for k, v in zip(rng.permutation(len(out)) * 3, out, strict=True)]


ODD = [(5000, None), (5001, []), (5002, [1.0, None]), (5003, [float("nan"), 1.0]), (5004, [float("inf"), 1.0]), (5005, [0.0] * 16), (None, [1.0] * 16), (5006, [3.0]), (5007, [2.0]), (5008, [-2.0]), (5009, [1.0, 2.0]), (5010, [1e-30, 2e-30]), (5011, [3e30, 6e30]), (5012, [5.0, 1.0]), (5012, [1.0, 2.5]), (5013, [1.0, 2.5]), (5013, [1.0, 2.5])]


@pytest.mark.parametrize("group", [2048, 12])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(lattice, "GROUP", group)
    rows = some_rows(group) + ODD
    got = [tuple(r) for r in lattice.embedding_dedup(spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], SCHEMA), recall=SURE).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_large_cells_have_balls(spark, monkeypatch):
    monkeypatch.setattr(lattice, "GROUP", 12)
    seen = []
    whole = lattice._centres
    monkeypatch.setattr(lattice, "_centres", lambda *a: seen.append(whole(*a)) or seen[-1])
    rows = some_rows(1)
    got = lattice.embedding_dedup(spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], SCHEMA), recall=SURE)
    assert {tuple(r) for r in got.collect()} == brute(rows) and seen[0]


def test_recall_at_the_threshold(spark):
    """Planted pairs just at the threshold, with the operator's own recall."""
    rng = np.random.default_rng(3)
    first = rng.normal(size=(1500, 64))
    rows = [(2 * k + j, v.tolist()) for k, x in enumerate(first) for j, v in enumerate((x, near(x, 0.9005, rng)))]
    got = lattice.embedding_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert got.where("n_links = 1 and component_id = vec_id - vec_id % 2").count() >= 0.98 * len(rows) and got.where("n_links > 1").count() == 0


def test_nearest_points():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(300, 8)) * 2
    z = lattice.nearest(y)
    halves = 2 * z
    assert (halves == np.rint(halves)).all() and (z.sum(1) % 2 == 0).all() and (np.ptp(halves % 2, axis=1) == 0).all()
    away = ((y - z) ** 2).sum(1)
    assert away.max() <= 1 + 1e-9  # the covering radius is 1
    assert all((((y - (z + r)) ** 2).sum(1) >= away - 1e-9).all() for r in lattice.ROOTS)
    assert len({tuple(r) for r in lattice.ROOTS}) == 240 and np.allclose((lattice.ROOTS**2).sum(1), 2)


def test_finer_cells_for_more_vectors():
    small, large = lattice.hashing_for(1000), lattice.hashing_for(10**9)
    assert (small.blocks, small.scale) < (large.blocks, large.scale) and small.tables < large.tables


def test_forest():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 300, (2, 200))
    u, v = lattice.forest(a, b)
    find, union = lattice.common.union_find(300)
    for i, j in zip(a, b, strict=True):
        union(int(i), int(j))
    assert all(find(int(i)) == j for i, j in zip(u, v, strict=True)) and len(u) == len({*a, *b}) - len({find(int(k)) for k in {*a, *b}})


def test_empty(spark):
    assert lattice.embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
