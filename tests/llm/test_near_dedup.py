import math
import random

from helpers import BIG, docs, odd_rows, text

from sessionlens.llm import common, near_dedup


def brute(rows, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {d: (len(sets[d]), label[d], label[d] == d) for d in sets}


def check(spark, rows, percent=85):
    got = near_dedup.near_dedup(docs(spark, rows), percent).collect()
    assert len(got) == len(rows)
    assert {r[0]: (r[1], r[2], r[3]) for r in got} == brute(rows, percent)


def test_equals_brute_force(spark):
    rng = random.Random(0)
    rows = []
    for d in range(120):
        words = text(rng.choice([0, 0, 0, 1000, 2000]), 150).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append((d * 3 + 1, " ".join(words)))
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, odd_rows() + [(BIG + 1, "One TWO"), (BIG + 2, "one two three four five")], 80)


def test_empty_table(spark):
    assert near_dedup.near_dedup(docs(spark, []), 85).count() == 0


def test_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    base = text(0, 300).split()
    rows = [(k, " ".join([*base[:k], f"n{k}", *base[k + 1 :]])) for k in range(1, 70)]
    check(spark, rows)


def test_least_matches():
    k = near_dedup.K
    below = lambda t, p: sum(math.comb(k, x) * p**x * (1 - p) ** (k - x) for x in range(t))
    for p in (0.8, 0.85, 0.95):
        t = near_dedup.least_matches(p)
        assert below(t, p) <= near_dedup.MISS < below(t + 1, p)
    assert near_dedup.least_matches(1.0) == k


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in common.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_long_lists_of_several_groups(spark, monkeypatch):
    # groups that share a stock part, so that long lists hold several components
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "WIDE", 16)
    stock = text(0, 80)
    rows = []
    for k in range(90):
        words = f"{stock} {text(500 * (k % 3) + 100, 40 + 10 * (k % 3))}".split()
        words[k % len(words)] = f"n{k}"
        rows.append((k + 1, " ".join(words)))
    check(spark, rows, 80)


def test_hubs_are_dealt_to_several_tasks(spark):
    edges = spark.range(3000).selectExpr("7 as a", "id + 8 as b").union(spark.range(50).selectExpr("id + 3000 as a", "id + 5000 as b"))
    got = {r["node"]: r["label"] for r in common.connected_components(edges, hub=10).collect()}
    assert got == {k: 7 for k in range(7, 3008)} | {k + 2000: 7 for k in range(3000, 3008)} | {k: k for k in range(3008, 3050)} | {k + 2000: k for k in range(3008, 3050)}
