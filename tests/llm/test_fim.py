import hashlib

import duckdb
import pytest
from helpers import docs, odd_rows, text
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlens.llm import fim

TEXTS = st.text(alphabet="aZ é🙂\n<>PSM", max_size=80)


def plain(r):
    return [] if isinstance(r, fim.Leaf) else [r, *plain(r.left), *plain(r.right)]


def brute(text, numbers):
    units = fim.UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or numbers[2] % 100 >= 90:
        return text, n, "plain", None, None
    a, b = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if numbers[3] % 100 < 20:
        return f"<S>{s}<P>{p}<M>{m}", n, "spm", len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", n, "psm", len(p), len(m)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4), st.sampled_from([1, 3, 256]))
def test_moves_and_restores(text, numbers, size):
    held, fim.LEAF = fim.LEAF, size
    try:
        got = fim.moved(text, numbers)
        assert got == brute(text, numbers) and fim.restored(got[0], got[2]) == text
    finally:
        fim.LEAF = held


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(0, 90), st.integers(0, 90))
def test_rope(text, a, b):
    held, fim.LEAF = fim.LEAF, 2
    try:
        r = fim.rope(text)
        left, right = fim.split(r, a)
        units = fim.UNIT.findall(text)
        assert fim.flat(left) == "".join(units[:a]) and fim.flat(right) == "".join(units[a:])
        assert fim.rank_at(r, len("".join(units[:b]))) == min(b, len(units))
        for node in (n for part in (r, left, right) for n in plain(part)):
            assert abs(node.left.height - node.right.height) <= 1
            assert node.units == node.left.units + node.right.units == len(fim.UNIT.findall(fim.flat(node))) and node.chars == len(fim.flat(node))
    finally:
        fim.LEAF = held


def test_numbers():
    digest = hashlib.sha256(b"1:77").hexdigest()
    assert fim.numbers_of(77, 1) == [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def test_odd_rows(spark):
    rows = [*odd_rows(), (None, text(3, 50)), (11, "keep <P> as it is"), *((k, text(k, 60)) for k in range(20, 60))]
    got = fim.restore(fim.fill_in_middle(docs(spark, rows))).collect()
    assert sorted((str(r["doc_id"]), r["restored"]) for r in got) == sorted((str(d), t or "") for d, t in rows)
    want = sorted(str((d, *brute(t or "", fim.numbers_of(d, 1)))) for d, t in rows)
    assert sorted(str(tuple(r)[0:1] + tuple(r)[1:6]) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_restore_stands_foreign_rows(spark):
    rows = spark.createDataFrame([(1, "no sentinel", 3, "psm", 1, 1), (2, "<P>ab<S>cd<M>ef", 9, "psm", 2, 2)], "doc_id bigint, output string, n bigint, form string, prefix_chars bigint, middle_chars bigint")
    assert {r["doc_id"]: r["restored"] for r in fim.restore(rows).collect()} == {1: None, 2: "abefcd"}


def test_empty(spark):
    assert fim.restore(fim.fill_in_middle(docs(spark, []))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    got, want = fim.op12_fim(spark, f"/root/testdata/{sf}"), duckdb.sql(fim.ORACLE)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
