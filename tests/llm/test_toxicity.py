import numpy as np
from helpers import docs, held_out, odd_rows, text

from sessionlens.llm import toxicity


def test_search_equals_brute_force():
    rng = np.random.default_rng(0)
    sets = [np.array(sorted(set(rng.integers(0, 40, rng.integers(0, 8)).tolist())), np.int64) for _ in range(700)]
    rows = [(r, 1 + np.log(rng.integers(1, 5, len(r)).astype(float))) for r in sets]
    weights = rng.random(40) + 0.5
    index = toxicity.Index.of(rows, weights)
    dense = np.zeros((700, 40))
    for k, (terms, counts) in enumerate(rows):
        dense[k, terms] = counts * weights[terms]
    length = np.sqrt((dense**2).sum(1, keepdims=True))
    dense = np.divide(dense, length, out=np.zeros_like(dense), where=length > 0)
    for q in range(0, 700, 7):
        cos = np.round(dense @ dense[q], 11)
        cos[q] = 0
        best = [int(b) for b in np.lexsort((np.arange(700), -cos))[:5] if cos[b] > 0]
        found = index.search_all([rows[q]], 5, [q])[0]
        assert np.allclose([s for s, _ in found], cos[best], atol=1e-10) and all(abs(cos[n] - s) < 1e-10 for s, n in found)
        assert len({n for _, n in found}) == len(best)
    none = (np.empty(0, np.int64), np.empty(0))
    assert index.search_all([none, rows[0], none], 5)[::2] == [[], []] and len(index.full) < 40 < toxicity.OFTEN * 40


def test_ties_go_to_the_smaller_number():
    row = (np.array([0, 1]), np.ones(2))
    index = toxicity.Index.of([row] * 300, np.ones(2))
    assert [n for _, n in index.search_all([row], 5, [2])[0]] == [0, 1, 3, 4, 5]


def test_the_label_picks_no_term():
    texts = ["the " + text(d * 11, 60) + (" idiot" if d % 4 == 0 else "") for d in range(200)]
    model = toxicity.fit_examples(texts, [int(d % 4 == 0) for d in range(200)], list(range(200)), (150, 50))
    plain = toxicity.fit_examples(texts, [0] * 200, list(range(200)), (200, 0))
    assert model.vocabulary == plain.vocabulary and "idiot" in model.vocabulary
    reader = toxicity.Vectors(model.vocabulary)
    assert all(near for _, near in model.votes([reader.row(t) for t in texts]))
    # without a margin a term weighs its inverse document frequency
    w, v = model.index.weights, plain.index.weights
    assert (w >= v - 1e-12).all() and w[model.vocabulary["idiot"]] > 3 * v[model.vocabulary["idiot"]]


def corpus():
    return [(d, text(d * 11, 60) + (" idiot scum clown" if d % 4 == 0 else "") + " " + text(d, 30)) for d in range(1000, 1400)]


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    labels = spark.createDataFrame([(d, 1, int(d % 4 == 0)) for d, _ in rows] + [(None, 1, 1), (5, None, None), (1000, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows + odd_rows()), labels)
    got = toxicity.score(docs(spark, rows + odd_rows() + [(None, "you idiot scum")]), model).collect()
    assert len(got) == len(rows) + len(odd_rows()) + 1 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert all(by[d] == (d % 4 == 0) for d, _ in rows if held_out(d)) and by[2] == 0 and by[None] == 1
    assert not any(held_out(d) for d in model.doc_ids.tolist())
    kept = toxicity.keep_clean(docs(spark, rows), model)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows if d % 4} and kept.columns == docs(spark, []).columns


def test_no_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs(spark, odd_rows()), none)
    assert {r["predicted"] for r in toxicity.score(docs(spark, odd_rows()), model).collect()} == {0}
    assert toxicity.score(docs(spark, []), model).count() == 0
