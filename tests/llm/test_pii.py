import hashlib
import random
import re

import numpy as np
from helpers import BIG, docs, odd_rows

from sessionlens.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, kind != 1 or all(int(x) <= 255 for x in m.group().split(".")), kind != 2 or 13 <= len(digits) <= 19 and pii.luhn(digits), kind != 3 or 9 <= len(digits) <= 15)
            if all(ok):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_equals_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("1234509.@ab-+ ()é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_are_linear():
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1." * 100_000) == brute("1." * 100_000)


CARD = "4111111111111111"


def test_query_and_added_spans(spark):
    rows = odd_rows() + [(20, f"pay {CARD} now"), (21, f"twice {CARD} {CARD} end {CARD}"), (22, "call +1 (017) 555-7713 or a.b@c.org, 10.0.0.255 / 10.0.0.256")]
    got = {r["doc_id"]: r for r in pii.find_pii(docs(spark, rows)).collect()}
    for d, t in rows:
        base = pii.joined(brute(t or ""))
        assert got[d]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[d]["spans"].split(","))
    assert got[BIG]["n_card"] == 0 and (got[22]["n_email"], got[22]["n_ip"], got[22]["n_phone"]) == (1, 1, 1)
    # the pattern takes two cards in a row for one number
    assert got[21]["n_card"] == 1


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    number = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))

    def card():
        while not pii.luhn(c := number(16)):
            pass
        return c

    made = (lambda: f"{word()}.{number(2)}@{word()}{number(1)}.org", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), card, lambda: f"+{number(1)} {rng.randint(100, 999)} {number(3)}-{number(4)}", lambda: number(16), lambda: f"{number(1)}.{number(1)}", lambda: number(4))
    return [" ".join(rng.choice(made)() if rng.random() < 0.06 else word() for _ in range(80)) for _ in range(n)]


def test_sown_mentions_are_found():
    field = pii.train(*pii.lessons(corpus(250, 1)))
    rng = random.Random(5)
    right = wrong = planted = 0
    for t in corpus(80, 2):
        noisy, mentions = pii.sown(t, pii.base_spans(t), rng)
        base, full = pii.all_spans([noisy], field)
        assert set(base[0]) <= set(full[0])
        over = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
        planted += len(mentions)
        right += sum(any(over(m, s) for s in full[0]) for m in mentions)
        wrong += sum(not any(over(m, s) for m in mentions) for s in set(full[0]) - set(base[0]))
    assert planted > 100 and right >= 0.8 * planted and wrong <= 0.1 * right


def test_only_skip_edges_find_a_second_mention():
    field = pii.train(*pii.lessons(corpus(250, 1)))
    texts = ["ab 4111111111111111 cd efg ****1111 hi", "ab cd efg ****1111 hi", "write jo.12@here3.org or jo.12(at)here3.org now", "write jo.12(at)here3.org now", "from 10.0.0.77 gh 10[.]0[.]0[.]77 end"]
    base, full = pii.all_spans(texts, field)
    added = [pii.joined([s for s in f if s not in b]) for b, f in zip(base, full, strict=True)]
    assert added == ["card:27:35", "", "email:25:43", "", "ip:18:33"]
    without = pii.Field(field.unary, field.chain, np.zeros_like(field.skip))
    assert pii.all_spans(texts, without)[0] == pii.all_spans(texts, without)[1]


def equal_pull(chain, skip):
    w = pii.blank()
    w.chain[:], w.skip[:] = chain * np.eye(5), skip * np.eye(5)
    return w


def test_labels_reach_all_mentions():
    for written in (0, 20, 39):
        mentions = ["5550-1771-23"] * 40
        text = " x ".join(mentions)
        start = text.index(" x ") * written + 3 * written
        g = pii.graph([text], [[(3, start, start + 12)]])
        assert (g.seen >= 0).sum() == 1 and g.seen[written] == 4 and len(g.skip) == 39
        assert pii.posteriors(g, equal_pull(0, 10))[:, 4].min() > 0.99


def test_long_chains_settle():
    # no repeated token: a label walks along neighbours alone
    text = " ".join(f"{k:03d}" for k in range(60))
    g = pii.graph([text, "17 18"], [[(3, 0, 3)], []])
    assert len(g.skip) == 0 and len(g.chain) == 60
    # the exact marginals of a chain
    ratio = (np.exp(10) - 1) / (np.exp(10) + 4)
    assert np.abs(pii.posteriors(g, equal_pull(10, 1))[:60, 4] - (0.2 + 0.8 * ratio ** np.arange(60))).max() < 1e-3


def test_many_spans_over_one_token():
    found = [(0, 2, 9), (1, 0, 3), (1, 4, 6), (1, 7, 20), (2, 1, 5), (2, 6, 12)]
    assert pii.graph(["0123456789 123"], [found]).seen.tolist() == [2, 3]
    assert pii.graph(["0123456789 123"], [found[:3]]).seen.tolist() == [2, -1]


def test_redaction_keeps_other_columns(spark):
    rows = [(None, f"a {CARD} b"), (BIG, None), (3, "clean")]
    got = {r["doc_id"]: r for r in pii.redact_pii(docs(spark, rows)).collect()}
    assert got[None]["text"] == "a [CARD] b" and got[None]["n_chars"] == len("a [CARD] b")
    assert got[BIG]["text"] is None and got[3]["text"] == "clean" and got[3]["_copies"] == 3
    assert pii.redact_pii(docs(spark, [])).count() == 0
