import math
import random
import re
import warnings
from collections import Counter

from helpers import docs, odd_rows, text

from sessionlens.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(t):
    w = re.findall(WORD, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def test_measures_and_verdicts(spark):
    rng = random.Random(0)
    rows = odd_rows() + [(100 + k, text(k * 13, 200, 1 + k % 9) + ".\n" + text(k, 40) + ".") for k in range(60)]
    rows += [(200 + k, " ".join(f"{w}###" for w in text(k * 7, 120).split())) for k in range(20)]
    rows += [(300 + k, "\n".join(rng.choice(["a b c", "a b | c", "", " "]) for _ in range(30))) for k in range(10)]
    got = quality.judge(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = dict(rows)
    for r in got:
        b = brute(want[r["doc_id"]] or "")
        assert tuple(r)[1:6] == b
        assert r["base_failed"] == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert set(range(100, 160)) <= kept and not kept & set(range(200, 220))
    assert quality.judge(docs(spark, [])).count() == 0


def test_em_tells_accuracies():
    rules = len(quality.RULES)
    code = lambda votes: sum(3**k * v for k, v in enumerate(votes))
    good, bad = code([2] * rules), code([1, 1, 1] + [2] * (rules - 3))
    post = quality.fit({good: (900, 900), bad: (100, 100)})
    assert post[good] > 0.99 and post[bad] < 0.01 and quality.fit({}) == {}


def brute_em(texts, rounds):
    """The model text by text in plain Python. texts: (votes, whether it is learnt from)."""
    rules = len(quality.RULES)
    p = [1 / (1 + math.exp(3 * v.count(1) - v.count(2))) for v, _ in texts]
    for _ in range(rounds):
        mass, seen = [0.0, 0.0], [[[0.0] * 3 for _ in range(rules)] for _ in range(2)]
        for (votes, learnt), q in zip(texts, p, strict=True):
            for side, share in enumerate((1 - q, q)) if learnt else ():
                mass[side] += share
                for rule, vote in enumerate(votes):
                    seen[side][rule][vote] += share
        chance = [[[(x + 0.5) / (mass[side] + 1.5) for x in seen[side][rule]] for rule in range(rules)] for side in range(2)]
        for rule in range(rules):
            for vote, unlikely in ((2, 0), (1, 1)):
                a, b = chance[unlikely][rule][vote], chance[1 - unlikely][rule][vote]
                if a > b:
                    chance[0][rule][vote] = chance[1][rule][vote] = (a + b) / 2
        logs = [[math.log((mass[side] + 1) / (sum(mass) + 2)) + sum(math.log(chance[side][rule][vote]) for rule, vote in enumerate(votes)) for side in range(2)] for votes, _ in texts]
        p = [1 / (1 + math.exp(max(-500, min(500, a - b)))) for a, b in logs]
    return p


def test_verdicts_equal_plain_em():
    rng = random.Random(4)
    for clear in (0.8, 0.5, 0.4):  # the less clear the votes, the more rounds
        texts = []
        for _ in range(300):
            good = rng.random() < 0.7
            texts.append(([rng.choice([0, 1, 2]) if rng.random() > clear else 2 if good else 1 for _ in quality.RULES], rng.random() < 0.9))
        code = [sum(3**k * v for k, v in enumerate(votes)) for votes, _ in texts]
        counts = {c: (sum(x == c and learnt for x, (_, learnt) in zip(code, texts, strict=True)), code.count(c)) for c in set(code)}
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # no swinging here
            post = quality.fit(counts)
        want = brute_em(texts, 400)
        assert max(abs(post[c] - w) for c, w in zip(code, want, strict=True)) < 1e-6
        assert all((post[c] >= 0.5) == (w >= 0.5) for c, w in zip(code, want, strict=True))
