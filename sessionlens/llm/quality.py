"""Quality rules as weak supervision: rules vote good or bad or abstain, and expectation-maximisation weighs them.

Each rule has a clear-cut zone on either side and abstains between. A text's votes form a pattern; patterns of all texts that pass the
base rules are counted,
and a latent-class model (quality, and each rule's chances of voting good, bad or nothing under either quality) is fitted to
the counts. A text is kept if its posterior probability of good quality is at least 0.5 and it doesn't fail the base rules.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
#: Expectation-maximisation ends where no posterior moves by SETTLED. Where the moves find no new low in PATIENCE rounds, steps are halved.
SETTLED, PATIENCE = 1e-9, 1_000
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(common.SEPARATORS)] = True
_END = (".", "!", "?", "…", ":", '"', "”", "»", ";")

#: Name, where the rule says bad, where it says good; it abstains elsewhere.
RULES = (
    ("few_words", lambda f: f["n_words"] < 30, lambda f: f["n_words"] >= 80),
    ("word_length", lambda f: (f["mean_word"] > 15) | (f["mean_word"] < 2), lambda f: (f["mean_word"] <= 12) & (f["mean_word"] >= 3)),
    ("symbols", lambda f: f["symbols"] > 0.2, lambda f: f["symbols"] <= 0.02),
    ("marked_words", lambda f: f["marked_words"] > 0.2, lambda f: f["marked_words"] <= 0.02),
    ("marked_lines", lambda f: f["marked_lines"] > 0.5, lambda f: f["marked_lines"] <= 0.1),
    ("equal_lines", lambda f: f["dup_lines"] > 0.3, lambda f: f["dup_lines"] <= 0.05),
    ("repeats", lambda f: f["repeats"] > 0.3, lambda f: f["repeats"] <= 0.1),
    ("capitals", lambda f: f["capitals"] > 0.6, lambda f: f["capitals"] <= 0.2),
    ("line_ends", lambda f: f["line_ends"] < 0.5, lambda f: f["line_ends"] >= 0.7),
    ("variety", lambda f: f["variety"] < 0.15, lambda f: f["variety"] >= 0.3),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside a WINDOW-word window whose words occur at two places or more."""
    windows = common.window_hashes(hashes, WINDOW)
    if len(windows) < 2:
        return 0
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(texts: list[bytes]) -> pd.DataFrame:
    """Base counts and the rules' inputs of each text."""
    out = []
    for begin, end in common.slices(texts):
        part = texts[begin:end]
        hashes, bounds = common.word_hashes(part)
        buffer = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        stops = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))

        def totals(mask: np.ndarray, stops=stops) -> np.ndarray:
            run = np.concatenate(([0], np.cumsum(mask)))
            return run[stops[1:]] - run[stops[:-1]]

        inside = np.concatenate(([False], ~_SPACE[buffer], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        run = np.concatenate(([0], np.cumsum(_SYMBOL[buffer])))
        marks = np.zeros(len(buffer), bool)
        marks[edges[::2][run[edges[1::2]] > run[edges[::2]]]] = True
        marked = totals(marks)
        chars = totals((buffer & 0xC0 != 0x80) & ~_SPACE[buffer])
        symbols, upper, letters = totals(_SYMBOL[buffer]), totals(_UPPER[buffer]), totals(_LETTER[buffer])
        for k, text in enumerate(part):
            words = hashes[bounds[k] : bounds[k + 1]]
            n = len(words)
            lines = [line for line in text.split(b"\n") if line.strip(common.SEPARATORS)]
            dup = len(lines) - len(set(lines))
            repeats = repeated_words(words)
            ended = sum(line.rstrip(common.SEPARATORS).decode("utf-8", "replace").endswith(_END) for line in lines)
            in_lines = sum(any(c in line for c in SYMBOLS) for line in lines) if symbols[k] else 0
            out.append((n, int(chars[k]), int(symbols[k]), dup, repeats, chars[k] / max(1, n), symbols[k] / max(1, n), marked[k] / max(1, n), in_lines / max(1, len(lines)), dup / max(1, len(lines)), repeats / max(1, n), upper[k] / max(1, letters[k]), ended / max(1, len(lines)), len(np.unique(words)) / n if n else 0.0))
    return pd.DataFrame(out, columns=[*MEASURES, "mean_word", "symbols", "marked_words", "marked_lines", "dup_lines", "repeats", "capitals", "line_ends", "variety"])


def patterns(f: pd.DataFrame) -> np.ndarray:
    """Each text's votes as a number to base 3: 0 abstains, 1 bad, 2 good, first rule last."""
    code = np.zeros(len(f), np.int64)
    for k, (_, bad, good) in enumerate(RULES):
        code += 3**k * np.where(bad(f), 1, np.where(good(f), 2, 0))
    return code


def fit(counts: dict[int, tuple[int, int]]) -> dict[int, float]:
    """Posterior probability of good quality for each pattern, by expectation-maximisation from the majority's opinion, until it settles.

    counts: a pattern's texts that pass the base rules, which the model is fitted to, and all its texts. Smoothing and the bound on a rule's
    chances may make rounds swing; steps are then halved until they end, with a warning.
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts), np.int64)
    weight = np.array([counts[c][0] for c in codes], float)
    votes = (codes[:, None] // 3 ** np.arange(len(RULES))) % 3
    one_hot = np.eye(3)[votes]  # pattern x rule x vote
    good, bad = (votes == 2).sum(1), (votes == 1).sum(1)
    # one clear objection weighs as much as three approvals to begin with
    p = 1 / (1 + np.exp(-(good - 3.0 * bad)))
    step, least, waited = 1.0, np.inf, 0
    while True:
        share = np.stack((1 - p, p)) * weight
        prior = (share.sum(1) + 1) / (weight.sum() + 2)
        chance = (np.einsum("cp,prv->crv", share, one_hot) + 0.5) / (share.sum(1)[:, None, None] + 1.5)
        # a rule that votes tells the truth at least as often as not: good votes no likelier under bad quality, and vice versa
        for vote, low, high in ((2, 0, 1), (1, 1, 0)):
            middle = (chance[low, :, vote] + chance[high, :, vote]) / 2
            wrong = chance[low, :, vote] > chance[high, :, vote]
            chance[low, wrong, vote] = chance[high, wrong, vote] = middle[wrong]
        logs = np.log(prior)[:, None] + np.einsum("prv,crv->cp", one_hot, np.log(chance))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        move = step * float(np.abs(new - p).max())
        p = p + step * (new - p)
        if move < SETTLED:
            break
        least, waited = (move, 0) if move < least else (least, waited + 1)
        if waited == PATIENCE:
            warnings.warn(f"quality model swings by {move:.3g}; steps are halved to {step / 2:.3g}", stacklevel=2)
            step, least, waited = step / 2, np.inf, 0
    return {int(c): float(x) for c, x in zip(codes, p, strict=True)}


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior of each row of docs(doc_id, text).

    Null and empty texts have no words and fail the base rules. A repeated row gives a row each time and votes each time; doc_id may be
    null; with no rows the result is empty. Other columns are ignored.
    """

    def measure(texts: list[str]) -> list[tuple]:
        f = measures([t.encode("utf-8", "replace") for t in texts])
        return list(zip(*(f[m].tolist() for m in MEASURES), patterns(f).tolist(), strict=True))

    rows = common.map_texts(docs, ", ".join(f"{m} long" for m in MEASURES) + ", pattern int", lambda: measure)
    rows = common.written(rows, "measures")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # at most 3 ** len(RULES) patterns
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy("pattern").agg(F.count_if(~failed), F.count(F.lit(1))).collect()}
    posterior = fit(counts)
    table = F.broadcast(docs.sparkSession.createDataFrame(list(posterior.items()), "pattern int, posterior double"))
    rows = rows.join(table, "pattern", "left").withColumn("base_failed", failed)
    return rows.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))
