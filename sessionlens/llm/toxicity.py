"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes.

Terms are all lower-cased words and their beginnings of 4 and 6 letters that FLOOR examples hold; the label picks none. A text's
vector has 1 + log of each term's count times the term's weight, at unit length. The weight is the inverse document frequency; a term whose
log odds of the label are above 0 by SURE standard errors counts (1 + RAISE * that margin) times as much, all others as they are.

Examples are laid out so that similar ones share a block. For each block the index holds the postings by term, and for each term its
largest value in each block; the few terms that one in OFTEN examples holds are kept in full and added up for many texts at once. A
search adds the blocks' upper bounds to those sums and scores blocks from the largest bound down, until no bound beats the k-th cosine
found. So neighbours are exact; ties go to the smaller example number.

Votes are weighted by 1 / (distance + SOFT) and by what an example stands for in all labelled rows, then put through a logistic curve.
Odds are counted on one half of the examples, the curve is fitted on the leave-one-out votes of the other half, whose labels
raised no term. Texts without any term have no neighbour; they score as the labelled rows do on the whole.

Examples are a bounded sample of labelled rows: MOST_TOXIC and MOST_OTHER rows at most, those with the smallest hash of doc_id, of the
rows that may be learned from (crc32 of doc_id mod 5 isn't 0) with texts of at most MOST_CHARS. Class sizes count over all rows that may be
learned from. Texts of any length are scored whole.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MOST_TOXIC, MOST_OTHER, MOST_CHARS = 500, 1_500, 20_000
FLOOR = 10
SURE, RAISE = 2.5, 8.0
NEIGHBOURS, SOFT = 15, 0.05
BLOCK, AT_ONCE, TOGETHER, OFTEN = 128, 4, 32, 12
PREFIXES = (4, 6)
#: Words and scores that a task remembers.
REMEMBER = 50_000
_STRIP = "\"'.,;:!?#*$%&|<>()[]{}=_-+/\\~`^@…“”„«»‚‘’¿¡"

Row = tuple[np.ndarray, np.ndarray]  # term numbers, ascending, and 1 + log of their counts


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def stems(word: str) -> tuple[str, ...]:
    """A word's terms."""
    word = word.strip(_STRIP)
    if not word:
        return ()
    return (word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n))


class Vectors:
    """Texts to counted term numbers."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[int, ...]] = {}

    def _numbers(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= REMEMBER:
            self.known.clear()
        numbers = (self.vocabulary.get(s) for s in stems(word))
        found = self.known[word] = tuple(n for n in numbers if n is not None)
        return found

    def row(self, text: str) -> Row:
        counts: dict[int, int] = {}
        known = self.known
        for word, n in Counter(text.lower().split()).items():
            found = known.get(word)
            for number in self._numbers(word) if found is None else found:
                counts[number] = counts.get(number, 0) + n
        numbers = np.fromiter(counts, np.int64, len(counts))
        order = np.argsort(numbers)
        return numbers[order], 1 + np.log(np.fromiter(counts.values(), float, len(counts)))[order]


def _layout(rows: list[Row], weights: np.ndarray) -> np.ndarray:
    """An order of the examples in which similar ones are near: halved again and again along the line between two far ones, seen in a random projection."""
    directions = np.random.default_rng(1).standard_normal((len(weights), 48)).astype(np.float32)
    points = np.zeros((len(rows), 48), np.float32)
    for k, (terms, counts) in enumerate(rows):
        if len(terms):
            v = counts * weights[terms]
            points[k] = (v / np.sqrt(v @ v)) @ directions[terms]
    out, todo = [], [np.arange(len(rows))]
    while todo:
        some = todo.pop()
        if len(some) <= BLOCK:
            out.append(some)
            continue
        x = points[some]
        a = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
        b = x[((x - a) ** 2).sum(1).argmax()]
        order = np.argsort(x @ (b - a), kind="stable")
        half = -(-len(some) // 2 // BLOCK) * BLOCK  # whole blocks
        todo += [some[order[half:]], some[order[:half]]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


@dataclass
class Index:
    """Block-max inverted index of unit vectors. Terms that one in OFTEN examples holds are laid out in full, all others as postings."""

    weights: np.ndarray  # of each term
    numbers: np.ndarray  # example number of each place
    often: np.ndarray  # of each term: its column in full, -1 for a rare one
    full: np.ndarray  # often term x place
    starts: np.ndarray  # block x (terms + 1): where a rare term's postings in a block begin
    places: np.ndarray  # of each posting, in order of block, term and place: place in the block, value
    values: np.ndarray
    tops: np.ndarray  # term x block: the largest value of a rare term

    @classmethod
    def of(cls, rows: list[Row], weights: np.ndarray) -> Index:
        numbers = _layout(rows, weights)
        blocks = max(1, -(-len(rows) // BLOCK))
        laid = [rows[n] for n in numbers]
        terms = np.concatenate([t for t, _ in laid]) if laid else np.empty(0, np.int64)
        place = np.repeat(np.arange(len(laid)), [len(t) for t, _ in laid])
        values = (np.concatenate([c for _, c in laid]) if laid else np.empty(0)) * weights[terms]
        values = values / np.sqrt(np.bincount(place, values**2, minlength=len(laid)))[place]
        dense = np.bincount(terms, minlength=len(weights)) * OFTEN >= max(1, len(rows))
        often = np.where(dense, np.cumsum(dense) - 1, -1).astype(np.int32)
        full = np.zeros((int(dense.sum()), blocks * BLOCK))
        in_full = dense[terms]
        full[often[terms[in_full]], place[in_full]] = values[in_full]
        terms, place, values = terms[~in_full], place[~in_full], values[~in_full]
        block = place // BLOCK
        order = np.lexsort((place, terms, block))
        key = block[order] * len(weights) + terms[order]
        starts = np.searchsorted(key, (np.arange(blocks) * len(weights))[:, None] + np.arange(len(weights) + 1)[None, :]).astype(np.int32)
        tops = np.zeros((len(weights), blocks))
        np.maximum.at(tops, (terms, block), values)
        return cls(weights, numbers, often, full, starts, (place % BLOCK)[order].astype(np.int16), values[order], tops)

    def search_all(self, rows: list[Row], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each row the k examples of largest cosine above 0, best first; the example in `without` is left out."""
        out = []
        for begin in range(0, len(rows), TOGETHER):
            part = rows[begin : begin + TOGETHER]
            units = []
            asked = np.zeros((len(part), len(self.full)))
            for n, (terms, counts) in enumerate(part):
                q = counts * self.weights[terms]
                if len(q):
                    q = q / math.sqrt(float(q @ q))
                column = self.often[terms]
                asked[n, column[column >= 0]] = q[column >= 0]
                units.append((terms[column < 0], q[column < 0]))
            known = asked @ self.full
            out += [self._best(known[n], *unit, k, without[begin + n] if without else -1) for n, unit in enumerate(units)]
        return out

    def _best(self, known: np.ndarray, terms: np.ndarray, q: np.ndarray, k: int, without: int) -> list[tuple[float, int]]:
        """known: what the terms in full add to each place; terms and q: the rare ones."""
        known = known.reshape(-1, BLOCK)
        bounds = known.max(1) + q @ self.tops[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        scores, numbers = np.empty(0), np.empty(0, np.int64)
        least = 0.0
        for begin in range(0, len(order), AT_ONCE):
            # cosines are compared at 12 digits, so equal ones tie whatever order they were added in
            some = order[begin : begin + AT_ONCE]
            some = some[bounds[some] + 1e-9 >= least]
            if not len(some):
                break
            first = self.starts[some[:, None], terms].ravel()
            sizes = self.starts[some[:, None], terms + 1].ravel() - first
            has = np.flatnonzero(sizes)
            first, sizes = first[has], sizes[has]
            ends = np.cumsum(sizes)
            pair = np.repeat(np.arange(len(has)), sizes)
            at = np.arange(len(pair)) + (first - (ends - sizes))[pair]
            lane = has // max(1, len(terms)) * BLOCK
            found = known[some].ravel() + np.bincount(self.places[at] + lane[pair], self.values[at] * q[has % max(1, len(terms))][pair], minlength=len(some) * BLOCK)
            found = np.round(found, 12)
            hits = np.flatnonzero((found > 0) & (found >= least))
            names = self.numbers[some[hits // BLOCK] * BLOCK + hits % BLOCK]
            hits, names = hits[names != without], names[names != without]
            scores, numbers = np.concatenate((scores, found[hits])), np.concatenate((numbers, names))
            if len(scores) > k:
                best = np.lexsort((numbers, -scores))[:k]
                scores, numbers = scores[best], numbers[best]
            if len(scores) == k:
                least = float(scores.min())
        best = np.lexsort((numbers, -scores))
        return [(float(scores[b]), int(numbers[b])) for b in best]


@dataclass
class Model:
    vocabulary: dict[str, int]
    index: Index
    labels: np.ndarray
    stands_for: np.ndarray
    doc_ids: np.ndarray
    without_terms: float
    curve: tuple[float, float] = (4.0, -2.0)
    seen: dict = field(default_factory=dict)

    def votes(self, rows: list[Row], without: list[int] | None = None) -> list[tuple[float, list[tuple[float, int]]]]:
        """For each row the share of weight that votes for the label, -1 without neighbours; and the neighbours."""
        out = []
        for near in self.index.search_all(rows, NEIGHBOURS, without):
            w = [self.stands_for[n] / (1 - s + SOFT) for s, n in near]
            out.append((sum(x * self.labels[n] for x, (_, n) in zip(w, near, strict=True)) / sum(w) if near else -1.0, near))
        return out

    def scores(self, rows: list[Row]) -> list[tuple[float, str]]:
        """Scores, and the evidence: nearest examples as doc_id:label:cosine. Equal rows are looked up once."""
        keys = [hashlib.blake2b(terms.tobytes() + counts.tobytes(), digest_size=16).digest() for terms, counts in rows]
        if len(self.seen) >= REMEMBER // 10:
            self.seen.clear()
        new = {key: row for key, row in zip(keys, rows, strict=True) if key not in self.seen}
        for key, (share, near) in zip(new, self.votes(list(new.values())), strict=True):
            score = self.without_terms if share < 0 else 1 / (1 + math.exp(-(self.curve[0] * share + self.curve[1])))
            self.seen[key] = score, ",".join(f"{self.doc_ids[n]}:{self.labels[n]}:{s:.4f}" for s, n in near[:3])
        return [self.seen[key] for key in keys]


def odds_margin(having: np.ndarray, without: np.ndarray, n_having: int, n_without: int) -> np.ndarray:
    """How far a term's log odds of the label are above 0 beyond SURE standard errors; document counts in both classes."""
    cells = [having + 0.5, n_having - having + 0.5, without + 0.5, n_without - without + 0.5]
    logs = np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3])
    return np.maximum(0.0, logs - SURE * np.sqrt(sum(1 / c for c in cells)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by damped Newton steps, with a light penalty; the slope stays positive."""
    a, b = 4.0, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (p - y) * x).sum() + 1e-2 * (a - 4), (w * (p - y)).sum() + 1e-2 * (b + 2)])
        s = w * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1e-2, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        a = max(a, 0.5)
    return a, b


def fit_examples(texts: list[str], labels: list[int], doc_ids: list[int], totals: tuple[int, int]) -> Model:
    """A model of the examples; totals: rows without and with the label that the examples stand for."""
    y = np.array(labels, np.int64)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    sets = [{s for word in set(t.lower().split()) for s in stems(word)} for t in texts]
    frequency = Counter(s for terms in sets for s in terms)
    names = sorted(s for s, c in frequency.items() if c >= FLOOR)
    vocabulary = {s: k for k, s in enumerate(names)}
    # halves by the order of a hash, each class by itself
    half = np.zeros(len(y), bool)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        half[own[np.argsort(common.mix64(np.array([doc_ids[k] for k in own], np.int64).view(np.uint64)), kind="stable")[::2]]] = True
    held: list[np.ndarray] = []
    for label in (0, 1):
        counts = Counter(s for k in np.flatnonzero(half & (y == label)) for s in sets[k])
        held.append(np.array([counts[s] for s in names], float))
    weights = np.log((1 + len(y)) / (1 + np.array([frequency[s] for s in names], float))) + 1
    weights *= 1 + RAISE * odds_margin(held[1], held[0], int((half & (y == 1)).sum()), int((half & (y == 0)).sum()))
    del sets, frequency
    reader = Vectors(vocabulary)
    rows = [reader.row(t) for t in texts]
    stands_for = (np.array(totals, float) / np.maximum(n, 1))[y] if len(y) else np.empty(0)
    model = Model(vocabulary, Index.of(rows, weights), y, stands_for, np.array(doc_ids, np.int64), totals[1] / max(1, sum(totals)))
    others = np.flatnonzero(~half)
    votes = np.full(len(y), -1.0)
    votes[others] = [share for share, _ in model.votes([rows[k] for k in others], others.tolist())]
    used = votes >= 0
    if used.any() and 0 < y[used].mean() < 1:
        model.curve = _logistic(votes[used], y[used].astype(float), stands_for[used] / stands_for[used].mean())
    return model


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_other: int = MOST_OTHER, most_chars: int = MOST_CHARS) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic). Of several labels of one doc_id the largest counts, of several texts the smallest; nulls are left out."""
    labels = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r[0]: r[1] for r in labels.groupBy("toxic").agg(F.count(F.lit(1))).collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= most_chars)
    short = labels.join(texts.select("doc_id").distinct(), "doc_id")
    pick = lambda c, n: short.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # at most most_toxic + most_other rows of two numbers
    chosen = F.broadcast(pick(1, most_toxic).union(pick(0, most_other)))
    rows = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return fit_examples([r["text"] for r in rows], [int(r["toxic"]) for r in rows], [r["doc_id"] for r in rows], (totals.get(0, 0), totals.get(1, 0)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, evidence for each row of docs(doc_id, text).

    Null and empty texts have no neighbour and score as the labelled rows on the whole. A repeated row gives a row each time; doc_id may be
    null; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the examples' number and length
    return common.map_texts(docs, "score double, predicted int, evidence string", lambda: _scorer(held.value))


def _scorer(model: Model):
    reader = Vectors(model.vocabulary)

    def run(texts: list[str]) -> list[tuple]:
        out = []
        for begin in range(0, len(texts), 8 * TOGETHER):  # rows are larger than texts, so few at a time
            out += [(s, int(s >= 0.5), evidence) for s, evidence in model.scores([reader.row(t) for t in texts[begin : begin + 8 * TOGETHER]])]
        return out

    return run


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, that score below the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_all = _scorer(held.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                yield part.filter(pa.array([s < threshold for s, _, _ in score_all([t or "" for t in part.column("text").to_pylist()])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
