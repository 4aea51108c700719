"""Personal data by patterns, and by a skip-chain conditional random field on top.

The four base patterns are exact and linear in the text. The field then labels every token with a digit, an @ or an (at) (all other
tokens are observed to be outside): neighbours share a chain potential, and tokens anywhere in the document that are written alike
share a skip potential of their kind of likeness: the same digits or letters, the same beginning or end, the same last digits after a mask.
Tokens under a base span are observed with its label. Loopy message passing carries labels along both kinds of edge, so that a number
written once in full marks its other mentions too, those that no pattern finds. Spans that come out with at least CERTAIN are
added; base spans stay. Luhn sums, octets and the like are features of a token; nothing is checked afterwards.

Weights are learned by pseudo-likelihood from a sample of TRAIN_DOCS documents of at most TRAIN_CHARS, those with the smallest hash of doc_id:
from these as they are, and from copies of those with base spans into which noise is sown with a fixed seed: mentions of a base span
without a plus sign, with other separators, masked or cut (labelled with its kind), and strangers of the same shapes (labelled as outside).
"""

from __future__ import annotations

import hashlib
import random
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
TRAIN_DOCS, TRAIN_CHARS = 2_000, 20_000
CERTAIN = 0.9
#: Digits of a span in several tokens.
MOST_DIGITS = (0, 0, 19, 15)
#: A document's messages pass until they change by less than SETTLED; one that SWEEPS don't settle is warned of.
SWEEPS, SETTLED = 2_000, 1e-4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive and anchored at the start of a run of digits: what fails there fails inside the run too, so long runs cost linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)
_NOT_DIGIT = re.compile(r"[^0-9]")
_EDGES = "\"'.,;:!?#*$%&|<>[]{}=()"
_FRONT = _EDGES.replace("*", "")  # a mask may begin a token
_AT, _MASK, _MASKED_END = re.compile(r"[(\[]at[)\]]", re.I), re.compile(r"\*{2,}|[xX]{3,}"), re.compile(r"(?:\*|[xX])[ -]?([0-9]{4})$")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in text.split("."))


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, by kind, then start."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((0, start, last := domain.end()))
        at = text.find("@", max(at + 1, last))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if octets(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Bounds of the tokens that hold a digit, an @ or an (at), without the punctuation around them."""
    out, n, mark = [], len(text), _MARK.search(text)
    while mark:
        start, end = mark.start(), mark.end()
        floor = out[-1][2] if out else 0
        while start > floor and not text[start - 1].isspace():
            start -= 1
        while end < n and not text[end].isspace():
            end += 1
        a, b = start, end
        while a < b and text[a] in _FRONT:
            a += 1
        while b > a and text[b - 1] in _EDGES:
            b -= 1
        out.append((a, b, end))
        mark = _MARK.search(text, end)
    return [(a, b) for a, b, _ in out]


N_FEATURES = 20


def features(core: str) -> list[int]:
    """Numbers of the token's features that hold."""
    digits = _NOT_DIGIT.sub("", core)
    n, out = len(digits), [0]
    out.append(1 + (n > 0) + (n > 3) + (n > 8) + (n > 12) + (n > 19))
    out += [k for k, holds in ((7, "@" in core), (8, core.count(".") == 3), (9, core.startswith("+")), (10, "-" in core), (11, any(c.isalpha() for c in core))) if holds]
    if 13 <= n <= 19 and luhn(digits):
        out.append(12)
    if core.count(".") == 3 and n + 3 == len(core) and octets(core):
        out.append(13)
    out += [k for k, holds in ((14, core.count(".") == 1), (15, len(core) == n), (16, _MASK.search(core)), (17, _AT.search(core)), (18, core.count("-") == 3), (19, "[" in core)) if holds]
    return out


#: Kinds of likeness: written the same, same beginning or end, same last digits after a mask.
SAME, PART, MASKED = 0, 1, 2


def likeness(core: str, span: str = "") -> list[tuple[int, str]]:
    """What a token shares with tokens like it, by kind of likeness; span is the base span that it lies in."""
    out = []
    digits, whole = _NOT_DIGIT.sub("", core), _NOT_DIGIT.sub("", span)
    letters = any(c.isalpha() for c in core)
    if "@" in core or _AT.search(core):
        name, _, domain = _AT.sub("@", core.casefold()).rpartition("@")
        out.append((SAME, f"{name}@{domain}"))
        if name and domain:
            out.append((PART, f"{name[:1]}@{domain}"))
    elif letters and not _MASK.search(core) and not core.lower().endswith(".x") and len(core) >= 6:
        out.append((SAME, core.casefold()))
    if not letters and len(digits) >= 4:
        out.append((SAME, digits))
    if whole and whole != digits:
        out.append((SAME, whole))
    if core.count(".") == 3:
        out.append((PART, core.rpartition(".")[0]))
    end = _MASKED_END.search(core)
    if end:
        out.append((MASKED, end[1]))
    elif span.endswith(core) and len(whole) >= 9 and "@" not in span and span.count(".") != 3:
        out.append((MASKED, whole[-4:]))
    if len(whole or digits) >= 9 and not letters:
        out.append((PART, (whole or digits)[-8:]))
    return out


@dataclass
class Graph:
    """Tokens of many documents: their features, observed labels (-1: none) and edges; kind is each skip edge's likeness."""

    x: np.ndarray
    seen: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    kind: np.ndarray
    where: list[tuple[int, int, int]]  # document, start, end


def graph(texts: list[str], spans: list[list[Span]]) -> Graph:
    rows, seen, chain, skip, where = [], [], [], [], []
    for doc, (text, found) in enumerate(zip(texts, spans, strict=True)):
        of: dict[tuple[int, str], list[int]] = {}
        kinds = [sorted((s, e) for k, s, e in found if k == kind) for kind in range(len(KINDS))]  # disjoint within a kind
        at, before = [0] * len(KINDS), None
        for a, b in tokens(text):
            node = len(where)
            over = []
            for kind, own in enumerate(kinds):
                while at[kind] < len(own) and own[at[kind]][1] <= a:
                    at[kind] += 1
                if at[kind] < len(own) and own[at[kind]][0] < b:
                    over.append((own[at[kind]][0], kind))
            label = min(over)[1] + 1 if over else -1
            core = text[a:b]
            row = np.zeros(N_FEATURES, np.float32)
            row[features(core)] = 1
            rows.append(row)
            seen.append(label)
            if before is not None and a - before <= 2 and "\n" not in text[before:a]:
                chain.append((node - 1, node))
            for key in likeness(core, text[slice(*kinds[label - 1][at[label - 1]])] if label > 0 else ""):
                of.setdefault(key, []).append(node)
            before = b
            where.append((doc, a, b))
        # one of the tokens alike, an observed one if there is any, is the hub of all others, so that labels are two steps apart at most
        tied: set[tuple[int, int]] = set()
        for (kind, _), nodes in sorted(of.items()):
            hub = next((x for x in nodes if seen[x] >= 0), nodes[0])
            for x in nodes:
                edge = min(hub, x), max(hub, x)
                if x != hub and edge not in tied:
                    tied.add(edge)
                    skip.append((*edge, kind))
    pairs = lambda e, n: np.array(e, np.int64).reshape(-1, n)
    skips = pairs(skip, 3)
    return Graph(np.array(rows, np.float32).reshape(-1, N_FEATURES), np.array(seen, np.int64), pairs(chain, 2), skips[:, :2], skips[:, 2], where)


@dataclass
class Field:
    """Weights: of features by label, of label pairs along the chain, of label pairs along skips by likeness."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def blank() -> Field:
    m = len(LABELS)
    return Field(np.zeros((N_FEATURES, m)), np.zeros((m, m)), np.zeros((3, m, m)))


def train(g: Graph, truth: np.ndarray, steps: int = 400, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Pseudo-likelihood: every token's label (truth) given its features and its neighbours' labels, by gradient steps of adaptive size."""
    n, m = len(truth), len(LABELS)
    w = blank()
    w.unary[0, 0] = 1.0  # outside, where nothing was learned
    if not n:
        return w
    one_hot = np.eye(m)[truth]
    (a, b), (i, j) = g.chain.T, g.skip.T
    parts = [w.unary, w.chain, w.skip]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        logits = g.x @ w.unary
        np.add.at(logits, b, w.chain[truth[a]])
        np.add.at(logits, a, w.chain[:, truth[b]].T)
        np.add.at(logits, j, w.skip[g.kind, truth[i]])
        np.add.at(logits, i, w.skip[g.kind, truth[j]])
        p = np.exp(logits - logits.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - one_hot) / n
        skip = np.zeros_like(w.skip)
        for kind in range(len(skip)):
            x, y = i[g.kind == kind], j[g.kind == kind]
            skip[kind] = one_hot[x].T @ error[y] + one_hot[y].T @ error[x]
        gradients = [g.x.T @ error, one_hot[a].T @ error[b] + error[a].T @ one_hot[b], (skip + skip.transpose(0, 2, 1)) / 2]
        for k, (part, gradient) in enumerate(zip(parts, gradients, strict=True)):
            gradient = gradient + decay / n * part
            first[k] = 0.9 * first[k] + 0.1 * gradient
            second[k] = 0.99 * second[k] + 0.01 * gradient**2
            part -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return w


def broken(kind: int, span: str, rng: random.Random) -> str:
    """A mention of a base span as no pattern of its kind finds it."""
    digits = _NOT_DIGIT.sub("", span)
    if kind == 0:
        name, _, domain = span.rpartition("@")
        return rng.choice((f"{name}(at){domain}", f"{name}[at]{domain}", f"{name[:1]}***@{domain}"))
    if kind == 1:
        return rng.choice((span.rpartition(".")[0] + ".x", span.replace(".", "-"), span.replace(".", "[.]")))
    if kind == 2:
        return rng.choice((".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), "****" + digits[-4:], "xxxx-xxxx-" + digits[-4:], "/".join(digits[k : k + 4] for k in range(0, len(digits), 4))))
    return rng.choice((span[1:], digits if not luhn(digits) or len(digits) < 13 else span[1:], "***" + digits[-4:]))


def stranger(kind: int, span: str, rng: random.Random) -> str:
    """Something of the shape of a broken mention that names nobody in the text."""
    other = re.sub("[0-9]", lambda _: str(rng.randrange(10)), span)
    return broken(kind, re.sub("[a-z]", lambda _: rng.choice("abcdefghijklmnopqrstuvwxyz"), other), rng)


def sown(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """The text with broken mentions of its spans and strangers between words, and where the mentions are."""
    gaps = [m.start() for m in re.finditer(r"(?<=[a-z]) (?=[a-z])", text)]
    gaps = [x for x in gaps if not any(a <= x < b for _, a, b in spans)]
    if not gaps:
        return text, []
    put = []
    for kind, a, b in spans:
        for _ in range(rng.randint(0, 2)):
            put.append((rng.choice(gaps), broken(kind, text[a:b], rng), kind))
        if rng.random() < 0.7:
            put.append((rng.choice(gaps), stranger(kind, text[a:b], rng), -1))
    out, where, last, size = [], [], 0, 0
    for x, mention, kind in sorted({p[0]: p for p in put}.values()):
        out += [text[last : x + 1], mention, " "]
        size += x + 1 - last
        if kind >= 0:
            where.append((kind, size, size + len(mention)))
        size += len(mention) + 1
        last = x + 1
    return "".join(out) + text[last:], where


def lessons(texts: list[str], seed: int = 0) -> tuple[Graph, np.ndarray]:
    """The graph of the texts as they are and with noise sown, and the true labels of its tokens."""
    rng = random.Random(seed)
    all_texts, mentions = list(texts), [[] for _ in texts]
    for text in texts:
        spans = base_spans(text)
        if spans:
            for _ in range(3):
                noisy, where = sown(text, spans, rng)
                all_texts.append(noisy)
                mentions.append(where)
    g = graph(all_texts, [base_spans(t) for t in all_texts])
    return g, true_labels(g, mentions)


def true_labels(g: Graph, mentions: list[list[Span]]) -> np.ndarray:
    truth = np.maximum(g.seen, 0)
    for k, (doc, a, b) in enumerate(g.where):
        if g.seen[k] < 0:
            truth[k] = next((kind + 1 for kind, s, e in mentions[doc] if s < b and e > a), 0)
    return truth


def posteriors(g: Graph, w: Field, sweeps: int = SWEEPS) -> np.ndarray:
    """Each token's label probabilities by loopy belief propagation, all documents at once; observed labels are certain."""
    m = len(LABELS)
    local = g.x @ w.unary
    local = np.where((g.seen >= 0)[:, None], np.where(np.arange(m)[None, :] == g.seen[:, None], 0.0, -30.0), local - local.max(1, keepdims=True))
    edges = np.concatenate((g.chain, g.skip))
    if len(edges):
        potential = np.concatenate((np.repeat(w.chain[None], len(g.chain), 0), w.skip[g.kind]))
        source, target = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
        potential = np.concatenate((potential, potential.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
        message = np.zeros((len(source), m))
        doc = np.array([x[0] for x in g.where])[source]
        # only documents whose messages still change go on: all their edges, by number in at
        at = np.arange(len(source))
        for _ in range(sweeps):
            belief = local.copy()
            np.add.at(belief, target[at], message[at])
            new = (belief[source[at]] - message[back[at]])[:, :, None] + potential[at]
            top = new.max(1)
            new = top + np.log(np.exp(new - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            moving = np.abs(new - message[at]).max(1) >= SETTLED
            message[at] = 0.5 * message[at] + 0.5 * new
            open_docs = np.zeros(doc.max() + 1, bool)
            open_docs[doc[at[moving]]] = True
            at = at[open_docs[doc[at]]]
            if not len(at):
                break
        else:
            warnings.warn(f"messages of {len(np.unique(doc[at]))} documents have not settled after {sweeps} sweeps", stacklevel=2)
        local = local.copy()
        np.add.at(local, target, message)
    p = np.exp(local - local.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def all_spans(texts: list[str], w: Field) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans of each text, and all spans: base and those that the field adds."""
    base = [base_spans(t) if _MARK.search(t) else [] for t in texts]
    some = [k for k, t in enumerate(texts) if _MARK.search(t)]
    g = graph([texts[k] for k in some], [base[k] for k in some])
    full = [list(b) for b in base]
    if not g.where:
        return base, full
    p = posteriors(g, w)
    best, sure = p.argmax(1), p.max(1)
    linked = set(map(tuple, g.chain))
    new = lambda k: best[k] > 0 and g.seen[k] < 0 and sure[k] >= CERTAIN
    k = 0
    while k < len(best):
        if new(k):
            (doc, start, end), label = g.where[k], int(best[k])
            text = texts[some[doc]]
            # cards and phones may be written in several tokens
            while (k, k + 1) in linked and best[k + 1] == label and new(k + 1) and len(_NOT_DIGIT.sub("", text[start : g.where[k + 1][2]])) <= MOST_DIGITS[label - 1]:
                k += 1
                end = g.where[k][2]
            full[some[doc]].append((label - 1, start, end))
        k += 1
    return base, [sorted(set(f)) for f in full]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= last:
            out += [text[last:a], f"[{KINDS[kind].upper()}]"]
        last = max(last, b)
    return "".join(out) + text[last:]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Field:
    """The field's weights from a bounded sample of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").where(F.length("text") <= train_chars)
    # ids first: at most train_docs numbers, and then only their texts
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).distinct()
    rows = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return train(*lessons([r[1] for r in rows]))


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs(doc_id, text).

    Counts and base_sha256 are of the base patterns; spans holds all. Null and empty texts have none. A repeated row gives a row each
    time; doc_id may be null; other columns are ignored.
    """
    field = field or fit(docs)

    def run(texts: list[str]) -> list[tuple]:
        return [(*(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(full)) for base, full in zip(*all_spans(texts, field), strict=True)]

    return common.map_texts(docs, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", lambda: run)


def redact_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with all spans of text redacted and n_chars, if there, set anew; null texts stay null, all other columns as they are."""
    field = field or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            new: list[str | None] = []
            for begin, end in common.slices([t or "" for t in texts]):
                part = [t or "" for t in texts[begin:end]]
                new += [None if old is None else redacted(t, full) for old, t, full in zip(texts[begin:end], part, all_spans(part, field)[1], strict=True)]
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["text"] = pa.array(new, columns["text"].type)
            if "n_chars" in columns:
                sizes = [n if t is None else len(t) for t, n in zip(new, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(common.table(spark, sf_dir, "documents"))
