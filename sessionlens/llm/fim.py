"""Fill-in-the-middle: a text is cut at two of its units and its pieces change places, marked by sentinels; restore() turns them back.

A text is a rope: leaves of at most LEAF units under a balanced tree whose nodes cache their numbers of units and of code points. Cutting
splits the tree at a unit's rank along one path, moving concatenates subtrees and leaves for the sentinels, and restoring finds the sentinels'
code points, turns them into ranks by the cached counts, splits there and concatenates the other way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: What a unit is, the sentinels, and how many of 100 texts take part or have the suffix first.
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MOVED, SUFFIX_FIRST = 90, 20
LEAF = 256


@dataclass(frozen=True, slots=True)
class Leaf:
    text: str
    units: int
    chars: int
    height: int = 0


@dataclass(frozen=True, slots=True)
class Node:
    left: Rope
    right: Rope
    units: int
    chars: int
    height: int


Rope = Leaf | Node
EMPTY = Leaf("", 0, 0)


def leaf(text: str) -> Leaf:
    return Leaf(text, sum(1 for _ in UNIT.finditer(text)), len(text))


def rope(text: str) -> Rope:
    """A balanced rope; leaves end where units end, so a long run of letters is one leaf's one unit."""
    parts, begin, n, end = [], 0, 0, 0
    for match in UNIT.finditer(text):
        n, end = n + 1, match.end()
        if n == LEAF:
            parts.append(Leaf(text[begin:end], n, end - begin))
            begin, n = end, 0
    if n:
        parts.append(Leaf(text[begin:end], n, end - begin))
    while len(parts) > 1:
        parts = [join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else EMPTY


def join(a: Rope, b: Rope) -> Rope:
    """Their concatenation. Heights differ by one at most along the seam, so that it stays balanced. No unit may run across the seam."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    if a.height > b.height + 1:
        return _balanced(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _balanced(join(a, b.left), b.right)
    return _node(a, b)


def _node(a: Rope, b: Rope) -> Node:
    return Node(a, b, a.units + b.units, a.chars + b.chars, 1 + max(a.height, b.height))


def _balanced(a: Rope, b: Rope) -> Node:
    """_node(a, b) for heights that differ by two at most, by a rotation where they do."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return _node(a.left, _node(a.right, b))
        return _node(_node(a.left, a.right.left), _node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return _node(_node(a, b.left), b.right)
        return _node(_node(a, b.left.left), _node(b.left.right, b.right))
    return _node(a, b)


def split(r: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest."""
    if rank <= 0:
        return EMPTY, r
    if rank >= r.units:
        return r, EMPTY
    if isinstance(r, Leaf):
        for k, match in enumerate(UNIT.finditer(r.text)):
            if k == rank:
                at = match.start()
                break
        return Leaf(r.text[:at], rank, at), Leaf(r.text[at:], r.units - rank, r.chars - at)
    if rank < r.left.units:
        a, b = split(r.left, rank)
        return a, join(b, r.right)
    a, b = split(r.right, rank - r.left.units)
    return join(r.left, a), b


def rank_at(r: Rope, char: int) -> int:
    """The number of units before a code point at which a unit begins."""
    before = 0
    while isinstance(r, Node):
        if char < r.left.chars:
            r = r.left
        else:
            before, char, r = before + r.left.units, char - r.left.chars, r.right
    return before + sum(1 for m in UNIT.finditer(r.text) if m.start() < char)


def flat(r: Rope) -> str:
    out, open_ = [], [r]
    while open_:
        r = open_.pop()
        if isinstance(r, Leaf):
            out.append(r.text)
        else:
            open_ += [r.right, r.left]
    return "".join(out)


def moved(text: str, numbers: list[int]) -> tuple[str, int, str, int | None, int | None]:
    """Output, n, form, prefix_chars and middle_chars of a text by its four random numbers."""
    r = rope(text)
    n = r.units
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or numbers[2] % 100 >= MOVED:
        return text, n, "plain", None, None
    first, second = sorted(h % (n + 1) for h in numbers[:2])
    rest, suffix = split(r, second)
    prefix, middle = split(rest, first)
    p, s, m = leaf(PREFIX), leaf(SUFFIX), leaf(MIDDLE)
    form = "spm" if numbers[3] % 100 < SUFFIX_FIRST else "psm"
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    out = EMPTY
    for part in parts:
        out = join(out, part)
    return flat(out), n, form, prefix.chars, middle.chars


def restored(output: str, form: str) -> str:
    """The text that moved() gave this output and form for."""
    if form == "plain":
        return output
    r, pieces, marks = rope(output), {}, [SUFFIX, PREFIX, MIDDLE] if form == "spm" else [PREFIX, SUFFIX, MIDDLE]
    for mark in reversed(marks):  # what follows the last sentinel is cut off first
        r, tail = split(r, rank_at(r, output.index(mark)))
        pieces[mark] = split(tail, leaf(mark).units)[1]
    return flat(join(join(pieces[PREFIX], pieces[MIDDLE]), pieces[SUFFIX]))


def numbers_of(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def _mapped(rows: DataFrame, columns: list[str], schema: pa.Schema, function) -> DataFrame:
    """function(*values) to a tuple for each row, a few megabytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in columns]
            for begin, end in common.slices([t or "" for t in values[1]]):
                out = [function(*row) for row in zip(*(v[begin:end] for v in values), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    kinds = {pa.int64(): "long", pa.string(): "string"}
    return rows.select(*columns).mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, output, n, form (plain, psm or spm), prefix_chars, middle_chars of each row of docs(doc_id, text).

    The cuts and the form follow from seed and doc_id alone. A null text counts as empty and stays plain, as does one that holds a sentinel; a
    null doc_id draws as an empty one. Repeated rows give repeated results; other columns are ignored; an empty table gives an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("output", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _mapped(rows, ["doc_id", "text"], schema, lambda doc_id, text: (doc_id, *moved(text or "", numbers_of(doc_id, seed))))


def restore(examples: DataFrame) -> DataFrame:
    """The examples' columns and `restored`, rebuilt from output and form alone; null where an output lacks the sentinels of its form."""
    schema = pa.schema([("doc_id", pa.int64()), ("output", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("restored", pa.string())])

    def row(doc_id, output, n, form, prefix, middle):
        marked = form == "plain" or all(m in output for m in (PREFIX, SUFFIX, MIDDLE))
        return doc_id, output, n, form, prefix, middle, restored(output, form) if marked else None

    return _mapped(examples, schema.names[:-1], schema, row)


def op12_fim(spark, sf_dir: str) -> DataFrame:
    rows = restore(fill_in_middle(common.table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS UBIGINT)) AS h FROM d),
n AS (SELECT *, len(units) AS n, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {MOVED} AS plain FROM u),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM n),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf,
  CASE WHEN plain THEN 'plain' WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN NOT plain THEN length(pre) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN NOT plain THEN length(mid) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
