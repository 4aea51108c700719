"""Byte-level BPE by overlapping chunk encoding.

A text longer than CHUNK code points is cut into chunks that overlap by OVERLAP. Chunks are pre-tokenised in parallel, each from
its own start. How text is split to the right of a boundary between pre-tokens doesn't depend on what is left of it, so as soon as a
boundary of a chunk's reliable part is also one of the next chunk's, both go on alike: there the chunks are stitched. (Not after
white space: its last character would be split off otherwise where a piece ends.) The pieces between two stitches are encoded and
their ids concatenated. Where an overlap holds no common boundary (one pre-token longer than the
overlap), the two chunks are joined to one piece, so the ids are always those of the whole text. A text of one chunk is its own
piece. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import threading
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RANKS = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 16_384, 512
#: A boundary this near a chunk's end may depend on what follows: a contraction looks two characters ahead, white space one.
AHEAD = 4

_cache: dict[str, tiktoken.Encoding] = {}
_lock = threading.Lock()


def encoding(ranks: str = RANKS) -> tiktoken.Encoding:
    """The rank file of that name from the tokenizers' package; loaded once a process."""
    with _lock:
        if ranks not in _cache:
            with open(public_tokenizers.path(ranks), "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            _cache[ranks] = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        return _cache[ranks]


def boundaries(text: str) -> list[int]:
    """Starts of the text's pre-tokens, and its end."""
    return [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)] + [len(text)]


def chunk_edges(text: str, first: bool, last: bool, overlap: int) -> tuple[list[int], list[int]]:
    """A chunk's boundaries in its overlap with the chunk before, and reliable ones in its overlap with the next, in code points from the chunk's start."""
    cuts = boundaries(text)
    head = [] if first else [c for c in cuts if c <= overlap]
    tail = [] if last else [c for c in cuts if len(text) - overlap <= c <= len(text) - AHEAD and not text[c - 1].isspace()]
    return head, tail


def stitched(chunks: list[tuple[str, list[int], list[int]]], step: int) -> list[str]:
    """Pieces of the whole text, cut where neighbouring chunks have a common boundary; chunk k starts at k * step."""
    pieces, held, begin = [], "", 0
    for k, (text, _, tail) in enumerate(chunks):
        cut = None
        if k + 1 < len(chunks):
            head = set(chunks[k + 1][1])
            cut = next((c for c in tail if c > begin and c - step in head), None)
        if cut is not None:
            pieces.append(held + text[begin:cut])
            held, begin = "", cut - step
        elif k + 1 < len(chunks):
            held, begin = held + text[begin:step] if begin < step else held, max(0, begin - step)
        else:
            pieces.append(held + text[begin:])
    return pieces


def encode_pieces(pieces: list[str], ranks: str = RANKS) -> list[int]:
    enc = encoding(ranks)
    return [i for piece in pieces for i in enc.encode_ordinary(piece)]


def decode(ids: list[int], ranks: str = RANKS) -> bytes:
    """The raw bytes of the ids, one after another; they need not be whole characters."""
    return encoding(ranks).decode_bytes(ids)


def _pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        edges = [chunk_edges(t, k == 0, k == n - 1, OVERLAP) for t, k, n in zip(batch["text"], batch["chunk"], batch["chunks"], strict=True)]
        yield batch.assign(head=[e[0] for e in edges], tail=[e[1] for e in edges])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _long_chunks(rows: DataFrame) -> DataFrame:
    """A row for each overlapping chunk of texts over CHUNK code points; equal rows are one group with their number."""
    rows = rows.where(F.length("text") > CHUNK).groupBy("doc_id", "text").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    chunks = F.ceil(F.greatest(F.lit(1), F.length("text") - OVERLAP) / F.lit(CHUNK)).cast("int")
    rows = rows.withColumn("key", F.sha2("text", 256)).withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    size = F.when(F.col("chunk") == F.col("chunks") - 1, F.length("text")).otherwise(F.lit(CHUNK + OVERLAP))
    return rows.select("doc_id", "copies", "key", "chunk", "chunks", F.col("text").substr(F.col("chunk") * CHUNK + 1, size).alias("text"))


def _encoded(docs: DataFrame, columns: str, row_of, ranks: str) -> DataFrame:
    """doc_id and `columns`, made by row_of(ids), for each row of docs."""
    schema = f"doc_id long, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]

    def short(texts: list[str]) -> list[tuple]:
        return [row_of(encode_pieces([t], ranks)) for t in texts]

    def stitch(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        pieces = stitched(list(zip(group["text"], group["head"], group["tail"], strict=True)), CHUNK)
        row = (group["doc_id"].iloc[0], *row_of(encode_pieces(pieces, ranks)))
        return pd.DataFrame([row] * int(group["copies"].iloc[0]), columns=names).astype({"doc_id": "Int64"})

    rows = _rows(docs)
    few = common.map_texts(rows.where(F.length("text") <= CHUNK), columns, lambda: short)
    parts = _long_chunks(rows).repartition("doc_id", "key", "chunk")
    parts = parts.mapInPandas(_pretokenise, "doc_id long, copies int, key string, chunk int, chunks int, text string, head array<int>, tail array<int>")
    return few.unionByName(parts.groupBy("doc_id", "copies", "key").applyInPandas(stitch, schema))


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids array<int> of each row of docs(doc_id, text).

    Null and empty texts have no ids. A repeated row gives a row each time; doc_id may be null. Other columns are ignored.
    """
    return _encoded(docs, "ids array<int>", lambda ids: (ids,), ranks)


def digests(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs(doc_id, text), on the terms of encode(); the ids needn't leave their task."""

    def row_of(ids: list[int]) -> tuple:
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decode(ids, ranks)).hexdigest()

    return _encoded(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", row_of, ranks)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
