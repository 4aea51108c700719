import hashlib
import random

from helpers import docs, odd_rows

from sessionlens.llm import byte_bpe


def test_stitching_equals_whole_encoding():
    enc, rng, joined = byte_bpe.encoding(), random.Random(2), 0
    for _ in range(3000):
        t = "".join(rng.choice(rng.choice(["ab '\n", "ab's re.  \t", "é漢 1a'll", "x", "\n "])) for _ in range(rng.randint(1, 300)))
        size, overlap = rng.choice([20, 40, 64]), rng.choice([8, 12, 16])
        n = max(1, -(-max(1, len(t) - overlap) // size))
        chunks = []
        for k in range(n):
            part = t[k * size :] if k == n - 1 else t[k * size : k * size + size + overlap]
            chunks.append((part, *byte_bpe.chunk_edges(part, k == 0, k == n - 1, overlap)))
        pieces = byte_bpe.stitched(chunks, size)
        joined += len(pieces) < n
        assert "".join(pieces) == t
        ids = byte_bpe.encode_pieces(pieces)
        assert ids == enc.encode_ordinary(t) and byte_bpe.decode(ids) == t.encode()
    assert joined


def test_query(spark):
    enc = byte_bpe.encoding()
    long = [(30, "word and 'll more\n\n\n  x " * 3000), (30, "word and 'll more\n\n\n  x " * 3000), (None, " " * 50_000), (31, "<|endoftext|>")]
    rows = odd_rows() + long
    got = sorted(byte_bpe.digests(docs(spark, rows)).collect(), key=str)
    want = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert byte_bpe.digests(docs(spark, [])).count() == 0
    assert {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs(spark, [(1, "hello"), (2, None)])).collect()} == {1: enc.encode_ordinary("hello"), 2: []}
