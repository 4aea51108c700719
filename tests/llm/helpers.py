"""Rows that every operator must stand: nulls, empty and long texts, ties, repeated rows, extra and clashing columns."""

import zlib

WORDS = [f"w{k}" for k in range(3000)]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score double, _copies int"
BIG = 2**60 + 1


def text(start, n, step=7):
    return " ".join(WORDS[(start + step * k) % len(WORDS)] for k in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "x", 0.5, 3) for d, t in rows], DOCS)


def odd_rows():
    same = text(5, 120)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, same), (6, same), (6, same), (BIG, text(9, 90)), (8, "a" * 40_000), (9, " ".join(["x"] * 20_000)), (10, "é🙂漢  " * 50)]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
