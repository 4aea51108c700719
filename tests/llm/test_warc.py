import hashlib

import duckdb

from sessionlens.llm import warc

SCHEMA = "page_id bigint, url string, html string, key string, digest string, first int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "d", 1) for i, u, h in rows], SCHEMA)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    same, nul = "x" * 100, "y" * 99
    rows = [(k, f"http://h{k % 3}.org/p/{k % 5}?q {k}", f"é{k}" * k) for k in range(10, 90)]
    rows += [(1, "http://a.org", same), (2, "http://a.org", same), (3, "http://b.org", same), (4, "http://b.org", nul), (5, None, nul), (6, "", None), (7, "bad url\n\tx", ""), (2**60 + 1, "ftp://u@H.org:80/#f", same), (None, "http://n.org", same)]
    table = pages(spark, rows).repartition(3)
    archive = warc.write_archive(table)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.read_back(table, archive).collect()}
    want = {}
    for i, _, h in rows:
        if i is not None:
            data = (h or "").encode()
            want[i] = (len(data), hashlib.sha256(data).hexdigest(), "revisit" if h == same and i != 1 else "response", 1 if h == same and i != 1 else None)
    assert got == want
    reader = archive.reader()
    key = pages(spark, [(1, "http://a.org", "")]).select(warc.url_key(__import__("pyspark.sql.functions", fromlist=["col"]).col("url"))).first()[0]
    assert key == "org,a)/" and list(reader.captures(key)) == [1, 2] and reader.read(key, 1).payload == same.encode() and reader.read(key, 99) is None


def test_repeated_and_no_rows(spark):
    table = pages(spark, [(1, "http://a.org", "z" * 200)] * 3)
    assert {tuple(r) for r in warc.read_back(table, warc.write_archive(table)).collect()} == {(1, 200, hashlib.sha256(b"z" * 200).hexdigest(), "response", None)}
    assert warc.read_back(pages(spark, []), warc.write_archive(pages(spark, []))).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert {tuple(r) for r in warc.op10_warc(spark, sf).collect()} == set(duckdb.sql(warc.ORACLE).fetchall())
