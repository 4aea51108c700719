import corpus_pipeline
from helpers import docs, odd_rows, text

from sessionlens.llm import near_dedup, pii, toxicity


def test_stages(spark, tmp_path):
    rows = odd_rows() + [(d, text(d * 11, 80) + (" idiot scum clown moron" if d % 4 == 0 else f" mail a{d}@b.org")) for d in range(1000, 1270)] + [(3000, text(1001 * 11, 80) + " mail a1001@b.org")]
    sf = f"file://{tmp_path}"
    docs(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(d, int(d % 7 > 0), int(d % 4 == 0)) for d in range(1000, 1270)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    kept = docs(spark, rows)
    columns = kept.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, sf)
        kept.write.parquet(f"{sf}/{name}")
        kept = spark.read.parquet(f"{sf}/{name}")
        seen[name] = kept.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == columns
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
            assert {r["doc_id"] for r in seen[name]} == {r["doc_id"] for r in toxicity.score(before, model).where("score < 0.5").collect()}
        if name == "near_dedup":
            gone = {r["doc_id"] for r in near_dedup.near_dedup(before, corpus_pipeline.SIMILAR).where("not kept").collect()}
            assert {r["doc_id"] for r in seen[name]} == {r["doc_id"] for r in before.collect()} - gone and 3000 in gone and 6 in gone
        if name == "pii":
            assert not any(pii.base_spans(r["text"] or "") for r in seen[name]) and len(seen[name]) == before.count()
        if name == "mixing":
            assert {r["doc_id"] for r in seen[name]} == {r["doc_id"] for r in before.collect()}
    assert {d for d in range(1000, 1270) if d % 4} <= {r["doc_id"] for r in seen["mixing"]} and len(seen["byte_bpe"]) == len(seen["mixing"])
    assert corpus_pipeline.run(spark, sf).count() == len(seen["byte_bpe"])
