import corpus_pipeline
from threadloom.llm import decontaminate, minhash, pii

from . import cases


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    item = cases.prose(70, 15)
    texts = [cases.prose(i, 80) for i in range(40)] + [cases.prose(3, 80) + " end", cases.prose(71, 20) + " " + item, "write to me@host.example now " + cases.prose(72, 40)]
    texts += ["### ".join(cases.prose(80 + i, 60).upper().split()) for i in range(12)]
    docs = cases.documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = range(100, 100 + len(texts))
    spark.createDataFrame([(d, int(d < 143), 0) for d in ids], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, str(tmp_path)).cache()
        own = {r.doc_id: r for r in before.collect()}
        left = {r.doc_id for r in now.collect()}
        if name == "quality":
            assert not left & set(range(143, 155)) and set(range(100, 143)) <= left
        if name == "near_duplicates":
            assert own.keys() - left == {r.doc_id for r in minhash.near_duplicates(before).collect() if not r.kept and r.doc_id} and 140 not in left
        if name == "decontamination":
            assert own.keys() - left == {141}
        if name == "personal_data":
            assert left == own.keys() and "<EMAIL>" in {r.doc_id: r.text for r in now.collect()}[142]
        assert now.columns == docs.columns or name == "packing"
    rows = corpus_pipeline.run(spark, str(tmp_path))
    per_doc = lambda df: sorted(map(tuple, df.fillna(-1).groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()))
    assert per_doc(rows) == per_doc(now)
