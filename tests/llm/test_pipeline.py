import re
from collections import Counter

import corpus_pipeline
from fitspark.llm import mixing, toxicity


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path / name)
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = [r.asDict() for r in docs.collect()]
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{d}/labels.parquet"))
            rejected = {r["doc_id"] for r in toxicity.score(before, model).where("toxic_rejected").collect()}
            assert {r["doc_id"] for r in kept[name]} == {r["doc_id"] for r in before.collect()} - rejected
        if name == "exact_dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
            assert Counter(norm(r["text"]) for r in kept[name]) == Counter({norm(r["text"]) for r in before.collect()})
        if name == "mixing":
            light, _ = mixing.mix(before)
            assert Counter(r["doc_id"] for r in kept[name]) == Counter({r["doc_id"]: r["mix_copies"] for r in light.collect() if r["mix_copies"]})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert len(kept["bpe"]) == len(kept["mixing"]) and set(r["doc_id"] for r in kept["near_dedup"]) <= set(r["doc_id"] for r in kept["exact_dedup"])
    assert sorted(map(repr, corpus_pipeline.run(spark, d).collect())) == sorted(map(repr, docs.collect()))
