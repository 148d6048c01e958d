import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitspark.llm import mixing, toxicity, weak

# ------------------------------------------------------------------ weak supervision


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    right = (0.95, 0.8, 0.7, 0.9)
    votes = np.stack([np.where(rng.random(len(truth)) < 0.2, -1, np.where(rng.random(len(truth)) < r, truth, ~truth)) for r in right], axis=1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = weak.estimate(patterns, counts)
    assert m.prior == pytest.approx(0.7, abs=0.05)
    for j, r in enumerate(right):
        spoke = m.table[j, 1, 1:].sum()
        assert m.table[j, 1, 2] / spoke == pytest.approx(r, abs=0.06)
    assert ((m.posterior(votes) > 0.5) == truth).mean() > 0.9


def test_no_patterns_give_the_prior():
    m = weak.estimate(np.zeros((0, 3), int), np.zeros(0), prior=0.6)
    assert m.posterior(np.array([[1, 0, -1]])) == pytest.approx([0.6])


def test_posterior_column_is_the_posterior(spark):
    m = weak.estimate(np.array([[1, 1], [0, 0], [1, -1], [-1, 0]]), np.array([50, 20, 10, 5]))
    rows = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    got = [r[2] for r in spark.createDataFrame(rows, "a int, b int").select("a", "b", m.posterior_column([F.col("a"), F.col("b")])).orderBy("a", "b").collect()]
    assert got == pytest.approx(m.posterior(np.array(rows)).tolist())


# ------------------------------------------------------------------ toxicity

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"))


def test_held_out_rows_are_those_of_crc32(spark):
    ids = [0, 1, 2, 77, 10**12, -5]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", toxicity.held_out()).collect()
    assert [r[1] for r in rows] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]


def test_classifier_learns_from_few_labels(spark, model):
    scored = toxicity.score(spark.read.parquet(f"{D}/documents.parquet"), model).join(spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    rows = scored.where(toxicity.held_out()).where("lang = 'en'").collect()
    toxic, clean = ([r["toxic_score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.85 and np.mean([s >= 0.3 for s in clean]) < 0.1


def test_score_depends_on_the_text_alone(spark, model, edge, empty):
    got = toxicity.score(edge, model)
    assert got.columns == [*edge.columns, "toxic_score", "toxic_rejected"] and toxicity.score(empty, model).count() == 0
    rows = got.collect()
    assert len(rows) == edge.count() and all(0 <= r["toxic_score"] <= 1 for r in rows)
    same = {r["toxic_score"] for r in rows if r["text"] == "alpha beta gamma delta epsilon zeta"}
    assert len(same) == 1 and len({r["toxic_score"] for r in rows if not (r["text"] or "").split()}) == 1


def test_scorer_forgets_and_agrees(model, docs, monkeypatch):
    texts = [r["text"] for r in docs.limit(70).collect()]
    want = toxicity.Scorer(model).scores(texts)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 10)
    assert toxicity.Scorer(model).scores(texts) == pytest.approx(want)
    direct = toxicity.sigmoid(model.scale * toxicity.logits(model, [toxicity.buckets_of(t) for t in texts]) + model.shift)
    assert direct.tolist() == want.tolist()


def test_unlabelled_tables_reject_nothing(spark, edge, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.fit(edge, labels)
    assert not any(r["toxic_rejected"] for r in toxicity.score(edge, m).collect())
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 1, 1), (2, 1, 0), (3, 1, 5)], "doc_id long, quality int, toxic int")
    assert not any(r["toxic_rejected"] for r in toxicity.score(edge, toxicity.fit(edge, odd)).collect())


# ------------------------------------------------------------------ mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450) == pytest.approx([200, 83.3333, 166.6667], abs=1e-3)
    got = mixing.targets([10, 1000, 0, 500], [3, 1, 2, 3], 1.5 * 1510)
    assert sum(got) == pytest.approx(1.5 * 1510) and got[0] == 20 and got[2] == 0 and all(t <= 2 * s + 1e-9 for t, s in zip(got, [10, 1000, 0, 500]))
    assert mixing.targets([], [], 0) == []


def test_splitting_tree_is_exact():
    q = [7, 0, 1000, 33]
    split = mixing.split_quotas(q, 13, 4)
    assert split.sum(axis=0).tolist() == q and split.min() >= 0 and max(split.sum(axis=1)) - min(split.sum(axis=1)) <= 4
    assert (split == mixing.split_quotas(q, 13, 4)).all()


def test_mix_of_documents(docs):
    light, plan = mixing.mix(docs)
    rows = light.collect()
    assert len(rows) == docs.count() and all(r["mix_copies"] <= 2 for r in rows)
    taken, goal = {}, dict(zip(plan.sources["source"], plan.sources["target"]))
    for r in rows:
        taken[r["mix_source"]] = taken.get(r["mix_source"], 0) + r["mix_size"] * r["mix_copies"]
    largest = max(r["mix_size"] for r in rows)
    assert all(abs(taken[s] - goal[s]) <= max(0.15 * goal[s], 40) for s in goal if goal[s] > largest)
    assert sorted(map(repr, mixing.mix(docs.repartition(7))[0].select("doc_id", "mix_copies", "mix_shards").collect())) == sorted(map(repr, light.select("doc_id", "mix_copies", "mix_shards").collect()))


def test_large_blocks_are_taken_in_parts(docs, monkeypatch):
    monkeypatch.setattr(mixing, "PART_DOCS", 2)
    light, plan = mixing.mix(docs, max_blocks=1)
    assert plan.counts["n_parts"].max() > 2 and len(plan.partial)
    taken = {}
    for r in light.collect():
        assert r["mix_copies"] <= 2
        taken[r["mix_source"]] = taken.get(r["mix_source"], 0) + r["mix_size"] * r["mix_copies"]
    largest = max(r["mix_size"] for r in light.collect())
    assert all(abs(taken[s] - t) <= largest for s, t in zip(plan.sources["source"], plan.sources["target"]))


def test_number_of_blocks_is_bounded(docs, monkeypatch):
    monkeypatch.setattr(mixing, "ALL_BLOCKS", 40)
    _, plan = mixing.mix(docs)
    assert len(plan.blocks) <= 40 and len(plan.sources) == 20
    monkeypatch.setattr(mixing, "ALL_BLOCKS", 10)
    with pytest.raises(ValueError, match="more than 10 sources"):
        mixing.mix(docs)


def test_shards_hold_their_quotas(docs):
    _, plan = mixing.mix(docs, shards=4)
    drawn = [s for x in plan.blocks["shards"] for s in x]
    assert len(drawn) == plan.blocks["copies"].sum() and max(drawn.count(k) for k in range(4)) - min(drawn.count(k) for k in range(4)) <= 3


def test_mixed_documents_and_edge_cases(docs, edge, empty):
    light, _ = mixing.mix(docs)
    want = sorted(r["doc_id"] for r in light.collect() for _ in range(r["mix_copies"]))
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == want
    shards = {}
    for r in mixing.mix_documents(docs, shards=6, shard_column="shard").withColumn("at", F.spark_partition_id()).collect():
        shards.setdefault(r["at"], set()).add(r["shard"])
    assert {len(s) for s in shards.values()} == {1} and set().union(*shards.values()) == set(range(6))
    ordered = [min(shards[at]) for at in sorted(shards)]
    assert ordered == sorted(ordered)  # a shard's partitions stand together
    light, plan = mixing.mix(edge)
    assert light.count() == edge.count() and list(plan.sources["source"]) == ["", "s1", "s2", "s3", None]
    for r in light.collect():
        assert r["mix_size"] * r["mix_copies"] <= 2 * r["mix_size"]
    assert mixing.mix_documents(edge).columns == edge.columns
    assert mixing.mix(empty)[0].count() == mixing.mix_documents(empty).count() == 0
