import json
import random

import pytest
from pyspark.sql import functions as F

from fitspark.config import parity, role_of, structural
from fitspark.operators import cells, lexical, matching
from fitspark.operators.ranking import nearest
from fitspark.plans.candidates import ROLE


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    r = random.Random(3)
    middles = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(f"e{i}", [x + r.gauss(0, 0.05) for x in middles[i % 12]]) for i in range(1500)]
    rows += [("zero", [0.0] * 8), ("null", None), ("short", [1.0]), ("hole", [1.0, None] + [0.0] * 6)] + [(f"same{i}", rows[5][1]) for i in range(6)]
    vectors = spark.createDataFrame(rows, "embedding_id string, vector array<double>")
    path = str(tmp_path_factory.mktemp("cells"))
    cells.build(vectors, path, cells=24, sample=700)
    return vectors, path, rows


def test_pruned_search_equals_the_whole_one(spark, indexed):
    vectors, path, rows = indexed
    r = random.Random(1)
    read = []
    for k, asked in [(1, rows[7][1]), (10, rows[5][1]), (30, [r.gauss(0, 1) for _ in range(8)]), (10, [-x for x in rows[0][1]])]:
        got, n, of = cells.search(spark, path, asked, k=k)
        want = nearest(vectors, F.array(*(F.lit(x) for x in asked)), k=k)
        assert [(x.embedding_id, round(x.similarity, 9)) for x in got.collect()] == [(x.embedding_id, round(x.similarity, 9)) for x in want.collect()]
        read.append(n / of)
    assert min(read) < 0.3  # where vectors stand in clusters, most cells are left out


@pytest.mark.parametrize("asked", [[0.0] * 8, [1.0, 2.0]])
def test_vectors_without_a_direction_and_more_than_there_are(spark, indexed, asked):
    vectors, path, _ = indexed
    got, n, of = cells.search(spark, path, asked, k=5)
    want = nearest(vectors, F.array(*(F.lit(x) for x in asked)), k=5)
    assert [x.embedding_id for x in got.collect()] == [x.embedding_id for x in want.collect()] and n == of
    assert cells.search(spark, path, [1.0] * 8, k=5000)[0].count() == vectors.count()


def test_a_cell_is_a_folder_that_searches_skip(spark, indexed):
    _, path, rows = indexed
    got, _, _ = cells.search(spark, path, rows[7][1], k=1)
    assert "PartitionFilters: [cell" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bins", [1, 4, 64])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of_equals_a_plain_search_however_it_is_dealt(spark, bins, strict):
    r = random.Random(bins)
    rows = [(i, r.choice(["hot", "hot", "a", "b", None]), r.choice([None, r.randrange(60), 30])) for i in range(300)]
    ladder = [(r.choice(["hot", "a", None]), t, f"v{t}") for t in r.sample(range(60), 25)] + [("a", None, "never")]
    got = matching.as_of(spark.createDataFrame(rows, "i int, k string, t int"), spark.createDataFrame(ladder, "k string, at int, v string"), on="t", at="at", take=["v"], by=["k"], strict=strict, bins=bins)

    def plain(k, t):
        fits = [(at, v) for key, at, v in ladder if key == k and at is not None and t is not None and (at < t if strict else at <= t)]
        return max(fits)[1] if fits else None

    assert sorted((x.i, x.v) for x in got.collect()) == [(i, plain(k, t)) for i, k, t in rows]


def test_as_of_without_keys_takes_a_ladder_of_any_size(spark):
    ladder = spark.range(30_000).select((F.col("id") * 2).alias("at"), (F.col("id") * 10).alias("v"))
    got = matching.as_of(spark.range(0, 70_000, 7).select(F.col("id").alias("t")), ladder, on="t", at="at", take=["v"])
    assert got.where("not (v <=> least(t div 2, 29999) * 10)").count() == 0 and got.count() == 10_000
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    text = spark.createDataFrame([("b",), ("d",)], "t string")
    steps = spark.createDataFrame([("a", 1), ("c", 2)], "at string, v int")
    assert sorted(map(tuple, matching.as_of(text, steps, on="t", at="at", take=["v"]).collect())) == [("b", 1), ("d", 2)]
    assert matching.as_of(text, steps.limit(0), on="t", at="at", take=["v"]).where("v is null").count() == 2


@pytest.mark.parametrize("share", [0.5, 0.8, 1.0, 0.01])
def test_overlaps_of_rarest_tokens_equal_all_pairs(spark, share):
    r = random.Random(int(share * 100))
    made = lambda n, most: [(i, sorted({f"w{min(r.randrange(40), r.randrange(40))}" for _ in range(r.randrange(most))})) for i in range(n)]
    items, docs = made(40, 9), made(120, 25)
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} int, tokens array<string>")
    got = sorted((x.item, x.doc, x.hits) for x in lexical.overlapping(frame(items, "item"), frame(docs, "doc"), item="item", doc="doc", share=share).collect())
    assert got == sorted((i, d, len({*a} & {*b})) for i, a in items for d, b in docs if a and len({*a} & {*b}) >= share * len(a) - 1e-9 and {*a} & {*b})


def test_summaries_of_profiles_equal_those_of_the_driver(spark):
    base = ROLE.raw
    more = base | {"signals": base["signals"] + [{"id": "a_first", "label": "x", "query": "x", "evidence_regex": None, "dense_weight": 0.1}], "red_flags": {"cv_primary": {"enabled": False}, "job_hopper": {"enabled": True}}}
    more["domain"] = base["domain"] | {"out_of_domain_terms": ["tax", "sales"]}
    df = spark.createDataFrame([(json.dumps(base), json.dumps(more))], "a string, b string").select(matching.structural_of(F.parse_json("a")).alias("a"), matching.structural_of(F.parse_json("b")).alias("b"))
    row = df.select("a", "b", matching.parity_of(F.col("a"), F.col("b")).alias("p")).first().asDict(recursive=True)
    assert row["a"] == structural(role_of(base)) and row["b"] == structural(role_of(more))
    assert row["p"] == parity(row["a"], row["b"])


def test_only_similarities_come_back_from_python(spark):
    from fitspark.embedding import cosines, similarities

    class Given:
        model, dim = "given", 2

        def embed(self, texts):
            return [{"east": [3.0, 0.0], "north": [0.0, 2.0], "both": [1.0, 1.0], "": [], "odd": [1.0], "none": [0.0, 0.0]}[t] for t in texts]

    rows = spark.createDataFrame([(1, ["east", "both", None]), (2, []), (3, None), (4, ["odd", "none", "north", "north"])], "id int, texts array<string>")
    got = {r["id"]: r["s"] for r in similarities(rows, Given(), [[1.0, 0.0], [0.0, 1.0], []], texts="texts", into="s").collect()}
    half = 0.5**0.5
    assert got[2] == got[3] == [] and got[4] == [[0.0] * 3, [0.0] * 3, [0.0, 1.0, 0.0], [0.0, 1.0, 0.0]]
    assert [[round(x, 12) for x in s] for s in got[1]] == [[1.0, 0.0, 0.0], [round(half, 12)] * 2 + [0.0], [0.0] * 3]
    assert cosines([], [[1.0]]).shape == (0, 1)
