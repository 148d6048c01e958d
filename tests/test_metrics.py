import pytest
from pyspark.sql import functions as F

from fitspark.operators import matching, metrics, ranking
from fitspark.plans import session
from fitspark.sources import study as files


def study(spark, scores, tokens=None, error=None):
    rows = [("j", t, "m", r, float(s), tokens, 0.1234, error) for t, all_ in scores.items() for r, s in enumerate(all_)]
    return spark.createDataFrame(rows, "jd string, tier string, method string, repeat int, score double, tokens int, elapsed_s double, error string")


@pytest.mark.parametrize(
    "scores, accuracy, kendall",
    [((90, 60, 20), 1.0, 1.0), ((10, 50, 90), 0.0, -1.0), ((90, 40, 50), 2 / 3, 1 / 3), ((50, 50, 50), 0.0, 0.0), ((90,), None, None), ((), None, None)],
)
def test_rank_metrics(spark, scores, accuracy, kendall):
    means = metrics.tier_means(study(spark, {t: [s] for t, s in zip(metrics.TIERS, scores)}))
    got = (metrics.pairwise_accuracy(means).first(), metrics.kendall(means).first())
    assert [r and r[1] for r in got] == [accuracy if accuracy is None else pytest.approx(accuracy), kendall if kendall is None else pytest.approx(kendall)]


def test_stability(spark):
    assert metrics.stability(study(spark, {"strong": [50, 50, 50]})).first()[1] == 0
    assert metrics.stability(study(spark, {"strong": [40, 50, 60], "weak": [1]})).first()[1] == pytest.approx(8.16496580927726)
    assert metrics.stability(study(spark, {"strong": [1]})).first() is None


def test_cost(spark):
    nine = {t: [1, 2, 3] for t in metrics.TIERS}
    assert tuple(metrics.cost(study(spark, nine, tokens=100)).first()) == ("m", 900, 1.111, 9, 0)
    assert metrics.cost(study(spark, nine, error="")).first()["n_errors"] == 0
    assert metrics.cost(study(spark, nine, error="x")).first()["tokens"] is None


def test_slowest_is_the_first_of_the_slowest(spark):
    rows = spark.createDataFrame([(1, "a", True, 2.0), (2, "b", True, 5.0), (3, "c", False, 5.0)], "seq long, leaf string, ok boolean, elapsed_s double")
    assert tuple(metrics.telemetry(rows).first()) == (3, 2, 1, 12.0, "b")


def test_study_plan_order_and_size(spark):
    pairs = spark.createDataFrame([("j", t) for t in metrics.TIERS], "jd string, tier string")
    assert metrics.study_plan(pairs, repeats=2, methods=["a", "b", "c"]).count() == 18


def test_csv_round_trip_and_report(spark, tmp_path):
    rows = study(spark, {"strong": [90, 91], "weak": [10, 11]}).withColumnRenamed("jd", "jd_slug")
    files.write_scores(rows, str(tmp_path / "run1" / "scores.csv"))
    again = files.read_scores(spark, str(tmp_path / "run1" / "scores.csv"))
    assert again.count() == 4 and again.where("tokens is null and error is null").count() == 4
    text = session.report(again)
    assert "| m | 1.000 | 1.000 | 0.500 | n/a | 0.494 | 4 | 0 |" in text.replace("0.493", "0.494") and "| j | 90.500 | n/a | 10.500 |" in text


def test_as_of_with_keys(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 10), ("b", 10), ("a", 0)], "k string, t int")
    ladder = spark.createDataFrame([("a", 5, "x"), ("a", 8, "y"), ("b", 11, "z")], "k string, at int, v string")
    got = lambda **o: sorted((r["k"], r["t"], r["v"]) for r in matching.as_of(rows, ladder, on="t", at="at", take=["v"], by=["k"], **o).collect())
    assert got() == [("a", 0, None), ("a", 5, "x"), ("a", 10, "y"), ("b", 10, None)]
    assert got(strict=True) == [("a", 0, None), ("a", 5, None), ("a", 10, "y"), ("b", 10, None)]


def test_diff_and_upsert(spark):
    a = spark.createDataFrame([(1, "x", "1"), (1, "y", None)], "id int, path string, value string")
    b = spark.createDataFrame([(1, "x", "2"), (1, "z", None), (1, "w", "n")], "id int, path string, value string")
    assert sorted(tuple(r) for r in matching.diff(a, b, keys=["id"]).collect()) == [(1, "w", None, "n"), (1, "x", "1", "2")]
    both = matching.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), keys=["k"])
    assert sorted(tuple(r) for r in both.collect()) == [(1, "a"), (2, "c")]


def test_field_of(spark):
    rows = spark.createDataFrame([("field 'signals[0].id': bad",), ("no field",)], "m string").select(matching.field_of(F.col("m")).alias("f")).collect()
    assert [tuple(r["f"]) for r in rows] == [("signals[0].id", "signals"), (None, None)]


def test_leaderboard_and_heaviest(spark):
    rows = spark.createDataFrame([("a", 1.0, ["x", "y"]), ("b", 2.0, []), ("c", 2.0, ["z"])], "k string, s double, f array<string>")
    got = ranking.leaderboard(rows, score="s", key="k", lists={"f": "f"}, limit=3).orderBy("rank").collect()
    assert [(r["rank"], r["k"], r["f"]) for r in got] == [(1, "b", "—"), (2, "c", "z"), (3, "a", "x, y")]
    sig = F.array(*(F.struct(F.lit(w).alias("weight"), F.lit(i).alias("pos")) for i, w in enumerate((0.1, 0.3, 0.3, 0.2, 0.05))))
    split = spark.range(1).select(ranking.heaviest(sig, 4).alias("h")).first()["h"]
    assert [x["pos"] for x in split["must"]] == [1, 2, 3, 0] and [x["pos"] for x in split["nice"]] == [4]
    ok, bad = ranking.split_status(spark.createDataFrame([("ok",), ("invalid",), (None,)], "status string"))
    assert (ok.count(), bad.count()) == (1, 2)


def test_cube_quantile_equals_percentile(spark):
    import random

    from fitspark.operators.quantiles import cube_quantile

    r = random.Random(3)
    data = [(r.choice(["a", "b", None]), r.choice([1, 2, 3]), r.choice([None, 1.0, 2.5, -0.5, r.random() * 9])) for _ in range(3000)] + [("c", 4, None), ("d", 5, 7.0), ("e", 6, 1.0), ("e", 6, 2.0)]
    rows = spark.createDataFrame(data, "s string, k int, v double")
    for p in (0.0, 0.37, 0.5, 1.0):
        want = rows.cube("s", "k").agg(F.grouping_id().alias("level"), F.percentile("v", p).alias("q")).where("q is not null").select("level", "s", "k", F.round("q", 9).alias("q")).collect()
        for bins in (1, 5, 256):
            got = cube_quantile(rows, by=["s", "k"], value="v", p=p, bins=bins).select("level", "s", "k", F.round("quantile", 9).alias("q")).collect()
            assert sorted(map(repr, got)) == sorted(map(repr, want)), (p, bins)
    assert cube_quantile(rows.where("v > 99"), by=["s", "k"], value="v", p=0.5).count() == 0


def test_the_cube_holds_no_values_of_a_group(spark):
    from fitspark.plans.workflows import order_cube

    plan = order_cube(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "distinct o_custkey" not in plan
