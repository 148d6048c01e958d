import random
import time
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fitspark.functions.tables import register_tables
from fitspark.operators import sketches
from fitspark.operators.concordance import concordance, gamma, weighted_pairs
from fitspark.operators.intervals import overlap_join


def plain_pairs(points):
    c = d = 0
    for (a, b), (x, y) in combinations(points, 2):
        sign = (a - x) * (b - y)
        c, d = c + (sign > 0), d + (sign < 0)
    return c, d


@pytest.mark.parametrize("block_rows", [10**6, 20, 3])
def test_concordance_equals_all_pairs(spark, block_rows):
    r = random.Random(block_rows)
    rows = [(g, r.randrange(12) if g else r.choice([3, 3, 3, r.randrange(200)]), r.gauss(0, 1) if g == 2 else float(r.randrange(9))) for g in (0, 1, 2) for _ in range(150)]
    rows += [(3, 1, 1.0)] * 5 + [(4, None, 1.0), (5, 1, 2.0), (5, 2, None)]
    got = {x.g: (x.n, int(x.concordant), int(x.discordant), x.gamma) for x in concordance(spark.createDataFrame(rows, "g int, a int, b double"), by=["g"], a="a", b="b", block_rows=block_rows).collect()}
    assert got.keys() == {0, 1, 2, 3, 5}
    for g in got:
        points = [(a, b) for k, a, b in rows if k == g and a is not None and b is not None]
        c, d = plain_pairs(points)
        assert got[g][:3] == (len(points), c, d)
        assert got[g][3] is None if c + d == 0 else got[g][3] == pytest.approx((c - d) / (c + d))


def test_concordance_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "a int, b int")
    assert concordance(df, by=[], a="a", b="b").select("n", F.col("concordant").cast("int"), F.col("discordant").cast("int")).first() == (3, 1, 1)
    assert concordance(df.withColumn("g", F.lit(1)).limit(0), by=["g"], a="a", b="b").count() == 0


def test_a_million_rows_in_one_group(spark):
    n = 10**6
    df = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 1_000_003).alias("a"), (F.col("id") * 104_729 % 999_983).alias("b"))
    began = time.time()
    one = concordance(df, by=["g"], a="a", b="b", block_rows=150_000).first()
    x, y = (np.arange(n, dtype=np.int64) * k % m for k, m in ((7919, 1_000_003), (104_729, 999_983)))
    c, d = weighted_pairs(x, y, np.ones(n, np.int64))
    assert (int(one.concordant), int(one.discordant)) == (c, d) and c + d > 0.49 * n * n
    assert time.time() - began < 300
    assert gamma(pd.Series(x[:500]), pd.Series(y[:500])) == pytest.approx((lambda p: (p[0] - p[1]) / (p[0] + p[1]))(plain_pairs(list(zip(x[:500].tolist(), y[:500].tolist())))))


def test_weights_beyond_64_bits():
    w = np.array([3 * 10**11, 10**11, 5], np.int64)
    assert weighted_pairs(np.array([1, 2, 3]), np.array([1, 2, 0]), w) == (3 * 10**22, 4 * 10**11 * 5)


@pytest.mark.parametrize("touch", [False, True])
@pytest.mark.parametrize("hot_rows", [100_000, 2])
def test_overlaps_equal_all_pairs(spark, touch, hot_rows):
    r = random.Random(7)
    made = lambda n: [(i, r.choice(["a", "a", "b", None]), (s := r.randrange(0, 400) / 2), s + r.choice([0, 0.5, 3, 7, 50, 300, -1])) for i in range(n)]
    a, b = made(120) + [(900, "a", None, 3.0), (901, "a", 5.0, None)], made(90)
    span = (F.col("s"), F.col("e"))
    frame = lambda rows: spark.createDataFrame(rows, "i int, k string, s double, e double")
    pairs = overlap_join(frame(a), frame(b), on=["k"], left_span=span, right_span=span, width=5.0, touch=touch, hot_rows=hot_rows)
    got = sorted((x.left.i, x.right.i) for x in pairs.collect())

    def over(x, y):
        if None in (x[1], x[2], x[3], y[2], y[3]) or x[1] != y[1] or x[2] > x[3] or y[2] > y[3]:
            return False
        if touch:
            return x[2] <= y[3] and y[2] <= x[3]
        inside = lambda p, q: p[2] == p[3] and q[2] < p[2] < q[3]
        return (x[2] < y[3] and y[2] < x[3]) or inside(x, y) or inside(y, x)

    assert got == sorted((x[0], y[0]) for x in a for y in b if over(x, y))
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString() and "NestedLoop" not in pairs._jdf.queryExecution().toString()
    assert overlap_join(frame(a).limit(0), frame(b).limit(0), on=["k"], left_span=span, right_span=span, width=5.0).count() == 0


def test_spans_take_their_columns_from_the_table(spark):
    assert register_tables(spark) == ["fit_spans"]
    spark.createDataFrame([("x", 1, None), ("x", 2, "A"), ("x", 3, None), ("x", 4, "B"), ("y", 1, "A"), (None, 2, None)], "doc string, line int, head string").createOrReplaceTempView("span_lines")
    got = spark.sql("SELECT * FROM fit_spans(TABLE(span_lines), split_by => 'doc', order_by => 'line', header => 'head')")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc", "string"), ("head", "string"), ("first", "int"), ("last", "int"), ("n_rows", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("x", None, 1, 1, 1), ("x", "A", 2, 3, 2), ("x", "B", 4, 4, 1), ("y", "A", 1, 1, 1), (None, None, 2, 2, 1)], key=repr)
    with pytest.raises(Exception, match="must name a column"):
        spark.sql("SELECT * FROM fit_spans(TABLE(span_lines), split_by => 'none', order_by => 'line', header => 'head')").collect()


def test_stored_sketches_merge_and_replace_days(spark, tmp_path):
    rows = spark.range(200_000).select((F.col("id") % 5).alias("day"), (F.col("id") % 50_000).alias("user"), (F.col("id") % 1000).cast("double").alias("v"))
    path = str(tmp_path / "sketches")
    made = sketches.partial(rows, by=["day"], sets={"users": "user"}, quantiles={"amounts": "v"})
    sketches.store(made, path, day="day")
    sketches.store(made.where("day = 3"), path, day="day")
    days = sketches.stored(spark, path)
    assert days.count() == 5
    one = sketches.merged(days, by=[], sets=["users"], quantiles=["amounts"]).select("n", sketches.distinct("users").alias("u"), sketches.quantile("amounts", 0.9).alias("q"), sketches.rank("amounts", 250.0).alias("r")).first()
    assert one.n == 200_000 and abs(one.u - 50_000) < 1500 and abs(one.q - 900) < 20 and abs(one.r - 0.25) < 0.02
    sets = days.where("day = 0").select(F.col("users").alias("a")).join(days.where("day = 1").select(F.col("users").alias("b")))
    both = sets.select(sketches.distinct(sketches.both("a", "b")).alias("both"), sketches.distinct(sketches.only("a", "b")).alias("only"), sketches.distinct(F.lit(None).cast("binary")).alias("none")).first()
    assert (both.both, both.only, both.none) == (0, 10_000, 0)


def test_keys_with_few_rows_are_joined_without_bins(spark):
    r = random.Random(11)
    rows = [(k, i, s := r.randrange(60) / 2, s + r.choice([0, 1, 2, 30])) for i, k in enumerate([1] * 30 + [2] * 4 + [3] * 2 + [None] * 9)]
    frame = spark.createDataFrame(rows, "k int, id int, s double, e double")
    span = (F.col("s"), F.col("e"))
    join = lambda **more: overlap_join(frame, frame, on=["k"], left_span=span, right_span=span, width=1.0, touch=True, **more)
    pairs = lambda df: sorted((x["left"]["id"], x["right"]["id"]) for x in df.collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3])
    for few in (0, 3, 10, 256):
        assert pairs(join(few_rows=few)) == want, few
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan(join()) and "Generate" in plan(join(few_rows=3))
