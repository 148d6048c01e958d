"""Sketches of distinct counts, sets and quantiles that are stored in parts and merged later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Binary logarithm of the values that a set keeps: sets of fewer values are exact, larger ones within some 3 / sqrt(2**LG).
LG_SET = 14
#: Accuracy of quantiles: a rank is off by some 1.65 / K**0.9 at most.
K_QUANTILES = 400


def partial(rows: DataFrame, *, by: list[str], sets: dict[str, str | Column] | None = None, quantiles: dict[str, str | Column] | None = None) -> DataFrame:
    """(by, n, a binary column for each sketch) of each group: `sets` of values and `quantiles` of numbers, by name. Nulls are left out."""
    made = [F.theta_sketch_agg(c, LG_SET).alias(name) for name, c in (sets or {}).items()]
    made += [F.kll_sketch_agg_double(F.col(c) if isinstance(c, str) else c, F.lit(K_QUANTILES)).alias(name) for name, c in (quantiles or {}).items()]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *made)


def store(parts: DataFrame, path: str, *, day: str) -> None:
    """Write parts by day. A day that is there already is replaced, other days stay."""
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(parts: DataFrame, *, by: list[str], sets: list[str] = (), quantiles: list[str] = ()) -> DataFrame:
    """Parts put together by coarser keys, without the rows that they were made of."""
    made = [F.theta_union_agg(c, LG_SET).alias(c) for c in sets] + [F.kll_merge_agg_double(c, F.lit(K_QUANTILES)).alias(c) for c in quantiles]
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), *made)


def distinct(sketch: str | Column) -> Column:
    """The number of distinct values of a set; 0 for null."""
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0))


def both(a: str | Column, b: str | Column) -> Column:
    return F.theta_intersection(a, b)


def only(a: str | Column, b: str | Column) -> Column:
    """The values of the first set that the second has not."""
    return F.theta_difference(a, b)


def quantile(sketch: str | Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def rank(sketch: str | Column, value: float) -> Column:
    """The share of numbers up to a value."""
    return F.kll_sketch_get_rank_double(sketch, F.lit(float(value)))
