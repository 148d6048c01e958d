"""Exact quantiles of the groupings of a cube, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of values that are counted before any value is looked at.
BINS = 256


def groupings(by: list[str]) -> Column:
    """The groupings of a cube that a row is in: array<struct<level, by...>>; level is Spark's grouping_id()."""
    of = lambda level: F.struct(F.lit(level).cast("long").alias("level"), *(F.when(F.lit((level >> (len(by) - 1 - i)) & 1 == 0), F.col(c)).alias(c) for i, c in enumerate(by)))
    return F.array(*(of(level) for level in range(1 << len(by))))


def _bin(value: Column, edges: list[float], low: int = 0) -> Column:
    """The number of edges below the value, by a tree of comparisons."""
    if not edges:
        return F.lit(low)
    m = len(edges) // 2
    return F.when(value <= F.lit(edges[m]), _bin(value, edges[:m], low)).otherwise(_bin(value, edges[m + 1 :], low + m + 1))


def cube_quantile(rows: DataFrame, *, by: list[str], value: str, p: float, bins: int = BINS) -> DataFrame:
    """(level, by..., quantile): the exact quantile of a column in each grouping of a cube, interpolated as percentile() does.

    Values are counted by range first. Of each grouping only the ranges that hold its
    quantile are then looked at, each value once however often it occurs, so a task has
    some rows / bins of them at most. Ranges are edges of approximate quantiles, which
    decide where values are counted, not what is found. The groupings that are
    looked at, two rows for each at most, are broadcast: they must be few. Null values
    do not count; a grouping without others has no row.
    """
    some = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    edges = some.agg(F.percentile_approx("_v", [i / bins for i in range(1, bins)], 10 * bins)).first()[0] or []
    some = some.withColumn("_bin", _bin(F.col("_v"), sorted(set(edges))))
    keys = ["level", *by]
    each = some.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n")).select("_bin", "_n", F.inline(groupings(by)))
    counted = each.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    upto = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    at = (F.sum("_n").over(W.partitionBy(*keys)) - 1) * F.lit(float(p))
    ranked = counted.select(*keys, "_bin", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), "_n", at.alias("_at"))
    # Rows are numbered from 0; the quantile stands between two of them.
    holds = lambda before, n: (F.ceil("_at") >= F.col(before)) & (F.floor("_at") < F.col(before) + F.col(n))
    wanted = ranked.where(holds("_before", "_n")).select(*(F.col(k).alias(f"w_{k}") for k in keys), F.col("_bin").alias("w_bin"), "_before", "_at")
    placed = some.select("_bin", "_v", F.inline(groupings(by)))
    same = F.col("_bin") == F.col("w_bin")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"w_{k}"))
    values = placed.join(F.broadcast(wanted), same).groupBy(*keys, "_bin", "_v", "_before", "_at").agg(F.count(F.lit(1)).alias("_n"))
    within = W.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    found = values.withColumn("_first", F.col("_before") + F.sum("_n").over(within) - F.col("_n")).where(holds("_first", "_n"))
    ends = found.groupBy(*keys, "_at").agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    share = F.col("_at") - F.floor("_at")
    return ends.select(*keys, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - share) * F.col("low") + share * F.col("high")).alias("quantile"))
