"""Top-k, leaderboards and ordered splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fitspark.functions import arrays


def nearest(vectors: DataFrame, asked: Column, *, k: int, vector: str = "vector", key: str = "embedding_id") -> DataFrame:
    """The k rows most similar to the asked vector, ties by key. Filter before calling: filters apply before the top-k."""
    return vectors.withColumn("similarity", arrays.cosine(F.col(vector), asked)).orderBy(F.desc("similarity"), F.col(key)).limit(k)


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank. Spark drops the others before the shuffle, too."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def leaderboard(rows: DataFrame, *, score: str, key: str, lists: dict[str, str] | None = None, limit: int) -> DataFrame:
    """The best `limit` rows with ranks; arrays become text, an empty one a dash.

    The limit comes first, as a distributed top-k; only what is left is numbered.
    """
    top = rows.orderBy(F.desc(score), F.col(key)).limit(limit)
    out = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), F.col(key))))
    for name, column in (lists or {}).items():
        out = out.withColumn(name, F.when(F.size(column) > 0, F.array_join(column, ", ")).otherwise(F.lit("—")))
    return out


def heaviest(signals: Column, k: int) -> Column:
    """An array of signals (weight, pos, ...) by weight, ties by place: struct<must, nice> of the first k and the rest."""
    ordered = F.array_sort(signals, lambda a, b: F.when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).otherwise(a["pos"].cast("int") - b["pos"].cast("int")))
    return F.struct(F.slice(ordered, 1, k).alias("must"), F.slice(ordered, k + 1, 1 << 30).alias("nice"))


def split_status(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are ok, and the others."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return outcomes.where(ok), outcomes.where(~ok)
