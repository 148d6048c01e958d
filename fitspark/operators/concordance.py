"""Concordant and discordant pairs of two columns, exactly, without comparing pairs."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitspark.cluster import ship

#: Rows of a group that one task ranks, about; larger groups are cut into blocks of values.
BLOCK_ROWS, MOST_BLOCKS = 1_000_000, 1024


def dense_ranks(v: np.ndarray) -> np.ndarray:
    return np.unique(v, return_inverse=True)[1]


def weighted_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[int, int]:
    """(concordant, discordant) of points with weights, in O(n log n) for each bit of the ranks of y.

    A tree of counts by rank range: at each of its levels, a node's points stand in
    the order of x, and each point of the right half counts the weight of the left
    half before it. Pairs that are tied in x or y count for neither.
    """
    if len(x) < 2:
        return 0, 0
    x, y = dense_ranks(x), dense_ranks(y)
    whole = int(sum(map(int, w))) if w.dtype == object else int(w.sum())
    w = w.astype(object if whole * whole >= 2**62 else np.int64)
    total = lambda a: int(a.sum())
    sums = lambda k: np.array([w[k == i].sum() for i in range(k.max() + 1)], object) if w.dtype == object else np.bincount(k, w).astype(np.int64)
    # Of equal x the larger y stands first, so that no such pair counts.
    order = np.lexsort((-y, x))
    y_at, w_at = y[order], w[order]
    concordant = 0
    for bit in reversed(range(int(y.max()).bit_length())):
        right = (y_at >> bit) & 1 == 1
        node = y_at >> (bit + 1)
        left_before = np.cumsum(np.where(right, 0, w_at))
        begins = np.flatnonzero(np.diff(node, prepend=-1))
        base = np.concatenate([[0], left_before])[begins]
        before = left_before - np.repeat(base, np.diff(begins, append=len(node)))
        concordant += total(w_at[right] * before[right])
        deal = np.argsort(y_at >> bit, kind="stable")
        y_at, w_at = y_at[deal], w_at[deal]
    same = dense_ranks(x.astype(np.int64) * (int(y.max()) + 1) + y)
    untied = (whole**2 - sum(int(v) ** 2 for v in sums(x)) - sum(int(v) ** 2 for v in sums(y)) + sum(int(v) ** 2 for v in sums(same))) // 2
    return concordant, untied - concordant


def gamma(a: pd.Series, b: pd.Series) -> float:
    """Goodman and Kruskal's gamma of two columns of a group; 0 without a pair that is tied in neither."""
    known = a.notna() & b.notna()
    c, d = weighted_pairs(a[known].to_numpy(), b[known].to_numpy(), np.ones(int(known.sum()), np.int64))
    return (c - d) / (c + d) if c + d else 0.0


def _local(pdf: pd.DataFrame) -> tuple[int, int]:
    return weighted_pairs(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())


def _grid(pdf: pd.DataFrame) -> tuple[int, int]:
    """Pairs of cells that differ in both blocks, from sums over all cells before."""
    i, j = dense_ranks(pdf["x"].to_numpy()), dense_ranks(pdf["y"].to_numpy())
    cells = np.zeros((i.max() + 1, j.max() + 1), object)
    cells[i, j] = [int(v) for v in pdf["w"]]
    before = np.zeros((cells.shape[0] + 1, cells.shape[1] + 1), object)
    before[1:, 1:] = cells.cumsum(0).cumsum(1)
    concordant = (cells * before[:-1, :-1]).sum()
    discordant = (cells * (before[:-1, -1:] - before[:-1, 1:])).sum()
    return int(concordant), int(discordant)


def _counts(count, by: list[str]):
    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c, d = count(pdf)
        return pd.DataFrame({**dict(zip(by, ([k] for k in key))), "c": [Decimal(c)], "d": [Decimal(d)]})

    return of


def concordance(rows: DataFrame, *, by: list[str], a: str, b: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(by, n, concordant, discordant, gamma) of the columns a and b of each group, exactly.

    Rows with a null in either do not count; a group without any other is not there.
    Ties count for neither. gamma is null without a pair that is tied in neither.

    Equal rows become one with a weight first. A group of more than `block_rows`
    is cut at quantiles of a and of b, where a value that is an edge is a block by
    itself: a value that many rows have is tied with itself and needs no count. Pairs
    in two blocks of both are counted from the cells of the grid, other pairs
    within one block of a, or within one of b, by tasks of their own. Quantiles
    are approximate, but any edges give the same counts.
    """
    ship(rows.sparkSession)
    keys = [F.col(c).alias(f"g{i}") for i, c in enumerate(by)] or [F.lit(True).alias("g0")]  # all rows are one group
    g = [f"g{i}" for i in range(len(keys))]
    w = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("w"))
    sizes = w.groupBy(*g).agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("points"))
    most = sizes.agg(F.max("points")).first()[0] or 0
    n_blocks = min(MOST_BLOCKS, -(-most // block_rows))
    if n_blocks > 1:
        shares = [i / n_blocks for i in range(1, n_blocks)]
        edges = w.groupBy(*g).agg(F.array_distinct(F.percentile_approx("x", shares, 10_000)).alias("ex"), F.array_distinct(F.percentile_approx("y", shares, 10_000)).alias("ey"))
        cut = w.join(edges, g)
    else:
        cut = w.withColumns({"ex": F.array(F.lit(None).cast(w.schema["x"].dataType)), "ey": F.array(F.lit(None).cast(w.schema["y"].dataType))})

    def block(edges: str, v: str) -> Column:
        below = F.size(F.filter(F.col(edges), lambda e: e < F.col(v)))
        return 2 * below + F.coalesce(F.array_contains(edges, F.col(v)), F.lit(False)).cast("int")

    cut = cut.select(*g, "x", "y", "w", block("ex", "x").alias("xb"), block("ey", "y").alias("yb"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in w.select(*g).schema) + ", c decimal(38,0), d decimal(38,0)"
    cells = cut.groupBy(*g, F.col("xb").alias("x"), F.col("yb").alias("y")).agg(F.sum("w").alias("w"))
    parts = cells.groupBy(*g).applyInPandas(_counts(_grid, g), schema)
    # An edge's block has one value: all its pairs are tied.
    within = cut.where("xb % 2 = 0").select(*g, "xb", "x", "y", "w")
    parts = parts.union(within.groupBy(*g, "xb").applyInPandas(_counts(_local, g), schema))
    across = cut.where("yb % 2 = 0").groupBy(*g, "yb", F.col("xb").alias("x"), "y").agg(F.sum("w").alias("w"))
    parts = parts.union(across.groupBy(*g, "yb").applyInPandas(_counts(_local, g), schema))
    pairs = parts.groupBy(*g).agg(F.sum("c").cast("decimal(38,0)").alias("c"), F.sum("d").cast("decimal(38,0)").alias("d"))
    out = sizes.join(pairs, g)
    named = [F.col(f"g{i}").alias(c) for i, c in enumerate(by)]
    return out.select(*named, "n", F.col("c").alias("concordant"), F.col("d").alias("discordant"), F.try_divide((F.col("c") - F.col("d")).cast("double"), (F.col("c") + F.col("d")).cast("double")).alias("gamma"))
