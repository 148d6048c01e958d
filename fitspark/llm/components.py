"""Connected components by contraction, with written rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitspark.llm.common import lean, ship, written

#: What is left of a graph is finished by one task from so many edges on (less than a megabyte); larger graphs are contracted first.
LAST_EDGES = 50_000


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to) of the components of a few edges, by union and find."""
    root: dict[int, int] = {}

    def top(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = root[i]
        return i

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = top(x), top(y)
            root[max(x, y)] = min(x, y)
    nodes = sorted(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array([top(i) for i in nodes], np.int64))], ["node", "to"])


def _moved(labels: DataFrame, step: DataFrame, rows: int) -> DataFrame:
    """The labels after a step that moves some of them."""
    moved = labels.join(step.select(F.col("node").alias("label"), "to"), "label", "left")
    return written(moved.select("node", F.coalesce("to", "label").alias("label")), "labels", rows=rows)


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph of `edges` (a, b: long).

    Returns (node, label), one row per node with an edge to another; label is a
    node of the same component. Each round lets every node point at the node of
    least random rank next to it, then contracts; ranks are dealt anew each
    round, so long chains shrink by a constant share. The last LAST_EDGES edges are
    finished by one task. Neighbour lists are never
    gathered: a node's choice is an aggregate with a partial sum on the map
    side. No edges: no rows.
    """
    e = written(edges.where("a is not null and b is not null and a != b").select("a", "b").distinct(), "edges")
    out, rounds, most = None, 0, 0
    while n := e.count():
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        if n <= LAST_EDGES:
            ship(e.sparkSession)
            step = written(e.coalesce(1).mapInArrow(lean(_finished), "node long, to long"), "choice")
            return _moved(out, step, most) if out is not None else step.select("node", F.col("to").alias("label"))
        both = e.union(e.select("b", "a"))
        rank = lambda c: F.xxhash64(F.col(c), F.lit(rounds))
        best = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"))
        step = written(best.select(F.col("a").alias("node"), F.when(rank("b") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("to")), "choice", rows=2 * n)
        # Labels are folded round by round, so that no plan grows with the rounds.
        if out is None:
            most, out = 2 * n, step.select("node", F.col("to").alias("label"))
        else:
            out = _moved(out, step, most)
        e = written(
            e.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta != tb")
            .select(F.col("ta").alias("a"), F.col("tb").alias("b"))
            .distinct(),
            "edges",
            rows=n,
        )
        rounds += 1
    return out or e.select(F.col("a").alias("node"), F.col("b").alias("label"))
