"""Exact vector search that leaves out cells which cannot hold a result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitspark.cluster import ship
from fitspark.functions import arrays

#: Rows that centroids are fitted on, at most, and cells.
SAMPLE, CELLS = 20_000, 256
#: What rounding may add to a distance.
SLACK = 1e-6
#: The cell of vectors without a direction.
NOWHERE = -1


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centroids of directions by k-means from evenly spread rows; the same for the same sample."""
    points = unit(sample[np.linalg.norm(sample, axis=1) > 0])
    if not len(points):
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    centers = np.unique(points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)], axis=0)
    for _ in range(rounds):
        own = np.argmax(points @ centers.T - 0.5 * (centers**2).sum(1), axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centers))[:, None]
        centers = np.where(n > 0, sums / np.maximum(n, 1), centers)
    return centers


def _dealt(centers: np.ndarray, vector: str):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(b.schema.get_field_index(vector)).to_pylist()
            cell, away = np.full(len(rows), NOWHERE, np.int32), np.zeros(len(rows))
            fits = [i for i, v in enumerate(rows) if v is not None and len(v) == centers.shape[1] and None not in v and any(v)]
            if fits:
                p = unit(np.array([rows[i] for i in fits], float))
                own = np.argmax(p @ centers.T - 0.5 * (centers**2).sum(1), axis=1)
                cell[fits], away[fits] = own, np.linalg.norm(p - centers[own], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(away)], [*b.schema.names, "cell", "away"])

    return mapped


def build(vectors: DataFrame, path: str, *, vector: str = "vector", key: str = "embedding_id", cells: int = CELLS, sample: int = SAMPLE) -> None:
    """Write the vectors by cells, with each cell's centroid and radius beside them.

    Centroids are fitted on the `sample` rows of least hash of their key; every row gets a
    cell. Vectors of another length, with nulls or of zero length go to a cell that each search reads.
    """
    spark = vectors.sparkSession
    ship(spark)
    some = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key).alias("h")).orderBy("h").limit(sample).collect()
    width = max((len(r.v) for r in some), default=1)
    fitted = [r.v for r in some if len(r.v) == width and None not in r.v]
    centers = fit_centroids(np.array(fitted, float).reshape(-1, width), cells)
    schema = vectors.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("away")).schema
    dealt = vectors.mapInArrow(_dealt(centers, vector), schema)
    dealt.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    radii = stored.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    places = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
    radii.join(F.broadcast(places), "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")  # a row for each cell


def search(spark: SparkSession, path: str, asked: list[float], *, k: int, vector: str = "vector", key: str = "embedding_id") -> tuple[DataFrame, int, int]:
    """The k rows most similar to a vector, ties by key, as nearest() gives them; the cells read, and all cells.

    A point of a cell is no nearer than its centroid less the cell's radius. The cells whose
    bounds are least are read until they hold k rows; then those whose bound is
    within the distance of the kth. So no result is lost, whatever the centroids are; only
    the number of cells that are read depends on them.
    """
    q = np.array(asked, float)
    norm = float(np.linalg.norm(q))
    known = spark.read.parquet(f"{path}/cells").collect()  # bounded by CELLS
    bounds = sorted((max(0.0, float(np.linalg.norm(q / (norm or 1) - np.array(c.center))) - c.radius - SLACK) if c.cell != NOWHERE and norm and len(c.center) == len(q) else 0.0, c.cell, c.n) for c in known)
    rows = spark.read.parquet(f"{path}/rows")
    scored = rows.withColumn("similarity", arrays.cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in asked))))
    best = lambda read: scored.where(F.col("cell").isin(read)).orderBy(F.desc("similarity"), F.col(key)).limit(k)
    first, held = [], 0
    for bound, cell, n in bounds:
        if held >= k and bound > 0:
            break
        first.append(cell)
        held += n
    least = best(first).agg(F.min("similarity")).first()[0] if held >= k else None
    # Unit vectors of cosine s are sqrt(2 - 2 s) apart. A cosine of 0 or less leaves those without a direction, which are read anyway.
    reach = float("inf") if least is None else float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    read = [cell for bound, cell, _ in bounds if bound <= reach]
    return best(read).drop("cell", "away"), len(read), len(known)
