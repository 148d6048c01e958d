"""What a cluster needs to run this package's Python parts."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: they may not have it installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_fitspark_shipped", False):
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), package.name), "zip", package.parent, package.name)
        sc.addPyFile(archive)
        sc._fitspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where one machine is all."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return (path or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


#: Rows of a table that one task takes, where much is done with each.
TASK_ROWS = 5_000


def spread(rows: DataFrame, *, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows dealt to tasks of some `task_rows` each.

    A million short rows may be one row group of a file, and so one task, however much is
    done with each of them. They are counted first, which reads no column of a table.
    """
    tasks = -(-rows.count() // task_rows)
    return rows.repartition(tasks) if tasks > 1 else rows
