"""Stored entities: logs of versions in Parquet, read as the latest version of each key."""

from __future__ import annotations

import os
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitspark.operators.matching import latest
from fitspark.operators.ranking import nearest
from fitspark.schemas import TABLES

KEYS = {name: schema.fieldNames()[0] for name, schema in TABLES.items()}


def new_id(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:10]}"


def now_iso() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def folder_name(model: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "_", model)


#: What marks a version and, for vectors, the partition that a search reads.
VERSION, MODEL, DIM = "_version", "_model", "_dim"


class Store:
    """Entities under a path. Saving appends a version; nothing is rewritten, so a writer that dies leaves the old one.

    A table is one or more folders, which a small file beside them names; the last
    takes new versions. Vectors are keyed by id within their model and length.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, table: str, rows: DataFrame | list[dict]) -> None:
        """Upsert whole rows by the table's key. Of rows with one key in one call, any one counts."""
        schema = TABLES[table]
        if isinstance(rows, list):
            rows = self.spark.createDataFrame([tuple(r.get(f) for f in schema.fieldNames()) for r in rows], schema)
        have = [c for c in schema.fieldNames() if c in rows.columns]
        full = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
        if table == "embeddings":
            wrong = F.concat(F.lit("vector of embedding "), F.col("embedding_id"), F.lit(" has not the length of its dim"))
            full = full.withColumn("vector", F.when(F.size("vector") == F.col("dim"), F.col("vector")).otherwise(F.raise_error(wrong)))
        version = F.lit(datetime.now(timezone.utc).timestamp() * 1e6).cast("long")
        self._append(full.withColumn(VERSION, version), table, self._folders(table)[-1])

    def _append(self, rows: DataFrame, table: str, folder: str) -> None:
        if table == "embeddings":
            rows.withColumn(MODEL, F.regexp_replace("embedding_model", "[^A-Za-z0-9]", "_")).withColumn(DIM, F.col("dim")).write.mode("append").partitionBy(MODEL, DIM).parquet(f"{self.path}/{table}/{folder}")
        else:
            rows.write.mode("append").parquet(f"{self.path}/{table}/{folder}")

    def _hadoop(self):
        """(Path class, file system of the store)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, table: str) -> list[str]:
        path, system = self._hadoop()
        listing = f"{self.path}/{table}.folders"
        return [r["value"] for r in self.spark.read.text(listing).collect()] if system.exists(path(listing)) else ["v0"]

    def _versions(self, table: str, keep: Column | None = None) -> DataFrame:
        """All versions; `keep` may prune partitions, as it comes before versions are compared."""
        path, system = self._hadoop()
        there = [f for f in (f"{self.path}/{table}/{x}" for x in self._folders(table)) if system.exists(path(f))]
        schema = T.StructType([*TABLES[table].fields, T.StructField(VERSION, T.LongType()), *([T.StructField(MODEL, T.StringType()), T.StructField(DIM, T.IntegerType())] if table == "embeddings" else [])])
        rows = self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)
        return rows if keep is None else rows.where(keep)

    def _latest(self, table: str, keep: Column | None = None) -> DataFrame:
        keys = [KEYS[table], MODEL, DIM] if table == "embeddings" else [KEYS[table]]
        return latest(self._versions(table, keep), keys=keys, order=[F.desc(VERSION)])

    def read(self, table: str) -> DataFrame:
        """The latest version of every row; no rows before the first save."""
        return self._latest(table).select(*TABLES[table].fieldNames())

    def get(self, table: str, key: str) -> dict | None:
        """A row by its key; the filter comes before versions are compared, so it is pushed down."""
        row = self._latest(table, F.col(KEYS[table]) == key).select(*TABLES[table].fieldNames()).first()
        return row.asDict() if row else None

    def list(self, table: str, workspace_id: str | None = None) -> DataFrame:
        """Rows of a workspace by creation, ties by key."""
        rows = self.read(table)
        if workspace_id is not None:
            rows = rows.where(F.col("workspace_id") == workspace_id)
        return rows.orderBy("created_at", KEYS[table])

    def search(self, vector: list[float], *, model: str, workspace_id: str | None = None, owner_type: str | None = None, top_k: int = 5) -> DataFrame:
        """The most similar vectors of this model and length, of whose partition alone anything is read. Filters come before the top-k, so it never returns too few."""
        rows = self._latest("embeddings", (F.col(MODEL) == folder_name(model)) & (F.col(DIM) == len(vector))).where(F.col("embedding_model") == model).select(*TABLES["embeddings"].fieldNames())
        for name, value in (("workspace_id", workspace_id), ("owner_type", owner_type)):
            if value is not None:
                rows = rows.where(F.col(name) == value)
        return nearest(rows, F.array(*(F.lit(float(x)) for x in vector)), k=top_k)

    def clean(self, table: str) -> None:
        """Keep only the latest versions.

        They are written to a new folder, then a list that names it replaces the old
        one in one step, then the files that went in are deleted. A reader always
        finds a list; versions that are saved meanwhile go to the old folder, which
        stays on the list until a later clean-up finds it empty.
        """
        path, system = self._hadoop()
        names = self._folders(table)
        used = {f: self._files(f"{self.path}/{table}/{f}") for f in names}
        files = [x for some in used.values() for x in some]
        if not files:
            return
        new = f"v-{uuid.uuid4().hex}"
        self._append(self._latest(table).select(*TABLES[table].fieldNames(), VERSION), table, new)
        stay = [f for f in names if used[f]]
        listing, draft = f"{self.path}/{table}.folders", f"{self.path}/{table}.folders-{new}"
        out = system.create(path(draft), True)
        out.write("\n".join([*stay, new]).encode())
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        context = jvm.FileContext.getFileContext(system.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(jvm, "Options$Rename")
        overwrite = self.spark.sparkContext._gateway.new_array(rename, 1)
        overwrite[0] = rename.OVERWRITE
        context.rename(path(draft), path(listing), overwrite)
        for f in files:
            system.delete(path(f), False)

    def _files(self, folder: str) -> list[str]:
        path, system = self._hadoop()
        if not system.exists(path(folder)):
            return []
        found, it = [], system.listFiles(path(folder), True)
        while it.hasNext():
            f = it.next().getPath().toString()
            if f.endswith(".parquet") and "/_temporary/" not in f:
                found.append(f)
        return found


def ensure_schema(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the stored tables in a catalog, in dependency order, unless they are there; returns their names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, schema in TABLES.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")
    return list(TABLES)


def open_store(spark: SparkSession, config: dict | None = None) -> Store:
    """A store by configuration, else the environment's STORE_PATH, else the session's warehouse; kinds are parquet and memory."""
    config = config or {}
    kind = (config.get("backend") or os.environ.get("STORE_BACKEND") or "parquet").lower()
    if kind not in ("parquet", "duckdb", "persistent", "memory", "mem"):
        raise ValueError(f"unknown store backend: {kind}")
    path = config.get("path") or os.environ.get("STORE_PATH") or spark.conf.get("spark.sql.warehouse.dir")
    if kind in ("memory", "mem"):
        path = f"{path}/session-{spark.sparkContext.applicationId}"
    return Store(spark, f"{path}/fitspark-store" if not config.get("path") else path)


def with_ids(rows: DataFrame, name: str, prefix: str) -> DataFrame:
    """Add a new identifier to each row. It differs on every evaluation: write before using it twice."""
    return rows.withColumn(name, F.concat(F.lit(f"{prefix}_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 10)))


def as_json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})
