"""Shared pieces: white space, null text, written intermediate tables, row bitmaps."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitspark.cluster import shared_dir, ship

#: ASCII white space: space and U+0009 to U+000D.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"

#: Rows and bytes of an Arrow batch at most: texts may be very long.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: A map of rows has 16 bits for each key, but 2**MAX_BITS bits (32 MB) at most.
MAX_BITS, LEAST_BITS = 28, 15


def text_of(col: str | Column = "text") -> Column:
    """The text with null as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_ws(c: Column) -> Column:
    return F.translate(c, WS_CHARS, "")


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/fitspark/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows for each file of a written table whose number of rows is known.
FILE_ROWS = 50_000


def written(df: DataFrame, label: str, *, rows: int | None = None, light: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder.

    It cuts lineage and survives the loss of any executor. discard() removes it. `rows` is a bound of their number after a
    shuffle: small tables then become few files, however many partitions there are.
    `light` says that a scan of texts leaves some bytes of each: they are dealt anew
    to partitions of the advisory size, so that a table of them is no file for each
    partition of the scan.
    """
    spark = df.sparkSession
    if light:
        df = df.hint("rebalance")
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Remove all tables that written() has made for this application in the shared folder; results that still read them must be stored before. Other applications' tables stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of an Arrow batch of texts, for an operator that runs Python.

    Spark reads the bounds when a result is computed, so they stay with the session.
    """
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


#: mallopt() settings of glibc: blocks from this size on are mapped, so that freeing them gives them back at once.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD, MAPPED_BYTES = -1, -3, 1 << 17


def lean(mapped: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow() in a worker that gives memory back to the system.

    A Python worker serves many stages, and its allocators keep what the largest
    of them took; beside a JVM with its heap that adds up. Elsewhere than on glibc
    only Arrow's pool is changed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        libc = ctypes.CDLL(None)
        for option in (M_TRIM_THRESHOLD, M_MMAP_THRESHOLD):
            if hasattr(libc, "mallopt"):
                libc.mallopt(option, MAPPED_BYTES)
        yield from mapped(batches)
        gc.collect()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return run


@dataclass
class KeyMap:
    """A one-hash membership map of 64-bit keys, which lets a scan tell most rows that have none of them."""

    rows: DataFrame
    bits: int


#: Bits of a row of a map, which is what bitmap_construct_agg() makes.
CHUNK = 15


def key_map(keys: DataFrame, key: str, n: int, *, bits: int | None = None) -> KeyMap:
    """A map of the column `key` of `keys`, which are about `n`, as 4 kB rows (bm_chunk, bm_bits).

    Its size goes by the number of keys up to 2**MAX_BITS bits; a broadcast of it
    is never larger than 32 MB. With more than some 10**8 keys it fills up: then
    more rows pass than need to, up to all, and never fewer.
    """
    bits = bits or min(MAX_BITS, max(LEAST_BITS, 4 + (max(1, n) - 1).bit_length()))
    slot = F.expr(f"{key} & {(1 << bits) - 1}L")
    slots = keys.select(slot.alias("bm_slot")).select(F.shiftright("bm_slot", CHUNK).alias("bm_chunk"), F.expr(f"bm_slot & {(1 << CHUNK) - 1}L").alias("bm_at"))
    # Chunks are put together where their slots have been dealt to: partial chunks of every task would be larger than the slots.
    return KeyMap(slots.repartition("bm_chunk").groupBy("bm_chunk").agg(F.bitmap_construct_agg("bm_at").alias("bm_bits")), bits)


def maybe_in(rows: DataFrame, key: str, known: KeyMap, flag: str) -> DataFrame:
    """Add `flag`: true for every key that was put into the map, and for few others."""
    chunk = F.expr(f"shiftright({key} & {(1 << known.bits) - 1}L, {CHUNK})")
    at = F.expr(f"cast({key} & {(1 << CHUNK) - 1}L as int)")
    byte = F.conv(F.hex(F.substring("bm_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    return rows.join(F.broadcast(known.rows), chunk == F.col("bm_chunk"), "left").withColumn(flag, hit).drop("bm_chunk", "bm_bits")
