"""Exact duplicates by a Golomb-coded exchange of fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitspark.llm.common import KeyMap, key_map, lean, maybe_in, ship, strip_ws, text_of, written

#: Bits of an exchanged fingerprint; more make fewer false suspects.
FINGERPRINT_BITS = 48
#: Distinct fingerprints that one owner decodes at a time.
PER_OWNER = 2_000_000
#: Rows of a sender's block.
PER_BLOCK = 1_000_000
#: Fingerprints that a full block sends to each of its owners, on average, at least.
PER_MESSAGE = 1_000


def golomb_encode(values: np.ndarray, low: int, high: int) -> tuple[bytes, int]:
    """Sorted distinct integers of [low, high) as Rice-coded gaps: (code, Rice parameter)."""
    n = len(values)
    if n == 0:
        return b"", 0
    gaps = np.diff(values.astype(np.int64), prepend=low)
    k = max(0, int(math.log2(max(1.0, (high - low) / n * math.log(2)))))
    quotient = gaps >> k
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    rest = np.empty((n, k), np.uint8)
    for b in range(k):  # bit by bit, to need no array of n * k integers
        rest[:, b] = (gaps >> b) & 1
    return np.packbits(np.concatenate([unary, rest.ravel()])).tobytes(), k


def golomb_decode(code: bytes, n: int, k: int, low: int) -> np.ndarray:
    """The integers that golomb_encode() was given."""
    if n == 0:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:n] + 1
    quotient = np.diff(ends, prepend=0) - 1
    gaps = quotient.astype(np.int64) << k
    rest = bits[ends[-1] : ends[-1] + n * k].reshape(n, k)
    for b in range(k):
        gaps |= rest[:, b].astype(np.int64) << b
    return np.cumsum(gaps) + low


def _send(owners: int, width: int, per_block: int):
    """Blocks of a partition's sorted distinct fingerprints, one coded message to each owner that they have any for."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        name = 0

        def flush():
            fp, count = np.unique(np.concatenate([h[0] for h in held]), return_counts=True)
            cuts = np.searchsorted(fp, np.arange(owners + 1, dtype=np.int64) * width)
            out = []
            for o in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[o], cuts[o + 1])
                code, k = golomb_encode(fp[part], o * width, (o + 1) * width)
                out.append((o, name, int(cuts[o + 1] - cuts[o]), k, code, np.packbits(count[part] > 1).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["owner", "block", "n", "k", "code", "again"])

        for b in batches:
            if b.num_rows:
                fp, uid = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                if not held:
                    name = int(uid[0])  # unique, and the same when a lost task runs again over the written table
                held.append((fp, uid))
                if sum(len(h[0]) for h in held) >= per_block:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return blocks


def _owner(width: int):
    """An owner decodes what it was sent and answers each block with a bitmap of duplicates."""

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low = int(key[0]) * width
        sets = [golomb_decode(c, n, k, low) for c, n, k in zip(pdf["code"], pdf["n"], pdf["k"])]
        every, count = np.unique(np.concatenate(sets), return_counts=True)
        dup = every[count > 1]
        bitmaps = [np.packbits(np.isin(s, dup, assume_unique=True)).tobytes() for s in sets]
        return pd.DataFrame({"owner": pdf["owner"], "block": pdf["block"], "bitmap": bitmaps})

    return answer


def _suspects(width: int):
    """A block's fingerprints that its owner, or the block itself, has seen twice."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                bits = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8) | np.frombuffer(r["again"], np.uint8))[: r["n"]]
                fp = golomb_decode(r["code"], r["n"], r["k"], r["owner"] * width)[bits.astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64())], ["fp"])

    return marked


def by_group(light: DataFrame, n: int, owners: int, width: int, *, per_block: int = PER_BLOCK, per_message: int = PER_MESSAGE) -> DataFrame:
    """The rows of `light` (fp, uid), dealt so that a block has rows for per_block / per_message owners at most.

    So many owners are a group, a range of the fingerprints. One group needs no
    dealing. Of more, each gets partitions of its own, of some eight blocks each: then
    messages stay as large, and grow in number with the rows, not with their square.
    """
    in_group = max(1, per_block // per_message)
    groups = -(-owners // in_group)
    if groups == 1:
        return light.select("fp", "uid")
    each = max(1, -(-n // (groups * 8 * per_block)))
    group = F.expr(f"fp div {width * in_group}L")
    return light.select("fp", "uid").repartitionById(groups * each, (group * each + F.pmod("uid", F.lit(each))).cast("int"))


def exchanged(light: DataFrame, *, fingerprint_bits: int, per_owner: int, per_block: int, per_message: int) -> tuple[DataFrame, int]:
    """(messages, width): what partitions send to owners of ranges of this width, written."""
    n = light.count()
    owners = max(1, -(-n // per_owner))
    width = -(-(1 << fingerprint_bits) // owners)
    dealt = by_group(light, n, owners, width, per_block=per_block, per_message=per_message)
    return written(dealt.mapInArrow(lean(_send(owners, width, per_block)), "owner long, block long, n long, k int, code binary, again binary"), "blocks", light=True), width


def suspect_fingerprints(light: DataFrame, *, fingerprint_bits: int = FINGERPRINT_BITS, per_owner: int = PER_OWNER, per_block: int = PER_BLOCK, per_message: int = PER_MESSAGE) -> DataFrame:
    """Fingerprints that more than one row of `light` (fp, uid) has; a fingerprint may come several times."""
    ship(light.sparkSession)
    blocks, width = exchanged(light, fingerprint_bits=fingerprint_bits, per_owner=per_owner, per_block=per_block, per_message=per_message)
    replies = blocks.select("owner", "block", "n", "k", "code").groupBy("owner").applyInPandas(_owner(width), "owner long, block long, bitmap binary")
    return blocks.join(replies, ["owner", "block"]).mapInArrow(lean(_suspects(width)), "fp long")


def suspect_map(light: DataFrame, fingerprint_bits: int) -> KeyMap:
    """The suspects among `light` (fp, uid) as a map that picks their rows from a scan."""
    found = written(suspect_fingerprints(light, fingerprint_bits=fingerprint_bits).distinct(), "suspects")
    return key_map(found, "fp", found.count())


def exact_dedup(docs: DataFrame, *, fingerprint_bits: int = FINGERPRINT_BITS) -> DataFrame:
    """Group the rows of `docs` (doc_id, text, ...) whose texts are equal without white space.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    Of a group, the row with the most code points stays, then the smallest
    doc_id (null last), then the first row in the written table, so of repeated
    rows exactly one stays. Null text counts as empty; empty texts are equal.
    Other columns are ignored. No rows: no rows.

    1. A light table (ids, lengths, digests) is written once.
    2. Its partitions send their sorted distinct fingerprints, Golomb-coded, to
       owners of ranges of the fingerprints and get bitmaps of duplicates back.
       A hot group is one entry in each block, so no owner gets its rows. From some
       2 * 10**9 rows on, fingerprints are first dealt to groups of owners (by_group()).
    3. Suspects alone are shuffled for verification: texts are compared byte by
       byte by grouping on them, pre-aggregated on the map side. A map of
       bounded size picks the suspects from the scan; what it lets through besides
       forms groups of one.
    """
    text = text_of()
    norm = strip_ws(text)
    fp = F.expr(f"xxhash64(norm) & {(1 << fingerprint_bits) - 1}L")
    light = written(
        docs.select("doc_id", F.char_length(text).alias("n"), norm.alias("norm")).select("doc_id", "n", F.unhex(F.sha2("norm", 256)).alias("sha"), fp.alias("fp"), F.monotonically_increasing_id().alias("uid")),
        "light",
        light=True,
    )
    suspects = suspect_map(light, fingerprint_bits)
    texts = maybe_in(docs.select(norm.alias("norm")).select("norm", fp.alias("fp")), "fp", suspects, "suspect").where("suspect")
    verified = texts.groupBy("norm").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "size")
    marked = maybe_in(light, "fp", suspects, "suspect").where("suspect")
    first = marked.groupBy("sha").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("null"), "doc_id", "uid")).alias("keep"))
    groups = written(verified.join(first, "sha").select("sha", "size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.uid").alias("keep_uid")), "groups", rows=light.count())
    return light.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_documents(docs: DataFrame, *, fingerprint_bits: int = FINGERPRINT_BITS) -> DataFrame:
    """`docs` with one row of each group that exact_dedup() finds, by the same rule and exchange.

    Returns the columns of `docs`. Rows that no fingerprint makes suspect are not
    shuffled. Of suspects each task sends on one row of each text at most.
    """
    text = text_of("text")
    fp = F.expr(f"xxhash64(dedup_norm) & {(1 << fingerprint_bits) - 1}L")
    order = F.struct((-F.char_length(text)).alias("n"), F.col("doc_id").isNull().alias("null"), "doc_id")
    rows = docs.select(F.struct(*docs.columns).alias("dedup_row"), strip_ws(text).alias("dedup_norm"), order.alias("dedup_order")).withColumn("dedup_fp", fp)
    light = written(rows.select(F.col("dedup_fp").alias("fp"), F.monotonically_increasing_id().alias("uid")), "light", light=True)
    suspects = suspect_map(light, fingerprint_bits)
    marked = maybe_in(rows, "dedup_fp", suspects, "dedup_suspect")
    kept = marked.where("dedup_suspect").groupBy("dedup_norm").agg(F.min_by("dedup_row", "dedup_order").alias("dedup_row"))
    return marked.where("not dedup_suspect").select("dedup_row.*").union(kept.select("dedup_row.*"))
