"""Mix sources to target weights by splitting exact block quotas among output shards."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitspark.llm.common import WORD, ship, text_of, written

#: Blocks of a source at most; each is the documents that a hash deals to it.
BLOCKS = 2048
#: Blocks of all sources at most; with many sources, each has fewer. It bounds the sources, too.
ALL_BLOCKS = 400_000
#: Documents of a part of a block, where blocks are larger than that. Of a block taken in part, all parts but one are taken whole or not.
PART_DOCS = 4096
#: Documents of a block that a source needs before it gets another block.
BLOCK_DOCS = 8
#: Single documents that are added to a block taken in part.
MORE = 32
SHARDS = 16
SHARE = 1.5
MOST_REPEATS = 2
WEIGHTS = (3, 1, 2)


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_REPEATS) -> list[float]:
    """Split `total` by weight, but give no source more than `most` times its size.

    What is above goes to the others by weight, until none is above.
    """
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        weight = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not above:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in above)
        open_ -= above
    return out


def _rng(*what: object) -> np.random.Generator:
    """A generator that depends on nothing but its arguments."""
    return np.random.default_rng(list(hashlib.sha256(repr(what).encode()).digest()))


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Exact block quotas by source, split among shards: an array (shards, sources).

    A node of the tree has a range of shards and the quotas that fall to it; its
    left child's quotas are a multivariate hypergeometric draw. Shards get equal
    numbers of blocks, but for one; columns sum to `quotas`.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(lo: int, hi: int, quota: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = quota
            return
        mid = (lo + hi) // 2
        left = int(quota.sum()) * (mid - lo) // (hi - lo)
        drawn = _rng(seed, "split", lo, hi).multivariate_hypergeometric(quota, left, method="marginals") if left else np.zeros_like(quota)
        node(lo, mid, drawn)
        node(mid, hi, quota - drawn)

    node(0, shards, np.array(quotas, np.int64))
    return out


@dataclass
class Plan:
    """sources: (source, source_size, target); blocks: (source, block, copies, shards); partial: (source, block, words), later (source, block, part, cut, more)."""

    sources: pd.DataFrame
    blocks: pd.DataFrame
    partial: pd.DataFrame
    counts: pd.DataFrame


def plan_mix(blocks: pd.DataFrame, counts: pd.DataFrame, *, share: float, weights: tuple[float, ...], shards: int, seed: int) -> Plan:
    """Decide on whole blocks from their sizes (source, block, size).

    A source's full passes take all its blocks. Of the rest of its target,
    permuted blocks are taken as long as one fits; the block that comes nearest to
    what is still missing is then taken in part, by its documents.
    """
    names = sorted(counts["source"], key=lambda s: (s is None, (s or "").encode()))
    by = {s: g for s, g in blocks.groupby("source", dropna=False, sort=False)} if len(blocks) else {}
    by = {None if not isinstance(k, str) else k: g for k, g in by.items()}
    sizes = [int(by[s]["size"].sum()) for s in names]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes))
    rows, partial, cuts = [], [], [0]
    for s, size, goal in zip(names, sizes, target):
        g = by[s].sort_values("block")
        block, words = g["block"].to_numpy(), g["size"].to_numpy()
        passes = int(goal // size) if size else 0
        copies = np.full(len(block), passes)
        rest = goal - passes * size
        held = None
        for i in _rng(seed, "blocks", s).permutation(len(block)):
            if words[i] <= rest:
                copies[i] += 1
                rest -= words[i]
            elif held is None or words[i] < words[held]:
                held = i
        if held is not None and rest >= 1:
            partial.append((s, int(block[held]), float(rest)))
        rows += [(s, int(b), int(c)) for b, c in zip(block, copies)]
        cuts.append(len(rows))
    taken = pd.DataFrame(rows, columns=["source", "block", "copies"])
    # Each shard draws its quota of a source's permuted block copies; the ranges are disjoint.
    copies = taken["copies"].to_numpy()
    quotas = [int(copies[a:b].sum()) for a, b in zip(cuts, cuts[1:])]
    split = split_quotas(quotas, shards, seed)
    shard_of = np.full((len(taken), MOST_REPEATS + 1), -1, np.int64)
    for k, (s, a, b) in enumerate(zip(names, cuts, cuts[1:])):
        draws = [(i, c) for i in range(a, b) for c in range(copies[i])]
        owner = np.repeat(np.arange(shards), split[:, k])
        for (i, c), o in zip((draws[j] for j in _rng(seed, "draw", s).permutation(len(draws))), owner):
            shard_of[i, c] = o
    taken["shards"] = [[int(x) for x in row if x >= 0] for row in shard_of]
    return Plan(pd.DataFrame({"source": pd.Series(names, dtype=object), "source_size": sizes, "target": target}), taken, pd.DataFrame(partial, columns=["source", "block", "words"]), counts)


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the last part of a block gives: its documents up to a number in permuted order, and a few more that fit.

    A number and at most MORE keys stand for the choice, whatever the part's size.
    """
    pdf = pdf.sort_values(["deal", "row_key"])
    size, key, left = pdf["size"].to_numpy(), pdf["row_key"].to_numpy(), float(pdf["words"].iat[0])
    n = int(np.searchsorted(np.cumsum(size), left, side="right"))
    left -= size[:n].sum()
    more: list[int] = []
    for i in range(n, len(size)):
        if 0 < size[i] <= left and len(more) < MORE:
            more.append(int(key[i]))
            left -= size[i]
    others = [i for i in range(n, len(size)) if size[i] > 0 and int(key[i]) not in more]
    if others and size[near := min(others, key=lambda i: size[i])] < 2 * left:  # over by less than it is short of now
        more.append(int(key[near]))
    return pd.DataFrame({"source": [pdf["source"].iat[0]], "block": [int(pdf["block"].iat[0])], "part": [int(pdf["part"].iat[0])], "cut": [int(pdf["deal"].iat[n - 1]) if n else -(2**63)], "more": [more]})


def _keyed(docs: DataFrame, text, names: list[str] | None = None) -> DataFrame:
    """Light columns of each row: its words, its key (equal for repeated rows only) and a number that deals it."""
    key = F.xxhash64(F.col("doc_id").cast("string"), text, F.col("source").cast("string"))
    return docs.select(*(names or []), F.col("source").cast("string").alias("mix_source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("mix_size"), key.alias("mix_key"), F.xxhash64(key, F.lit(7)).alias("mix_deal"))


def _blocks_of(spark: SparkSession, counts: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(list(zip(counts["source"], counts["n_blocks"], counts["n_parts"])), "source string, n_blocks long, n_parts long")


def _block(blocks_of: DataFrame, rows: DataFrame) -> DataFrame:
    """Add mix_block, the deal scaled to the number of the source's blocks, and n_parts of each."""
    b = blocks_of.select(F.col("source").alias("bs"), "n_blocks", "n_parts")
    return rows.join(F.broadcast(b), F.col("mix_source").eqNullSafe(F.col("bs")), "left").drop("bs").withColumn("mix_block", F.pmod("mix_deal", "n_blocks"))


def mix(docs: DataFrame, *, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, shards: int = SHARDS, seed: int = 17, max_blocks: int = BLOCKS) -> tuple[DataFrame, Plan]:
    """Decide how often each row of `docs` (doc_id, text, source, ...) is taken.

    Returns (light, plan): light has doc_id, mix_source, mix_size, mix_key,
    mix_block, mix_shards (the output shard of each copy) and mix_copies. Sizes are words; null text has none. Sources
    are ordered by code point, null last, and weigh `weights` in turn; the mix has
    `share` times all words; no source gives more than twice its own. A source of
    no words gives none. Equal rows (doc_id, text, source) are taken alike; those
    of a block that is taken in part are taken all or not. Null doc_id is as good
    as any. No rows: no rows. Reruns agree, as everything is dealt by hashes.

    The driver holds one row for each source and at most `max_blocks` for its
    blocks, ALL_BLOCKS in all, and one for each PART_DOCS documents of a block taken in part; more sources than that are
    an error. A hot source is dealt to blocks like any other; no task holds more than one part of a block.
    """
    spark = docs.sparkSession
    ship(spark)
    light = written(_keyed(docs, text_of(), ["doc_id"]), "sizes", light=True)
    counts = light.groupBy(F.col("mix_source").alias("source")).agg(F.count(F.lit(1)).alias("n")).limit(ALL_BLOCKS + 1).toPandas()
    if len(counts) > ALL_BLOCKS:
        raise ValueError(f"more than {ALL_BLOCKS} sources: group them before mixing")
    max_blocks = max(1, min(max_blocks, ALL_BLOCKS // max(1, len(counts))))
    counts["source"] = counts["source"].astype(object).where(counts["source"].notna(), None)
    counts["n_blocks"] = [int(min(max_blocks, max(1, n // BLOCK_DOCS))) for n in counts["n"]]
    counts["n_parts"] = [int(max(1, n // b // PART_DOCS)) for n, b in zip(counts["n"], counts["n_blocks"])]
    blocks_of = _blocks_of(spark, counts)
    placed = _block(blocks_of, light)
    sums = placed.groupBy(F.col("mix_source").alias("source"), F.col("mix_block").alias("block")).agg(F.sum("mix_size").alias("size")).toPandas()
    sums["source"] = sums["source"].astype(object).where(sums["source"].notna(), None)
    plan = plan_mix(sums, counts, share=share, weights=weights, shards=shards, seed=seed)
    partial = spark.createDataFrame(_rows_of(plan.partial), "ps string, pb long, words double")
    asked = placed.join(F.broadcast(partial), F.col("mix_source").eqNullSafe(F.col("ps")) & (F.col("mix_block") == F.col("pb"))).withColumn("part", _part())
    # Equal rows are one item of the partial block.
    names = [F.col("mix_source").alias("source"), F.col("mix_block").alias("block"), "part"]
    parts = asked.groupBy(*names, "words").agg(F.sum("mix_size").alias("size"))
    # The parts before the one that the target falls into are taken whole: as many rows as a source has parts go to the driver.
    last = _last_parts(parts.toPandas())
    wanted = spark.createDataFrame(_rows_of(last), "ls string, lb long, lp long, rest double")
    fill = (
        asked.drop("words").join(F.broadcast(wanted), F.col("mix_source").eqNullSafe(F.col("ls")) & (F.col("mix_block") == F.col("lb")) & (F.col("part") == F.col("lp")))
        .groupBy(*names, F.col("mix_key").alias("row_key"), F.col("mix_deal").alias("deal"), F.col("rest").alias("words"))
        .agg(F.sum("mix_size").alias("size"))
    )
    plan.partial = fill.groupBy("source", "block", "part").applyInPandas(_fill, "source string, block long, part long, cut long, more array<long>").toPandas()
    return _decided(spark, placed, plan, shards), plan


def _part() -> Column:
    """The part of its block that a row is in."""
    return F.pmod(F.xxhash64("mix_key", F.lit(11)), F.col("n_parts"))


def _last_parts(parts: pd.DataFrame) -> pd.DataFrame:
    """Of each block's parts (source, block, part, words, size), the one that the words still missing fall into, and how many are missing then."""
    out = []
    for _, g in parts.sort_values("part").groupby(["source", "block"], dropna=False, sort=False):
        before = g["size"].cumsum() - g["size"]
        i = int((before <= g["words"]).to_numpy().nonzero()[0][-1])
        out.append((g["source"].iat[i], int(g["block"].iat[i]), int(g["part"].iat[i]), float(g["words"].iat[i] - before.iat[i])))
    return pd.DataFrame(out, columns=["source", "block", "part", "rest"])


def _rows_of(pdf: pd.DataFrame) -> list[tuple]:
    """Rows for createDataFrame(): a missing source as None, arrays as lists."""
    return [tuple(None if isinstance(v, float) and v != v else list(map(int, v)) if isinstance(v, (list, np.ndarray)) else v for v in r) for r in pdf.astype(object).itertuples(index=False, name=None)]


def _decided(spark: SparkSession, placed: DataFrame, plan: Plan, shards: int) -> DataFrame:
    """Add mix_shards, the shard of each copy, and mix_copies. What is broadcast is bounded by the number of sources and blocks."""
    whole = spark.createDataFrame(_rows_of(plan.blocks[["source", "block", "shards"]]), "ws string, wb long, mix_shards array<int>")
    part = spark.createDataFrame(_rows_of(plan.partial), "ps string, pb long, pp long, cut long, more array<long>")
    rows = placed.join(F.broadcast(whole), F.col("mix_source").eqNullSafe(F.col("ws")) & (F.col("mix_block") == F.col("wb")), "left")
    rows = rows.join(F.broadcast(part), F.col("mix_source").eqNullSafe(F.col("ps")) & (F.col("mix_block") == F.col("pb")), "left")
    here = _part() == F.col("pp")
    extra = (_part() < F.col("pp")) | (here & ((F.col("mix_deal") <= F.col("cut")) | F.array_contains("more", F.col("mix_key"))))
    one_more = F.concat("mix_shards", F.array(F.pmod("mix_key", F.lit(shards)).cast("int")))
    rows = rows.withColumn("mix_shards", F.when(extra, one_more).otherwise(F.col("mix_shards")))
    return rows.drop("ws", "wb", "ps", "pb", "pp", "cut", "more", "n_blocks", "n_parts").withColumn("mix_copies", F.size("mix_shards"))


def mix_documents(docs: DataFrame, *, shard_column: str | None = None, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, shuffled within its output shard.

    Returns the columns of `docs`, and the shard as `shard_column` if that is named. Each
    shard has partitions of its own, the same number for all, and stands in a contiguous range of them.
    """
    shards = options.get("shards", SHARDS)
    _, plan = mix(docs, **options)
    spark = docs.sparkSession
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(c) for c in names]).alias("mix_row"), "doc_id", "text", "source")
    keyed = _keyed(packed, text_of(), ["mix_row"])
    rows = _decided(spark, _block(_blocks_of(spark, plan.counts), keyed), plan, shards)
    drawn = rows.select("mix_row", "mix_deal", F.posexplode("mix_shards").alias("mix_copy", "mix_shard"))
    each = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    dealt = drawn.repartitionById(shards * each, (F.col("mix_shard") * each + F.pmod("mix_deal", F.lit(each))).cast("int"))
    ordered = dealt.sortWithinPartitions(F.xxhash64("mix_deal", "mix_copy"))
    return ordered.select("mix_row.*", *([F.col("mix_shard").alias(shard_column)] if shard_column else []))
