"""Pairs of intervals that overlap, by an equi-join on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one side in a bin beyond which the bin is dealt to several tasks.
HOT_ROWS = 100_000
#: Rows of one side with a key up to which the key alone joins them.
FEW_ROWS = 256


def _level(start: Column, stop: Column, width: float) -> Column:
    """The least level at which a bin is at least as long as the interval: bins of a level are twice as long as those of the level before."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1.0), (stop - start) / width)))).cast("int")


def _binned(rows: DataFrame, span: tuple[Column, Column], on: list[str], width: float, name: str) -> DataFrame:
    start, stop = span
    out = rows.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(on)), F.struct(*rows.columns).alias(name), start.cast("double").alias("s"), stop.cast("double").alias("e"))
    # An interval that ends before it begins overlaps nothing, nor does a null key.
    return out.where(" and ".join(["s <= e", *(f"k{i} is not null" for i in range(len(on)))])).withColumn("own", _level(F.col("s"), F.col("e"), width))


def overlap_join(left: DataFrame, right: DataFrame, *, on: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: float, touch: bool = False, hot_rows: int = HOT_ROWS, few_rows: int = FEW_ROWS) -> DataFrame:
    """(left, right) as structs: the pairs of rows with equal keys `on` whose intervals overlap.

    Spans are (start, stop) columns that can be cast to double; with `touch`, intervals
    that only share an end overlap, too; without, an empty interval overlaps what it stands
    inside of. Null ends or keys overlap nothing. Repeated rows make repeated pairs.

    Rows whose key has `few_rows` at most on each side are joined by their key alone, so
    each is shuffled once. The rows of other keys, if there are any, meet in bins.

    Bins are `width` long and twice as long at each further level. An interval
    belongs to the level at which it covers two bins at most, so a long one does not
    become many rows; at coarser levels it is only looked up, where the other side has
    intervals of that level. A pair meets at the coarser of the two levels, and counts in
    its first common bin only. Bins with more than `hot_rows` rows of the left side are
    split: their left rows are dealt to parts, and their right rows go to each part.
    """
    keys = [f"k{i}" for i in range(len(on))]
    l, r = _binned(left, left_span, on, width, "left"), _binned(right, right_span, on, width, "right")  # noqa: E741
    over = "s <= re and rs <= e" if touch else "(s < re and rs < e) or (s = e and rs < s and s < re) or (rs = re and s < rs and rs < e)"
    many = [side.groupBy(*keys).count().where(F.col("count") > few_rows).select(*keys) for side in (l, r)] if keys else []
    dense = many[0].union(many[1]).distinct() if many else None
    if dense is not None and dense.isEmpty():
        return _by_key(l, r, keys, over)
    few = None
    if dense is not None:
        few = _by_key(l.join(dense, keys, "left_anti"), r.join(dense, keys, "left_anti"), keys, over)
        l, r = l.join(dense, keys, "left_semi"), r.join(dense, keys, "left_semi")  # noqa: E741
    binned = _by_bins(l, r, keys, over, width, hot_rows)
    return binned if few is None else few.unionByName(binned)


def _by_key(l: DataFrame, r: DataFrame, keys: list[str], over: str) -> DataFrame:  # noqa: E741
    """The pairs of rows with equal keys that overlap."""
    return l.drop("own").join(r.drop("own").withColumnsRenamed({"s": "rs", "e": "re"}), keys).where(over).select("left", "right")


def _by_bins(l: DataFrame, r: DataFrame, keys: list[str], over: str, width: float, hot_rows: int) -> DataFrame:  # noqa: E741
    # Levels are the binary logarithm of a range of doubles: some hundreds at most.
    levels = sorted({x[0] for side in (l, r) for x in side.select("own").distinct().collect()})
    if not levels:
        return l.select("left").join(r.select("right"), F.lit(False))

    def placed(side: DataFrame, name: str) -> DataFrame:
        at = F.explode(F.filter(F.array(*(F.lit(x) for x in levels)), lambda x: x >= F.col("own"))).alias("level")
        size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("level"))
        first, last = F.floor(F.col("s") / size), F.floor(F.col("e") / size)
        return side.select(*keys, name, "s", "e", "own", at).withColumns({"first": first, "bin": F.explode(F.sequence(first, last))})

    a = placed(l, "left")
    b = placed(r, "right").select(*keys, "level", "bin", "right", F.col("s").alias("rs"), F.col("e").alias("re"), F.col("own").alias("r_own"), F.col("first").alias("r_first"))
    hot = a.groupBy(*keys, "level", "bin").agg(F.ceil(F.count(F.lit(1)) / hot_rows).cast("int").alias("parts")).where("parts > 1")
    a = a.join(hot, [*keys, "level", "bin"], "left").withColumn("part", F.pmod(F.xxhash64("left"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    b = b.join(hot, [*keys, "level", "bin"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    met = a.join(b, [*keys, "level", "bin", "part"]).where("level = greatest(own, r_own) and bin = greatest(first, r_first)")
    return met.where(over).select("left", "right")
