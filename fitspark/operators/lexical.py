"""Pairs of token sets that overlap by a share, from their rarest tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlapping(items: DataFrame, docs: DataFrame, *, item: str, doc: str, tokens: str = "tokens", share: float = 0.5) -> DataFrame:
    """(item, doc, n, hits): pairs in which the document has `share` of the item's n distinct tokens or more, exactly.

    A document that has so many shares one of the item's n - ceil(share * n) + 1 rarest
    tokens, so only these are joined on, and what they find is verified on whole sets. Common tokens
    make no pairs but where an item has few others. Keys must be distinct; sets
    are arrays without repeats; items without tokens have no pairs.
    """
    q = items.select(item, tokens, F.size(tokens).alias("n")).where("n > 0")
    least = F.ceil(F.lit(share) * F.col("n") - 1e-9)
    words = q.select(item, "n", F.explode(tokens).alias("w"))
    t = docs.select(doc, F.explode(tokens).alias("w")).join(words.select("w").distinct(), "w", "left_semi")
    often = t.groupBy("w").agg(F.count(F.lit(1)).alias("times"))
    ranked = words.join(often, "w", "left").withColumn("place", F.row_number().over(W.partitionBy(item).orderBy(F.coalesce("times", F.lit(0)), "w")))
    rare = ranked.where((F.col("place") <= F.col("n") - least + 1) & F.col("times").isNotNull())
    found = rare.select(item, "w").join(t, "w").select(item, doc).distinct()
    both = found.join(q, item).join(docs.select(doc, F.col(tokens).alias("_there")), doc)
    return both.withColumn("hits", F.size(F.array_intersect(tokens, "_there"))).where(F.col("hits") >= least).select(item, doc, "n", "hits")
