"""How far the sources of a language differ in their terms, from distinct count columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitspark.llm.common import lean, small_batches, text_of, written
from fitspark.llm.runs import counted, runs, summed, term_bytes

#: A term is kept if so many documents of its language have it; every count gets so much before it is made a share of SCALE.
MIN_DOCS, EXTRA, SCALE = 30, 5, 1_000_000_000
#: Pairs of cells that are evaluated at a time.
CELLS = 1 << 20


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's texts, added up."""

    def tables() -> Iterator[pa.Table]:
        for b in batches:
            lang, source = (b.column(i).dictionary_encode() for i in (0, 1))
            n_source = max(1, len(source.dictionary))
            group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_source + source.indices.to_numpy(zero_copy_only=False)
            found, rows = runs(b.column(2), term_bytes)
            terms, row, term, count = counted(found, rows, b.num_rows)
            n_terms = max(1, len(terms))
            key, of = np.unique(group[row] * n_terms + term, return_inverse=True)
            g = key // n_terms
            yield pa.table(
                {
                    "lang": lang.dictionary.take(pa.array(g // n_source)),
                    "source": source.dictionary.take(pa.array(g % n_source)),
                    "term": terms.take(pa.array(key % n_terms)),
                    "n": np.bincount(of, count, len(key)).astype(np.int64),
                    "docs": np.bincount(of, minlength=len(key)).astype(np.int64),
                },
                schema=pa.schema({"lang": pa.string(), "source": pa.string(), "term": pa.large_string(), "n": pa.int64(), "docs": pa.int64()}),
            )

    for b in summed(tables(), ["lang", "source", "term"], ["n", "docs"]):
        yield b.set_column(2, "term", b.column(2).cast(pa.string()))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + EXTRA) / (total + EXTRA * kept)), exactly; 0 if no terms are kept."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + F.lit(EXTRA).cast("decimal(1,0)"))
    below = total.cast("decimal(19,0)") + F.lit(EXTRA).cast("decimal(1,0)") * kept.cast("decimal(12,0)")
    return F.when(kept > 0, 1 + F.call_function("div", top, below)).otherwise(F.lit(0).cast("long"))


def _one_sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a source and each other: what terms that only the first has add to the value as if no term occurred in either.

    Sums over the distinct shares of the source are split at the other's share of
    no occurrence, by sorted sums.
    """
    names, kinds = ["lang", "a", "b", "value"], [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for b in batches:
        for r in b.to_pylist():
            other, base = (np.array([x[k] for x in r["others"]], np.int64) for k in ("sid", "base"))
            p, w = (np.array([x[k] for x in r["shares"] or []], np.int64) for k in ("p", "w"))
            order = np.argsort(p, kind="stable")
            p, w = p[order], w[order]
            at = np.searchsorted(p, base)
            n, s = (np.concatenate([[0], np.cumsum(x)]) for x in (w, w * p))
            apart = np.abs(base - r["base"])
            value = (s[-1] - s[at]) - (n[-1] - n[at]) * base + n[at] * base - s[at] - n[-1] * apart
            value = value + np.where(other > r["sid"], r["kept"] * apart, 0)
            real = other != r["sid"]
            other, value = other[real], value[real]
            for lo in range(0, len(other), 10_000):
                o, v = other[lo : lo + 10_000], value[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(o), kinds[0]), pa.array(np.minimum(o, r["sid"])), pa.array(np.maximum(o, r["sid"])), pa.array(v)], names)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of sources that a count vector has: what replaces the two one-sided amounts, times the terms of the vector."""

    def tables() -> Iterator[pa.Table]:
        for b in batches:
            cells = b.column(2)
            size = np.diff(cells.offsets.to_numpy())
            sid, p, base = (cells.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = np.cumsum(size) - size
            mult = b.column(1).to_numpy(zero_copy_only=False)
            langs = b.column(0).dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False)
            for k in np.unique(size[size > 1]).tolist():
                rows = np.flatnonzero(size == k)
                step = max(1, CELLS // (k * k))
                for lo in range(0, len(rows), step):
                    at = rows[lo : lo + step]
                    here = starts[at][:, None] + np.arange(k)
                    # The first cells of pairs in blocks, so that a vector of very many sources needs no matrix of all of them.
                    for i in range(0, k, max(1, CELLS // k)):
                        left = np.arange(i, min(k, i + max(1, CELLS // k)))
                        x, y = (v.ravel() for v in np.meshgrid(left, np.arange(k), indexing="ij"))
                        x, y = x[x < y], y[x < y]
                        x, y = here[:, x], here[:, y]
                        value = np.abs(p[x] - p[y]) - np.abs(p[x] - base[y]) - np.abs(base[x] - p[y]) + np.abs(base[x] - base[y])
                        of = np.repeat(lang[at], x.shape[1]).astype(np.int64)
                        a, c = sid[x].ravel(), sid[y].ravel()
                        yield pa.table({"lang": langs.dictionary.take(pa.array(of)), "a": np.minimum(a, c), "b": np.maximum(a, c), "value": (value * mult[at][:, None]).ravel()})

    yield from summed(tables(), ["lang", "a", "b"], ["value"])


def source_divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = 50) -> DataFrame:
    """Compare the sources of each language of `docs` (text, lang, source, ...) by their terms.

    Terms are runs of ASCII letters, A-Z in lower case, and of characters beyond
    ASCII. A language keeps the V terms that at least `min_docs` of its rows have.
    The share p of a term in a (lang, source) group, or in a language, is
    1 + floor(1e9 * (n + 5) / (N + 5 * V)), N the sum of n over kept terms.

    Returns lang, source, part, item, value, rank. Part `pair`: for each other source
    of the language, the sum of |p - q| over all kept terms (0 if there are none).
    Part `term`: the first `top` kept terms that the group has with a larger share than
    the language, by the difference. Ranks go by value, then item. Null text, lang
    and source count as empty. Rows count as often as they are repeated. Other
    columns are ignored; no rows: no rows.

    Tasks add up their own counts before they send them. Terms with one sparse vector of
    counts by source become one row with their number; a pair of sources is
    evaluated once for each distinct vector that has both. Terms that only one of two
    sources has depend on that source's counts alone and are summed for each
    distinct count; terms that neither has are one constant.
    """
    spark = docs.sparkSession
    small_batches(spark)
    clean = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))
    found = clean.mapInArrow(lean(_terms), "lang string, source string, term string, n long, docs long")
    by_source = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    terms = written(by_term.where(F.col("docs") >= min_docs).drop("docs"), "terms", light=True)

    in_group = terms.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    in_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    present = clean.select("lang", "source").distinct()
    known = present.join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    numbered = known.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    groups = written(numbered.withColumn("base", share(F.lit(0), F.col("total"), F.col("kept"))), "groups")

    # Part term: every kept term of a group, by itself.
    each = terms.select("lang", "term", F.col("n").alias("lang_n"), F.inline("counts")).join(groups, ["lang", "source"])
    apart = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = each.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart.alias("value")).where("value > 0").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # Part pair: terms by their vectors of counts.
    vectors = written(terms.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("times")).withColumn("vector", F.monotonically_increasing_id()), "vectors", light=True)
    cells = vectors.select("lang", "vector", "times", F.inline("counts")).join(groups, ["lang", "source"]).select("lang", "vector", "times", "sid", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "base")
    whole = cells.groupBy("lang", "vector").agg(F.first("times").alias("times"), F.array_sort(F.collect_list(F.struct("sid", "p", "base"))).alias("cells"))
    both = whole.select("lang", "times", "cells").mapInArrow(lean(_both), "lang string, a long, b long, value long")
    shares = cells.groupBy("lang", "sid", "p").agg(F.sum("times").alias("w")).groupBy("lang", "sid").agg(F.collect_list(F.struct("p", "w")).alias("shares"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("sid", "base")).alias("others"))
    alone = groups.select("lang", "sid", "base", "kept").join(shares, ["lang", "sid"], "left").join(others, "lang").mapInArrow(lean(_one_sided), "lang string, a long, b long, value long")
    pairs = written(both.union(alone).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs", light=True)
    ways = pairs.union(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = groups.select("lang", "sid", "source")
    named = ways.join(name.withColumnRenamed("sid", "a"), ["lang", "a"]).join(name.select("lang", F.col("sid").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    compared = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return compared.union(ranked)
