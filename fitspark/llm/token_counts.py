"""Token counts with a cache that is keyed by digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitspark.llm.common import key_map, lean, maybe_in, small_batches, text_of, written

CACHE = "digest binary, n_tokens long, version string"

_models: dict[str, object] = {}


def _model(path: str):
    import sentencepiece
    import tokenizers

    if path not in _models:
        _models.clear()
        if path.endswith(".json"):
            t = tokenizers.Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _models[path] = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
        else:
            s = sentencepiece.SentencePieceProcessor(model_file=path)
            _models[path] = lambda texts: [len(s.encode(t)) for t in texts]
    return _models[path]


def _counted(path: str):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return mapped


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file: counts of another version are never used."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts (digest, n_tokens) of this version; none if the cache is not there yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    # Two runs may have appended the same digest.
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str, *, limit: int = 4096) -> DataFrame:
    """Count the tokens of the texts of `docs` (doc_id, text, ...) with the tokenizer in `path`.

    Returns one row per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit). Null text counts as empty. Content is normalised only by
    that: any other change could change the count. Repeated rows and rows with
    null doc_id stay. Other columns are ignored; no rows: no rows.

    `cache` is a Parquet table in storage that all machines share, in one folder
    for each tokenizer version, of which a run reads its own, once. Digests that it
    has are joined to their counts. Of the others, one text of each is encoded, and
    its count appended. Texts that occur once are encoded where they are read; only
    repeated ones, and those that the maps cannot tell, are shuffled, one of each
    from each task. Two maps of bounded size (see key_map()) tell the scan which rows
    are which; the first is of the misses or of the hits, whichever are fewer.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_version(path)
    text = text_of()
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    light = written(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests", light=True)
    n = light.count()
    asked = written(light.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).join(read_cache(spark, cache, version), "digest", "left"), "asked", rows=n)
    hits, misses = asked.where("n_tokens is not null").select("digest", "n_tokens"), asked.where("n_tokens is null").select("digest", "times")
    n_hits, n_misses, n_many = asked.agg(F.count("n_tokens"), F.count_if(F.col("n_tokens").isNull()), F.count_if(F.expr("n_tokens is null and times > 1"))).first()
    key = F.xxhash64("digest").alias("key")
    few, by_hits = (hits, True) if n_hits < n_misses else (misses, False)
    scan = maybe_in(keyed.select("digest", "text", key), "key", key_map(few.select(key), "key", min(n_hits, n_misses)), "maybe")
    scan = maybe_in(scan, "key", key_map(misses.where("times > 1").select(key), "key", n_many), "many")
    if by_hits:
        once, rest = scan.where("not maybe and not many"), scan.where("maybe or many")
    else:  # a few hits pass, and go with their counts
        once, rest = scan.where("maybe and not many"), scan.where("maybe and many")
    texts = once.select("digest", "text").union(rest.groupBy("digest").agg(F.first("text").alias("text")).join(misses, "digest", "left_semi").select("digest", "text"))
    counted = texts.mapInArrow(lean(_counted(path)), "digest binary, n_tokens long")
    fresh = written(counted.join(misses, "digest", "left_semi"), "fresh")
    if n_misses:
        fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").partitionBy("version").parquet(cache)
    # Written, so that both sides of the join are plain exchanges and a hot digest can be split.
    counts = written(hits.union(fresh), "counts")
    return light.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
