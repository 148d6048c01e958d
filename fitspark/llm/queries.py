"""Queries over the documents table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitspark.llm import pii, secrets, toxicity
from fitspark.llm.bpe import bpe_round_trip
from fitspark.llm.common import shared_path
from fitspark.llm.divergence import source_divergence
from fitspark.llm.exact_dedup import exact_dedup
from fitspark.llm.line_dedup import line_dedup
from fitspark.llm.mixing import mix
from fitspark.llm.quality import quality_scores
from fitspark.llm.rank_bpe import word_bpe_round_trip
from fitspark.llm.simhash import simhash_groups
from fitspark.llm.token_counts import token_counts
from fitspark.llm.variants import spelling_variants


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).drop("uid")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(documents(spark, sf_dir)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir), shingle=3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = quality_scores(documents(spark, sf_dir))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= toxicity.CUT).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    light, plan = mix(documents(spark, sf_dir))
    sources = spark.createDataFrame([(s, int(n), float(t)) for s, n, t in plan.sources.itertuples(index=False, name=None)], "s string, source_size long, target double")
    # One row for each source.
    rows = light.join(F.broadcast(sources), F.col("mix_source").eqNullSafe(F.col("s")), "left")
    shards = F.array_join(F.transform("mix_shards", lambda x: x.cast("string")), ",").alias("shards")
    return rows.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"), shards)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """It starts with an empty cache, so that every distinct text is encoded."""
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), shared_path(spark, "token-cache"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pii_spans(documents(spark, sf_dir)))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_secrets": op2_secrets,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_bpe": op7_bpe,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
    "op11_word_bpe": op11_word_bpe,
    "op12_divergence": op12_divergence,
    "op13_variants": op13_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH lines AS (
          SELECT doc_id, unnest(l) AS body, generate_subscripts(l, 1) - 1 AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        placed AS (
          SELECT *, sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(body) - 1 AS origin, regexp_extract_all(body, '[^.!?]*[.!?]+|[^.!?]+') AS p FROM lines),
        parts AS (SELECT doc_id, line, origin, len(p) = 1 AS whole, unnest(p) AS unit, generate_subscripts(p, 1) AS k FROM placed),
        each AS (
          SELECT doc_id, line, whole, unit, k, origin + sum(length(unit)) OVER (PARTITION BY doc_id, line ORDER BY k) - length(unit) AS start FROM parts
          UNION ALL SELECT doc_id, line, true, body, NULL, origin FROM placed WHERE len(p) > 1),
        units AS (
          SELECT *, greatest(len(words), length(unit) // 8) AS n_words FROM (SELECT *, list_filter(string_split_regex(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM each)
          WHERE len(words) > 0 AND greatest(len(words), length(unit) // 8) >= CASE WHEN k IS NULL THEN 15 ELSE 3 END),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY doc_id, k IS NULL ORDER BY start) AS seq,
                 row_number() OVER w AS r, first_value(doc_id) OVER w AS keep_doc_id, first_value(start) OVER w AS keep_start
          FROM units WINDOW w AS (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, start)),
        runs AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id, k IS NULL ORDER BY seq) AS run FROM ranked WHERE r > 1),
        judged AS (
          SELECT *, whole AND n_words >= 15 AS line_goes, sum(n_words) OVER (PARTITION BY doc_id, k IS NULL, run) AS in_run,
                 max(whole AND n_words >= 15) OVER (PARTITION BY doc_id, line) AS line_gone FROM runs)
        SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(start AS BIGINT) AS start, CAST(start + length(unit) AS BIGINT) AS stop, CAST(n_words AS BIGINT) AS n_words,
               keep_doc_id, CAST(keep_start AS BIGINT) AS keep_start
        FROM judged WHERE line_goes OR (NOT line_gone AND k IS NOT NULL AND in_run >= 25)""",
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""",
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        groups AS (SELECT DISTINCT lang, source FROM d),
        w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
        langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source),
        shares AS (
          SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
                 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
          FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
          LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        every AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
