"""Substring duplicates by hashing lines, and the sentences of lines that repeat in runs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitspark.llm.common import lean, small_batches, text_of, written

#: A repeated line of so many words goes; shorter ones recur by chance, and in clean documents.
LINE_WORDS = 15
#: Repeated sentences go where they follow each other and have so many words in all: a passage that was copied into a line.
RUN_WORDS = 25
#: Sentences of fewer words neither count nor break a run, and stay.
PART_WORDS = 3
#: So many characters count as a word at least: some scripts have no spaces.
WORD_CHARS = 8
#: Sentences tile a line.
PART = r"[^.!?]*[.!?]+|[^.!?]+"

UNITS = "doc_id long, uid long, line long, seq long, start long, stop long, n_words long, whole boolean, digest binary"


def _units(line_words: int, part_words: int):
    kinds = (pa.int64(),) * 7 + (pa.bool_(), pa.binary())
    each = re.compile(PART)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in kinds]

            def unit(doc_id, uid, line, seq, start, text, whole, least):
                words = text.encode().lower().split()
                n = max(len(words), len(text) // WORD_CHARS) if words else 0
                if n < max(1, least):
                    return False
                for c, v in zip(cols, (doc_id, uid, line, seq, start, start + len(text), n, whole, xxhash.xxh3_128_digest(b" ".join(words)))):
                    c.append(v)
                return True

            for doc_id, uid, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                at = seq = 0
                for line, body in enumerate(text.split("\n")):
                    parts = each.findall(body)
                    if len(parts) > 1:
                        unit(doc_id, uid, line, None, at, body, True, line_words)
                    for part in parts:
                        seq += unit(doc_id, uid, line, seq, at, part, len(parts) == 1, part_words)
                        at += len(part)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "uid", "line", "seq", "start", "stop", "n_words", "whole", "digest"])

    return cut


def line_units(docs: DataFrame, *, line_words: int = LINE_WORDS, part_words: int = PART_WORDS, uid: Column | None = None) -> DataFrame:
    """The lines of every text (whole), and their sentences, numbered by seq; a line of one sentence is one row.

    Lines of several sentences have `line_words` words or more, sentences `part_words`.

    start and stop are code points in the text, stop exclusive, without the line
    break. n_words are the words, or one for each eight characters if that is
    more. digest is 128 bits of the unit with A-Z in lower case and one space
    between words. uid tells rows with the same doc_id apart. Null text: none.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), (F.monotonically_increasing_id() if uid is None else uid).alias("uid"), text_of().alias("text")).mapInArrow(lean(_units(line_words, part_words)), UNITS)


def line_dedup(docs: DataFrame, *, line_words: int = LINE_WORDS, run_words: int = RUN_WORDS, part_words: int = PART_WORDS, uid: Column | None = None) -> DataFrame:
    """The units to remove: what repeats an earlier unit of any document.

    A repeated line of `line_words` words or more goes as a whole. Of other lines
    repeated sentences go that belong to a run of `run_words` words or more; a run is
    of repeated sentences that follow each other, over the ends of lines, too. Sentences
    of fewer than `part_words` words are passed over.
    Returns doc_id, uid, line, start, stop, n_words, keep_doc_id, keep_start, one
    row per removed unit, with its place in the original text and the occurrence
    that stays. Units do not overlap. The earliest occurrence has the smallest
    doc_id (null last), then the first row, then the first place. Repeated rows
    lose what is long enough, but for the first row. Null and empty texts have no
    units; other columns are ignored; no rows: no rows.

    Digests are counted with partial sums on the map side, so a unit that a third
    of all documents share is one row from each task; the join that follows
    compares light rows and may be split at hot digests by adaptive execution.
    Only repeated units are then put together by document.
    """
    units = written(line_units(docs, line_words=line_words, part_words=part_words, uid=uid), "units")
    at = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "uid", "start")
    # Written, so that both sides of the join are plain exchanges and a hot digest can be split.
    repeated = written(units.groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("first")).where("times > 1"), "repeated", rows=units.count())
    again = units.join(repeated.select("digest", "first"), "digest").where(~at.eqNullSafe(F.col("first"))).drop("digest")
    by_seq = W.partitionBy("uid", F.col("seq").isNull()).orderBy("seq")
    run = W.partitionBy("uid", F.col("seq").isNull(), "run")
    line_goes = F.col("whole") & (F.col("n_words") >= line_words)
    judged = (
        again.repartition("uid")  # serves all windows
        .withColumn("run", F.col("seq") - F.row_number().over(by_seq))
        .withColumn("in_run", F.sum("n_words").over(run))
        .withColumn("line_gone", F.max(line_goes).over(W.partitionBy("uid", "line")))
    )
    gone = judged.where(line_goes | (~F.col("line_gone") & F.col("seq").isNotNull() & (F.col("in_run") >= run_words)))
    return gone.select("doc_id", "uid", "line", "start", "stop", "n_words", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.start").alias("keep_start"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the units that line_dedup() finds cut out of the texts; their original offsets are in removed_spans.

    Each row loses its own units, so of repeated rows the first keeps its text, also
    with null doc_id. Line breaks stay; null texts stay null. The rows are written with
    a number each first, as a row must be the same one in both steps.
    """
    rows = written(docs.select(F.struct(*docs.columns).alias("line_row"), F.monotonically_increasing_id().alias("line_uid")), "rows")
    flat = rows.select(F.col("line_row.doc_id").alias("doc_id"), F.col("line_row.text").alias("text"), "line_uid")
    removed = line_dedup(flat, uid=F.col("line_uid"), **options)
    spans = removed.groupBy(F.col("uid").alias("line_uid")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("line_spans"))
    s, n, text = F.col("line_spans"), F.size("line_spans"), F.col("line_row.text")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["stop"]).cast("int")
    end = lambda i: F.when(i == n, F.char_length(text)).otherwise(F.get(s, i)["start"]).cast("int")
    kept = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, begin(i) + 1, end(i) - begin(i))), "")
    names = [F.when(s.isNull(), text).otherwise(kept).alias(c) if c == "text" else F.col("line_row")[c].alias(c) for c in docs.columns if c != "removed_spans"]
    return rows.join(spans, "line_uid", "left").select(*names, s.alias("removed_spans"))
