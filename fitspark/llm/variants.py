"""Words that differ by one edit, from blocks of shared beginnings and endings, and the form each is a variant of."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitspark.llm.common import lean, small_batches, text_of, written
from fitspark.llm.runs import counted, latin_bytes, runs, summed

#: One in so many runs of a document, by their checksum, loses a code point.
SPOIL = 97
MIN_LENGTH, MIN_TIMES = 5, 3
#: A block of more words is subdivided.
BLOCK = 48
#: Pairs of words of 16 code points that are verified at a time, and rows of blocks that are read at a time.
PAIRS, SCANNED = 1 << 17, 20_000
#: Bytes of a run up to which all checksums of a batch go on together; longer ones are summed one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


CRC = _crc_table()


def checksums(found: pa.LargeStringArray, rows: np.ndarray, prefixes: list[bytes]) -> np.ndarray:
    """crc32 of each run's bytes after the prefix of its row."""
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
    raw = np.frombuffer(found.buffers()[2], np.uint8) if len(found) else np.zeros(0, np.uint8)
    begun = np.array([zlib.crc32(p) for p in prefixes], np.uint32)[rows]
    at, size, state = offsets[:-1], np.diff(offsets), begun ^ np.uint32(0xFFFFFFFF)
    some = np.flatnonzero(size <= LONG)
    for k in range(LONG):
        some = some[size[some] > k]
        old = state[some]
        state[some] = CRC[(old ^ raw[at[some] + k]) & np.uint32(0xFF)] ^ (old >> np.uint32(8))
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(raw[offsets[i] : offsets[i + 1]], int(begun[i]))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's texts, added up."""

    def tables() -> Iterator[pa.Table]:
        for b in batches:
            found, rows = runs(b.column(1), latin_bytes)
            length = pc.utf8_length(found).to_numpy(zero_copy_only=False)
            enough = length >= MIN_LENGTH
            found, rows, length = found.filter(pa.array(enough)), rows[enough], length[enough]
            h = checksums(found, rows, [f"{'' if i is None else i}:".encode() for i in b.column(0).to_pylist()])
            spoilt = h % SPOIL == 0
            whole = found.filter(pa.array(~spoilt))
            at = np.flatnonzero(spoilt & (length > MIN_LENGTH))
            cut = []
            for word, k, n in zip(found.take(pa.array(at)).to_pylist(), h[at].tolist(), length[at].tolist()):
                cut.append(word[: k % n] + word[k % n + 1 :])
            every = pa.concat_arrays([whole, pa.array(cut, pa.large_string())])
            words, _, of, n = counted(every, np.zeros(len(every), np.int64), 1)
            yield pa.table({"word": words.take(pa.array(of)), "n": n.astype(np.int64)})

    for b in summed(tables(), ["word"], ["n"]):
        yield b.set_column(0, "word", b.column(0).cast(pa.string()))


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters of the texts of `docs` with their deletions, of MIN_LENGTH code points that occur MIN_TIMES times or more."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text")).mapInArrow(lean(_counts), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TIMES)


def _key() -> Column:
    """What the words of a block share: beginning, ending, and the way that led to the block."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in ("size", "head", "tail", "below")], F.expr("left(word, head)"), F.expr("right(word, tail)"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the block with a longer shared beginning, and in that with a longer shared ending.

    `size` is the length of the shorter words of a block, and `head` and `tail` are
    the code points that its words share at both ends. The edit of a pair stands
    behind the first half of what is between, which is then intact, or before its
    second half. A pair whose common beginning covers the first half belongs to the
    first block only, any other to the second only: `below` is the least
    length that a pair's common beginning does not reach.
    """
    half = F.expr("head + (size - head - tail) div 2").cast("int")
    ways = F.array(
        F.struct(half.alias("head"), F.col("tail").alias("tail"), F.col("below").alias("below")),
        F.struct(F.col("head").alias("head"), (F.col("size") - half).alias("tail"), F.least("below", half).alias("below")),
    )
    split = rows.select("word", "extra", "size", F.explode(ways).alias("way")).select("word", "extra", "size", "way.*")
    return split.withColumn("block", _key())


def blocks_of(words: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(block, word, extra, size, below): blocks of words that may be near, each pair of near words together in exactly one.

    A word of n code points is among the shorter ones (extra 0) of blocks of size n,
    and among the longer ones (extra 1) of size n - 1. Blocks of more than `block`
    words are subdivided in written rounds, until at most one code point is not
    shared: then the alphabet bounds them. Only sizes are counted; no task gathers a
    block that may be large. Blocks without a shorter word or with one word go.
    """
    n = F.char_length("word")
    start = words.select("word", F.explode(F.array(F.struct(F.lit(0).alias("extra"), n.alias("size")), F.struct(F.lit(1).alias("extra"), (n - 1).alias("size")))).alias("way")).select("word", "way.*")
    rows = _halves(start.withColumns({"head": F.lit(0), "tail": F.lit(0), "below": F.col("size") + 1}))
    done = None
    while True:
        rows = written(rows, "blocks", light=True)
        sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("members"), F.min("extra").alias("least")).where("members > 1 and least = 0")
        # Written, so that the join is of plain exchanges and a hot block can be split.
        sizes = written(sizes, "sizes", light=True)
        sized = rows.join(sizes.select("block", "members"), "block")
        small = F.expr(f"members <= {block} or size - head - tail <= 1")
        ready = sized.where(small).select("block", "word", "extra", "size", "below")
        done = ready if done is None else done.union(ready)
        if sizes.where(F.col("members") > block).isEmpty():
            return done
        rows = _halves(sized.where(~small))


def _near(letters: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Which pairs differ by one edit and belong to their block. y is as long as x or one longer; letters are padded with 0."""
    a, b, n = letters[x], letters[y], size[x]
    same = a == b
    width = letters.shape[1]
    lead = np.where(same.all(1), width, same.argmin(1))
    lead = np.minimum(lead, n)
    longer = size[y] > n
    place = np.arange(width)
    inside = place < n[:, None]
    # Behind the edit: the same places if a code point is replaced, places one further if one is inserted.
    shifted = np.concatenate([b[:, 1:], np.zeros((len(b), 1), b.dtype)], 1)
    fits = np.where(longer[:, None], a == shifted, same) | ~inside | (place < (lead + ~longer)[:, None])
    return fits.all(1) & (longer | (lead < n)) & (lead < below)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs (a, b) of the blocks of a sorted partition, which is scanned once: a block's words stand side by side."""
    held: list[pa.Table] = []
    for b in batches:
        if b.num_rows:
            held.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in held) >= SCANNED:
                t = pa.concat_tables(held).combine_chunks()
                # The last block may go on in the next batch.
                last = pc.index(t["block"], t["block"][-1]).as_py()
                yield from _verified(t.slice(0, last))
                held = [t.slice(last)]
    if held:
        yield from _verified(pa.concat_tables(held).combine_chunks())


def _verified(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near pairs of whole blocks, in which shorter words stand before longer ones."""
    if not t.num_rows:
        return
    words = t["word"].to_pylist()
    extra, below = t["extra"].to_numpy(), t["below"].to_numpy()
    size = pc.utf8_length(t["word"]).to_numpy()
    begins = np.append(True, pc.not_equal(t["block"].slice(1), t["block"].slice(0, t.num_rows - 1)).to_numpy().astype(bool))
    first = np.flatnonzero(begins)
    stop = np.append(first[1:], t.num_rows)[np.cumsum(begins) - 1]
    short = np.flatnonzero(extra == 0)
    # A shorter word is paired with all that stand behind it in its block. Words of like length go together, so that a matrix of letters is not wide for one of them.
    partners = stop[short] - short - 1
    kind = np.frompyfunc(int.bit_length, 1, 1)((size[short] - 1).astype(object)).astype(int)
    for c in np.unique(kind):
        mine, n = short[kind == c], partners[kind == c]
        width = int(size[mine].max()) + 1
        cuts = np.unique(np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()) + 1, max(1, PAIRS * 16 // width)), side="right"))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(mine))):
            left = np.repeat(mine[lo:hi], n[lo:hi])
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
            used, at = np.unique(np.concatenate([left, right]), return_inverse=True)
            # The alphabet ends at U+00FF, so a byte holds a code point.
            letters = np.frombuffer("".join([words[i].ljust(width, "\0") for i in used.tolist()]).encode("latin-1"), np.uint8).reshape(len(used), width)
            ok = np.flatnonzero(_near(letters, size[used], at[: len(left)], at[len(left) :], below[left]))
            if len(ok):
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in left[ok]], pa.string()), pa.array([words[i] for i in right[ok]], pa.string())], ["a", "b"])


def near_words(words: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(a, b) of `words` (word: distinct, of code points up to U+00FF): every two that differ by exactly one inserted, deleted or replaced code point, once."""
    small_batches(words.sparkSession)
    placed = blocks_of(words, block=block).select("block", "word", "extra", "below")
    # Sorted as a dictionary of beginnings and of endings; a block's words stand side by side.
    dealt = placed.repartition("block").sortWithinPartitions("block", "extra", "word")
    return dealt.mapInArrow(lean(_pairs), "a string, b string")


def followed(links: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(word, root) of `links` (word, form): the last word that the forms lead to, by doubling the steps each round."""
    ways = written(links.select("word", F.col("form").alias("root")), "roots", light=True)
    for _ in range(max_rounds):
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ways = written(ways.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots", light=True)
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")
    raise RuntimeError(f"forms did not end in {max_rounds} rounds")


def spelling_variants(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Group the words of `docs` (doc_id, text, ...) by spelling.

    Runs of A-Z, a-z and U+00C0 to U+00FF are taken, A-Z in lower case; where 97
    divides h, the crc32 of `<doc_id>:<run>`, code point h % length is deleted. Words
    are the distinct results of 5 code points or more that occur 3 times or more.
    Returns word, form (the near word of largest n, then the first by code
    points, if its n is twice the word's or more), root (the last word that forms lead
    to), n, n_near (its near words) and form_n. Null text has no words; null doc_id
    counts as empty. Repeated rows count each. Other columns are ignored; no rows
    or no words: no rows.

    Near words share the beginning or the ending around their edit. They are found
    in blocks of a dictionary sorted forward and of one sorted by endings;
    large blocks are subdivided, and every pair of a block is verified.
    """
    words = written(words_of(docs), "words", light=True)
    pairs = written(near_words(words, block=block), "near", light=True)
    ways = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    best = ways.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    judged = words.join(best.withColumnRenamed("a", "word"), "word", "left").withColumn("stands", F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False)))
    named = written(judged.select("word", F.when(F.col("stands"), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("stands"), -F.col("best.less")).alias("form_n")), "forms", light=True)
    roots = followed(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
