"""Toxicity by a convolutional classifier over hashed words, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitspark.llm.common import lean, small_batches, text_of, written

#: Fits 16 bits, in which the sample's words travel.
BUCKETS = 1 << 15
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Labelled rows of each label that the fit reads at most; the earliest by a hash of doc_id.
FIT_ROWS = 3000
#: A labelled row of more words is left out of the fit, which bounds its memory.
FIT_WORDS = 4000
#: The share of the sample that is kept from training, to calibrate scores and thresholds.
CALIBRATION = 0.25
EPOCHS = 5
BATCH = 64
#: Steps that the fit takes at least, however few rows there are.
LEAST_STEPS = 250
#: The score at which a document is rejected if its language has no threshold of its own.
CUT = 0.3
#: Labelled rows of each label that a language needs for a threshold of its own.
LEAST_ROWS = 25

PAD = max(WIDTHS) - 1
DROP = b".,;:!?\"'()[]{}<>|*#$%&"


#: A word's embedding is the sum of those of the word and of its first letters, so that unseen forms of a word score like it.
PREFIXES = (5, 4)
PARTS = 1 + len(PREFIXES)


#: Distinct words that a task keeps between batches; all are forgotten beyond it.
KEPT_WORDS = 100_000


class Words:
    """Numbers distinct words; `buckets` has the hash buckets of each. Number 0 pads."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.buckets: list[tuple[int, ...]] = [(0,) * PARTS]

    def of(self, text: str) -> np.ndarray:
        """The numbers of a text's words, in lower case, without punctuation at their ends."""
        words = text.lower().encode("utf-8", "replace").split()
        out = np.fromiter((self.number.get(w, -1) for w in words), np.int32, len(words))
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = self._add(words[i])
        return out

    def _add(self, word: bytes) -> int:
        if (i := self.number.get(word)) is None:
            i = self.number[word] = len(self.buckets)
            bare = word.strip(DROP)
            letters = bare.decode("utf-8", "replace")
            self.buckets.append(tuple(zlib.crc32(x) % (BUCKETS - 1) + 1 for x in (bare, *(f"{n} {letters[:n]}".encode() for n in PREFIXES))))
        return i


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] | None = None

    def tables(self, buckets: np.ndarray) -> list[list[np.ndarray]]:
        """What each of the words with these buckets adds to each filter at each place in its window."""
        words = self.embedding[buckets].sum(axis=1)
        return [[exact_product(words, w[j]) for j in range(len(w))] for w in self.filters]


class Scorer:
    """Scores texts; what each word adds to the filters is computed when the word is first met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.words, self.done = Words(), 0
        self.tables = [[np.zeros((0, w.shape[2]), np.float32) for _ in w] for w in self.model.filters]

    def scores(self, texts: list[str]) -> np.ndarray:
        m, out = self.model, np.empty(len(texts))
        for lo in range(0, len(texts), 32):
            tokens, starts = pack([self.words.of(t) for t in texts[lo : lo + 32]])
            if len(self.words.buckets) > self.done:
                new = m.tables(np.array(self.words.buckets[self.done :], np.int32))
                for held, more in zip(self.tables, new):
                    for j, t in enumerate(more):
                        held[j] = grown(held[j], self.done, t)
                self.done = len(self.words.buckets)
            z = exact_product(pooled(tokens, starts, self.tables, m.bias), m.weight[:, None])[:, 0] + m.offset
            out[lo : lo + 32] = sigmoid(m.scale * z + m.shift)
            if self.done > KEPT_WORDS:
                self.forget()
        return out


def grown(table: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
    """The table with `rows` from row n on; it grows by half when it is full."""
    if n + len(rows) > len(table):
        wider = np.zeros((max(n + len(rows), len(table) * 3 // 2, 4096), rows.shape[1]), np.float32)
        wider[:n] = table[:n]
        table = wider
    table[n : n + len(rows)] = rows
    return table


def buckets_of(text: str) -> np.ndarray:
    """An array (words, PARTS) of hash buckets."""
    words = Words()
    numbers = words.of(text)
    return np.array(words.buckets, np.int32)[numbers].reshape(-1, PARTS)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, summed in one order: a row's result must not depend on what stands beside it, as it may with BLAS."""
    out = a[:, :1] * b[0]
    for d in range(1, len(b)):
        out = out + a[:, d : d + 1] * b[d]
    return out


def pack(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents in a row, each followed by padding, and where each starts."""
    pad = np.zeros(PAD, np.int32)
    lengths = np.array([max(1, len(d)) + PAD for d in docs])
    return np.concatenate([x for d in docs for x in (d if len(d) else np.zeros(1, np.int32), pad)]), np.cumsum(lengths) - lengths


def distinct_words(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pack() for documents as arrays of buckets: numbers of words, starts, and the buckets of each number."""
    flat = np.concatenate([np.zeros((1, PARTS), np.int32), *docs])
    _, first, inverse = np.unique(flat[:, 0].astype(np.int64) * BUCKETS * BUCKETS + flat[:, 1].astype(np.int64) * BUCKETS + flat[:, 2], return_index=True, return_inverse=True)
    cuts = np.cumsum([1, *(len(d) for d in docs)])
    tokens, starts = pack([inverse[a:b] for a, b in zip(cuts, cuts[1:])])
    return tokens, starts, flat[first]


def pooled(tokens: np.ndarray, starts: np.ndarray, tables: list[list[np.ndarray]], bias: np.ndarray) -> np.ndarray:
    """The largest value of each filter over each document's windows. A window may reach into the padding only."""
    ends = np.append(starts[1:], len(tokens))
    out, at = np.empty((len(starts), len(bias)), np.float32), 0
    padding = np.ones(len(tokens), bool)
    for k in range(PAD):
        padding[ends - 1 - k] = False
    for table in tables:
        n = table[0].shape[1]
        value = np.zeros((len(tokens), n), np.float32)
        for j, t in enumerate(table):
            value[: len(tokens) - j] += t[tokens[j:]]
        value[~padding] = -np.inf
        out[:, at : at + n] = np.maximum.reduceat(value, starts, axis=0)
        at += n
    return np.maximum(out + bias, 0)


def train(docs: list[np.ndarray], labels: np.ndarray, *, seed: int = 5, epochs: int = EPOCHS) -> Model:
    """Fit embedding, filters and output by Adam on the logistic loss; only windows that win the pooling learn."""
    rng = np.random.default_rng(seed)
    n = FILTERS * len(WIDTHS)
    # Small embeddings, so that words the fit has not met hardly move the pooled values.
    m = Model(rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32), [rng.normal(0, 0.5 / np.sqrt(DIM * w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(n, np.float32), rng.normal(0, 0.2, n).astype(np.float32), 0.0)
    m.embedding[0] = 0
    dense = [*m.filters, m.bias, m.weight]
    first, second = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    e_first, e_second = np.zeros_like(m.embedding), np.zeros_like(m.embedding)
    o = [0.0, 0.0]
    step, rate = 0, 0.01
    weight_of = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(docs) // BATCH)))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            local, starts, buckets = distinct_words([docs[i] for i in some])
            tokens = local
            ends = np.append(starts[1:], len(tokens))
            used, inverse = np.unique(buckets, return_inverse=True)
            inverse = inverse.reshape(buckets.shape)
            own = m.embedding[used]
            emb = own[inverse].sum(axis=1)
            open_ = np.ones(len(tokens), bool)
            for k in range(PAD):
                open_[ends - 1 - k] = False
            best = np.empty((len(some), n), np.int64)
            top = np.empty((len(some), n), np.float32)
            at = 0
            for w in m.filters:
                value = np.zeros((len(tokens), FILTERS), np.float32)
                for j in range(len(w)):
                    value[: len(tokens) - j] += (emb @ w[j])[local[j:]]
                value[~open_] = -np.inf
                for d in range(len(some)):
                    part = value[starts[d] : ends[d]]
                    i = part.argmax(axis=0)
                    best[d, at : at + FILTERS] = starts[d] + i
                    top[d, at : at + FILTERS] = part[i, np.arange(FILTERS)]
                at += FILTERS
            hidden = np.maximum(top + m.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ m.weight + m.offset, -30, 30)))
            g = ((p - labels[some]) * weight_of[some] / len(some)).astype(np.float32)
            back = g[:, None] * m.weight * (top + m.bias > 0)
            grads, g_emb = [], np.zeros_like(emb)
            at = 0
            for w in m.filters:
                gw = np.zeros_like(w)
                b, at_ = back[:, at : at + FILTERS], best[:, at : at + FILTERS]
                for j in range(len(w)):
                    rows = local[np.minimum(at_ + j, len(tokens) - 1)]
                    gw[j] = np.einsum("df,dfe->ef", b, emb[rows])
                    np.add.at(g_emb, rows, b[:, :, None] * w[j].T[None])
                grads.append(gw)
                at += FILTERS
            grads += [back.sum(0), hidden.T @ g + 1e-5 * m.weight]
            step += 1
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            for x, gx, a, v in zip(dense, grads, first, second):
                a += 0.1 * (gx - a)
                v += 0.001 * (gx * gx - v)
                x -= rate * (a / c1) / (np.sqrt(v / c2) + 1e-8)
            g_own = np.zeros_like(own)
            for k in range(PARTS):
                np.add.at(g_own, inverse[:, k], g_emb)
            ea, ev = e_first[used], e_second[used]  # moments of the buckets in this batch only
            ea += 0.1 * (g_own - ea)
            ev += 0.001 * (g_own * g_own - ev)
            e_first[used], e_second[used] = ea, ev
            m.embedding[used] = own - rate * (ea / c1) / (np.sqrt(ev / c2) + 1e-8)
            m.embedding[0] = 0
            gb = float(g.sum())
            o = [0.9 * o[0] + 0.1 * gb, 0.999 * o[1] + 0.001 * gb * gb]
            m.offset -= rate * (o[0] / c1) / (np.sqrt(o[1] / c2) + 1e-8)
        rate *= 0.1 ** (1 / epochs)
    return m


def logits(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    out = []
    for lo in range(0, len(docs), 64):
        tokens, starts, buckets = distinct_words(docs[lo : lo + 64])
        out.append(exact_product(pooled(tokens, starts, m.tables(buckets), m.bias), m.weight[:, None])[:, 0] + m.offset)
    return np.concatenate(out) if out else np.zeros(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap that it falls in."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2)


def calibrate(m: Model, docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None], share: np.ndarray) -> None:
    """Scale the logits so that the best cut over all is CUT, then set a threshold for each language with enough rows.

    `share` weighs the rows back to the labels' shares in the table.
    """
    z = logits(m, docs)
    if len(z) and 0 < labels.sum() < len(labels):
        a, b = 1.0, 0.0
        for _ in range(300):  # Platt's two parameters
            p = sigmoid(a * z + b)
            g = (p - labels) * share / share.sum()
            a, b = max(0.05, a - 0.3 * (g @ z)), b - 0.3 * g.sum()
        cut = best_cut(a * z + b, labels)
        m.scale, m.shift = a, b + np.log(CUT / (1 - CUT)) - cut
    scores = sigmoid(m.scale * z + m.shift)
    m.thresholds = {}
    for lang in sorted({x for x in langs if x is not None}):
        of = np.array([x == lang for x in langs])
        if min(labels[of].sum(), (1 - labels[of]).sum()) >= LEAST_ROWS:
            m.thresholds[lang] = float(np.clip(best_cut(scores[of], labels[of]), 0.05, 0.95))


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [buckets_of(t) for t in b.column(3).to_pylist()]
        keep = np.array([len(w) <= FIT_WORDS for w in words], bool)
        mask = pa.array(keep)
        cols = [b.column(i).filter(mask) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([w.astype(np.uint16).tobytes() for w, k in zip(words, keep) if k], pa.binary())], ["doc_id", "lang", "toxic", "words"])


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, seed: int = 5) -> Model:
    """Fit and calibrate on a bounded sample of the labelled rows that are not held out.

    Takes at most `rows` rows of each label, the first by a hash of doc_id; rows
    with null or other labels, null doc_id or several labels that differ are left
    out. Without rows of both labels the model scores everything alike, as clean.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    ranked = [known.where(f"toxic = {t}").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows) for t in (0, 1)]
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = F.broadcast(ranked[0].union(ranked[1]).select("doc_id", "toxic"))  # 2 * rows rows at most
    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text_of().alias("text")).join(wanted, "doc_id").select("doc_id", "lang", "toxic", "text")
    got = written(texts.mapInArrow(lean(_bucketed), "doc_id long, lang string, toxic int, words binary"), "fit", light=True).orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").limit(2 * rows).toArrow().to_pydict()
    words = [np.frombuffer(w, np.uint16).astype(np.int32).reshape(-1, PARTS) for w in got["words"]]
    toxic = np.array(got["toxic"], np.float64)
    if not 0 < toxic.sum() < len(toxic):
        return Model(np.zeros((BUCKETS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), -3.0, thresholds={})
    n = int(len(words) * (1 - CALIBRATION))
    m = train(words[:n], toxic[:n], seed=seed)
    share = np.where(toxic == 1, shares.get(1, 0) / toxic.sum(), shares.get(0, 0) / (1 - toxic).sum())
    calibrate(m, words[n:], toxic[n:], got["lang"][n:], share[n:])
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score the texts of `docs` (doc_id, text, lang, ...).

    Returns the columns of `docs` and toxic_score (0 to 1) and toxic_rejected (the score
    reaches the threshold of the row's language, or CUT without one). The score
    depends on the text alone; null and empty texts are scored as one pad word. Rows
    stay whatever they repeat; no rows: no rows. Columns named toxic_score or
    toxic_rejected are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # of fixed size
    names = [c for c in docs.columns if c not in ("toxic_score", "toxic_rejected")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            out = scorer.scores(b.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(out, pa.float64())], [*(f"c{i}" for i in range(len(names))), "score"])

    sent_cols = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), text_of().alias("t"))
    schema = sent_cols.select(*sent_cols.columns[:-1], F.lit(0.0).cast("double").alias("score")).schema
    got = sent_cols.mapInArrow(lean(scored), schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("score").alias("toxic_score"))
    cut = F.lit(CUT)
    if "lang" in names:
        for lang, t in (model.thresholds or {}).items():
            cut = F.when(F.col("lang") == lang, F.lit(t)).otherwise(cut)
    return got.withColumn("toxic_rejected", F.col("toxic_score") >= cut)
