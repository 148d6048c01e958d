"""Byte-level BPE encoding and decoding by replaying merges over a block's distinct pieces."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitspark.llm.common import lean, small_batches, text_of

#: A block of texts is encoded when it has this many new distinct pieces or this many pieces in all.
BLOCK_NEW = 100_000
BLOCK_PIECES = 2_000_000
#: Pieces whose ids a task keeps between blocks; all are forgotten beyond it.
KEPT_PIECES = 250_000

NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of byte strings, and the rank that each mergeable pair of tokens gives."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ids = np.fromiter(self.ranks.values(), np.int64, len(self.ranks))
        size = int(ids.max()) + 1
        self.bytes_of = [b""] * size
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(left << 32 | right, rank) for token, rank in self.ranks.items() for cut in range(1, len(token)) if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs] + [2**62], np.int64)
        self.gives = np.array([p[1] for p in pairs] + [NONE], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.gives[at], NONE)


def merge_replay(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row, and the number of each piece's ids.

    All bytes of all pieces stand in one array as a linked list. An inverted
    index maps the rank of a pair to the positions where it stands; the least
    rank is taken from a heap, all its positions merge at once (of overlapping
    ones the leftmost first), and only the pairs with the two neighbours are
    looked up anew. A piece that is a token itself is that token.
    """
    if not pieces:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    whole = np.fromiter((vocabulary.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    parts = np.flatnonzero(whole < 0)
    counts = np.ones(len(pieces), np.int64)
    ids = np.zeros(0, np.int32)
    if len(parts):
        raw = np.frombuffer(b"".join(pieces[i] for i in parts), np.uint8)
        own = np.repeat(np.arange(len(parts), dtype=np.int32), sizes[parts])
        n = len(raw)
        token = vocabulary.of_byte[raw]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        last = np.flatnonzero(np.diff(own, append=-1))
        after[last] = -1
        before[np.concatenate([[0], last[:-1] + 1])] = -1
        rank = np.full(n, NONE, np.int32)
        has = np.flatnonzero(after >= 0).astype(np.int32)
        rank[has] = vocabulary.pair_ranks(token[has], token[after[has]])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Add the positions to the index under their pairs' ranks."""
            r = rank[at]
            at, r = at[r != NONE], r[r != NONE]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            lo = 0
            for hi in [*cuts.tolist(), len(r)]:
                key = int(r[lo])
                if (there := index.get(key)) is None:
                    index[key] = [at[lo:hi]]
                    heapq.heappush(heap, key)
                else:
                    there.append(at[lo:hi])
                lo = hi

        enter(has)
        while heap:
            now = heapq.heappop(heap)
            lists = index.pop(now)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == now]
            if not len(at):
                continue
            prev = before[at]
            chained = (prev >= 0) & (rank[prev] == now)
            if chained.any():
                starts = np.flatnonzero(~chained)
                in_run = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
                at = at[in_run % 2 == 0]
            right = after[at]
            beyond = after[right]
            token[at] = now
            alive[right] = False
            rank[right] = NONE
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            rank[at] = NONE
            rank[at[inner]] = vocabulary.pair_ranks(token[at[inner]], token[beyond[inner]])
            prev = before[at]
            at_prev, prev = at[prev >= 0], prev[prev >= 0]
            rank[prev] = vocabulary.pair_ranks(token[prev], token[at_prev])
            enter(np.unique(np.concatenate([at, prev])) if len(prev) else at)
        ids = token[alive].astype(np.int32)
        counts[parts] = np.bincount(own[alive], minlength=len(parts))
    # Put the ids of whole tokens and of merged pieces in the order of the pieces.
    out = np.empty(int(counts.sum()), np.int32)
    merged = np.repeat(whole < 0, counts)
    out[merged] = ids
    out[~merged] = whole[whole >= 0]
    return out, counts


def take_runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after the other."""
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return values[shift + np.arange(len(shift))]


class Encoder:
    """Encodes blocks of texts; keeps the ids of the pieces it has met, up to a bound."""

    def __init__(self, path: str, pattern: str, kept: int = KEPT_PIECES) -> None:
        self.vocabulary, self.pattern, self.kept = Vocabulary(path), regex.compile(pattern), kept
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int64)
        self.pending: list[str] = []

    def pieces_of(self, text: str) -> np.ndarray:
        """The text's pieces as numbers; unknown ones get a number and wait for replay()."""
        known, out = self.known, []
        for p in self.pattern.findall(text):
            if (i := known.get(p)) is None:
                i = known[p] = len(known)
                self.pending.append(p)
            out.append(i)
        return np.array(out, np.int32)

    def replay(self) -> None:
        if self.pending:
            ids, counts = merge_replay([p.encode() for p in self.pending], self.vocabulary)
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            self.pending = []
            self.starts = np.cumsum(self.counts) - self.counts

    def ids_of(self, pieces: np.ndarray) -> np.ndarray:
        return take_runs(self.ids, self.starts[pieces], self.counts[pieces]) if len(pieces) else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        v = self.vocabulary
        return take_runs(v.blob, v.starts[ids], v.lengths[ids]).tobytes() if len(ids) else b""


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This Python worker's encoder; its vocabulary is kept between tasks."""
    if (path, pattern) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _encoded(path: str, pattern: str, with_ids: bool):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32()), pa.string()] * with_ids]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, np.ndarray]] = []
        total = 0
        e = encoder(path, pattern)

        def flush():
            nonlocal total
            e.replay()
            for lo in range(0, len(held), 256):
                rows = []
                for doc_id, pieces in held[lo : lo + 256]:
                    ids = e.ids_of(pieces)
                    raw = e.decode(ids)
                    row = (doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
                    rows.append(row + (ids, raw.decode()) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
            held.clear()
            total = 0
            if len(e.known) > e.kept:
                e.forget()

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pieces = e.pieces_of(text)
                held.append((doc_id, pieces))
                total += len(pieces) + 16
                if total >= BLOCK_PIECES or len(e.pending) >= BLOCK_NEW:
                    yield from flush()
        if held:
            yield from flush()
        e.forget()  # the worker may wait for other work with what it holds

    return mapped


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """Encode the texts of `docs` (doc_id, text, ...) by the ranks in `path`, and decode the ids.

    Returns one row per row: doc_id, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded bytes),
    and ids and decoded if `with_ids`. Null text counts as empty, which has no
    tokens. Rows with null doc_id and repeated rows stay. Other columns are
    ignored; no rows: no rows.

    It moves no rows: a task gathers the distinct pieces of its own texts and replays
    the merges over them, in blocks of bounded size.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(lean(_encoded(path, pattern, with_ids)), schema)
