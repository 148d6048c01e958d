"""BPE encoding and decoding of words with an end mark, by a contiguous array of ranks for each word."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitspark.llm.common import lean, small_batches, text_of

#: A word of more symbols has its ranks in a numpy array, which is scanned as one.
SHORT = 64
#: Widths of the matrices that words of like length share, and their rows at most.
WIDTHS, ROWS = (4, 8, 12, 16, 24, 32, SHORT), 4096
#: Characters of texts that are encoded together, about.
BLOCK_CHARS = 1 << 20
#: Chunks between white space whose ids a worker keeps, of so many characters at most: beyond the number, those that the last so many did without go.
KEPT, KEPT_CHARS = 250_000, 64

NONE = 2**31 - 1
#: Marks a chunk that is one piece, however Python's pattern would split it. No other chunk has white space.
WHOLE = "\n"
#: What str.split() takes for white space and the pattern does not.
NO_SPACE = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


#: Beyond the first plane, versions of Unicode differ most.
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def unassigned() -> re.Pattern:
    """Code points of the first plane that Python's and the library's versions of Unicode may treat differently: unassigned ones, and composing ones added since the oldest version."""
    oldest = unicodedata.ucd_3_2_0
    odd = [c for c in range(0x10000) if unicodedata.category(x := chr(c)) == "Cn" or oldest.category(x) == "Cn" and (unicodedata.combining(x) or unicodedata.decomposition(x))]
    return re.compile("[" + "".join(f"\\u{c:04x}" for c in odd) + "]")


class Words:
    """A vocabulary with ranked merges, and the encoding of pieces by them.

    Made for files that normalise by NFC, white space and lower case, split by a
    pattern, show bytes as characters, and mark a word's end by a suffix. They name no
    decoder, so decoded tokens are joined by spaces and keep their marks.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = lambda name, each: [x["type"] for x in (spec.get(name) or {}).get(each, [])]
        kinds = steps("normalizer", "normalizers"), steps("pre_tokenizer", "pretokenizers")
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["model"]["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError(f"{path} is of another kind: {kinds}")
        self.path = path
        vocab, merges, end = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.token = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.of_byte = [vocab[c] for c in byte_alphabet()]
        self.of_last = [vocab[c + end] for c in byte_alphabet()]
        self.rank, self.gives = {}, []
        for r, (a, b) in enumerate(merges):
            self.rank[vocab[a] << 32 | vocab[b]] = r
            self.gives.append(vocab[a + b])
        made = {g: r for r, g in reversed(list(enumerate(self.gives)))}
        #: Whether a merge only makes pairs of larger ranks, so that all places of the least rank may merge in one scan.
        self.ordered = all(made.get(k >> 32, -1) < r and made.get(k & 0xFFFFFFFF, -1) < r for k, r in self.rank.items())
        self.keys = np.array(sorted(self.rank) + [2**62], np.int64)
        self.key_ranks = np.array([self.rank.get(int(k), NONE) for k in self.keys], np.int64)
        self.gives_array = np.array(self.gives, np.int64)
        self.unassigned = unassigned()
        self._library = None
        self.forget()

    def forget(self) -> None:
        self.ids_of: dict[str, str] = {}
        self.shown: dict[str, str] = {}
        self.old_ids: dict[str, str] = {}
        self.old_shown: dict[str, str] = {}
        self.long: list[str] = []

    def age(self) -> None:
        """Chunks that are used again move back from the old ones; the rest go with the next ageing."""
        if len(self.ids_of) > KEPT:
            self.old_ids, self.old_shown = self.ids_of, self.shown
            self.ids_of, self.shown = {}, {}

    def symbols(self, piece: bytes) -> list[int]:
        return [self.of_byte[b] for b in piece[:-1]] + [self.of_last[piece[-1]]]

    def merged(self, words: list[list[int]]) -> list[list[int]]:
        """The ids of words of these symbols.

        Each word has a row: `ids` holds the part that begins at each boundary, and
        `ranks`, beside it, the rank of the pair that it forms with the next part. In
        every step the leftmost least rank of each row is found by a scan; the boundary
        behind its first part goes, and the ranks of the pairs on both sides are looked
        up again. Rows that have no pair left are done.
        """
        out: list[list[int]] = [[]] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(size > SHORT):
            out[i] = self.merged_long(words[i])
        low = 0
        for most in WIDTHS:
            mine = np.flatnonzero((size > low) & (size <= most))
            low = most
            for first in range(0, len(mine), ROWS):
                rows, n = mine[first : first + ROWS], size[mine[first : first + ROWS]]
                width = int(n.max())
                place = np.arange(width)
                ids = np.zeros((len(rows), width + 1), np.int64)
                ids[:, :width][place < n[:, None]] = np.fromiter((x for i in rows for x in words[i]), np.int64, int(n.sum()))
                ranks = np.where(place < n[:, None] - 1, self.pair_ranks(ids[:, :-1], ids[:, 1:]), NONE)
                while len(rows):
                    at = ranks.argmin(1)
                    every = np.arange(len(rows))
                    least = ranks[every, at]
                    done = least == NONE
                    if done.any():
                        for i, k, row in zip(rows[done], n[done], ids[done]):
                            out[i] = row[:k].tolist()
                        live = ~done
                        rows, n, ids, ranks, at, least = rows[live], n[live], ids[live], ranks[live], at[live], least[live]
                        every = np.arange(len(rows))
                    if not len(rows):
                        break
                    ids[every, at] = self.gives_array[least]
                    # What stands behind moves up by one.
                    ids[:, :-1] = np.where(place > at[:, None], ids[:, 1:], ids[:, :-1])
                    ranks[:, :-1] = np.where(place[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
                    ranks[:, -1] = NONE
                    n = n - 1
                    behind = self.pair_ranks(ids[every, at], ids[every, at + 1])
                    ranks[every, at] = np.where(at + 1 < n, behind, NONE)
                    left = np.flatnonzero(at > 0)
                    ranks[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], ids[left, at[left]])
        return out

    def merged_long(self, symbols: list[int]) -> list[int]:
        """The same for any length: each scan merges all places of the least rank, of overlapping ones the leftmost first.

        A scan is one pass over the arrays and there is at most one for each rank, so
        a word of n symbols takes no n * n steps.
        """
        ids = np.array(symbols, np.int64)
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks) and (least := int(ranks.min())) != NONE:
            at = np.flatnonzero(ranks == least)
            if self.ordered:
                new_run = np.diff(at, prepend=-2) != 1
                first = np.flatnonzero(new_run)
                at = at[(np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) % 2 == 0]
            else:
                at = at[:1]
            ids[at] = self.gives[least]
            ids = np.delete(ids, at + 1)
            ranks = np.delete(ranks, at)
            now = at - np.arange(len(at))
            for i in (now[now < len(ranks)], now[now > 0] - 1):
                ranks[i] = self.pair_ranks(ids[i], ids[i + 1])
        return ids.tolist()

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_ranks[at], NONE)

    def learn(self, chunks: set[str]) -> None:
        """Get the ids and the decoding, joined by spaces, of chunks that are not known yet: by their pieces, which are kept as well."""
        known, shown, old, find = self.ids_of, self.shown, self.old_ids, self.pattern.findall
        new, fresh = [], []
        for c in chunks:
            if c in old:
                known[c], shown[c] = old[c], self.old_shown[c]
                continue
            pieces = [c] if c[0] == WHOLE else find(c)
            if len(pieces) > 1:
                new.append((c, pieces))
                fresh += pieces
            else:
                fresh.append(c)
        fresh = list({p for p in fresh if p not in known})
        token = self.token
        for p, ids in zip(fresh, self.merged([self.symbols(p.removeprefix(WHOLE).encode()) for p in fresh])):
            if len(ids) == 1:
                known[p], shown[p] = str(ids[0]), token[ids[0]]
            else:
                known[p], shown[p] = " ".join([str(i) for i in ids]), " ".join([token[i] for i in ids])
        for c, pieces in new:
            known[c], shown[c] = " ".join([known[p] for p in pieces]), " ".join([shown[p] for p in pieces])
        self.long += [c for some in (chunks, fresh) for c in some if len(c) > KEPT_CHARS]

    def library(self):
        """The public library, for its tables of Unicode only."""
        if self._library is None:
            import tokenizers

            self._library = tokenizers.Tokenizer.from_file(self.path)
        return self._library

    def chunks_of(self, part: str) -> list[str]:
        """What stands between white space in text without special tokens, normalised; or marked pieces, where the library split it.

        Pieces never hold white space, so what replaces it does not matter.
        """
        if not part.isascii():
            if ASTRAL.search(part) or self.unassigned.search(part):
                lib = self.library()
                back = {c: b for b, c in enumerate(byte_alphabet())}
                return [WHOLE + bytes(back[c] for c in p).decode() for p, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(part))]
            # Code point by code point, a capital sigma has one lower case only.
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        part = part.lower()
        return regex.findall(r"\S+", part) if NO_SPACE.search(part) else part.split()

    def encode_all(self, texts: list[str]) -> list[tuple[str, str]]:
        """All ids of each text and its decoding, each joined by spaces; special tokens inside a text are ids of their own."""
        cut = [[(p if p in self.special else None, [] if p in self.special else self.chunks_of(p)) for p in (self.special_split.split(t) if "<" in t else [t])] for t in texts]
        self.age()
        self.learn({c for parts in cut for _, chunks in parts for c in chunks if c not in self.ids_of})
        out = []
        for parts in cut:
            both = [(str(self.special[s]), s) if s is not None else (" ".join(map(self.ids_of.__getitem__, chunks)), " ".join(map(self.shown.__getitem__, chunks))) for s, chunks in parts]
            out.append((" ".join([a for a, _ in both if a]), " ".join([b for a, b in both if a])))
        for c in self.long:
            self.ids_of.pop(c, None)
            self.shown.pop(c, None)
        self.long = []
        return out

    def encode(self, text: str) -> tuple[str, str]:
        return self.encode_all([text])[0]


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    """This Python worker's vocabulary, kept between tasks."""
    if path not in _words:
        _words.clear()
        _words[path] = Words(path)
    return _words[path]


def _encoded(path: str, with_ids: bool):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32()), pa.string()] * with_ids]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(path)

        def block(docs: list[tuple[int | None, str]]) -> pa.RecordBatch:
            rows = []
            for (doc_id, _), (ids, decoded) in zip(docs, w.encode_all([t for _, t in docs])):
                row = (doc_id, ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append(row + (list(map(int, ids.split())), decoded) if with_ids else row)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            docs, held = [], 0
            for doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs.append(doc)
                held += len(doc[1])
                if held >= BLOCK_CHARS:
                    yield block(docs)
                    docs, held = [], 0
            if docs:
                yield block(docs)

    return mapped


def word_bpe_round_trip(docs: DataFrame, path: str, *, with_ids: bool = False) -> DataFrame:
    """Encode the texts of `docs` (doc_id, text, ...) with the word vocabulary in `path`, and decode the ids.

    Returns one row per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined
    by spaces), decoded_sha256 (of the decoded text in UTF-8), and ids and decoded
    if `with_ids`. Special tokens that stand in a text are their own ids; none are
    added, nothing is cut or padded. Null text counts as empty, which has no tokens.
    Rows with null doc_id and repeated rows stay. Other columns are ignored; no
    rows: no rows.

    It moves no rows. A distinct chunk between white space is encoded once for a Python
    worker, up to a bound of what it keeps.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(lean(_encoded(path, with_ids)), schema)
