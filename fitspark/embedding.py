"""Embeddings without a network: hashed bags of tokens, the same on every machine."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitspark.cluster import ship
from fitspark.functions.text import STOPWORDS


class EmbeddingBackend(Protocol):
    """Turns texts into vectors of one length. It is created anew in each task, so it must be picklable."""

    model: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedding:
    """Sums a pseudo-random unit vector for each token; texts that share tokens are similar."""

    model = "hashed-tokens"

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim
        self._of: dict[str, np.ndarray] = {}

    def _token(self, token: str) -> np.ndarray:
        if token not in self._of:
            raw = b"".join(hashlib.sha256(f"{token}:{i}".encode()).digest() for i in range(-(-self.dim * 4 // 32)))
            v = np.frombuffer(raw, "<u4")[: self.dim].astype(np.float64) / 2**31 - 1
            self._of[token] = v / np.linalg.norm(v)
        return self._of[token]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            words = {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 1 and w not in STOPWORDS}
            v = sum((self._token(w) for w in sorted(words)), np.zeros(self.dim))
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    def __getstate__(self) -> dict:
        return {"dim": self.dim, "_of": {}}


class DigestEmbedding:
    """One SHA-256 for each dimension: unit vectors that only equal texts share. For tests of storage."""

    model, dim = "digest", 32

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.array([int.from_bytes(hashlib.sha256(f"{i}:{t}".encode()).digest()[:4], "big") / 2**31 - 1 for i in range(self.dim)])
            out.append((v / np.linalg.norm(v)).tolist())
        return out


class TermEmbedding:
    """Marks which of some terms a text has, and a one: vectors that can be worked out by hand."""

    model = "terms"

    def __init__(self, terms: tuple[str, ...]) -> None:
        self.terms, self.dim = terms, len(terms) + 1

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[*(float(t in (x or "").lower()) for t in self.terms), 1.0] for x in texts]


def embed_texts(rows: DataFrame, backend: EmbeddingBackend, *, text: str = "text", vector: str = "vector") -> DataFrame:
    """Add the vector of each text, in batches."""

    ship(rows.sparkSession)

    def embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = backend.embed([t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], [*b.schema.names, vector])

    return rows.mapInArrow(embedded, rows.withColumn(vector, F.expr("cast(array() as array<double>)")).schema)


def cosines(vectors: list[list[float]], asked: list[list[float]]) -> np.ndarray:
    """The cosine similarity of each vector to each asked one; 0 for empty vectors, unequal lengths and zero vectors. A row does not depend on the others."""
    out = np.zeros((len(vectors), len(asked)))
    of_length: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        of_length.setdefault(len(v), []).append(i)
    for k, a in enumerate(asked):
        at = of_length.get(len(a), []) if len(a) else []
        if at:
            m, q = np.array([vectors[i] for i in at], np.float64), np.array(a, np.float64)
            n = np.sqrt((m * m).sum(axis=1)) * np.sqrt((q * q).sum())
            out[at, k] = np.divide((m * q).sum(axis=1), n, out=np.zeros(len(at)), where=~(n <= 0))
    return out


def similar_lists(backend: EmbeddingBackend, asked: list[list[float]]):
    """A column function that turns an array of texts into the similarities of each to the asked vectors; no vector comes back, and each text of a batch is embedded once."""

    @F.arrow_udf("array<array<double>>")
    def similar(lists: pa.Array) -> pa.Array:
        texts = [x or [] for x in lists.to_pylist()]
        distinct = sorted({t or "" for x in texts for t in x})
        of = dict(zip(distinct, cosines(backend.embed(distinct), asked).tolist()))
        return pa.array([[of[t or ""] for t in x] for x in texts], pa.list_(pa.list_(pa.float64())))

    return similar


def similarities(rows: DataFrame, backend: EmbeddingBackend, asked: list[list[float]], *, texts: str, into: str) -> DataFrame:
    """Add the similarities of an array of texts to the asked vectors, as array<array<double>>."""
    ship(rows.sparkSession)
    return rows.withColumn(into, similar_lists(backend, asked)(F.col(texts)))
