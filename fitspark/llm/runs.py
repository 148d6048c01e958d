"""Runs of letters in a batch of texts, as one Arrow array, and sums of counts that a task makes before it sends them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct rows that a task sums up before it sends them on.
HELD_ROWS = 400_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: Bytes of ASCII letters and of all characters beyond ASCII.
TERM = ASCII_LETTER | (np.arange(256) >= 128)


def term_bytes(raw: np.ndarray) -> np.ndarray:
    return TERM[raw]


def latin_bytes(raw: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of U+00C0 to U+00FF, which UTF-8 writes as 0xC3 and one more byte."""
    lead = raw == 0xC3
    out = ASCII_LETTER[raw] | lead
    out[1:] |= lead[:-1]
    return out


def runs(texts: pa.Array, inside) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All maximal runs of bytes that are `inside`, A-Z in lower case, and the row of each.

    Works on the bytes of the whole batch at once; a run ends where its text ends.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    mask = inside(raw)
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    begins[first] = mask[first]
    starts = np.flatnonzero(begins)
    kept = LOWER[raw[mask]]
    # Places of the runs among the kept bytes.
    places = np.flatnonzero(begins[mask])
    rows = np.searchsorted(offsets, starts, side="right") - 1
    out = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(places, len(kept)).astype(np.int64)), pa.py_buffer(kept))
    return out, rows


def summed(tables: Iterator[pa.Table], keys: list[str], sums: list[str], held_rows: int = HELD_ROWS) -> Iterator[pa.RecordBatch]:
    """The tables with equal keys added up, as far as a task can hold them: rows go out when so many distinct ones are held."""
    order = keys + sums

    def total(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate([(c, "sum") for c in sums])
        return t.rename_columns({f"{c}_sum": c for c in sums}).select(order)

    held: list[pa.Table] = []
    rows, least = 0, 0
    for t in tables:
        held.append(t.select(order))
        rows += t.num_rows
        if rows >= max(held_rows, 2 * least):
            held = [total(held)]
            rows = least = held[0].num_rows
            if rows >= held_rows:
                yield from held[0].to_batches(max_chunksize=10_000)
                held, rows, least = [], 0, 0
    if held:
        yield from total(held).to_batches(max_chunksize=10_000)


def counted(values: pa.Array, rows: np.ndarray, n_rows: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, and each (row, value) that occurs as numbers with its count: (values, rows, value numbers, counts)."""
    coded = pc.dictionary_encode(values)
    n = max(1, len(coded.dictionary))
    pairs, count = np.unique(rows.astype(np.int64) * n + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    return coded.dictionary, pairs // n, pairs % n, count
