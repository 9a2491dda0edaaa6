"""Vectorised text arithmetic shared by the training-data operators.

Everything works on one Arrow string column at a time: its UTF-8 buffer is one
byte array and each document a slice of it, so words, n-grams and character
classes of a whole batch are found by a few numpy passes and no per-word Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available

U64 = np.uint64
#: Multipliers of the word hash and the mixer (odd 64-bit constants).
_RADIX = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_SPAN = 1 << 22

_pows: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2^64, n of each."""
    have = _pows.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.empty(size, U64)
        q = np.empty(size, U64)
        with np.errstate(over="ignore"):
            for out, radix in ((p, _RADIX), (q, pow(_RADIX, -1, 1 << 64))):
                out[0] = 1
                done = 1
                while done < size:  # doubling: out[done:2*done] = out[:done] * radix**done
                    take = min(done, size - done)
                    out[done : done + take] = out[:take] * U64(pow(radix, done, 1 << 64))
                    done += take
        _pows["p"], _pows["q"] = p, q
    return _pows["p"][:n], _pows["q"][:n]


def string_buffer(column: pa.Array, kind: pa.DataType | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column, or of a binary one with kind; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if kind is None else b"")
    column = column.cast(kind or pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - (offsets[0] if len(offsets) else 0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = _SPAN) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice has at most most_bytes of text, or one document."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pa.compute.binary_length(text).fill_null(0), np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


#: White space: the space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Letters as seen in bytes: ASCII letters, and every byte of a longer UTF-8 sequence.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
#: ASCII upper case to lower case.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a run never crosses documents."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    last = np.zeros(n + 1, bool)
    last[offsets[1:]] = True
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | last[1:])) + 1
    return starts, ends


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice raw[start:end], from one prefix sum over the batch.

    The sum of byte * radix**position is taken modulo 2^64, shifted back to the
    slice's start by the inverse power and mixed with the length.
    """
    if len(starts) == 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        power, inverse = _powers(len(raw) + 1)
        total = np.empty(len(raw) + 1, U64)
        total[0] = 0
        np.cumsum((raw.astype(U64) + U64(1)) * power[:-1], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        return mix64(h + mix64((ends - starts).astype(U64)))


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents in order, and word offsets by document.

    A word is a maximal run of true bytes of ``inside``; by default of non-space.
    """
    starts, ends = runs(~SPACE[raw] if inside is None else inside, offsets)
    return run_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, and shingle offsets by document.

    A document of 1 to n - 1 words has one shingle, all its words; one without
    words has none.
    """
    counts = np.diff(offsets)
    own = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(own)])
    doc = np.repeat(np.arange(len(counts)), own)
    at = np.arange(out_offsets[-1]) - out_offsets[:-1][doc] + offsets[:-1][doc]
    left = offsets[1:][doc] - at
    padded = np.concatenate([hashes, np.zeros(n, U64)])
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), U64)
        for k in range(n):
            h = h * U64(_RADIX) + np.where(k < left, padded[at + k], U64(k + 1))
        return mix64(h), out_offsets

