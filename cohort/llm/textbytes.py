"""Words and their hashes for whole Arrow columns of text, by numpy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; features of words take some fifty times as much in a worker.
CHUNK = 1 << 18

_codes = np.arange(256)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
#: Bytes of words: digits, letters, and all bytes of letters beyond ASCII.
IN_WORD = (((_codes >= 48) & (_codes <= 57)) | ((_codes >= 97) & (_codes <= 122))
           | ((_codes >= 65) & (_codes <= 90)) | (_codes >= 128))
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection), so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A 64-bit code for each byte, letters in lower case.
BYTE_CODE = mix((LOWER.astype(np.uint64) + np.uint64(1)) * BASE)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * (out[done - 1:done] * BASE)
        done += step
    return out


def chunks(column: pa.Array, budget: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``budget`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[
        column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + budget, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words end where their text ends."""
    inside = IN_WORD[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    if len(data) == 0:
        at = at[:0]
    start, end = at[:-1], at[1:]
    kept = inside[start] if len(start) else np.zeros(0, bool)
    start, end = start[kept], end[kept]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z as a-z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    ends = np.cumsum(length)
    place = np.arange(ends[-1]) - np.repeat(ends - length, length)
    codes = BYTE_CODE[data[np.repeat(start, length) + place]]
    return mix(np.add.reduceat(codes * powers(int(length.max()))[place], ends - length)
               + length.astype(np.uint64) * BASE)


def run_hashes(hashes: np.ndarray, rows: np.ndarray, length: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each run of ``length`` words within a row; a shorter row is one run."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    counts = np.diff(np.r_[head, n])
    total = hashes.copy()
    left = np.repeat(head + counts, counts) - np.arange(n)  # words from here to the end of the row
    for k in range(1, length):
        more = np.zeros(n, np.uint64)
        more[:max(n - k, 0)] = hashes[k:]
        more[left <= k] = 0
        total = mix(total) + more
    kept = left >= np.minimum(length, np.repeat(counts, counts))
    first = np.flatnonzero(kept)
    return mix(total[first] + np.uint64(length)), first
