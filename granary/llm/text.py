"""Vectorised word kernels on Arrow string buffers.

Words are runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``); a UTF-8 continuation
byte is never one of those, so working on bytes equals working on code points. Hashes are 64 bits wide: a
polynomial of a random number for each byte value, read off prefix sums, mixed with the length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U = np.uint64
TASK_ROWS = 1 << 21  # rows of a few numbers that a task holds at once
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_A = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_powers = np.ones((2, 1), U)


def powers(n: int) -> np.ndarray:
    """The powers of _A up to the ``n``-th, and those of its inverse modulo 2**64."""
    global _powers
    if _powers.shape[1] <= n:
        out = np.empty((2, max(n + 1, 1 << 16)), U)
        out[:, 0] = 1
        out[0, 1:], out[1, 1:] = U(_A), U(pow(_A, -1, 1 << 64))
        np.multiply.accumulate(out, axis=1, out=out)
        _powers = out
    return _powers


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0) if col.num_chunks else pa.array([], col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Consecutive slices of a batch whose text holds at most ``limit`` bytes (or is a single row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one entry more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edge = off[(off > 0) & (off < len(data))]
    start[edge] |= word[edge]
    end[edge - 1] |= word[edge - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def spans_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the disjoint, ascending byte spans [s, e)."""
    if not len(s):
        return np.zeros(0, U)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.multiply(_BYTES[data], up[: len(data)], out=total[1:])
    np.cumsum(total, out=total)
    return mix(((total[e] - total[s]) * down[s]) ^ ((e - s).astype(U) * U(0xD6E8FEB86659FD93)))


def word_hashes(col, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a string column and each row's first index into them."""
    data, off = utf8(col)
    if lower:
        data = LOWER[data]
    s, e, first = words(data, off)
    return spans_hash(data, s, e), first


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` consecutive entries that start at each position but the last n - 1."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    # A polynomial over prefix sums: sum of h[i+j] * a**j, times a common power that is divided out.
    if n <= 8:
        out = np.zeros(m, U)
        for j in range(n):
            out *= U(_A)
            out += hashes[j : j + m]
        return mix(out)
    up, down = powers(len(hashes))
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[:m])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths), lengths)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows, partitioned by ``keys`` so that a task gets about TASK_ROWS at most, whatever the size."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > least else df.repartition(*keys)
