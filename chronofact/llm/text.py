"""Vectorised word splitting and hashing over the byte buffers of Arrow batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is a polynomial of its bytes modulo
2**64 with a random value for each byte, mixed afterwards; texts are never copied into Python strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
#: Bytes handled at once; a longer word or text only makes a chunk longer where no white space allows a cut.
CHUNK = 1 << 19

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept while it suffices."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, CHUNK + 4096)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        _powers[base] = out
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit of the input moves every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` was made of."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(31)) ^ (x >> _U(62))) * _U(pow(0x94D049BB133111EB, -1, 2**64))
        x = (x ^ (x >> _U(27)) ^ (x >> _U(54))) * _U(pow(0xBF58476D1CE4E5B9, -1, 2**64))
        return x ^ (x >> _U(30)) ^ (x >> _U(60))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and for each text the number of words before it (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = apart[data]
    start = ~space
    start[1:] &= space[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    start[inner] = ~space[inner]
    end = ~space
    end[:-1] &= space[1:]
    end[inner - 1] = ~space[inner - 1]
    first = np.flatnonzero(start)
    return first, np.flatnonzero(end) + 1, np.searchsorted(first, offsets).astype(np.int64)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool, apart: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and for each text the number of words before it (n + 1 values).

    ``apart`` marks the bytes that are no part of words. With ``prefixes`` the hashes have further columns: of each
    word's first so many bytes (of the whole word if it is shorter).
    """
    first, last, at = bounds(data, offsets, apart)
    if not len(data):
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), first, last, at
    value, hashes, done = _BYTE_LOWER if lower else _BYTE, np.empty((1 + len(prefixes), len(first)), np.uint64), 0
    ends = [last, *(np.minimum(last, first + n) for n in prefixes)]
    with np.errstate(over="ignore"):
        while done < len(first):
            base = first[done]
            upto = max(int(np.searchsorted(last, base + CHUNK, "right")), done + 1)
            stop = int(last[upto - 1])
            total = np.empty(stop - base + 1, np.uint64)
            total[0] = 0
            np.cumsum(value[data[base:stop]] * _power(_BASE, stop - base), out=total[1:])
            a = first[done:upto] - base
            for own, end in zip(hashes, ends, strict=True):
                own[done:upto] = (total[end[done:upto] - base] - total[a]) * _power(_BASE_INV, stop - base)[a]
            done = upto
        for own, end in zip(hashes, ends, strict=True):
            own[:] = mix(own + (end - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return hashes.T if prefixes else hashes[0], first, last, at


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values (len - k + 1 of them); the caller drops runs over a text's end."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * _U(0xC2B2AE3D27D4EB4F) + hashes[i : i + m]
    return mix(out)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] values each, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def pieces(batch: pa.RecordBatch, column: str | int, limit: int = 4 * 2**20) -> list[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each (or one row)."""
    data, offsets = buffers(batch.column(column))
    out, row = [], 0
    while row < batch.num_rows:
        upto = max(int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1, row + 1)
        out.append(batch.slice(row, upto - row))
        row = upto
    return out


def carried(docs: DataFrame, columns: list[str], text_col: str) -> tuple[DataFrame, int]:
    """``docs`` with ``columns`` and, last, the text as ``__text`` (null: empty); the text itself stands in for it where it
    is among the columns, so that it is sent once. Also the place of the text."""
    kind = docs.select(F.col(text_col)).schema[0].dataType.simpleString()
    if text_col in columns and kind in ("string", "binary"):
        return docs.select(*(F.col(c) for c in columns)), columns.index(text_col)
    return docs.select(*(F.col(c) for c in columns), F.col(text_col).cast("binary" if kind == "binary" else "string").alias("__text")), len(columns)


def binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value of counts[i] items of ``flat`` for each i, without a copy for each."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * flat.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())]).cast(pa.binary())
