"""Word and byte views of an Arrow string column as flat numpy arrays.

The helpers work on whole record batches at once (no per-word Python): a
batch is cut into blocks of a few megabytes of text, so that the temporary
arrays of one task stay bounded whatever the row count of a batch; a single
text longer than a block is one block of its own.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Gives the freed memory of numpy arrays back; glibc keeps those below a size that grows with use.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)
U64 = np.uint64
BLOCK_BYTES = 2 << 20
_MULT = U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers, the same in every task."""
    return mix64(np.arange(1, n + 1, dtype=U64) * _MULT + U64(seed))


_BYTE = seeded(256, 11)
_BASE = U64(0xD6E8FEB86659FD93)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = max(1 << n.bit_length(), 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            run = np.full(size, base, dtype=U64)
            run[0] = 1
            _powers[name] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``p`` with ``p[j] - p[i]`` fixing the bytes ``data[i:j]`` (see span_hash)."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * _MULT)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its len+1 bounds; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def blocks(batches, column: str, limit: int = BLOCK_BYTES):
    """Cut record batches into sub-batches of about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.diff(flat(col)[1])
        group = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)
        # else a worker keeps the peak of all its batches
        pa.default_memory_pool().release_unused()
        _trim(0)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal True runs; a run never crosses a bound."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, bounds: np.ndarray):
    """Word starts, ends and row numbers; a word is ``[^\\x20\\x09-\\x0D]+``."""
    starts, ends = runs(~_SPACE[data], bounds)
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def shingles(word: np.ndarray, row: np.ndarray, width: int):
    """Hashes and first-word numbers of all ``width``-word windows inside one row."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[width - 1:])
    total = np.zeros(len(at), dtype=U64)
    for j, c in enumerate(seeded(width, 77)):
        total += mix64(word[at + j] + c) * (c | U64(1))
    return mix64(total), at
