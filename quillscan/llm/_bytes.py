"""Texts as flat byte arrays: Arrow's buffers seen by numpy, cut into words, hashed without Python strings."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Letters and digits of ASCII, and every byte of a longer character.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])

_rng = np.random.default_rng(20240229)
_MIXED = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows (one more than rows); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32, len(texts) + 1, texts.offset * (8 if large else 4)).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(offsets: np.ndarray, most_bytes: int = 1_000_000, most_rows: int = 2_000):
    """Ranges of rows with about so many bytes, one row at least: whole rows, so a very long text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most_bytes, "right")) - 1
        b = min(max(a + 1, b), a + most_rows, n)
        yield a, b
        a = b


def release() -> None:
    """Give freed memory back to the system, since Python workers outlive tasks."""
    if len(_powers[0]) > 4_000_000:
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def lean(run):
    """``run`` over a task's batches, with ``release`` at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def lean_groups(run, every: int = 32_000_000):
    """``run`` over the table of a group, with ``release`` after so many bytes of them."""
    held = [0]

    def wrapped(table):
        out = run(table)
        held[0] += table.nbytes
        if held[0] > every:
            held[0] = 0
            del table
            release()
        return out

    return wrapped


def lean_cogroups(run, every: int = 32_000_000):
    """The same over the two tables of a group."""
    held = [0]

    def wrapped(left, right):
        out = run(left, right)
        held[0] += left.nbytes + right.nbytes
        if held[0] > every:
            held[0] = 0
            del left, right
            release()
        return out

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(raw: np.ndarray, fold: bool = False) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes (A-Z lower-cased if ``fold``), for ``span``."""
    n = len(raw)
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n + 65536, base, np.uint64))])
    table = _MIXED[LOWER] if fold else _MIXED
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(table[raw] * _powers[0][:n], out=out[1:])
    return out


def span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings [start, end), equal for equal strings wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes for which ``inside`` holds (default: not white space)."""
    n = len(raw)
    on = np.zeros(n + 1, bool)
    on[:n] = (~SPACE if inside is None else inside)[raw]
    first = on[:n].copy()
    first[1:] &= ~on[: n - 1]
    last = on[:n] & ~on[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    first[edge] = on[edge]
    last[edge - 1] = on[edge - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
