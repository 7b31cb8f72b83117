"""Vectorised tokenising and hashing over the UTF-8 buffers of Arrow string columns.

Every separator used here is ASCII, so words can be cut on bytes.  Work is done on slices of a few
MB, whatever the size of the Arrow batch; one text is never cut.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 21
_R = 0x9E3779B97F4A7C15 | 1
_RI = pow(_R, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _lut(is_word) -> np.ndarray:
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([lower[b] + 1 if is_word(lower[b]) else 0 for b in range(256)], U)


#: words [^\x20\x09-\x0D]+, A-Z lowered
BLANK_SEPARATED = _lut(lambda b: b != 32 and not 9 <= b <= 13)
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lowering A-Z
ALNUM = _lut(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: lines, as the bytes between \n; case is kept
LINES = np.array([0 if b == 10 else b + 1 for b in range(256)], U)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    t = _tables.get(name)
    if t is None or len(t) < n:
        size = max(n, SLICE_BYTES)
        t = np.full(size, base, U)
        t[0] = 1
        t = np.cumprod(t, dtype=U)
        if size <= 1 << 24:
            _tables[name] = t
    return t


def release() -> None:
    """Gives memory that a finished task no longer needs back to the system: workers live on, idle or not."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first, last, bytes, offsets) of runs of texts of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray, lut: np.ndarray):
    """(starts, ends, hashes, counts): byte spans and hashes of words, and the words of each text."""
    n = len(buf)
    empty = np.zeros(0, np.int64)
    if not n:
        return empty, empty, np.zeros(0, U), np.zeros(len(off) - 1, np.int64)
    v = lut[buf]
    w = v != 0
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    inner = off[(off > 0) & (off < n)]
    s[inner] = w[inner]
    e[inner - 1] = w[inner - 1]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    counts = np.diff(np.searchsorted(starts, off))
    if not len(starts):
        return starts, ends, np.zeros(0, U), counts
    v *= _powers("up", _R, n)[:n]
    h = np.add.reduceat(v, starts) * _powers("down", _RI, n)[starts]
    return starts, ends, mix(h + (ends - starts).astype(U) * U(0x2545F4914F6CDD1D)), counts


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words, without regard to the texts' ends."""
    if len(h) < k:
        return np.zeros(0, U)
    x = np.zeros(len(h) - k + 1, U)
    c = 0x9E3779B97F4A7C15
    for i in range(k):
        x += h[i : len(h) - k + 1 + i] * U(c)
        c = (c * 0xD1342543DE82EF95 + 2 * i + 1) & 0xFFFFFFFFFFFFFFFF | 1
    return mix(x + U(k))
