"""Vectorised text kernels over Arrow string buffers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  All separators are ASCII, so
splitting the UTF-8 bytes equals splitting the code points.  Everything here works on a
bounded slice of a batch (see :func:`slices`), so memory does not grow with the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_LIBC = ctypes.CDLL(None)
U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)
_LONG_WORD = 512


def lean(work: Callable) -> Callable:
    """A batch function whose worker gives the memory it no longer needs back when its task ends:
    Spark keeps workers for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each slice has about ``most`` bytes of text; a longer single
    text makes a slice of its own and stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Word starts and lengths of a slice; ``first[d]:first[d + 1]`` are the words of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        word = ~_SPACE[data]
        opens, closes = word.copy(), word.copy()
        if n:
            inner = offsets[(offsets > 0) & (offsets < n)]
            opens[1:] &= ~word[:-1]
            opens[inner] |= word[inner]
            closes[:-1] &= ~word[1:]
            closes[inner - 1] |= word[inner - 1]
        self.starts = np.flatnonzero(opens)
        self.lens = np.flatnonzero(closes) + 1 - self.starts
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int) -> np.ndarray:
        """64-bit hashes of the words' bytes."""
        return hash_pieces(self.data, self.starts, self.lens, seed)


def hash_pieces(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the byte ranges ``starts[i] : starts[i] + lens[i]``."""
    raw = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    at = np.ndarray((len(data) + 1,), dtype="<u8", buffer=raw, strides=(1,))
    h = lens.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed)
    h = mix(h ^ (at[starts] & _MASK[np.minimum(lens, 8)]))
    left, k = np.flatnonzero((lens > 8) & (lens <= _LONG_WORD)), 8
    while left.size:
        rest = lens[left] - k
        h[left] = mix(h[left] * U64(0xA0761D6478BD642F) ^ (at[starts[left] + k] & _MASK[np.minimum(rest, 8)]))
        left, k = left[rest > 8], k + 8
    if (huge := np.flatnonzero(lens > _LONG_WORD)).size:
        from hashlib import blake2b

        for i in huge:
            own = blake2b(raw[starts[i] : starts[i] + lens[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
            h[i] = U64(int.from_bytes(own.digest(), "little"))
    return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _POWERS.get(base, (np.ones(0, U64), np.ones(0, U64)))
    if len(up) < n:
        size = max(n, 1 << 20)
        inverse = pow(base, -1, 1 << 64)
        up, down = (np.concatenate([[U64(1)], np.cumprod(np.full(size - 1, b, dtype=U64))]) for b in (U64(base), U64(inverse)))
        if size <= 1 << 22:
            _POWERS[base] = up, down
    return up, down


def rolling(words: np.ndarray, width: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Hashes of the ``len(words) - width + 1`` windows of ``width`` consecutive values (Karp-Rabin
    modulo 2**64 with an odd base, then mixed).  Windows over text borders are the caller's to drop."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    up, down = _powers(base, len(words) + 1)
    total = np.concatenate([[U64(0)], np.cumsum(words * up[: len(words)], dtype=U64)])
    return mix((total[width:] - total[:-width]) * down[:n])


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(global start, text) of each window of ``width`` words that lies within one text."""
    counts = np.diff(first)
    n = np.maximum(counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    return start, text
