"""Word shingles of texts as 64-bit hashes, with numpy on whole batches.

Words are runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z. A text's set holds the
hashes of its distinct runs of five words; a text of fewer words has its whole sequence as one element; a
text without words has an empty set. Work is on bytes: no Python object is made per word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = U(0xD6E8FEB86659FD93)
_TAG = U(0xA0761D6478BD642F)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INK = np.ones(256, dtype=bool)
_INK[[0x20, *range(0x09, 0x0E)]] = False


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(size, U(base))
                p[0] = 1
                setattr(self, name, np.cumprod(p))
        return self.up, self.down


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def spans(ink: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``ink``, none across two texts."""
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = offsets[(offsets > 0) & (offsets < len(ink))]
    first[inner] |= ink[inner]
    last[inner - 1] |= ink[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Hashes:
    """Hashes of any stretches of some bytes, from one pass over them."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers.to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of each text's words."""
    start, end = spans(_INK[data], offsets)
    return Hashes(_FOLD[data]).of(start, end), np.searchsorted(start, offsets)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle hashes, one after another, and their offsets."""
    data, offsets = text_bytes(column)
    w, at = words(data, offsets)
    n = np.diff(at)
    size = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    h = np.empty(out[-1], dtype=U)
    if len(w) >= WIDTH:
        m = len(w) - WIDTH + 1
        run = w[:m].copy()
        for k in range(1, WIDTH):
            run = run * _STEP + w[k : k + m]
        run = mix(run)
    for i in np.flatnonzero(size):
        a, b, lo = out[i], out[i + 1], at[i]
        if n[i] >= WIDTH:
            h[a:b] = run[lo : lo + b - a]
            h[a:b].sort()
        else:
            x = U(int(n[i]))
            for v in w[lo : lo + n[i]]:
                x = U((int(x) * int(_STEP) + int(v)) % (1 << 64))
            h[a] = mix(np.array([x ^ _TAG]))[0]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    full = out[:-1][size > 0]
    new[full] = True
    kept = np.zeros(len(h) + 1, np.int64)
    np.cumsum(new, out=kept[1:])
    return h[new], kept[out]


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
