"""Words of whole texts, found and hashed in numpy over Arrow buffers.

A word is a run of bytes other than space and U+0009 to U+000D. These are single bytes in
UTF-8 and occur in no other character, so the search can run on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Words whose windows are hashed at once.
BLOCK_WORDS = 1 << 17

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(0x632BE59BD9B4E019)) * _U(0x9E3779B97F4A7C15))


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = randoms(256, 1)
_BYTE[SEPARATOR] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_PLACE = randoms(256, 2)


def places(n: int) -> np.ndarray:
    global _PLACE
    if len(_PLACE) < n:
        _PLACE = randoms(max(n, 2 * len(_PLACE)), 2)
    return _PLACE


@dataclass
class Chunk:
    """Some consecutive texts. bounds: each text's first word, and the number of words."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word: random values of byte and place, multiplied, summed and mixed."""
        if not len(self.starts):
            return np.zeros(0, _U)
        lengths = np.diff(np.append(self.starts, len(self.data)))
        head = self.starts[0]
        place = np.arange(head, len(self.data), dtype=np.int64) - np.repeat(self.starts, lengths)
        value = (_BYTE_LOWER if lower else _BYTE)[self.data[head:]]
        value *= places(int(lengths.max()))[place]
        return mix(np.add.reduceat(value, self.starts - head))

    def text(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts and each text's bounds; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts in chunks of about limit bytes, with the places of all words."""
    data, offsets = buffers(texts)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        inside = ~SEPARATOR[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[bounds] = True
        start, end = inside.copy(), inside.copy()
        if len(part):
            start[1:] &= ~inside[:-1] | cut[1:-1]
            end[:-1] &= ~inside[1:] | cut[1:-1]
        starts = np.flatnonzero(start)
        yield Chunk(lo, part, bounds, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds))
        lo = hi


def windows(hashes: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp: a rolling polynomial hash, modulo 2 to the 64, of every window of size word hashes.

    The sum of a prefix is kept once; a window is the difference of two prefixes, moved to the
    same power by the inverse of the odd base. The result is mixed so that all its bits serve.
    """
    n = len(hashes)
    if n < size:
        return np.zeros(0, _U)
    if n > BLOCK_WORDS + size:
        return np.concatenate([windows(hashes[i : i + BLOCK_WORDS + size - 1], size, base) for i in range(0, n - size + 1, BLOCK_WORDS)])
    up, down = _powers(n + 1, base)
    sums = np.zeros(n + 1, _U)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, _U)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def row_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The shingle set of one text: sorted distinct hashes of size words each; a shorter text is one shingle as a whole."""
    if not len(hashes):
        return np.zeros(0, _U)
    if len(hashes) < size:
        return mix(windows(hashes, len(hashes)) + _U(len(hashes)))
    return np.unique(windows(hashes, size))
