"""Byte and word arithmetic shared by the text operators: numpy over one bounded block at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: White space that parts words: space and bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: A fixed random 64-bit value for each byte.
BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
#: Odd multipliers of the two independent rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; kept, and grown when a longer block comes."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(BASES[which], -1, 2**64) if inverse else BASES[which]
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[which, inverse] = np.cumprod(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads entropy over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(symbols: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of each run of n neighbouring symbols."""
    if len(symbols) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols), which), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(len(symbols) - n + 1, which, True))


def blocks(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


_multipliers: dict[int, np.ndarray] = {}


def multipliers(n: int, which: int) -> np.ndarray:
    """n odd numbers without a rule between them, so that no pattern of bytes cancels out in sums of their products."""
    have = _multipliers.get(which)
    if have is None or len(have) < n:
        have = _multipliers[which] = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * np.uint64(BASES[which])) | np.uint64(1)
    return have[:n]


class Words:
    """The words of some texts: where each starts and ends in `data`, its text's number and two hashes, independent of each other."""

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join(texts) + b" "
        self.data = np.frombuffer(self.raw, np.uint8)
        self.gap = SPACE[self.data]
        edge = np.flatnonzero(np.diff(self.gap, prepend=True))
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.hash = self.hashes(0)

    def hashes(self, which: int) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = (self.end - self.start).astype(np.int32)
        begin = np.cumsum(size, dtype=np.int32) - size
        inner = np.arange(size.sum(), dtype=np.int32) - np.repeat(begin, size)
        sums = np.add.reduceat(BYTE_CODE[self.data[~self.gap]] * multipliers(int(size.max()), which)[inner], begin)
        return mix(sums + size.astype(np.uint64))

    @cached_property
    def second(self) -> np.ndarray:
        return self.hashes(1)


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `width` grams the value of its least gram, and where that gram first stands in the window.

    Both depend only on what the window holds, so equal windows get equal values and places in them wherever they stand.
    width is 64 at most: the low 6 bits of each key carry the place in its block of `width` grams. A window is the end of one
    block and the beginning of the next.
    """
    n = len(grams) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, six = np.uint64(63), np.uint64(6)
    keys = np.full(-(-len(grams) // width) * width, ~low, np.uint64)
    keys[: len(grams)] = grams & ~low
    keys = keys.reshape(-1, width) | np.arange(width, dtype=np.uint64)
    left = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    right = np.minimum.accumulate(keys, axis=1).ravel()[width - 1 : width - 1 + n]
    later = (right >> six) < (left >> six)
    best = np.where(later, right, left)
    at = np.arange(n) + np.where(later, width - 1, 0)
    return best >> six, at // width * width + (best & low).astype(np.int64)
