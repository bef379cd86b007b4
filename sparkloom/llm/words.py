"""Words and word n-grams of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. All hashes are fixed functions of the bytes, so every task agrees on them.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES, SLICE_ROWS = 512 << 10, 1 << 12

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (self._row(b, size) for b in (self.base, self.inverse))
        return self.up, self.down

    @staticmethod
    def _row(base: int, size: int) -> np.ndarray:
        row = np.full(size, base, U64)
        row[0] = 1
        return np.multiply.accumulate(row)


_BYTE_POWERS, _WORD_POWERS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def sequence_hashes(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``run_hashes`` gives the hash of any run of words."""
    up, _ = _WORD_POWERS.upto(len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=prefix[1:])
    return prefix


def run_hashes(prefix: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """Hashes of the runs of ``length`` words from each of ``start``."""
    _, down = _WORD_POWERS.upto(len(prefix))
    return mix((prefix[start + length] - prefix[start]) * down[start] + U64(0x632BE59BD9B4E019) * np.asarray(length).astype(U64))


@dataclass
class Words:
    """The words of a few consecutive texts: byte spans, hashes and the texts' offsets among the words."""

    first: int
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    prefix: np.ndarray
    data: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def grams(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the runs of ``length`` words from each of ``start``."""
        return run_hashes(self.prefix, start, length)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.offsets))


def arrow_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of an Arrow string column; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in ``data``, and the offsets of the texts among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]]) | cut[:-1]
    after = np.concatenate([space[1:], [True]]) | cut[1:]
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return start, end, np.searchsorted(start, offsets)


def slices(texts: pa.Array, size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes and at most ``rows`` (one text at least): first row, bytes, offsets."""
    data, offsets = arrow_bytes(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans of bytes."""
    up, down = _BYTE_POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def word_runs(texts: pa.Array, size: int = SLICE_BYTES, fold: bool = False) -> Iterator[Words]:
    """The words of all texts (with ``fold`` in ASCII lower case), some consecutive whole texts at a time."""
    for first, data, offsets in slices(texts, size):
        data = LOWER[data] if fold else data
        start, end, at = spans(data, offsets)
        hashes = byte_hashes(data, start, end)
        yield Words(first, start, end, at, hashes, sequence_hashes(hashes), data)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), then those of start[1] and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(total)
