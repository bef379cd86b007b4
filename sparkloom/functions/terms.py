"""The terms of ``text.index_terms``, made of Arrow texts with array operations."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from .text import _plain_letters

_WIDE, _DROP, _GAP = 1 << 16, 0xFFFFFFFF, 10


def _term_letter(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co"


@cache
def _plain() -> dict[int, int | None]:
    """What letters with marks become, and marks, which go."""
    letters, bases = _plain_letters()
    return dict(zip(map(ord, letters), map(ord, bases), strict=True)) | dict.fromkeys(range(0x300, 0x370))


def _folded(text: str) -> str:
    return text.lower() if text.isascii() else text.lower().translate(_plain())


@cache
def _table() -> np.ndarray:
    """What each code point below 2**16 becomes: itself folded, a gap, nothing, or 0 where its neighbours or more than one code point decide."""
    out = np.zeros(_WIDE, np.uint32)
    for i in range(_WIDE):
        c = chr(i)
        if 0xD800 <= i < 0xE000 or c == "Σ":
            continue
        low = _folded(c)
        out[i] = _DROP if not low else (i if low == c else ord(low)) if len(low) == 1 and _term_letter(low) else _GAP if len(low) == 1 else 0
    return out


def _plain_terms(text: str) -> str:
    return "".join(c if _term_letter(c) else "\n" for c in _folded(text))


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in order, and the number of each text's; a null has none."""
    names = [(t or "").replace("\0", "\n") for t in texts.to_pylist()]
    points = np.frombuffer("\0".join(names).encode("utf-32-le", "replace"), np.uint32)
    made = np.where(points < _WIDE, _table()[np.minimum(points, _WIDE - 1)], 0)
    if (made == 0).any():  # final sigmas, letters that become two, and those beyond the basic plane
        text = np.cumsum(points == 0)
        for i in np.unique(text[made == 0]):
            names[i] = _plain_terms(names[i])
        points = np.frombuffer("\0".join(names).encode("utf-32-le", "replace"), np.uint32)
        made = np.where(points < _WIDE, _table()[np.minimum(points, _WIDE - 1)], points)
        made = np.where((made == 0) & (points > 0), points, made)
    made = np.where(points == 0, np.uint32(0), made)[made != _DROP]
    data = np.frombuffer(made.tobytes().decode("utf-32-le").encode(), np.uint8)
    gap = np.concatenate([[True], (data == _GAP) | (data == 0), [True]])
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap[1:-1]])])
    ends = np.append(np.flatnonzero(data == 0), len(data))[: len(names)]
    return found, np.diff(np.searchsorted(start, ends), prepend=0)
