"""Shingle sets of whole columns of texts, hashed by numpy inside Arrow tasks.

Words are what blanks (space, tab to carriage return) separate.  Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LONG_WORD = 64             # bytes
SLICE_BYTES = 1 << 20      # of texts whose words are hashed at once


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hashes of the words at these bytes, eight bytes of all words at a time."""
    lanes = np.ndarray(len(data) + 1, "<u8", np.r_[data, np.zeros(8, np.uint8)], strides=(1,))
    h = _mix(size.astype(np.uint64))
    own, word, left = slice(None), at, size
    for i in range(0, LONG_WORD, 8):
        h[own] = _mix(h[own] + _mix(lanes[word + i] & _LOW_BYTES[np.minimum(left, 8)]))
        own = np.flatnonzero(size > i + 8)
        if not len(own):
            break
        word, left = at[own], size[own] - i - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[at[i]:at[i] + size[i]].tobytes())
    return h


def _words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in a row, and where each text's begin."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)          # A-Z only
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    ends = ends[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]
    ends -= ends[0]
    blank = _BLANK[data]
    first, last = ~blank, ~blank
    # a word begins after a blank or where a text does, and ends likewise
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    some = np.diff(ends) > 0
    first[ends[:-1][some]] = ~blank[ends[:-1][some]]
    last[ends[1:][some] - 1] = ~blank[ends[1:][some] - 1]
    at = np.flatnonzero(first)
    return _hashes(data, at, np.flatnonzero(last) + 1 - at), np.searchsorted(at, ends)


def _slices(texts: pa.Array, slice_bytes: int):
    """The texts in runs of about ``slice_bytes``."""
    if len(texts):
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        part = np.cumsum(size) // slice_bytes
        at = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(texts)].tolist()
        for s, e in zip(at[:-1], at[1:]):
            yield texts.slice(s, e - s)


def hashed_sets(texts, k: int, lower: bool = False, slice_bytes: int = SLICE_BYTES) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of every text (an Arrow column or
    a list).  A text of fewer than k words is one shingle; one without words has none."""
    out = []
    salts = _mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    for part in _slices(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), slice_bytes):
        h, starts = _words(part, lower)
        x = h[:max(len(h) - k + 1, 0)] * salts[0]
        for i in range(1, k):
            x = _mix(x) + h[i:i + len(x)] * salts[i]
        x = _mix(x)
        # shingles that begin in a text's last k - 1 words would run into the next
        first, n = starts[:-1], np.diff(starts)
        ends = first + np.maximum(n - k + 1, 0)
        for s, e in zip(first.tolist(), ends.tolist()):
            x[s:e].sort()
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        whole = ends > first
        new[first[whole]] = True
        edge = np.zeros(len(x) + 1, np.int64)
        np.add.at(edge, first[whole], 1)
        np.add.at(edge, ends[whole], -1)
        new &= np.cumsum(edge[:-1]) > 0
        x, at = x[new], np.r_[0, np.cumsum(new)]
        for s, e, m in zip(first.tolist(), ends.tolist(), n.tolist()):
            if e > s:
                out.append(x[at[s]:at[e]])
            elif m:
                y = np.full(1, m, np.uint64)
                for i in range(m):
                    y = _mix(y) + h[s + i:s + i + 1] * salts[i]
                out.append(_mix(y))
            else:
                out.append(h[:0])
    return out
