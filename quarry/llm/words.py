"""Hashed words of many whole texts at once.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as of
``bytes.lower`` and ``bytes.split``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import xxhash

_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
#: Longer words are hashed one by one, by XXH64.
_LONG = 256


@dataclass
class Words:
    """raw: the lower-cased bytes; for each word its start and end in raw, its 64-bit hash, and the number of its text; where each text ends in raw."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    text_ends: np.ndarray

    def text(self, i: int) -> str:
        return self.raw[self.starts[i] : self.ends[i]].decode("utf-8", "surrogatepass")


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= _ODD
    x ^= x >> np.uint64(29)
    x *= _ODD2
    return x ^ x >> np.uint64(32)


def words(texts: Iterable[str | None]) -> Words:
    """The words of all texts, in order. The hash mixes in eight bytes at a time."""
    own = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = b"\n".join(own) + b"\n"
    eights = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))
    ends_of = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    b = np.frombuffer(raw, np.uint8)
    solid = np.zeros(len(b) + 1, bool)
    solid[1:] = (b - np.uint8(9) > 4) & (b != 32)  # below 9 it wraps around
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(raw, none, none, np.zeros(0, np.uint64), none, ends_of)
    lens = ends - starts
    h = lens.astype(np.uint64) * _ODD2
    h = _mixed(h ^ (eights[starts] & _MASK[np.minimum(lens, 8)]))
    at = 8
    todo = np.flatnonzero((lens > at) & (lens <= _LONG))
    while len(todo):
        h[todo] = _mixed(h[todo] ^ (eights[starts[todo] + at] & _MASK[np.minimum(lens[todo] - at, 8)]))
        at += 8
        todo = todo[lens[todo] > at]
    for i in np.flatnonzero(lens > _LONG):
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    owner = np.repeat(np.arange(len(own)), np.diff(np.searchsorted(starts, ends_of), prepend=0))
    return Words(raw, starts, ends, h, owner, ends_of)


def chunks(ids: list, texts: list, most: int = 1 << 21):
    """Runs of rows of at most about most characters, at least one row each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield ids[at:i], texts[at:i]
            at, size = i, 0
        size += n
    if at < len(texts):
        yield ids[at:], texts[at:]
