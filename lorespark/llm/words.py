"""Words and word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
from xxhash import xxh3_64_intdigest

#: Bytes of a text that are hashed together; a longer text is cut at white space.
PIECE = 1 << 20
#: Bytes of a word up to which it's hashed beside others.
LONG = 512
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, which spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_POWER = np.multiply.accumulate(np.r_[np.uint64(1), np.full(LONG, _MUL)])


def _hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words of some bytes in order: a polynomial of each word's bytes, mixed."""
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _GAP[raw]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    letters, firsts = _LOWER[raw[~gap[1:-1]]], np.cumsum(sizes) - sizes
    places = np.arange(len(letters)) - np.repeat(firsts, sizes)
    h = np.add.reduceat(_BYTE[letters] * _POWER[np.minimum(places, LONG)], firsts)
    for i in np.flatnonzero(sizes > LONG):
        h[i] = xxh3_64_intdigest(letters[firsts[i] : firsts[i] + sizes[i]].tobytes())
    return mix(h + sizes.astype(np.uint64) * _MUL)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words in order: runs of anything but ``[\\x20\\x09-\\x0D]``, with A-Z in lower case; null: none."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    parts, at = [], 0
    while len(raw) - at > PIECE:
        end = at + PIECE
        while end < len(raw) and not len(gaps := np.flatnonzero(_GAP[raw[end : end + PIECE]])):
            end += PIECE
        end = end + int(gaps[0]) if end < len(raw) else len(raw)
        parts.append(_hashes(raw[at:end]))
        at = end
    return np.concatenate([*parts, _hashes(raw[at:])]) if parts else _hashes(raw)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; fewer words: the whole sequence as one."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(k, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        acc = (acc + h[i : len(h) - k + 1 + i]) * _MUL
        acc ^= acc >> np.uint64(29)
    acc = np.sort(mix(acc))
    return acc[np.r_[True, acc[1:] != acc[:-1]]]


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_list(text: str | None) -> list[str]:
    """A text's words as they stand: runs of anything but ``[\\x20\\x09-\\x0D]``; null: none."""
    return _WORD.findall(text or "")


class _Numbers(dict):
    def __missing__(self, word):
        v = self[word] = len(self)
        return v


def word_numbers(words: list[str]) -> np.ndarray:
    """A number for each word, 0, 1, ... by first appearance, so that numbers are equal exactly where words are."""
    return np.fromiter(map(_Numbers().__getitem__, words), np.int64, len(words))
