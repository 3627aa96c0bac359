"""Periodic runs of words, found by matching blocks.

A run is a stretch of words with smallest period q (words q apart are identical) of at least max(MIN_WORDS, REPEATS * q) words that can't be
extended. At each power of two B, the text is cut into aligned blocks of B words. A run whose period lies within (2B - 1) / 3 and (4B - 2) / 3 is long enough to hold
one of these blocks together with its copy one period later, so an Aho-Corasick automaton over the blocks as integer sequences finds that copy; the pair seeds
an exact extension to both sides. The ranges of the powers of two cover every period once.

A block's key is the pair of its halves' numbers, which grow by doubling, so that keys stay short at every scale and a text takes O(n log^2 n) time and O(n) memory.
Left out of the automaton are only blocks that can't seed: those with a word that doesn't come again within the scale's largest distance, and those inside a known run
that repeats within one block (their copies lie whole periods of that run apart).

Null and empty texts have no words and no runs. Rows are judged one by one, so repeated rows repeat their result; a null doc_id is kept. A text is one
row of one task; texts of a million words take memory in proportion to their words.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import NO_ID, id_column, text_batches, with_nulls
from .words import word_list, word_numbers

REPEATS = 4
MIN_WORDS = 6
#: Matches of the automaton that are looked at together.
CHUNK = 1 << 16


def _alike(w: np.ndarray, i: int, d: int, step: int) -> int:
    """How many words from i on, in steps of 1 or -1, equal those d later."""
    n = len(w) - d - i if step > 0 else i + 1
    at, size = 0, 16
    while at < n:
        m = min(size, n - at)
        a = i + at if step > 0 else i - at - m + 1
        same = w[a : a + m] == w[a + d : a + d + m]
        if not same.all():
            return at + int(np.argmin(same if step > 0 else same[::-1]))
        at, size = at + m, size * 2
    return at


def _gaps(w: np.ndarray) -> np.ndarray:
    """How far the next occurrence of each word is; beyond the text where there's none."""
    order = np.argsort(w, kind="stable")
    out = np.full(len(w), 2 * len(w) + 8, np.int64)
    again = np.flatnonzero(w[order][1:] == w[order][:-1])
    out[order[again]] = order[again + 1] - order[again]
    return out


def _doubled(name: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the pieces of 2 * width words at each place, from those of the pieces of width words: equal exactly where the pieces are."""
    pair = name[:-width] * (int(name.max()) + 1) + name[width:]
    return np.unique(pair, return_inverse=True)[1].astype(np.int64)


def _seeds(name: np.ndarray, starts: np.ndarray, half: int, nearest: int, farthest: int):
    """(place, distance) of the blocks at ``starts`` and their copies nearest to farthest words later, by distance, then place.

    A block is the sequence of the numbers of its halves, the text that of the pieces half a block apart, for each phase after the other.
    """
    import ahocorasick

    block = 2 * half
    keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    starts = starts[starts + block <= len(name) + half - 1]
    key_at = np.full(len(name) // block + 2, -1, np.int64)
    for p, a, b in zip(starts.tolist(), name[starts].tolist(), name[starts + half].tolist()):
        key = keys.get((a, b), -1)
        if key < 0:
            keys.add_word((a, b), key := p)
        key_at[p // block] = key
    if not len(keys):
        return
    keys.make_automaton()
    other = int(name.max()) + 1
    places, distances = [], []
    #: Only where copies may lie is searched: stretches that reach the farthest distance beyond each block.
    breaks = np.flatnonzero(starts[1:] > starts[:-1] + block + farthest)
    for a, b in zip(starts[np.r_[0, breaks + 1]].tolist(), starts[np.r_[breaks, len(starts) - 1]].tolist()):
        piece = name[a : b + half + farthest + 1]
        rows = -(-len(piece) // half) + 1
        phases = np.full(rows * half, other, np.int64)
        phases[: len(piece)] = piece
        matches = keys.iter(tuple(phases.reshape(rows, half).T.ravel().tolist()))
        while part := list(islice(matches, CHUNK)):
            at, key = np.array(part, np.int64).T
            s = a + (at % rows - 1) * half + at // rows
            p = np.maximum(0, -(-(s - farthest) // block) * block)
            ok = (s - p >= nearest) & (s - p <= farthest)
            ok[ok] = key_at[p[ok] // block] == key[ok]
            places.append(p[ok])
            distances.append((s - p)[ok])
    if places:
        p, d = np.concatenate(places), np.concatenate(distances)
        order = np.lexsort((p, d))
        yield from zip(p[order].tolist(), d[order].tolist())


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words numbered ``w``, by start, then period."""
    n, found = len(w), {}
    if n < MIN_WORDS:
        return []
    most, name = _gaps(w), w
    end, period = np.zeros(n, np.int64), np.ones(n, np.int64)
    half, level, seen = 1, 0, {}
    while True:
        block = 2 * half
        nearest, farthest = (2 * block + 1) // 3, (4 * block - 2) // 3
        if REPEATS * nearest > n:
            break
        most = np.maximum(most[0 : len(most) // 2 * 2 : 2], most[1::2])
        starts = np.flatnonzero(most <= farthest) * block
        starts = starts[~((end[starts] >= np.minimum(starts + block + farthest, n)) & (period[starts] <= block))]
        if len(starts):
            while 1 << level < half:
                name, level = _doubled(name, 1 << level), level + 1
            for p, d in _seeds(name, starts, half, nearest, farthest):
                if p < seen.get(d, 0) or (d % period[p] == 0 and end[p] >= p + d + block):
                    continue
                right = p + block + _alike(w, p + block, d, 1)
                left = p - _alike(w, p - 1, d, -1) if p else 0
                seen[d] = right
                length = right + d - left
                if length >= max(MIN_WORDS, REPEATS * d) and d < found.get((left, length), d + 1):
                    found[left, length] = d
                    end[left : left + length], period[left : left + length] = left + length, d
        half = block
    return sorted((a, m, q) for (a, m), q in found.items())


def repeated(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a part repeated to the end, for every tenth id by its crc32; others and null ids: as they are."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def report(words: list[str]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)."""
    found = runs(word_numbers(words))
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    if found:
        kept = np.ones(len(words), bool)
        for start, length, q in found:
            kept[start + q : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *shown, sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(words)))


_COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, change=None) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row of ``docs`` (doc_id, text).

    ``change`` may alter a document's words by its id before they are judged.
    """
    text_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"].tolist(), pdf["text"]):
                words = word_list(t)
                rows.append(report(words if change is None else change(words, None if i == NO_ID else i)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _COLUMNS.split(", ")], dtype=object)
            for c in ("n_runs", "start", "length", "period", "exponent_milli"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return with_nulls(docs.select(id_column(), "text").mapInPandas(run, f"doc_id long, {_COLUMNS}"))
