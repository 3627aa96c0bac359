"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words of the corpus (at most LEXICON_WORDS of them, a bound on the lexicon's size) are compiled with their
token ids into a minimal acyclic transducer: states that accept the same suffixes are shared, and the numbers on a
word's path add up to its index into the table of ids. The driver compiles it once; each Python worker
memory-maps the image and looks up all words of a batch at once, each distinct one once. Words that it lacks are merged exactly
by the vocabulary's merge ranks, side by side, so the lexicon changes speed, never ids.

Texts are normalised and cut into words by Python's Unicode tables. Where these differ from the tokenizers library's, which is of another
Unicode version (``odd_characters``), a piece of text that holds such a character is normalised and cut by the library.

Null texts count as empty. Empty texts have no ids. Rows are encoded one by one, whole, with no truncation.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
import unicodedata
import uuid

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_column, stored, text_batches, with_nulls

LEXICON_WORDS = 65_536
#: Bytes of text that are encoded at once.
AT_ONCE = 4 << 20
#: Bytes of words that are merged side by side, by classes of length; longer ones are merged alone.
TOGETHER = (8, 16, 32, 64)
_NEVER = 1 << 60
#: Above any token id.
_PAIR = 1 << 31
#: White space of the tokenizers library's \s (Unicode White_Space).
_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPLIT = re.compile(f"[{_SPACE}]+")
#: White space beyond ASCII, as the pattern of Arrow's replacement.
_WIDE_SPACE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _SPACE if c > "\x7f") + "]"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _library(spec: dict):
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(json.dumps(spec))
    found.no_truncation()
    found.no_padding()
    return found


def odd_characters(spec: dict) -> str:
    """The characters that the tokenizers library may normalise or classify otherwise than Python does, as ranges of a character class.

    These are all that Python's tables don't assign, and of those that they do, what differs when the library is asked for each
    (the ends of the two large private planes stand for them).
    """
    library, own = _library(spec), WordBpe(spec)
    assigned = [c for c in range(0x80, 0xF0000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    assigned += [0xF0000, 0xFFFFD, 0x100000, 0x10FFFD]
    unlike = lambda s: library.normalizer.normalize_str(s) != own.normalised(s)
    odd = np.ones(0x110000, bool)
    odd[[*range(0x80), *assigned]] = odd[0xD800:0xE000] = odd[0xF0000:0xFFFFE] = odd[0x100000:0x10FFFE] = False
    for at in range(0, len(assigned), 1 << 14):
        some = assigned[at : at + (1 << 14)]
        text = "".join(f" a{chr(c)}!" for c in some)
        start, end = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        for _, (i, j) in library.pre_tokenizer.pre_tokenize_str(text):
            start[i:j], end[i:j] = i, j
        places = np.arange(len(some)) * 4 + 2
        theirs = np.where(end[places] == 0, 0, np.where(start[places] < places, 1, np.where(end[places] == places + 1, 2, 3)))
        for c, kind in zip(some, theirs.tolist()):
            x = chr(c)
            mine = 0 if x in _SPACE else 1 if own.letter(x) else 2 if own.number(x) else 3
            odd[c] = mine != kind or (mine > 0 and unlike(x)) or (mine == 1) != x.isalpha()
            if unicodedata.combining(x):
                odd[c] |= unlike(f"e{x}\u0334") or unlike(f"e{x}\u0301")  # marks are sorted by their classes
            elif unlike(parts := unicodedata.normalize("NFD", x)):
                odd[[ord(p) for p in parts if p > "\x7f"]] = True
    edges = np.flatnonzero(np.diff(np.r_[False, odd, False]))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))


class WordBpe:
    """The vocabulary file: word pattern, merge ranks, special tokens. ``odd`` is what ``odd_characters`` gave."""

    letter, number = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match

    def __init__(self, spec: dict, odd: str = ""):
        self.spec, self.library = spec, None
        self._odd, self._plain = re.compile(f"[{odd}]").search if odd else lambda _: None, set()
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        #: Rank of each pair of ids, and the id that each rank makes.
        self.merges, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.suffix] for s in symbols]
        #: The same ranks as arrays: pairs in order with their ranks, and those of two bytes, the second within or at the end of a word.
        keys, ranks = (np.fromiter(x, np.int64, len(self.merges)) for x in ((a * _PAIR + b for a, b in self.merges), self.merges.values()))
        order = np.argsort(keys)
        self._keys, self._ranks, self._made = keys[order], ranks[order], np.array(self.made, np.int64)
        self._first = np.array([self.inner, self.last], np.int64)
        self._begin = [self._rank(self._first[0][:, None], x[None]) for x in self._first]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", f"[^{_SPACE}"))
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def odd(self, piece: str) -> bool:
        """Whether a piece holds an odd character; characters that were found plain are remembered."""
        if self._plain.issuperset(piece):
            return False
        new = set(piece) - self._plain
        if self._odd("".join(new)):
            return True
        self._plain |= new
        return False

    def words(self, piece: str) -> list[str]:
        """Normalised words of a piece; lower-casing is by character, as the library does it."""
        if not piece.isascii() and self.odd(piece):
            self.library = self.library or _library(self.spec)
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
            return [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8", "replace") for w, _ in cut]
        s = self.normalised(piece)
        return [s] if s.isalpha() else self.pattern.findall(s)

    @staticmethod
    def normalised(piece: str) -> str:
        s = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
        return s.lower() if "Σ" not in s else "".join(map(str.lower, s))

    def merge(self, word: str) -> list[int]:
        """Token ids of one word by merging the adjacent pair of least rank until none is left."""
        return self._merge_bytes(word.encode("utf-8", "replace"))

    def _merge_bytes(self, raw: bytes) -> list[int]:
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if len(ids) > 512:
            return self._merge_long(ids)
        find, made = self.merges.get, self.made
        ranks = [find(pair, _NEVER) for pair in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < _NEVER:
            i = ranks.index(rank)
            ids[i] = new = made[rank]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = find((new, ids[i + 1]), _NEVER)
            if i:
                ranks[i - 1] = find((ids[i - 1], new), _NEVER)
        return ids

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids; what is no pair (or below 0) has none."""
        want = a * _PAIR + b
        if not len(self._keys):
            return np.full(want.shape, _NEVER)
        at = np.minimum(np.searchsorted(self._keys, want), len(self._keys) - 1)
        return np.where((self._keys[at] == want) & (a >= 0) & (b >= 0), self._ranks[at], _NEVER)

    def merge_all(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of each word (at least one byte) in a text: all ids in a row, and how many each word has."""
        found, counts, order = [], np.zeros(len(starts), np.int64), []
        for least, most in zip((0, *TOGETHER), TOGETHER):
            some = np.flatnonzero((sizes > least) & (sizes <= most))
            for at in range(0, len(some), 1 << 14):
                part = some[at : at + (1 << 14)]
                ids = self._merge_some(text, starts[part], sizes[part], most)
                counts[part] = (ids >= 0).sum(axis=1)
                found.append(ids[ids >= 0])
                order.append(part)
        for i in np.flatnonzero(sizes > TOGETHER[-1]).tolist():
            ids = self._merge_bytes(text[starts[i] : starts[i] + sizes[i]].tobytes())
            counts[i] = len(ids)
            found.append(np.array(ids, np.int64))
            order.append(np.array([i]))
        if not order:
            return np.empty(0, np.int64), counts
        order = np.concatenate(order)
        begins = np.empty(len(counts), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return gathered(np.concatenate(found), begins, counts)[0], counts

    def _merge_some(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
        """Token ids (-1 behind the last) of words of at most ``width`` bytes: in each step every word merges its leftmost pair of least rank."""
        column, row = np.arange(width), np.arange(len(starts))
        text = text[np.minimum(starts[:, None] + column, len(text) - 1)]
        ids = np.where(column < sizes[:, None], self._first[0][text], -1)
        ids[row, sizes - 1] = self._first[1][text[row, sizes - 1]]
        out = ids.copy()
        ids = np.column_stack([ids, np.full(len(row), -1)])
        ranks = np.full((len(row), width + 1), _NEVER)
        ranks[:, : width - 1] = np.where(column[1:] < sizes[:, None] - 1, self._begin[0][text[:, :-1], text[:, 1:]], _NEVER)
        two = np.flatnonzero(sizes > 1)
        ranks[two, sizes[two] - 2] = self._begin[1][text[two, sizes[two] - 2], text[two, sizes[two] - 1]]
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            live = best < _NEVER
            if not live.all():
                out[row[~live]] = ids[~live, :-1]
                row, ids, ranks, at, best = (x[live] for x in (row, ids, ranks, at, best))
            if not len(row):
                return out
            n, new = np.arange(len(row)), self._made[best]
            ids[n, at] = new
            # the second id of the pair goes, and so does the pair's rank; the last column is padding and stays so
            ids[:, :-1] = np.take_along_axis(ids, column[None] + (column[None] > at[:, None]), 1)
            ranks[:, :-1] = np.take_along_axis(ranks, column[None] + (column[None] >= at[:, None]), 1)
            ranks[n, at] = self._rank(new, ids[n, at + 1])
            inside = np.flatnonzero(at > 0)
            ranks[inside, at[inside] - 1] = self._rank(ids[inside, at[inside] - 1], new[inside])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges through a heap, for words of any length in n log n steps."""
        import heapq

        n, find = len(ids), self.merges.get
        nxt, prv, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := find((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = self.made[rank], False, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] >= 0 and (rank := find((ids[x], ids[nxt[x]]))) is not None:
                    heapq.heappush(heap, (rank, x, ids[x], ids[nxt[x]]))
        return [t for t, ok in zip(ids, alive) if ok]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The image of the minimal acyclic transducer from words to id sequences.

    Words come in sorted order; once a state can't change any more it's replaced by an equal one seen before. An arc's
    number is the count of words that sort before those through it, so a path's sum is the word's index.
    """
    register: dict = {}
    arcs: list[dict] = [{}]
    final: list[bool] = [False]
    free: list[int] = []
    path: list[tuple[int, int, int]] = []
    before = b""

    def close(down_to: int) -> None:
        while len(path) > down_to:
            parent, label, child = path.pop()
            key = (final[child], tuple(arcs[child].items()))
            if (same := register.get(key)) is not None:
                arcs[parent][label] = same
                arcs[child] = {}
                free.append(child)
            else:
                register[key] = child

    words = sorted(entries)
    for word in words:
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        close(common)
        state = path[-1][2] if path else 0
        for label in word[common:]:
            if free:
                child = free.pop()
                final[child] = False
            else:
                child = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[state][label] = child
            path.append((state, label, child))
            state = child
        final[state] = True
        before = word
    close(0)

    counts: dict[int, int] = {}

    def count(root: int) -> int:
        stack = [root]
        while stack:
            s = stack[-1]
            todo = [t for t in arcs[s].values() if t not in counts]
            if todo:
                stack.extend(todo)
            else:
                counts[s] = final[s] + sum(counts[t] for t in arcs[s].values())
                stack.pop()
        return counts[root]

    count(0)
    keys, targets, outs = [], [], []
    for s in counts:
        passed = int(final[s])
        for label in sorted(arcs[s]):
            t = arcs[s][label]
            keys.append(s << 8 | label)
            targets.append(t << 1 | final[t])
            outs.append(passed)
            passed += counts[t]
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    columns = [np.array(x, np.int64)[order] for x in (keys, targets, outs)]
    lengths = np.array([len(entries[w]) for w in words], np.int64)
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    ids = np.fromiter((i for w in words for i in entries[w]), np.int64, int(lengths.sum()))
    head = np.array([len(keys), len(words), len(ids), int(final[0])], np.int64)
    return b"".join(x.tobytes() for x in (head, *columns, offsets, ids))


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, image: bytes):
        fd, name = tempfile.mkstemp(prefix="lexicon-")
        os.write(fd, image)
        self._map = mmap.mmap(fd, len(image), access=mmap.ACCESS_READ)
        os.close(fd)
        os.unlink(name)  # the mapping lives on; nothing stays behind
        arcs, words, ids, _ = np.frombuffer(self._map, np.int64, 4)
        at, parts = 4, []
        for n in (arcs, arcs, arcs, words + 1, ids):
            parts.append(np.frombuffer(self._map, np.int64, int(n), at * 8))
            at += int(n)
        self.keys, self.targets, self.outs, self.offsets, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's index, or -1: all words walk through the automaton together, byte by byte."""
        if not words or not len(self.keys):
            return np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return self.find_in(np.frombuffer(b"".join(words), np.uint8), np.r_[0, np.cumsum(sizes)[:-1]], sizes)

    def find_in(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same of words within a text."""
        if not len(sizes) or not len(self.keys):
            return np.full(len(sizes), -1, np.int64)
        state, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        accepts, live = np.zeros(len(sizes), bool), np.flatnonzero(sizes > 0)
        for i in range(int(sizes.max())):
            live = live[sizes[live] > i]
            if not len(live):
                break
            want = state[live] << 8 | text[starts[live] + i].astype(np.int64)
            at = np.searchsorted(self.keys, want)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == want
            accepts[live[~hit]] = False
            live, at = live[hit], at[hit]
            state[live] = self.targets[at] >> 1
            accepts[live] = (self.targets[at] & 1) > 0
            total[live] += self.outs[at]
        return np.where(accepts, total, -1)

    def of(self, index: int) -> list[int]:
        return self.ids[self.offsets[index] : self.offsets[index + 1]].tolist()


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` one behind the other, and where each begins (and the last ends)."""
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    return values[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _texts(column):
    """An Arrow array of strings as (bytes, where each begins, and the last ends)."""
    _, places, text = column.buffers()
    ends = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if places else np.zeros(1, np.int64)
    return np.frombuffer(text or b"", np.uint8), ends


class Encoder:
    """Encodes whole columns of texts: Arrow cuts them at white space, and each distinct piece and word of a batch is encoded once."""

    def __init__(self, bpe: WordBpe, lexicon: Lexicon):
        import pyarrow as pa

        self.bpe, self.lexicon = bpe, lexicon
        ids = range(max(bpe.names, default=-1) + 1)
        self.numbers, self.names = pa.array(map(str, ids), pa.string()), pa.array([bpe.names.get(i, "") for i in ids], pa.string())

    def word_ids(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin in them, how many it has) of distinct words."""
        text, ends = _texts(words)
        starts, sizes = ends[:-1], np.diff(ends)
        found = self.lexicon.find_in(text, starts, sizes)
        rest = np.flatnonzero((found < 0) & (sizes > 0))
        merged, counts = self.bpe.merge_all(text, starts[rest], sizes[rest])
        at, n = self.lexicon.offsets[found], np.where(found < 0, 0, self.lexicon.offsets[found + 1] - self.lexicon.offsets[found])
        at[rest], n[rest] = len(self.lexicon.ids) + np.cumsum(counts) - counts, counts
        return np.concatenate([self.lexicon.ids, merged]), at, n

    def pieces(self, text: str) -> list[str]:
        """What stands between white space and special tokens, and those themselves."""
        return [p for x in self.bpe.special_split.split(text) for p in ([x] if x in self.bpe.special else _SPLIT.split(x))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts; special tokens in a text are taken as such, as the library does by default."""
        import pyarrow as pa

        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]

    def encode_column(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin, and the last ends) of an Arrow array of strings without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        marked = pc.match_substring(texts, "<|") if self.bpe.special else pa.array(np.zeros(len(texts), bool))
        plain = pc.if_else(marked, "", texts)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, _WIDE_SPACE, " "))
        ids, ends = self._encode_pieces(lists.flatten(), lists.offsets.to_numpy().astype(np.int64))
        special = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        if not len(special):
            return ids, ends
        cut = [self.pieces(t) for t in texts.take(pa.array(special)).to_pylist()]
        more, places = self._encode_pieces(pa.array([p for x in cut for p in x], pa.string()), np.r_[0, np.cumsum([len(x) for x in cut])].astype(np.int64))
        starts, sizes = ends[:-1].copy(), np.diff(ends)
        starts[special], sizes[special] = len(ids) + places[:-1], np.diff(places)
        return gathered(np.concatenate([ids, more]), starts, sizes)

    def _encode_pieces(self, pieces, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode_column`` of texts whose pieces are given, and where each text's begin."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(pieces):
            return np.empty(0, np.int64), np.zeros(len(ends), np.int64)
        coded = pieces.dictionary_encode()
        distinct, special = coded.dictionary, self.bpe.special
        letters = pc.ascii_is_alpha(distinct)
        cut = [[p] if p in special else self.bpe.words(p) for p in distinct.filter(pc.invert(letters)).to_pylist()]
        words = pa.concat_arrays([pc.ascii_lower(distinct.filter(letters)), pa.array([w for s in cut for w in s], pa.string())]).dictionary_encode()
        values, at, n = self.word_ids(words.dictionary)
        for x, i in special.items():  # no other word looks like a special token
            if (place := pc.index(words.dictionary, x).as_py()) >= 0:
                at[place], n[place] = len(values), 1
                values = np.append(values, i)
        word = words.indices.to_numpy()
        ids, places = gathered(values, at[word], n[word])
        is_word = letters.to_numpy(zero_copy_only=False)
        whole = int(is_word.sum())
        first, count = np.empty(len(distinct), np.int64), np.ones(len(distinct), np.int64)
        first[is_word] = np.arange(whole)
        count[~is_word] = sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        first[~is_word] = whole + np.cumsum(sizes) - sizes
        begin, end = places[first], places[first + count]
        piece = coded.indices.to_numpy()
        ids, places = gathered(ids, begin[piece], (end - begin)[piece])
        return ids, places[ends]

    def digests(self, ids: np.ndarray, ends: np.ndarray, shown) -> list[str]:
        """SHA-256 of each text's ids, shown and joined by spaces."""
        import pyarrow as pa
        import pyarrow.compute as pc

        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), shown.take(pa.array(ids))), " ")
        text, places = _texts(joined)
        return [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(places[:-1].tolist(), places[1:].tolist())]


def slices(texts, most: int):
    """(first row, rows) of stretches of an Arrow array of strings that hold at most about ``most`` bytes, at least a row each."""
    _, ends = _texts(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to - at
        at = to


_encoders: dict = {}


def _encoder(key: str, make) -> Encoder:
    """One encoder for each Python worker and job: its tables serve the worker's next tasks."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = make()
    return _encoders[key]


def frequent_words(docs: DataFrame, limit: int) -> list[str]:
    """The ``limit`` most frequent words of all texts, ties by the word.

    The counts of counts give the least count that can matter, so that only about ``limit`` words ever leave the executors.
    """
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    counts = stored(docs.select(word).where("word <> ''").groupBy("word").count().where("count > 1"), "bpe-words")
    least, seen = 2, 0
    for r in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).toLocalIterator():
        least, seen = r["count"], seen + r["n"]
        if seen >= limit:
            break
    over = [r["word"] for r in counts.where(F.col("count") > least).orderBy(F.desc("count"), "word").collect()]
    rest = counts.where(F.col("count") == least).select("word").orderBy("word").limit(max(0, limit - len(over)))
    out = over + [r["word"] for r in rest.collect()]
    discard(counts)
    return out


def encode_decode(docs: DataFrame, vocabulary: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    odd = odd_characters(spec)
    bpe = WordBpe(spec, odd)
    image = compile_lexicon({w.encode(): bpe.merge(w) for word in frequent_words(docs, lexicon_words) for w in bpe.words(word)})
    #: The vocabulary file and at most lexicon_words words, whatever the corpus holds.
    shared, key = spark.sparkContext.broadcast((spec, odd, image)), uuid.uuid4().hex

    def run(batches):
        def make():
            spec, odd, image = shared.value
            return Encoder(WordBpe(spec, odd), Lexicon(image))

        encoder = _encoder(key, make)
        for batch in batches:
            import pyarrow as pa
            import pyarrow.compute as pc

            texts = pc.fill_null(batch.column("text"), "")
            for at, n in slices(texts, AT_ONCE):
                ids, ends = encoder.encode_column(texts.slice(at, n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), pa.array(np.diff(ends)), *(pa.array(encoder.digests(ids, ends, x), pa.string()) for x in (encoder.numbers, encoder.names))],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return with_nulls(docs.select(id_column(), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
