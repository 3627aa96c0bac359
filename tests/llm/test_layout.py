"""Sharding and packing."""

import heapq
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from lorespark.llm import packing as P
from lorespark.llm import sharding as S


def test_schedule_is_the_heap_rule():
    """Exact sizes, most above eight thousand bytes and many of them a byte apart."""
    rng = random.Random(4)
    sizes = sorted({*rng.sample(range(16, 90_000), 60), *range(50_000, 50_040)}, reverse=True)
    counts = [rng.choice([1, 2, 3, 700]) for _ in sizes]
    heap, loads = [(0, s) for s in range(7)], [0] * 7
    for size, count in zip(sizes, counts):
        for _ in range(count):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            loads[s] += size
    ends, owners = S.schedule(sizes, counts, 7)
    assert ends[-1] == sum(counts) and (np.diff(ends) > 0).all()
    each, mine = np.repeat(sizes, counts), [0] * 7
    for a, b, s in zip([0, *ends], ends, owners):
        mine[s] += int(each[a:b].sum())
    assert sorted(mine) == sorted(loads)
    assert [len(x) for x in S.schedule([], [], 7)] == [0, 0]


def test_shards(spark):
    rng = random.Random(1)
    texts = [("é" * rng.randint(0, 3000)) for _ in range(300)]
    texts += ["hot"] * 150 + [None] * 5 + [""] * 4 + ["x" * 100_000]
    rows = [(i, t, -1) for i, t in enumerate(texts)] + [(3, texts[3], -1)]
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 8).collect()
    assert len(got) == len(rows)
    of, loads = {}, [0] * 8
    for r in got:
        t = rows[r["doc_id"]][1]
        assert r["size"] == len((t or "").encode()) + 16 and r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
        assert r["law"] == "bytes" and r["grown_shard"] is None
        assert of.setdefault(t or ("" if t == "" else None), r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r["shard"], r["slot"])), key=lambda r: r["shard"]):
        group = list(group)
        assert [r["slot"] for r in group] == list(range(len(group)))
    assert max(loads) - min(loads) < 200
    groups = Counter((t or ("" if t == "" else None)) for _, t, _ in rows)
    heap = [(0, s) for s in range(8)]
    for size in sorted((n * (len((t or "").encode()) + 16) for t, n in groups.items()), reverse=True):
        heapq.heapreplace(heap, (heap[0][0] + size, heap[0][1]))
    assert sorted(loads) == sorted(x for x, _ in heap)  # plain scheduling of the exact sizes
    none = S.shard(spark.createDataFrame([], "doc_id long, text string"), 4)
    assert none.count() == 0


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 20) for _ in lengths]
        k = rng.randint(1, 4)
        got = P.boundaries(np.array(lengths, float), np.array(counts, float), k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], n))
        assert got[-1] == lengths[-1] and len(got) <= k and padding(lengths, counts, got) == best
    assert P.boundaries(np.array([]), np.array([]), 3) == []


def test_boundaries_of_many_lengths(monkeypatch):
    """The quadratic recurrence on lengths far above a thousand, with equally good choices, in slices too."""
    rng = np.random.default_rng(5)
    for at_once in (1 << 22, 50):
        monkeypatch.setattr(P, "_AT_ONCE", at_once)
        for n in (1, 2, 7, 300):
            lengths = np.unique((rng.lognormal(7, 1.5, n)).astype(np.int64) + 1)
            counts = rng.integers(1, 4, len(lengths))
            rows, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
            least, froms = [int(x * rows[j + 1] - tokens[j + 1]) for j, x in enumerate(lengths)], []
            for _ in range(1, min(6, len(lengths))):
                sums = [[(0 if i == 0 else least[i - 1]) + int(x * (rows[j + 1] - rows[i]) - (tokens[j + 1] - tokens[i])) for i in range(j + 1)] for j, x in enumerate(lengths)]
                froms.append([s.index(min(s)) for s in sums])
                least = [min(s) for s in sums]
            want, j = [], len(lengths) - 1
            for source in [*reversed(froms), [0] * len(lengths)]:
                if j >= 0:
                    want.append(int(lengths[j]))
                    j = source[j] - 1
            got = P.boundaries(lengths, counts, 6)
            assert got == want[::-1] and padding(lengths, counts, got) == least[-1]


def test_pack(spark):
    from tokenizers import Tokenizer

    rng, vocabulary = random.Random(3), public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(["w"] * rng.randint(0, 90)) for _ in range(400)] + [None, "", " \n\t", "a\x0bb\rc", "w " * 5000, "w " * 3001]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(0, texts[0], 9)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, batch int"), vocabulary, 5, 500).collect()
    assert len(got) == len(rows)
    library = Tokenizer.from_file(vocabulary)
    ends = {}
    for r in got:
        t = rows[r["doc_id"]][1] or ""
        assert r["length"] == len(library.encode(t, add_special_tokens=False).ids) + 1 and r["padding"] == r["boundary"] - r["length"] >= 0
        assert ends.setdefault(r["bucket"], r["boundary"]) == r["boundary"]
    assert len(ends) <= 5 and [ends[b] for b in sorted(ends)] == sorted(ends.values())
    batches = {}
    for r in got:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["place"])
    for (bucket, batch), places in batches.items():
        per = max(1, 500 // ends[bucket])
        assert sorted(places) == list(range(len(places))) and len(places) <= per
        last = batch == max(b for x, b in batches if x == bucket)
        assert last or len(places) == per
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary).count() == 0
