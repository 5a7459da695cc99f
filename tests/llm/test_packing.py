from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bitquarry.llm import packing

tokenizers = pytest.importorskip("tokenizers")


def best_fit(sizes, capacity):
    """One item after the other, largest first, into the tightest open bin: how many bins are how full."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= s]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(s)
        else:
            bins.append([s])
    return Counter(map(sum, bins))


def unrolled(plan, histogram):
    bins = defaultdict(list)
    seen = Counter()
    for k, (size, ordinal, first, each, offset) in enumerate(plan.tolist()):
        later = [r[1] for r in plan.tolist() if r[0] == size and r[1] > ordinal]
        for t in range(min(later, default=histogram[size]) - ordinal):
            bins[first + t // each].append((offset + t % each * size, size))
            seen[size] += 1
    assert seen == Counter(histogram)
    for content in bins.values():
        at = 0
        for offset, size in sorted(content):
            assert offset == at
            at += size
    return bins


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for capacity in (10, 31, 100):
        for _ in range(60):
            sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 80))]
            plan, n = packing.best_fit_plan(Counter(sizes), capacity)
            bins = unrolled(plan, Counter(sizes))
            got = Counter(sum(s for _, s in b) for b in bins.values())
            assert len(bins) == n and got == best_fit(sizes, capacity)


def test_segment_tree():
    rng = random.Random(1)
    tree, used = packing.RoomTree(50), set()
    for _ in range(2000):
        room, flag = rng.randrange(0, 51), rng.random() < 0.5
        tree.set(room, flag)
        (used.add if flag else used.discard)(room)
        size = rng.randrange(0, 51)
        assert tree.tightest(size) == min((u for u in used if u >= size), default=None)


def test_query_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = [(d, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([0, 1, 5, 60, 300, 700])))) for d in range(60)]
    rows += [(70, None), (71, ""), (72, "word " * 4000), (72, "word " * 4000), (None, "no id"), (73, "a\n\n b \n")]
    t = Tokenizer.from_file(packing.vocabulary())
    t.encode_special_tokens = True
    out = packing.best_fit_pack(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int")).collect()
    want = Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, packing.END]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4"))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) == sum(best_fit([r["length"] for r in out], 1024).values())


def test_empty_table(spark):
    assert packing.best_fit_pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
