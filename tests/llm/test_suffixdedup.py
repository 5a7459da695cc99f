from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from bitquarry.llm import suffixdedup as sd
from bitquarry.llm._suffix import permuted_lcp, suffix_array

from . import brute


def digests(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sd.removed_spans(docs).mapInArrow(sd._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return sorted((tuple(r) for r in out.collect()), key=str)


def wanted(rows):
    gone = brute.repeated_bytes([t for _, t in rows], sd.LENGTH)
    return sorted(((d, *brute.repeated_digest(t, g)) for (d, t), g in zip(rows, gone, strict=True)), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    passages = [" ".join(f"{rng.choice('abcdeé')}{rng.randrange(30)}" for _ in range(rng.randrange(30, 160))) for _ in range(6)]
    rows = []
    for d in range(n):
        parts = [rng.choice([rng.choice(passages), " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))), "ha " * rng.randrange(0, 120)]) for _ in range(rng.randrange(0, 4))]
        text = list(" ".join(parts))
        for _ in range(rng.randrange(0, 3)):
            if text:
                text[rng.randrange(len(text))] = "#"
        rows.append((d, "".join(text)))
    return rows


def test_suffix_array_and_common_prefixes_match_sorting():
    rng = np.random.default_rng(1)
    for trial in range(120):
        data = rng.integers(0, rng.integers(1, 5), rng.integers(1, 90)).astype(np.uint8)
        if trial % 3 == 0:
            data = np.tile(data[: max(1, len(data) // 4)], 6)
        text = np.concatenate([data.astype(np.uint16) + 1, [0]]).astype(np.uint16)
        sa = suffix_array(text, 8)
        raw = text.tolist()
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        common, before = permuted_lcp(data, sa)
        for r in range(2, len(sa)):
            i, j = sa[r], sa[r - 1]
            k = 0
            while max(i, j) + k < len(data) and data[i + k] == data[j + k]:
                k += 1
            assert common[i] == k and before[i] == j


def test_matches_brute_force(spark):
    rows = corpus(3)
    assert digests(spark, rows) == wanted(rows)


def test_large_groups_string_by_string(spark, monkeypatch):
    rows = corpus(4, 40)
    monkeypatch.setattr(sd, "GROUP", 600)
    assert digests(spark, rows) == wanted(rows)


def test_pieces_of_a_long_text_cover_every_string_once(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 900)
    texts = [t for _, t in corpus(5, 40)]
    zero = pa.array([0] * len(texts), pa.int64())
    starts = {}
    for out in sd._scan(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), zero, pa.array(texts)], names=["id", "mark", "text"])])):
        for i, s, n in zip(*(out.column(c).to_pylist() for c in ("id", "start", "many")), strict=True):
            starts.setdefault(i, []).extend(range(s, s + n))
    for i, t in enumerate(texts):
        assert sorted(starts.get(i, [])) == list(range(max(0, len(t.encode()) - sd.LENGTH + 1)))


def test_shards_hold_whole_grams(monkeypatch):
    rng = random.Random(6)
    grams = [bytes(rng.choice(b"ab") for _ in range(400)) for _ in range(30)]
    rows = [(g, k, bytes(rng.choice([x[:300], x[100:], x[50:350]]))) for g, x in enumerate(grams) for k in range(rng.randrange(1, 4))]

    def spans(shard, size):
        monkeypatch.setattr(sd, "SHARD", shard)
        batches = []
        for i in range(0, len(rows), size):
            g, k, x = zip(*rows[i : i + size], strict=True)
            n = pa.array([0] * len(g), pa.int64())
            batches.append(pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(range(i, i + len(g)), pa.int64()), n, n, n, pa.array(x, pa.binary())], names=["gram", "id", "mark", "start", "copies", "snippet"]))
        return sorted(t for out in sd._shard(iter(batches)) for t in zip(*(out.column(c).to_pylist() for c in ("id", "lo", "hi")), strict=True))

    want = spans(1 << 30, 1000)
    assert want and all(spans(shard, size) == want for shard in (1, 700, 5000) for size in (1, 3, 1000))


def test_edge_cases(spark):
    same = "exactly the same text of more than two hundred bytes, " * 5
    rows = [(1, None), (2, ""), (3, "short"), (3, "short"), (4, same), (4, same), (5, "a" * 199), (6, "b" * 200), (7, "c" * 201), (None, same + "!"), (8, "x" + same * 3000)]
    assert digests(spark, rows) == wanted(rows)
    assert digests(spark, []) == []
    docs = spark.createDataFrame([(1, same, "a", 2), (2, same, "b", 3)], "doc_id long, text string, mark string, spans int")
    assert {r["id"]: len(sd.merged([tuple(x) for x in r["spans"]])) for r in sd.removed_spans(docs).collect()} == {1: 1, 2: 1}
