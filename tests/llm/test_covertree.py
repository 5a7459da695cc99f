from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from bitquarry.llm import covertree

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int"


def links(spark, rows, schema=SCHEMA):
    out = covertree.embedding_links(spark.createDataFrame(rows, schema))
    return {r["id"]: (r["n_links"], r["component_id"]) for r in out.collect()}


def vectors(seed, n, dim=8, near=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * near * rng.choice([0.5, 1, 2, 4], (n, 1))
    return x.astype(np.float32)


def test_dual_traversal_matches_all_pairs():
    for seed in range(6):
        x = vectors(seed, 300).astype(np.float64)
        weight = np.random.default_rng(seed).integers(1, 4, 300)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        linked = unit @ unit.T >= 0.93
        count, root = covertree.dual_links(x, weight, 0, 0.93)
        assert (count == linked @ weight - weight).all()
        want = brute.components(range(300), list(zip(*np.nonzero(linked), strict=True)))
        assert root.tolist() == [want[i] for i in range(300)]
        count, _ = covertree.dual_links(x, weight, 120, 0.93)
        cross = linked.copy()
        cross[:120, :120] = cross[120:, 120:] = False
        assert (count == cross @ weight).all()


def test_matches_brute_force(spark, monkeypatch):
    x = vectors(7, 240)
    rng = np.random.default_rng(0)
    x[200:220] = x[rng.integers(0, 200, 20)]
    rows = [(int(i) * 3, [float(v) for v in x[i]], int(rng.integers(0, 3))) for i in range(240)]
    want = brute.cosine_links(rows, 0.93)
    assert links(spark, rows) == want
    for block, centres in ((16, 256), (8, 2)):  # many regions, few regions of many blocks
        monkeypatch.setattr(covertree, "BLOCK", block)
        monkeypatch.setattr(covertree, "CENTRES", centres)
        monkeypatch.setattr(covertree, "DEALT", 50)
        assert links(spark, rows) == want


def test_several_blocks_of_real_size_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(5000, 16)), vectors(8, 2000, 16), rng.normal(size=(1, 16)) + rng.normal(size=(2000, 16)) * 0.07]).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    root = brute.components(range(len(x)), list(zip(*np.nonzero(np.triu(linked)), strict=True)))
    got = links(spark, [(i, v, 1) for i, v in enumerate(x.tolist())])
    assert got == {i: (int(linked[i].sum()), root[i]) for i in range(len(x))}


def test_regions_that_are_far_apart_never_meet():
    unit = np.eye(3)[[0, 0, 1, 2]] + np.array([[0, 0, 0], [0, 0.01, 0], [0, 0, 0], [0, 0, 0]])
    rows = {"label": [1, 1, 1], "dim": [3, 3, 3], "region": [0, 1, 2], "centre": unit[[0, 2, 3]].tolist(), "radius": [0.02, 0.0, 1.2], "blocks": [2, 1, 3]}
    got = covertree._meet(0.93)((), pa.table(rows)).to_pylist()
    assert [[(m["base"], m["blocks"]) for m in r["met"]] for r in got] == [[(0, 2), (3, 3)], [(2, 1), (3, 3)], [(0, 2), (2, 1), (3, 3)]]
    assert [r["base"] for r in got] == [0, 2, 3]


def test_near_copies_chain_and_cosines_at_the_limit(spark):
    turn = [[math.cos(0.3 * k), math.sin(0.3 * k)] for k in range(12)]  # cos 0.3 = 0.955, cos 0.6 = 0.825
    rows = [(k, v, 0) for k, v in enumerate(turn)] + [(50, [1.0, 0.0, 0.0], 1), (51, [0.93, math.sqrt(1 - 0.93**2), 0.0], 1)]
    got = links(spark, rows, "vec_id long, embedding array<double>, label int")
    assert got == brute.cosine_links(rows, 0.93)
    assert got[11] == (1, 0)


def test_edge_cases(spark):
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, math.nan], 0), (6, [math.inf, 1.0], 0), (7, [1.0, 0.0], None),
        (8, [1.0, 0.0], 0), (9, [1.0, 0.0], 0), (10, [5.0, 0.1], 0), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (13, [-1.0, 0.0], 0),
    ]
    got = links(spark, rows)
    assert got == {**{k: (0, k) for k in (1, 2, 3, 4, 5, 6, 7, 11, 12, 13, None)}, 8: (2, 8), 9: (2, 8), 10: (2, 8)}


def test_repeated_rows_empty_table_and_other_columns(spark):
    assert links(spark, []) == {}
    rows = [(1, [1.0, 0.0], 0, 5, 6), (1, [1.0, 0.0], 0, 7, 8), (2, [0.0, 1.0], 0, 9, 1)]
    got = covertree.embedding_links(spark.createDataFrame(rows, SCHEMA + ", rep long, block long")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]
