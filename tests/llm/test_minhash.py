from __future__ import annotations

import random

import numpy as np
import pytest

from bitquarry.llm import minhash

from . import brute

SCHEMA = "doc_id long, text string"


def classes(spark, rows, schema=SCHEMA):
    return {r["id"]: r["class_id"] for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, schema)).collect()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    element = np.arange(400, dtype=np.uint64) * np.uint64(2654435761)
    a, b = rng.uniform(0.2, 3, 400), rng.uniform(0.2, 3, 400)
    b[:200] = a[:200]
    k = 5000
    doc = np.zeros(400, np.int64)
    x, y = (minhash.dart_signatures(element, w, doc, 1, k) for w in (a, b))
    assert abs((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.025


def test_signature_does_not_depend_on_the_batch():
    element = np.arange(50, dtype=np.uint64)
    one = minhash.dart_signatures(element, np.ones(50), np.zeros(50, np.int64), 1, 96)
    both = minhash.dart_signatures(np.concatenate([element[:3], element]), np.ones(53), np.repeat([0, 2], [3, 50]), 3, 96)
    assert (both[2] == one[0]).all() and not both[1].any() and both[0].all()


def test_classes_match_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(3000)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for k, words in enumerate(base):
        rows += [(1000 * k + i, edited(rng, words, rng.choice([0, 1, 2, 3, 4, 5, 6, 8]))) for i in range(25)]
    rows += [(9000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40)))) for i in range(40)]
    rng.shuffle(rows)
    assert classes(spark, rows) == brute.near_duplicates(rows)


def test_edge_cases(spark):
    long_text = "alpha beta gamma delta epsilon " * 40_000
    rows = [(1, None), (2, ""), (3, "!!! ..."), (4, "One two"), (5, "one TWO!"), (6, "one two three"), (7, long_text), (8, long_text + "zeta"), (7, long_text), (None, "one two")]
    got = classes(spark, rows)
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, None: None}


def test_empty_table_and_clashing_columns(spark):
    assert classes(spark, []) == {}
    rows = [(1, "a b c d e f", 9, "x", 2), (2, "a b c d e f", 8, "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, class_id string, band long")
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == rows[:1]


@pytest.mark.parametrize("size", [1500])
def test_large_group_of_copies_is_not_all_its_pairs(spark, size):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(80)]
    rows = [(i, edited(rng, words, 1)) for i in range(size)] + [(size + i, " ".join(words)) for i in range(size)]
    assert len(set(classes(spark, rows).values())) == 1


def test_columns_of_any_name_pass_through(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "a", 5), (2, text, "b", 6), (3, None, "c", 7)], "doc_id long, text string, gone string, gone_ int")
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
