from __future__ import annotations

import random

from bitquarry.operators.references import decoded_picture_buffer, mark_references
from bitquarry.operators.params import profile_of
from pyspark.sql import functions as F


def buffer(pictures):
    """What is held after each picture, one after the other."""
    held, out = [], []
    for pic, poc, used, waiting, room in pictures:
        gone = None
        if room:
            if len(held) >= room:
                at = next((k for k, (_, u, w) in enumerate(held) if not (u or w)), 0)
                gone = held.pop(at)[0]
            held.append((poc, used, waiting))
        out.append((pic, gone, len(held), ",".join(str(p) for p, _, _ in held)))
    return out


def test_decoded_picture_buffer(spark):
    rng = random.Random(5)
    rows = []
    for stream in range(12):
        rows += [(stream, pic, rng.randrange(40), rng.random() < 0.6, rng.random() < 0.3, stream % 5) for pic in rng.sample(range(1000), rng.randrange(0, 60))]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "stream_id long, pic_id long, poc long, used boolean, waiting boolean, capacity long")
    got = {}
    for r in decoded_picture_buffer(df).orderBy("stream_id", "pic_id").collect():
        got.setdefault(r["stream_id"], []).append((r["pic_id"], r["evicted"], r["n_held"], r["held"]))
    want = {s: buffer(sorted(r[1:] for r in rows if r[0] == s)) for s in range(12)}
    assert got == {s: w for s, w in want.items() if w}


def test_marking(spark):
    rows = [(poc, layer, [3, 9], [1, 3, 7]) for poc in range(10) for layer in (0, 1)]
    df = spark.createDataFrame(rows, "poc long, layer long, long_term array<long>, short_term array<long>").selectExpr("*", "'short' as marking", "0L as current_layer", "7L as current_poc")
    got = {(r["poc"], r["layer"]): r["marking"] for r in mark_references(df).collect()}
    assert all(got[p, 1] == "short" for p in range(10)) and got[7, 0] == "short"
    assert (got[3, 0], got[9, 0], got[1, 0], got[2, 0]) == ("long", "long", "short", "unused")


def test_profiles(spark):
    df = spark.createDataFrame([(1, [0], False), (1, [2], False), (2, [0], True), (3, [0], False), (4, [0], False), (4, [1], False)], "idc long, flags array<long>, one boolean")
    got = [r[0] for r in df.select(profile_of(F.col("idc"), F.col("flags"), F.col("one"))).collect()]
    assert got == ["Main", "Main 10", "Main 10 Still Picture", "Main Still Picture", None, "Main"]
