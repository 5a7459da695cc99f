from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitquarry.operators import blocks
from bitquarry.operators.planes import kernel
from bitquarry.operators.reconstruct import chroma_mode, dequantise, luma_mode, pictures, predict, reconstruct, transform
from bitquarry.sources.bits import BitstreamError
from bitquarry.sources.entropy import Scripted
from bitquarry.sources.slicedata import Picture, slice_data


def test_modes():
    assert [luma_mode(0, 0, True, 2, 0), luma_mode(10, 10, True, 1, 0), luma_mode(0, 1, False, 0, 0)] == [26, 9, 2]
    for a in range(36):
        for b in range(36):
            rest = [luma_mode(a, b, False, 0, r) for r in range(32)]
            assert len(set(rest)) == 32 and not set(rest) & {luma_mode(a, b, True, m, 0) for m in range(3)}
    assert [chroma_mode(k, 10) for k in range(5)] == [0, 26, 34, 1, 10] and chroma_mode(4, 34, True) == 31


def rows(spark, planes):
    data = [(k, 8, 8, [int(v) for v in p.reshape(-1)]) for k, p in enumerate(planes)]
    return spark.createDataFrame(data, "plane_id long, width long, height long, samples array<long>")


def made(df, n):
    out: dict[int, list] = {}
    for r in df.collect():
        out.setdefault(r["plane_id"], [0] * n)[r["i"]] = r["s"]
    return {k: np.array(v) for k, v in out.items()}


def test_kernels_agree_with_the_expressions(spark):
    rng = np.random.default_rng(2)
    planes = rng.integers(0, 256, (70, 8, 8))
    df = rows(spark, planes)
    refs = blocks.with_references(df)
    for template, mode in ((blocks.PLANAR, lambda k: 0), (blocks.DC, lambda k: 1), (blocks.ANGULAR, lambda k: k % 33 + 2)):
        got = made(kernel(refs, template), 16)
        for k, p in enumerate(planes):
            assert (got[k].reshape(4, 4) == predict(p, k % 6, k % 5, 4, 4, mode(k), 8)).all(), (k, mode(k))
    got = made(kernel(df.withColumn("shift", F.lit(5).cast("long")), blocks.DEQUANTISED), 16)
    for k, p in enumerate(planes):
        assert (got[k].reshape(4, 4) == dequantise(p.reshape(-1)[:16].reshape(4, 4) - 128, k % 52, 8)).all()
    for template, n, four in ((blocks.DCT8, 8, False), (blocks.DCT4, 4, False), (blocks.DST4, 4, True)):
        got = made(kernel(df, template), n * n)
        for k, p in enumerate(planes):
            assert (got[k].reshape(n, n) == transform(p.reshape(-1)[: n * n].reshape(n, n) - 128, 8, four)).all()


SCRIPT = [0, 0, 5, 1, 0, 0, 0, 0, 0, 1]


def test_pictures(spark):
    p = Picture(width=8, height=8, ctb_log2=3, min_cb_log2=3, chroma=0, min_tb_log2=3, max_tb_log2=3)
    data = slice_data(Scripted(SCRIPT), p)
    unit = data["units"][0]["tree"]["transform"]["unit"]
    assert unit["luma"]["levels"] == [1]
    (plane,) = reconstruct(p, data, 30)
    level = np.zeros((8, 8), int)
    level[0, 0] = 1
    assert (plane == np.clip(transform(dequantise(level, 30, 8), 8, False), 0, 255)).all() and plane.any()
    options = '{"width": 8, "height": 8, "ctb_log2": 3, "min_cb_log2": 3, "chroma": 0, "min_tb_log2": 3, "max_tb_log2": 3}'
    df = spark.createDataFrame([(1, options, SCRIPT, 30), (2, options, SCRIPT[:4], 30)], "stream_id long, picture string, values array<long>, qp int")
    got = {r["stream_id"]: r for r in pictures(df).collect()}
    assert got[1]["samples"] == plane.reshape(-1).tolist() and got[2]["error"].startswith("unexpected end")


def test_chroma_and_what_cannot_be_done():
    p = Picture(width=8, height=8, ctb_log2=3, min_cb_log2=3, chroma=1, min_tb_log2=3, max_tb_log2=3)
    planes = reconstruct(p, slice_data(Scripted([0, 0, 5, 0, 0, 0, 0, 1]), p), 30)
    assert [x.shape for x in planes] == [(8, 8), (4, 4), (4, 4)]
    wide = Picture(width=8, height=8, ctb_log2=3, min_cb_log2=3, chroma=2, min_tb_log2=3, max_tb_log2=3)
    with pytest.raises(BitstreamError, match="square"):
        reconstruct(wide, slice_data(Scripted([0, 0, 5, 0, 0, 0, 0, 0, 0, 1]), wide), 30)
    inter = {"units": [{"tree": {"x": 0, "y": 0, "unit": {"skip": True}}}]}
    with pytest.raises(BitstreamError, match="non-intra"):
        reconstruct(p, inter, 30)
