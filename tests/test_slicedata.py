from __future__ import annotations

import pytest

from bitquarry.sources.bits import BitstreamError
from bitquarry.sources.entropy import Scripted
from bitquarry.sources.slicedata import (
    Latches, Neighbours, Picture, coding_tree, coding_unit, cross_component, dense_levels, motion_difference, palette, palette_samples, partition_sizes, prediction_unit, residual, rows_of_tree,
    sample_offsets, scan_places, slice_data, transform_tree,
)


def test_coding_tree_shape():
    p = Picture(width=8, height=8, ctb_log2=3, min_cb_log2=2)
    tree = coding_tree(Scripted([1]), p, 0, 0, 3, shape_only=True)
    assert tree["split"] and [(c["x"], c["y"]) for c in tree["children"]] == [(0, 0), (4, 0), (0, 4), (4, 4)]
    rows = list(rows_of_tree(tree))
    assert [r["path"] for r in rows] == [[], [0], [1], [2], [3]] and [r["leaf"] for r in rows] == [False, True, True, True, True]
    beyond = coding_tree(Scripted([]), Picture(width=6, height=8, ctb_log2=3, min_cb_log2=2), 0, 0, 3, shape_only=True)
    assert not beyond["split"]  # over the edge: no flag is read


def test_small_structures():
    mvd = motion_difference(Scripted([1, 0, 1, 2, 1]))
    assert mvd == {"greater0": [True, False], "greater1": [True, False], "minus2": [2, None], "sign": [True, None]}
    assert cross_component(Scripted([2, 1])) == {"log2_plus1": 2, "sign": True} and cross_component(Scripted([0])) == {"log2_plus1": 0}
    latches = Latches()
    latches.read_qp(Scripted([3, 1]))
    latches.read_qp(Scripted([]))  # read once
    assert latches.qp == -3
    latches.read_chroma(Scripted([1, 2]), 2)
    assert latches.chroma == {"enabled": True, "index": 2}


def test_sample_offsets():
    p = Picture(sao_luma=True, sao_chroma=True, depth_luma=10, depth_chroma=10)
    e = Scripted([1, 0, 1, 0, 2, 0, 1, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
    sao = sample_offsets(e, p, False, False)
    assert sao["luma"] == {"type": 1, "abs": [0, 1, 0, 2], "sign": [False, True], "band": 3}
    assert sao["cb"]["type"] == sao["cr"]["type"] == 0 and not e.values
    assert sample_offsets(Scripted([0, 1]), p, True, True) == {"merge_left": False, "merge_up": True}


def test_prediction_units():
    p = Picture(slice_type=1)
    unit = prediction_unit(Scripted([0, 0, 0, 1]), p, False)
    assert unit["merge"] is False and unit["mvd_l0"]["greater0"] == [False, False] and unit["mvp_l0"] is True
    assert prediction_unit(Scripted([3]), p, True) == {"merge_idx": 3}
    both = prediction_unit(Scripted([0, 2, 0, 0, 1, 1]), Picture(slice_type=0, mvd_l1_zero=True), False)
    assert both["direction"] == 2 and "mvd_l1" not in both and both["mvp_l1"] is True
    assert partition_sizes(16, 4) == [(16, 4), (16, 12)] and partition_sizes(16, 7) == [(4, 16), (12, 16)] and len(partition_sizes(8, 3)) == 4


def test_coding_units():
    p = Picture(min_cb_log2=2)
    unit = coding_unit(Scripted([0, 1, 2, 0]), p, 2)
    assert unit["part_mode"] == 0 and unit["luma_modes"] == [{"previous": True, "mpm": 2}] and unit["chroma_modes"] == [4] and unit["transforms"]
    skipped = coding_unit(Scripted([1, 0]), Picture(slice_type=1, min_cb_log2=2), 2)
    assert skipped["skip"] and not skipped["transforms"]
    merged = coding_unit(Scripted([0, 0, 0, 1, 0]), Picture(slice_type=1, min_cb_log2=2), 2)
    assert merged["units"] == [{"merge": True, "merge_idx": 0}] and merged["transforms"] and "root_cbf" not in merged
    pcm = coding_unit(Scripted([1]), Picture(min_cb_log2=2, pcm_log2=(3, 5)), 3)
    assert pcm["pcm"] and not pcm["transforms"]


def test_transform_trees():
    leaf = transform_tree(Scripted([0]), Picture(chroma=0), 0, 0, 2)
    assert not leaf["split"] and leaf["cbf_luma"] is False and "unit" not in leaf
    p = Picture(chroma=1, max_tb_log2=3)
    tree = transform_tree(Scripted([0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]), p, 0, 0, 4)
    assert tree["split"] and len(tree["children"]) == 4  # inferred above the largest size
    unit = transform_tree(Scripted([1, 0, 0, 0, 0, 0]), Picture(chroma=0), 0, 0, 2)["unit"]
    assert unit["qp_delta"] == 0 and unit["luma"]["levels"] == [1]


def test_residuals():
    p = Picture()
    one = residual(Scripted([0, 0, 0, 0]), p, 2, 0, True, False, 0, 0, [0] * 4)
    assert one["levels"] == [1] and one["places"] == [(0, 0)] and one["significant"] == [True]
    # last at (1, 0) of a 4x4 block, with two places before it in the diagonal scan, of which the first counts
    more = residual(Scripted([1, 0, 0, 0, 1, 1, 0, 1, 0, 1, 4, 0]), p, 2, 0, True, False, 0, 0, [0] * 4)
    assert more["last"] == (1, 0) and more["significant"] == [True, False, True] and more["places"] == [(1, 0), (0, 0)]
    assert more["greater1"] == [True, False] and more["greater2"] is True and more["remaining"] == [4] and more["levels"] == [7, -1]
    hidden = Picture(sign_hiding=True)
    got = residual(Scripted([3, 0, 3, 0] + [0] * 30), hidden, 2, 0, True, False, 0, 0, [0] * 4)
    assert len(got["levels"]) == sum(got["significant"])
    with pytest.raises(BitstreamError):
        residual(Scripted([0] * 9), p, 1, 0, True, False, 0, 0, [0] * 4)
    with pytest.raises(BitstreamError):
        scan_places(4, 3)
    dense = dense_levels(one, 2)
    assert dense[0] == 1 and sum(map(abs, dense)) == 1


def test_palettes():
    p = Picture(chroma=0, palette_max_size=4)
    got = palette(Scripted([0]), p, 4, False)
    assert got["runs"] == [{"scan": 0, "above": False, "length": 16}] and not got["escape"]
    # two new entries, no escape, two indices: a run of 4 (prefix 2, suffix 1), the other to the end
    got = palette(Scripted([2, 10, 20, 0, 1, 0, 1, 0, 0, 2, 1, 0]), p, 4, False)
    assert got["new"] == [[10, 20]] and [(r["index"], r["length"]) for r in got["runs"]] == [(0, 4), (1, 12)]
    planes = palette_samples([[10, 20]], got["runs"], [], 4, 4, False, 8)
    assert planes == [[10] * 4 + [20] * 12]
    above = [{"scan": 0, "above": False, "index": 0, "length": 2}, {"scan": 2, "above": False, "index": 2, "length": 2}, {"scan": 4, "above": True, "length": 4}]
    assert palette_samples([[10, 20]], above, [[300, 7, 8, 9]], 4, 2, False, 8) == [[10, 10, 255, 7, 10, 10, 8, 9]]
    with pytest.raises(BitstreamError):
        palette(Scripted([9]), p, 4, False)


def test_slice_data():
    p = Picture(width=4, height=4, ctb_log2=2, min_cb_log2=2, chroma=0, transforms=False)
    got = slice_data(Scripted([0, 1, 2, 1]), p)
    assert got["boundaries"] == 0 and len(got["units"]) == 1 and got["units"][0]["end"] and got["units"][0]["addr_rs"] == 0
    two = Picture(width=8, height=4, ctb_log2=2, min_cb_log2=2, chroma=0, transforms=False, tiles=True, tile_ids=(0, 1), ts_to_rs=(0, 1), rs_to_ts=(0, 1))
    got = slice_data(Scripted([0, 1, 2, 0, 1, 0, 1, 2, 1]), two)
    assert got["boundaries"] == 1 and [u["addr_ts"] for u in got["units"]] == [0, 1]
    with pytest.raises(BitstreamError, match="no following"):
        slice_data(Scripted([0, 1, 2, 0]), p)


def test_neighbours():
    near = Neighbours(Picture(width=16, height=16, ctb_log2=3, min_cb_log2=2))
    near.enter(0, 0, False, False)
    near.record(0, 0, 8, 0, True)
    near.enter(8, 0, True, False)
    assert near.look(8, 0) == [(0, True)]
    near.enter(8, 0, False, False)
    assert near.look(8, 0) == []  # another slice or tile
    near.record(8, 0, 4, 1, False)
    assert near.look(12, 0) == [(1, False)] and near.look(8, 4) == [(1, False)]
