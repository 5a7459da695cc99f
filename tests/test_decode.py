from __future__ import annotations

import random

import pytest

from bitquarry.operators.decode import intra_stream
from bitquarry.sources import model
from bitquarry.sources.bits import BitReader, BitstreamError, unescape
from bitquarry.sources.bitstream import split_stream
from bitquarry.sources.encoder import Recorder
from bitquarry.sources.slicedata import Picture, slice_data
from bitquarry.sources.syntax import parse_payload
from bitquarry.sources.vcl import read_slice, tile_maps


def test_context_vector():
    assert model.context_count() == 531 and len(model.elements()) == 38
    assert [sum(v is not None for v in model.context_values(k)) for k in range(3)] == [161, 185, 185]
    with pytest.raises(BitstreamError, match="initialization type"):
        model.context_values(3)
    e = model.elements()
    assert model.context_place("cu_skip_flag", 2, 1) == e["cu_skip_flag"].base + 4
    assert model.context_place("cbf_chroma", 1, 12) == e["cbf_chroma"].base + 12
    assert model.context_place("sig_coeff_flag", 1, 43) == e["sig_coeff_flag"].base + 129
    assert model.context_place("sig_coeff_flag", None, 43) == e["sig_coeff_flag"].base + 43
    with pytest.raises(BitstreamError, match="no context"):
        model.context_place("sao_merge", 0, 3)


def test_ranges():
    assert model.LPS_RANGES[0] == [128, 176, 208, 240] and model.LPS_RANGES[14] == [69, 85, 100, 116] and model.LPS_RANGES[31] == [29, 35, 41, 48]
    assert model.LPS_RANGES[41] == [41, 17, 21, 25] and model.LPS_RANGES[62] == [62, 6, 7, 8] and model.LPS_RANGES[63] == [63, 2, 2, 2]
    assert all(a <= b for a, b in zip(model.AFTER_LPS, model.AFTER_LPS[1:], strict=False))


def test_decoder_of_zeros_and_of_ones():
    zeros = model.Standard(BitReader(bytes(8)), 0, 26)
    assert (zeros.bin("sao_merge", 0), zeros.bypass(), zeros.terminate()) == (zeros.first[""][0].mps, 0, 0)
    with pytest.raises(BitstreamError, match="510"):
        model.Standard(BitReader(b"\xff\x80"), 0, 26)


def test_what_is_coded_is_decoded():
    done = 0
    for seed in range(120):
        rng = random.Random(seed)
        kind, qp, share = rng.randrange(3), rng.randrange(52), rng.choice([0.2, 0.35, 0.5])
        p = Picture(width=32, height=32, ctb_log2=4, chroma=rng.choice([0, 1]), ts_to_rs=(0, 1, 2, 3), rs_to_ts=(0, 1, 2, 3), tile_ids=(0,) * 4, sao_luma=seed % 2 == 0, qp_delta=True, sign_hiding=seed % 3 == 0, transform_skip=True)
        recorder = Recorder(lambda name, inc, rng=rng, share=share: int(rng.random() < share), kind, qp, 4)
        try:
            want = slice_data(recorder, p)
        except BitstreamError:  # a value that the syntax doesn't allow
            continue
        entropy = model.Standard(BitReader(recorder.bytes()), kind, qp)
        assert slice_data(entropy, p) == want and entropy.trailing() == 0
        done += 1
    assert done > 60


def test_slices_from_bytes():
    units = split_stream(intra_stream(15))
    sps, pps = parse_payload(33, unescape(units[0][2:])), parse_payload(34, unescape(units[1][2:]))
    got = [read_slice(u[0] >> 1 & 63, u[2:], sps, pps) for u in units[2:]]
    assert len(got) == 8 and [g["header"]["independent"].get("slice_pic_order_cnt_lsb", 0) for g in got] == [0, 3, 6, 9, 12, 15, 2, 5]
    assert all(len(g["data"]["units"]) == 1 and g["zero_words"] == 0 for g in got)
    with pytest.raises(BitstreamError):
        read_slice(1, units[3][2:4], sps, pps)
    with pytest.raises(BitstreamError, match="isn't a slice"):
        read_slice(33, b"", sps, pps)


def test_tile_maps():
    assert tile_maps({"tiles_enabled_flag": False}, 3, 2) == ([0] * 6, list(range(6)), list(range(6)))
    explicit = {"tiles_enabled_flag": True, "tiles": {"num_tile_columns_minus1": 1, "num_tile_rows_minus1": 0, "uniform_spacing_flag": False, "column_width_minus1": [1], "row_height_minus1": []}}
    assert tile_maps(explicit, 4, 2) == ([0, 0, 0, 0, 1, 1, 1, 1], [0, 1, 4, 5, 2, 3, 6, 7], [0, 1, 4, 5, 2, 3, 6, 7])
    with pytest.raises(BitstreamError, match="columns"):
        tile_maps(explicit, 2, 2)
