from __future__ import annotations

import pytest

from bitquarry.sources.bits import BitReader, BitstreamError, BitWriter
from bitquarry.sources.bitstream import split_sample, split_stream
from bitquarry.sources.syntax import CONTEXT, parse_payload, read_table, slice_pps_id, trailing_words, unit_header, width


def level(w):
    w.u(2, 0).u(1, 0).u(5, 1).u(32, 0).u(4, 0).u(43, 0).u(1, 0)
    return w.u(8, 120)


def test_unit_headers():
    assert unit_header(bytes([0x40, 0x01])) == (32, 0, 1)
    for bad in (b"\0\0", b"\x80\x01", b"\x40"):
        with pytest.raises(BitstreamError, match="header"):
            unit_header(bad)


def test_framing():
    units = [bytes([0x40, 0x01, 0xAA]), bytes([0x02, 0xBB, 0xCC])]
    assert split_stream(b"".join(b"\0\0\1" + u for u in units)) == units
    assert split_stream(b"x\0\0\0\1" + units[0] + b"\0\0\0\0\0\1\0\0\0\1" + units[1] + b"\0\0") == units
    assert split_stream(b"") == split_stream(b"\0\0\1") == split_stream(b"abc") == []
    assert split_sample(b"\0\3" + units[0] + b"\0\3" + units[1], 2) == units and split_sample(b"", 4) == []
    for bad, size in ((b"\0", 2), (b"\0\0", 2), (b"\0\5ab", 2), (b"\1a", 5)):
        with pytest.raises(BitstreamError):
            split_sample(bad, size)


def test_video_parameter_set():
    w = BitWriter().u(4, 3).u(1, 1).u(1, 1).u(6, 0).u(3, 0).u(1, 1).u(16, 0xFFFF)
    level(w).u(1, 1).ue(0).ue(0).ue(0).u(6, 0).ue(0).u(1, 0).u(1, 0).trailing()
    vps = parse_payload(32, w.bytes())
    assert vps["vps_video_parameter_set_id"] == 3 and vps["vps_reserved_0xffff_16bits"] == 0xFFFF
    assert vps["profile_tier_level"]["general_level_idc"] == 120 and len(vps["sub_layer_ordering_info"]) == 1 and "timing" not in vps


def sps_head(w, width_=64, height=64):
    w.u(4, 0).u(3, 0).u(1, 1)
    level(w).ue(2).ue(1).ue(width_).ue(height).u(1, 0).ue(2).ue(2).ue(4).u(1, 1)
    return w.ue(0).ue(0).ue(0).ue(0).ue(3).ue(0).ue(3).ue(0).ue(0)


def test_sequence_parameter_set_with_tools():
    w = sps_head(BitWriter(), 1920, 1080).u(1, 0).u(1, 1).u(1, 1).u(1, 1).u(4, 7).u(4, 7).ue(0).ue(2).u(1, 1)
    w.ue(2).ue(1).ue(0).ue(0).u(1, 1)  # one earlier picture
    w.u(1, 1).u(1, 0).ue(1).u(1, 1).u(1, 0).u(1, 1)  # predicted: used, then only its difference
    w.u(1, 0).u(1, 1).u(1, 1).u(1, 0).u(1, 0).trailing()
    sps = parse_payload(33, w.bytes())
    assert (sps["pic_width_in_luma_samples"], sps["pic_height_in_luma_samples"], sps["bit_depth_luma_minus8"]) == (1920, 1080, 2)
    assert sps["pcm"]["sample_bit_depth_luma_minus1"] == 7 and sps["amp_enabled_flag"] and "scaling_list_data" not in sps
    second = sps["short_term_ref_pic_sets"][1]
    assert second["used_by_curr_pic_flag"] == [True, False] and second["use_delta_flag"] == [False, True] and second["num_delta_pocs"] == 2


def test_scaling_lists():
    w = BitWriter()
    for k in range(20):
        if k:
            w.u(1, 0).ue(0)
        else:
            w.u(1, 1).se(8)
            for _ in range(15):
                w.se(0)
    lists = read_table("scaling_list_data", BitReader(w.bytes()))["matrices"]
    assert len(lists) == 20 and lists[0]["coefficients"] == [16] * 16
    assert [(m["size_id"], m["matrix_id"]) for m in lists[17:]] == [(2, 5), (3, 0), (3, 3)]


def test_picture_parameter_set_with_extensions():
    w = BitWriter().ue(3).ue(1).u(2, 3).u(3, 5).u(2, 3).ue(1).ue(2).se(-2).u(3, 7).ue(1).se(-1).se(2).u(6, 0b110111)
    w.ue(1).ue(1).u(1, 0).ue(3).ue(4).u(1, 1).u(1, 1).u(1, 1).u(1, 1).u(1, 0).se(-1).se(2).u(1, 0).u(1, 1).ue(2).u(1, 1).u(1, 1)
    w.u(8, 0b10010000).ue(1).u(2, 3).ue(1).ue(1).se(0).se(-1).se(2).se(-2).ue(2).ue(3)
    w.u(3, 7).se(0).se(0).se(0).u(1, 1).ue(2).u(1, 0).ue(2).ue(1).u(10, 1).u(10, 2)
    for v in (3, 4, 5, 6):
        w.u(9, v)
    pps = parse_payload(34, w.trailing().bytes())
    assert pps["pps_pic_parameter_set_id"] == 3 and pps["init_qp_minus26"] == -2 and pps["tiles"]["column_width_minus1"] == [3]
    assert pps["deblocking_filter_control"]["pps_tc_offset_div2"] == 2
    extension = pps["pps_extension"]
    assert [p["cb"] for p in extension["range_extension"]["qp_offset_list"]] == [0, 2]
    assert [p["values"] for p in extension["scc_extension"]["palette_predictor_initializers"]] == [[1, 2], [3, 4], [5, 6]]


def test_usability_information_and_timing():
    w = BitWriter().u(1, 1).u(8, 255).u(16, 100).u(16, 200).u(2, 0).u(1, 0).u(3, 0).u(1, 1).ue(1).ue(2).ue(3).ue(4)
    w.u(1, 1).u(32, 1001).u(32, 60000).u(1, 0).u(1, 1)
    w.u(2, 2).u(1, 0).u(4, 1).u(4, 2).u(15, 0).u(1, 1).ue(0).ue(0).ue(5).ue(6).u(1, 1)  # one layer with one buffer
    w.u(1, 0)
    vui = read_table("vui", BitReader(w.trailing().bytes()), 0)
    assert (vui["sar_width"], vui["sar_height"], vui["default_display_window"], vui["timing_info"]["time_scale"]) == (100, 200, [1, 2, 3, 4], 60000)
    layer = vui["timing_info"]["hrd_parameters"]["sub_layers"][0]
    assert layer["nal_hrd_parameters"][0]["cpb_size_value_minus1"] == 6 and "vcl_hrd_parameters" not in layer


def test_messages_and_short_payloads():
    sei = parse_payload(39, bytes([5, 1, 0xAB, 255, 5, 0, 0x80]))
    assert [(m["payload_type"], m["payload"]) for m in sei["messages"]] == [(5, [0xAB]), (260, [])]
    assert parse_payload(35, BitWriter().u(3, 2).trailing().bytes())["pic_type"] == 2
    assert parse_payload(38, b"\xff\xff\x80")["filler_byte_count"] == 2
    assert parse_payload(36, b"") == {} and parse_payload(45, b"x") is None
    for kind, payload in ((36, b"\x80"), (35, BitWriter().u(3, 2).trailing().u(8, 0).bytes()), (33, b"\x01")):
        with pytest.raises(BitstreamError):
            parse_payload(kind, payload)
    assert trailing_words(BitReader(b"\x80\0\0")) == 1


def test_slice_headers():
    context = CONTEXT | {"nal_unit_type": 19, "slice_segment_address_bits": 4, "dependent_slice_segments_enabled_flag": True}
    w = BitWriter().u(1, 1).u(1, 0).ue(2).ue(2).se(-3).trailing()
    got = read_table("slice_header", BitReader(w.bytes()), context)
    assert got["slice_pic_parameter_set_id"] == 2 and got["independent"]["slice_type"] == 2 and got["independent"]["slice_qp_delta"] == -3
    assert slice_pps_id(19, w.bytes()) == 2
    w = BitWriter().u(1, 0).u(1, 0).ue(2).u(1, 1).u(4, 3).trailing()
    got = read_table("slice_header", BitReader(w.bytes()), context)
    assert got["dependent_slice_segment_flag"] and got["slice_segment_address"] == 3 and "independent" not in got
    with pytest.raises(BitstreamError, match="slice_type"):
        read_table("slice_header", BitReader(BitWriter().u(1, 1).u(1, 0).ue(0).ue(3).trailing().bytes()), context)


def test_weighted_inter_slice():
    context = CONTEXT | {"nal_unit_type": 1, "weighted_pred_flag": True, "lists_modification_present_flag": True, "num_pic_total_curr": 3}
    w = BitWriter().u(1, 1).ue(0).ue(1).u(4, 9).ue(0).ue(0)  # a predicted slice with an empty set of its own
    w.u(1, 1).ue(1).u(1, 1).u(2, 2).u(2, 0).ue(5).se(-1).u(2, 0b10).u(2, 0b01).se(3).se(-4).se(1).se(2).se(3).se(4).ue(2).se(1).trailing()
    body = read_table("slice_header", BitReader(w.bytes()), context)["independent"]
    assert body["slice_pic_order_cnt_lsb"] == 9 and body["list_entry_l0"] == [2, 0] and body["five_minus_max_num_merge_cand"] == 2
    assert body["weights_l0"]["entries"] == [{"delta_luma_weight": 3, "luma_offset": -4}, {"chroma_weight_offset": [1, 2, 3, 4]}]


def test_colour_mapping_recursion():
    w = BitWriter().ue(0).u(6, 1).u(2, 1).u(2, 0).ue(0).ue(0).ue(0).ue(0).u(2, 0).u(2, 0).se(0).se(0).u(1, 1)
    for _ in range(8):
        w.u(4, 0)
    root = read_table("colour_mapping", BitReader(w.bytes()))["root"]
    assert root["split_octant_flag"] and [(c["idx_y"], c["idx_cb"], c["idx_cr"]) for c in root["children"]][:3] == [(0, 0, 0), (0, 0, 1), (0, 1, 0)]


def test_counts_from_the_data_are_bounded():
    with pytest.raises(BitstreamError, match="too many"):
        read_table("sei_message", BitReader(b"\0" + b"\xff" * 300 + b"\0"))
    assert width(1) == 0 and width(2) == 1 and width(5) == 3
