"""Slices from their bytes: header, slice data by arithmetic decoding, closing bits; and the pictures of intra slices."""

from __future__ import annotations

from functools import lru_cache
from typing import Any

import numpy as np

from .bits import BitReader, BitstreamError, unescape
from .bitstream import substreams
from .model import Standard
from .slicedata import Picture, slice_data
from .syntax import read_table, slice_context, width


def _invalid(message: str) -> BitstreamError:
    return BitstreamError("invalid syntax value", message)


def ctb_geometry(sps: dict[str, Any]) -> tuple[int, int, int]:
    """(log2 of the block size, blocks across, blocks down) of a sequence's pictures."""
    log2 = sps["log2_min_luma_coding_block_size_minus3"] + sps["log2_diff_max_min_luma_coding_block_size"] + 3
    return log2, -(-sps["pic_width_in_luma_samples"] >> log2), -(-sps["pic_height_in_luma_samples"] >> log2)


def tile_maps(pps: dict[str, Any], across: int, down: int) -> tuple[list[int], list[int], list[int]]:
    """Of a picture of ``across`` x ``down`` blocks: the tile by place in tile scan, and the raster place by place in
    tile scan and the other way round."""
    tiles = pps.get("tiles") if pps.get("tiles_enabled_flag") else {"num_tile_columns_minus1": 0, "num_tile_rows_minus1": 0, "uniform_spacing_flag": True}
    if tiles is None:
        raise _invalid("tiles are enabled but not described")

    explicit = not tiles["uniform_spacing_flag"]
    given = (tuple(tiles["column_width_minus1"]), tuple(tiles["row_height_minus1"])) if explicit else (None, None)
    tile, to_raster, to_scan = _tile_maps(tiles["num_tile_columns_minus1"] + 1, tiles["num_tile_rows_minus1"] + 1, *given, across, down)
    return tile.tolist(), to_raster.tolist(), to_scan.tolist()


@lru_cache(maxsize=16)
def _tile_maps(n_columns: int, n_rows: int, widths: tuple[int, ...] | None, heights: tuple[int, ...] | None, across: int, down: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def sizes(n: int, whole: int, given: tuple[int, ...] | None, axis: str) -> list[int]:
        if n > whole:
            raise _invalid("tile layout doesn't fit the picture")
        if given is None:
            return [(k + 1) * whole // n - k * whole // n for k in range(n)]
        rest = whole - sum(v + 1 for v in given)
        if rest <= 0:
            raise _invalid(f"tile {axis} leave nothing for the last one")
        return [*(v + 1 for v in given), rest]

    columns, rows = sizes(n_columns, across, widths, "columns"), sizes(n_rows, down, heights, "rows")
    tile = np.repeat(np.arange(len(rows)), rows)[:, None] * len(columns) + np.repeat(np.arange(len(columns)), columns)
    to_raster = np.argsort(tile.reshape(-1), kind="stable")
    to_scan = np.empty_like(to_raster)
    to_scan[to_raster] = np.arange(len(to_raster))
    return tile.reshape(-1)[to_raster], to_raster, to_scan


def slice_picture(header: dict[str, Any], sps: dict[str, Any], pps: dict[str, Any], points: tuple[tuple[int, int], ...]) -> Picture:
    """What the data of a slice is read with."""
    body = header["independent"]
    log2, across, down = ctb_geometry(sps)
    tile_ids, ts_to_rs, rs_to_ts = tile_maps(pps, across, down)
    start = header.get("slice_segment_address", 0)
    if start >= len(ts_to_rs):
        raise _invalid("slice address is outside picture")
    kind = body["slice_type"]
    extension, more = sps.get("sps_extension", {}), pps.get("pps_extension", {})
    sps_range, sps_scc, pps_range, pps_scc = extension.get("range_extension", {}), extension.get("scc_extension", {}), more.get("range_extension", {}), more.get("scc_extension", {})
    min_tb = sps["log2_min_luma_transform_block_size_minus2"] + 2
    pcm = sps.get("pcm")
    smallest_pcm = pcm["log2_min_pcm_luma_coding_block_size_minus3"] + 3 if pcm else 0
    chroma = 0 if sps["separate_colour_plane_flag"] else sps["chroma_format_idc"]
    return Picture(
        width=sps["pic_width_in_luma_samples"], height=sps["pic_height_in_luma_samples"], ctb_log2=log2, min_cb_log2=sps["log2_min_luma_coding_block_size_minus3"] + 3,
        slice_type=kind, chroma=chroma, depth_luma=sps["bit_depth_luma_minus8"] + 8, depth_chroma=sps["bit_depth_chroma_minus8"] + 8, amp=sps["amp_enabled_flag"],
        bypass_enabled=pps["transquant_bypass_enabled_flag"], palette_enabled=sps_scc.get("palette_mode_enabled_flag", False), palette_max_size=sps_scc.get("palette_max_size", 0),
        pcm_log2=(smallest_pcm, smallest_pcm + pcm["log2_diff_max_min_pcm_luma_coding_block_size"]) if pcm else None,
        min_tb_log2=min_tb, max_tb_log2=min_tb + sps["log2_diff_max_min_luma_transform_block_size"], max_depth=sps[f"max_transform_hierarchy_depth_{'intra' if kind == 2 else 'inter'}"],
        transform_skip=pps["transform_skip_enabled_flag"], max_skip_log2=pps_range.get("log2_max_transform_skip_block_size_minus2", 0) + 2,
        explicit_rdpcm=sps_range.get("explicit_rdpcm_enabled_flag", False), implicit_rdpcm=sps_range.get("implicit_rdpcm_enabled_flag", False), sign_hiding=pps["sign_data_hiding_enabled_flag"],
        colour_transform=pps_scc.get("residual_adaptive_colour_transform_enabled_flag", False), cross_component=pps_range.get("cross_component_prediction_enabled_flag", False),
        qp_delta=pps["cu_qp_delta_enabled_flag"], chroma_qp_offset=body.get("cu_chroma_qp_offset_enabled_flag", False), chroma_qp_list=pps_range.get("chroma_qp_offset_list_len_minus1", 0),
        sao_luma=body.get("slice_sao_luma_flag", False), sao_chroma=body.get("slice_sao_chroma_flag", False),
        active_l0_minus1=body.get("num_ref_idx_l0_active_minus1", pps["num_ref_idx_l0_default_active_minus1"]), active_l1_minus1=body.get("num_ref_idx_l1_active_minus1", pps["num_ref_idx_l1_default_active_minus1"]),
        five_minus_merge=body.get("five_minus_max_num_merge_cand", 0), mvd_l1_zero=body.get("mvd_l1_zero_flag", False), wavefront=pps["entropy_coding_sync_enabled_flag"], tiles=pps["tiles_enabled_flag"],
        slice_address=ts_to_rs[start], start=start, tile_ids=tuple(tile_ids), ts_to_rs=tuple(ts_to_rs), rs_to_ts=tuple(rs_to_ts), entry_points=points,
    )


def slice_qp(header: dict[str, Any], pps: dict[str, Any]) -> int:
    return max(0, min(51, 26 + pps["init_qp_minus26"] + header["independent"].get("slice_qp_delta", 0)))


def init_type_of(slice_type: int, flag: bool) -> int:
    return 0 if slice_type == 2 else (2 if flag else 1) if slice_type == 1 else 1 if flag else 2


def read_slice(nal_type: int, payload: bytes, sps: dict[str, Any], pps: dict[str, Any]) -> dict[str, Any]:
    """Header, data and the zero words behind it of a slice from its escaped payload. The data of a segment that depends
    on the one before it isn't read."""
    if nal_type > 31:
        raise _invalid("the unit isn't a slice")
    plain = unescape(payload)
    _, across, down = ctb_geometry(sps)
    reader = BitReader(plain)
    header = read_table("slice_header", reader, slice_context(nal_type, sps, pps, width(across * down)))
    body = header.get("independent")
    if body is None:
        return {"header": header, "data": None, "zero_words": 0}
    start = reader.at // 8
    offsets = header["tail"].get("entry_point_offset_minus1", [])
    points = tuple(substreams(payload, start, offsets)) if offsets else ()
    picture = slice_picture(header, sps, pps, points)
    entropy = Standard(BitReader(plain[start:]), init_type_of(body["slice_type"], body.get("cabac_init_flag", False)), slice_qp(header, pps))
    if points:
        entropy.substream(*points[0])
        entropy.restart()
    data = slice_data(entropy, picture)
    return {"header": header, "picture": picture, "data": data, "zero_words": entropy.trailing()}
