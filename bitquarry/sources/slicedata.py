"""Slice data over an entropy reader: coding trees, units, transform trees, residuals, palettes and offsets.

Everything is a function of the reader and of what the parameter sets say (``Picture``); results are plain dicts that
hold only what was read. Trees become rows with ``rows_of_tree``, since rows can't nest without bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from .bits import BitstreamError
from .entropy import Entropy


@dataclass(frozen=True)
class Picture:
    """What slice data is read with; the defaults switch every tool off."""

    width: int = 8
    height: int = 8
    ctb_log2: int = 3
    min_cb_log2: int = 3
    slice_type: int = 2
    chroma: int = 1
    depth_luma: int = 8
    depth_chroma: int = 8
    amp: bool = False
    bypass_enabled: bool = False
    palette_enabled: bool = False
    palette_max_size: int = 0
    palette_predictor_size: int = 0
    pcm_log2: tuple[int, int] | None = None
    min_tb_log2: int = 2
    max_tb_log2: int = 5
    max_depth: int = 3
    transforms: bool = True
    transform_skip: bool = False
    max_skip_log2: int = 2
    explicit_rdpcm: bool = False
    implicit_rdpcm: bool = False
    sign_hiding: bool = False
    persistent_rice: bool = False
    extended_precision: bool = False
    bypass_alignment: bool = False
    colour_transform: bool = False
    cross_component: bool = False
    qp_delta: bool = False
    chroma_qp_offset: bool = False
    chroma_qp_list: int = 0
    sao_luma: bool = False
    sao_chroma: bool = False
    active_l0_minus1: int = 0
    active_l1_minus1: int = 0
    five_minus_merge: int = 0
    mvd_l1_zero: bool = False
    wavefront: bool = False
    tiles: bool = False
    slice_address: int = 0
    start: int = 0
    tile_ids: tuple[int, ...] = (0,)
    ts_to_rs: tuple[int, ...] = (0,)
    rs_to_ts: tuple[int, ...] = (0,)
    entry_points: tuple[tuple[int, int], ...] = ()

    @property
    def columns(self) -> int:
        return -(-self.width >> self.ctb_log2)


@dataclass
class Latches:
    """What a transform tree reads once: the quantiser's change and the chroma offset, and how its levels run."""

    qp: int | None = None
    chroma: dict[str, Any] | None = None
    statistics: list[int] = field(default_factory=lambda: [0] * 4)

    def read_qp(self, e: Entropy) -> None:
        if self.qp is None:
            size = e.qp_delta()
            self.qp = -size if size and e.bypass() else size

    def read_chroma(self, e: Entropy, longest: int) -> None:
        if self.chroma is None:
            self.chroma = {"enabled": e.flag("cu_chroma_qp_offset_flag")}
            if self.chroma["enabled"] and longest:
                self.chroma["index"] = e.rice_in("cu_chroma_qp_offset_idx", 0, 5, longest, same=True)


def motion_difference(e: Entropy) -> dict[str, Any]:
    some = [e.flag("abs_mvd", 0) for _ in range(2)]
    more = [s and e.flag("abs_mvd", 1) for s in some]
    out: dict[str, Any] = {"greater0": some, "greater1": more, "minus2": [None, None], "sign": [None, None]}
    for k in range(2):
        if some[k]:
            if more[k]:
                out["minus2"][k] = e.golomb(1)
            out["sign"][k] = bool(e.bypass())
    return out


def cross_component(e: Entropy) -> dict[str, Any]:
    out: dict[str, Any] = {"log2_plus1": e.rice_in("log2_res_scale_abs_plus1", 0, 4, 4)}
    if out["log2_plus1"]:
        out["sign"] = e.flag("res_scale_sign_flag")
    return out


def sample_offsets(e: Entropy, p: Picture, left: bool, up: bool) -> dict[str, Any]:
    """Offsets of a coding-tree unit. They are read for every type, none included; the second chroma component has
    the first one's type and reads the rest anew."""
    out: dict[str, Any] = {"merge_left": left and e.flag("sao_merge")}
    out["merge_up"] = up and not out["merge_left"] and e.flag("sao_merge")
    if out["merge_left"] or out["merge_up"]:
        return out

    def component(depth: int, kind: int | None = None) -> dict[str, Any]:
        got: dict[str, Any] = {"type": e.rice_in("sao_type", 0, 1, 2) if kind is None else kind}
        got["abs"] = [e.rice((1 << max(min(depth, 10) - 5, 0)) - 1) for _ in range(4)]
        got["sign"] = [bool(e.bypass()) for v in got["abs"] if v] if got["type"] == 1 else []
        if got["type"]:
            got["band" if got["type"] == 1 else "class"] = e.fixed(31 if got["type"] == 1 else 3)
        return got

    if p.sao_luma:
        out["luma"] = component(p.depth_luma)
    if p.sao_chroma and p.chroma:
        out["cb"] = component(p.depth_chroma)
        out["cr"] = component(p.depth_chroma, out["cb"]["type"])
    return out


def prediction_unit(e: Entropy, p: Picture, skipped: bool, width: int = 0, height: int = 0, depth: int = 0) -> dict[str, Any]:
    """The merge list is as long as the coded number plus five."""
    merge_max = p.five_minus_merge + 5
    out: dict[str, Any] = {}
    if not skipped:
        out["merge"] = e.flag("merge_flag")
    if skipped or out["merge"]:
        if merge_max > 1:
            out["merge_idx"] = e.rice_in("merge_idx", 0, 1, merge_max - 1)
        return out
    lists = e.direction(width, height, depth) if p.slice_type == 0 else 0
    if p.slice_type == 0:
        out["direction"] = lists
    for k, used, active in ((0, lists != 1, p.active_l0_minus1), (1, lists in (1, 2), p.active_l1_minus1)):
        if used:
            if active:
                out[f"ref_idx_l{k}"] = e.rice_in("ref_idx", 0, 2, active)
            if not (k and p.mvd_l1_zero and lists == 2):
                out[f"mvd_l{k}"] = motion_difference(e)
            out[f"mvp_l{k}"] = e.flag("mvp_flag")
    return out


def partition_sizes(size: int, mode: int) -> list[tuple[int, int]]:
    """Widths and heights of the prediction blocks of an inter unit by its partitioning."""
    half, quarter, rest = size // 2, size // 4, size - size // 4
    whole = [(size, size)]
    return {
        0: whole, 1: [(size, half)] * 2, 2: [(half, size)] * 2, 3: [(half, half)] * 4, 4: [(size, quarter), (size, rest)], 5: [(size, quarter), (size, rest)],
        6: [(quarter, size), (rest, size)], 7: [(quarter, size), (rest, size)],
    }.get(mode, whole)


def coding_unit(e: Entropy, p: Picture, log2: int, skip_inc: int = 0, depth: int = 0) -> dict[str, Any]:
    """A coding unit without its transform tree; ``transforms`` says if one follows."""
    out: dict[str, Any] = {"part_mode": 0, "transforms": False}
    inter_slice = p.slice_type != 2
    if p.bypass_enabled:
        out["bypass"] = e.flag("cu_transquant_bypass_flag")
    if inter_slice:
        out["skip"] = e.flag("cu_skip_flag", skip_inc)
        if out["skip"]:
            out["units"] = [prediction_unit(e, p, True)]
            return out
        out["intra"] = e.flag("pred_mode_flag")
    intra = out.get("intra", True)
    smallest = log2 == p.min_cb_log2
    if p.palette_enabled and intra and log2 <= p.max_tb_log2:
        out["palette_mode"] = e.flag("palette_mode_flag")
        if out["palette_mode"]:
            out["palette"] = palette(e, p, 1 << log2, out.get("bypass", False))
            return out
    if not intra or smallest:
        out["part_mode"] = e.part_mode(intra, smallest, p.amp)
    if intra and out["part_mode"] == 0 and p.pcm_log2 and p.pcm_log2[0] <= log2 <= p.pcm_log2[1]:
        out["pcm"] = bool(e.terminate())
        if out["pcm"]:
            return out
    if intra:
        n = 4 if out["part_mode"] == 1 else 1
        modes = []
        for _ in range(n):
            known = e.flag("prev_intra_luma_pred_flag")
            modes.append({"previous": known, "mpm": e.rice(2)} if known else {"previous": known, "rem": e.fixed(31)})
        out["luma_modes"] = modes
        out["chroma_modes"] = [e.bits(2) if e.flag("intra_chroma_pred_mode") else 4 for _ in range(n if p.chroma == 3 else min(p.chroma, 1))]
        out["transforms"] = True
    else:
        out["units"] = [prediction_unit(e, p, False, w, h, depth) for w, h in partition_sizes(1 << log2, out["part_mode"])]
        out["transforms"] = True
        if not (out["units"][0].get("merge") and out["part_mode"] == 0):
            out["root_cbf"] = out["transforms"] = e.flag("rqt_root_cbf")
    return out


def palette(e: Entropy, p: Picture, size: int, lossless: bool) -> dict[str, Any]:
    """Palette entries, then all indices, then the runs that spread them over the block, then escaped samples."""
    total, reused, at = size * size, [False] * p.palette_predictor_size, 0
    while at < len(reused) and sum(reused) < p.palette_max_size:
        run = e.golomb(0)
        if run == 1:
            break
        at += max(run - 1, 0)
        if at >= len(reused):
            raise BitstreamError("invalid syntax value", "palette predictor run exceeds predictor list")
        reused[at] = True
        at += 1
    new = e.golomb(0) if sum(reused) < p.palette_max_size else 0
    if sum(reused) + new > p.palette_max_size:
        raise BitstreamError("invalid syntax value", "palette entries exceed palette_max_size")
    depths = [p.depth_luma] if p.chroma == 0 else [p.depth_luma, p.depth_chroma, p.depth_chroma]
    out: dict[str, Any] = {"reused": reused, "new": [[e.palette_value(d, lossless) for _ in range(new)] for d in depths], "escape": False, "indices": [], "transpose": False}
    entries = sum(reused) + new
    waiting, final_copy = 0, False
    if entries:
        out["escape"] = bool(e.bypass())
        waiting = e.palette_count(entries) + 1
        if waiting > total:
            raise BitstreamError("invalid syntax value", "palette index count exceeds coding block")
        for k in range(waiting):
            if entries > min(k, 1):
                index = e.palette_index(entries - min(k, 1))
                if index > entries:
                    raise BitstreamError("invalid syntax value", "palette index exceeds current palette")
                out["indices"].append(index)
        final_copy = e.flag("copy_above_palette_indices_flag")
        out["transpose"] = e.flag("palette_transpose_flag")
    latches = Latches()
    if out["escape"]:
        if p.qp_delta:
            latches.read_qp(e)
        if p.chroma_qp_offset and not lossless:
            latches.read_chroma(e, p.chroma_qp_list)
    out |= {"qp_delta": latches.qp, "chroma_qp": latches.chroma, "runs": []}
    count, scan = waiting, 0
    while scan < total:
        above = False
        if entries and scan >= size and not (out["runs"] and out["runs"][-1]["above"]):
            above = e.flag("copy_above_palette_indices_flag") if waiting and scan < total - 1 else not waiting
        run: dict[str, Any] = {"scan": scan, "above": above}
        if entries and not above:
            place = count - waiting
            run["index"] = out["indices"][place] if place < len(out["indices"]) else 0
            waiting = max(waiting - 1, 0)
        most = max(total - scan - 1 - waiting - final_copy, 0)
        length = most + 1
        if entries and (waiting or above != final_copy):
            length = 1
            if most:
                prefix = e.run_prefix(most, run.get("index", 0), above)
                more = prefix
                if prefix > 1:
                    more = 1 << prefix - 1
                    if most != more:
                        more += e.run_suffix(most, prefix)
                length = max(1, min(more + 1, most + 1))
        run["length"] = length
        out["runs"].append(run)
        scan += length
    if out["escape"]:
        n = sum(r["length"] for r in out["runs"] if r.get("index") == entries)
        out["escaped"] = [[e.palette_value(d, lossless) for _ in range(n)] for d in depths]
    return out


def scan_places(size: int, kind: int) -> list[tuple[int, int]]:
    """(x, y) of a square block in up-right diagonal, horizontal or vertical order."""
    if kind not in (0, 1, 2):
        raise BitstreamError("invalid syntax value", "residual scan index must be zero, one, or two")
    key = (lambda c: (c[0] + c[1], c[0]), lambda c: (c[1], c[0]), lambda c: c)[kind]
    return sorted(((x, y) for x in range(size) for y in range(size)), key=key)


# Contexts of the significance flags of 4x4 blocks, in raster order.
_SIG_4X4 = [0, 1, 4, 5, 2, 3, 4, 5, 6, 6, 8, 8, 7, 7, 8]


def _last_prefix(e: Entropy, name: str, luma: bool, log2: int) -> int:
    if not 2 <= log2 <= 6:
        raise BitstreamError("invalid syntax value", "last coefficient transform size is out of range")
    offset, shift = (3 * (log2 - 2) + (log2 - 1 >> 2), log2 + 1 >> 2) if luma else (15, log2 - 2)
    return e.ones(2 * log2 - 1, lambda k: e.bin(name, offset + (k >> shift)))


def _last_place(prefix: int, suffix: int | None, log2: int) -> int:
    place = prefix if prefix <= 3 else (1 << (prefix >> 1) - 1) * (2 + prefix % 2) + suffix
    if place >= 1 << log2:
        raise BitstreamError("invalid syntax value", "last coefficient coordinate exceeds transform block")
    return place


def _significance_context(luma: bool, log2: int, kind: int, place: tuple[int, int], block: tuple[int, int], coded: dict[tuple[int, int], bool], skips: bool) -> int:
    """The neighbours that count are those of the block of the coordinates inside the 4x4 block, which is the first."""
    x, y = place
    if skips:
        return 42 if luma else 16
    if log2 == 2:
        return _SIG_4X4[4 * y + x] + (0 if luma else 27)
    if place == (0, 0) and block == (0, 0):
        return 0
    near = coded.get((1, 0), False) + 2 * coded.get((0, 1), False)
    inc = ((x + y < 3) + (x + y == 0), (y == 1) + (y == 0), (x == 1) + (x == 0), 2)[near]
    if luma:
        return inc + (21 if log2 > 3 else 9 if kind == 0 else 15)
    return 27 + inc + (9 if log2 == 3 else 12)


def residual(e: Entropy, p: Picture, log2: int, component: int, intra: bool, lossless: bool, mode: int, kind: int, statistics: list[int]) -> dict[str, Any]:
    """The levels of a block, in four phases over all of its 4x4 blocks: which are significant, which exceed one, the
    signs, and what remains."""
    if component > 2 or log2 < 2:
        raise BitstreamError("invalid syntax value", "no such residual block")
    luma = component == 0
    out: dict[str, Any] = {}
    if p.transform_skip and not lossless and log2 <= p.max_skip_log2:
        out["transform_skip"] = e.flag("transform_skip_flag", 0 if luma else 3)
    skips = out.get("transform_skip", False) or lossless
    if not intra and p.explicit_rdpcm and skips:
        out["rdpcm"] = e.flag("explicit_rdpcm_flag", 0 if luma else 2)
        if out["rdpcm"]:
            out["rdpcm_dir"] = e.flag("explicit_rdpcm_dir_flag", 0 if luma else 2)
    prefixes = [_last_prefix(e, f"last_sig_coeff_{axis}_prefix", luma, log2) for axis in "xy"]
    suffixes = [e.fixed((1 << (q >> 1) - 1) - 1) if q > 3 else None for q in prefixes]
    last = tuple(_last_place(q, s, log2) for q, s in zip(prefixes, suffixes, strict=True))
    out["last_read"], out["last"] = last, last if kind != 2 else last[::-1]
    places, squares = scan_places(4, kind), scan_places(1 << log2 - 2, kind)
    end_square = squares.index((out["last"][0] // 4, out["last"][1] // 4))
    end_place = places.index((out["last"][0] % 4, out["last"][1] % 4))

    coded: dict[tuple[int, int], bool] = {}
    blocks: list[list[int]] = []  # scan places of the significant levels, last first
    out |= {"coded_blocks": [], "significant": []}
    for s in range(end_square, -1, -1):
        x, y = square = squares[s]
        between = 0 < s < end_square
        near = min(coded.get((x + 1, y), False) + coded.get((x, y + 1), False), 1)
        coded[square] = e.flag("coded_sub_block_flag", near + (0 if luma else 2)) if between else True
        out["coded_blocks"].append(coded[square])
        found = [end_place] if s == end_square else []
        first_inferred = between
        flags = [True] if s == end_square else []
        for c in range((end_place if s == end_square else 16) - 1, -1, -1):
            inc = _significance_context(luma, log2, kind, places[c], square, coded, p.transform_skip and skips)
            one = coded[square] and (True if c == 0 and first_inferred else e.flag("sig_coeff_flag", inc))
            flags.append(one)
            if one:
                found.append(c)
                first_inferred = False
        out["significant"] += flags
        blocks.append(found)

    greater1: list[list[bool]] = []
    run, before, begun, second = 1, False, False, None  # second: the first level that exceeds one, and its context set
    out["greater1"] = []
    for b, found in enumerate(blocks):
        flags = []
        for k in range(len(found)):
            if k or begun:
                run = 0 if run and before else run + 1 if run else 0
            if not k:
                group = (0 if b == len(blocks) - 1 or not luma else 2) + (begun and run == 0)
                run, begun = 1, True
            inc = group * 4 + min(run, 3) + (0 if luma else 16)
            before = e.flag("coeff_abs_level_greater1_flag", inc)
            flags.append(before)
            if before and second is None:
                second = b, k, inc // 4
        greater1.append(flags)
        out["greater1"] += flags
    if second is not None:
        out["greater2"] = e.flag("coeff_abs_level_greater2_flag", second[2] + (0 if luma else 4))
    if p.bypass_alignment:
        e.align_bypass()

    unhidden = intra and p.implicit_rdpcm and out.get("transform_skip", False) and mode in (10, 26)
    may_hide = p.sign_hiding and not lossless and not unhidden and not out.get("rdpcm", False)
    hides = [may_hide and bool(found) and found[0] - found[-1] > 3 for found in blocks]
    signs = [[None if hide and k == len(found) - 1 else bool(e.bypass()) for k in range(len(found))] for found, hide in zip(blocks, hides, strict=True)]

    kinds, most = 2 * luma + skips, 8 if p.persistent_rice else 4
    depth = p.depth_luma if luma else p.depth_chroma
    out |= {"remaining": [], "levels": [], "places": []}
    seen = 0
    for b, found in enumerate(blocks):
        rice, fresh, total = statistics[kinds] // 4 if p.persistent_rice else 0, True, 0
        for k, place in enumerate(found):
            special = second is not None and second[:2] == (b, k)
            level = 1 + greater1[b][k] + (special and out["greater2"])
            if level == ((3 if special else 2) if seen < 8 else 1):
                rest = e.remaining(min(rice, most), p.extended_precision, max(depth + 6, 15))
                out["remaining"].append(rest)
                if p.persistent_rice and fresh:
                    bound = 1 << statistics[kinds] // 4
                    statistics[kinds] += 1 if rest >= 3 * bound else -1 if 2 * rest < bound and statistics[kinds] else 0
                    fresh = False
                level += rest
                if level > 3 << min(rice, most):
                    rice = min(rice + 1, most)
            seen += 1
            total += level
            negative = signs[b][k] if signs[b][k] is not None else total % 2 == 1
            out["levels"].append(-level if negative else level)
            x, y = squares[end_square - b]
            out["places"].append((4 * x + places[place][0], 4 * y + places[place][1]))
    return out


def transform_tree(e: Entropy, p: Picture, x: int, y: int, log2: int, intra: bool = True, lossless: bool = False, split_intra: bool = False, mode: int = 0, kind: int = 0) -> dict[str, Any]:
    latches = Latches()

    def node(x: int, y: int, log2: int, depth: int, parent: dict[str, bool]) -> dict[str, Any]:
        out: dict[str, Any] = {"x": x, "y": y, "log2": log2, "depth": depth}
        if log2 > p.max_tb_log2:
            out["split"] = True
        else:
            may = log2 > p.min_tb_log2 and depth < p.max_depth and not (split_intra and depth == 0)
            out["split"] = may and e.flag("split_transform_flag", max(5 - log2, 0))
        chroma = log2 > 2 and p.chroma != 0 or p.chroma == 3
        for c in ("cb", "cr"):
            out[f"cbf_{c}"] = []
            if chroma and parent[c]:
                out[f"cbf_{c}"].append(e.flag("cbf_chroma", depth))
                if p.chroma == 2 and (not out["split"] or log2 == 3):
                    out[f"cbf_{c}"].append(e.flag("cbf_chroma", 12 + depth))
        any_chroma = any(out["cbf_cb"] + out["cbf_cr"])
        if out["split"]:
            half, below = 1 << log2 - 1, {c: bool(out[f"cbf_{c}"]) and out[f"cbf_{c}"][0] for c in ("cb", "cr")}
            out["children"] = [node(x + dx * half, y + dy * half, log2 - 1, depth + 1, below) for dy in (0, 1) for dx in (0, 1)]
            return out
        if intra or depth or any_chroma:
            out["cbf_luma"] = e.flag("cbf_luma", int(depth != 0))
        if out.get("cbf_luma") or any_chroma:
            out["unit"] = unit(log2, out.get("cbf_luma", False), out["cbf_cb"], out["cbf_cr"])
        return out

    def unit(log2: int, luma: bool, cb: list[bool], cr: list[bool]) -> dict[str, Any]:
        """The quantiser's change is always read, the chroma offset whenever chroma is coded; chroma blocks are read
        with the size of the luma block."""
        out: dict[str, Any] = {}
        any_chroma = any(cb + cr)
        if p.colour_transform:
            out["act"] = e.flag("tu_residual_act_flag")
        latches.read_qp(e)
        if any_chroma and not lossless:
            latches.read_chroma(e, 0)
        block = lambda component: residual(e, p, log2, component, intra, lossless, mode, kind, latches.statistics)
        if luma:
            out["luma"] = block(0)
        crosses = p.cross_component and luma and any_chroma
        out["cross"] = []
        for component, name, flags in ((1, "cb", cb), (2, "cr", cr)):
            if crosses:
                out["cross"].append(cross_component(e))
            out[name] = [block(component) for f in flags if f]
        return out | {"qp_delta": latches.qp, "chroma_qp": latches.chroma}

    return node(x, y, log2, 0, {"cb": True, "cr": True})


class Neighbours:
    """Depth and skipping of the blocks read so far, by the smallest coding block: what contexts look up."""

    def __init__(self, p: Picture) -> None:
        self.p, self.cells = p, {}
        self.ctu, self.left, self.up = (0, 0), False, False

    def enter(self, x: int, y: int, left: bool, up: bool) -> None:
        self.ctu, self.left, self.up = (x, y), left, up

    def look(self, x: int, y: int) -> list[tuple[int, bool]]:
        """The blocks to the left of and above a place that count."""
        out = []
        for nx, ny, outside, known in ((x - 1, y, x - 1 < self.ctu[0], self.left), (x, y - 1, y - 1 < self.ctu[1], self.up)):
            if nx >= 0 and ny >= 0 and (known or not outside):
                cell = self.cells.get((nx >> self.p.min_cb_log2, ny >> self.p.min_cb_log2))
                if cell is not None:
                    out.append(cell)
        return out

    def record(self, x: int, y: int, size: int, depth: int, skip: bool) -> None:
        for cy in range(y >> self.p.min_cb_log2, (y + size - 1 >> self.p.min_cb_log2) + 1):
            for cx in range(x >> self.p.min_cb_log2, (x + size - 1 >> self.p.min_cb_log2) + 1):
                self.cells[cx, cy] = depth, skip


def coding_tree(e: Entropy, p: Picture, x: int, y: int, log2: int, near: Neighbours | None = None, depth: int = 0, shape_only: bool = False) -> dict[str, Any]:
    """A coding tree. A block that reaches over the picture's edge isn't split unless it says so, which it can't."""
    near = near or Neighbours(p)
    size = 1 << log2
    out: dict[str, Any] = {"x": x, "y": y, "log2": log2, "depth": depth, "split": False}
    if x + size <= p.width and y + size <= p.height and log2 > p.min_cb_log2:
        inc = 0 if shape_only else sum(d > depth for d, _ in near.look(x, y))
        out["split"] = e.flag("split_cu_flag", inc)
    if out["split"]:
        half = size // 2
        inside = [(x + dx * half, y + dy * half) for dy in (0, 1) for dx in (0, 1)]
        out["children"] = [coding_tree(e, p, cx, cy, log2 - 1, near, depth + 1, shape_only) for cx, cy in inside if cx < p.width and cy < p.height]
        return out
    if shape_only:
        return out
    skip_inc = sum(s for _, s in near.look(x, y)) if p.slice_type != 2 else 0
    cu = out["unit"] = coding_unit(e, p, log2, skip_inc, depth)
    if cu["transforms"] and p.transforms:
        intra = cu.get("intra", True)
        split = intra and cu["part_mode"] == 1
        out["transform"] = transform_tree(e, p, x, y, log2 - split, intra, cu.get("bypass", False), split)
    near.record(x, y, size, depth, cu.get("skip", False))
    return out


def _at(values: tuple[int, ...], k: int, message: str) -> int:
    if not 0 <= k < len(values):
        raise BitstreamError("invalid syntax value", message)
    return values[k]


def slice_data(e: Entropy, p: Picture) -> dict[str, Any]:
    """All coding-tree units of a slice segment in tile scan, with the restarts between tiles and block rows."""
    near, units, ts, boundaries = Neighbours(p), [], p.start, 0
    tile = lambda rs: _at(p.tile_ids, _at(p.rs_to_ts, rs, "raster-to-tile mapping is incomplete"), "tile map is incomplete")
    while True:
        rs = _at(p.ts_to_rs, ts, "tile-scan mapping is incomplete")
        cx, cy = rs % p.columns, rs // p.columns
        here = _at(p.tile_ids, ts, "tile map is incomplete")
        left = cx > 0 and rs > p.slice_address and tile(rs - 1) == here
        up = cy > 0 and rs - p.columns >= p.slice_address and tile(rs - p.columns) == here
        unit: dict[str, Any] = {"addr_ts": ts, "addr_rs": rs}
        if p.sao_luma or p.sao_chroma:
            unit["sao"] = sample_offsets(e, p, left, up)
        near.enter(cx << p.ctb_log2, cy << p.ctb_log2, left, up)
        unit["tree"] = coding_tree(e, p, cx << p.ctb_log2, cy << p.ctb_log2, p.ctb_log2, near)
        if p.wavefront and (cx == 1 or rs > 1 and here != tile(rs - 2)):
            e.store()
        unit["end"] = bool(e.terminate())
        units.append(unit)
        if unit["end"]:
            return {"units": units, "boundaries": boundaries}
        ts += 1
        rs = _at(p.ts_to_rs, ts, "slice segment has no following CTU")
        there = _at(p.tile_ids, ts, "tile map is incomplete")
        new_tile = p.tiles and there != here
        if new_tile or p.wavefront and (rs % p.columns == 0 or tile(max(rs - 1, 0)) != there):
            if not e.terminate():
                raise BitstreamError("invalid syntax value", "end_of_subset_one_bit must equal one")
            e.align()
            above = rs - p.columns
            if new_tile or above < p.slice_address or tile(above) != there or not e.synchronize():
                e.reset()
            if boundaries < len(p.entry_points):
                e.substream(*p.entry_points[boundaries])
            e.restart()
            boundaries += 1


def rows_of_tree(tree: dict[str, Any], path: tuple[int, ...] = ()) -> Iterator[dict[str, Any]]:
    """The nodes of a tree as flat rows, parents first, each with its path of child numbers."""
    yield {k: v for k, v in tree.items() if k not in ("children", "transform", "unit")} | {"path": list(path), "leaf": "children" not in tree}
    for k, child in enumerate(tree.get("children", ())):
        yield from rows_of_tree(child, (*path, k))


def dense_levels(block: dict[str, Any], log2: int) -> list[int]:
    """The levels in raster order. Places inside a 4x4 block are taken from the diagonal scan of the whole block, which
    is another one for larger blocks; a level that this puts outside is an error."""
    size = 1 << log2
    out = [0] * (size * size)
    if not block["levels"]:
        return out
    order, squares = scan_places(size, 0), scan_places(size // 4, 0)
    x, y = block["last_read"]
    end_square, end_place = squares.index((x // 4, y // 4)), order.index((x % 4, y % 4))
    flags, levels = iter(block["significant"]), iter(block["levels"])
    for k in range(len(block["coded_blocks"])):
        s = max(end_square - k, 0)
        for c in range(end_place if s == end_square else 15, -1, -1):
            if next(flags, False):
                at = (4 * squares[s][1] + order[c][1]) * size + 4 * squares[s][0] + order[c][0]
                if at >= len(out):
                    raise BitstreamError("invalid syntax value", "coefficient lies outside its block")
                out[at] = next(levels)
    return out


def palette_samples(entries: list[list[int]], runs: list[dict[str, Any]], escaped: list[list[int]], width: int, height: int, transpose: bool, depth: int) -> list[list[int]]:
    """The component planes of a palette block, in raster order."""
    n = max(len(entries), 1)
    planes, indices, taken = [[0] * (width * height) for _ in range(n)], [-1] * (width * height), 0
    known = len(entries[0]) if entries else 0
    for run in runs:
        for at in range(run["scan"], min(run["scan"] + run["length"], width * height)):
            index = indices[at] = indices[at - width] if run["above"] and at >= width else run.get("index", 0)
            x, y = at % width, at // width
            if transpose:
                x, y = min(y, width - 1), min(x, height - 1)
            escape = not 0 <= index < known
            for c in range(n):
                if escape:
                    value = escaped[c][taken] if c < len(escaped) and taken < len(escaped[c]) else 0
                    planes[c][y * width + x] = max(0, min((1 << depth) - 1, value))
                else:
                    planes[c][y * width + x] = entries[c][index] if index < len(entries[c]) else 0
            taken += escape
    return planes
