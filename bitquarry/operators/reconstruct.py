"""Intra pictures from parsed slice data: prediction from what is decoded already, plus the transformed residual.

A block needs the samples of the blocks before it, so a picture is one task; pictures are independent of each other.
The kernels are those of ``blocks`` in numpy, block by block.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import dealt, pieces, ship
from ..sources.bits import BitstreamError
from ..sources.entropy import Scripted
from ..sources.slicedata import Picture, dense_levels, slice_data
from ..sources.tables import table
from .blocks import ANGLES, INTRA_4X4, LEVEL_SCALE, MODE_422, cosine_matrix
from .geometry import SUB_HEIGHT, SUB_WIDTH


def luma_mode(a: int, b: int, known: bool, mpm: int, rem: int) -> int:
    """The mode of a block from those of its neighbours, as one of three candidates or as what remains."""
    a, b = (m if m <= 34 else 1 for m in (a, b))
    if a != b:
        third = next(m for m in (0, 1, 26) if m not in (a, b))
        candidates = [a, b, third]
    else:
        candidates = [0, 1, 26] if a < 2 else [a, 2 + (a + 29) % 32, 2 + (a - 1) % 32]
    if known:
        return candidates[min(mpm, 2)]
    mode = min(rem, 31)
    for c in sorted(candidates):
        mode += mode >= c
    return min(mode, 34)


def chroma_mode(coded: int, luma: int, wide: bool = False) -> int:
    """Four fixed modes, the last angular one where luma has the same, and luma's own."""
    mode = luma
    if coded < 4:
        mode = (0, 26, 10, 1)[coded]
        mode = 34 if mode == luma else mode
    return MODE_422[mode] if wide else mode


def predict(plane: np.ndarray, x: int, y: int, w: int, h: int, mode: int, depth: int) -> np.ndarray:
    """The prediction of a block from its neighbours, whose coordinates are clamped to the plane."""
    rows, columns = plane.shape
    n = 2 * max(w, h) + 1
    over, beside = np.clip(y - 1, 0, rows - 1), np.clip(x - 1, 0, columns - 1)
    top = plane[over, np.clip(np.arange(x, x + n), 0, columns - 1)]
    left = plane[np.clip(np.arange(y, y + n), 0, rows - 1), beside]
    corner = plane[over, beside]
    i, j = np.arange(w), np.arange(h)[:, None]
    if mode == 0:
        total = (w - 1 - i) * left[:h, None] + (i + 1) * top[w] + (h - 1 - j) * top[:w] + (j + 1) * left[h]
        return (total + max(w, h)) // (2 * max(w, h))
    if mode == 1:
        return np.full((h, w), (top[:w].sum() + left[:h].sum() + (w + h) // 2) // (w + h))
    along, source = (j, top) if mode >= 18 else (i, left)
    move = (along + 1) * ANGLES[mode]
    first, part = (move >> 5) + along, move & 31

    def at(k: np.ndarray) -> np.ndarray:
        return np.where(k < 0, corner, source[np.clip(k, 0, n - 1)])

    out = np.broadcast_to(np.where(part == 0, at(first), (32 - part) * at(first) + part * at(first + 1) + 16 >> 5), (h, w))
    out = np.clip(out, 0, (1 << depth) - 1)
    if w == h < 32 and mode in (10, 26):
        half = lambda v: np.where(v < 0, -(-v // 2), v // 2)  # noqa: E731  towards zero
        if mode == 26:
            out[:, 0] = np.clip(top[0] + half(left[:h] - corner), 0, (1 << depth) - 1)
        else:
            out[0] = np.clip(left[0] + half(top[:w] - corner), 0, (1 << depth) - 1)
    return out


def dequantise(levels: np.ndarray, qp: int, depth: int) -> np.ndarray:
    size = levels.shape[0]
    span = max(depth + 6, 15)
    shift = max(depth + size.bit_length() - 1 + 10 - span, 0)
    value = levels.astype(np.int64) * 16 * LEVEL_SCALE[qp % 6] << max(qp, 0) // 6
    value = value + (1 << shift - 1 if shift else 0) >> shift
    return np.clip(value, -(1 << span - 1), (1 << span - 1) - 1)


@lru_cache(maxsize=16)
def _matrix(size: int, four: bool) -> np.ndarray:
    return np.array(INTRA_4X4 if four and size == 4 else cosine_matrix(size), np.int64)


def transform(values: np.ndarray, depth: int, four: bool) -> np.ndarray:
    m = _matrix(len(values), four)
    limit = 1 << min(max(depth + 6, 1), 30)
    return np.clip(m @ values @ m.T, -limit, limit - 1)


def reconstruct(p: Picture, data: dict[str, Any], qp: int) -> list[np.ndarray]:
    """The planes of an intra picture from the units of a slice; samples that nothing covers are 0."""
    sub = (SUB_WIDTH[p.chroma], SUB_HEIGHT[p.chroma])
    planes = [np.zeros((p.height, p.width), np.int64)]
    if p.chroma:
        planes += [np.zeros((-(-p.height // sub[1]), -(-p.width // sub[0])), np.int64) for _ in range(2)]

    def block(component: int, x: int, y: int, w: int, h: int, mode: int, levels: list[int] | None, own_qp: int, lossless: bool, four: bool) -> None:
        plane, depth = planes[component], p.depth_chroma if component else p.depth_luma
        if w != h:
            raise BitstreamError("unsupported", "chroma blocks that aren't square")
        coded = dequantise(np.array(levels if levels is not None else [0] * (w * h)).reshape(h, w), own_qp, depth)
        extra = coded if lossless else transform(coded, depth, four)
        out = np.clip(predict(plane, x, y, w, h, mode, depth) + extra, 0, (1 << depth) - 1)
        plane[y : y + h, x : x + w] = out[: plane.shape[0] - y, : plane.shape[1] - x]

    def walk(node: dict[str, Any], modes: tuple[int, int], lossless: bool) -> None:
        for child in node.get("children", ()):
            walk(child, modes, lossless)
        if "children" in node:
            return
        unit, size = node.get("unit", {}), 1 << node["log2"]
        own_qp = qp + (unit.get("qp_delta") or 0)
        levels = dense_levels(unit["luma"], node["log2"]) if "luma" in unit else None
        block(0, node["x"], node["y"], size, size, modes[0], levels, own_qp, lossless, node["log2"] == 2)
        if p.chroma and size >= max(sub):
            for component, name in ((1, "cb"), (2, "cr")):
                coded = unit.get(name) or [None]
                levels = dense_levels(coded[0], node["log2"] - 1) if coded[0] else None
                block(component, node["x"] // sub[0], node["y"] // sub[1], size // sub[0], size // sub[1], modes[1], levels, own_qp, lossless, False)

    def trees(node: dict[str, Any]) -> None:
        for child in node.get("children", ()):
            trees(child)
        if "unit" not in node or "children" in node:
            return
        unit = node["unit"]
        if "luma_modes" not in unit:
            raise BitstreamError("invalid syntax value", "I slice contains non-intra CU")
        first = unit["luma_modes"][0]
        luma = luma_mode(1, 1, first["previous"], first.get("mpm", 0), first.get("rem", 0))
        chroma = chroma_mode(unit["chroma_modes"][0], luma) if unit["chroma_modes"] else luma
        if "transform" in node:
            walk(node["transform"], (luma, chroma), unit.get("bypass", False))

    for unit in data["units"]:
        trees(unit["tree"])
    return planes


@lru_cache(maxsize=64)
def _picture(options: str) -> Picture:
    return Picture(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(options).items()})


def pictures(streams: DataFrame) -> DataFrame:
    """(stream_id, component, width, height, samples, error) of rows (stream_id, picture, values, qp).

    ``picture`` is the JSON of what the slice is read with, ``values`` the syntax elements in coded order. Slices that
    can't be read or reconstructed are one row with an error.
    """
    ship(streams.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows: list[tuple] = []
            for stream, options, values, qp in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "picture", "values", "qp")), strict=True):
                try:
                    p = _picture(options)
                    for component, plane in enumerate(reconstruct(p, slice_data(Scripted(values), p), qp)):
                        rows.append((stream, component, plane.shape[1], plane.shape[0], plane.reshape(-1).tolist(), None))
                except BitstreamError as e:
                    rows.append((stream, None, None, None, None, str(e)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["stream_id", "component", "width", "height", "samples", "error"])

    return streams.mapInArrow(run, "stream_id long, component long, width long, height long, samples array<long>, error string")


def er12_intra_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as monochrome pictures of 8x8 samples: one unit, predicted by a coded mode, and a level in its corner."""
    p = dealt(table(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    options = F.lit(json.dumps({"width": 8, "height": 8, "ctb_log2": 3, "min_cb_log2": 3, "chroma": 0, "min_tb_log2": 3, "max_tb_log2": 3}))
    k = F.col("p_partkey")
    # whole unit, a coded mode; a luma residual; no change of the quantiser; last level at the corner, sign, no rest
    head = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), k % 32, F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    tail = F.array(F.lit(0).cast("long"), (k % 2).cast("long"), F.lit(1).cast("long"))
    made = pictures(p.select(k.alias("stream_id"), options.alias("picture"), F.concat(head, tail).alias("values"), (F.lit(20) + F.col("p_size") % 30).cast("long").alias("qp")))
    return made.select("stream_id", "component", F.array_join(F.transform("samples", lambda s: s.cast("string")), ",").alias("samples"), "error")


QUERIES = {"er12_intra_pictures": er12_intra_pictures}
#: The prediction from samples that are 0 is 0 in every mode, and a level in the corner moves all samples by as much.
ORACLE = {
    "er12_intra_pictures": """SELECT p_partkey AS stream_id, 0::BIGINT AS component, array_to_string(list_transform(range(64), lambda i: CASE WHEN p_partkey % 2 = 0 THEN 255 ELSE 0 END), ',') AS samples, CAST(NULL AS VARCHAR) AS error FROM part""",
}
