"""Coded streams made from rows: parameter sets, messages and slice headers with fields given by the row's key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..runtime import dealt, pieces, ship
from .bits import BitWriter, escape
from .tables import table


def _unit(kind: int, payload: bytes) -> bytes:
    return (kind << 9 | 1).to_bytes(2, "big") + escape(payload)


def _profile(w: BitWriter, idc: int, level: int) -> BitWriter:
    w.u(2, 0).u(1, 0).u(5, idc)
    for k in range(32):
        w.u(1, k == idc)
    return w.u(4, 0b1001).u(43, 0).u(1, 0).u(8, level)


def vps(key: int) -> bytes:
    w = BitWriter().u(4, key % 16).u(2, 3).u(6, 0).u(3, 0).u(1, 1).u(16, 0xFFFF)
    _profile(w, 1 + key % 3, 93)
    return w.u(1, 1).ue(key % 5).ue(0).ue(0).u(6, 0).ue(0).u(1, 0).u(1, 0).trailing().bytes()


def sps(key: int, width: int, height: int) -> bytes:
    w = BitWriter().u(4, key % 16).u(3, 0).u(1, 1)
    _profile(w, 1 + key % 3, 30 + key % 90).ue(key % 4).ue(1).ue(width).ue(height).u(1, key % 2)
    if key % 2:
        for k in range(4):
            w.ue(k)
    w.ue(0).ue(0).ue(4).u(1, 1).ue(key % 5).ue(0).ue(0).ue(0).ue(1 + key % 3).ue(0).ue(2).ue(1).ue(1)
    w.u(1, 0).u(1, 0).u(1, 1).u(1, 0)  # scaling lists, partitions, offsets, PCM
    w.ue(1).ue(2).ue(1).ue(0).u(1, 1).ue(1).u(1, key % 2).ue(key % 7).u(1, 1)  # one set of two earlier and one later picture
    return w.u(1, 0).u(1, 0).u(1, 0).u(1, 0).u(1, 0).trailing().bytes()


def pps(key: int, columns: int, rows: int) -> bytes:
    tiles = columns * rows > 1
    w = BitWriter().ue(key % 8).ue(key % 4).u(2, 0).u(3, 0).u(2, 0).ue(0).ue(0).se(key % 11 - 5).u(2, 0).u(1, key % 2)
    if key % 2:
        w.ue(key % 3)
    w.se(key % 7 - 3).se(3 - key % 7).u(1, 1).u(3, 0).u(1, tiles).u(1, 0)
    if tiles:
        w.ue(columns - 1).ue(rows - 1).u(1, 1).u(1, 1)
    return w.u(1, 0).u(1, 0).u(1, 0).u(1, 0).ue(0).u(1, 0).u(1, 0).trailing().bytes()


def slice_payload(key: int, number: int, tiles: bool) -> bytes:
    """The header of an intra slice that is the whole picture, and a byte of data."""
    w = BitWriter().u(1, 1).ue(key % 8).ue(2).u(8, number % 256).u(1, 1).u(1, 1).u(1, 0).se(number % 9 - 4).se(1).se(-1)
    if tiles:
        w.ue(0)
    return w.trailing().u(8, 0x80).bytes()


def stream(key: int, size: int) -> bytes:
    columns, rows, n = 1 + key % 3, 1 + key % 2, 1 + key % 4
    units = [
        _unit(32, vps(key)),
        _unit(33, sps(key, 8 * size, 8 * (1 + key % 40))),
        _unit(35, BitWriter().u(3, key % 3).trailing().bytes()),
        _unit(34, pps(key, columns, rows)),
        _unit(39, bytes([key % 200, 3, 1, 0, 0, 0x80])),
        *(_unit(1, slice_payload(key, key + k, columns * rows > 1)) for k in range(n)),
        _unit(38, b"\xff" * (key % 5) + b"\x80"),
        _unit(36, b""),
        bytes([0x40, 0x00]),  # a unit whose header is wrong
    ]
    return b"".join(b"\0" * (1 + (key + k) % 2) + b"\0\1" + u if (key + k) % 2 else b"\0\0\1" + u for k, u in enumerate(units))


def part_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coded stream for every part: (stream_id, payload)."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keys, sizes = batch.column("p_partkey").to_pylist(), batch.column("p_size").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([stream(k, s) for k, s in zip(keys, sizes, strict=True)], pa.binary())], names=["stream_id", "payload"])

    # keys are small and streams are not: deal the keys out before the streams are made
    keys = dealt(table(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    return keys.mapInArrow(run, "stream_id long, payload binary")
