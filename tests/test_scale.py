"""What must not grow with the input: broadcasts, and what Python workers hold at a time."""

from __future__ import annotations

import json

import pyarrow as pa

from bitquarry.operators.decode import decoded_pictures, e10_arithmetic_bins, intra_stream
from bitquarry.operators.readers import _mapped, b14_decoded_bins
from bitquarry.operators.reconstruct import er12_intra_pictures
from bitquarry.runtime import PIECE_ROWS, pieces
from bitquarry.sources.bits import BitReader, unescape
from bitquarry.sources.bitstream import _fields, as_of, fields_of, nal_units, parse_units, split_stream
from bitquarry.sources.model import Standard, context_count
from bitquarry.sources.syntax import parse_payload


def test_sets_are_not_broadcast(spark):
    rows = spark.createDataFrame([(s, k, s % 2) for s in range(40) for k in range(2, 5)], "stream_id long, nal_idx long, pps_id long")
    sets = spark.createDataFrame([(s, 0, s % 2, "x" * 50) for s in range(39)], "stream_id long, nal_idx long, pps_id long, pps string")
    got = as_of(rows, sets, "pps_id", "pps")
    assert {(r["stream_id"], r["pps"]) for r in got.collect()} == {(s, "x" * 50 if s < 39 else None) for s in range(40)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_slice_makes_only_the_contexts_that_it_uses():
    a = Standard(BitReader(bytes(8)), 0, 26)
    assert not a.contexts[""] and not a.synchronize()
    a.bin("split_cu_flag", 1)
    a.store()
    moved = {k: (c.state, c.mps) for k, c in a.contexts[""].items()}
    assert len(moved) == 1 < context_count()
    a.bin("split_cu_flag", 1)
    a.bin("cu_qp_delta_abs", 0)
    assert a.synchronize() and {k: (c.state, c.mps) for k, c in a.contexts[""].items()} == moved
    a.reset()
    assert not a.contexts[""] and not a.synchronize()


def test_sets_in_common_are_parsed_once():
    _fields.cache_clear()
    sps = unescape(split_stream(intra_stream(3))[0][2:])
    assert json.loads(fields_of(33, sps)) == parse_payload(33, sps)
    assert fields_of(33, sps) is fields_of(33, bytes(sps)) and _fields.cache_info().misses == 1
    assert fields_of(1, sps) is None and _fields.cache_info().currsize == 1


def test_python_works_on_pieces():
    small, large = pa.record_batch({"x": list(range(5000))}), pa.record_batch({"x": [bytes(1 << 18)] * 20})
    got = list(pieces([small, large, small.slice(0, 0)]))
    assert pa.Table.from_batches([g for g in got if g.num_rows <= PIECE_ROWS and g.schema == small.schema]).column("x").to_pylist() == list(range(5000))
    assert [g.num_rows for g in got if g.schema != small.schema] == [3] * 6 + [2]
    # what a reader gives back comes in pieces, too, not as one batch for 5000 rows
    run = _mapped(lambda row: row, ["x"], small.schema)
    assert max(b.num_rows for b in run(iter([small]))) <= PIECE_ROWS


def test_rows_are_dealt_to_all_cores_before_python(spark):
    for query, name in ((e10_arithmetic_bins, "e10"), (er12_intra_pictures, "er12"), (b14_decoded_bins, "b14")):
        assert query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1, name


def test_slices_are_decoded_once(spark):
    units = spark.createDataFrame([(3, intra_stream(3)), (4, intra_stream(4)[:70])], "stream_id long, payload binary")
    got = decoded_pictures(parse_units(nal_units(units)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sum("MapInArrow run(" in line and "trees" in line for line in plan.splitlines()) == 1
    rows = got.orderBy("nal_idx").collect()
    assert [r["poc"] for r in rows if r["stream_id"] == 3] == [0, 3, 6, 9]
    assert all((r["poc"] is None) == (r["error"] is not None) for r in rows)
