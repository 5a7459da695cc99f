from __future__ import annotations

import pytest

from bitquarry.operators.entropy import init_type, initial_state
from bitquarry.sources.bits import BitReader, BitstreamError, encode_bins
from bitquarry.sources.entropy import Arithmetic, Context, Entropy
from pyspark.sql import functions as F

#: Ranges of a made-up model: the engine takes any.
RANGES = [[128 - s] * 4 for s in range(64)]
AFTER = [max(0, s - 1) for s in range(64)]


def test_states(spark):
    rows = spark.createDataFrame([(0x00, 22), (0xFF, 22)], "v long, qp long")
    assert [tuple(r) for r in rows.select(*initial_state(F.col("v"), F.col("qp"))).collect()] == [(62, 0), (62, 1)]
    kinds = spark.createDataFrame([(k, f) for k in range(4) for f in (False, True)], "k long, f boolean")
    assert [r[0] for r in kinds.select(init_type(F.col("k"), F.col("f"))).collect()] == [2, 1, 1, 2, 0, 0, None, None]


def test_decoder():
    initial = {"x": [0x00, 154]}
    zeros = Arithmetic(BitReader(b"\0" * 8), RANGES, AFTER, initial)
    zeros.contexts["x"][0] = context = Context(0, 0)
    assert (zeros.bin("x", 0), zeros.bypass(), zeros.terminate()) == (0, 0, 0) and context.state == 1
    high = Arithmetic(BitReader(b"\xfe\0\0\0"), RANGES, AFTER)
    context = Context(0, 0)
    assert high.decision(context) == 1 and context.mps == 1
    ones = Arithmetic(BitReader(b"\xfe\x7f\xff\xff"), RANGES, AFTER)
    assert ones.terminate() == 1 and ones.ended
    with pytest.raises(BitstreamError):
        Arithmetic(BitReader(b"\xff\x80"), RANGES, AFTER)
    with pytest.raises(BitstreamError, match="context"):
        zeros.bin("y", 0)


def test_contexts_are_kept_and_restored():
    a = Arithmetic(BitReader(b"\0" * 20), RANGES, AFTER, {"x": [154]})
    assert not a.synchronize()
    before = a.contexts["x"][0].state
    a.bin("x", 0)
    a.store()
    moved = a.contexts["x"][0].state
    a.bin("x", 0)
    assert a.synchronize() and a.contexts["x"][0].state == moved != before
    a.reset()
    assert a.contexts["x"][0].state == before and not a.synchronize()


class Bins(Entropy):
    """Bins from a string, contexts and bypass alike."""

    def __init__(self, text):
        self.text = list(text)[::-1]

    def bin(self, name, inc):
        return int(self.text.pop())

    def bypass(self):
        return int(self.text.pop())


def test_binarizations_read_what_was_encoded():
    for value in range(32):
        assert Bins(encode_bins(value, "FL", c_max=31)).fixed(31) == value
        assert Bins(encode_bins(value, "TB", c_max=36)).truncated(36) == value
        assert Bins(encode_bins(value, "TR", c_max=32, rice=2)).rice(32, 2) == value
        assert Bins(encode_bins(value, "TR", c_max=31)).rice_in("x", 0, 3, 31) == value
        assert Bins(encode_bins(value, "EG", order=1)).golomb(1) == value
        assert Bins(encode_bins(value, "LEG", rice=1, log2_range=15)).limited_golomb(1, 15) == value
    assert [Bins(t).part_mode(False, False, True) for t in ("1", "011", "0100", "0101", "001", "0001", "00000", "00001")] == [0, 1, 4, 5, 2, 3, 6, 7]
    assert [Bins(t).part_mode(False, True, False) for t in ("01", "00")] == [1, 2] and [Bins(t).part_mode(True, True, False) for t in "10"] == [0, 1]
    assert [Bins(t).direction(8, 8, 1) for t in ("1", "00", "01")] == [2, 0, 1] and [Bins(t).direction(8, 4, 1) for t in "01"] == [0, 2]
    assert [Bins(t).qp_delta() for t in ("0", "11110", "111110", "11111100")] == [0, 4, 5, 6]
    assert [Bins(t).remaining(1, False, 15) for t in ("00", "101", "11100", "111011")] [0] == 0 and Bins("1101").remaining(1, False, 15) == 5
