from __future__ import annotations

import random

import pytest

from bitquarry.sources.bits import BitReader, BitstreamError, BitWriter, code_of_signed, decode_bins, dropped_before, encode_bins, escape, signed_of_code, unescape


def bits(text):
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_fixed_codes():
    r = BitReader(bytes([0b10111010]))
    assert r.u(4) == 11 and r.i(4) == -6 and r.left == 0
    with pytest.raises(BitstreamError, match="unexpected end"):
        r.u(1)
    assert BitReader(b"\x80").peek(12, beyond=True) == 0x800


def test_exp_golomb_codes():
    r = BitReader(bits("10100110"))
    assert [r.ue() for _ in range(3)] == [0, 1, 2]
    r = BitReader(bits("101001100100"))
    assert [r.se() for _ in range(4)] == [0, 1, -1, 2]
    with pytest.raises(BitstreamError, match="overflow"):
        BitReader(b"\0" * 9).ue()
    w = BitWriter()
    values = [0, 1, 5, 255, 2**32, 2**63 - 2]
    for v in values:
        w.ue(v)
    r = BitReader(w.bytes())
    assert [r.ue() for _ in values] == values
    assert [signed_of_code(k) for k in range(7)] == [0, 1, -1, 2, -2, 3, -3] and [code_of_signed(signed_of_code(k)) for k in range(50)] == list(range(50))


def test_descriptors():
    assert BitReader(b"ok\0").read("st") == "ok" and BitReader(b"\xc0").read("u(3)") == 6 and BitReader(b"\x41").read("b") == 0x41
    with pytest.raises(BitstreamError, match="arithmetic"):
        BitReader(b"").read("ae")
    r = BitReader(b"a\0")
    r.u(1)
    with pytest.raises(BitstreamError, match="aligned"):
        r.read("st")
    with pytest.raises(BitstreamError, match="terminator"):
        BitReader(b"ab").st()
    with pytest.raises(BitstreamError, match="utf-8"):
        BitReader(b"\xff\0").st()


def test_trailing_bits():
    assert not BitReader(b"\x80").more_data()
    r = BitReader(bytes([0b10110000]))
    assert r.more_data()
    r.u(3)
    assert not r.more_data()
    r.trailing()
    assert r.left == 0
    with pytest.raises(BitstreamError, match="alignment bit"):
        BitReader(b"\0").trailing()
    with pytest.raises(BitstreamError, match="alignment zero"):
        BitReader(b"\xc0").trailing()


def test_escaping():
    assert unescape(bytes([0, 0, 3, 1, 2])) == bytes([0, 0, 1, 2])
    rng = random.Random(1)
    for _ in range(500):
        raw = bytes(rng.choice([0, 0, 0, 1, 2, 3, 4]) for _ in range(rng.randrange(0, 30)))
        coded = escape(raw)
        assert unescape(coded) == raw and not any(p in coded for p in (b"\0\0\0", b"\0\0\1", b"\0\0\2"))
        kept, zeros = bytearray(), 0
        for byte in raw:  # byte after byte
            if zeros >= 2 and byte == 3:
                zeros = 0
                continue
            kept.append(byte)
            zeros = zeros + 1 if byte == 0 else 0
        assert unescape(raw) == bytes(kept)
        assert dropped_before(coded, len(coded)) == len(coded) - len(raw)


SCHEMES = [dict(scheme="FL", c_max=31), dict(scheme="TB", c_max=36), dict(scheme="TR", c_max=31, rice=0), dict(scheme="TR", c_max=32, rice=2), dict(scheme="EG", order=0), dict(scheme="EG", order=3), dict(scheme="LEG", rice=1, log2_range=15)]


@pytest.mark.parametrize("scheme", SCHEMES)
def test_bin_strings_round_trip(scheme):
    seen = set()
    for value in range(32):
        bins = encode_bins(value, **scheme)
        assert decode_bins(bins, **scheme) == value
        seen.add(bins)
        with pytest.raises(BitstreamError):
            decode_bins(bins + "0" * 40, **scheme)
    assert len(seen) == 32
    assert not any(a != b and b.startswith(a) for a in seen for b in seen)


def test_bin_strings_reject_what_is_too_large():
    for scheme in SCHEMES[:4]:
        with pytest.raises(BitstreamError):
            encode_bins(40, **scheme)
    with pytest.raises(BitstreamError):
        decode_bins("11111", "FL", c_max=30)
    with pytest.raises(BitstreamError):
        decode_bins("111", "EG")


def test_substreams_of_a_slice():
    from bitquarry.sources.bitstream import substreams

    rng = random.Random(3)
    for _ in range(200):
        raw = bytes(rng.choice([0, 0, 1, 3, 7]) for _ in range(40))
        coded = escape(raw)
        start = rng.randrange(0, 5)
        at = next(k for k in range(len(coded) + 1) if k - dropped_before(coded, k) == start)
        lengths = [rng.randrange(1, 6) for _ in range(3)]
        got = substreams(coded, start, [n - 1 for n in lengths])
        assert got[0][0] == 0 and got[-1][1] == len(raw) - start
        assert all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
        for n, (lo, hi) in zip(lengths, got, strict=False):
            assert hi - lo == n - (dropped_before(coded, at + n) - dropped_before(coded, at))
            at += n
    with pytest.raises(BitstreamError):
        substreams(b"abc", 0, [9])
    with pytest.raises(BitstreamError):
        substreams(b"abc", 7, [])


def test_a_bin_behind_the_largest_rice_code_is_an_error():
    assert decode_bins("1" * 36, "TR", c_max=36) == 36 and decode_bins("1" * 35 + "0", "TR", c_max=36) == 35
    for bins, c_max in (("1" * 36 + "0", 36), ("10", 1), ("0", 0)):
        with pytest.raises(BitstreamError, match="wrong length"):
            decode_bins(bins, "TR", c_max=c_max)
    # with a rest the zero tells values apart
    assert decode_bins("1100", "TR", c_max=5, rice=1) == 4 and decode_bins("11", "TR", c_max=5, rice=1) == 5


def test_codes_by_the_word_and_bit_by_bit():
    def slowly(bits):
        zeros = len(bits) - len(bits.lstrip("0"))
        if zeros > 63:
            return "exp-golomb overflow", zeros
        if 2 * zeros + 1 > len(bits):
            return "unexpected end", None
        return int(bits[zeros : 2 * zeros + 1], 2) - 1, 2 * zeros + 1

    rng = random.Random(8)
    for _ in range(3000):
        start, n = rng.randrange(9), rng.randrange(0, 140)
        bits = ("0" * rng.randrange(0, 70) + "1" + format(rng.getrandbits(140), "0140b"))[:n]
        text = format(rng.getrandbits(start), f"0{start}b") * (start > 0) + bits
        behind = "1" * (-len(text) % 8 + 8 * rng.randrange(2))  # bits behind the reader's end aren't looked at
        data = int("1" + text + behind, 2).to_bytes((len(text + behind) + 8) // 8, "big")[1:]
        reader, (want, after) = BitReader(data, start, len(text)), slowly(bits)
        try:
            assert (reader.ue(), reader.at - start) == (want, after)
        except BitstreamError as e:
            assert e.kind == want
