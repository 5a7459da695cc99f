from __future__ import annotations

import struct

import pytest

from bitquarry.sources import mp4
from bitquarry.sources.bits import BitstreamError
from bitquarry.sources.bitstream import sample_units


def box(tag, *content):
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), tag) + body


def movie_file(samples, chunks=((0, 2), (2, 1)), wide=False):
    """A file whose samples lie in chunks of (first sample, number)."""
    head = box(b"ftyp", b"isom")
    offsets, at = [], len(head) + 8
    for s in samples:
        offsets.append(at)
        at += len(s)
    starts = [offsets[first] for first, _ in chunks]
    tables = [
        box(b"stsd", b"\0" * 8, box(b"hvc1", b"\0" * 78, box(b"hvcC", bytes(21) + b"\x03\x01" + b"\x20\0\x01\0\x03abc"))),
        box(b"stsz", struct.pack(">III", 0, 0, len(samples)), *(struct.pack(">I", len(s)) for s in samples)),
        box(b"stsc", struct.pack(">II", 0, len(chunks)), *(struct.pack(">III", k + 1, n, 1) for k, (_, n) in enumerate(chunks))),
        box(b"co64" if wide else b"stco", struct.pack(">II", 0, len(chunks)), *(struct.pack(">Q" if wide else ">I", s) for s in starts)),
    ]
    audio = box(b"trak", box(b"mdia", box(b"smhd", b"\0" * 8)))
    video = box(b"trak", box(b"mdia", box(b"vmhd", b"\0" * 12), box(b"stbl", *tables)))
    return head + box(b"mdat", *samples) + box(b"moov", audio, video)


SAMPLES = [b"\0\0\0\3\x40\x01a", b"\0\0\0\2\x02\x01\0\0\0\3\x02\x01b", b"\0\0\0\2\x26\x01"]


@pytest.mark.parametrize("wide", [False, True])
def test_sample_places(wide):
    raw = movie_file(SAMPLES, wide=wide)
    track = mp4.video_track(mp4.movie(lambda at, n: raw[at : at + n], len(raw)))
    places = mp4.sample_places(track)
    assert [raw[o : o + n] for o, n in places] == SAMPLES
    assert mp4.configuration(track) == (4, [b"abc"])


def test_damaged_files():
    raw = movie_file(SAMPLES)
    with pytest.raises(BitstreamError, match="moov"):
        mp4.movie(lambda at, n: raw[at : at + n], 12)
    with pytest.raises(BitstreamError, match="box size"):
        mp4.movie(lambda at, n: b"\0\0\0\4ftyp", 100)
    assert mp4.entries(struct.pack(">III", 0, 5, 7), 8, ">I") == [(7,)]  # cut off behind its first entry
    with pytest.raises(BitstreamError, match="no coded video"):
        mp4.configuration(b"nothing")


def test_data_source(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(movie_file(SAMPLES))
    (tmp_path / "note.txt").write_text("x")
    from bitquarry.runtime import ship

    ship(spark)
    spark.dataSource.register(mp4.Mp4Source)
    rows = spark.read.format("mp4").option("partitions", 2).load(f"file://{tmp_path}")
    got = {r["sample"]: bytes(r["payload"]) for r in rows.collect()}
    assert got == {-1: b"\0\0\0\3abc", **dict(enumerate(SAMPLES))}
    units = sample_units(rows.where("sample >= 0").selectExpr("sample as stream_id", "payload"), 4).orderBy("stream_id", "nal_idx")
    assert [bytes(r["unit"]) for r in units.collect()] == [b"\x40\x01a", b"\x02\x01", b"\x02\x01b", b"\x26\x01"]
