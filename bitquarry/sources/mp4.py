"""MP4 files as a Spark data source: the coded samples of the video track, a row each.

Only the index (the ``moov`` box) of a file is read whole; samples are read by their offsets, and a file's samples
are dealt over as many partitions as the option ``partitions`` says. ``spark.read.format("mp4").load(path)``.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bits import BitstreamError

SCHEMA = "path string, sample long, offset long, size long, length_size int, payload binary"


def box_header(data: bytes, whole: int) -> tuple[bytes, int, int]:
    """(tag, header length, total size) of the box at the start of ``data``, which has ``whole`` bytes to its end."""
    size, tag = struct.unpack_from(">I4s", data)
    head = 8
    if size == 1:
        size, head = struct.unpack_from(">Q", data, 8)[0], 16
    elif size == 0:
        size = whole
    if size < head or size > whole:
        raise BitstreamError("invalid box size", tag.decode("latin-1"))
    return tag, head, size


def find_box(data: bytes, tag: bytes) -> bytes | None:
    """The content of the first plausible box with a tag, wherever it lies: containers aren't walked."""
    at = data.find(tag, 4)
    while at >= 0:
        try:
            _, head, size = box_header(data[at - 4 : at + 12].ljust(16, b"\0"), len(data) - at + 4)
            return data[at - 4 + head : at - 4 + size]
        except BitstreamError:
            at = data.find(tag, at + 1)
    return None


def movie(read, length: int) -> bytes:
    """The content of the movie box; ``read(offset, n)`` gives bytes of a file of ``length`` bytes."""
    at = 0
    while at + 8 <= length:
        tag, head, size = box_header(read(at, 16).ljust(16, b"\0"), length - at)
        if tag == b"moov":
            return read(at + head, size - head)
        at += size
    raise BitstreamError("no moov box")


def video_track(moov: bytes) -> bytes | None:
    at = 0
    while at + 8 <= len(moov):
        size, tag = struct.unpack_from(">I4s", moov, at)
        if size < 8 or at + size > len(moov):
            return None
        if tag == b"trak" and find_box(inner := moov[at + 8 : at + size], b"vmhd") is not None:
            return inner
        at += size
    return None


def entries(data: bytes | None, start: int, layout: str) -> list[tuple]:
    """The entries of a table box behind its count; those that are cut off are left out."""
    if data is None or len(data) < start:
        return []
    count, step = struct.unpack_from(">I", data, start - 4)[0], struct.calcsize(layout)
    return [struct.unpack_from(layout, data, start + k * step) for k in range(min(count, (len(data) - start) // step))]


def sample_places(track: bytes) -> list[tuple[int, int]]:
    """(offset, size) of every sample of a track: chunks in order, each with as many samples as its run says."""
    if (narrow := find_box(track, b"stco")) is not None:
        chunks = [c for c, in entries(narrow, 8, ">I")]
    else:
        chunks = [c for c, in entries(find_box(track, b"co64"), 8, ">Q")]
    sizes_box = find_box(track, b"stsz")
    fixed = struct.unpack_from(">I", sizes_box, 4)[0] if sizes_box is not None and len(sizes_box) >= 12 else 0
    sizes = [fixed] * struct.unpack_from(">I", sizes_box, 8)[0] if fixed else [s for s, in entries(sizes_box, 12, ">I")]
    runs = [(first, each) for first, each, _ in entries(find_box(track, b"stsc"), 8, ">III")]
    firsts = [first for first, _ in runs]
    out: list[tuple[int, int]] = []
    for number, base in enumerate(chunks, 1):
        run = bisect_right(firsts, number) - 1
        own = sizes[len(out) : len(out) + (runs[run][1] if run >= 0 else 1)]
        out += zip(accumulate(own, initial=base), own, strict=False)
    return out


def configuration(track: bytes) -> tuple[int, list[bytes]]:
    """How long the length before a unit is, and the parameter-set units of the decoder configuration."""
    if not any(find_box(track, tag) is not None for tag in (b"hvc1", b"hev1")):
        raise BitstreamError("no coded video of this kind")
    config = find_box(track, b"hvcC")
    if config is None or len(config) < 23:
        raise BitstreamError("unexpected end", "hvcC box is truncated")
    at, units = 23, []

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(config):
            raise BitstreamError("unexpected end", "hvcC array is truncated")
        at += n
        return config[at - n : at]

    for _ in range(config[22]):
        _, count = struct.unpack(">BH", take(3))
        for _ in range(count):
            units.append(take(struct.unpack(">H", take(2))[0]))
    return config[21] % 4 + 1, units


class Mp4Source(DataSource):
    """Rows (path, sample, offset, size, length_size, payload). Sample -1 holds the parameter sets, behind lengths of
    four bytes. Options: ``path``, a file or a folder of .mp4 files, and ``partitions`` of each file."""

    @classmethod
    def name(cls) -> str:
        return "mp4"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Mp4Reader(self.options)


class Part(InputPartition):
    def __init__(self, path: str, number: int, of: int) -> None:
        self.path, self.number, self.of = path, number, of


class Mp4Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.of = options["path"], int(options.get("partitions", "1"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)
        info = files.get_file_info(at)
        found = [f.path for f in files.get_file_info(fs.FileSelector(at))] if info.type == fs.FileType.Directory else [at]
        scheme = self.path.split("://")[0] if "://" in self.path else "file"
        return [Part(f"{scheme}://{p}", k, self.of) for p in sorted(found) if p.lower().endswith((".mp4", ".mov", ".m4v")) for k in range(self.of)]

    def read(self, partition: Part) -> Iterator[tuple]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(partition.path)
        with files.open_input_file(at) as source:
            track = video_track(movie(lambda offset, n: source.read_at(n, offset), source.size()))
            if track is None:
                raise BitstreamError("no video track")
            length_size, units = configuration(track)
            if partition.number == 0:
                sets = b"".join(struct.pack(">I", len(u)) + u for u in units)
                yield partition.path, -1, 0, len(sets), 4, sets
            for k, (offset, size) in enumerate(sample_places(track)):
                if k % partition.of == partition.number:
                    yield partition.path, k, offset, size, length_size, source.read_at(size, offset)
