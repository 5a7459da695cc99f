"""Byte streams as DataFrames: framing, units, parsed syntax, and the parameter sets that are active at a slice.

Streams are rows (stream_id, payload). Splitting and parsing run in Python on Arrow batches, a row per unit, so a
long stream is parsed by as many tasks as its units are dealt to; only the split of one stream is serial. Units that
don't parse become rows with an error (``mode="permissive"``) or end the job (``mode="failfast"``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import pieces, ship, stored
from .bits import BitReader, BitstreamError, unescape
from .syntax import KINDS, parse_payload, read_table, slice_context, slice_pps_id, unit_header, width


def split_stream(stream: bytes) -> list[bytes]:
    """The units between start codes (two or three zeros and a one), without the zeros behind them; empty ones go."""
    out = []
    begin = stream.find(b"\0\0\1")
    while begin >= 0:
        after = stream.find(b"\0\0\1", begin + 3)
        unit = stream[begin + 3 : after if after >= 0 else len(stream)].rstrip(b"\0")
        if unit:
            out.append(unit)
        begin = after
    return out


def split_sample(sample: bytes, length_size: int) -> list[bytes]:
    """The units of a sample, each behind its length of 1 to 4 bytes."""
    if not 1 <= length_size <= 4:
        raise BitstreamError("invalid syntax value", "NAL length size must be 1..=4")
    out, at = [], 0
    while at < len(sample):
        if at + length_size > len(sample):
            raise BitstreamError("unexpected end", f"{8 * length_size} bits wanted, {8 * (len(sample) - at)} left")
        n = int.from_bytes(sample[at : at + length_size], "big")
        at += length_size
        if not n or at + n > len(sample):
            raise BitstreamError("invalid syntax value", "invalid length-prefixed NAL")
        out.append(sample[at : at + n])
        at += n
    return out


def substreams(escaped: bytes, start: int, offsets_minus1: list[int]) -> list[tuple[int, int]]:
    """Byte ranges of the substreams of a slice, in the plain payload and from its data on.

    Lengths count bytes of the escaped payload, in which the data begin at the first byte that unescapes to ``start``.
    """
    plain, kept = [], 0
    for i, byte in enumerate(escaped):
        plain.append(kept)
        kept += not (byte == 3 and i >= 2 and escaped[i - 2 : i] == b"\0\0")
    plain.append(kept)
    if start not in plain:
        raise BitstreamError("invalid syntax value", "CABAC start is not an EBSP boundary")
    at, out = plain.index(start), []
    for n in offsets_minus1:
        if at + n + 1 >= len(plain):
            raise BitstreamError("invalid syntax value", "entry-point exceeds EBSP payload")
        out.append((plain[at] - start, plain[at + n + 1] - start))
        at += n + 1
    return [*out, (plain[at] - start, kept - start)]


UNITS = "stream_id long, nal_idx long, unit binary, error string"


def _units(split: Callable[..., list[bytes]], strict: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Splits rows (stream_id, payload, whatever ``split`` takes besides)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows: list[tuple] = []
            for stream, payload, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(stream, k, unit, None) for k, unit in enumerate(split(payload or b"", *more))]
                except BitstreamError as e:
                    if strict:
                        raise
                    rows.append((stream, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["stream_id", "nal_idx", "unit", "error"])

    return run


def nal_units(streams: DataFrame, mode: str = "permissive") -> DataFrame:
    """(stream_id, nal_idx, unit, error) of byte streams with start codes."""
    ship(streams.sparkSession)
    return streams.select(F.col("stream_id").cast("long"), "payload").mapInArrow(_units(split_stream, mode == "failfast"), UNITS)


def sample_units(samples: DataFrame, length_size: int | str, mode: str = "permissive") -> DataFrame:
    """(stream_id, nal_idx, unit, error) of length-prefixed samples; a sample that breaks the framing is one error row.

    ``length_size`` is the number of bytes of a length, or the column that holds it.
    """
    ship(samples.sparkSession)
    size = F.col(length_size) if isinstance(length_size, str) else F.lit(length_size)
    return samples.select(F.col("stream_id").cast("long"), "payload", size.cast("int")).mapInArrow(_units(split_sample, mode == "failfast"), UNITS)


def byte_stream(units: DataFrame) -> DataFrame:
    """(stream_id, payload): the units of each stream behind start codes, in order. Native; escapes nothing.

    A stream is one value, so it has 2 GB at most, like every value of a row.
    """
    return units.groupBy("stream_id").agg(F.expr("listagg(concat(X'000001', unit)) within group (order by nal_idx)").alias("payload"))


def header_fields(word: Column) -> dict[str, Column]:
    """Type, layer and temporal id from the first two bytes as a number, and what is wrong with them. Native."""
    kind, layer, temporal = F.shiftright(word, 9).bitwiseAND(63), F.shiftright(word, 3).bitwiseAND(63), word.bitwiseAND(7)
    error = F.when(F.shiftright(word, 15) != 0, "forbidden_zero_bit is not zero").when(temporal == 0, "nuh_temporal_id_plus1 is not greater than zero")
    return {"nal_type": kind, "layer_id": layer, "tid_plus1": temporal, "error": error}


PARSED = "stream_id long, nal_idx long, nal_type int, layer_id int, tid_plus1 int, kind string, syntax string, rbsp binary, error string"


@lru_cache(maxsize=256)
def _fields(kind: int, rbsp: bytes) -> str | None:
    fields = parse_payload(kind, rbsp)
    return None if fields is None else json.dumps(fields)


def fields_of(kind: int, rbsp: bytes) -> str | None:
    """The fields of a payload as JSON; those of short parameter sets, which streams have in common, are kept."""
    return (_fields if 32 <= kind <= 34 and len(rbsp) <= 1024 else _fields.__wrapped__)(kind, rbsp)


def _parsed(strict: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string())
    names = [f.split()[0] for f in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for stream, idx, unit, error in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "nal_idx", "unit", "error")), strict=True):
                head: tuple = (None, None, None)
                kind = syntax = rbsp = None
                if unit is not None:
                    try:
                        head = unit_header(unit)
                        rbsp = unescape(unit[2:])
                        kind = KINDS.get(head[0], "vcl" if head[0] < 32 else "raw")
                        syntax = fields_of(head[0], rbsp)
                    except BitstreamError as e:
                        if strict:
                            raise
                        error = str(e)
                rows.append((stream, idx, *head, kind, syntax, rbsp, error))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def parse_units(units: DataFrame, mode: str = "permissive") -> DataFrame:
    """Header, kind and fields (as JSON) of every unit. Slices keep their payload and are parsed only when asked for."""
    ship(units.sparkSession)
    return units.select("stream_id", "nal_idx", "unit", "error").mapInArrow(_parsed(mode == "failfast"), PARSED)


def field(path: str, kind: str = "bigint", column: str = "syntax") -> Column:
    """A field of parsed syntax by its path."""
    return F.get_json_object(column, f"$.{path}").cast(kind)


def as_of(rows: DataFrame, sets: DataFrame, key: str, value: str) -> DataFrame:
    """Adds to rows (stream_id, nal_idx, key) the latest ``value`` of sets (stream_id, nal_idx, key, value) before them.

    A union and a running last value per stream and key: a later set replaces an earlier one. Only the set's place runs
    through the window; the value itself is joined by it. Rows whose key has no set before them get null. The sets may be
    as many as the rows, so they are never broadcast: stored sets that resemble each other look small and aren't.
    """
    places = sets.select("stream_id", "nal_idx", key, F.col("nal_idx").alias("__place"))
    both = rows.withColumn("__is_set", F.lit(False)).unionByName(places.withColumn("__is_set", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("stream_id", key).orderBy("nal_idx", F.desc("__is_set")).rowsBetween(Window.unboundedPreceding, -1)
    placed = both.withColumn("__place", F.last("__place", ignorenulls=True).over(w)).where("not __is_set").drop("__is_set")
    values = sets.select("stream_id", F.col("nal_idx").alias("__place"), value)
    # a fixed number of parts: by their compressed size they would be put together into few, and Python reads slices behind this
    spark, key = rows.sparkSession, ["stream_id", "__place"]
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(n, *key).join(values.repartition(n, *key).hint("merge"), key, "left").drop("__place")


HEADERS = "stream_id long, nal_idx long, header string, error string"


@lru_cache(maxsize=256)
def _loaded(fields: str) -> dict:
    """The fields of a parameter set, which most slices of a batch share."""
    return json.loads(fields)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = []
        for stream, idx, kind, rbsp, sps, pps in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "nal_idx", "nal_type", "rbsp", "sps", "pps")), strict=True):
            header, error = None, None
            if pps is None or sps is None:
                error = "missing picture parameter set" if pps is None else "missing sequence parameter set"
            else:
                s, p = _loaded(sps), _loaded(pps)
                size = 1 << s["log2_min_luma_coding_block_size_minus3"] + s["log2_diff_max_min_luma_coding_block_size"] + 3
                blocks = -(-s["pic_width_in_luma_samples"] // size) * -(-s["pic_height_in_luma_samples"] // size)
                try:
                    header = json.dumps(read_table("slice_header", BitReader(rbsp), slice_context(kind, s, p, width(blocks))))
                except BitstreamError as e:
                    error = str(e)
            rows.append((stream, idx, header, error))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["stream_id", "nal_idx", "header", "error"])


def _pps_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids = []
        for kind, rbsp in zip(batch.column("nal_type").to_pylist(), batch.column("rbsp").to_pylist(), strict=True):
            try:
                ids.append(slice_pps_id(kind, rbsp))
            except BitstreamError:
                ids.append(None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=[*batch.schema.names, "pps_id"])


def active_sets(parsed: DataFrame) -> DataFrame:
    """Slices with the parameter sets that are active at them: (stream_id, nal_idx, nal_type, rbsp, pps_id, pps, sps_id, sps).

    The picture set by the id that the slice names, the sequence set by the id in that picture set, both as they
    are at the slice.
    """
    ship(parsed.sparkSession)
    parsed = stored(parsed.where("kind in ('vcl', 'pps', 'sps') and error is null"), "parsed-units")  # parsed once
    slices = parsed.where("kind = 'vcl'").select("stream_id", "nal_idx", "nal_type", "rbsp").mapInArrow(_pps_ids, "stream_id long, nal_idx long, nal_type int, rbsp binary, pps_id long")
    pps = parsed.where("kind = 'pps'").select("stream_id", "nal_idx", field("pps_pic_parameter_set_id").alias("pps_id"), F.col("syntax").alias("pps"))
    sps = parsed.where("kind = 'sps'").select("stream_id", "nal_idx", field("sps_seq_parameter_set_id").alias("sps_id"), F.col("syntax").alias("sps"))
    with_pps = as_of(slices, pps, "pps_id", "pps").withColumn("sps_id", field("pps_seq_parameter_set_id", column="pps"))
    return as_of(with_pps, sps, "sps_id", "sps")


def slice_headers(parsed: DataFrame) -> DataFrame:
    """(stream_id, nal_idx, header, error) of every slice, read with the parameter sets that are active at it."""
    return active_sets(parsed).select("stream_id", "nal_idx", "nal_type", "rbsp", "sps", "pps").mapInArrow(_headers, HEADERS)
