"""Queries over bit-serial readers: descriptors, bin strings, and payloads whose fields the key of a row gives.

``read_fields`` reads a row's payload by a script of descriptors, ``read_payloads`` by a syntax table; both give an
error instead of a value where the payload breaks a rule. ``code_at`` and ``fixed_at`` are the native forms over
strings of bits.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arith import power2
from ..runtime import dealt, pieces, shared_path, ship
from ..sources.bits import BitReader, BitstreamError, BitWriter, decode_bins, encode_bins
from ..sources.bitstream import field
from ..sources.mp4 import Mp4Source, configuration, movie, sample_places, video_track
from ..sources.synthetic import _profile
from ..sources.syntax import read_table
from ..sources.tables import table


def _mapped(run_row: Callable[[tuple], tuple], columns: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = [run_row(row) for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def ask(reader: BitReader, step: str) -> tuple[BitReader, int | str]:
    """The answer of a reader to a step of a script, and the reader to go on with."""
    name, *numbers = step.split(":")
    n = [int(x) for x in numbers]
    if name == "peek0":
        return reader, reader.peek(n[0], beyond=True)
    if name == "part":
        return reader.part(*n), n[1]
    if name in ("position", "left"):
        return reader, reader.at if name == "position" else reader.left
    if name in ("more", "aligned"):
        return reader, int(reader.more_data() if name == "more" else reader.aligned())
    if name in ("trailing", "align"):
        getattr(reader, name)()
        return reader, reader.at
    if name == "peek":
        return reader, reader.peek(*n)
    return reader, reader.read(f"{name}({n[0]})" if n else name)


def read_fields(rows: DataFrame) -> DataFrame:
    """(id, got, error) of rows (id, payload, script): what each step of a script reads, up to the first error.

    Steps are descriptors (``u:5``, ``i:5``, ``f:8``, ``b``, ``ue``, ``se``, ``st``, ``ae``), ``peek:n`` and ``peek0:n``
    (zeros behind the end), ``more``, ``trailing``, ``align``, ``aligned``, ``position``, ``left`` and
    ``part:offset:bytes``. Answers are joined by commas.
    """
    ship(rows.sparkSession)

    def one(row: tuple) -> tuple:
        key, payload, script = row
        reader, got = BitReader(payload), []
        try:
            for step in script:
                reader, value = ask(reader, step)
                got.append(str(value))
        except BitstreamError as e:
            return key, ",".join(got), str(e)
        return key, ",".join(got), None

    schema = pa.schema([("id", pa.int64()), ("got", pa.string()), ("error", pa.string())])
    return rows.mapInArrow(_mapped(one, ["id", "payload", "script"], schema), "id long, got string, error string")


def read_payloads(rows: DataFrame, name: str, *args: Any) -> DataFrame:
    """(id, syntax, error) of rows (id, payload): the fields of a syntax table as JSON."""
    ship(rows.sparkSession)

    def one(row: tuple) -> tuple:
        try:
            return row[0], json.dumps(read_table(name, BitReader(row[1]), *args)), None
        except BitstreamError as e:
            return row[0], None, str(e)

    schema = pa.schema([("id", pa.int64()), ("syntax", pa.string()), ("error", pa.string())])
    return rows.mapInArrow(_mapped(one, ["id", "payload"], schema), "id long, syntax string, error string")


def bin_strings(rows: DataFrame) -> DataFrame:
    """(id, scheme, bins, back, error) of rows (id, scheme, value, c_max, rice, k, log2_range, tail): a value's bins, and
    what they and the ``tail`` behind them decode to."""
    ship(rows.sparkSession)

    def one(row: tuple) -> tuple:
        key, scheme, value, c_max, rice, order, log2_range, tail = row
        bins = None
        try:
            bins = encode_bins(value, scheme, c_max, rice, order, log2_range)
            return key, scheme, bins, decode_bins(bins + tail, scheme, c_max, rice, order, log2_range), None
        except BitstreamError as e:
            return key, scheme, bins, None, str(e)

    schema = pa.schema([("id", pa.int64()), ("scheme", pa.string()), ("bins", pa.string()), ("back", pa.int64()), ("error", pa.string())])
    columns = ["id", "scheme", "value", "c_max", "rice", "k", "log2_range", "tail"]
    return rows.mapInArrow(_mapped(one, columns, schema), "id long, scheme string, bins string, back long, error string")


# --- native forms over strings of bits -------------------------------------------------------------------------


def fixed_at(bits: Column, at: Column | int, n: Column | int, signed: bool = False) -> Column:
    """The n bits from a place on as a number, null behind the end; n is 1 to 63."""
    at, n = F.lit(at), F.lit(n)
    value = F.conv(F.substring(bits, at + 1, n), 2, 10).cast("long")
    if signed:
        value = F.when(value >= power2(n - 1), value - power2(n)).otherwise(value)
    return F.when(at + n <= F.length(bits), value)


def code_at(bits: Column, at: Column | int) -> tuple[Column, Column]:
    """The Exp-Golomb code number at a place, and the place behind it; null behind the end."""
    at = F.lit(at)
    zeros = F.call_function("locate", F.lit("1"), bits, at + 1) - at - 1
    rest = F.when(zeros > 0, F.conv(F.substring(bits, at + zeros + 2, zeros), 2, 10).cast("long")).otherwise(0)
    value = power2(zeros) - 1 + rest
    fits = (zeros >= 0) & (at + 2 * zeros + 1 <= F.length(bits))
    return F.when(fits, value), F.when(fits, at + 2 * zeros + 1)


def code_bits(value: Column) -> Column:
    """The Exp-Golomb code of a number as bits."""
    digits = F.bin(value + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(digits) - 1), digits)


def bytes_of(bits: Column, n_bytes: int) -> Column:
    """Bits as bytes, with zeros up to ``n_bytes``, which is 8 at most."""
    return F.unhex(F.lpad(F.conv(F.rpad(bits, 8 * n_bytes, "0"), 2, 16), 2 * n_bytes, "0"))


# --- queries over descriptors ----------------------------------------------------------------------------------


def b1_fixed_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width reads of six bytes that an event gives: plain, ahead, signed, ahead behind the end, and one too many."""
    e = table(spark, sf_dir, "events", "event_id", "user_id")
    word = (F.col("event_id") * 2654435761 + F.col("user_id") * 97) % (1 << 48)
    a, b = F.col("event_id") % 17, F.col("user_id") % 16 + 1
    text = lambda name, n: F.concat(F.lit(name), n.cast("string"))
    script = F.array(text("u:", a), F.lit("peek:7"), text("i:", b), F.lit("position"), F.lit("left"), F.lit("aligned"), F.lit("peek0:60"), F.lit("u:64"))
    payload = F.unhex(F.lpad(F.hex(word), 12, "0"))
    got = read_fields(e.select(F.col("event_id").alias("id"), payload.alias("payload"), script.alias("script")))
    bits = F.lpad(F.bin(word), 48, "0")
    native = e.select(F.col("event_id").alias("id"), fixed_at(bits, a, b, signed=True).alias("native"), fixed_at(bits, 40, b).alias("short"))
    return got.join(native, "id")


def b5_exp_golomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three codes behind one another, read by the reader and by the native form."""
    e = table(spark, sf_dir, "events", "event_id", "user_id")
    one, two = F.col("event_id") % 8000, F.col("user_id") % 4000 * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    signed = F.when(two > 0, 2 * two - 1).otherwise(-2 * two)
    bits = F.concat(code_bits(one), code_bits(signed), code_bits(F.col("event_id") % 3))
    rows = e.select(F.col("event_id").alias("id"), bits.alias("bits"))
    script = F.array(F.lit("ue"), F.lit("se"), F.lit("ue"), F.lit("position"))
    got = read_fields(rows.select("id", bytes_of(F.col("bits"), 8).alias("payload"), script.alias("script")))
    first, after = code_at(F.col("bits"), 0)
    native = rows.select("id", "bits", first.alias("first"), after.alias("after"))
    second, end = code_at(F.col("bits"), F.col("after"))
    return got.join(native.select("id", "first", second.alias("second"), end.cast("long").alias("end")), "id")


def b7_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as strings up to a zero byte: read, not aligned, not ended, or not UTF-8, as the key says."""
    p = dealt(table(spark, sf_dir, "part", "p_partkey", "p_name"), "p_partkey")
    k = F.col("p_partkey")
    name = F.col("p_name").cast("binary")
    payload = F.when(k % 11 == 0, F.concat(F.unhex(F.lit("FF")), name, F.unhex(F.lit("00")))).when(k % 7 == 0, name).otherwise(F.concat(name, F.unhex(F.lit("0041"))))
    script = F.when(k % 5 == 0, F.array(F.lit("f:1"), F.lit("st"))).when(k % 11 == 0, F.array(F.lit("st"))).otherwise(F.array(F.lit("st"), F.lit("b"), F.lit("left")))
    return read_fields(p.select(k.alias("id"), payload.alias("payload"), script.alias("script")))


def b8_trailing_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with closing bits behind them, broken for some; what follows the descriptor of coded bins is an error."""
    p = dealt(table(spark, sf_dir, "part", "p_partkey"), "p_partkey")
    k = F.col("p_partkey")
    n = 1 + k % 13
    bits = F.concat(F.lpad(F.bin(k % power2(n)), n.cast("int"), "0"), F.when(k % 6 == 0, F.lit("0")).otherwise(F.lit("1")))
    width = F.lit("u:")
    script = F.array(F.lit("more"), F.concat(width, n.cast("string")), F.lit("more"), F.lit("trailing"), F.lit("align"), F.when(k % 10 == 3, F.lit("ae")).otherwise(F.lit("left")))
    return read_fields(p.select(k.alias("id"), bytes_of(bits, 2).alias("payload"), script.alias("script")))


def b11_substreams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bytes from a place of eight, or an error where they lie behind the end."""
    p = dealt(table(spark, sf_dir, "part", "p_partkey"), "p_partkey")
    k = F.col("p_partkey")
    payload = F.unhex(F.lpad(F.hex(k * 2654435761), 16, "0"))
    script = F.array(F.lit("u:3"), F.concat(F.lit("part:"), (k % 8).cast("string"), F.lit(":2")), F.lit("position"), F.lit("left"), F.lit("u:16"))
    return read_fields(p.select(k.alias("id"), payload.alias("payload"), script.alias("script")))


def b14_decoded_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes in all five schemes, coded and decoded; a bin too many behind some of them is an error."""
    p = dealt(table(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    k, v = F.col("p_partkey"), F.col("p_size").cast("long")
    scheme = F.explode(F.array(*(F.lit(s) for s in ("FL", "TB", "TR", "EG", "LEG")))).alias("scheme")
    tail = F.when(k % 9 == 0, F.lit("0")).otherwise(F.lit(""))
    rows = p.select(k.alias("id"), scheme, v.alias("value"), (k % 60 + 1).alias("c_max"), (k % 4).alias("rice"), (k % 4).alias("k"), F.lit(15).cast("long").alias("log2_range"), tail.alias("tail"))
    return bin_strings(rows)


# --- payloads whose fields the key gives -------------------------------------------------------------------------


def _hrd(w: BitWriter, key: int, sub_pic: int, layers: int) -> BitWriter:
    w.u(1, 1).u(1, 0).u(1, sub_pic)
    if sub_pic:
        w.u(8, key % 200).u(5, 3).u(1, 1).u(5, 4)
    w.u(4, key % 16).u(4, 3)
    if sub_pic:
        w.u(4, 5)
    w.u(5, 1).u(5, key % 32).u(5, 2)
    for k in range(layers):
        w.u(1, 1).ue(key % 6 + k).ue(0).ue(key + k).ue(2)
        if sub_pic:
            w.ue(7).ue(8)
        w.u(1, key % 2)
    return w


def video_set(key: int) -> bytes:
    w = BitWriter().u(4, key % 16).u(2, 3).u(6, 0).u(3, 1).u(1, 1).u(16, 0xFFFF)
    _profile(w, 1 + key % 3, 93).u(2, 1)
    for _ in range(7):
        w.u(2, 0)
    w.u(8, key % 100).u(1, 1).ue(key % 5).ue(key % 3).ue(0).ue(1).ue(2).ue(3).u(6, key % 4).ue(1)
    for k in range(key % 4 + 1):
        w.u(1, key >> k)
    w.u(1, 1).u(32, 1000 + key).u(32, 60_000).u(1, key % 2)
    if key % 2:
        w.ue(key % 9)
    return _hrd(w.ue(1).ue(0), key, 0, 2).u(1, 0).trailing().bytes()


def usability(key: int) -> bytes:
    w = BitWriter().u(1, 1).u(8, 255).u(16, key % 60_000).u(16, 200).u(1, 0).u(1, 1).u(3, key % 6).u(1, 1).u(1, 1).u(8, 1).u(8, key % 18).u(8, 2)
    w.u(1, 1).ue(key % 6).ue(2).u(1, key % 2).u(1, 0).u(1, 1).u(1, 1).ue(1).ue(key % 7).ue(3).ue(4).u(1, 1).u(32, 1001).u(32, 24_000 + key).u(1, 0).u(1, 1)
    return _hrd(w, key, 1, 1).u(1, 1).u(2, 2).u(1, 1).ue(5).ue(6).ue(key % 17).ue(7).ue(8).bytes()


def scaling_lists(key: int) -> bytes:
    w = BitWriter()
    for i in range(20):
        size = min(i // 6, 3)
        w.u(1, (i + key) % 2)
        if (i + key) % 2 == 0:
            w.ue(i % 3)
            continue
        if size > 1:
            w.se(key % 17 - 8)
        for k in range(min(64, 16 << 2 * size)):
            w.se((7 * k + key + i) % 11 - 5)
    return w.bytes()


def predicted_sets(key: int) -> bytes:
    """A set given as it is and one predicted from it, of a sequence's set list of two."""
    w = BitWriter().ue(1 + key % 3).ue(key % 2)
    for k in range(1 + key % 3 + key % 2):
        w.ue(k).u(1, 1)
    w.u(1, 1).u(1, key % 2).ue(key % 5)
    for k in range(2 + key % 3 + key % 2):
        w.u(1, (key + k) % 2)
        if (key + k) % 2 == 0:
            w.u(1, (key // 2 + k) % 2)
    return w.bytes()


def picture_extensions(key: int) -> bytes:
    """The extensions of a picture set: range, several layers, depth tables and screen content."""
    w = BitWriter().u(4, 0b1111).u(4, 0)
    w.ue(key % 3).u(1, key % 2).u(1, 1).ue(1).ue(1).se(key % 13 - 6).se(2).se(-3).se(key % 5).ue(1).ue(2)
    w.u(1, 1).u(1, 1).u(6, key % 64).ue(1).u(6, 5).u(1, 1).se(key % 9 - 4).se(1).se(2).se(3).u(1, 0).u(1, 1).ue(1).ue(2).ue(3).ue(key % 4).u(1, 0)
    w.u(1, 1).u(6, 0).u(4, 0).u(1, 1).u(1, 0).u(1, 0).u(8, 3).u(8, 9).u(width_of(10), 3).u(8, key % 256)
    for k in range(2):
        w.u(width_of(9 - 4 + 1), (key + k) % 6)
    w.u(1, 1).u(1, 1).u(1, 1).se(key % 11 - 5).se(1).se(2).u(1, 1).ue(2).u(1, key % 2).ue(0)
    if key % 2 == 0:
        w.ue(1)
    for c in range(1 if key % 2 else 3):
        w.u(9 if c else 8, (key + c) % 256).u(9 if c else 8, 17)
    return w.trailing().bytes()


def width_of(n: int) -> int:
    """Bits that numbers below n take."""
    return (n - 1).bit_length()


def colour_map(key: int) -> bytes:
    """A colour table of one layer whose root is split for odd keys; every third vertex is coded."""
    w = BitWriter().ue(0).u(6, key % 64).u(2, 1).u(2, 0).ue(0).ue(0).ue(0).ue(0).u(2, 0).u(2, 0).se(key % 7 - 3).se(1).u(1, key % 2)
    for k in range(8 * 4 if key % 2 else 4):
        coded = (key + k) % 3 == 0
        w.u(1, coded)
        for c in range(3 if coded else 0):
            w.ue(c).u(9, (key + k) % 400)
            if c or (key + k) % 400:
                w.u(1, k % 2)
    return w.bytes()


def depth_deltas(key: int) -> bytes:
    w = BitWriter().u(8, 2 + key % 4).u(8, 20)
    least = 1 + key % 20
    if 2 + key % 4 > 2:
        w.u(width_of(21), least - 1)
    else:
        least = 20
    w.u(8, key % 256)
    for k in range(1 + key % 4 if least < 20 else 0):
        w.u(width_of(20 - least + 1), (key + k) % (20 - least + 1))
    return w.bytes()


def sequence_extensions(key: int) -> bytes:
    """The extensions of a sequence's set: range, several layers, depth and screen content, for 4:2:0 of 8 and 10 bits."""
    w = BitWriter().u(4, 0b1111).u(4, 0).u(9, key % 512).u(1, key % 2)
    w.u(2, 1).u(2, key % 4).ue(key % 3).u(5, 0b10101).ue(2).u(5, key % 32)
    return w.u(1, 1).u(1, 1).ue(key % 64).ue(3).u(1, 1).ue(1).u(8, key % 256).u(8, 1).u(10, key % 1024).u(10, 2).u(10, 3).u(10, 4).u(2, key % 3).u(1, 1).trailing().bytes()


def _made(spark: SparkSession, sf_dir: str, make: Callable[[int], bytes]) -> DataFrame:
    """(id, payload): a payload for every part."""
    ship(spark)
    schema = pa.schema([("id", pa.int64()), ("payload", pa.binary())])
    keys = dealt(table(spark, sf_dir, "part", "p_partkey"), "p_partkey")
    return keys.mapInArrow(_mapped(lambda row: (row[0], make(row[0])), ["p_partkey"], schema), "id long, payload binary")


def _size(path: str) -> Column:
    return F.size(F.from_json(F.get_json_object("syntax", f"$.{path}"), "array<string>")).cast("long")


def _longs(path: str) -> Column:
    return F.from_json(F.get_json_object("syntax", f"$.{path}"), "array<bigint>")


def _flag(path: str) -> Column:
    return field(path, "boolean").cast("long")


def p5_video_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_payloads(_made(spark, sf_dir, video_set), "vps")
    hrd = "timing.hrd[0].hrd_parameters"
    return rows.select(
        "id", field("vps_video_parameter_set_id").alias("set_id"), field("profile_tier_level.sub_layers[0].level_idc").alias("sub_level"), field("sub_layer_ordering_info[0].max_num_reorder_pics").alias("reorder"),
        field("sub_layer_ordering_info[1].max_latency_increase_plus1").alias("latency"), _size("layer_id_included_flag[0].included").alias("n_layers"), field("timing.num_units_in_tick").alias("ticks"),
        field("timing.num_ticks_poc_diff_one_minus1").alias("poc_ticks"), field(f"{hrd}.bit_rate_scale").alias("rate_scale"), field(f"{hrd}.au_cpb_removal_delay_length_minus1").alias("au_length"),
        field(f"{hrd}.sub_layers[1].elemental_duration_in_tc_minus1").alias("duration"), field(f"{hrd}.sub_layers[1].nal_hrd_parameters[0].bit_rate_value_minus1").alias("rate"), "error",
    )


def p14_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_payloads(_made(spark, sf_dir, usability), "vui", 0)
    hrd = "timing_info.hrd_parameters"
    return rows.select(
        "id", field("sar_width").alias("sar_width"), field("video_format").alias("video_format"), field("transfer_characteristics").alias("transfer"), field("chroma_sample_loc_type_top_field").alias("loc_top"),
        _flag("neutral_chroma_indication_flag").alias("neutral"), field("default_display_window[1]").alias("window"), field("timing_info.time_scale").alias("time_scale"), field(f"{hrd}.tick_divisor_minus2").alias("divisor"),
        field(f"{hrd}.sub_layers[0].nal_hrd_parameters[0].cpb_size_du_value_minus1").alias("cpb_du"), field("max_bits_per_min_cu_denom").alias("cu_bits"), field("log2_max_mv_length_vertical").alias("mv_vertical"), "error",
    )


def p15_scaling_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the twenty matrices: the matrix it is taken from, or its first, last and summed coefficients."""
    rows = read_payloads(_made(spark, sf_dir, scaling_lists), "scaling_list_data")
    kind = "array<struct<size_id:bigint,matrix_id:bigint,pred_matrix_id_delta:bigint,coefficients:array<bigint>>>"
    each = rows.select("id", F.posexplode(F.from_json(F.get_json_object("syntax", "$.matrices"), kind)).alias("i", "m"))
    c = F.col("m.coefficients")
    total = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return each.select("id", F.col("i").cast("long").alias("i"), "m.size_id", "m.matrix_id", F.col("m.pred_matrix_id_delta").alias("delta"), F.get(c, 0).alias("first"), F.element_at(c, -1).alias("last"), total.alias("total"))


def p16_predicted_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference sets predicted from the one before them."""
    ship(spark)

    def one(row: tuple) -> tuple:
        try:
            reader = BitReader(row[1])
            first = read_table("st_ref_pic_set", reader, 0, [], 2)
            second = read_table("st_ref_pic_set", reader, 1, [first], 2)
            return row[0], json.dumps(second), None
        except BitstreamError as e:
            return row[0], None, str(e)

    schema = pa.schema([("id", pa.int64()), ("syntax", pa.string()), ("error", pa.string())])
    rows = _made(spark, sf_dir, predicted_sets).mapInArrow(_mapped(one, ["id", "payload"], schema), "id long, syntax string, error string")
    return rows.select("id", _flag("delta_rps_sign").alias("sign"), field("abs_delta_rps_minus1").alias("delta_minus1"), field("reference_rps_idx").alias("from_set"), field("num_delta_pocs").alias("n_deltas"), _size("entries").alias("n_entries"), "error")


def p9_picture_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_payloads(_made(spark, sf_dir, picture_extensions), "pps_extension", True)
    return rows.select(
        "id", field("range_extension.log2_max_transform_skip_block_size_minus2").alias("skip_size"), field("range_extension.qp_offset_list[0].cb").alias("first_cb"), field("range_extension.qp_offset_list[1].cr").alias("second_cr"),
        field("multilayer_extension.pps_scaling_list_ref_layer_id").alias("ref_layer"), field("multilayer_extension.reference_location_offsets[0].scaled_ref_layer_offsets[0]").alias("offset"),
        field("multilayer_extension.reference_location_offsets[0].resample_phase[3]").alias("phase"), field("three_d_extension.depth_layers[0].delta_dlt.delta_dlt_val0").alias("depth"),
        field("three_d_extension.depth_layers[0].delta_dlt.delta_val_diff_minus_min[1]").alias("depth_step"), field("scc_extension.pps_act_y_qp_offset_plus5").alias("act"),
        _size("scc_extension.palette_predictor_initializers").alias("n_components"), field("scc_extension.palette_predictor_initializers[0].values[0]").alias("entry"), "error",
    )


def octants(rows: DataFrame) -> DataFrame:
    """(id, path, depth, y, cb, cr, n_vertices, n_coded) of the leaves of colour tables (id, syntax) whose root is split once at most."""
    leaf = "struct<input_depth:bigint,idx_y:bigint,idx_cb:bigint,idx_cr:bigint,split_octant_flag:boolean,vertices:array<struct<coded_res_flag:boolean>>>"
    root = F.from_json(F.get_json_object("syntax", "$.root"), f"{leaf[:-1]},children:array<{leaf}>>")
    r = rows.select("id", root.alias("r"))
    nodes = F.when(F.col("r.split_octant_flag"), F.col("r.children")).otherwise(F.array(F.col("r").dropFields("children")))
    each = r.select("id", F.col("r.split_octant_flag").alias("split"), F.posexplode(nodes).alias("i", "n"))
    coded = F.size(F.filter("n.vertices", lambda v: v["coded_res_flag"])).cast("long")
    path = F.when(F.col("split"), F.col("i").cast("string")).otherwise("")
    return each.select("id", path.alias("path"), F.col("n.input_depth").alias("depth"), F.col("n.idx_y").alias("y"), F.col("n.idx_cb").alias("cb"), F.col("n.idx_cr").alias("cr"), F.size("n.vertices").cast("long").alias("n_vertices"), coded.alias("n_coded"))


def p10_colour_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octants(read_payloads(_made(spark, sf_dir, colour_map), "colour_mapping"))


def p11_depth_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_payloads(_made(spark, sf_dir, depth_deltas), "delta_dlt", 8)
    steps = _longs("delta_val_diff_minus_min")
    return rows.select("id", field("num_val_delta_dlt").alias("n"), field("max_diff").alias("max_diff"), field("min_diff_minus1").alias("min_minus1"), field("delta_dlt_val0").alias("val0"), F.array_join(steps.cast("array<string>"), ",").alias("steps"), "error")


def p12_sequence_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_payloads(_made(spark, sf_dir, sequence_extensions), "sps_extension", 1, 0, 2)
    return rows.select(
        "id", _flag("range_extension.transform_skip_rotation_enabled_flag").alias("rotation"), _flag("range_extension.cabac_bypass_alignment_enabled_flag").alias("alignment"), _flag("inter_view_mv_vert_constraint_flag").alias("vertical"),
        field("three_d_extension.log2_ivmc_sub_pb_size_minus3").alias("sub_pb"), _flag("three_d_extension.skip_intra_enabled_flag").alias("skip_intra"), field("scc_extension.palette_max_size").alias("palette_size"),
        field("scc_extension.palette_predictor_initializers[0].values[0]").alias("luma"), field("scc_extension.palette_predictor_initializers[1].values[0]").alias("chroma"), field("scc_extension.motion_vector_resolution_control_idc").alias("mv_control"), "error",
    )


# --- movie files -----------------------------------------------------------------------------------------------


def _box(tag: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), tag) + body


def movie_of(samples: list[bytes], sets: list[bytes], length_code: int, wide: bool, whole: bool = True) -> bytes:
    """A movie of an audio and a video track: two samples in the first chunk, one in each other; without its index unless ``whole``."""
    chunks = [0, *range(2, len(samples))]
    head = _box(b"ftyp", b"isom")
    places, at = [], len(head) + 8
    for s in samples:
        places.append(at)
        at += len(s)
    units = b"".join(b"\x20\0\x01" + struct.pack(">H", len(u)) + u for u in sets)
    tables = [
        _box(b"stsd", bytes(8), _box(b"hvc1", bytes(78), _box(b"hvcC", bytes(21) + bytes([length_code, len(sets)]) + units))),
        _box(b"stsz", struct.pack(">III", 0, 0, len(samples)), *(struct.pack(">I", len(s)) for s in samples)),
        _box(b"stsc", struct.pack(">II", 0, 2), struct.pack(">III", 1, 2, 1), struct.pack(">III", 2, 1, 1)),
        _box(b"co64" if wide else b"stco", struct.pack(">II", 0, len(chunks)), *(struct.pack(">Q" if wide else ">I", places[first]) for first in chunks)),
    ]
    video = _box(b"trak", _box(b"mdia", _box(b"vmhd", bytes(12)), _box(b"stbl", *tables)))
    moov = _box(b"moov", _box(b"trak", _box(b"mdia", _box(b"smhd", bytes(8)))), video)
    return head + _box(b"mdat", *samples) + (moov if whole else b"")


def movie_file(key: int, whole: bool = False) -> bytes:
    """A movie of ``3 + key % 5`` samples and ``key % 3`` sets that the key gives."""
    samples = [bytes([key % 256, k]) * (1 + (key + k) % 9) for k in range(3 + key % 5)]
    return movie_of(samples, [bytes([key % 256]) * (2 + k) for k in range(key % 3)], key % 4, key % 2 == 1, whole or key % 13 > 0)


def movie_index(movies: DataFrame) -> DataFrame:
    """(id, length_size, n_sets, places, error) of movie files (id, content): the configuration and (offset, size) of all samples."""
    ship(movies.sparkSession)

    def one(row: tuple) -> tuple:
        key, content = row
        try:
            track = video_track(movie(lambda at, n: content[at : at + n], len(content)))
            if track is None:
                raise BitstreamError("no video track")
            size, sets = configuration(track)
            return key, size, len(sets), [{"offset": a, "size": n} for a, n in sample_places(track)], None
        except BitstreamError as e:
            return key, None, None, None, str(e)

    schema = pa.schema([("id", pa.int64()), ("length_size", pa.int64()), ("n_sets", pa.int64()), ("places", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))), ("error", pa.string())])
    return movies.mapInArrow(_mapped(one, ["id", "content"], schema), "id long, length_size long, n_sets long, places array<struct<offset:bigint,size:bigint>>, error string")


def s6_movie_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movies of parts: their configuration and their samples' places; every thirteenth has no index."""
    index = movie_index(_made(spark, sf_dir, movie_file).withColumnRenamed("payload", "content"))
    each = index.select("id", "length_size", "n_sets", F.posexplode_outer("places").alias("sample", "p"), "error")
    return each.select("id", "length_size", "n_sets", F.col("sample").cast("long").alias("sample"), F.col("p.offset").alias("offset"), F.col("p.size").alias("size"), "error")


def write_movies(spark: SparkSession, sf_dir: str, make: Callable[[int], bytes]) -> str:
    """A folder in the shared one with a movie file for every nation, named by its key."""
    folder = shared_path(spark, "movies")
    ship(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in pieces(batches):
            for key in batch.column("n_nationkey").to_pylist():
                files, at = fs.FileSystem.from_uri(folder)
                files.create_dir(at)
                with files.open_output_stream(f"{at}/{key}.mp4") as out:
                    out.write(make(key))
            yield batch

    table(spark, sf_dir, "nation", "n_nationkey").mapInArrow(write, "n_nationkey int").count()
    return folder


def s5_movie_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movies of nations written as files to the shared folder and read by the data source; sample -1 holds the sets."""
    folder = write_movies(spark, sf_dir, lambda key: movie_file(key + 1, True))
    spark.dataSource.register(Mp4Source)
    rows = spark.read.format("mp4").option("partitions", 2).load(folder)
    byte = lambda at: F.conv(F.hex(F.substring("payload", at, 1)), 16, 10).cast("long")
    return rows.where("sample >= 0").select(movie_key().alias("id"), "sample", "size", byte(1).alias("first"), byte(2).alias("second"))


def movie_key() -> Column:
    """The number that a movie's file is called by."""
    return F.regexp_extract("path", r"(\d+)\.mp4$", 1).cast("long")


def availability_context(pictures: DataFrame) -> DataFrame:
    """Adds ``error``: whether tiles (tiles_w, tiles_h) and slice segments (an array, one for each block) cover a picture of ctb_w x ctb_h blocks."""
    good = (F.col("tiles_w") == F.col("ctb_w")) & (F.col("tiles_h") == F.col("ctb_h")) & (F.size("segments") == F.col("ctb_w") * F.col("ctb_h"))
    return pictures.withColumn("error", F.when(~good, "tile dimensions do not cover picture"))


def n1_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .geometry import part_pictures, with_grid

    p = with_grid(part_pictures(spark, sf_dir))
    k = F.col("pic_id")
    segments = F.sequence(F.lit(1).cast("long"), F.col("ctb_w") * F.col("ctb_h") + F.when(k % 7 == 0, 1).otherwise(0))
    made = p.select("pic_id", "ctb_w", "ctb_h", (F.col("ctb_w") + F.when(k % 5 == 0, 1).otherwise(0)).alias("tiles_w"), (F.col("ctb_h") - F.when(k % 11 == 0, 1).otherwise(0)).alias("tiles_h"), segments.alias("segments"))
    return availability_context(made).select("pic_id", "ctb_w", "ctb_h", "error")


QUERIES = {
    "b1_fixed_widths": b1_fixed_widths, "b5_exp_golomb": b5_exp_golomb, "b7_strings": b7_strings, "b8_trailing_bits": b8_trailing_bits, "b11_substreams": b11_substreams, "b14_decoded_bins": b14_decoded_bins,
    "p5_video_sets": p5_video_sets, "p9_picture_extensions": p9_picture_extensions, "p10_colour_maps": p10_colour_maps, "p11_depth_deltas": p11_depth_deltas, "p12_sequence_extensions": p12_sequence_extensions,
    "p14_usability": p14_usability, "p15_scaling_lists": p15_scaling_lists, "p16_predicted_sets": p16_predicted_sets, "s5_movie_samples": s5_movie_samples, "s6_movie_index": s6_movie_index, "n1_contexts": n1_contexts,
}


def _oracle() -> dict[str, str]:
    from .geometry import PICTURES_SQL

    digits = lambda v, n: f"CASE WHEN {n} > 0 THEN lpad(bin({v}), CAST({n} AS INTEGER), '0') ELSE '' END"
    trailing = "invalid syntax value: bin string has trailing bins"
    wrong = "invalid syntax value: bin string has the wrong length"
    return {
        "b1_fixed_widths": """WITH x AS (SELECT event_id AS id, (event_id * 2654435761 + user_id * 97) % 281474976710656 AS w, CAST(event_id % 17 AS INTEGER) AS a, CAST(user_id % 16 + 1 AS INTEGER) AS b FROM events),
v AS (SELECT *, (w >> (48 - a - b)) % (1::BIGINT << b) AS raw, 48 - a - b AS rest FROM x), s AS (SELECT *, CASE WHEN raw >= (1::BIGINT << (b - 1)) THEN raw - (1::BIGINT << b) ELSE raw END AS i FROM v)
SELECT id, (w >> (48 - a)) || ',' || ((w >> (41 - a)) % 128) || ',' || i || ',' || (a + b) || ',' || rest || ',' || CASE WHEN (a + b) % 8 = 0 THEN 1 ELSE 0 END || ',' || ((w % (1::BIGINT << rest)) << (60 - rest)) AS got,
  'unexpected end: 64 bits wanted, ' || rest || ' left' AS error, i AS native, CASE WHEN b <= 8 THEN (w >> (8 - b)) % (1::BIGINT << b) END AS short FROM s""",
        "b5_exp_golomb": """WITH x AS (SELECT event_id AS id, event_id % 8000 AS one, (user_id % 4000) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS two, event_id % 3 AS three FROM events),
y AS (SELECT *, CASE WHEN two > 0 THEN 2 * two - 1 ELSE -2 * two END AS code FROM x), z AS (SELECT *, 2 * length(bin(one + 1)) - 1 + 2 * length(bin(code + 1)) - 1 AS pos FROM y)
SELECT id, one || ',' || two || ',' || three || ',' || (pos + 2 * length(bin(three + 1)) - 1) AS got, CAST(NULL AS VARCHAR) AS error, one AS first, code AS second, pos AS "end" FROM z""",
        "b7_strings": """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 11 = 0 THEN '1' ELSE '0' END WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN '' ELSE p_name || ',65,0' END AS got,
  CASE WHEN p_partkey % 5 = 0 THEN 'not byte aligned' WHEN p_partkey % 11 = 0 THEN 'invalid utf-8' WHEN p_partkey % 7 = 0 THEN 'missing string terminator' END AS error FROM part""",
        "b8_trailing_bits": """WITH x AS (SELECT p_partkey AS id, 1 + p_partkey % 13 AS n, p_partkey % 6 = 0 AS broken FROM part), y AS (SELECT *, id % (1::BIGINT << CAST(n AS INTEGER)) AS v, 8 * ((n + 8) // 8) AS closed FROM x)
SELECT id, CASE WHEN broken AND v = 1::BIGINT << CAST(n - 1 AS INTEGER) THEN '0,' ELSE '1,' END || v || CASE WHEN broken THEN ',1' ELSE ',0,' || closed || ',' || closed || CASE WHEN id % 10 = 3 THEN '' ELSE ',' || (16 - closed) END END AS got,
  CASE WHEN broken THEN 'invalid alignment bit' WHEN id % 10 = 3 THEN 'arithmetic coding unsupported' END AS error FROM y""",
        "b11_substreams": """WITH x AS (SELECT p_partkey AS id, p_partkey * 2654435761 AS w, p_partkey % 8 AS pos FROM part)
SELECT id, (w >> 61) || CASE WHEN pos > 6 THEN '' ELSE ',2,' || 8 * pos || ',16,' || ((w >> CAST(48 - 8 * pos AS INTEGER)) % 65536) END AS got, CASE WHEN pos > 6 THEN 'unexpected end: substream lies behind the data' END AS error FROM x""",
        "b14_decoded_bins": f"""WITH x AS (SELECT p_partkey AS id, p_size::BIGINT AS v, p_partkey % 60 + 1 AS c, CAST(p_partkey % 4 AS INTEGER) AS r, p_partkey % 9 = 0 AS more FROM part),
w AS (SELECT *, length(bin(c)) AS n, length(bin(c + 1)) - 1 AS k, length(bin(v // (1 << r) + 1)) - 1 AS o FROM x), u AS (SELECT *, (2 << k) - (c + 1) AS short, v - ((1 << o) - 1) * (1 << r) AS rest, least(o, 13) AS p FROM w),
b AS (SELECT *, {digits("v", "n")} AS fl, CASE WHEN v < short THEN {digits("v", "k")} ELSE {digits("(v + short)", "(k + 1)")} END AS tb,
  repeat('1', v >> r) || CASE WHEN v < c THEN '0' || {digits("(v % (1 << r))", "r")} ELSE '' END AS tr, repeat('1', o) || '0' || {digits("rest", "(o + r)")} AS eg FROM u),
s AS (SELECT id, 'FL' AS scheme, fl AS bins, v, v <= c AS fits, more, '{wrong}' AS why, NULL::BIGINT AS other FROM b
  UNION ALL SELECT id, 'TB', tb, v, v <= c, more, CASE WHEN v >= short THEN '{wrong}' END, CASE WHEN v < short THEN (2 * v - short + 4294967296) % 4294967296 END FROM b
  UNION ALL SELECT id, 'TR', tr, v, v <= c, more, '{wrong}', NULL FROM b UNION ALL SELECT id, 'EG', eg, v, TRUE, more, '{trailing}', NULL FROM b UNION ALL SELECT id, 'LEG', eg, v, TRUE, more, '{trailing}', NULL FROM b)
SELECT id, scheme, CASE WHEN fits THEN bins END AS bins, CASE WHEN fits THEN CASE WHEN more THEN other ELSE v END END AS back,
  CASE WHEN NOT fits THEN 'invalid syntax value: value exceeds its maximum' WHEN more THEN why END AS error FROM s""",
        "p5_video_sets": """SELECT p_partkey AS id, p_partkey % 16 AS set_id, p_partkey % 100 AS sub_level, p_partkey % 3 AS reorder, 3::BIGINT AS latency, p_partkey % 4 + 1 AS n_layers, 1000 + p_partkey AS ticks,
  CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 9 END AS poc_ticks, p_partkey % 16 AS rate_scale, p_partkey % 32 AS au_length, p_partkey % 6 + 1 AS duration, p_partkey + 1 AS rate, CAST(NULL AS VARCHAR) AS error FROM part""",
        "p14_usability": """SELECT p_partkey AS id, p_partkey % 60000 AS sar_width, p_partkey % 6 AS video_format, p_partkey % 18 AS transfer, p_partkey % 6 AS loc_top, p_partkey % 2 AS neutral, p_partkey % 7 AS window, 24000 + p_partkey AS time_scale,
  p_partkey % 200 AS divisor, 7::BIGINT AS cpb_du, p_partkey % 17 AS cu_bits, 8::BIGINT AS mv_vertical, CAST(NULL AS VARCHAR) AS error FROM part""",
        "p15_scaling_lists": """WITH m AS (SELECT p_partkey AS id, unnest(range(20)) AS i FROM part), s AS (SELECT *, least(i // 6, 3) AS size_id, CASE WHEN i < 18 THEN i % 6 ELSE (i - 18) * 3 END AS matrix_id, (i + id) % 2 = 1 AS own FROM m),
c AS (SELECT *, unnest(range(least(64, 16 << CAST(2 * size_id AS INTEGER)))) AS k FROM s WHERE own), d AS (SELECT id, i, k, ((CASE WHEN size_id > 1 THEN id % 17 ELSE 8 END + sum((7 * k + id + i) % 11 - 5) OVER (PARTITION BY id, i ORDER BY k)) % 256 + 256) % 256 AS v FROM c),
t AS (SELECT id, i, min_by(v, k)::BIGINT AS first, max_by(v, k)::BIGINT AS last, sum(v)::BIGINT AS total FROM d GROUP BY id, i)
SELECT s.id, s.i, size_id, matrix_id, CASE WHEN NOT own THEN s.i % 3 END AS delta, first, last, total FROM s LEFT JOIN t ON t.id = s.id AND t.i = s.i""",
        "p16_predicted_sets": """SELECT p_partkey AS id, p_partkey % 2 AS sign, p_partkey % 5 AS delta_minus1, 0::BIGINT AS from_set,
  len(list_filter(range(2 + p_partkey % 3 + p_partkey % 2), lambda k: (p_partkey + k) % 2 = 1 OR (p_partkey // 2 + k) % 2 = 1))::BIGINT AS n_deltas, 2 + p_partkey % 3 + p_partkey % 2 AS n_entries, CAST(NULL AS VARCHAR) AS error FROM part""",
        "p9_picture_extensions": """SELECT p_partkey AS id, p_partkey % 3 AS skip_size, p_partkey % 13 - 6 AS first_cb, p_partkey % 5 AS second_cr, p_partkey % 64 AS ref_layer, p_partkey % 9 - 4 AS "offset", p_partkey % 4 AS phase, p_partkey % 256 AS depth,
  (p_partkey + 1) % 6 AS depth_step, p_partkey % 11 - 5 AS act, CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 3 END::BIGINT AS n_components, p_partkey % 256 AS entry, CAST(NULL AS VARCHAR) AS error FROM part""",
        "p10_colour_maps": """WITH o AS (SELECT p_partkey AS id, p_partkey % 2 = 1 AS split, unnest(range(CASE WHEN p_partkey % 2 = 1 THEN 8 ELSE 1 END)) AS i FROM part)
SELECT id, CASE WHEN split THEN CAST(i AS VARCHAR) ELSE '' END AS path, CASE WHEN split THEN 1 ELSE 0 END::BIGINT AS depth, CASE WHEN split THEN i // 4 ELSE 0 END AS y, CASE WHEN split THEN i // 2 % 2 ELSE 0 END AS cb, CASE WHEN split THEN i % 2 ELSE 0 END AS cr,
  4::BIGINT AS n_vertices, len(list_filter(range(4), lambda k: (id + 4 * i + k) % 3 = 0))::BIGINT AS n_coded FROM o""",
        "p11_depth_deltas": """WITH x AS (SELECT p_partkey AS id, 2 + p_partkey % 4 AS n, CASE WHEN p_partkey % 4 > 0 THEN 1 + p_partkey % 20 ELSE 20 END AS least FROM part)
SELECT id, n, 20::BIGINT AS max_diff, CASE WHEN n > 2 THEN least - 1 END AS min_minus1, id % 256 AS val0, CASE WHEN least < 20 THEN array_to_string(list_transform(range(n - 1), lambda k: (id + k) % (20 - least + 1)), ',') END AS steps, CAST(NULL AS VARCHAR) AS error FROM x""",
        "p12_sequence_extensions": """SELECT p_partkey AS id, (p_partkey % 512) >> 8 AS rotation, p_partkey % 2 AS alignment, p_partkey % 2 AS vertical, p_partkey % 3 AS sub_pb, p_partkey % 2 AS skip_intra, p_partkey % 64 AS palette_size, p_partkey % 256 AS luma,
  p_partkey % 1024 AS chroma, p_partkey % 3 AS mv_control, CAST(NULL AS VARCHAR) AS error FROM part""",
        "s6_movie_index": """WITH m AS (SELECT p_partkey AS id, p_partkey % 13 <> 0 AS whole FROM part), s AS (SELECT id, unnest(range(3 + id % 5)) AS sample FROM m WHERE whole), z AS (SELECT *, 2 * (1 + (id + sample) % 9) AS size FROM s)
SELECT id, id % 4 + 1 AS length_size, id % 3 AS n_sets, sample, CAST(20 + coalesce(sum(size) OVER (PARTITION BY id ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", size, CAST(NULL AS VARCHAR) AS error FROM z
UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, 'no moov box' FROM m WHERE NOT whole""",
        "s5_movie_samples": """WITH s AS (SELECT n_nationkey::BIGINT AS id, n_nationkey + 1 AS key, unnest(range(3 + (n_nationkey + 1) % 5)) AS sample FROM nation WHERE TRUE)
SELECT id, sample, 2 * (1 + (key + sample) % 9) AS size, key::BIGINT AS first, sample AS second FROM s""",
        "n1_contexts": f"""WITH {PICTURES_SQL} SELECT pic_id, ctb_w, ctb_h, CASE WHEN pic_id % 5 = 0 OR pic_id % 7 = 0 OR pic_id % 11 = 0 THEN 'tile dimensions do not cover picture' END AS error FROM grid""",
    }


ORACLE = _oracle()
