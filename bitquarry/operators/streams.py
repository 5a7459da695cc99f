"""Queries over coded streams: framing, headers, parameter sets, slices, bin strings and sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arith import div
from ..plans.dialect import duck_sql, spark_sql
from ..sources.bitstream import byte_stream, field, header_fields, nal_units, parse_units, sample_units, slice_headers
from ..sources.synthetic import part_streams
from ..sources.tables import table


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_units(nal_units(part_streams(spark, sf_dir)))


def s1_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of units of each stream, and of those that don't parse."""
    return parsed(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("n_units"), F.count("error").alias("n_errors"))


def s2_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams joined again from their units and split once more give the same units."""
    units = nal_units(part_streams(spark, sf_dir))
    again = nal_units(byte_stream(units)).withColumnRenamed("unit", "second")
    same = units.join(again.select("stream_id", "nal_idx", "second"), ["stream_id", "nal_idx"], "full")
    return same.groupBy("stream_id").agg(F.count("*").alias("n_units"), F.sum(F.when(F.col("unit") == F.col("second"), 1).otherwise(0)).alias("n_same"))


def s4_length_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units behind their lengths, split again; every seventh sample is cut short and is an error."""
    units = nal_units(part_streams(spark, sf_dir))
    padded = F.concat(F.lpad(F.hex(F.length("unit")), 8, "0"), F.hex("unit"))
    whole = units.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nal_idx", padded.alias("hex")))), lambda p: p["hex"]), "").alias("hex"))
    sample = whole.select("stream_id", F.unhex(F.when(F.col("stream_id") % 7 == 0, F.expr("left(hex, length(hex) - 2)")).otherwise(F.col("hex"))).alias("payload"))
    return sample_units(sample, 4).groupBy("stream_id").agg(F.count("unit").alias("n_units"), F.max("error").alias("error"))


def p1_unit_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen bits of every event read as a unit header."""
    e = table(spark, sf_dir, "events", "event_id", "user_id")
    word = (F.col("event_id") * 2654435 + F.col("user_id") * 97) % 65536
    return e.select("event_id", *(c.alias(n) for n, c in header_fields(word).items()))


def p6_sequence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(spark, sf_dir).where("kind = 'sps'")
    numbers = ("sps_video_parameter_set_id", "sps_seq_parameter_set_id", "pic_width_in_luma_samples", "pic_height_in_luma_samples", "log2_diff_max_min_luma_coding_block_size")
    return p.select("stream_id", *(field(n).alias(n) for n in numbers), field("profile_tier_level.general_profile.profile_idc").alias("profile_idc"), field("profile_tier_level.general_level_idc").alias("level_idc"),
                    field("conformance_window[3]").alias("window_last"), field("short_term_ref_pic_sets[0].num_delta_pocs").alias("n_deltas"))


def p8_picture_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(spark, sf_dir).where("kind = 'pps'")
    numbers = ("pps_pic_parameter_set_id", "pps_seq_parameter_set_id", "init_qp_minus26", "diff_cu_qp_delta_depth", "pps_cb_qp_offset", "pps_cr_qp_offset")
    return p.select("stream_id", *(field(n).alias(n) for n in numbers), field("tiles.num_tile_columns_minus1").alias("tile_columns_minus1"))


def p17_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, delimiters and filler by stream."""
    p = parsed(spark, sf_dir)
    pick = lambda kind, path: F.max(F.when(F.col("kind") == kind, field(path)))
    return p.groupBy("stream_id").agg(pick("sei", "messages[0].payload_type").alias("sei_type"), pick("aud", "pic_type").alias("pic_type"), pick("filler", "filler_byte_count").alias("n_filler"))


def p19_slice_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice headers, read with the sets that are active at them."""
    h = slice_headers(parsed(spark, sf_dir))
    get = lambda path: field(path, column="header")
    return h.select("stream_id", "nal_idx", get("slice_pic_parameter_set_id").alias("pps_id"), get("independent.slice_type").alias("slice_type"), get("independent.slice_pic_order_cnt_lsb").alias("poc_lsb"), get("independent.slice_qp_delta").alias("qp_delta"), "error")


def b6_signed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exp-Golomb code numbers as signed values and back."""
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    code = F.col("l_partkey") * 3 + F.col("l_linenumber")
    value = F.when(code % 2 == 1, div(code + 1, 2)).otherwise(-div(code, 2))
    rows = line.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), code.cast("long").alias("code"), value.alias("value"))
    return rows.withColumn("back", F.when(F.col("value") > 0, F.col("value") * 2 - 1).otherwise(-F.col("value") * 2))


def bits_of(value: Column, n: Column) -> Column:
    return F.when(n > 0, F.lpad(F.bin(value), n.cast("int"), "0")).otherwise("")


def bin_width(c_max: Column) -> Column:
    """Bits of the largest value; none where that is 0."""
    return F.when(c_max > 0, F.length(F.bin(c_max))).otherwise(0)


def fixed_bins(value: Column, c_max: Column) -> Column:
    return F.when(value <= c_max, bits_of(value, bin_width(c_max)))


def truncated_binary(value: Column, c_max: Column) -> Column:
    k = F.length(F.bin(c_max + 1)) - 1
    short = F.call_function("shiftleft", F.lit(2).cast("long"), k) - (c_max + 1)
    return F.when(value <= c_max, F.when(value < short, bits_of(value, k)).otherwise(bits_of(value + short, k + 1)))


def truncated_rice(value: Column, c_max: Column, rice: Column) -> Column:
    prefix = F.call_function("shiftright", value, rice.cast("int"))
    low = value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), rice.cast("int")) - 1)
    return F.when(value <= c_max, F.concat(F.repeat(F.lit("1"), prefix.cast("int")), F.when(value < c_max, F.concat(F.lit("0"), bits_of(low, rice))).otherwise("")))


def exp_golomb(value: Column, order: Column) -> Column:
    """The prefix has as many ones as the scaled value plus one has bits, less one."""
    scale = F.call_function("shiftleft", F.lit(1).cast("long"), order.cast("int"))
    ones = F.length(F.bin(div(value, scale) + 1)) - 1
    rest = value - (F.call_function("shiftleft", F.lit(1).cast("long"), ones) - 1) * scale
    return F.concat(F.repeat(F.lit("1"), ones), F.lit("0"), bits_of(rest, ones + order))


def b13_bin_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    v, c = F.col("p_size").cast("long"), F.col("p_partkey") % 60 + 1
    return p.select("p_partkey", fixed_bins(v, c).alias("fl"), truncated_binary(v, c).alias("tb"), truncated_rice(v, c, F.col("p_partkey") % 4).alias("tr"), exp_golomb(v, F.col("p_partkey") % 4).alias("eg"))


_BYTES = "EACH(n, i, CASE WHEN AT(z, i) % 5 < 3 THEN 0 WHEN AT(z, i) % 5 = 3 THEN 3 ELSE AT(z, i) % 256 END)"


def b12_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte lists made of zeros and threads of 3s, without the 3s that stand behind two zeros."""
    rows = _byte_lists(spark, sf_dir).selectExpr("vec_id", f"{spark_sql(_BYTES)} as raw")
    kept = "filter(raw, (b, k) -> not (b = 3 and k >= 2 and get(raw, k - 1) = 0 and get(raw, k - 2) = 0))"
    return rows.selectExpr("vec_id", "size(raw) as n", f"{kept} as kept").selectExpr("vec_id", "cast(n as bigint) as n", "cast(size(kept) as bigint) as n_kept", "array_join(transform(kept, k -> cast(k as string)), ',') as kept")


def _byte_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n, z): a number for every component of the vectors."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").where("embedding is not null")
    return e.selectExpr("vec_id", "cast(size(embedding) as bigint) as n", "transform(embedding, v -> cast(floor(abs(cast(v as double)) * 1000) as bigint) + vec_id % 7) as z")


def plain_offsets(payloads: DataFrame) -> DataFrame:
    """(id, i, plain): where each byte of escaped payloads (id, i, byte) lies once unescaped; a byte that goes has the
    place of the one behind it. A running count of the 3s that stand behind two zeros."""
    w = Window.partitionBy("id").orderBy("i")
    gone = (F.col("byte") == 3) & (F.lag("byte", 1, 1).over(w) == 0) & (F.lag("byte", 2, 1).over(w) == 0)
    before = F.sum(F.when(F.col("gone"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return payloads.withColumn("gone", gone).select("id", "i", (F.col("i") - F.coalesce(before, F.lit(0))).cast("long").alias("plain"))


def x10_plain_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_offsets(_byte_lists(spark, sf_dir).selectExpr("vec_id as id", f"posexplode({spark_sql(_BYTES)}) as (i, byte)").withColumn("i", F.col("i").cast("long")))


def sample_table(chunks: DataFrame, runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(track, chunk, sample, offset, size): where each sample of a track lies.

    chunks (track, chunk, base), runs (track, first_chunk, per_chunk) and sizes (track, sample, size), all counted
    from 0: a chunk holds as many samples as the last run that begins at it or before says (one without a run), and
    samples lie one behind the other in their chunk. An as-of step, running sums and one range by equal keys.
    """
    both = chunks.select("track", "chunk", "base", F.lit(None).cast("long").alias("per_chunk")).unionByName(runs.select("track", F.col("first_chunk").alias("chunk"), F.lit(None).cast("long").alias("base"), "per_chunk"))
    upto = Window.partitionBy("track").orderBy("chunk", F.col("base").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("n", F.coalesce(F.last("per_chunk", ignorenulls=True).over(upto), F.lit(1))).where("base is not null")
    before = Window.partitionBy("track").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    spread = filled.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 0")
    spread = spread.select("track", "chunk", "base", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("sample"))
    inside = Window.partitionBy("track", "chunk").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.join(sizes, ["track", "sample"])
    return placed.select("track", "chunk", "sample", (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("offset"), "size")


def s8_sample_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tracks, their orders as chunks, and the line items of a nation's parts as sample sizes."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    chunk = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    chunks = orders.select(F.col("o_custkey").alias("track"), chunk.cast("long").alias("chunk"), F.floor("o_totalprice").cast("long").alias("base"))
    runs = chunks.where("chunk % 3 = 1").select("track", F.col("chunk").alias("first_chunk"), (F.col("track") % 3 + F.col("chunk") % 2).alias("per_chunk"))
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_partkey", "l_suppkey", "l_linenumber").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("track")), "l_orderkey")
    sample = F.row_number().over(Window.partitionBy("track").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    sizes = line.select("track", sample.cast("long").alias("sample"), F.col("l_quantity").cast("long").alias("size"))
    return sample_table(chunks, runs, sizes)


def s10_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth second of a stream of 24 frames a second, frames being a user's events."""
    e = table(spark, sf_dir, "events", "event_id", "user_id")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select("user_id", "event_id", frame.cast("long").alias("frame")).where(F.col("frame") % (24 * 5) == 0)


def s11_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 frames whose chroma planes are quarters of other samples of the plane."""
    from .planes import frame_to_rgb, planes8

    p = planes8(spark, sf_dir)
    return frame_to_rgb(p.select(F.col("plane_id").alias("frame_id"), "width", "height", F.col("samples").alias("luma"), F.slice("samples", 1, 16).alias("cb"), F.slice("samples", 17, 16).alias("cr")))


QUERIES = {
    "s1_units": s1_units, "s2_round_trip": s2_round_trip, "s4_length_prefixed": s4_length_prefixed, "s8_sample_table": s8_sample_table, "s10_every_nth": s10_every_nth, "s11_rgb": s11_rgb,
    "p1_unit_headers": p1_unit_headers, "p6_sequence_sets": p6_sequence_sets, "p8_picture_sets": p8_picture_sets, "p17_messages": p17_messages, "p19_slice_headers": p19_slice_headers,
    "b6_signed_codes": b6_signed_codes, "b12_unescape": b12_unescape, "b13_bin_strings": b13_bin_strings, "x10_plain_offsets": x10_plain_offsets,
}


def _oracle() -> dict[str, str]:
    from .planes import PLANES8_SQL

    bits = lambda v, n: f"CASE WHEN {n} > 0 THEN lpad(bin({v}), CAST({n} AS INTEGER), '0') ELSE '' END"
    round_f = lambda f: f"CAST(least(255, greatest(0, round(CAST(l AS FLOAT) + {f}))) AS BIGINT)"
    return {
        "s1_units": "SELECT p_partkey AS stream_id, 8 + 1 + p_partkey % 4 AS n_units, 1::BIGINT AS n_errors FROM part",
        "s2_round_trip": "SELECT p_partkey AS stream_id, 9 + p_partkey % 4 AS n_units, 9 + p_partkey % 4 AS n_same FROM part",
        "s4_length_prefixed": "SELECT p_partkey AS stream_id, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 9 + p_partkey % 4 END AS n_units, CASE WHEN p_partkey % 7 = 0 THEN 'invalid syntax value: invalid length-prefixed NAL' END AS error FROM part",
        "s8_sample_table": """WITH c AS (SELECT o_custkey AS track, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS chunk, CAST(floor(o_totalprice) AS BIGINT) AS base FROM orders),
r AS (SELECT track, chunk AS first_chunk, track % 3 + chunk % 2 AS per_chunk FROM c WHERE chunk % 3 = 1),
n AS (SELECT c.*, coalesce(r.per_chunk, 1) AS n FROM c ASOF LEFT JOIN r ON c.track = r.track AND c.chunk >= r.first_chunk),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY track ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM n),
x AS (SELECT track, chunk, base, unnest(range(CAST(start AS BIGINT), CAST(start + n AS BIGINT))) AS sample FROM s),
z AS (SELECT o_custkey AS track, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS sample, CAST(l_quantity AS BIGINT) AS size FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT x.track, chunk, x.sample, CAST(base + coalesce(sum(size) OVER (PARTITION BY x.track, chunk ORDER BY x.sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", size
FROM x JOIN z ON z.track = x.track AND z.sample = x.sample""",
        "s10_every_nth": "SELECT user_id, event_id, frame FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM events) WHERE frame % 120 = 0",
        "s11_rgb": f"""WITH {PLANES8_SQL}, x AS (SELECT plane_id AS frame_id, i % 8 AS x, i // 8 AS y, samples[i + 1] AS l, CAST(samples[(i // 16) * 4 + (i % 8) // 2 + 1] - 128 AS FLOAT) AS u, CAST(samples[16 + (i // 16) * 4 + (i % 8) // 2 + 1] - 128 AS FLOAT) AS v
  FROM (SELECT *, unnest(range(64)) AS i FROM planes8))
SELECT frame_id, x, y, {round_f("CAST(1.402 AS FLOAT) * v")} AS r, {round_f("(-(CAST(0.344136 AS FLOAT) * u) - CAST(0.714136 AS FLOAT) * v)")} AS g, {round_f("CAST(1.772 AS FLOAT) * u")} AS b FROM x""",
        "p1_unit_headers": """WITH x AS (SELECT event_id, (event_id * 2654435 + user_id * 97) % 65536 AS w FROM events)
SELECT event_id, (w // 512) % 64 AS nal_type, (w // 8) % 64 AS layer_id, w % 8 AS tid_plus1, CASE WHEN w >= 32768 THEN 'forbidden_zero_bit is not zero' WHEN w % 8 = 0 THEN 'nuh_temporal_id_plus1 is not greater than zero' END AS error FROM x""",
        "p6_sequence_sets": """SELECT p_partkey AS stream_id, p_partkey % 16 AS sps_video_parameter_set_id, p_partkey % 4 AS sps_seq_parameter_set_id, 8 * p_size::BIGINT AS pic_width_in_luma_samples, 8 * (1 + p_partkey % 40) AS pic_height_in_luma_samples,
  1 + p_partkey % 3 AS log2_diff_max_min_luma_coding_block_size, 1 + p_partkey % 3 AS profile_idc, 30 + p_partkey % 90 AS level_idc, CASE WHEN p_partkey % 2 = 1 THEN 3 END::BIGINT AS window_last, 3::BIGINT AS n_deltas FROM part""",
        "p8_picture_sets": """SELECT p_partkey AS stream_id, p_partkey % 8 AS pps_pic_parameter_set_id, p_partkey % 4 AS pps_seq_parameter_set_id, p_partkey % 11 - 5 AS init_qp_minus26, CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 3 END AS diff_cu_qp_delta_depth,
  p_partkey % 7 - 3 AS pps_cb_qp_offset, 3 - p_partkey % 7 AS pps_cr_qp_offset, CASE WHEN (1 + p_partkey % 3) * (1 + p_partkey % 2) > 1 THEN p_partkey % 3 END AS tile_columns_minus1 FROM part""",
        "p17_messages": "SELECT p_partkey AS stream_id, p_partkey % 200 AS sei_type, p_partkey % 3 AS pic_type, p_partkey % 5 AS n_filler FROM part",
        "p19_slice_headers": """SELECT p_partkey AS stream_id, 5 + k AS nal_idx, p_partkey % 8 AS pps_id, 2::BIGINT AS slice_type, (p_partkey + k) % 256 AS poc_lsb, (p_partkey + k) % 9 - 4 AS qp_delta, CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, unnest(range(1 + p_partkey % 4)) AS k FROM part)""",
        "b6_signed_codes": """WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey * 3 + l_linenumber AS code FROM lineitem),
v AS (SELECT *, CASE WHEN code % 2 = 1 THEN (code + 1) // 2 ELSE -(code // 2) END AS value FROM x) SELECT *, CASE WHEN value > 0 THEN value * 2 - 1 ELSE -value * 2 END AS back FROM v""",
        "b12_unescape": f"""WITH z AS (SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda v: CAST(floor(abs(CAST(v AS DOUBLE)) * 1000) AS BIGINT) + vec_id % 7) AS z FROM embeddings WHERE embedding IS NOT NULL),
r AS (SELECT vec_id, {duck_sql(_BYTES)} AS raw FROM z), i AS (SELECT vec_id, raw, unnest(range(len(raw))) AS i FROM r), b AS (SELECT vec_id, i, raw[i + 1] AS b FROM i),
s AS (SELECT *, sum(CASE WHEN b <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM b),
k AS (SELECT vec_id, i, b, b = 3 AND coalesce(i - 1 - max(CASE WHEN b <> 0 THEN i END) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), i) >= 2 AS gone FROM s)
SELECT vec_id, count(*) AS n, count(*) FILTER (NOT gone) AS n_kept, string_agg(CAST(b AS VARCHAR), ',' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY vec_id""",
        "x10_plain_offsets": f"""WITH z AS (SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda v: CAST(floor(abs(CAST(v AS DOUBLE)) * 1000) AS BIGINT) + vec_id % 7) AS z FROM embeddings WHERE embedding IS NOT NULL),
r AS (SELECT vec_id AS id, {duck_sql(_BYTES)} AS raw FROM z), i AS (SELECT id, raw, unnest(range(len(raw))) AS i FROM r)
SELECT id, i, i - len(list_filter(range(i), lambda k: k >= 2 AND raw[k + 1] = 3 AND raw[k] = 0 AND raw[k - 1] = 0)) AS plain FROM i""",
        "b13_bin_strings": f"""WITH x AS (SELECT p_partkey, p_size::BIGINT AS v, p_partkey % 60 + 1 AS c, p_partkey % 4 AS r FROM part),
w AS (SELECT *, length(bin(c)) AS n, length(bin(c + 1)) - 1 AS k, length(bin(v // (1 << r) + 1)) - 1 AS o FROM x), u AS (SELECT *, (2 << k) - (c + 1) AS short, v - ((1 << o) - 1) * (1 << r) AS rest FROM w)
SELECT p_partkey, CASE WHEN v <= c THEN {bits("v", "n")} END AS fl, CASE WHEN v <= c THEN CASE WHEN v < short THEN {bits("v", "k")} ELSE {bits("(v + short)", "(k + 1)")} END END AS tb,
  CASE WHEN v <= c THEN repeat('1', v >> r) || CASE WHEN v < c THEN '0' || {bits("(v % (1 << r))", "r")} ELSE '' END END AS tr, repeat('1', o) || '0' || {bits("rest", "(o + r)")} AS eg FROM u""",
    }


ORACLE = _oracle()
