"""Parameter sets: the ones active at a slice, and the profile rules that they must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arith import ceil_div, div, power2
from ..sources.bitstream import as_of
from ..sources.tables import table
from .geometry import uniform_sizes

# Profiles with their numbers, largest bit depth above 8, and whether they hold a single picture.
PROFILES = {"Main": (1, 0, False), "Main 10": (2, 2, False), "Main Still Picture": (3, 0, True), "Main 10 Still Picture": (2, 2, True)}
# Tools that the profiles forbid, in the order in which they are looked at.
SPS_TOOLS = (
    "transform_skip_rotation_enabled_flag", "transform_skip_context_enabled_flag", "implicit_rdpcm_enabled_flag", "explicit_rdpcm_enabled_flag", "extended_precision_processing_flag",
    "intra_smoothing_disabled_flag", "high_precision_offsets_enabled_flag", "persistent_rice_adaptation_enabled_flag", "cabac_bypass_alignment_enabled_flag",
    "sps_curr_pic_ref_enabled_flag", "palette_mode_enabled_flag", "motion_vector_resolution_control_idc", "intra_boundary_filtering_disabled_flag",
)
PPS_TOOLS = ("log2_max_transform_skip_block_size_minus2", "chroma_qp_offset_list_enabled_flag", "residual_adaptive_colour_transform_enabled_flag")
#: Smallest tile in luma samples.
MIN_TILE_WIDTH, MIN_TILE_HEIGHT = 256, 64


def profile_of(idc: Column, compatible: Column, one_picture: Column) -> Column:
    """The profile that a sequence set indicates, by its number or a compatibility flag; null if none."""
    is_ = lambda k: (idc == k) | F.array_contains(compatible, F.lit(k).cast("long"))
    return (
        F.when(is_(3), "Main Still Picture")
        .when(is_(2), F.when(one_picture, "Main 10 Still Picture").otherwise("Main 10"))
        .when(is_(1), "Main")
    )


def first_set(flags: dict[str, Column]) -> Column:
    """The name of the first flag that is set, null if none."""
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in flags.items()))


def raw_ctu_bits(ctb: Column, depth_luma: Column, depth_chroma: Column) -> Column:
    half = div(ctb, 2)
    return ctb * ctb * depth_luma + 2 * half * half * depth_chroma


def tile_error(sizes: Column, smallest: int, name: str) -> Column:
    """The first size below the smallest, as a message."""
    low = F.filter(F.transform(sizes, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: x["s"] < smallest)
    return F.when(F.size(low) > 0, F.format_string(f"{name} %d is %d samples", F.get(low, 0)["i"], F.get(low, 0)["s"]))


def profile_rules(sets: DataFrame) -> DataFrame:
    """Adds ``violation``: the first rule that a row of parameter-set fields breaks, and ``violations``: all of them.

    Rules in order: profile indicated, one picture, base layer, chroma format, bit depths, forbidden tools of the
    sequence and the picture set, tiles with wavefronts, block size, still-picture buffering, tile sizes.
    """
    c = F.col
    depth = F.when(c("profile").isin("Main", "Main Still Picture"), 0).otherwise(2)
    log2 = c("log2_min_cb_minus3") + c("log2_diff_cb") + 3
    ctb = power2(log2)
    columns = F.when(c("tiles"), uniform_sizes(ceil_div("width", ctb), c("tile_columns"))).otherwise(F.array(ceil_div("width", ctb)))
    rows = F.when(c("tiles"), uniform_sizes(ceil_div("height", ctb), c("tile_rows"))).otherwise(F.array(ceil_div("height", ctb)))
    good_size = log2.between(4, 6)
    rules = [
        F.when(c("profile").isNull(), "profile not indicated"),
        F.when((c("profile") == "Main 10 Still Picture") & ~c("one_picture"), "one-picture flag required"),
        F.when(~c("base_internal") | ~c("base_available"), "base layer flags"),
        F.when(c("chroma") != 1, F.format_string("chroma format %d", c("chroma"))),
        F.when(c("luma_minus8") > depth, F.format_string("luma bit depth %d", c("luma_minus8"))),
        F.when(c("chroma_minus8") > depth, F.format_string("chroma bit depth %d", c("chroma_minus8"))),
        F.concat(F.lit("forbidden tool "), first_set({n: F.get("sps_tools", i) for i, n in enumerate(SPS_TOOLS)})),
        F.concat(F.lit("forbidden tool "), first_set({n: F.get("pps_tools", i) for i, n in enumerate(PPS_TOOLS)})),
        F.when(c("tiles") & c("wavefront"), "tiles with entropy-coding sync"),
        F.when(~good_size, F.format_string("block size %d", log2)),
        F.when(c("profile").like("%Still%") & (c("buffering") != 0), F.format_string("still-picture buffering %d", c("buffering"))),
        F.when(good_size & c("tiles"), tile_error(F.transform(columns, lambda s: s * ctb), MIN_TILE_WIDTH, "tile column")),
        F.when(good_size & c("tiles"), tile_error(F.transform(rows, lambda s: s * ctb), MIN_TILE_HEIGHT, "tile row")),
    ]
    all_ = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return sets.withColumn("violations", all_).withColumn("violation", F.coalesce(*rules)).withColumn("raw_ctu_bits", raw_ctu_bits(ctb, c("luma_minus8") + 8, c("chroma_minus8") + 8))


def part_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pairs of parameter sets; most keep the rules, their keys say which one is broken."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    rows = p.select(
        k.alias("set_id"),
        (1 + k % 5).alias("idc"),
        F.array(k % 7).alias("compatible"),
        (k % 3 == 0).alias("one_picture"),
        (k % 29 != 0).alias("base_internal"),
        (k % 31 != 0).alias("base_available"),
        F.when(k % 23 == 0, 2).otherwise(1).cast("long").alias("chroma"),
        F.when(k % 6 == 0, 2).otherwise(0).cast("long").alias("luma_minus8"),
        F.when(k % 10 == 0, 3).otherwise(0).cast("long").alias("chroma_minus8"),
        F.array(*(k % (41 + i) == 0 for i in range(len(SPS_TOOLS)))).alias("sps_tools"),
        F.array(*(k % (61 + i) == 0 for i in range(len(PPS_TOOLS)))).alias("pps_tools"),
        (k % 4 == 1).alias("tiles"),
        (k % 13 == 0).alias("wavefront"),
        (k % 2).alias("log2_min_cb_minus3"),
        (k % 5).alias("log2_diff_cb"),
        (k % 2).alias("buffering"),
        (s * 40 + 100).alias("width"),
        (s * 20 + 60).alias("height"),
        (1 + k % 3).alias("tile_columns"),
        (1 + k % 2).alias("tile_rows"),
    )
    return rows.withColumn("profile", profile_of(F.col("idc"), F.col("compatible"), F.col("one_picture")))


def read_bits_violation(units: DataFrame) -> DataFrame:
    """(set_id, ctu, calls): the first coding-tree unit that was read in over five thirds of its raw bits, if any."""
    over = units.where("calls * 3 > raw_ctu_bits * 5")
    return over.groupBy("set_id").agg(F.min(F.struct("ctu", "calls")).alias("first")).select("set_id", "first.ctu", "first.calls")


def j1_active_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a coded stream: sign-ups are picture sets, purchases sequence sets, views slices."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("nal_idx"), "event_type", F.floor("value").cast("long").alias("v"))
    pps = e.where("event_type = 'signup'").select("stream_id", "nal_idx", F.pmod("v", F.lit(4)).cast("long").alias("pps_id"), F.struct(F.col("nal_idx").alias("at"), F.pmod("nal_idx", F.lit(3)).cast("long").alias("sps_id")).alias("pps"))
    sps = e.where("event_type = 'purchase'").select("stream_id", "nal_idx", F.pmod("v", F.lit(3)).cast("long").alias("sps_id"), F.col("nal_idx").alias("sps_at"))
    slices = e.where("event_type = 'view'").select("stream_id", "nal_idx", F.pmod("v", F.lit(4)).cast("long").alias("pps_id"))
    with_pps = as_of(slices, pps, "pps_id", "pps").select("stream_id", "nal_idx", "pps_id", F.col("pps.at").alias("pps_at"), F.col("pps.sps_id").alias("sps_id"))
    return as_of(with_pps, sps, "sps_id", "sps_at").select("stream_id", "nal_idx", "pps_id", "pps_at", "sps_id", "sps_at")


def v1_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_sets(spark, sf_dir).select("set_id", "idc", "profile")


def v2_profile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_rules(part_sets(spark, sf_dir)).select("set_id", "violation", F.size("violations").cast("long").alias("n_violations"), "raw_ctu_bits")


def v7_read_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as coding-tree units of their part's picture."""
    line = table(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    units = line.join(profile_rules(part_sets(spark, sf_dir)).select(F.col("set_id").alias("l_partkey"), "raw_ctu_bits"), "l_partkey")
    return read_bits_violation(units.select(F.col("l_partkey").alias("set_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ctu"), F.floor(F.col("l_extendedprice") * 3).cast("long").alias("calls"), "raw_ctu_bits"))


def v8_picture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Still-picture sets whose part has other than one line item."""
    n = table(spark, sf_dir, "lineitem", "l_partkey").groupBy(F.col("l_partkey").alias("set_id")).agg(F.count("*").alias("n_pics"))
    return part_sets(spark, sf_dir).join(n, "set_id").where("profile like '%Still%' and n_pics <> 1").select("set_id", "profile", "n_pics")


def v9_buffering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buffering of the highest sub-layer: the last of as many entries as layers, or the only one; else null."""
    e = table(spark, sf_dir, "embeddings", "vec_id")
    entries = F.transform(F.sequence(F.lit(1), (F.col("vec_id") % 4 + 1).cast("int")), lambda i: (i * 7 + F.col("vec_id")) % 16)
    n, layers = F.size("entries"), F.col("vec_id") % 3 + 1
    value = F.when((n == layers) | (n == 1), F.element_at("entries", -1))
    return e.select("vec_id", entries.alias("entries")).select("vec_id", value.cast("long").alias("buffering"))


QUERIES = {"j1_active_sets": j1_active_sets, "v1_profiles": v1_profiles, "v2_profile_rules": v2_profile_rules, "v7_read_bits": v7_read_bits, "v8_picture_counts": v8_picture_counts, "v9_buffering": v9_buffering}

_SETS_SQL = """s0 AS (SELECT p_partkey AS k, p_partkey AS set_id, 1 + p_partkey % 5 AS idc, p_partkey % 7 AS compatible, p_partkey % 3 = 0 AS one_picture,
  p_partkey % 2 + p_partkey % 5 + 3 AS log2, CASE WHEN p_partkey % 6 = 0 THEN 2 ELSE 0 END AS l8, CASE WHEN p_partkey % 10 = 0 THEN 3 ELSE 0 END AS c8,
  p_size * 40 + 100 AS width, p_size * 20 + 60 AS height, 1 + p_partkey % 3 AS nc, 1 + p_partkey % 2 AS nr FROM part),
sets AS (SELECT *, (1::BIGINT << log2) AS ctb, CASE WHEN idc = 3 OR compatible = 3 THEN 'Main Still Picture' WHEN idc = 2 OR compatible = 2 THEN CASE WHEN one_picture THEN 'Main 10 Still Picture' ELSE 'Main 10' END
  WHEN idc = 1 OR compatible = 1 THEN 'Main' END AS profile FROM s0)"""


def _tools(names: tuple[str, ...], base: int) -> str:
    return "CASE " + " ".join(f"WHEN k % {base + i} = 0 THEN 'forbidden tool {n}'" for i, n in enumerate(names)) + " END"


def _tile(length: str, n: str, smallest: int, name: str) -> str:
    sizes = f"list_transform(range({n}), lambda i: ((i + 1) * (({length} + ctb - 1) // ctb) // {n} - i * (({length} + ctb - 1) // ctb) // {n}) * ctb)"
    first = f"list_position(list_transform({sizes}, lambda s: s < {smallest}), TRUE)"
    return f"CASE WHEN log2 BETWEEN 4 AND 6 AND k % 4 = 1 AND {first} > 0 THEN '{name} ' || ({first} - 1) || ' is ' || ({sizes})[{first}] || ' samples' END"


_RULES = [
    "CASE WHEN profile IS NULL THEN 'profile not indicated' END",
    "CASE WHEN profile = 'Main 10 Still Picture' AND NOT one_picture THEN 'one-picture flag required' END",
    "CASE WHEN k % 29 = 0 OR k % 31 = 0 THEN 'base layer flags' END",
    "CASE WHEN k % 23 = 0 THEN 'chroma format 2' END",
    "CASE WHEN l8 > CASE WHEN profile IN ('Main', 'Main Still Picture') THEN 0 ELSE 2 END THEN 'luma bit depth ' || l8 END",
    "CASE WHEN c8 > CASE WHEN profile IN ('Main', 'Main Still Picture') THEN 0 ELSE 2 END THEN 'chroma bit depth ' || c8 END",
    _tools(SPS_TOOLS, 41),
    _tools(PPS_TOOLS, 61),
    "CASE WHEN k % 4 = 1 AND k % 13 = 0 THEN 'tiles with entropy-coding sync' END",
    "CASE WHEN log2 < 4 OR log2 > 6 THEN 'block size ' || log2 END",
    "CASE WHEN profile LIKE '%Still%' AND k % 2 <> 0 THEN 'still-picture buffering ' || (k % 2) END",
    _tile("width", "nc", MIN_TILE_WIDTH, "tile column"),
    _tile("height", "nr", MIN_TILE_HEIGHT, "tile row"),
]
_BITS = "ctb * ctb * (l8 + 8) + 2 * (ctb // 2) * (ctb // 2) * (c8 + 8)"
ORACLE = {
    "j1_active_sets": """WITH e AS (SELECT user_id AS stream_id, event_id AS nal_idx, event_type, CAST(floor(value) AS BIGINT) AS v FROM events),
p AS (SELECT stream_id, nal_idx, ((v % 4) + 4) % 4 AS pps_id, nal_idx % 3 AS sps_id FROM e WHERE event_type = 'signup'),
s AS (SELECT stream_id, nal_idx, ((v % 3) + 3) % 3 AS sps_id FROM e WHERE event_type = 'purchase'),
x AS (SELECT stream_id, nal_idx, ((v % 4) + 4) % 4 AS pps_id FROM e WHERE event_type = 'view'),
y AS (SELECT x.*, p.nal_idx AS pps_at, p.sps_id FROM x ASOF LEFT JOIN p ON x.stream_id = p.stream_id AND x.pps_id = p.pps_id AND x.nal_idx > p.nal_idx)
SELECT y.*, s.nal_idx AS sps_at FROM y ASOF LEFT JOIN s ON y.stream_id = s.stream_id AND y.sps_id = s.sps_id AND y.nal_idx > s.nal_idx""",
    "v1_profiles": f"WITH {_SETS_SQL} SELECT set_id, idc, profile FROM sets",
    "v2_profile_rules": f"""WITH {_SETS_SQL} SELECT set_id, coalesce({", ".join(_RULES)}) AS violation, CAST({" + ".join(f"(({r}) IS NOT NULL)::INT" for r in _RULES)} AS BIGINT) AS n_violations, {_BITS} AS raw_ctu_bits FROM sets""",
    "v7_read_bits": f"""WITH {_SETS_SQL}, u AS (SELECT set_id, l_orderkey * 8 + l_linenumber AS ctu, CAST(floor(l_extendedprice * 3) AS BIGINT) AS calls, {_BITS} AS bits FROM lineitem JOIN sets ON set_id = l_partkey),
o AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY ctu, calls) AS rn FROM u WHERE calls * 3 > bits * 5) SELECT set_id, ctu, calls FROM o WHERE rn = 1""",
    "v8_picture_counts": f"WITH {_SETS_SQL} SELECT set_id, any_value(profile) AS profile, count(*) AS n_pics FROM sets JOIN lineitem ON l_partkey = set_id WHERE profile LIKE '%Still%' GROUP BY set_id HAVING count(*) <> 1",
    "v9_buffering": """WITH e AS (SELECT vec_id, vec_id % 4 + 1 AS n, vec_id % 3 + 1 AS layers FROM embeddings) SELECT vec_id, CASE WHEN n = layers OR n = 1 THEN (n * 7 + vec_id) % 16 END AS buffering FROM e""",
}
