"""Motion vectors, merge candidates, fractional samples and weighted prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import duck_sql, spark_sql
from ..sources.tables import table
from .blocks import DCT4, DEQUANTISED
from .planes import PLANES8_SQL, kernel, kernel_sql, planes8

# The taps of the luma and chroma interpolation filters, by fraction of a sample.
LUMA = [[0, 0, 0, 64, 0, 0, 0, 0], [-1, 4, -10, 58, 17, -5, 1, 0], [-1, 4, -11, 40, 40, -11, 4, -1], [0, 1, -5, 17, 58, -10, 4, -1]]
CHROMA = [[0, 64, 0, 0], [-2, 58, 10, -2], [-4, 54, 16, -2], [-6, 46, 28, -4], [-4, 36, 36, -4], [-4, 28, 46, -6], [-2, 16, 54, -4], [-2, 10, 58, -2]]


def wrap16(value: Column) -> Column:
    """To the signed 16-bit number with the same low bits."""
    low = F.pmod(value, F.lit(65536).cast("long"))
    return F.when(low >= 32768, low - 65536).otherwise(low)


def motion_component(predictor: Column, difference: Column, whole: Column) -> Column:
    """A vector's component; with whole samples only, both parts count in whole samples."""
    return wrap16(F.when(whole, (F.shiftright(predictor, 2) + difference) * 4).otherwise(predictor + difference))


def fractional(taps: list[list[int]], fx: str, fy: str, before: int, final_shift: int) -> str:
    """A template of the sample at (px, py) with fractions fx and fy of a filter; rows are filtered and normalised first."""
    n = len(taps[0])
    flat = f"LIST({', '.join(str(v) for row in taps for v in row)})"
    row = f"SHR(SUM({n}, i, AT({flat}, ({fx}) * {n} + i) * PLANE(samples, width, height, px + i - {before}, py{{dy}})), 6)"
    column = f"SHR(SUM({n}, j, AT({flat}, ({fy}) * {n} + j) * PLANE(samples, width, height, px, py + j - {before})), 6)"
    rounding = f" + {1 << (final_shift - 1)}" if final_shift == 12 else ""
    both = f"SHR(SUM({n}, j, AT({flat}, ({fy}) * {n} + j) * {row.format(dy=f' + j - {before}')}){rounding}, {final_shift})"
    return f"SAMPLE(CASE WHEN {fx} = 0 AND {fy} = 0 THEN PLANE(samples, width, height, px, py) WHEN {fy} = 0 THEN {row.format(dy='')} WHEN {fx} = 0 THEN {column} ELSE {both} END, 8)"


def _block(template: str, mv_x: str, mv_y: str, bits: int) -> str:
    """The 4x4 prediction at (plane_id % 6, plane_id % 5), moved by a vector in fractions of ``bits`` bits."""
    px = f"(plane_id % 6 + SHR({mv_x}, {bits}) + k % 4)"
    py = f"(plane_id % 5 + SHR({mv_y}, {bits}) + k // 4)"
    return f"EACH(16, k, {template.replace('px', px).replace('py', py)})"


def _frac(mv: str, bits: int) -> str:
    return f"({mv} - SHR({mv}, {bits}) * {1 << bits})"


_MVX, _MVY = "(plane_id % 29 - 14)", "(plane_id % 23 - 11)"
LUMA_BLOCK = _block(fractional(LUMA, _frac(_MVX, 2), _frac(_MVY, 2), 3, 12), _MVX, _MVY, 2)
CHROMA_BLOCK = _block(fractional(CHROMA, _frac(_MVX, 3), _frac(_MVY, 3), 1, 6), _MVX, _MVY, 3)

_SHIFT1, _SHIFT2 = 14 - 8, 15 - 8
# both lists, the first or the second one, by plane
DEFAULT_WEIGHT = f"""EACH(64, k, SAMPLE(CASE plane_id % 4 WHEN 0 THEN SHR(AT(samples, k) * 64 + {1 << _SHIFT1 - 1}, {_SHIFT1}) WHEN 1 THEN SHR(AT(samples, 63 - k) * 64 + {1 << _SHIFT1 - 1}, {_SHIFT1})
  WHEN 2 THEN SHR(AT(samples, k) * 64 + AT(samples, 63 - k) * 64 + {1 << _SHIFT2 - 1}, {_SHIFT2}) ELSE 0 END, 8))"""
_D = "(plane_id % 7)"
_W0, _W1, _O0, _O1 = "(plane_id % 129 - 40)", "(plane_id % 97 - 20)", "(plane_id % 31 - 15)", "(plane_id % 19 - 9)"
_ROUND = f"(CASE WHEN {_D} = 0 THEN 0 ELSE POW2(greatest({_D} - 1, 0)) END)"
EXPLICIT_WEIGHT = f"""EACH(64, k, SAMPLE(CASE plane_id % 4 WHEN 0 THEN SHR(AT(samples, k) * {_W0} + {_ROUND}, {_D}) + {_O0} WHEN 1 THEN SHR(AT(samples, 63 - k) * {_W1} + {_ROUND}, {_D}) + {_O1}
  WHEN 2 THEN SHR(AT(samples, k) * {_W0} + AT(samples, 63 - k) * {_W1} + {_ROUND}, {_D} + 1) + SHR({_O0} + {_O1} + 1, 1) ELSE 0 END, 8))"""


# both predictions of a block, from one plane moved by two vectors, weighted by default; a list that is missing is absent
_MVX1, _MVY1 = "(plane_id % 17 - 8)", "(plane_id % 19 - 9)"
SECOND_BLOCK = _block(fractional(LUMA, _frac(_MVX1, 2), _frac(_MVY1, 2), 3, 12), _MVX1, _MVY1, 2)
BOTH_LISTS = f"""EACH(16, k, SAMPLE(CASE plane_id % 4 WHEN 0 THEN SHR(AT(first, k) + {1 << _SHIFT1 - 1}, {_SHIFT1}) WHEN 1 THEN SHR(AT(second, k) + {1 << _SHIFT1 - 1}, {_SHIFT1})
  WHEN 2 THEN SHR(AT(first, k) + AT(second, k) + {1 << _SHIFT2 - 1}, {_SHIFT2}) ELSE 0 END, 8))"""


def merge_candidates(spatial: DataFrame, both_lists: Column) -> DataFrame:
    """(id, rank, l0, l1) from rows (id, pos, l0, l1, most): the merge list of each id, as many entries as ``most``.

    First the different spatial candidates in order, then pairs of the first list of one with the second list of
    another among the leading ones, then zero vectors with ascending references; an entry never occurs twice. Each
    id is one group, kept as an ordered array of all its candidates.
    """
    cand = F.struct(F.col("l0"), F.col("l1"))
    g = spatial.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", cand.alias("c")))), lambda x: x["c"]).alias("all"), F.max("most").alias("most"), F.max(both_lists).alias("both"))
    g = g.withColumn("lead", F.slice(F.array_distinct("all"), F.lit(1), F.col("most").cast("int")))
    n = F.size("lead")
    pairs = F.flatten(F.transform(F.slice("all", F.lit(1), n), lambda left: F.transform(F.slice("all", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda right: F.struct(left["l0"].alias("l0"), right["l1"].alias("l1")))))
    pairs = F.when(F.col("both"), F.filter(pairs, lambda p: p["l0"].isNotNull() & p["l1"].isNotNull())).otherwise(F.array().cast("array<struct<l0:string,l1:string>>"))
    zero = lambda i: F.concat(i.cast("string"), F.lit(":0:0"))
    zeros = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("most"), F.lit(1)) - 1), lambda i: F.struct(zero(i).alias("l0"), F.when(F.col("both"), zero(i)).alias("l1")))
    merged = F.slice(F.array_distinct(F.concat("lead", pairs, zeros)), F.lit(1), F.col("most").cast("int"))
    return g.select("id", F.posexplode(merged).alias("rank", "c")).select("id", F.col("rank").cast("long").alias("rank"), F.col("c.l0").alias("l0"), F.col("c.l1").alias("l1"))


def m1_motion_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictors and differences that reach over 16 bits, and the chroma vectors of 4:2:0 and 4:2:2."""
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    px, py = F.col("l_partkey") * 37 % 65536 - 32768, F.col("l_orderkey") * 11 % 65536 - 32768
    dx, dy = F.col("l_suppkey") * 613 % 65536 - 32768, F.col("l_quantity").cast("long") * 1201 - 30000
    whole = F.col("l_linenumber") % 3 == 0
    rows = line.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), motion_component(px, dx, whole).alias("mv_x"), motion_component(py, dy, whole).alias("mv_y"))
    return rows.select("*", F.col("mv_x").alias("c420_x"), F.col("mv_y").alias("c420_y"), (F.col("mv_y") * 2).alias("c422_y"))


def m3_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    vector = lambda ref, x, y: F.concat_ws(":", (ref).cast("string"), (x).cast("string"), (y).cast("string"))
    rows = line.select(
        F.col("l_orderkey").alias("id"),
        pos.cast("long").alias("pos"),
        F.when(F.col("l_returnflag") != "R", vector(F.col("l_partkey") % 2, F.col("l_partkey") % 3, F.lit(0))).alias("l0"),
        F.when(F.col("l_returnflag") != "A", vector(F.col("l_suppkey") % 2, F.col("l_suppkey") % 2, F.lit(1))).alias("l1"),
        (F.col("l_orderkey") % 5 + 1).alias("most"),
    )
    return merge_candidates(rows, F.col("id") % 2 == 0)


def _planed(template: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kernel(planes8(spark, sf_dir), template)

    return run


def m4_inter_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks predicted from the first list, the second, both or none."""
    p = planes8(spark, sf_dir).select("*", F.expr(spark_sql(LUMA_BLOCK)).alias("first"), F.expr(spark_sql(SECOND_BLOCK)).alias("second"))
    return kernel(p, BOTH_LISTS)


# an inter block from its references to the picture: prediction, scaled levels, residual, sum, and the plane with the block in it
RESIDUAL = f"CASE WHEN plane_id % 5 = 0 THEN scaled ELSE {DCT4.replace('(AT(samples, u * 4 + t) - 128)', 'AT(scaled, u * 4 + t)')} END"
SUMMED = "EACH(16, k, SAMPLE(AT(pred, k) + AT(residual, k), 8))"
_INSIDE = "k % width >= plane_id % 6 AND k % width < plane_id % 6 + 4 AND k // width >= plane_id % 5 AND k // width < plane_id % 5 + 4"
PLACED = f"EACH(width * height, k, CASE WHEN {_INSIDE} THEN AT(block, (k // width - plane_id % 5) * 4 + k % width - plane_id % 6) ELSE AT(samples, k) END)"
_INTER_STEPS = {"pred": BOTH_LISTS, "scaled": DEQUANTISED, "residual": RESIDUAL, "block": SUMMED}


def m9_inter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes with an inter block in them: predicted from one list, both or none, with a residual that some don't transform."""
    p = planes8(spark, sf_dir).select("*", F.expr(spark_sql(LUMA_BLOCK)).alias("first"), F.expr(spark_sql(SECOND_BLOCK)).alias("second"), F.lit(5).cast("long").alias("shift"))
    for name, template in _INTER_STEPS.items():
        p = p.withColumn(name, F.expr(spark_sql(template)))
    return kernel(p, PLACED)


def _inter_sql() -> str:
    with_sql, source = PLANES8_SQL + f", pair AS (SELECT *, {duck_sql(LUMA_BLOCK)} AS first, {duck_sql(SECOND_BLOCK)} AS second, 5 AS shift FROM planes8)", "pair"
    for name, template in _INTER_STEPS.items():
        with_sql, source = f"{with_sql}, with_{name} AS (SELECT *, {duck_sql(template)} AS {name} FROM {source})", f"with_{name}"
    return kernel_sql(PLACED, source, with_sql)


QUERIES = {
    "m9_inter_blocks": m9_inter_blocks, "m4_inter_prediction": m4_inter_prediction,
    "m1_motion_vectors": m1_motion_vectors, "m3_merge": m3_merge, "m5_default_weight": _planed(DEFAULT_WEIGHT), "m6_explicit_weight": _planed(EXPLICIT_WEIGHT),
    "m7_luma_fraction": _planed(LUMA_BLOCK), "m8_chroma_fraction": _planed(CHROMA_BLOCK),
}

_WRAP = "CASE WHEN (({0}) % 65536 + 65536) % 65536 >= 32768 THEN (({0}) % 65536 + 65536) % 65536 - 65536 ELSE (({0}) % 65536 + 65536) % 65536 END"
ORACLE = {
    "m1_motion_vectors": f"""WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey * 37 % 65536 - 32768 AS px, l_orderkey * 11 % 65536 - 32768 AS py,
  l_suppkey * 613 % 65536 - 32768 AS dx, CAST(l_quantity AS BIGINT) * 1201 - 30000 AS dy, l_linenumber % 3 = 0 AS whole FROM lineitem),
v AS (SELECT l_orderkey, l_linenumber, CASE WHEN whole THEN ((px >> 2) + dx) * 4 ELSE px + dx END AS vx, CASE WHEN whole THEN ((py >> 2) + dy) * 4 ELSE py + dy END AS vy FROM x),
w AS (SELECT l_orderkey, l_linenumber, {_WRAP.format("vx")} AS mv_x, {_WRAP.format("vy")} AS mv_y FROM v)
SELECT *, mv_x AS c420_x, mv_y AS c420_y, mv_y * 2 AS c422_y FROM w""",
    "m3_merge": """WITH s AS (SELECT * FROM (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS pos,
  CASE WHEN l_returnflag <> 'R' THEN (l_partkey % 2) || ':' || (l_partkey % 3) || ':0' END AS l0, CASE WHEN l_returnflag <> 'A' THEN (l_suppkey % 2) || ':' || (l_suppkey % 2) || ':1' END AS l1,
  l_orderkey % 5 + 1 AS most, l_orderkey % 2 = 0 AS both_ FROM lineitem)),
d AS (SELECT id, l0, l1, min(pos) AS pos, max(most) AS most, bool_or(both_) AS both_ FROM s GROUP BY id, l0, l1),
lead_ AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM d),
n AS (SELECT id, least(count(*), max(most)) AS n, max(most) AS most, bool_or(both_) AS both_ FROM d GROUP BY id),
cand AS (SELECT id, l0, l1, k AS place FROM lead_ WHERE k <= most
  UNION ALL SELECT a.id, a.l0, b.l1, 1000 * a.pos + b.pos FROM s a JOIN s b ON a.id = b.id JOIN n ON n.id = a.id WHERE n.both_ AND a.pos <= n.n AND b.pos BETWEEN 2 AND n.n AND a.l0 IS NOT NULL AND b.l1 IS NOT NULL
  UNION ALL SELECT id, i || ':0:0', CASE WHEN both_ THEN i || ':0:0' END, 1000000000 + i FROM (SELECT *, unnest(range(greatest(most, 1))) AS i FROM n)),
first_ AS (SELECT id, l0, l1, min(place) AS place FROM cand GROUP BY id, l0, l1),
r AS (SELECT id, l0, l1, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS rank FROM first_)
SELECT r.id, r.rank, r.l0, r.l1 FROM r JOIN n USING (id) WHERE r.rank < n.most""",
    "m9_inter_blocks": _inter_sql(),
    "m4_inter_prediction": kernel_sql(BOTH_LISTS, "pair", PLANES8_SQL + f", pair AS (SELECT *, {duck_sql(LUMA_BLOCK)} AS first, {duck_sql(SECOND_BLOCK)} AS second FROM planes8)"),
    "m5_default_weight": kernel_sql(DEFAULT_WEIGHT),
    "m6_explicit_weight": kernel_sql(EXPLICIT_WEIGHT),
    "m7_luma_fraction": kernel_sql(LUMA_BLOCK),
    "m8_chroma_fraction": kernel_sql(CHROMA_BLOCK),
}
