"""Block kernels: intra prediction, mode derivation, dequantisation, inverse transforms and residual tools.

All kernels are templates (see ``plans.dialect``) over one row that holds the block's samples or coefficients.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import duck_sql, spark_sql
from ..sources.tables import table
from .planes import PLANES8_SQL, kernel, kernel_sql, planes8

# Displacement in 1/32 samples of the angular modes 2 to 34, after two unused entries.
ANGLES = [0, 0, 32, 26, 21, 17, 13, 9, 5, 2, 0, -2, -5, -9, -13, -17, -21, -26, -32, -26, -21, -17, -13, -9, -5, -2, 0, 2, 5, 9, 13, 17, 21, 26, 32]
# Chroma mode of each luma mode in 4:2:2 pictures.
MODE_422 = [0, 1, 2, 2, 2, 2, 3, 5, 7, 8, 10, 12, 13, 15, 17, 18, 19, 20, 21, 22, 23, 23, 24, 24, 25, 25, 26, 27, 27, 28, 28, 29, 29, 30, 31]
# Level scale by the remainder of the quantiser by 6, and the transform of 4x4 intra blocks.
LEVEL_SCALE = [40, 45, 51, 57, 64, 72]
INTRA_4X4 = [[29, 55, 74, 84], [74, 74, 0, -74], [84, -29, -74, 55], [55, -84, 74, -29]]


def cosine_matrix(n: int) -> list[list[int]]:
    """Rows of the cosine transform scaled by 64 and rounded; the first one is flat."""
    return [[64] * n if r == 0 else [round(64 * math.cos(math.pi * (2 * c + 1) * r / (2 * n)) * math.sqrt(2)) for c in range(n)] for r in range(n)]


def _list(values: list[int]) -> str:
    return f"LIST({', '.join(map(str, values))})"


# Neighbours of the block of n x n samples at (x0, y0): above, to the left, and the corner; coordinates are clamped.
N = "4"
X0, Y0 = "(plane_id % 6)", "(plane_id % 5)"
TOP = f"EACH(2 * {N} + 1, q, PLANE(samples, width, height, {X0} + q, {Y0} - 1))"
LEFT = f"EACH(2 * {N} + 1, q, PLANE(samples, width, height, {X0} - 1, {Y0} + q))"
CORNER = f"PLANE(samples, width, height, {X0} - 1, {Y0} - 1)"
MODE = "(plane_id % 33 + 2)"

PLANAR = f"""EACH({N} * {N}, k, (({N} - 1 - k % {N}) * AT(lft, k // {N}) + (k % {N} + 1) * AT(top, {N})
  + ({N} - 1 - k // {N}) * AT(top, k % {N}) + (k // {N} + 1) * AT(lft, {N}) + {N}) // (2 * {N}))"""
DC = f"EACH({N} * {N}, k, (SUM({N}, j, AT(top, j) + AT(lft, j)) + {N}) // (2 * {N}))"


def _angular() -> str:
    along = f"CASE WHEN mode >= 18 THEN k // {N} ELSE k % {N} END"
    source = "CASE WHEN mode >= 18 THEN top ELSE lft END"
    move = f"(({along}) + 1) * AT({_list(ANGLES)}, mode)"
    first = f"(SHR({move}, 5) + ({along}))"
    frac = f"(({move}) - SHR({move}, 5) * 32)"

    def ref(at: str) -> str:
        return f"(CASE WHEN {at} < 0 THEN corner ELSE AT({source}, least({at}, 2 * {N})) END)"

    plain = f"SAMPLE(SHR((32 - {frac}) * {ref(first)} + {frac} * {ref(first + ' + 1')} + 16, 5), 8)"
    edge26 = f"SAMPLE(AT(top, 0) + (AT(lft, k // {N}) - corner) // 2, 8)"
    edge10 = f"SAMPLE(AT(lft, 0) + (AT(top, k % {N}) - corner) // 2, 8)"
    return f"EACH({N} * {N}, k, CASE WHEN mode = 26 AND k % {N} = 0 THEN {edge26} WHEN mode = 10 AND k // {N} = 0 THEN {edge10} ELSE {plain} END)"


ANGULAR = _angular()


def with_references(planes: DataFrame) -> DataFrame:
    """Adds the neighbours of each plane's block and the mode to predict it with."""
    cols = {"top": TOP, "lft": LEFT, "corner": CORNER, "mode": MODE}
    return planes.select("*", *(F.expr(spark_sql(t)).alias(n) for n, t in cols.items()))


REFERENCES_SQL = PLANES8_SQL + f", refs AS (SELECT *, {duck_sql(TOP)} AS top, {duck_sql(LEFT)} AS lft, {duck_sql(CORNER)} AS corner, {MODE} AS mode FROM planes8)"

# the mode of a luma block from its neighbours' modes a and b
_A, _B = "CASE WHEN a <= 34 THEN a ELSE 1 END", "CASE WHEN b <= 34 THEN b ELSE 1 END"
CANDIDATES = """CASE WHEN na = nb AND na < 2 THEN LIST(0, 1, 26) WHEN na = nb THEN LIST(na, 2 + (na + 29) % 32, 2 + (na - 1) % 32)
  ELSE LIST(na, nb, CASE WHEN na <> 0 AND nb <> 0 THEN 0 WHEN na <> 1 AND nb <> 1 THEN 1 ELSE 26 END) END"""
_STEP1 = "least(rem, 31) + CASE WHEN least(rem, 31) >= AT(sorted, 0) THEN 1 ELSE 0 END"
_STEP2 = "s1 + CASE WHEN s1 >= AT(sorted, 1) THEN 1 ELSE 0 END"
_STEP3 = "least(34, s2 + CASE WHEN s2 >= AT(sorted, 2) THEN 1 ELSE 0 END)"
CHROMA = f"""CASE WHEN pred = 0 THEN CASE WHEN luma = 0 THEN 34 ELSE 0 END WHEN pred = 1 THEN CASE WHEN luma = 26 THEN 34 ELSE 26 END
  WHEN pred = 2 THEN CASE WHEN luma = 10 THEN 34 ELSE 10 END WHEN pred = 3 THEN CASE WHEN luma = 1 THEN 34 ELSE 1 END ELSE luma END"""

LEVELS = "EACH({n}, k, AT(samples, k) - 128)"
DEQUANTISED = f"""EACH(16, k, CLIP(SHR((AT(samples, k) - 128) * 16 * AT({_list(LEVEL_SCALE)}, plane_id % 52 % 6) * POW2(plane_id % 52 // 6) + POW2(shift - 1), shift), -16384, 16383))"""


def transform_template(n: int, matrix: list[list[int]], depth: int) -> str:
    """Both passes of the transform of n x n coefficients, as sums over the coefficients; clipped once at the end."""
    flat = _list([v for row in matrix for v in row])
    low, high = -(1 << depth + 6), (1 << depth + 6) - 1
    inner = f"SUM({n}, u, AT({flat}, (k // {n}) * {n} + u) * (AT(samples, u * {n} + t) - 128))"
    return f"EACH({n * n}, k, CLIP(SUM({n}, t, AT({flat}, (k % {n}) * {n} + t) * {inner}), {low}, {high}))"


DCT8, DCT4, DST4 = transform_template(8, cosine_matrix(8), 8), transform_template(4, cosine_matrix(4), 8), transform_template(4, INTRA_4X4, 8)
# a residual that adds up along its rows or columns
BYPASS_ROWS = "EACH(64, k, SUM(k % 8 + 1, t, AT(samples, k - t) - 128))"
BYPASS_COLUMNS = "EACH(64, k, SUM(k // 8 + 1, t, AT(samples, k - 8 * t) - 128))"
CROSS = "EACH(64, k, AT(samples, 63 - k) - 128 + SHR((plane_id % 17 - 8) * SHR((AT(samples, k) - 128) * POW2(10), 8), 3))"
RECONSTRUCT = "EACH(64, k, SAMPLE(AT(samples, k) + AT(samples, 63 - k) - 128, 8))"

# the inverse colour transform of a luma and two chroma residuals of 8 and 10 bits
COLOUR = {
    "luma": "SHR(t + 2 * cb + 2, 2)",
    "cb": "SHR(t - SHR(2 * cr, 1), 0)",
    "cr": "SHR(2 * cr + t - SHR(2 * cr, 1), 0)",
}


def _predicted(template: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kernel(with_references(planes8(spark, sf_dir)), template)

    return run


def _planed(template: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kernel(planes8(spark, sf_dir), template)

    return run


def i1_luma_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable modes of a block's neighbours decide the mode, directly or as what remains."""
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = line.selectExpr("l_orderkey", "cast(l_linenumber as bigint) as l_linenumber", "l_partkey % 40 as a", "if(l_suppkey % 4 = 0, l_partkey % 40, l_suppkey % 36) as b", "l_orderkey % 2 = 0 as prev", "l_linenumber % 4 as mpm", "cast(l_quantity as bigint) % 34 as rem")
    rows = rows.selectExpr("*", f"{spark_sql(_A)} as na", f"{spark_sql(_B)} as nb")
    rows = rows.selectExpr("*", f"{spark_sql(CANDIDATES)} as cand").selectExpr("*", "array_sort(cand) as sorted")
    rows = rows.selectExpr("*", f"{spark_sql(_STEP1)} as s1").selectExpr("*", f"{spark_sql(_STEP2)} as s2")
    return rows.selectExpr("l_orderkey", "l_linenumber", "a", "b", f"cast(case when prev then {spark_sql('AT(cand, least(mpm, 2))')} else {spark_sql(_STEP3)} end as bigint) as mode")


def i2_chroma_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = line.selectExpr("l_orderkey", "cast(l_linenumber as bigint) as l_linenumber", "l_suppkey % 5 as pred", "element_at(array(0, 1, 10, 26, l_partkey % 35), cast(l_partkey % 5 + 1 as int)) as luma")
    rows = rows.selectExpr("*", f"{spark_sql(CHROMA)} as mode")
    return rows.selectExpr("l_orderkey", "l_linenumber", "cast(mode as bigint) as mode", f"cast({spark_sql(f'AT({_list(MODE_422)}, mode)')} as bigint) as mode_422")


def r1_dequantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4x4 levels scaled back for 8 bits, flat matrix, quantiser by plane."""
    return kernel(planes8(spark, sf_dir).withColumn("shift", F.lit(8 + 2 + 10 - 15).cast("long")), DEQUANTISED)


def r7_colour_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = line.selectExpr("l_orderkey", "cast(l_linenumber as bigint) as l_linenumber", "l_partkey % 511 - 255 as luma", "l_suppkey % 301 - 150 as cb", "cast(l_quantity as bigint) * 7 - 160 as cr")
    rows = rows.selectExpr("*", f"4 * luma - {spark_sql('SHR(2 * cb, 1)')} as t")
    return rows.selectExpr("l_orderkey", "l_linenumber", *(f"{spark_sql(t)} as {n}_out" for n, t in COLOUR.items()))


QUERIES = {
    "i1_luma_mode": i1_luma_mode, "i2_chroma_mode": i2_chroma_mode, "i4_planar": _predicted(PLANAR), "i5_dc": _predicted(DC), "i6_angular": _predicted(ANGULAR),
    "r1_dequantised": r1_dequantised, "r2_dct8": _planed(DCT8), "r2_dct4": _planed(DCT4), "r2_dst4": _planed(DST4), "r5_bypass_rows": _planed(BYPASS_ROWS), "r5_bypass_columns": _planed(BYPASS_COLUMNS),
    "r6_cross_component": _planed(CROSS), "r7_colour_transform": r7_colour_transform, "r8_reconstruct": _planed(RECONSTRUCT),
}

ORACLE = {
    "i1_luma_mode": f"""WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey % 40 AS a, CASE WHEN l_suppkey % 4 = 0 THEN l_partkey % 40 ELSE l_suppkey % 36 END AS b,
  l_orderkey % 2 = 0 AS prev, l_linenumber % 4 AS mpm, CAST(l_quantity AS BIGINT) % 34 AS rem FROM lineitem),
n AS (SELECT *, {_A} AS na, {_B} AS nb FROM x), c AS (SELECT *, {duck_sql(CANDIDATES)} AS cand FROM n), o AS (SELECT *, list_sort(cand) AS sorted FROM c),
s1 AS (SELECT *, {duck_sql(_STEP1)} AS s1 FROM o), s2 AS (SELECT *, {duck_sql(_STEP2)} AS s2 FROM s1)
SELECT l_orderkey, l_linenumber, a, b, CAST(CASE WHEN prev THEN cand[least(mpm, 2) + 1] ELSE {duck_sql(_STEP3)} END AS BIGINT) AS mode FROM s2""",
    "i2_chroma_mode": f"""WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey % 5 AS pred, ([0, 1, 10, 26, l_partkey % 35])[l_partkey % 5 + 1] AS luma FROM lineitem),
m AS (SELECT *, {CHROMA} AS mode FROM x) SELECT l_orderkey, l_linenumber, CAST(mode AS BIGINT) AS mode, CAST({duck_sql(f"AT({_list(MODE_422)}, mode)")} AS BIGINT) AS mode_422 FROM m""",
    "i4_planar": kernel_sql(PLANAR, "refs", REFERENCES_SQL),
    "i5_dc": kernel_sql(DC, "refs", REFERENCES_SQL),
    "i6_angular": kernel_sql(ANGULAR, "refs", REFERENCES_SQL),
    "r1_dequantised": kernel_sql(DEQUANTISED, "(SELECT *, 5 AS shift FROM planes8)"),
    "r2_dct8": kernel_sql(DCT8),
    "r2_dct4": kernel_sql(DCT4),
    "r2_dst4": kernel_sql(DST4),
    "r5_bypass_rows": kernel_sql(BYPASS_ROWS),
    "r5_bypass_columns": kernel_sql(BYPASS_COLUMNS),
    "r6_cross_component": kernel_sql(CROSS),
    "r7_colour_transform": f"""WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey % 511 - 255 AS luma, l_suppkey % 301 - 150 AS cb, CAST(l_quantity AS BIGINT) * 7 - 160 AS cr FROM lineitem),
t AS (SELECT *, 4 * luma - {duck_sql("SHR(2 * cb, 1)")} AS t FROM x) SELECT l_orderkey, l_linenumber, {", ".join(f"{duck_sql(t)} AS {n}_out" for n, t in COLOUR.items())} FROM t""",
    "r8_reconstruct": kernel_sql(RECONSTRUCT),
}
