"""In-loop filters over sample planes: deblocking of edges eight samples apart, and sample-adaptive offsets.

Vertical edges change only the two samples beside them and read three to each side, so all of them are independent
and one pass is one expression over the plane; horizontal edges are a second pass over its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import duck_sql, spark_sql
from .planes import PLANES16_SQL, kernel, planes16

STEP = 8
#: Boundary strength, offsets and strong filtering by plane, for the queries.
_BS, _BETA_OFFSET, _TC_OFFSET, _STRONG = "(plane_id % 3)", "(plane_id % 7 - 3)", "(plane_id % 5 - 2)", "(plane_id % 2 = 0)"
BETA = f"greatest(13 + 2 * {_BETA_OFFSET}, 0)"
TC = f"greatest({_BS} + 1 + {_TC_OFFSET}, 1)"


def deblock_pass(samples: str, vertical: bool) -> str:
    """A template of the plane after one pass: of every eight samples along an edge the first four are filtered."""
    x, y = "(k % width)", "(k // width)"
    across, along, length = (x, y, "width") if vertical else (y, x, "height")
    # the sample's place by the nearest edge: q0 on it, p0 before it
    is_q, is_p = f"({across} % {STEP} = 0 AND {across} > 0)", f"({across} % {STEP} = {STEP - 1} AND {across} + 1 < {length})"
    edge = f"({across} + CASE WHEN {is_p} THEN 1 ELSE 0 END)"

    def at(offset: int) -> str:
        place = f"{edge} + ({offset})"
        return f"PLANE({samples}, width, height, {place}, {y})" if vertical else f"PLANE({samples}, width, height, {x}, {place})"

    p2, p1, p0, q0, q1, q2 = (at(o) for o in (-3, -2, -1, 0, 1, 2))
    gather = f"LIST({p2}, {p1}, {p0}, {q0}, {q1}, {q2})"
    p2, p1, p0, q0, q1, q2 = (f"AT(e, {i})" for i in range(6))
    rough = f"(abs({p2} - 2 * {p1} + {p0}) + abs({q2} - 2 * {q1} + {q0}))"
    strong = f"({_STRONG} AND {_BS} = 2 AND {rough} < {BETA} // 4 AND abs({p0} - {q0}) < (5 * {TC} + 1) // 2)"
    p_strong = f"SAMPLE(least(greatest({p0} - 2 * {TC}, ({p2} + 2 * {p1} + 2 * {p0} + 2 * {q0} + {q1} + 4) // 8), {p0} + 2 * {TC}), 8)"
    q_strong = f"SAMPLE(least(greatest({q0} - 2 * {TC}, ({p1} + 2 * {p0} + 2 * {q0} + 2 * {q1} + {q2} + 4) // 8), {q0} + 2 * {TC}), 8)"
    delta = f"CLIP(SHR(9 * ({q0} - {p0}) - 3 * ({q1} - {p1}) + 8, 4), -({TC}), {TC})"
    own = f"AT({samples}, k)"
    p_new = f"CASE WHEN {strong} THEN {p_strong} WHEN {rough} < {BETA} THEN SAMPLE({p0} + {delta}, 8) ELSE {p0} END"
    q_new = f"CASE WHEN {strong} THEN {q_strong} WHEN {rough} < {BETA} THEN SAMPLE({q0} - {delta}, 8) ELSE {q0} END"
    filtered = f"PICK(CASE WHEN {is_p} THEN {p_new} ELSE {q_new} END, e, {gather})"
    return f"EACH(width * height, k, CASE WHEN {_BS} > 0 AND {along} % {STEP} < 4 AND ({is_q} OR {is_p}) THEN {filtered} ELSE {own} END)"


VERTICAL, HORIZONTAL = deblock_pass("samples", True), deblock_pass("once", False)

_OFFSETS = "LIST(0, 3, -2, 5, -4)"
_BAND = "((SHR(AT(samples, k), 3) + 32 - plane_id % 32) % 32)"
BAND = f"EACH(width * height, k, SAMPLE(AT(samples, k) + AT({_OFFSETS}, CASE WHEN {_BAND} BETWEEN 1 AND 4 THEN {_BAND} ELSE 0 END), 8))"


def edge_offset(kind: str) -> str:
    """A template of the plane after edge offsets of a class: neighbours left and right, above and below, or diagonal."""
    dx, dy = f"AT(LIST(-1, 0, -1, 1), {kind})", f"AT(LIST(0, -1, -1, -1), {kind})"
    x, y = "(k % width)", "(k // width)"
    inside = f"({x} + {dx} BETWEEN 0 AND width - 1 AND {x} - {dx} BETWEEN 0 AND width - 1 AND {y} + {dy} BETWEEN 0 AND height - 1 AND {y} - {dy} BETWEEN 0 AND height - 1)"
    step = lambda s: f"CAST(sign(AT(samples, k) - PLANE(samples, width, height, {x} {s} {dx}, {y} {s} {dy})) AS bigint)"
    shape = f"AT(LIST(1, 2, 0, 3, 4), 2 + {step('+')} + {step('-')})"
    return f"EACH(width * height, k, SAMPLE(AT(samples, k) + CASE WHEN {inside} THEN AT({_OFFSETS}, {shape}) ELSE 0 END, 8))"


EDGE = edge_offset("plane_id % 4")


def deblock(planes: DataFrame) -> DataFrame:
    """Both passes over every plane, vertical edges first."""
    once = planes.withColumn("once", F.expr(spark_sql(VERTICAL)))
    return kernel(once, HORIZONTAL)


def f1_vertical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel(planes16(spark, sf_dir), VERTICAL)


def f2_deblocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deblock(planes16(spark, sf_dir))


def f3_band_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel(planes16(spark, sf_dir), BAND)


def f4_edge_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel(planes16(spark, sf_dir), EDGE)


QUERIES = {"f1_vertical_edges": f1_vertical_edges, "f2_deblocked": f2_deblocked, "f3_band_offset": f3_band_offset, "f4_edge_offset": f4_edge_offset}


def _sql(template: str, extra: str = "", source: str = "planes16") -> str:
    return f"""WITH {PLANES16_SQL}{extra}, made AS (SELECT *, {duck_sql(template)} AS out FROM {source})
SELECT plane_id, i, CAST(out[i + 1] AS BIGINT) AS s FROM (SELECT *, unnest(range(len(out))) AS i FROM made)"""


ORACLE = {
    "f1_vertical_edges": _sql(VERTICAL),
    "f2_deblocked": _sql(HORIZONTAL, f", passed AS (SELECT *, {duck_sql(VERTICAL)} AS once FROM planes16)", "passed"),
    "f3_band_offset": _sql(BAND),
    "f4_edge_offset": _sql(EDGE),
}
