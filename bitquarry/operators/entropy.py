"""Initial states of arithmetic-coding contexts, and coding trees as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arith import clip, shift_right
from ..runtime import pieces, ship
from ..sources.entropy import Scripted
from ..sources.slicedata import Picture, coding_tree, rows_of_tree
from ..sources.tables import table


def initial_state(init_value: Column, qp: Column) -> tuple[Column, Column]:
    """State index and more probable symbol of a context, from its initial value and the slice's quantiser."""
    slope = shift_right(init_value, 4) * 5 - 45
    offset = init_value.bitwiseAND(15) * 8 - 16
    before = clip(shift_right(slope * clip(qp, 0, 51), 4) + offset, 1, 126)
    return F.when(before <= 63, 63 - before).otherwise(before - 64), (before > 63).cast("long")


def init_type(slice_type: Column, init_flag: Column) -> Column:
    """Which of three sets of initial values a slice uses; B, P and I slices are 0, 1 and 2, others null."""
    return F.when(slice_type == 2, 0).when(slice_type == 1, F.when(init_flag, 2).otherwise(1)).when(slice_type == 0, F.when(init_flag, 1).otherwise(2)).cast("long")


def coding_tree_rows(streams: DataFrame) -> DataFrame:
    """(stream_id, path, x, y, log2, depth, split) of the coding trees of (stream_id, width, height, bins).

    ``bins`` are the split decisions in coded order; a tree of its own for every row, its nodes flat and with their
    paths of child numbers.
    """
    ship(streams.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for stream, w, h, bins in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "width", "height", "bins")), strict=True):
                picture = Picture(width=w, height=h, ctb_log2=6, min_cb_log2=3)
                tree = coding_tree(Scripted(bins), picture, 0, 0, 6, shape_only=True)
                rows += [(stream, n["path"], n["x"], n["y"], n["log2"], n["depth"], n["split"]) for n in rows_of_tree(tree)]
            types = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["stream_id", "path", "x", "y", "log2", "depth", "split"])

    return streams.mapInArrow(run, "stream_id long, path array<long>, x long, y long, log2 long, depth long, split boolean")


def e1_context_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every initial value a byte can hold, with quantisers given by line items."""
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    value, qp = F.col("l_partkey") % 256, F.col("l_quantity").cast("long") * 2 - 20
    state, mps = initial_state(value, qp)
    return line.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), value.alias("init_value"), qp.alias("qp"), state.alias("state"), mps.alias("mps"))


def e3_init_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id")
    kind, flag = F.col("event_id") % 4, F.col("user_id") % 2 == 0
    return e.select("event_id", kind.alias("slice_type"), flag.alias("init_flag"), init_type(kind, flag).alias("init_type"))


def ex3_coding_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as coding trees of 64 samples; the decisions are the bits of a number that the key gives."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    bins = F.transform(F.sequence(F.lit(0), F.lit(84)), lambda i: F.pmod(F.shiftright(F.col("p_partkey") * 2654435761 + i * 40503, 7), F.lit(2)).cast("long"))
    rows = p.select(F.col("p_partkey").alias("stream_id"), (F.col("p_size").cast("long") + 40).alias("width"), F.lit(64).cast("long").alias("height"), bins.alias("bins"))
    return coding_tree_rows(rows).withColumn("path", F.array_join(F.transform("path", lambda c: c.cast("string")), "."))


QUERIES = {"ex3_coding_trees": ex3_coding_trees, "e1_context_states": e1_context_states, "e3_init_types": e3_init_types}
ORACLE = {
    "e1_context_states": """WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey % 256 AS init_value, CAST(l_quantity AS BIGINT) * 2 - 20 AS qp FROM lineitem),
p AS (SELECT *, greatest(1, least(126, (((init_value // 16) * 5 - 45) * greatest(0, least(51, qp)) >> 4) + (init_value % 16) * 8 - 16)) AS pre FROM x)
SELECT l_orderkey, l_linenumber, init_value, qp, CASE WHEN pre <= 63 THEN 63 - pre ELSE pre - 64 END AS state, CASE WHEN pre <= 63 THEN 0 ELSE 1 END::BIGINT AS mps FROM p""",
    "e3_init_types": """SELECT event_id, event_id % 4 AS slice_type, user_id % 2 = 0 AS init_flag,
  CASE event_id % 4 WHEN 2 THEN 0 WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END END::BIGINT AS init_type FROM events""",
    "ex3_coding_trees": """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_size::BIGINT + 40 AS w, 64::BIGINT AS h, list_transform(range(85), lambda i: (((p_partkey * 2654435761 + i * 40503) >> 7) % 2 + 2) % 2) AS bins FROM part),
s AS (SELECT id, w, h, bins, 0::BIGINT AS pos, [{'path': '', 'x': 0::BIGINT, 'y': 0::BIGINT, 'log2': 6::BIGINT, 'depth': 0::BIGINT}] AS todo, CAST(NULL AS BOOLEAN) AS split, CAST(NULL AS STRUCT(path VARCHAR, x BIGINT, y BIGINT, log2 BIGINT, depth BIGINT)) AS node FROM p
  UNION ALL SELECT id, w, h, bins, CASE WHEN can THEN pos + 1 ELSE pos END,
    list_concat(CASE WHEN one THEN list_transform(list_filter(list_transform(range(4), lambda q: {'path': n.path, 'x': n.x + (q % 2) * half, 'y': n.y + (q // 2) * half, 'log2': n.log2 - 1, 'depth': n.depth + 1}), lambda c: c.x < w AND c.y < h),
      lambda c, i: {'path': CASE WHEN n.path = '' THEN '' ELSE n.path || '.' END || CAST(i - 1 AS VARCHAR), 'x': c.x, 'y': c.y, 'log2': c.log2, 'depth': c.depth}) ELSE [] END, todo[2:]), one, n
  FROM (SELECT *, can AND bins[pos + 1] = 1 AS one FROM (SELECT *, 1::BIGINT << CAST(n.log2 - 1 AS INTEGER) AS half, n.x + (2::BIGINT << CAST(n.log2 - 1 AS INTEGER)) <= w AND n.y + (2::BIGINT << CAST(n.log2 - 1 AS INTEGER)) <= h AND n.log2 > 3 AS can
    FROM (SELECT id, w, h, bins, pos, todo, todo[1] AS n FROM s WHERE len(todo) > 0))))
SELECT id AS stream_id, node.path AS path, node.x AS x, node.y AS y, node.log2 AS log2, node.depth AS depth, split FROM s WHERE node IS NOT NULL""",
}
