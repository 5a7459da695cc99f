"""Sample planes: reading with clamped coordinates, overlaying blocks, cropping, subsampling and colour conversion.

A plane is one row (plane_id, width, height, samples), samples in raster order, so every kernel over a plane is an
expression of one row: it needs no join and no shuffle, and its memory is that of the plane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import duck_sql, spark_sql
from ..sources.tables import table

#: A component of an embedding as a sample of 8 bits.
_SAMPLE = "CLIP(FLOOR(CAST(v AS double) * 127 + 128), 0, 255)"


def planes8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as planes of 8x8 samples."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").where("size(embedding) = 64")
    samples = F.expr(f"transform(embedding, v -> {spark_sql(_SAMPLE)})")
    return e.select(F.col("vec_id").alias("plane_id"), F.lit(8).cast("long").alias("width"), F.lit(8).cast("long").alias("height"), samples.alias("samples"))


def planes16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four embeddings each as a plane of 16x16 samples, in the order of their ids."""
    p = planes8(spark, sf_dir).groupBy(F.expr("plane_id div 4").alias("plane_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("plane_id").alias("id"), "samples"))).alias("parts")).where("size(parts) = 4")
    return p.select("plane_id", F.lit(16).cast("long").alias("width"), F.lit(16).cast("long").alias("height"), F.expr("flatten(transform(parts, p -> p.samples))").alias("samples"))


PLANES8_SQL = f"""planes8 AS (SELECT vec_id AS plane_id, 8::BIGINT AS width, 8::BIGINT AS height, list_transform(embedding, lambda v: {duck_sql(_SAMPLE)}) AS samples FROM embeddings WHERE len(embedding) = 64)"""
PLANES16_SQL = PLANES8_SQL + """,
planes16 AS (SELECT plane_id // 4 AS plane_id, 16::BIGINT AS width, 16::BIGINT AS height, flatten(list(samples ORDER BY plane_id)) AS samples FROM planes8 GROUP BY plane_id // 4 HAVING count(*) = 4)"""


def kernel(planes: DataFrame, template: str, name: str = "samples", *keep: str) -> DataFrame:
    """Rows (plane_id, ..., i, s) of the list that a template makes of each plane."""
    made = planes.select("plane_id", *keep, F.posexplode(F.expr(spark_sql(template))).alias("i", "s"))
    return made.select("plane_id", *keep, F.col("i").cast("long").alias("i"), F.col("s").cast("long").alias(name if name != "samples" else "s"))


def kernel_sql(template: str, source: str = "planes8", with_sql: str = PLANES8_SQL, keep: str = "") -> str:
    return f"""WITH {with_sql}, made AS (SELECT *, {duck_sql(template)} AS out FROM {source})
SELECT plane_id, {keep}i, CAST(out[i + 1] AS BIGINT) AS s FROM (SELECT *, unnest(range(len(out))) AS i FROM made)"""


# a block read with clamped coordinates, and the plane with a block written over it, clipped to the plane
READ = "EACH(36, k, PLANE(samples, width, height, k % 6 + plane_id % 9 - 3, k // 6 + plane_id % 7 - 2))"
WRITE = """EACH(width * height, k, CASE WHEN k % width >= plane_id % 9 - 2 AND k % width < plane_id % 9 + 2 AND k // width >= plane_id % 7 - 2 AND k // width < plane_id % 7 + 2
  THEN (k % width - (plane_id % 9 - 2)) * 10 + k // width - (plane_id % 7 - 2) ELSE AT(samples, k) END)"""



def frame_to_rgb(frames: DataFrame) -> DataFrame:
    """(frame_id, x, y, r, g, b) of 4:2:0 frames (frame_id, width, height, luma, cb, cr), the nearest chroma sample each."""
    rows = frames.select("*", F.posexplode("luma").alias("i", "l")).withColumn("x", F.expr("i % width")).withColumn("y", F.expr("i div width"))
    at = F.expr("cast((y div 2) * ((width + 1) div 2) + x div 2 as int)")
    rows = rows.withColumn("u", (F.get("cb", at) - 128).cast("float")).withColumn("v", (F.get("cr", at) - 128).cast("float")).withColumn("f", F.col("l").cast("float"))

    def channel(formula: Column) -> Column:
        return F.least(F.lit(255), F.greatest(F.lit(0), F.round(F.col("f") + formula))).cast("long")

    u, v = F.col("u"), F.col("v")
    f32 = lambda x: F.lit(x).cast("float")
    return rows.select(
        "frame_id",
        F.col("x").cast("long").alias("x"),
        F.col("y").cast("long").alias("y"),
        channel(f32(1.402) * v).alias("r"),
        channel(-(f32(0.344136) * u) - f32(0.714136) * v).alias("g"),
        channel(f32(1.772) * u).alias("b"),
    )


def a1_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel(planes8(spark, sf_dir), "samples")


def a2_read_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel(planes8(spark, sf_dir), READ)


def a3_write_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel(planes8(spark, sf_dir), WRITE)


def o13_unavailable_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant planes in place of a reference that is missing: one row per component with its size and value."""
    from .geometry import components, part_pictures

    p = components(part_pictures(spark, sf_dir)).where("depth_luma between 8 and 16")
    return p.select("pic_id", "component", (F.col("plane_width") * F.col("plane_height")).alias("n"), F.expr("shiftleft(1L, cast(depth_luma - 1 as int))").alias("value"))


QUERIES = {"a1_planes": a1_planes, "a2_read_block": a2_read_block, "a3_write_block": a3_write_block, "o13_unavailable_picture": o13_unavailable_picture}


def _oracle() -> dict[str, str]:
    from .geometry import PICTURES_SQL

    return {
        "a1_planes": kernel_sql("samples"),
        "a2_read_block": kernel_sql(READ),
        "a3_write_block": kernel_sql(WRITE),
        "o13_unavailable_picture": f"""WITH {PICTURES_SQL}, c AS (SELECT *, unnest(range(CASE WHEN chroma = 0 THEN 1 ELSE 3 END)) AS component FROM pictures WHERE depth_luma BETWEEN 8 AND 16)
SELECT pic_id, component, CASE WHEN component = 0 OR separate OR chroma IN (0, 3) THEN width ELSE (width + 1) // 2 END * CASE WHEN component = 0 OR separate OR chroma <> 1 THEN height ELSE (height + 1) // 2 END AS n,
  CAST(1 AS BIGINT) << (depth_luma - 1) AS value FROM c""",
    }


ORACLE = _oracle()
