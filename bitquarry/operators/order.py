"""Picture order: counts derived from their low bits, per stream and in coded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arith import div
from ..sources.tables import table

#: Period of the low bits in the event streams.
PERIOD = 16


def wrap_step(lsb: Column, previous: Column, period: int | Column) -> Column:
    """What the high part moves by when the low bits go from ``previous`` to ``lsb``."""
    whole = F.lit(period).cast("long")
    half = div(whole, 2)
    return F.when(previous - lsb >= half, whole).when(lsb - previous > half, -whole).otherwise(F.lit(0)).cast("long")


def picture_stream(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """events as pictures: a stream per user, low bits from the value, error events as random-access points."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value") if events is None else events
    return e.select(
        F.col("user_id").alias("stream_id"),
        F.col("event_id").alias("pic_id"),
        F.pmod(F.floor("value").cast("long"), F.lit(PERIOD).cast("long")).alias("lsb"),
        (F.col("event_type") == "error").alias("irap"),
    )


def order_counts(pictures: DataFrame, period: int | Column = PERIOD) -> DataFrame:
    """Adds ``poc``: random-access pictures count 0 and leave the memory alone; the others add up their wraps.

    One shuffle by stream; the memory is a lag and a running sum over the other pictures of the stream.
    """
    w = Window.partitionBy("stream_id", "irap").orderBy("pic_id")
    step = wrap_step(F.col("lsb"), F.lag("lsb", 1, 0).over(w), period)
    stepped = pictures.withColumn("__step", step)
    total = F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("poc", F.when(F.col("irap"), F.lit(0).cast("long")).otherwise(F.col("lsb") + total)).drop("__step")


def o1_poc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-step rule on consecutive low bits, starting from a high part of one period."""
    p = picture_stream(spark, sf_dir)
    w = Window.partitionBy("stream_id").orderBy("pic_id")
    prev = F.lag("lsb", 1, 0).over(w)
    poc = F.when(F.col("irap"), F.lit(0).cast("long")).otherwise(F.col("lsb") + PERIOD + wrap_step(F.col("lsb"), prev, PERIOD))
    return p.select("stream_id", "pic_id", poc.alias("poc"))


def o2_poc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_counts(picture_stream(spark, sf_dir)).select("stream_id", "pic_id", "lsb", "irap", "poc")


def o2_poc_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest and largest count and the number of pictures of each stream."""
    p = order_counts(picture_stream(spark, sf_dir))
    return p.groupBy("stream_id").agg(F.min("poc").alias("min_poc"), F.max("poc").alias("max_poc"), F.count("*").alias("n_pics"))


PICTURES_SQL = f"pictures AS (SELECT user_id AS stream_id, event_id AS pic_id, ((CAST(floor(value) AS BIGINT) % {PERIOD}) + {PERIOD}) % {PERIOD} AS lsb, event_type = 'error' AS irap FROM events)"
_STEP = f"CASE WHEN prev - lsb >= {PERIOD // 2} THEN {PERIOD} WHEN lsb - prev > {PERIOD // 2} THEN -{PERIOD} ELSE 0 END"
POC_SQL = f"""{PICTURES_SQL},
lagged AS (SELECT *, lag(lsb, 1, 0) OVER (PARTITION BY stream_id, irap ORDER BY pic_id) AS prev FROM pictures),
counted AS (SELECT stream_id, pic_id, lsb, irap, CAST(CASE WHEN irap THEN 0 ELSE lsb + sum({_STEP}) OVER (PARTITION BY stream_id, irap ORDER BY pic_id ROWS UNBOUNDED PRECEDING) END AS BIGINT) AS poc FROM lagged)"""

QUERIES = {"o1_poc_pairs": o1_poc_pairs, "o2_poc_stream": o2_poc_stream, "o2_poc_range": o2_poc_range}
ORACLE = {
    "o1_poc_pairs": f"""WITH {PICTURES_SQL}, lagged AS (SELECT *, lag(lsb, 1, 0) OVER (PARTITION BY stream_id ORDER BY pic_id) AS prev FROM pictures)
SELECT stream_id, pic_id, CAST(CASE WHEN irap THEN 0 ELSE lsb + {PERIOD} + {_STEP} END AS BIGINT) AS poc FROM lagged""",
    "o2_poc_stream": f"WITH {POC_SQL} SELECT * FROM counted",
    "o2_poc_range": f"WITH {POC_SQL} SELECT stream_id, min(poc) AS min_poc, max(poc) AS max_poc, count(*) AS n_pics FROM counted GROUP BY stream_id",
}
