"""Picture order and the decoded-picture buffer over unbounded streams, with the state of one picture per stream.

The batch operators see a stream whole; here pictures come in micro-batches, in coded order within a stream. What is
kept between them is the memory of the last picture (two numbers) or the buffer (as many entries as its capacity).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.order import PERIOD, POC_SQL, picture_stream
from ..runtime import ship

POC = "stream_id long, pic_id long, lsb long, irap boolean, poc long"


def _poc(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    low, high = state.get if state.exists else (0, 0)
    rows = pd.concat(batches).sort_values("pic_id")
    out = []
    for pic, lsb, irap in zip(rows["pic_id"], rows["lsb"], rows["irap"], strict=True):
        if irap:
            out.append((key[0], pic, lsb, True, 0))
            continue
        moved = lsb - low
        high += PERIOD if -moved >= PERIOD // 2 else -PERIOD if moved > PERIOD // 2 else 0
        low = int(lsb)
        out.append((key[0], pic, lsb, False, high + low))
    state.update((low, int(high)))
    yield pd.DataFrame(out, columns=["stream_id", "pic_id", "lsb", "irap", "poc"])


def streamed_order(pictures: DataFrame) -> DataFrame:
    """Order counts of a stream of pictures (stream_id, pic_id, lsb, irap)."""
    ship(pictures.sparkSession)
    return pictures.groupBy("stream_id").applyInPandasWithState(_poc, POC, "low long, high long", "append", GroupStateTimeout.NoTimeout)


def m9_stream_poc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture stream read in micro-batches of a stream each time, written to a table and read back."""
    from ..runtime import shared_path

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    out = shared_path(spark, "stream-poc")
    query = streamed_order(picture_stream(spark, sf_dir, events)).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(POC).parquet(f"{out}/rows")


def windowed_counts(pictures: DataFrame, length: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Pictures and random-access points of each stream by event-time window, with a bound on lateness."""
    return pictures.withWatermark("ts", late).groupBy(F.window("ts", length), "stream_id").agg(F.count("*").alias("n_pics"), F.sum(F.col("irap").cast("long")).alias("n_irap"))


QUERIES = {"m9_stream_poc": m9_stream_poc}
ORACLE = {"m9_stream_poc": f"WITH {POC_SQL} SELECT * FROM counted"}
