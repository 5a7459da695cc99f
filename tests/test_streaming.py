from __future__ import annotations

import datetime as dt
import random

from bitquarry.operators.order import order_counts
from bitquarry.streaming.order import streamed_order, windowed_counts

PICTURES = "stream_id long, pic_id long, lsb long, irap boolean"


def run(df, mode, folder):
    query = df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def test_state_is_kept_between_micro_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(s, k, rng.randrange(16), rng.random() < 0.1) for s in range(5) for k in range(120)]
    for part in range(4):  # files in coded order: a micro-batch each
        chunk = [r for r in rows if r[1] // 30 == part]
        spark.createDataFrame(chunk, PICTURES).coalesce(1).write.parquet(f"{tmp_path}/in/part-{part}")
    source = spark.readStream.schema(PICTURES).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/part-*")
    run(streamed_order(source), "append", f"{tmp_path}/out")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect())
    want = sorted(tuple(r) for r in order_counts(spark.createDataFrame(rows, PICTURES)).select("stream_id", "pic_id", "lsb", "irap", "poc").collect())
    assert got == want


def test_event_time_windows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k % 3, start + dt.timedelta(minutes=k), k % 7 == 0) for k in range(60)]
    rows.append((9, start + dt.timedelta(days=1), False))  # moves the watermark past the others
    schema = "stream_id long, ts timestamp, irap boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run(windowed_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), "append", f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out/rows").where("stream_id < 9")
    assert got.count() == 18 and got.selectExpr("sum(n_pics)", "sum(n_irap)").first()[:] == (60, 9)
