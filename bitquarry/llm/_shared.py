"""Session settings and shared-folder tables used by the corpus operators.

Nothing here keeps state on one machine: intermediate results are Parquet tables in the
folder that ``spark.checkpoint.dir`` names, so a lost executor only costs the tasks it ran.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_path, ship

#: Rows that an Arrow batch holds at most; whole texts travel in it, so it is far below Spark's default.
BATCH_ROWS = 512


_held: dict[Hashable, Any] = {}


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, kept in this Python worker until another key is asked for.

    Workers outlive their tasks and serve every operator of a job, so a worker holds one operator's tables at a time;
    what the one before leaves goes back to the system.
    """
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # only where the C library has it
            trim(0)
        _held[key] = build()
    return _held[key]


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers and bound the Arrow batches, so that memory doesn't follow the text length."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives executor loss."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_spill(df: DataFrame) -> None:
    """Remove a table that ``spill`` wrote and that no later plan reads."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """The name, or one like it, that no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected pairs (a, b): rows (node, component), component the smallest node.

    Alternating large-star and small-star rounds, each a few aggregations and joins by key and one table in
    the shared folder; no adjacency list or component is ever gathered in a task or on the driver. Only nodes
    that have a pair with another node are returned. Null ends and loops are ignored; no pairs give no rows.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.col("lo").cast("decimal(38,0)"))).first())

    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = spill(e, "edges")
    before = mark(e)
    while before[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = spill(large, "large-star")
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = spill(small.unionAll(root.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        drop_spill(large)
        after = mark(new)
        drop_spill(e)
        e = new
        if after == before:
            break
        before = after
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
