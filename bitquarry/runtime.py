"""What the engine needs of a Spark session before Python code can run on the executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that Python works on at a time, however long Arrow's batches are.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark context."""
    context = spark.sparkContext
    package = Path(__file__).parent
    if getattr(context, "_bitquarry_shipped", False) or not package.is_dir():  # not a folder: it came as a file already
        return
    path = Path(tempfile.mkdtemp(prefix="bitquarry-")) / "bitquarry.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, Path(package.name) / source.relative_to(package))
    context.addPyFile(str(path))
    context._bitquarry_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses in the folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder takes its place, but only if driver and executors are one process: on a
    cluster they would each have their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="bitquarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of few rows and bytes: Python objects take many times the room of a batch, and grow with it."""
    for batch in batches:
        step = max(1, min(PIECE_ROWS, PIECE_BYTES * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores by a key before Python works on each: files are small where the work on a row is long."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what several parts of a plan read is worked out once, and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
