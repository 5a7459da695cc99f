"""Token sequences in length-delimited binary record files with masked checksums and an offset index.

A record is: payload length (unsigned 64 bits), masked checksum of those eight bytes (32 bits), payload, masked
checksum of the payload (32 bits). The payload is a flag byte (1: it has an id), the document's id (signed 64
bits) and its token ids (16 bits each, or 32 where the vocabulary needs them). All numbers are little-endian. The
checksum is CRC-32, turned right by 15 bits and added to a constant, so that data that hold checksums don't
check themselves. Beside each file ``x.rec`` lies ``x.idx``: for every record its offset and its number of ids,
unsigned 64 bits each, which is what a shuffled reader needs to fetch any record alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import shared_path
from ._shared import prepare, spill, table
from ._tokens import encoder, vocabulary

END = 0
_HEAD, _SUM, _DOC, _INDEX = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<?q"), struct.Struct("<QQ")
#: Added to a checksum after it is turned: a fixed value of the record format.
_MASK = 0xA282EAD8
#: Bytes that are read at a time.
_READ = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(doc: int | None, ids: bytes) -> bytes:
    """The record of a document whose ids are serialised already."""
    payload = _DOC.pack(doc is not None, doc or 0) + ids
    head = _HEAD.pack(len(payload))
    return b"".join((head, _SUM.pack(masked(head)), payload, _SUM.pack(masked(payload))))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_file(path: str, records: Iterator[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Write a record file and its index: (records, ids). The path must be one that no other attempt writes to."""
    files, at = _open(path)
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    n = tokens = offset = 0
    with files.open_output_stream(f"{at}.rec") as out, files.open_output_stream(f"{at}.idx") as index:
        for doc, ids in records:
            record = frame(doc, ids)
            out.write(record)
            index.write(_INDEX.pack(offset, len(ids) // width))
            offset += len(record)
            n, tokens = n + 1, tokens + len(ids) // width
    return n, tokens


def read_file(path: str) -> Iterator[tuple[int | None, bytes]]:
    """The records of a file in order; a wrong length or checksum raises ValueError."""
    files, at = _open(path)
    with files.open_input_stream(f"{at}.rec") as source:
        data = b""
        pos = 0

        def take(n: int) -> bytes:
            nonlocal data, pos
            if len(data) - pos < n:
                rest = [data[pos:]]
                have = len(rest[0])
                while have < n and (more := source.read(max(_READ, n - have))):
                    rest.append(more)
                    have += len(more)
                data, pos = b"".join(rest), 0
            part = data[pos : pos + n]
            pos += len(part)
            return part

        while head := take(_HEAD.size):
            if len(head) < _HEAD.size or _SUM.unpack(take(_SUM.size))[0] != masked(head):
                raise ValueError(f"{path}: a record's length is damaged")
            payload = take(_HEAD.unpack(head)[0])
            if len(payload) < _HEAD.unpack(head)[0] or _SUM.unpack(take(_SUM.size))[0] != masked(payload):
                raise ValueError(f"{path}: a record is damaged")
            has, doc = _DOC.unpack_from(payload)
            yield doc if has else None, payload[_DOC.size :]


def read_record(path: str, number: int) -> tuple[int | None, bytes]:
    """One record by its number, found through the index."""
    files, at = _open(path)
    with files.open_input_file(f"{at}.idx") as index:
        offset, _ = _INDEX.unpack(index.read_at(_INDEX.size, number * _INDEX.size))
    with files.open_input_file(f"{at}.rec") as source:
        head = source.read_at(_HEAD.size, offset)
        payload = source.read_at(_HEAD.unpack(head)[0], offset + _HEAD.size + _SUM.size)
        check = source.read_at(_SUM.size, offset + _HEAD.size + _SUM.size + len(payload))
    if _SUM.unpack(check)[0] != masked(payload):
        raise ValueError(f"{path}: record {number} is damaged")
    has, doc = _DOC.unpack_from(payload)
    return doc if has else None, payload[_DOC.size :]


def _write(folder: str, tokenizer: str, end: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, tail = f"<u{width}", np.array([end], "<u4").tobytes()

        def records() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                docs = batch.column("doc_id").to_pylist()
                for row, ids in encoder(tokenizer).encode_rows(batch):
                    yield docs[row], np.frombuffer(ids + tail, "<u4").astype(kind).tobytes()

        context = TaskContext.get()
        shard = context.partitionId()
        path = f"{folder}/part-{shard:06d}-{context.stageId()}-{context.taskAttemptId()}"
        n, tokens = write_file(path, records(), width)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, path, n, tokens)], names=["shard", "path", "n_docs", "n_ids"])

    return run


def _read(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = []
                for doc, ids in read_file(path):
                    ids = np.frombuffer(ids, f"<u{width}").astype("<u4")
                    rows.append((doc, start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    return run


def write_token_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to record files in ascending id order; the manifest (shard, path, n_docs, n_ids).

    The texts are dealt by ranges of ids and sorted within them, so files in shard order are in id order; null
    ids come first and equal ids by their text. Null and empty texts are the end id alone. Each attempt of a task
    writes to files of its own; the manifest names those of the attempt that counted, and the others are removed once
    it is written, so nothing that can be read is ever moved or replaced. The folder must be one that all executors
    reach and that holds nothing else. An empty table has files without records.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    tokenizer = tokenizer or vocabulary()
    manifest = spill(dealt.mapInArrow(_write(folder, tokenizer, end, id_width(tokenizer)), "shard long, path string, n_docs long, n_ids long"), "manifest")
    sweep(folder, manifest)
    return manifest


def sweep(folder: str, manifest: DataFrame) -> None:
    """Remove the record files of the folder that the manifest doesn't name: those of attempts that were lost."""
    spark = manifest.sparkSession
    named = {r["path"].rsplit("/", 1)[1] for r in manifest.select("path").collect()}  # a row per file
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(path) if files.exists(path) else ():
        stem, _, kind = status.getPath().getName().rpartition(".")
        if kind in ("rec", "idx") and stem not in named:
            files.delete(status.getPath(), False)


def id_width(tokenizer: str) -> int:
    return 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else 4


def read_token_records(manifest: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the files of a manifest, checksums verified."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    files = manifest.where("n_docs > 0").select("shard", "path", F.coalesce(before, F.lit(0)).cast("long").alias("start"))
    count = max(1, manifest.count())
    return files.repartitionByRange(count, "shard").select("path", "start").mapInArrow(_read(width), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_records(table(spark, sf_dir, "documents"), shared_path(spark, "token-records"))
    return read_token_records(manifest, id_width(vocabulary()))
