"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

Lengths are integers up to the capacity, so the state of best-fit decreasing is how many open bins have which
room left. The driver packs the histogram of lengths (at most ``capacity`` rows, however many documents there
are): a segment tree over the remaining capacities finds the tightest room that an item fits, and all bins with
that room are filled at once, exactly as one document after the other would be. The plan maps ranges of ordinals
of a length to ranges of bins; its size depends on the capacity alone. Executors number the pieces of each
length and look their places up.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import prepare, spill, table
from ._tokens import encoder, vocabulary

CAPACITY = 1024
END = 2
#: Pieces of one length that are numbered in one task, about.
NUMBERED = 10_000


class RoomTree:
    """A segment tree over remaining capacities that finds the smallest one in use from a size on."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.leaves)

    def set(self, room: int, used: bool) -> None:
        at = room + self.leaves
        self.used[at] = used
        while at > 1:
            at //= 2
            self.used[at] = self.used[2 * at] or self.used[2 * at + 1]

    def tightest(self, size: int) -> int | None:
        """Climb from the leaf of ``size`` to the first subtree to its right that is in use, and go down it."""
        at = size + self.leaves
        if self.used[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.used[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.used[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first ordinal, first bin, items per bin, offset in the bin), sorted, and the number of bins.

    Item ``first ordinal + t`` of the length goes to bin ``first bin + t // items`` at ``offset + t % items * length``.
    """
    tree, bins = RoomTree(capacity), 0
    open_bins: dict[int, list[tuple[int, int]]] = {}  # by room: ranges of bins
    plan = []

    def put(room: int, lo: int, hi: int) -> None:
        if room and lo < hi:
            open_bins.setdefault(room, []).append((lo, hi))
            tree.set(room, True)

    for size in sorted(histogram, reverse=True):
        left, ordinal = histogram[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room = capacity
                lo, hi = bins, bins + -(-left // (capacity // size))
                bins = hi
            else:
                lo, hi = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // size
            placed = min(left, (hi - lo) * each)
            plan.append((size, ordinal, lo, each, capacity - room))
            full, some = divmod(placed, each)
            put(room - each * size, lo, lo + full)
            if some:
                put(room - some * size, lo + full, lo + full + 1)
            put(room, lo + full + bool(some), hi)
            left -= placed
            ordinal += placed
    return np.array(sorted(plan), np.int64).reshape(-1, 5), bins


def _cut(path: str, end: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, ids, bounds in encoder(path).encode_blocks(batch):
                begin = bounds + np.arange(j - i + 1)  # with an end id behind each text
                full = np.full(begin[-1], end, "<u4")
                full[np.arange(len(ids)) + np.repeat(np.arange(j - i), np.diff(bounds))] = ids
                n = np.diff(begin)
                many = -(-n // capacity)
                row = np.repeat(np.arange(j - i), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                first = ((n - 1) % capacity + 1)[row]  # the first piece takes the remainder
                length = np.where(piece == 0, first, capacity)
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                raw, lo = memoryview(full).cast("B"), 4 * (begin[row] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
                out = [batch.column("doc_id").slice(i, j - i).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _place(plan: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            length, ordinal = (batch.column(c).to_numpy() for c in ("length", "ordinal"))
            at = np.searchsorted(key, (length << 48) + ordinal, "right") - 1
            step = ordinal - plan[at, 1]
            each = plan[at, 3]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            out = [batch.column(c) for c in names]
            out += [pa.array(plan[at, 2] + step // each), pa.array(plan[at, 4] + step % each * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "sequence_id", "offset"])

    return run


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document lies.

    A document is its ids and the end id; one longer than the capacity is cut so that all pieces but the first are
    full. Null and empty texts are the end id alone. Repeated rows are packed as often as they occur; rows with a
    null id are packed under it. An empty table gives no rows. Other columns don't matter.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = spill(source.mapInArrow(_cut(tokenizer or vocabulary(), end, capacity), schema), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = best_fit_plan(histogram, capacity)
    # as many salts as a length needs: a frequent one is numbered by many tasks, the others by one each
    salts = F.element_at(F.array(*(F.lit(-(-histogram.get(k, 1) // NUMBERED)) for k in range(1, capacity + 1))), F.col("length").cast("int"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))  # a row per length, and per NUMBERED pieces
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = salted.withColumn("rank", rank).join(base, ["length", "salt"]).withColumn("ordinal", (F.col("base") + F.col("rank") - 1).cast("long"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "ordinal").mapInArrow(_place(plan), schema + ", sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
