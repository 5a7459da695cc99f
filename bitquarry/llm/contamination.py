"""Benchmark decontamination: benchmark windows as a broadcast hash set, looked up in every document's words.

The windows of the benchmark are a sorted array of hashes with the words they stand for. A document's words are
hashed once; for each window length its run hashes are looked up, first in a bitmap and then in the array, and a
hit counts only when the words themselves agree. The benchmark is broadcast in blocks of at most
``BLOCK_BYTES`` bytes of text, so a benchmark of any size works and what is broadcast at a time is bounded. Each block
is a scan of its own over the documents as they came, which leaves nothing but the hits it found; those of all blocks
are put together by a digest of the text. Documents are never shuffled while the benchmark fits one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh, prepare, spill, table
from ._sql import WORDS as WORDS_SQL
from ._words import Words, blocks, mix, words

WINDOW = 10
#: Benchmark text that is broadcast at a time.
BLOCK_BYTES = 32 << 20
_BITS = 20

_factor = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Windows(NamedTuple):
    code: np.ndarray  # sorted hashes of the windows of one length
    text: list[bytes]  # their words, in the same order
    items: list[list[str]]  # the ids of the items that have the window
    seen: np.ndarray  # bitmap of the low bits of the hashes


def run_hashes(w: Words, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at each word, also where a run leaves its document."""
    total = len(w.code) - n + 1
    code = np.zeros(max(0, total), np.uint64)
    for j in range(n if total > 0 else 0):
        code += w.code[j : j + total] * _factor[j]
    return mix(code)


def window_index(items: list[tuple[str, str | None]], n: int) -> dict[int, Windows]:
    """The windows of the items by length: runs of n words, and whole items of fewer words."""
    found: dict[int, dict[bytes, tuple[int, set[str]]]] = {}
    batch = pa.RecordBatch.from_arrays([pa.array([t or "" for _, t in items], pa.string())], names=["text"])
    for i, j, data, offsets in blocks(batch, "text"):
        w = words(data, offsets)
        runs: dict[int, np.ndarray] = {}
        for k in range(j - i):
            a, b = int(w.first[k]), int(w.first[k + 1])
            size = min(n, b - a)
            if size:
                runs.setdefault(size, run_hashes(w, size))
            for s in range(a, b - size + 1) if size else ():
                code, ids = found.setdefault(size, {}).setdefault(w.joined(s, s + size), (int(runs[size][s]), set()))
                ids.add(items[i + k][0])
    out = {}
    for size, by in found.items():
        rows = sorted((code, text, sorted(ids)) for text, (code, ids) in by.items())
        code = np.array([r[0] for r in rows], np.uint64)
        seen = np.zeros(1 << _BITS, bool)
        seen[code & np.uint64((1 << _BITS) - 1)] = True
        out[size] = Windows(code, [r[1] for r in rows], [r[2] for r in rows], seen)
    return out


def hits(w: Words, index: dict[int, Windows]) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words lie in an occurrence of a window, and the items found in each document."""
    edge = np.zeros(len(w.code) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for n, win in index.items():
        code = run_hashes(w, n)
        at = np.flatnonzero(win.seen[code & np.uint64((1 << _BITS) - 1)])
        place = np.searchsorted(win.code, code[at])
        same = place < len(win.code)
        same[same] = win.code[place[same]] == code[at][same]
        at, place = at[same], place[same]
        doc = np.searchsorted(w.first, at, "right") - 1
        inside = at + n <= w.first[doc + 1]
        for s, p, d in zip(at[inside].tolist(), place[inside].tolist(), doc[inside].tolist(), strict=True):
            text = w.joined(s, s + n)
            while p < len(win.code) and win.code[p] == code[s]:  # hashes that clash stand side by side
                if win.text[p] == text:
                    edge[s] += 1
                    edge[s + n] -= 1
                    items.setdefault(d, set()).update(win.items[p])
                p += 1
    return np.cumsum(edge[:-1]) > 0, items


def _hit_words(batch: pa.RecordBatch, column: str, index: dict[int, Windows]) -> Iterator[tuple[int, int, Words, np.ndarray, dict[int, set[str]], np.ndarray]]:
    """Row ranges [i, j) with their words, which of them are hit, the items by row, and the texts' offsets."""
    for i, j, data, offsets in blocks(batch, column):
        w = words(data, offsets)
        yield i, j, w, *hits(w, index), offsets


def _scan(index: Broadcast, only_hits: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text its key, the items found, the runs of hit words (first, behind the last, first byte, behind the last byte) and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w, hit, items, offsets in _hit_words(batch, "text", index.value):
                some = np.array(sorted(items) if only_hits else range(j - i), np.int64)
                runs = [hit_runs(w, hit, k, int(offsets[k])) if k in items else [] for k in some.tolist()]
                out = [batch.column("key").slice(i, j - i).take(pa.array(some)), pa.array([sorted(items.get(k, ())) for k in some.tolist()], pa.list_(pa.string())), pa.array(runs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.diff(w.first)[some])], names=["key", "items", "runs", "n_words"])

    return run


def hit_runs(w: Words, hit: np.ndarray, k: int, offset: int) -> list[int]:
    """Of the k-th text, which begins at the offset, the runs of hit words as ``_scan`` gives them, one after the other."""
    a, b = int(w.first[k]), int(w.first[k + 1])
    flag = np.concatenate([[False], hit[a:b], [False]])
    turn = np.flatnonzero(flag[1:] != flag[:-1])
    return np.column_stack([turn[::2], turn[1::2], w.start[a + turn[::2]] - offset, w.end[a + turn[1::2] - 1] - offset]).reshape(-1).tolist()


def cut_runs(text: str, runs: list[int]) -> str:
    """The text without the bytes of the runs, which ascend."""
    raw, done, out = text.encode(), 0, []
    for lo, hi in zip(runs[2::4], runs[3::4], strict=True):
        out.append(raw[done:lo])
        done = hi
    return b"".join([*out, raw[done:]]).decode()


def _strip(index: Broadcast, at: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows without those that hold a window (``whole``) or without their hit words; ``at`` is the place of the text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w, hit, items, offsets in _hit_words(batch, at, index.value):
                part = batch.slice(i, j - i)
                if whole:
                    yield part.filter(pa.array([k not in items for k in range(j - i)]))
                    continue
                texts = part.column(at).to_pylist()
                for k in items:
                    texts[k] = cut_runs(texts[k], hit_runs(w, hit, k, int(offsets[k])))
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return run


def _cut_found(at: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first ``width`` columns, the text of one without the runs that follow them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in range(width)]
            texts = [cut_runs(t, r) if r else t for t, r in zip(columns[at].to_pylist(), batch.column(width).to_pylist(), strict=True)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    return run


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[DataFrame]:
    """The items with an id and a text, in tables of at most about ``limit`` bytes (a longer item is one alone)."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    size = F.octet_length("text") + F.octet_length("item")
    total = int(rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
    if total <= limit:
        return [rows]
    n = -(-2 * total // limit)
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def _index(spark: SparkSession, block: DataFrame, n: int) -> Broadcast:
    return spark.sparkContext.broadcast(window_index([(r["item"], r["text"]) for r in block.collect()], n))


#: Runs of hit words joined where they meet or overlap: (first word, behind the last, first byte, behind the last byte).
_JOINED = """aggregate(array_sort(transform(sequence(0, size(runs) div 4 - 1), k -> named_struct('a', runs[4 * k], 'b', runs[4 * k + 1], 's', runs[4 * k + 2], 'e', runs[4 * k + 3]))),
  cast(array() as array<struct<a:bigint,b:bigint,s:bigint,e:bigint>>),
  (done, r) -> if(size(done) > 0 and r.a <= done[size(done) - 1].b,
    concat(slice(done, 1, size(done) - 1), array(named_struct('a', done[size(done) - 1].a, 'b', greatest(done[size(done) - 1].b, r.b), 's', done[size(done) - 1].s, 'e', greatest(done[size(done) - 1].e, r.e)))),
    concat(done, array(r))))"""


def _found(spark: SparkSession, rows: DataFrame, parts: list[DataFrame], n: int) -> DataFrame:
    """(key, items, runs) of the texts (key, text) that hold windows of any block; equal keys stand for equal texts."""
    kind = "key string, items array<string>, runs array<bigint>, n_words long"
    each = [spill(rows.mapInArrow(_scan(_index(spark, part, n), True), kind).drop("n_words").dropDuplicates(["key"]), "decontaminate") for part in parts]
    every = reduce(DataFrame.unionAll, each)
    whole = every.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))  # a row a block at most
    return whole.withColumn("runs", F.expr(f"flatten(transform({_JOINED}, r -> array(r.a, r.b, r.s, r.e)))"))


def _digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """(id, items, spans, n_words, n_hit): per document the items found in it, the byte ranges of its hit words
    (start, end, start, end, ...), the number of its words and of those that are hit.

    A window is n consecutive words of an item; an item of fewer words is one window. Null and empty texts have no
    words; items without an id or words have no window. Repeated rows each give a row. Texts may be of any length.
    Empty tables give an empty result, or no hits. Columns other than the ids and the texts don't matter.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = benchmark_blocks(benchmark, item_col, item_text_col, limit)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = "key {}, items array<string>, runs array<bigint>, n_words long"
    if len(parts) == 1:
        out = rows.mapInArrow(_scan(_index(spark, parts[0], n), False), kind.format("long")).withColumnRenamed("key", "id")
    else:
        keyed = rows.select(_digest("text").alias("key"), "text")
        nothing = spark.sparkContext.broadcast({})
        counted = rows.select(F.struct("key", _digest("text").alias("digest")).alias("key"), "text").mapInArrow(_scan(nothing, False), kind.format("struct<key:long,digest:string>"))
        counted = counted.select(F.col("key.key").alias("id"), F.col("key.digest").alias("key"), "n_words")
        found = _found(spark, keyed, parts, n)
        none = F.array().cast("array<string>"), F.array().cast("array<bigint>")
        out = counted.join(found, "key", "left").select("id", F.array_sort(F.coalesce("items", none[0])).alias("items"), F.coalesce("runs", none[1]).alias("runs"), "n_words")
    # of each run (a, b, s, e) the words b - a and the bytes (s, e)
    signed = F.transform("runs", lambda x, k: F.when(k % 4 == 0, -x).when(k % 4 == 1, x).otherwise(0))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda t, x: t + x)
    return out.select("id", "items", F.filter("runs", lambda x, k: k % 4 >= 2).alias("spans"), "n_words", n_hit.alias("n_hit"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, or (``remove="spans"``) without the hit words.

    The other columns pass through as they are, whatever they are called. With spans removed, what separates the words
    around them stays. Hits are those in the documents as they came, however many blocks the benchmark has; nothing is
    shuffled where it has one, and else the documents are joined once with what was found.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = benchmark_blocks(benchmark, item_col, item_text_col, limit)
    if len(parts) == 1:
        return docs.mapInArrow(_strip(_index(spark, parts[0], n), docs.columns.index(text_col), remove == "documents"), docs.schema)
    key, runs = fresh(docs.columns, "digest"), fresh(docs.columns, "runs")
    found = _found(spark, docs.select(_digest(text_col).alias("key"), F.col(text_col).cast("string").alias("text")), parts, n).select(F.col("key").alias(key), F.col("runs").alias(runs))
    keyed = docs.withColumn(key, _digest(text_col))
    if remove == "documents":
        return keyed.join(found, key, "left_anti").drop(key)
    met = keyed.join(found, key, "left").select(*docs.columns, runs)
    return met.mapInArrow(_cut_found(docs.columns.index(text_col), len(docs.columns)), docs.schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, coalesce({WORDS_SQL.format("text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL.format("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(w[s:s + least({WINDOW}, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least({WINDOW}, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, s, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) AS items_sha256 FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
