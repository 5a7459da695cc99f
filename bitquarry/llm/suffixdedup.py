"""Removal of every byte that a repeated string of a fixed length covers, found in suffix arrays of shards.

Two equal strings of ``LENGTH`` bytes have the same smallest hash among their ``GRAM``-byte grams. A text is cut into
snippets, the runs of string starts whose strings share that smallest gram, so equal strings always lie in snippets
of the same gram, and the snippets of a gram are a unit of work that needs no other. A gram that occurs once has no
repeat; one whose snippets are all equal is a repeat from end to end. Only the others, where repeats begin, end or
are edited, are read again: their different snippets go to a shard by gram, the shard's suffix array is induced,
and the strings whose permuted common prefix with a neighbour reaches the length are the repeated ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import drop_spill, prepare, spill, table
from ._suffix import permuted_lcp, suffix_array
from ._words import blocks, prefix_hash, substring_hash

LENGTH, GRAM = 200, 40
#: Bytes of a text that are cut at a time.
PIECE = (1 << 20) - 4096
#: Bytes of different snippets of one gram that go to a shard; the strings of more are compared one by one.
SHARD, GROUP = 4 << 20, 8 << 20
_INDEX = np.uint64((1 << 20) - 1)


def snippets(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For the runs of string starts with the same smallest gram: gram hash, first start, number of starts, whether
    the gram occurs more than once in the run's bytes, and the start of each gram chosen (for ``cut_at``)."""
    prefix = prefix_hash(data)
    grams = substring_hash(prefix, np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
    window = length - gram + 1
    n = len(data) - length + 1
    key = (grams & ~_INDEX) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(key) % window
    square = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, window)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    at = (np.minimum(back[:n], ahead[window - 1 : window - 1 + n]) & _INDEX).astype(np.int64)
    return grams[at], at, prefix


def _cut(data: np.ndarray, offsets: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """Snippets of the texts data[offsets[i]:offsets[i+1]]: (text, start, starts, gram hash, snippet hash, inner)."""
    code, at, prefix = snippets(data)
    n = len(code)
    start = np.arange(n)
    doc = np.searchsorted(offsets, start, "right") - 1
    good = start + LENGTH <= offsets[doc + 1]
    start, code, at, doc = start[good], code[good], at[good], doc[good]
    if not len(start):
        return (start,) * 4 + (code, code, start)
    new = np.ones(len(start), bool)
    new[1:] = (code[1:] != code[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(start)))
    moved = np.concatenate([[0], np.cumsum(at[1:] != at[:-1])])
    inner = moved[first + many - 1] != moved[first]
    a = start[first]
    whole = substring_hash(prefix, a, a + many + LENGTH - 1)
    return key[doc[first]], a - offsets[doc[first]], many, a, code[first], whole, inner


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks = batch.column("id"), batch.column("mark")
        for i, j, data, offsets in blocks(batch, "text", PIECE):
            pieces = [(0, len(data), np.arange(i, j))]
            if len(data) > PIECE:  # one long text: pieces that share all but one byte of a string
                pieces = [(k, min(len(data), k + PIECE + LENGTH - 1), np.array([i])) for k in range(0, len(data) - LENGTH + 1, PIECE)]
            for lo, hi, rows in pieces:
                if hi - lo < LENGTH:
                    continue
                ends = offsets if len(rows) > 1 or lo == 0 and hi == len(data) else np.array([0, hi - lo])
                row, start, many, _, code, whole, inner = _cut(data[lo:hi], ends, rows)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), marks.take(take), pa.array(code.view(np.int64)), pa.array(whole.view(np.int64)), pa.array((start + lo).astype(np.int64)), pa.array(many.astype(np.int64)), pa.array(inner.astype(bool))],
                    names=["id", "mark", "gram", "whole", "start", "many", "inner"],
                )


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the snippets listed for each text."""
    for batch in batches:
        for row in range(batch.num_rows):
            raw = (batch.column("text")[row].as_py() or "").encode()
            parts = batch.column("parts").slice(row, 1).flatten()
            start, many = (parts.field(c).to_numpy(zero_copy_only=False) for c in ("start", "many"))
            for lo in range(0, len(start), 4096):
                some = slice(lo, lo + 4096)
                cut = [raw[s : s + n + LENGTH - 1] for s, n in zip(start[some].tolist(), many[some].tolist(), strict=True)]
                take = pa.array(np.full(len(cut), row))
                part = parts.slice(lo, len(cut))
                yield pa.RecordBatch.from_arrays(
                    [part.field("gram"), batch.column("id").take(take), batch.column("mark").take(take), part.field("start"), part.field("copies"), pa.array(cut, pa.binary())],
                    names=["gram", "id", "mark", "start", "copies", "snippet"],
                )


def repeated_starts(snippets_: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For all bytes of the snippets, one after the other, whether a string that starts there starts elsewhere too."""
    data = np.frombuffer(b"\xff".join(snippets_) + b"\xff", np.uint8)  # a byte that no UTF-8 text holds
    text = np.zeros(len(data) + 1, np.uint16)
    text[:-1] = data
    text[:-1] += 1
    sa = suffix_array(text, 258)
    common, before = permuted_lcp(data, sa)
    size = np.array([len(s) for s in snippets_])
    ends = np.cumsum(size + 1) - 1
    room = np.repeat(ends, size + 1) - np.arange(len(data))  # bytes up to the end of the snippet
    hit = (common >= length) & (room >= length)
    partner = before[hit]
    hit[partner] = True
    return np.delete(hit, ends)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs of the snippets, which come sorted by gram; a shard holds whole grams."""
    held: list[pa.RecordBatch] = []
    size = 0

    def solve(rows: pa.Table) -> pa.RecordBatch:
        texts = rows.column("snippet").to_pylist()
        hit = repeated_starts(texts)
        ends = np.cumsum([len(t) for t in texts])
        out: list[tuple[int, int, int]] = []
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            while s < e:  # a run of starts may go on in the next snippet
                k = int(np.searchsorted(ends, s, "right"))
                stop = min(e, int(ends[k]))
                base = int(ends[k]) - len(texts[k])
                out.append((k, s - base, stop - base + LENGTH - 1))
                s = stop
        row, lo, hi = (np.array([x[c] for x in out], np.int64) for c in range(3))
        own = rows.take(pa.array(row)) if len(row) else rows.slice(0, 0)
        start = own.column("start").combine_chunks().to_numpy(zero_copy_only=False) if len(row) else row
        return pa.RecordBatch.from_arrays([own.column("id").combine_chunks(), own.column("mark").combine_chunks(), pa.array(start + lo), pa.array(start + hi)], names=["id", "mark", "lo", "hi"])

    for batch in batches:
        gram = batch.column("gram").to_numpy(zero_copy_only=False)
        total = np.cumsum(pa.compute.binary_length(batch.column("snippet")).to_numpy(zero_copy_only=False).astype(np.int64)) if batch.num_rows else gram
        at = 0
        last = held[-1].column("gram")[-1].as_py() if held else None
        for k in np.flatnonzero(np.concatenate([[last is not None and len(gram) > 0 and gram[0] != last], gram[1:] != gram[:-1]]))[: len(gram)].tolist():
            so_far = size + (int(total[k - 1]) if k else 0) - (int(total[at - 1]) if at else 0)
            if so_far >= SHARD:
                yield solve(pa.Table.from_batches([*held, batch.slice(at, k - at)] if k > at else held))
                held, size, at = [], 0, k
        if at < batch.num_rows:
            held.append(batch.slice(at))
            size += int(total[-1]) - (int(total[at - 1]) if at else 0)
    if held:
        yield solve(pa.Table.from_batches(held))


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of the snippets one by one, by 128 bits of hash."""
    for batch in batches:
        for row in range(batch.num_rows):
            raw = np.frombuffer(batch.column("snippet")[row].as_py(), np.uint8)
            at = np.arange(len(raw) - LENGTH + 1)
            start = batch.column("start")[row].as_py()
            codes = [substring_hash(prefix_hash(x), at, at + LENGTH).view(np.int64) for x in (raw, raw ^ np.uint8(0x5A))]
            take = pa.array(np.full(len(at), row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes[0]), pa.array(codes[1]), batch.column("id").take(take), batch.column("mark").take(take), pa.array(at + start), batch.column("copies").take(take)],
                names=["code1", "code2", "id", "mark", "start", "copies"],
            )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, mark, lo, hi): byte ranges that repeated strings cover, of texts (id, mark, text); they may overlap."""
    where = ["id", "mark"]
    cut = spill(docs.mapInArrow(_scan, "id long, mark long, gram long, whole long, start long, many long, inner boolean"), "snippets")
    gram = cut.groupBy("gram").agg(F.count("*").alias("n"), F.min("whole").alias("one"), F.max("whole").alias("other"), F.max("inner").alias("any_inner"))
    several = gram.where("n > 1 or any_inner").select("gram", (F.col("one") != F.col("other")).alias("differ"), "any_inner")
    several = spill(several, "several")  # a table of its own: the rows of a frequent gram can then be split in the join
    met = spill(cut.join(several, "gram"), "shared-snippets")
    whole = (F.col("start") + F.col("many") + LENGTH - 1).alias("hi")
    equal = met.where("not differ and not any_inner").select(*where, F.col("start").alias("lo"), whole)
    mixed = met.where("differ or any_inner")
    kinds = mixed.groupBy("gram", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("id", "mark", "start")).alias("rep"), F.max("many").alias("many"))
    kinds = spill(kinds.select("gram", "whole", "copies", "rep.id", "rep.mark", "rep.start", "many"), "snippet-kinds")
    copied = mixed.join(kinds.where("copies > 1").select("gram", "whole"), ["gram", "whole"], "left_semi").select(*where, F.col("start").alias("lo"), whole)
    wanted = kinds.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "many", "gram", "copies")).alias("parts"))
    parts = docs.join(wanted, where).mapInArrow(_bytes, "gram long, id long, mark long, start long, copies long, snippet binary")
    parts = spill(parts, "snippet-bytes")
    load = parts.groupBy("gram").agg(F.sum(F.octet_length("snippet")).alias("size"))
    heavy = load.where(F.col("size") > GROUP).select("gram")
    light = parts.join(heavy, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram")
    sharded = light.mapInArrow(_shard, "id long, mark long, lo long, hi long")
    strings = parts.join(heavy, "gram", "left_semi").mapInArrow(_string_hashes, "code1 long, code2 long, id long, mark long, start long, copies long")
    strings = spill(strings, "strings")
    twice = strings.groupBy("code1", "code2").agg(F.sum("copies").alias("n")).where("n > 1").select("code1", "code2")
    single = strings.join(twice, ["code1", "code2"]).select(*where, F.col("start").alias("lo"), (F.col("start") + LENGTH).alias("hi"))
    out = spill(equal.unionAll(copied).unionAll(sharded).unionAll(single).where("hi > lo"), "spans")
    for done in (cut, several, met, kinds, parts, strings):
        drop_spill(done)
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges as maximal runs."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans): every row with the byte ranges of its text to remove, as (lo, hi), ascending and apart.

    A byte goes when a string of 200 bytes that covers it starts anywhere else too, in this text or another one;
    strings are judged on the input. Null texts count as empty; texts of fewer bytes lose nothing. Repeated rows
    are copies of each other. Ids may be null or repeat. An empty table gives no rows; other columns don't matter.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"), F.col(id_col).isNull().alias("nameless"))
    spans = repeated_spans(rows.select("id", "mark", "text"))
    runs = spans.groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    met = rows.join(runs, ["id", "mark"], "left")
    return met.select(F.when(~F.col("nameless"), F.col("id")).alias("id"), "text", "spans")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = text.encode()
            runs = merged([(s["lo"], s["hi"]) for s in spans or ()])
            left, at = hashlib.sha256(), 0
            for lo, hi in runs:
                left.update(raw[at:lo])
                at = hi
            left.update(raw[at:])
            rows.append((len(raw), sum(hi - lo for lo, hi in runs), len(runs), left.hexdigest()))
        columns = [batch.column("id")] + [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``documents``."""
    return removed_spans(table(spark, sf_dir, "documents")).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: The same digests from the hashes of all strings of the length, over hexadecimal text.
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS k FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE len(h) >= {2 * LENGTH})),
twice AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i > lag(i, 1, -{LENGTH + 1}) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} AS begins FROM s WHERE k IN (SELECT k FROM twice)),
run AS (SELECT doc_id, i, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit),
span AS (SELECT doc_id, run, min(i) AS lo, max(i) + {LENGTH} AS hi FROM run GROUP BY ALL),
edge AS (SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS lo, lo AS hi FROM span
  UNION ALL SELECT doc_id, max(hi), NULL FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, len(h) // 2) - lo)), '' ORDER BY lo) AS k FROM edge JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""
