"""Line deduplication by pairwise alignment of documents that share rare lines.

The lines of all documents are hashed, and so is every run of shorter lines that is just long enough for a block.
Documents overlap where they share a rare one, which at most ``RARE`` documents have: all of them are aligned with one
another. A frequent one points to the first document that has it, which each other document is aligned with, so no
overlap is lost and the number of alignments is bounded by the number of lines, also where thousands of copies share a
line. An alignment is a patience diff: lines that occur once in both
documents are matched in their longest common order, the gaps between them are aligned the same way, and matches grow
over equal lines on both sides. What it leaves is matched by the hashes of its runs, so blocks that stand more than
once or in another order are found too. Runs of matched lines that hold enough words are deleted from the later
document; the first occurrence of every block stays where it is.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh, prepare, spill, table
from ._words import blocks, mix, words

#: Words of a line that can lead to an alignment by itself, and of an aligned block that is deleted.
LINE_WORDS, BLOCK_WORDS = 6, 8
#: Documents that have a rare line or run at most; all pairs of them are aligned.
RARE = 4


def patience_matches(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], ascending in both: the patience diff of two sequences of line hashes."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        at = {b[k]: k for k in range(j, j_end) if in_b[b[k]] == 1}
        anchors = [(k, at[a[k]]) for k in range(i, i_end) if in_a[a[k]] == 1 and a[k] in at]
        for k, m in _longest_order(anchors):
            out.append((k, m))
            todo.append((i, k, j, m))
            i, j = k + 1, m + 1
        if anchors:
            todo.append((i, i_end, j, j_end))
    return sorted(out)


def _longest_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that ascends in the second number too, by piles of a patience game."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[pile], piles[pile] = j, k
    out = []
    k = piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def least_runs(n_words: Sequence[int]) -> list[tuple[int, int]]:
    """The runs [i, j) of lines with words that begin or end at each line and hold just enough of them for a block.

    Every run of lines with enough words is covered by those that lie in it.
    """
    out = set()
    i = total = 0
    for j, n in enumerate(n_words):  # [i, j] is the shortest run up to line j
        total += n
        while total - n_words[i] >= BLOCK_WORDS:
            total -= n_words[i]
            i += 1
        if total >= BLOCK_WORDS:
            out.add((i, j + 1))
    j = total = 0
    for i, n in enumerate(n_words):  # [i, j) is the shortest run from line i
        while j < len(n_words) and total < BLOCK_WORDS:
            total += n_words[j]
            j += 1
        if total >= BLOCK_WORDS:
            out.add((i, j))
        total -= n
    return sorted(out)


def common_blocks(later: Sequence[int], earlier: Sequence[int], n_words: Sequence[int]) -> list[int]:
    """The lines of ``later`` in runs of enough words that ``earlier`` has too; n_words are the words of its lines.

    A run goes on over blank lines (hash 0) and breaks where either document has other lines in between. Runs that
    the alignment crosses or leaves out, as their lines occur more than once, are looked up by their lines.
    """
    keep = [i for i, x in enumerate(later) if x]
    a, b = [later[i] for i in keep], [x for x in earlier if x]
    count = [n_words[i] for i in keep]
    gone = [False] * len(a)
    start = before = None
    for i, j in [*patience_matches(a, b), (-1, -1)]:
        if before is not None and (i, j) != (before[0] + 1, before[1] + 1):
            if sum(count[start : before[0] + 1]) >= BLOCK_WORDS:
                gone[start : before[0] + 1] = [True] * (before[0] + 1 - start)
            start = None
        start = i if start is None else start
        before = i, j
    known = set(b)
    if any(not g and x in known for g, x in zip(gone, a, strict=True)):
        size = dict(zip(a, count, strict=True))
        theirs: set[tuple[int, ...]] = set()
        i = 0
        while i < len(b):  # the stretches of lines that the later document has at all
            j = i
            while j < len(b) and b[j] in size:
                j += 1
            theirs.update(tuple(b[i + k : i + m]) for k, m in least_runs([size[x] for x in b[i:j]]))
            i = j + 1
        for k, m in least_runs(count):
            if not all(gone[k:m]) and tuple(a[k:m]) in theirs:
                gone[k:m] = [True] * (m - k)
    return [i for i, g in zip(keep, gone, strict=True) if g]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the hashes of its lines (0: without a word), the number of words in each, and the hashes of its runs."""
    for batch in batches:
        for i, j, data, offsets in blocks(batch, "text"):
            code, count, ends = line_codes(data, offsets)
            where = np.concatenate([[0], ends]).astype(np.int32)
            runs, run_doc = run_codes(code, count, ends)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(i, j - i),
                    pa.ListArray.from_arrays(where, pa.array(code.view(np.int64))),
                    pa.ListArray.from_arrays(where, pa.array(count.astype(np.int32))),
                    pa.ListArray.from_arrays(np.searchsorted(run_doc, np.arange(len(where))).astype(np.int32), pa.array(runs.view(np.int64))),
                ],
                names=["id", "lines", "n_words", "runs"],
            )


def line_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all lines' words (0 if none), their numbers of words, and where each document's lines end."""
    w = words(data, offsets)
    breaks = np.flatnonzero(data == 10)
    # a line ends behind its \n, and each document's last line at its end
    order = np.sort(np.concatenate([breaks * 2 + 1, offsets[1:] * 2]), kind="stable")
    same = np.arange(len(offsets) - 1) - np.searchsorted(offsets[1:], offsets[1:])  # of empty texts that end at one place
    ends = np.searchsorted(order, offsets[1:] * 2) + same + 1
    bound = order // 2
    first = np.searchsorted(w.start, np.concatenate([[0], bound]))
    count = np.diff(first)
    place = (np.arange(len(w.code)) - np.repeat(first[:-1], count)).astype(np.uint64)
    term = mix(w.code + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    code = mix(total[first[1:]] - total[first[:-1]] + count.astype(np.uint64))
    code[count == 0] = 0
    return code, count, ends


def run_codes(code: np.ndarray, count: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``least_runs`` that have more than one line, and each one's document, ascending."""
    doc = np.searchsorted(ends, np.arange(len(code)), "right")
    code, doc, count = code[count > 0], doc[count > 0], count[count > 0]
    n = len(code)
    total = np.concatenate([[0], np.cumsum(count)])
    line = np.arange(n)
    first = np.concatenate([line, np.searchsorted(total, total[1:] - BLOCK_WORDS, "right") - 1])
    last = np.concatenate([np.searchsorted(total, total[:-1] + BLOCK_WORDS) - 1, line])
    inside = (first >= 0) & (last < n) & (first < last)
    first, last = first[inside], last[inside]
    whole = doc[first] == doc[last]
    first, last = first[whole], last[whole]
    out = (last - first + 1).astype(np.uint64)
    for k in range(BLOCK_WORDS):  # each line has a word at least
        has = first + k <= last
        out[has] = mix(out[has] * np.uint64(0x9E3779B97F4A7C15) + code[first[has] + k])
    order = np.argsort(doc[first], kind="stable")
    return out[order], doc[first][order]


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        later, earlier, n_words = (batch.column(c).to_pylist() for c in ("lines", "own_lines", "n_words"))
        found = [common_blocks(a, b, n) for a, b, n in zip(later, earlier, n_words, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int32()))], names=["id", "gone"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, gone): the numbers of the lines, from 0, that each document with such lines loses.

    Lines are compared by their words, however few; lines end at a line feed. The earlier document is the one of the
    smaller id, and a block that several earlier documents have goes once. Texts and lines may be of any length.
    Rows with a null id and null or empty texts lose nothing. Texts under one id are one document after the other
    and lose the lines that any of them would. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    hashed = spill(plain.mapInArrow(_lines, "id long, lines array<bigint>, n_words array<int>, runs array<bigint>"), "lines")
    lone = F.transform(F.filter(F.arrays_zip("lines", "n_words"), lambda x: x["n_words"] >= LINE_WORDS), lambda x: x["lines"])
    each = hashed.select("id", F.explode(F.array_union(lone, "runs")).alias("line")).distinct()
    # a table of its own, so that the join's inputs are plain shuffles and the rows of a frequent line can be split
    owner = spill(each.groupBy("line").agg(F.min("id").alias("own"), F.count("*").alias("n")).where("n > 1").select("line", "own", "n"), "owners")
    rare = each.join(owner.where(f"n <= {RARE}").select("line"), "line").groupBy("line").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # RARE ids at most
    met = F.explode(F.flatten(F.transform("ids", lambda x, k: F.transform(F.slice("ids", F.lit(1), k), lambda y: F.struct(x.alias("id"), y.alias("own"))))))
    often = each.join(owner.where(f"n > {RARE}"), "line").where("own < id").select("id", "own")
    pairs = spill(rare.select(met.alias("pair")).select("pair.id", "pair.own").unionAll(often).distinct(), "line-pairs")
    theirs = hashed.select(F.col("id").alias("own"), F.col("lines").alias("own_lines"))
    met = pairs.join(theirs, "own").join(hashed, "id").select("id", "lines", "n_words", "own_lines")
    found = met.mapInArrow(_align, "id long, gone array<int>").where(F.size("gone") > 0)
    return found.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def cut_lines(text: str | None, gone: Sequence[int] | None) -> str | None:
    """The text without the lines of these numbers, each with its line feed."""
    if not text or not gone:
        return text
    without = set(gone)
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in without)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_empty: bool = True) -> DataFrame:
    """``docs`` with the repeated blocks cut from the later documents' texts, all other columns as they are.

    A document that loses all its words is dropped unless ``drop_empty`` is false; one that had none stays. Columns may
    be called anything.
    """
    one, two = fresh(docs.columns, "id_"), fresh(docs.columns, "gone_")
    gone = repeated_lines(docs, id_col, text_col).select(F.col("id").alias(one), F.col("gone").alias(two))
    met = docs.join(gone, docs[id_col].cast("long") == F.col(one), "left").drop(one)
    at = docs.columns.index(text_col)
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = batch.column(len(schema)).to_pylist()
            columns = [batch.column(k) for k in range(len(schema))]
            if any(lost):
                texts = columns[at].to_pylist()
                left = [cut_lines(t, g) for t, g in zip(texts, lost, strict=True)]
                columns[at] = pa.array(left, columns[at].type)
                out = pa.RecordBatch.from_arrays(columns, names=schema.names)
                if drop_empty:
                    out = out.filter(pa.array([not g or bool(words_in(x)) for g, x in zip(lost, left, strict=True)]))
                yield out
            else:
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return met.mapInArrow(cut, schema)


def words_in(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return len(words(raw, np.array([0, len(raw)])).code)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, t or "", g or []) for d, t, g in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "gone")), strict=True)]
        left = [cut_lines(t, g) for _, t, g in rows]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([t.count("\n") + 1 if t else 0 for _, t, _ in rows], pa.int64()),
                pa.array([len(g) for _, _, g in rows], pa.int64()),
                pa.array([len(x) for x in left], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in left], pa.string()),
            ],
            names=["doc_id", "n_lines", "n_removed", "n_chars_kept", "kept_sha256"],
        )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_chars_kept, kept_sha256) for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = repeated_lines(docs).withColumnRenamed("id", "doc_id")
    return docs.join(gone, "doc_id", "left").mapInArrow(_digest, "doc_id long, n_lines long, n_removed long, n_chars_kept long, kept_sha256 string")
