"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

A document is the multiset of its five-word shingles; two documents are linked when their weighted Jaccard
similarity (sum of smaller counts over sum of larger counts) is 0.8 or more. An element of weight w owns the
region [0, w) x [0, inf) of (weight, rank). Every unit of weight is thrown a stream of darts, a Poisson process
over the rank whose gaps, coordinates and identities are hashes of the element, the unit and the dart's number;
a document keeps the earliest dart in each of its ``k`` coordinates. Darts beyond a rank bound of about
(k ln k + 2k) / weight are not thrown unless a coordinate stays empty, which makes a signature cost little more
than reading the shingles. Two documents agree in a coordinate with the probability of their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import components, drop_spill, fresh, prepare, spill, table
from ._sql import WORDS as WORDS_SQL
from ._words import blocks, mix, shingles, words

WORDS = 5
BANDS, ROWS = 24, 4
#: Similarity as a fraction, so that the comparison is one of integers.
SIMILAR = (4, 5)

_GAP, _PLACE, _UNIT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA24BAED4963EE407))


def dart_signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """The earliest dart in each of k coordinates, for documents given as (element, weight, doc) sorted by doc.

    Weights are real and positive; darts of a unit of weight that lie beyond the weight are discarded. Rows of
    documents without elements are zero.
    """
    units = np.ceil(weight).astype(np.int64)
    row = np.repeat(np.arange(len(element)), units)
    unit = np.arange(len(row)) - np.repeat(np.cumsum(units) - units, units)
    room, of = weight[row] - unit, doc[row]
    state = mix(element[row] + (unit.astype(np.uint64) + np.uint64(1)) * _UNIT)
    total = np.bincount(of, weights=np.minimum(room, 1), minlength=n_docs)
    bound = (k * np.log(max(k, 2)) + 2 * k) / np.maximum(total, 1e-300)
    best, name = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, np.uint64)
    rank, thrown = np.zeros(len(row)), np.zeros(len(row), np.uint64)
    live = np.arange(len(row))
    while len(live):
        now = live
        while len(now):  # as many darts at a time as are expected below the bound
            several = np.clip(np.ceil(bound[of[now]] - rank[now]), 1, 256).astype(np.int64)
            ends = np.cumsum(several)
            who = np.repeat(now, several)
            step = (np.arange(len(who)) - np.repeat(ends - several, several)).astype(np.uint64) + thrown[who] + np.uint64(1)
            dart = mix(state[who] + step * _GAP)
            gap = -np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            run = np.cumsum(gap)
            run -= np.repeat(run[ends - several] - gap[ends - several], several)
            run += rank[who]
            _earliest(best, name, dart, run, of[who], room[who], k)
            thrown[now] += several.astype(np.uint64)
            rank[now] = run[ends - 1]
            now = now[rank[now] < bound[of[now]]]
        empty = (best.reshape(n_docs, k) >= bound[:, None]).any(1)  # a coordinate without a dart below the bound
        bound[empty] *= 2
        live = live[empty[of[live]]]
    return name.reshape(n_docs, k)


def _earliest(best: np.ndarray, name: np.ndarray, dart: np.ndarray, rank: np.ndarray, of: np.ndarray, room: np.ndarray, k: int) -> None:
    place = mix(dart ^ _PLACE)
    at = of * k + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
    good = ((place >> np.uint64(32)).astype(np.float64) * 2.0**-32 < room) & (rank < best[at])
    at, rank, dart = at[good], rank[good], dart[good]
    order = np.lexsort((dart, rank, at))
    at, rank, dart = at[order], rank[order], dart[order]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    best[at[first]], name[at[first]] = rank[first], dart[first]


def _counted(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (code, doc), sorted by doc, with their counts."""
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return code[at], np.diff(np.append(at, len(code))), doc[at]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factor = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        for i, j, data, offsets in blocks(batch, "text"):
            w = words(data, offsets)
            n = j - i
            code, doc = shingles(w, WORDS)
            element, weight, of = _counted(code, doc)
            names = dart_signatures(element, weight.astype(np.float64), of, n, BANDS * ROWS)
            bands = mix((names * factor).reshape(n, BANDS, ROWS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _UNIT)
            some = np.diff(w.first) > 0
            keys = []
            for salt in (_GAP, _PLACE):  # of the sequence of words
                up = mix((np.arange(len(w.code)) - np.repeat(w.first[:-1], np.diff(w.first))).astype(np.uint64) * _UNIT + salt) | np.uint64(1)
                total = np.zeros(n, np.uint64)
                if some.any():
                    total[some] = np.add.reduceat(mix(w.code ^ salt) * up, w.first[:-1][some])
                keys.append(mix(total).view(np.int64)[some])
            m = int(some.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(i, n).filter(pa.array(some)),
                    pa.array(keys[0]),
                    pa.array(keys[1]),
                    pa.array(np.bincount(doc, minlength=n)[some].astype(np.int64)),
                    pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * BANDS, pa.array(bands[some].reshape(-1).view(np.int64))),
                ],
                names=["id", "key1", "key2", "n", "bands"],
            )


def similar_rows(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether the texts a[i] and b[i] have a weighted Jaccard similarity of five-word shingles of 0.8 or more."""
    parts = []
    for side, texts in enumerate((a, b)):
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        for i, _, data, offsets in blocks(batch, "text"):
            code, doc = shingles(words(data, offsets), WORDS)
            parts.append((code, doc + i, np.full(len(code), side)))
    code, pair, side = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(code):
        return np.zeros(len(a), bool)
    order = np.lexsort((code, pair))
    code, pair, side = code[order], pair[order], side[order]
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(first)
    right = np.add.reduceat(side, at)
    left = np.diff(np.append(at, len(code))) - right
    shared = np.bincount(pair[at], weights=np.minimum(left, right), minlength=len(a))
    joint = np.bincount(pair[at], weights=np.maximum(left, right), minlength=len(a))
    return (joint > 0) & (shared * SIMILAR[1] >= joint * SIMILAR[0])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, size = 0, pa.compute.add(pa.compute.binary_length(batch.column("left")), pa.compute.binary_length(batch.column("right"))).to_numpy(zero_copy_only=False)
        while at < batch.num_rows:
            upto = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), 1 << 20)))
            part = batch.slice(at, upto - at)
            good = pa.array(similar_rows(part.column("left"), part.column("right")))
            yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], names=["a", "b"])
            at = upto


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shingle; the second and later occurrences of a shingle in a text are tokens of their own."""
    for batch in batches:
        for i, j, data, offsets in blocks(batch, "text"):
            element, weight, of = _counted(*shingles(words(data, offsets), WORDS))
            row = np.repeat(np.arange(len(element)), weight)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(weight) - weight, weight)
            part, take = batch.slice(i, j - i), pa.array(of[row])
            token = mix(element[row] + turn.astype(np.uint64) * _UNIT)
            yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("label").take(take), pa.array(token.view(np.int64))], names=["id", "label", "token"])


def _prefix_pairs(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels among (id, label, text) that can be similar: exact, by rarest tokens.

    With the tokens of every text in the order of their frequency, two similar texts share one of the first
    n - ceil(0.8 n) + 1. What makes a near copy differ is rare and comes first, so copies of one text that differ
    too much from it meet nobody. Tokens of one label alone make no pairs; sizes (id, n) and the places of the
    shared token leave out most others.
    """
    low, high = SIMILAR
    token = spill(texts.select("id", "label", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_tokens, "id long, label long, token long"), "tokens")
    often = token.groupBy("token").agg(F.count("*").alias("df"), (F.min("label") != F.max("label")).alias("mixed")).where("df > 1")
    often = spill(often, "often")
    mine = Window.partitionBy("id")
    placed = token.select("id", "token").join(often, "token").select("*", F.row_number().over(mine.orderBy("df", "token")).alias("rank"), F.count("*").over(mine).alias("shared"))
    placed = placed.where("mixed").join(texts.select("id", "label").distinct().join(sizes, "id"), "id").withColumn("at", F.expr("rank + n - shared"))
    prefix = spill(placed.where(f"at <= n - (({low} * n + {high - 1}) div {high}) + 1").select("token", "id", "label", "n", "at"), "prefix")
    x, y = (prefix.select("token", *(F.col(c).alias(c + s) for c in ("id", "label", "n", "at"))) for s in ("1", "2"))
    size = (F.col("n1") * high >= F.col("n2") * low) & (F.col("n2") * high >= F.col("n1") * low)
    room = (F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) + 1) * (low + high) >= (F.col("n1") + F.col("n2")) * low
    met = x.join(y, (x.token == y.token) & (x.id1 < y.id2) & (x.label1 != y.label2) & size & room)
    return met.select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct()


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id): classes of documents that links of similarity 0.8 or more join, named by their smallest id.

    Texts with equal word sequences are one class from the start and go on as one representative. Each bucket of
    a band links its members to the one that meets most others in all its buckets, which takes one comparison per
    member however large the bucket; the links are verified on the whole texts. Texts of a bucket that this has not
    brought into one class are then joined on their rarest shingles, which finds every link between them without
    listing the pairs of a large group. A pair at the threshold shares no bucket with a probability of 3e-6.

    Texts that are null or hold no word are each a class of their own. Texts of one to four words are one
    shingle. Rows with equal ids share their class; a row whose id is null has the class null. An empty table
    gives an empty result; columns other than the id and the text don't matter.
    """
    spark = docs.sparkSession
    prepare(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = spill(plain.where("id is not null").mapInArrow(_sketch, "id long, key1 long, key2 long, n long, bands array<bigint>"), "sketch")
    # tables of their own, so that the join's inputs are plain shuffles and a hot key's rows can be split
    least = spill(sketch.groupBy("key1", "key2").agg(F.min("id").alias("rep")), "least")
    member = spill(sketch.select("id", "key1", "key2").join(least, ["key1", "key2"]).select("id", "rep").distinct(), "member")
    lone = sketch.join(member.where("id = rep").select("id").distinct(), "id", "left_semi")
    bucket = lone.select("id", F.explode("bands").alias("band"))
    met = spill(bucket.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "met")
    bucket = spill(bucket.join(met, "band"), "bucket")
    central = bucket.groupBy("id").agg(F.sum("m").alias("met"))
    centre = bucket.join(central, "id").groupBy("band").agg(F.max(F.struct("met", (-F.col("id")).alias("minus"))).alias("best")).select("band", (-F.col("best.minus")).alias("centre"))
    centre = spill(centre, "centre")
    star = bucket.join(centre, "band").where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    star = spill(star, "star")
    texts = spill(plain.join(bucket.select("id").distinct().hint("merge"), "id", "left_semi"), "candidate-text")  # one plan at every size

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
        right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right")).mapInArrow(_verify, "a long, b long")

    links = spill(verified(star), "links")
    label = components(links).withColumnRenamed("node", "id")
    named = spill(bucket.select("band", "id").join(label, "id", "left").select("band", "id", F.coalesce("component", "id").alias("label")), "named")
    mixed = spill(named.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band"), "mixed")
    sizes = lone.groupBy("id").agg(F.max("n").alias("n"))
    apart = named.join(mixed, "band").select("id", "label").distinct()
    more = spill(verified(_prefix_pairs(texts.join(apart, "id"), sizes).join(star, ["a", "b"], "left_anti")), "links")
    final = components(links.unionAll(more))
    rep = member.join(final.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("class_id"))
    rep = spill(rep, "class")
    for done in (least, met, bucket, centre, star, texts, named, mixed, links, more, member):
        drop_spill(done)
    return plain.select("id").join(rep, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that have the smallest id of their near-duplicate class, with all columns of ``docs``.

    Rows with a null id, and texts without a word, stay. Rows that share the smallest id all stay. Columns may be called
    anything.
    """
    classes = near_duplicate_classes(docs, id_col, text_col)
    name = fresh(docs.columns, "gone")
    gone = classes.where("class_id < id").select(F.col("id").alias(name)).distinct()
    return docs.join(gone, docs[id_col] == F.col(name), "left_anti")


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, kept) for every row of ``documents``."""
    out = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


#: The same classes from all pairs that share a shingle.
ORACLE_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce({WORDS_SQL.format("text")}, []) AS w FROM documents),
sh AS (SELECT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WORDS - 1})) AS i FROM d WHERE len(w) >= {WORDS})
  UNION ALL SELECT doc_id, '|' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {WORDS - 1}),
c AS (SELECT doc_id, s, count(*) AS n FROM sh GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS i FROM c a JOIN c b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN t a ON a.doc_id = x JOIN t b ON b.doc_id = y WHERE i * {SIMILAR[1]} >= (a.n + b.n - i) * {SIMILAR[0]}),
r AS (SELECT DISTINCT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON r.node = l.x),
m AS (SELECT node, min(root) AS class_id FROM r GROUP BY node)
SELECT doc_id, class_id, doc_id = class_id AS kept FROM documents JOIN m ON node = doc_id"""
