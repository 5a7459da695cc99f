"""Reference pictures: sets of differences, lists, marking, the collocated picture and the decoded-picture buffer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship
from ..sources.tables import table
from .order import POC_SQL, order_counts, picture_stream


def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reference sets: line items by parity are earlier and later pictures, the return flag says if used.

    Rows (set_id, poc, side, idx, step, used); idx orders a side, step is the difference to the entry before.
    """
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    side = F.when(F.col("l_partkey") % 2 == 0, "neg").otherwise("pos")
    w = Window.partitionBy("set_id", "side").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    rows = line.select(F.col("l_orderkey").alias("set_id"), (F.col("l_orderkey") % 97).alias("poc"), side.alias("side"), (F.col("l_quantity").cast("long") % 8 + 1).alias("step"), (F.col("l_returnflag") != "R").alias("used"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    return rows.withColumn("idx", F.row_number().over(w) - 1).select("set_id", "poc", "side", F.col("idx").cast("long").alias("idx"), "step", "used")


def reference_set(rows: DataFrame) -> DataFrame:
    """Adds the order count of each entry: the running sum of steps away from the current picture, and its list."""
    w = Window.partitionBy("set_id", "side").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.sum("step").over(w) * F.when(F.col("side") == "neg", -1).otherwise(1)
    out = rows.withColumn("delta", delta).withColumn("ref_poc", F.col("poc") + F.col("delta"))
    return out.withColumn("list", F.when(~F.col("used"), "following").otherwise(F.col("side")))


def reference_lists(sets: DataFrame, most0: int, most1: int) -> DataFrame:
    """(set_id, poc, list0, list1): earlier then later pictures, and the other way round, cut but never repeated."""
    entry = F.struct("idx", "ref_poc")
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == s, entry))), lambda e: e["ref_poc"])
    g = sets.groupBy("set_id", "poc").agg(side("neg").alias("neg"), side("pos").alias("pos"))
    return g.select("set_id", "poc", F.slice(F.concat("neg", "pos"), 1, most0).alias("list0"), F.slice(F.concat("pos", "neg"), 1, most1).alias("list1"))


def predicted_set(base: DataFrame, change: DataFrame) -> DataFrame:
    """Sets predicted from others: rows (set_id, poc, place, delta, used, use_delta) -> rows with their list.

    Entries of the referenced set in the order earlier, later, following, then the difference between both sets;
    an entry stays if it is used or its difference is. A zero difference that is used goes to the following ones.
    """
    kept = base.join(change, ["set_id", "place"]).where("used or use_delta")
    where = F.when((F.col("delta") < 0) & F.col("used"), "neg").when((F.col("delta") > 0) & F.col("used"), "pos")
    where = where.when(F.col("delta") != 0, "following").when(F.col("used"), "following")
    return kept.withColumn("list", where).where("list is not null").withColumn("ref_poc", F.col("poc") + F.col("delta"))


def mark_references(pictures: DataFrame) -> DataFrame:
    """(…, marking) by membership: long-term beats short-term, the current picture and other layers are left as they are."""
    held = (F.col("layer") != F.col("current_layer")) | (F.col("poc") == F.col("current_poc"))
    by = F.when(F.array_contains("long_term", F.col("poc")), "long").when(F.array_contains("short_term", F.col("poc")), "short").otherwise("unused")
    return pictures.withColumn("marking", F.when(held, F.col("marking")).otherwise(by))


def collocated(lists: DataFrame) -> DataFrame:
    """Adds the collocated picture (null beyond its list) and whether a B slice predicts from no later picture."""
    chosen = F.when(F.col("from_l0"), F.get("list0", F.col("ref_idx").cast("int"))).otherwise(F.get("list1", F.col("ref_idx").cast("int")))
    quiet = F.col("is_b") & F.forall("list1", lambda p: p <= F.col("poc"))
    return lists.withColumn("collocated", chosen).withColumn("no_backward", F.when(chosen.isNotNull(), quiet))


def decoded_picture_buffer(pictures: DataFrame) -> DataFrame:
    """What each picture (stream_id, pic_id, poc, used, waiting, capacity) evicts, and what its buffer holds after it.

    A full buffer loses its first picture that is unused and not awaiting output, else its oldest. Streams are
    sorted by coded order and pass through in batches; the state is one buffer, however long a stream is.
    """
    ship(pictures.sparkSession)
    dealt = pictures.repartition("stream_id").sortWithinPartitions("stream_id", "pic_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # sorted batches: a stream's rows lie together, also over batches; only the buffer of the last stream is kept
        state: dict = {}
        for batch in batches:
            out = []
            for row in zip(*(batch[c] for c in ("stream_id", "pic_id", "poc", "used", "waiting", "capacity")), strict=True):
                if state.get("stream") != row[0]:
                    state = {"stream": row[0], "held": []}
                out.append(_advance(*row, state["held"]))
            yield pd.DataFrame(out, columns=["stream_id", "pic_id", "evicted", "n_held", "held"]).astype({"evicted": "Int64"})

    return dealt.mapInPandas(run, "stream_id long, pic_id long, evicted long, n_held long, held string")


def _advance(stream: int, pic: int, poc: int, used: bool, waiting: bool, room: int, held: list) -> tuple:
    evicted = None
    if room:
        if len(held) >= room:
            gone = next((i for i, (_, u, w) in enumerate(held) if not u and not w), 0)
            evicted = held.pop(gone)[0]
        held.append((int(poc), bool(used), bool(waiting)))
    return stream, pic, evicted, len(held), ",".join(str(p) for p, _, _ in held)


def o3_poc_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-count differences of consecutive pictures."""
    p = order_counts(picture_stream(spark, sf_dir))
    before = F.lag("poc", 1).over(Window.partitionBy("stream_id").orderBy("pic_id"))
    return p.select("stream_id", "pic_id", (F.col("poc") - before).alias("diff"))


def o4_picture_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_counts(picture_stream(spark, sf_dir))
    rows = p.select("stream_id", "pic_id", "poc", (F.col("pic_id") % 3 != 0).alias("used"), (F.col("pic_id") % 5 == 0).alias("waiting"), (F.col("stream_id") % 5).alias("capacity"))
    return decoded_picture_buffer(rows)


def o5_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_counts(picture_stream(spark, sf_dir)).select("stream_id", "pic_id", "poc", (F.col("pic_id") % 2).alias("layer"), F.lit("short").alias("marking"), F.lit(0).cast("long").alias("current_layer"))
    p = p.withColumn("current_poc", F.lit(7).cast("long")).withColumn("long_term", F.expr("array(3L, 12L, 20L)")).withColumn("short_term", F.expr("array(1L, 3L, 5L, 7L, 9L)"))
    return mark_references(p).select("stream_id", "pic_id", "poc", "marking")


def o6_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short-term references of layer 0 of each stream in ascending order count."""
    p = o5_marking(spark, sf_dir).where("marking = 'short' and pic_id % 2 = 0")
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy("poc", "pic_id")) - 1
    return p.select("stream_id", "pic_id", "poc", rank.cast("long").alias("rank"))


def o8_reference_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_set(reference_rows(spark, sf_dir)).select("set_id", "side", "idx", "ref_poc", "list")


def o9_predicted_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every set predicted from itself, moved by a difference that its id gives; flags by place."""
    s = reference_set(reference_rows(spark, sf_dir))
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy(F.expr("array_position(array('neg', 'pos', 'following'), list)"), F.expr("side = 'pos'"), "idx")) - 1
    base = s.select("set_id", "poc", rank.cast("long").alias("place"), "delta")
    last = base.groupBy("set_id", "poc").agg((F.max("place") + 1).alias("place")).withColumn("delta", F.expr("if(set_id % 2 = 0, -1, 1) * (set_id % 4 + 1)"))
    base = base.unionByName(last.select("set_id", "poc", "place", "delta"))
    change = base.select("set_id", "place", ((F.col("set_id") + F.col("place")) % 3 != 0).alias("used"), ((F.col("set_id") + F.col("place")) % 2 == 0).alias("use_delta"))
    return predicted_set(base, change).select("set_id", "place", "ref_poc", "list")


def o11_reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = reference_lists(reference_set(reference_rows(spark, sf_dir)), 4, 3)
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return lists.select("set_id", "poc", join(F.col("list0")).alias("list0"), join(F.col("list1")).alias("list1"))


def o12_collocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = reference_lists(reference_set(reference_rows(spark, sf_dir)), 4, 3)
    lists = lists.withColumn("is_b", F.col("set_id") % 3 != 0).withColumn("from_l0", F.col("set_id") % 2 == 0).withColumn("ref_idx", F.col("set_id") % 4)
    return collocated(lists).select("set_id", "collocated", "no_backward")


QUERIES = {
    "o3_poc_differences": o3_poc_differences, "o4_picture_buffer": o4_picture_buffer, "o5_marking": o5_marking, "o6_references": o6_references, "o8_reference_set": o8_reference_set,
    "o9_predicted_set": o9_predicted_set, "o11_reference_lists": o11_reference_lists, "o12_collocated": o12_collocated,
}

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag"
SETS_SQL = f"""r AS (SELECT l_orderkey AS set_id, l_orderkey % 97 AS poc, CASE WHEN l_partkey % 2 = 0 THEN 'neg' ELSE 'pos' END AS side, CAST(l_quantity AS BIGINT) % 8 + 1 AS step, l_returnflag <> 'R' AS used, {_ORDER} FROM lineitem),
s0 AS (SELECT *, row_number() OVER (PARTITION BY set_id, side ORDER BY {_ORDER}) - 1 AS idx FROM r),
s1 AS (SELECT *, CAST(sum(step) OVER (PARTITION BY set_id, side ORDER BY idx) AS BIGINT) * CASE WHEN side = 'neg' THEN -1 ELSE 1 END AS delta FROM s0),
sets AS (SELECT set_id, poc, side, idx, delta, poc + delta AS ref_poc, CASE WHEN used THEN side ELSE 'following' END AS list FROM s1)"""
_LISTS_SQL = f"""{SETS_SQL}, g AS (SELECT set_id, poc, coalesce(list(ref_poc ORDER BY idx) FILTER (list = 'neg'), []) AS neg, coalesce(list(ref_poc ORDER BY idx) FILTER (list = 'pos'), []) AS pos FROM sets GROUP BY set_id, poc),
lists AS (SELECT set_id, poc, (neg || pos)[1:4] AS list0, (pos || neg)[1:3] AS list1 FROM g)"""
_MARK = """CASE WHEN pic_id % 2 <> 0 OR poc = 7 THEN 'short' WHEN poc IN (3, 12, 20) THEN 'long' WHEN poc IN (1, 5, 9) THEN 'short' ELSE 'unused' END"""
ORACLE = {
    "o4_picture_buffer": f"""WITH RECURSIVE {POC_SQL},
n AS (SELECT stream_id, pic_id, {{'poc': poc, 'free': pic_id % 3 = 0 AND pic_id % 5 <> 0}} AS new, stream_id % 5 AS room, row_number() OVER (PARTITION BY stream_id ORDER BY pic_id) AS k FROM counted),
s AS (SELECT stream_id, pic_id, k, room, CAST(NULL AS BIGINT) AS evicted, CASE WHEN room > 0 THEN [new] ELSE [] END AS held FROM n WHERE k = 1
  UNION ALL SELECT stream_id, pic_id, k, room, CASE WHEN gone > 0 THEN held[gone].poc END,
    CASE WHEN room = 0 THEN held ELSE list_append(CASE WHEN gone > 0 THEN list_concat(held[1:gone - 1], held[gone + 1:]) ELSE held END, new) END
  FROM (SELECT n.stream_id, n.pic_id, n.k, n.room, n.new, s.held, CASE WHEN n.room > 0 AND len(s.held) >= n.room
      THEN CASE WHEN list_contains(list_transform(s.held, lambda h: h.free), TRUE) THEN list_position(list_transform(s.held, lambda h: h.free), TRUE) ELSE 1 END ELSE 0 END AS gone FROM s JOIN n ON n.stream_id = s.stream_id AND n.k = s.k + 1))
SELECT stream_id, pic_id, evicted, len(held)::BIGINT AS n_held, array_to_string(list_transform(held, lambda h: h.poc), ',') AS held FROM s""",
    "o3_poc_differences": f"WITH {POC_SQL} SELECT stream_id, pic_id, poc - lag(poc) OVER (PARTITION BY stream_id ORDER BY pic_id) AS diff FROM counted",
    "o5_marking": f"WITH {POC_SQL} SELECT stream_id, pic_id, poc, {_MARK} AS marking FROM counted",
    "o6_references": f"""WITH {POC_SQL}, m AS (SELECT stream_id, pic_id, poc, {_MARK} AS marking FROM counted)
SELECT stream_id, pic_id, poc, row_number() OVER (PARTITION BY stream_id ORDER BY poc, pic_id) - 1 AS rank FROM m WHERE marking = 'short' AND pic_id % 2 = 0""",
    "o8_reference_set": f"WITH {SETS_SQL} SELECT set_id, side, idx, ref_poc, list FROM sets",
    "o9_predicted_set": f"""WITH {SETS_SQL},
p AS (SELECT set_id, poc, row_number() OVER (PARTITION BY set_id ORDER BY list_position(['neg', 'pos', 'following'], list), side = 'pos', idx) - 1 AS place, delta FROM sets),
b AS (SELECT * FROM p UNION ALL SELECT set_id, poc, max(place) + 1, CASE WHEN set_id % 2 = 0 THEN -1 ELSE 1 END * (set_id % 4 + 1) FROM p GROUP BY set_id, poc),
f AS (SELECT *, (set_id + place) % 3 <> 0 AS used, (set_id + place) % 2 = 0 AS use_delta FROM b)
SELECT set_id, place, poc + delta AS ref_poc, CASE WHEN delta < 0 AND used THEN 'neg' WHEN delta > 0 AND used THEN 'pos' ELSE 'following' END AS list FROM f WHERE used OR (use_delta AND delta <> 0)""",
    "o11_reference_lists": f"WITH {_LISTS_SQL} SELECT set_id, poc, array_to_string(list0, ',') AS list0, array_to_string(list1, ',') AS list1 FROM lists",
    "o12_collocated": f"""WITH {_LISTS_SQL}, c AS (SELECT set_id, poc, list1, CASE WHEN set_id % 2 = 0 THEN list0[set_id % 4 + 1] ELSE list1[set_id % 4 + 1] END AS collocated FROM lists)
SELECT set_id, collocated, CASE WHEN collocated IS NOT NULL THEN set_id % 3 <> 0 AND len(list_filter(list1, lambda p: p > poc)) = 0 END AS no_backward FROM c""",
}
