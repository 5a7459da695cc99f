"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c), so the links are the pairs within a radius. The different
vectors of a label are the points of one cover tree, whose top level is dealt over tasks: each vector goes to the
nearest of at most ``CENTRES`` centres, and the covering radius of a region is that of all its members. Two regions
whose centres are further apart than both radii and the threshold never meet. Regions of more than ``BLOCK`` vectors
are several blocks. The tree of a block (nested levels whose radii halve, every node a net of its parent's points) is
grown once and stored with its vectors; each pair of blocks that can hold a link is a task of bounded size that walks
both trees at once. A pair of nodes is dropped when its centres are further apart than the threshold and both covering
radii, taken whole when the covering radii can't carry any pair beyond the threshold, and else opened; single vectors
that are left are compared by cosine. The walk goes over arrays of node pairs, not over one pair after the other.
Tasks return counts and a spanning forest, never their pairs, so a large group of near copies costs rows in proportion
to its members.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import components, prepare, spill, table

COSINE = 0.93
#: Different vectors of a block; a task holds two blocks.
BLOCK = 4096
#: Regions of a label at most; what bounds the table of centres that is held against a vector.
CENTRES = 256
#: Vectors that are dealt to regions in one task.
DEALT = 16_384
#: Slack of the bounds, far above the rounding of distances and far below what separates vectors.
SLACK = 1e-7
#: Child pairs of two nodes from which their distances are a matrix product, and entries of such a product.
DENSE, ENTRIES = 4096, 1 << 20


def unit_vectors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors scaled by powers of two so that no square over- or underflows, their norms, and the unit vectors."""
    x = x * 2.0 ** -np.floor(np.log2(np.abs(x).max(1, keepdims=True)))
    norm = np.sqrt((x * x).sum(1))
    return x, norm, x / norm[:, None]


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


def net(unit: np.ndarray, points: np.ndarray, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The points in groups within ``scale`` of each one's first, which is further than that from all earlier firsts;
    with the distances from it. The first point of all begins the first group."""
    out = []
    while len(points):
        heads = unit[points[:128]]
        dots = heads @ unit[points].T
        near = dots >= 1 - scale * scale / 2
        free = np.ones(len(points), bool)
        for k in range(len(heads)):
            if free[k]:
                near[k, k] = True
                mine = np.flatnonzero(near[k] & free)  # those before k are taken
                free[mine] = False
                out.append((points[mine], _distance(dots[k, mine])))
        points = points[free]
    return out


def grow(unit: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
    """The cover tree of unit vectors: the points in tree order, and for each the sizes and radii of the nodes that it
    is the centre of, from the top down. A node's points are the run of that size which its centre begins."""
    order: list[int] = []
    sizes: list[list[int]] = []
    radii: list[list[float]] = []

    def add(points: np.ndarray, distance: np.ndarray, scale: float, first: bool) -> None:
        if first:
            order.append(int(points[0]))
            sizes.append([])
            radii.append([])
        if len(points) == 1:
            return
        radius = float(distance.max())
        sizes[-1].append(len(points))
        radii[-1].append(radius)
        if radius <= SLACK:
            for k in range(1, len(points)):
                add(points[k : k + 1], distance[:1], scale, True)
            return
        while scale >= radius:
            scale /= 2
        for k, (some, d) in enumerate(net(unit, points, scale)):
            add(some, d, scale / 2, k > 0)

    add(np.arange(len(unit)), _distance(unit @ unit[0]), 2.0, True)
    return np.array(order), sizes, radii


class Tree:
    """Nodes as arrays, in the order of a walk from the top: the run of points, the radius, and the children."""

    def __init__(self, sizes: list[list[int]], radii: list[list[float]]) -> None:
        lo, hi, radius, up, above = [], [], [], [], []
        for p, (ns, rs) in enumerate(zip(sizes, radii, strict=True)):
            while above and hi[above[-1]] <= p:
                above.pop()
            for n, r in zip([*ns, 1], [*rs, 0.0], strict=True):
                up.append(above[-1] if above else -1)
                above.append(len(lo))
                lo.append(p)
                hi.append(p + n)
                radius.append(r)
        self.lo, self.hi, self.radius = np.array(lo), np.array(hi), np.array(radius)
        parent = np.array(up)
        self.kids = np.argsort(parent, kind="stable")[1:]  # the root, which has no parent, is the first
        self.many = np.bincount(parent[1:], minlength=len(lo))
        self.first = np.cumsum(self.many) - self.many

    def __add__(self, other: Tree) -> Tree:
        """Both trees over one list of points; the other's root is the node behind the last one of this tree."""
        out, n, points = object.__new__(Tree), len(self.lo), self.hi[0]
        out.lo, out.hi = np.concatenate([self.lo, other.lo + points]), np.concatenate([self.hi, other.hi + points])
        out.radius, out.many = np.concatenate([self.radius, other.radius]), np.concatenate([self.many, other.many])
        out.kids, out.first = np.concatenate([self.kids, other.kids + n]), np.concatenate([self.first, other.first + len(self.kids)])
        return out


class Forest:
    """Disjoint sets of points, joined many pairs at a time."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (self.parent != (up := self.parent[self.parent])).any():
                self.parent = up


def _run(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [lo, hi), one range after the other."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


class Links:
    """The links between the points below two nodes of a tree, found by walking both sides at once."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, tree: Tree, cosine: float) -> None:
        self.x, self.norm, self.unit = unit_vectors(x)
        self.tree, self.weight, self.cosine, self.reach = tree, weight, cosine, math.sqrt(2 - 2 * cosine)
        total = np.concatenate([[0], np.cumsum(weight)])
        self.held = total[tree.hi] - total[tree.lo]
        self.step, self.own = np.zeros(len(x) + 1, np.int64), np.zeros(len(x) + 1, np.int64)
        self.forest = Forest(len(x))
        self.todo: list[tuple] = []
        self.room = max(1, (4 * ENTRIES) // x.shape[1])

    def counts(self) -> np.ndarray:
        """For each point the summed weight of the points it links to, itself left out."""
        return np.cumsum(self.step)[:-1] - np.cumsum(self.own)[:-1] * self.weight

    def walk(self, a: int, b: int) -> None:
        self._judge(np.array([a]), np.array([b]), (self.unit[self.tree.lo[[a]]] * self.unit[self.tree.lo[[b]]]).sum(1))
        while self.todo:
            self._open(*self.todo.pop())

    def _judge(self, a: np.ndarray, b: np.ndarray, dots: np.ndarray) -> None:
        """Drop the node pairs that can't hold a link, count those that are links throughout, keep the rest to be opened."""
        t = self.tree
        both = t.radius[a] + t.radius[b]
        leaf = (t.many[a] == 0) & (t.many[b] == 0)
        near = (dots >= 1 - (self.reach + SLACK + both) ** 2 / 2) & ~(leaf & (a == b))
        a, b, dots, both, leaf = a[near], b[near], dots[near], both[near], leaf[near]
        whole = np.where(a == b, 0.0, _distance(dots)) + both < self.reach - SLACK
        close = np.flatnonzero(leaf & ~whole)
        if len(close):
            whole[close] = self._linked(t.lo[a[close]], t.lo[b[close]])
        self._count(a[whole], b[whole])
        rest = ~whole & ~leaf
        if rest.any():
            self.todo.append((a[rest], b[rest], None, 0))

    def _linked(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        got = np.concatenate([np.einsum("ij,ij->i", self.x[i[k : k + self.room]], self.x[j[k : k + self.room]]) for k in range(0, len(i), self.room)])
        got /= self.norm[i] * self.norm[j]
        out = got >= self.cosine
        for k in np.flatnonzero(np.abs(got - self.cosine) < 1e-12).tolist():  # the sum's order must not decide
            out[k] = math.fsum(self.x[i[k]] * self.x[j[k]]) / (self.norm[i[k]] * self.norm[j[k]]) >= self.cosine
        return out

    def _count(self, a: np.ndarray, b: np.ndarray) -> None:
        t = self.tree
        same, other = a == b, a != b
        for p, q in ((a, b), (b[other], a[other])):
            np.add.at(self.step, t.lo[p], self.held[q])
            np.add.at(self.step, t.hi[p], -self.held[q])
        np.add.at(self.own, t.lo[a[same]], 1)
        np.add.at(self.own, t.hi[a[same]], -1)
        for p, q in ((a, b), (b, a)):
            for k in range(0, len(p), ENTRIES // 8):  # the points of one side with the centre of the other
                some = p[k : k + ENTRIES // 8]
                self.forest.join(_run(t.lo[some], t.hi[some]), np.repeat(t.lo[q[k : k + ENTRIES // 8]], t.hi[some] - t.lo[some]))

    def _open(self, a: np.ndarray, b: np.ndarray, matrix: tuple | None, row: int) -> None:
        """Open a part of the pairs and leave the rest for later, so that little is held at a time."""
        t = self.tree
        if matrix is not None:  # the children of one pair, from a row on
            ca, cb = matrix
            rows = max(1, ENTRIES // len(cb))
            if row + rows < len(ca):
                self.todo.append((a, b, matrix, row + rows))
            some = ca[row : row + rows]
            dots = self.unit[t.lo[some]] @ self.unit[t.lo[cb]].T
            near = dots >= 1 - (self.reach + SLACK + t.radius[some][:, None] + t.radius[cb]) ** 2 / 2
            if a[0] == b[0]:
                near &= np.arange(row, row + len(some))[:, None] <= np.arange(len(cb))
            i, j = np.nonzero(near)
            self._judge(some[i], cb[j], dots[i, j])
            return
        left, right = t.many[a] > 0, t.many[b] > 0
        left, right = left & ~(right & (t.radius[b] > 2 * t.radius[a])), right & ~(left & (t.radius[a] > 2 * t.radius[b]))
        n, m = np.where(left, t.many[a], 1), np.where(right, t.many[b], 1)
        dense = n * m >= DENSE
        for k in np.flatnonzero(dense).tolist():
            sides = [t.kids[t.first[v] : t.first[v] + t.many[v]] if opened else np.array([v]) for v, opened in ((a[k], left[k]), (b[k], right[k]))]
            self.todo.append((a[k : k + 1], b[k : k + 1], tuple(sides), 0))
        a, b, left, right, n, m = (v[~dense] for v in (a, b, left, right, n, m))
        end = np.cumsum(n * m)
        if not len(end):
            return
        k = max(1, int(np.searchsorted(end, self.room, "right")))
        if k < len(a):
            self.todo.append((a[k:], b[k:], None, 0))
            a, b, left, right, n, m, end = (v[:k] for v in (a, b, left, right, n, m, end))
        pair = np.repeat(np.arange(k), n * m)
        at = np.arange(end[-1]) - np.repeat(end - n * m, n * m)
        i, j = at // m[pair], at % m[pair]
        once = (a[pair] != b[pair]) | (i <= j)
        pair, i, j = pair[once], i[once], j[once]
        ca, cb = a[pair], b[pair]
        ca = np.where(left[pair], t.kids[np.minimum(t.first[ca] + i, len(t.kids) - 1)], ca)
        cb = np.where(right[pair], t.kids[np.minimum(t.first[cb] + j, len(t.kids) - 1)], cb)
        self._judge(ca, cb, np.einsum("ij,ij->i", self.unit[t.lo[ca]], self.unit[t.lo[cb]]))


def dual_links(x: np.ndarray, weight: np.ndarray, split: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the vectors x[:split] and x[split:], or among all of x where split is 0.

    Returns for each vector the summed weight of the other vectors it links to, and the smallest vector it is joined
    with by links.
    """
    unit = unit_vectors(x)[2]
    parts = [np.arange(split), np.arange(split, len(x))] if split else [np.arange(len(x))]
    grown = [grow(unit[p]) for p in parts]
    order = np.concatenate([p[g[0]] for p, g in zip(parts, grown, strict=True)])
    count, parent = _linked(x[order], weight[order], [g[1:] for g in grown], cosine)
    least = np.full(len(x), len(x))
    np.minimum.at(least, parent, order)
    out, root = np.empty_like(count), np.empty_like(parent)
    out[order], root[order] = count, least[parent]
    return out, root


def _linked(x: np.ndarray, weight: np.ndarray, trees: list[tuple[list, list]], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sets of the points of one tree, or between those of two; the points are in tree order."""
    tree = Tree(*trees[0])
    other = len(tree.lo) if len(trees) > 1 else 0
    links = Links(x, weight, tree + Tree(*trees[1]) if other else tree, cosine)
    links.walk(0, other)
    return links.counts(), links.forest.parent


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _deal(key: tuple, rows: pa.Table, centres: pa.Table) -> pa.Table:
    """The nearest centre of each vector, of equally near ones the first, and its distance."""
    centres = centres.sort_by("region")
    near = unit_vectors(_matrix(centres.column("centre")))[2]
    unit = unit_vectors(_matrix(rows.column("embedding")))[2]
    dots = unit @ near.T
    which = dots.argmax(1)
    away = _distance(dots[np.arange(len(unit)), which])
    names = ["label", "dim", "rep", "copies", "embedding"]
    return pa.table([*(rows.column(c) for c in names), pa.array(which.astype(np.int32)), pa.array(away)], names=[*names, "region", "away"])


def _meet(cosine: float):
    """For the regions of a label: the number of the first block, the number of blocks, and those of all regions that can hold a link with it."""
    reach = math.sqrt(2 - 2 * cosine)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("region")
        unit = unit_vectors(_matrix(rows.column("centre")))[2]
        radius, blocks = rows.column("radius").to_numpy(), rows.column("blocks").to_numpy()
        base = np.cumsum(blocks) - blocks
        near = _distance(unit @ unit.T) <= reach + radius[:, None] + radius + 4 * SLACK
        np.fill_diagonal(near, True)
        met = [[{"base": int(base[j]), "blocks": int(blocks[j])} for j in np.flatnonzero(line).tolist()] for line in near]
        kind = pa.list_(pa.struct([("base", pa.int32()), ("blocks", pa.int32())]))
        return pa.table([rows.column("label"), rows.column("dim"), rows.column("region"), pa.array(base.astype(np.int32)), rows.column("blocks"), pa.array(met, kind)], names=["label", "dim", "region", "base", "blocks", "met"])

    return run


def _grow_block(key: tuple, rows: pa.Table) -> pa.Table:
    """The block in tree order, with its tree."""
    rows = rows.sort_by("rep")
    order, sizes, radii = grow(unit_vectors(_matrix(rows.column("embedding")))[2])
    rows = rows.take(pa.array(order))
    out = [*(rows.column(c) for c in ("label", "dim", "region", "block", "rep", "copies", "embedding"))]
    out += [pa.array(np.arange(len(order), dtype=np.int32)), pa.array(sizes, pa.list_(pa.int32())), pa.array(radii, pa.list_(pa.float64()))]
    return pa.table(out, names=["label", "dim", "region", "block", "rep", "copies", "embedding", "place", "sizes", "radii"])


def _link_blocks(cosine: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """(rep, links, another vector of its set) of the vectors with links."""
        rows = rows.sort_by([("block", "ascending"), ("place", "ascending")])
        ids, block = rows.column("rep").to_numpy(), rows.column("block").to_numpy()
        parts = [rows.filter(pa.array(block == k)) for k in dict.fromkeys((key[2].as_py(), key[3].as_py()))]
        if not all(len(p) for p in parts):  # a block that got no vector
            return pa.table({"rep": ids[:0], "n": ids[:0], "root": ids[:0]})
        count, parent = _linked(_matrix(rows.column("embedding")), rows.column("copies").to_numpy(), [(p.column("sizes").to_pylist(), p.column("radii").to_pylist()) for p in parts], cosine)
        some = np.flatnonzero(count)
        return pa.table({"rep": ids[some], "n": count[some], "root": ids[parent[some]]})

    return run


def embedding_links(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id) for every row: the other rows it links to, and the smallest id that links reach.

    Two rows link when their labels are equal and not null, their vectors have as many components, and their cosine
    is at least ``cosine``; a cosine at the limit is summed exactly. Vectors that are null, empty or zero or hold a
    null or non-finite component link with nothing, as do rows with a null id; their component is their own id. Equal
    vectors are compared once; repeated rows count as other vectors. An id that names several vectors stands for all
    of them and has all their links. Vectors may be of any length; a task holds two blocks of them. An empty table
    gives no rows. Other columns don't matter, whatever they are called.
    """
    spark = vectors.sparkSession
    prepare(spark)
    good = F.col(vector_col).isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    finite = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    some = F.exists(F.col(vector_col), lambda v: v != 0)
    rows = vectors.where(good).where(finite & some).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    reps = spill(rows.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")), "vectors")
    group = ["label", "dim"]

    def made(*fields: str) -> T.StructType:
        return T.StructType([T.StructField("label", rows.schema["label"].dataType), *T.DataType.fromDDL(", ".join(fields)).fields])

    sizes = reps.groupBy(*group).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64("rep", "embedding"), "rep", "embedding"))
    first = reps.select(*group, F.col("embedding").alias("centre"), rank.alias("rank")).where(f"rank <= {CENTRES}")  # each task keeps so many of a label
    centres = spill(first.join(sizes, group).where(f"rank <= ceil(n / {float(BLOCK)})").select(*group, (F.col("rank") - 1).alias("region"), "centre"), "centres")
    tasks = F.ceil(F.col("n") / F.lit(float(DEALT))).cast("int")
    salted = reps.join(sizes, group).select(*group, F.pmod(F.xxhash64("rep", "embedding"), tasks).cast("int").alias("salt"), "rep", "copies", "embedding")
    each = centres.join(sizes, group).select(*group, F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt"), "region", "centre")
    key = [*group, "salt"]
    dealt = spill(salted.groupBy(*key).cogroup(each.groupBy(*key)).applyInArrow(_deal, made("dim int", "rep long", "copies long", "embedding array<double>", "region int", "away double")), "regions")
    held = dealt.groupBy(*group, "region").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    regions = held.join(centres, [*group, "region"]).groupBy(*group).applyInArrow(_meet(cosine), made("dim int", "region int", "base int", "blocks int", "met array<struct<base:int,blocks:int>>"))
    regions = spill(regions, "region-pairs")
    block = (F.col("base") + F.pmod(F.xxhash64("embedding", "rep"), F.col("blocks"))).cast("int").alias("block")
    blocks = dealt.join(regions, [*group, "region"]).select(*group, "region", block, "rep", "copies", "embedding")
    trees = blocks.groupBy(*group, "block").applyInArrow(
        _grow_block, made("dim int", "region int", "block int", "rep long", "copies long", "embedding array<double>", "place int", "sizes array<int>", "radii array<double>")
    )
    trees = spill(trees, "trees")
    others = F.explode(F.flatten(F.transform("met", lambda r: F.sequence(r["base"], r["base"] + r["blocks"] - 1)))).alias("other")
    met = trees.join(regions.select(*group, "region", "met"), [*group, "region"]).select("*", others).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    met = met.select(*group, "lo", "hi", "block", "rep", "copies", "embedding", "place", "sizes", "radii")
    linked = spill(met.groupBy(*group, "lo", "hi").applyInArrow(_link_blocks(cosine), "rep long, n long, root long"), "links")
    total = linked.groupBy("rep").agg(F.sum("n").alias("n_links"))
    reached = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    own = reps.groupBy("rep").agg(F.sum(F.col("copies") - 1).alias("own"))  # a vector's copies link with it
    of_rep = own.join(total, "rep", "left").join(reached.withColumnRenamed("node", "rep"), "rep", "left").select("rep", (F.col("own") + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    of_row = rows.join(reps.select("label", "embedding", "rep"), ["label", "embedding"]).join(of_rep, "rep").select("id", "n_links", "component_id")
    alone = vectors.where(~F.coalesce(good & finite & some, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    return of_row.unionAll(alone)


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings``."""
    out = embedding_links(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


#: The same links and components from all pairs of a label.
ORACLE_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON r.node = l.x),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON node = vec_id LEFT JOIN n ON x = vec_id"""
