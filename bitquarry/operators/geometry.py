"""Pictures as grids: component planes, coding-tree blocks, quadtrees, tiles and scan orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arith import ceil_div, div, is_power_of_two, pick, power2, shift_right, total
from ..sources.tables import table

# Chroma subsampling by chroma format 0 to 3 (monochrome, 4:2:0, 4:2:2, 4:4:4).
SUB_WIDTH, SUB_HEIGHT = [1, 2, 2, 1], [1, 2, 1, 1]


def subsampling(chroma: Column) -> tuple[Column, Column]:
    return pick(SUB_WIDTH, chroma), pick(SUB_HEIGHT, chroma)


def format_error(width: Column, height: Column, depth_luma: Column, depth_chroma: Column, chroma: Column, separate: Column) -> Column:
    """The first rule that a picture format breaks, null if none."""
    return (
        F.when((width == 0) | (height == 0), "zero dimension")
        .when(~depth_luma.between(8, 16), F.format_string("invalid bit depth %d", depth_luma))
        .when(~depth_chroma.between(8, 16), F.format_string("invalid bit depth %d", depth_chroma))
        .when(separate & (chroma != 3), "separate planes require 4:4:4")
    )


def component_count(chroma: Column) -> Column:
    return F.when(chroma == 0, 1).otherwise(3).cast("long")


def components(pictures: DataFrame) -> DataFrame:
    """One row per colour component of (width, height, chroma, separate), with its plane's size."""
    rows = pictures.withColumn("component", F.explode(F.sequence(F.lit(0).cast("long"), component_count(F.col("chroma")) - 1)))
    whole = (F.col("component") == 0) | F.col("separate")
    sub_w, sub_h = subsampling(F.col("chroma"))
    return rows.withColumn("plane_width", F.when(whole, F.col("width")).otherwise(ceil_div("width", sub_w))).withColumn(
        "plane_height", F.when(whole, F.col("height")).otherwise(ceil_div("height", sub_h))
    )


def block_counts(chroma: Column, separate: Column) -> tuple[Column, Column, Column]:
    """Prediction, transform and coding blocks of a coding unit."""
    one = (chroma == 0) | separate
    prediction = F.when((chroma == 2) & ~separate, 5).when(one, 1).otherwise(3).cast("long")
    return prediction, prediction, F.when(one, 1).otherwise(3).cast("long")


def part_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pictures, with sizes, depths, block sizes, tiles and slices made from their keys."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    return p.select(
        k.alias("pic_id"),
        (s * 8 + k % 7 + 1).alias("width"),
        (s * 4 + k % 5 + 1).alias("height"),
        (k % 4).alias("chroma"),
        (k % 11 == 0).alias("separate"),
        (7 + k % 11).alias("depth_luma"),
        (8 + k % 3).alias("depth_chroma"),
        power2(4 + k % 3).alias("ctb"),
        power2(2 + k % 2).alias("min_tb"),
        (1 + k % 4).alias("want_cols"),
        (1 + k % 3).alias("want_rows"),
        (2 + k % 5).alias("slice_len"),
    )


PICTURES_SQL = """pictures AS (SELECT p_partkey AS pic_id, p_size * 8 + p_partkey % 7 + 1 AS width, p_size * 4 + p_partkey % 5 + 1 AS height,
  p_partkey % 4 AS chroma, p_partkey % 11 = 0 AS separate, 7 + p_partkey % 11 AS depth_luma, 8 + p_partkey % 3 AS depth_chroma,
  CAST(16 * (CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END) AS BIGINT) AS ctb, 4 * (1 + p_partkey % 2) AS min_tb,
  1 + p_partkey % 4 AS want_cols, 1 + p_partkey % 3 AS want_rows, 2 + p_partkey % 5 AS slice_len FROM part),
grid AS (SELECT *, (width + ctb - 1) // ctb AS ctb_w, (height + ctb - 1) // ctb AS ctb_h FROM pictures),
tiled AS (SELECT *, least(want_cols, ctb_w) AS cols, least(want_rows, ctb_h) AS rows FROM grid)"""


def with_grid(pictures: DataFrame) -> DataFrame:
    """Adds the picture's size in coding-tree blocks."""
    return pictures.withColumn("ctb_w", ceil_div("width", "ctb")).withColumn("ctb_h", ceil_div("height", "ctb"))


def with_tiles(grid: DataFrame) -> DataFrame:
    """Adds the numbers of tile columns and rows that the picture has room for."""
    return grid.withColumn("cols", F.least("want_cols", "ctb_w")).withColumn("rows", F.least("want_rows", "ctb_h"))


def ctb_blocks(grid: DataFrame) -> DataFrame:
    """One row per coding-tree block: raster address, block coordinates and clipped bounds."""
    rows = grid.withColumn("addr_rs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ctb_w") * F.col("ctb_h") - 1)))
    rows = rows.withColumn("ctb_x", F.col("addr_rs") % F.col("ctb_w")).withColumn("ctb_y", div("addr_rs", "ctb_w"))
    x, y = F.col("ctb_x") * F.col("ctb"), F.col("ctb_y") * F.col("ctb")
    return rows.select("*", x.alias("x"), y.alias("y"), F.least(F.col("width") - x, F.col("ctb")).alias("w"), F.least(F.col("height") - y, F.col("ctb")).alias("h"))


def uniform_bound(index: Column, length: Column, parts: Column) -> Column:
    return div(index * length, parts)


def uniform_sizes(length: Column, parts: Column) -> Column:
    """Sizes of ``parts`` nearly equal parts of ``length``."""
    return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda i: uniform_bound(i + 1, length, parts) - uniform_bound(i, length, parts))


def part_of(position: Column, length: Column, parts: Column) -> Column:
    """The uniform part that a position lies in: the last one whose bound is not beyond it, -1 before the first."""
    return F.when(position < 0, -1).otherwise(F.least(div((position + 1) * parts - 1, length), parts - 1)).cast("long")


def explicit_part_of(position: Column, sizes: Column) -> Column:
    """The part of a list of sizes that a position lies in, null behind the last."""
    ends = F.transform(sizes, lambda s, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    before = F.size(F.filter(ends, lambda e: e <= position)).cast("long")
    return F.when(before < F.size(sizes), before)


def tile_scan(blocks: DataFrame) -> DataFrame:
    """Adds tile ids and tile-scan addresses: tiles in raster order, blocks in raster order within a tile."""
    tile = part_of(F.col("ctb_y"), F.col("ctb_h"), F.col("rows")) * F.col("cols") + part_of(F.col("ctb_x"), F.col("ctb_w"), F.col("cols"))
    order = Window.partitionBy("pic_id").orderBy("tile_id", "addr_rs")
    return blocks.withColumn("tile_id", tile).withColumn("addr_ts", (F.row_number().over(order) - 1).cast("long"))


def z_rank(x: Column, y: Column, bits: int = 6) -> Column:
    """Interleaves the bits of x and y, x lowest."""
    parts = [((shift_right(v, b)) % 2) * (1 << (2 * b + odd)) for b in range(bits) for odd, v in enumerate((x, y))]
    return total(parts)


def min_tb_address(x: Column, y: Column, ctb: Column, min_tb: Column, ctb_w: Column) -> Column:
    per = div(ctb, min_tb)
    addr = div(y, ctb) * ctb_w + div(x, ctb)
    return addr * per * per + z_rank(div(x % ctb, min_tb), div(y % ctb, min_tb))


SCANS = {"diagonal": "x + y, x", "horizontal": "y, x", "vertical": "x, y", "traverse": "y, CASE WHEN y % 2 = 0 THEN x ELSE -x END", "z": "z"}


def scan_table(spark: SparkSession, largest: int = 5) -> DataFrame:
    """All scans of square blocks of 1 to 2**largest: (kind, size, rank, x, y)."""
    sizes = spark.range(largest + 1).select(power2(F.col("id")).alias("size"))
    axis = F.sequence(F.lit(0).cast("long"), F.col("size") - 1)
    cells = sizes.select("size", F.explode(axis).alias("x")).select("size", "x", F.explode(axis).alias("y")).withColumn("z", z_rank(F.col("x"), F.col("y")))
    out = None
    for kind, order in SCANS.items():
        rank = F.expr(f"row_number() over (partition by size order by {order})") - 1
        part = cells.select(F.lit(kind).alias("kind"), "size", rank.cast("long").alias("rank"), "x", "y")
        out = part if out is None else out.unionAll(part)
    return out


def quadtree_leaves(blocks: DataFrame, smallest: int) -> DataFrame:
    """Splits the square blocks (id, x, y, size) that can be until they are of the smallest size; ``leaf`` is in z order.

    A block splits while its size is even and above the smallest. The depth is at most the binary logarithm of the
    size, so the levels are unrolled as expressions of one pass over the rows.
    """
    halvings = F.expr(f"aggregate(sequence(1, 16), named_struct('s', size, 'd', 0L), (a, i) -> if(a.s > {smallest} and a.s % 2 = 0, named_struct('s', a.s div 2, 'd', a.d + 1L), a))")
    tree = blocks.withColumn("h", halvings)
    n = power2(F.col("h.d"))
    rows = tree.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), n * n - 1)))
    bits = range(8)
    cx = total([(shift_right(F.col("cell"), 2 * b) % 2) * (1 << b) for b in bits])
    cy = total([(shift_right(F.col("cell"), 2 * b + 1) % 2) * (1 << b) for b in bits])
    return rows.select("id", F.col("cell").alias("leaf"), (F.col("x") + cx * F.col("h.s")).alias("x"), (F.col("y") + cy * F.col("h.s")).alias("y"), F.col("h.s").alias("size"))


def z_scan_available(cur_addr: Column, nb_addr: Column, same_slice: Column, same_tile: Column, inside: Column) -> Column:
    return F.coalesce(inside & (nb_addr <= cur_addr) & same_slice & same_tile, F.lit(False))


def in_block(x: Column, y: Column, bx: Column, by: Column, w: Column, h: Column) -> Column:
    return (x >= bx) & (y >= by) & (x < bx + w) & (y < by + h)


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of positions in part pictures: line items give the current one and an offset to the neighbour."""
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pics = with_tiles(with_grid(part_pictures(spark, sf_dir))).withColumnRenamed("pic_id", "l_partkey")
    j = line.join(pics, "l_partkey")
    q = F.col("l_quantity").cast("long")
    j = j.withColumn("x", (F.col("l_orderkey") * 7 + q) % F.col("width")).withColumn("y", (F.col("l_suppkey") * 5 + F.col("l_linenumber")) % F.col("height"))
    j = j.withColumn("nx", F.col("x") + q % 41 - 20).withColumn("ny", F.col("y") + F.col("l_orderkey") % 33 - 24)
    j = j.withColumn("inside", (F.col("nx") >= 0) & (F.col("ny") >= 0) & (F.col("nx") < F.col("width")) & (F.col("ny") < F.col("height")))
    for p, x, y in (("cur", "x", "y"), ("nb", "nx", "ny")):
        cx, cy = div(x, "ctb"), div(y, "ctb")
        j = j.withColumn(f"{p}_addr", min_tb_address(F.col(x), F.col(y), F.col("ctb"), F.col("min_tb"), F.col("ctb_w")))
        j = j.withColumn(f"{p}_slice", div(cy * F.col("ctb_w") + cx, "slice_len"))
        j = j.withColumn(f"{p}_tile", part_of(cy, F.col("ctb_h"), F.col("rows")) * F.col("cols") + part_of(cx, F.col("ctb_w"), F.col("cols")))
    return j


def _place_sql(x: str, y: str) -> dict[str, str]:
    """DuckDB expressions of the address, tile and slice at a position, from the columns of its own row."""
    bits = [f"((({v} % ctb // min_tb) >> {b}) % 2) * {1 << (2 * b + odd)}" for b in range(6) for odd, v in enumerate((x, y))]
    ctu = f"(({y} // ctb) * ctb_w + {x} // ctb)"
    tile = f"((({y} // ctb + 1) * rows - 1) // ctb_h * cols + (({x} // ctb + 1) * cols - 1) // ctb_w)"
    return {"a": f"{ctu} * (ctb // min_tb) * (ctb // min_tb) + {' + '.join(bits)}", "tile": tile, "slice": f"{ctu} // slice_len"}


_CUR, _NB = _place_sql("x", "y"), _place_sql("greatest(nx, 0)", "greatest(ny, 0)")
NEIGHBOURS_SQL = f"""{PICTURES_SQL},
placed AS (SELECT l_orderkey, l_linenumber, t.*, (l_orderkey * 7 + CAST(l_quantity AS BIGINT)) % width AS x, (l_suppkey * 5 + l_linenumber) % height AS y, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem JOIN tiled t ON pic_id = l_partkey),
pairs AS (SELECT *, x + q % 41 - 20 AS nx, y + l_orderkey % 33 - 24 AS ny FROM placed),
both_ AS (SELECT *, {_CUR["a"]} AS cur_a, nx >= 0 AND ny >= 0 AND nx < width AND ny < height
  AND {_NB["a"]} <= {_CUR["a"]} AND {_NB["slice"]} = {_CUR["slice"]} AND {_NB["tile"]} = {_CUR["tile"]} AS available FROM pairs)"""


def g1_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component sizes, block counts and the broken rule of each picture format."""
    p = components(part_pictures(spark, sf_dir))
    pb, tb, cb = block_counts(F.col("chroma"), F.col("separate"))
    error = format_error(*(F.col(c) for c in ("width", "height", "depth_luma", "depth_chroma", "chroma", "separate")))
    return p.select("pic_id", "component", "plane_width", "plane_height", pb.alias("n_pb"), tb.alias("n_tb"), cb.alias("n_cb"), error.alias("error"))


def g4_ctb_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctb_blocks(with_grid(part_pictures(spark, sf_dir))).select("pic_id", "addr_rs", "ctb_x", "ctb_y", "x", "y", "w", "h")


def g4_geometry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block sizes made invalid for some pictures, and whether the geometry accepts them."""
    p = part_pictures(spark, sf_dir).withColumn("ctb", F.col("ctb") + F.when(F.col("pic_id") % 5 == 0, 8).otherwise(0)).withColumn("min_tb", F.col("min_tb") * F.when(F.col("pic_id") % 6 == 0, 16).otherwise(1))
    good = is_power_of_two(F.col("ctb")) & is_power_of_two(F.col("min_tb")) & (F.col("min_tb") <= F.col("ctb"))
    return p.select("pic_id", "ctb", "min_tb", good.alias("valid"))


def g6_quadtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = with_grid(part_pictures(spark, sf_dir)).select(F.col("pic_id").alias("id"), F.col("width").alias("x"), F.col("height").alias("y"), F.col("ctb").alias("size"))
    return quadtree_leaves(blocks, 8)


def t1_uniform_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_tiles(with_grid(part_pictures(spark, sf_dir)))
    sizes = p.select("pic_id", F.posexplode(F.array(uniform_sizes(F.col("ctb_w"), F.col("cols")), uniform_sizes(F.col("ctb_h"), F.col("rows")))).alias("axis", "sizes"))
    return sizes.select("pic_id", F.col("axis").cast("long").alias("axis"), F.posexplode("sizes").alias("i", "n")).select("pic_id", "axis", F.col("i").cast("long").alias("i"), "n")


def t2_tile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_scan(ctb_blocks(with_tiles(with_grid(part_pictures(spark, sf_dir))))).select("pic_id", "addr_rs", "addr_ts", "tile_id")


def t2_explicit_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile columns of given widths, the last one taking what is left."""
    p = with_grid(part_pictures(spark, sf_dir)).where("ctb_w >= 4")
    sizes = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.col("ctb_w") - 3)
    rows = p.select("pic_id", sizes.alias("sizes"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ctb_w"))).alias("ctb_x"))
    return rows.select("pic_id", "ctb_x", explicit_part_of(F.col("ctb_x"), F.col("sizes")).alias("tile_col"))


def c1_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(spark)


def c2_min_tb_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "x", "y", F.col("cur_addr").alias("addr"))


def n2_z_scan_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = neighbours(spark, sf_dir)
    ok = z_scan_available(F.col("cur_addr"), F.col("nb_addr"), F.col("cur_slice") == F.col("nb_slice"), F.col("cur_tile") == F.col("nb_tile"), F.col("inside"))
    return n.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "nx", "ny", ok.alias("available"))


def n3_prediction_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16x16 coding block at the current position with 8x8 prediction blocks, partition and mode from the line item."""
    n = neighbours(spark, sf_dir)
    part = F.col("l_linenumber") % 4
    bx, by = F.col("x"), F.col("y")
    same = in_block(F.col("nx"), F.col("ny"), bx, by, F.lit(16), F.lit(16))
    z = z_scan_available(F.col("cur_addr"), F.col("nb_addr"), F.col("cur_slice") == F.col("nb_slice"), F.col("cur_tile") == F.col("nb_tile"), F.col("inside"))
    later = (part == 1) & (by + 8 <= F.col("ny")) & (bx + 8 > F.col("nx"))
    intra = F.col("l_orderkey") % 3 == 0
    return n.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.when(same, ~later).otherwise(z) & ~intra).alias("available"))


def n4_ctu_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left and upper availability of coding-tree units in a slice that starts at a tenth of the picture."""
    t = tile_scan(ctb_blocks(with_tiles(with_grid(part_pictures(spark, sf_dir)))))
    t = t.withColumn("slice_addr", div(F.col("ctb_w") * F.col("ctb_h"), 10))
    tile = lambda x, y: part_of(y, F.col("ctb_h"), F.col("rows")) * F.col("cols") + part_of(x, F.col("ctb_w"), F.col("cols"))
    left = (F.col("ctb_x") > 0) & (F.col("addr_rs") > F.col("slice_addr")) & (tile(F.col("ctb_x") - 1, F.col("ctb_y")) == F.col("tile_id"))
    up_rs = F.col("addr_rs") - F.col("ctb_w")
    up = (F.col("ctb_y") > 0) & (up_rs >= F.col("slice_addr")) & (tile(F.col("ctb_x"), F.col("ctb_y") - 1) == F.col("tile_id"))
    return t.select("pic_id", "addr_rs", left.alias("left_available"), up.alias("up_available"))


QUERIES = {
    "g1_formats": g1_formats, "g4_ctb_grid": g4_ctb_grid, "g4_geometry_check": g4_geometry_check, "g6_quadtree": g6_quadtree, "t1_uniform_tiles": t1_uniform_tiles,
    "t2_tile_scan": t2_tile_scan, "t2_explicit_tiles": t2_explicit_tiles, "c1_scans": c1_scans, "c2_min_tb_address": c2_min_tb_address, "n2_z_scan_available": n2_z_scan_available,
    "n3_prediction_available": n3_prediction_available, "n4_ctu_available": n4_ctu_available,
}

_TILE_SQL = "(len(list_filter(range(rows), lambda i: i * ctb_h // rows <= {y})) - 1) * cols + len(list_filter(range(cols), lambda i: i * ctb_w // cols <= {x})) - 1"
_BLOCKS_SQL = f"""{PICTURES_SQL},
blocks AS (SELECT *, addr_rs % ctb_w AS ctb_x, addr_rs // ctb_w AS ctb_y FROM (SELECT *, unnest(range(ctb_w * ctb_h)) AS addr_rs FROM tiled)),
tiles AS (SELECT *, {_TILE_SQL.format(x="ctb_x", y="ctb_y")} AS tile_id FROM blocks)"""
_SCAN_SQL = " UNION ALL ".join(f"SELECT '{kind}' AS kind, size, row_number() OVER (PARTITION BY size ORDER BY {order}) - 1 AS rank, x, y FROM cells" for kind, order in SCANS.items())

ORACLE = {
    "g1_formats": f"""WITH {PICTURES_SQL},
c AS (SELECT *, unnest(range(CASE WHEN chroma = 0 THEN 1 ELSE 3 END)) AS component FROM pictures)
SELECT pic_id, component,
  CASE WHEN component = 0 OR separate OR chroma IN (0, 3) THEN width ELSE (width + 1) // 2 END AS plane_width,
  CASE WHEN component = 0 OR separate OR chroma <> 1 THEN height ELSE (height + 1) // 2 END AS plane_height,
  CASE WHEN chroma = 2 AND NOT separate THEN 5 WHEN chroma = 0 OR separate THEN 1 ELSE 3 END::BIGINT AS n_pb,
  CASE WHEN chroma = 2 AND NOT separate THEN 5 WHEN chroma = 0 OR separate THEN 1 ELSE 3 END::BIGINT AS n_tb,
  CASE WHEN chroma = 0 OR separate THEN 1 ELSE 3 END::BIGINT AS n_cb,
  CASE WHEN width = 0 OR height = 0 THEN 'zero dimension' WHEN depth_luma < 8 OR depth_luma > 16 THEN 'invalid bit depth ' || depth_luma
    WHEN depth_chroma < 8 OR depth_chroma > 16 THEN 'invalid bit depth ' || depth_chroma WHEN separate AND chroma <> 3 THEN 'separate planes require 4:4:4' END AS error FROM c""",
    "g4_ctb_grid": f"""WITH {_BLOCKS_SQL} SELECT pic_id, addr_rs, ctb_x, ctb_y, ctb_x * ctb AS x, ctb_y * ctb AS y, least(width - ctb_x * ctb, ctb) AS w, least(height - ctb_y * ctb, ctb) AS h FROM blocks""",
    "g4_geometry_check": f"""WITH {PICTURES_SQL}, odd AS (SELECT pic_id, ctb + CASE WHEN pic_id % 5 = 0 THEN 8 ELSE 0 END AS ctb, min_tb * CASE WHEN pic_id % 6 = 0 THEN 16 ELSE 1 END AS min_tb FROM pictures)
SELECT pic_id, ctb, min_tb, bit_count(ctb) = 1 AND bit_count(min_tb) = 1 AND min_tb <= ctb AS valid FROM odd""",
    "g6_quadtree": f"""WITH RECURSIVE {PICTURES_SQL},
tree AS (SELECT pic_id AS id, width AS x, height AS y, ctb AS size, 0::BIGINT AS leaf FROM pictures
  UNION ALL SELECT id, x + (q % 2) * (size // 2), y + (q // 2) * (size // 2), size // 2, leaf * 4 + q FROM tree, (SELECT unnest(range(4)) AS q) WHERE size > 8 AND size % 2 = 0)
SELECT id, leaf, x, y, size FROM tree WHERE NOT (size > 8 AND size % 2 = 0)""",
    "t1_uniform_tiles": f"""WITH {PICTURES_SQL}
SELECT pic_id, 0::BIGINT AS axis, i, (i + 1) * ctb_w // cols - i * ctb_w // cols AS n FROM (SELECT *, unnest(range(cols)) AS i FROM tiled)
UNION ALL SELECT pic_id, 1::BIGINT AS axis, i, (i + 1) * ctb_h // rows - i * ctb_h // rows AS n FROM (SELECT *, unnest(range(rows)) AS i FROM tiled)""",
    "t2_tile_scan": f"WITH {_BLOCKS_SQL} SELECT pic_id, addr_rs, row_number() OVER (PARTITION BY pic_id ORDER BY tile_id, addr_rs) - 1 AS addr_ts, tile_id FROM tiles",
    "t2_explicit_tiles": f"""WITH {PICTURES_SQL} SELECT pic_id, ctb_x, CASE WHEN ctb_x < 1 THEN 0 WHEN ctb_x < 3 THEN 1 WHEN ctb_x < ctb_w THEN 2 END::BIGINT AS tile_col
FROM (SELECT pic_id, ctb_w, unnest(range(ctb_w + 1)) AS ctb_x FROM grid WHERE ctb_w >= 4)""",
    "c1_scans": f"""WITH sizes AS (SELECT 1 << range AS size FROM range(6)), xs AS (SELECT size, unnest(range(size)) AS x FROM sizes), xy AS (SELECT size, x, unnest(range(size)) AS y FROM xs),
cells AS (SELECT *, list_sum(list_transform(range(6), lambda b: ((x >> b) % 2) * (1 << (2 * b)) + ((y >> b) % 2) * (2 << (2 * b)))) AS z FROM xy) {_SCAN_SQL}""",
    "c2_min_tb_address": f"WITH {NEIGHBOURS_SQL} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, x, y, CAST(cur_a AS BIGINT) AS addr FROM both_",
    "n2_z_scan_available": f"WITH {NEIGHBOURS_SQL} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, nx, ny, available FROM both_",
    "n3_prediction_available": f"""WITH {NEIGHBOURS_SQL} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
CASE WHEN nx >= x AND ny >= y AND nx < x + 16 AND ny < y + 16 THEN NOT (l_linenumber % 4 = 1 AND y + 8 <= ny AND x + 8 > nx) ELSE available END AND l_orderkey % 3 <> 0 AS available FROM both_""",
    "n4_ctu_available": f"""WITH {_BLOCKS_SQL}, s AS (SELECT *, ctb_w * ctb_h // 10 AS slice_addr FROM tiles)
SELECT c.pic_id, c.addr_rs, c.ctb_x > 0 AND c.addr_rs > c.slice_addr AND coalesce(l.tile_id = c.tile_id, FALSE) AS left_available,
  c.ctb_y > 0 AND c.addr_rs - c.ctb_w >= c.slice_addr AND coalesce(u.tile_id = c.tile_id, FALSE) AS up_available
FROM s c LEFT JOIN s l ON l.pic_id = c.pic_id AND l.addr_rs = c.addr_rs - 1 LEFT JOIN s u ON u.pic_id = c.pic_id AND u.addr_rs = c.addr_rs - c.ctb_w""",
}
