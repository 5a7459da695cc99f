"""From the bytes of slices to slice data, pictures and the buffer; tile maps, contexts and arithmetic decoding as rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import dealt, pieces, ship
from ..sources.bits import BitReader, BitstreamError, BitWriter, escape
from ..sources.bitstream import active_sets, nal_units, parse_units, sample_units, split_stream
from ..sources.encoder import Recorder
from ..sources.model import AFTER_LPS, LPS_RANGES, Standard, context_count, context_place, context_values
from ..sources.mp4 import Mp4Source
from ..sources.slicedata import Picture, slice_data
from ..sources.synthetic import _profile
from ..sources.tables import table
from ..sources.vcl import read_slice, slice_qp, tile_maps
from .entropy import initial_state
from .geometry import PICTURES_SQL as PARTS_SQL
from .geometry import part_pictures, with_grid, with_tiles
from .order import order_counts
from .readers import movie_key, movie_of, write_movies
from .references import decoded_picture_buffer
from .reconstruct import reconstruct


def _rows_in(run_row: Callable[[tuple], Iterator[tuple]], columns: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function from a function that turns a row into rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = [made for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True) for made in run_row(row)]
            cols = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


@lru_cache(maxsize=64)
def _loaded(text: str) -> dict:
    return json.loads(text)


_KEY = [("stream_id", pa.int64()), ("nal_idx", pa.int64())]
_PLANES = pa.list_(pa.struct([("component", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.list_(pa.int32()))]))
_SLICES = pa.schema([*_KEY, ("slice_type", pa.int64()), ("lsb", pa.int64()), ("period", pa.int64()), ("irap", pa.bool_()), ("output", pa.bool_()), ("qp", pa.int64()),
                     ("zero_words", pa.int64()), ("trees", pa.string()), ("planes", _PLANES), ("error", pa.string())])
SLICES = "stream_id long, nal_idx long, slice_type long, lsb long, period long, irap boolean, output boolean, qp long, zero_words long, trees string, planes array<struct<component:int,width:int,height:int,samples:array<int>>>, error string"


def _leaves(node: dict) -> Iterator[dict]:
    if "children" not in node:
        yield node
    for child in node.get("children", ()):
        yield from _leaves(child)


def decoded_slices(parsed: DataFrame, pictures: bool = True) -> DataFrame:
    """Every slice of parsed units with what its bytes say, read with the sets that are active at it.

    ``trees`` is the JSON of the coding trees' leaves by unit, ``planes`` the picture of an intra slice (null unless
    ``pictures``). Slices that can't be read, and slices of other types where a picture is wanted, are rows with an error.
    """
    ship(parsed.sparkSession)

    def one(row: tuple) -> Iterator[tuple]:
        stream, idx, kind, rbsp, sps, pps = row
        nothing = [None] * 9
        if sps is None or pps is None:
            yield stream, idx, *nothing, "missing picture parameter set" if pps is None else "missing sequence parameter set"
            return
        try:
            sequence, picture = _loaded(sps), _loaded(pps)
            got = read_slice(kind, escape(rbsp), sequence, picture)
            body = got["header"].get("independent", {"slice_type": 2})
            trees = [list(_leaves(u["tree"])) for u in got["data"]["units"]] if got["data"] else []
            planes = None
            if pictures:
                if body["slice_type"] != 2:
                    raise BitstreamError("unsupported slice type", str(body["slice_type"]))
                made = reconstruct(got["picture"], got["data"], slice_qp(got["header"], picture)) if got["data"] else []
                planes = [{"component": c, "width": p.shape[1], "height": p.shape[0], "samples": p.reshape(-1).tolist()} for c, p in enumerate(made)]
            period = 1 << sequence["log2_max_pic_order_cnt_lsb_minus4"] + 4
            yield (stream, idx, body["slice_type"], body.get("slice_pic_order_cnt_lsb", 0), period, 16 <= kind <= 23, body.get("pic_output_flag", True),
                   slice_qp(got["header"], picture) if got["data"] else None, got["zero_words"], json.dumps(trees), planes, None)
        except BitstreamError as e:
            yield stream, idx, *nothing, str(e)

    columns = ["stream_id", "nal_idx", "nal_type", "rbsp", "sps", "pps"]
    return active_sets(parsed).select(*columns).mapInArrow(_rows_in(one, columns, _SLICES), SLICES)


def decoded_pictures(parsed: DataFrame) -> DataFrame:
    """The slices that are pictures with their order counts: (..., pic_id, poc). Slices with an error have no count."""
    slices = decoded_slices(parsed).withColumn("pic_id", F.col("nal_idx"))
    return order_counts(slices, F.col("period"))  # slices with an error have no low bits and stand in a window of their own


def tile_map_rows(pictures: DataFrame) -> DataFrame:
    """(pic_id, addr_rs, addr_ts, tile_id, error) of pictures (pic_id, across, down, pps), ``pps`` the JSON of a set."""
    ship(pictures.sparkSession)
    schema = pa.schema([("pic_id", pa.int64()), ("addr_rs", pa.int64()), ("addr_ts", pa.int64()), ("tile_id", pa.int64()), ("error", pa.string())])

    def one(row: tuple) -> Iterator[tuple]:
        pic, across, down, pps = row
        try:
            tiles, to_raster, _ = tile_maps(json.loads(pps), across, down)
            yield from ((pic, rs, ts, tile, None) for ts, (rs, tile) in enumerate(zip(to_raster, tiles, strict=True)))
        except BitstreamError as e:
            yield pic, None, None, None, str(e)

    return pictures.mapInArrow(_rows_in(one, ["pic_id", "across", "down", "pps"], schema), "pic_id long, addr_rs long, addr_ts long, tile_id long, error string")


@lru_cache(maxsize=256)
def _asked(ask: str) -> tuple[str, int | None]:
    name, _, inc = ask.partition(":")
    return name, int(inc) if inc else None


def arithmetic_bins(payloads: DataFrame) -> DataFrame:
    """(id, i, bin, error) of rows (id, payload, init_type, qp, script): the bins that a script asks for.

    A script is an array of ``name:increment``, ``bypass`` and ``terminate``. The first error ends a row's bins.
    """
    ship(payloads.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("i", pa.int64()), ("bin", pa.int64()), ("error", pa.string())])

    def one(row: tuple) -> Iterator[tuple]:
        key, payload, kind, qp, script = row
        done = 0
        try:
            entropy = Standard(BitReader(payload), kind, qp)
            for done, ask in enumerate(script):
                name, inc = _asked(ask)
                yield key, done, getattr(entropy, name)() if inc is None else entropy.bin(name, inc), None
        except BitstreamError as e:
            yield key, done, None, str(e)

    return payloads.mapInArrow(_rows_in(one, ["id", "payload", "init_type", "qp", "script"], schema), "id long, i long, bin long, error string")


def movie_pictures(spark: SparkSession, path: str, every: int = 1) -> DataFrame:
    """(path, frame, poc, planes, error) of every ``every``-th picture of the movies below a path, from their bytes.

    The job from files to frames: samples by the data source, units by their lengths, sets of the configuration first.
    """
    ship(spark)
    spark.dataSource.register(Mp4Source)
    rows = spark.read.format("mp4").load(path)
    # a sample is a row of its own: the file's number and the sample's in one, and apart again behind the split
    number = F.pmod(F.xxhash64("path"), F.lit(1 << 31)) * (1 << 32) + F.col("sample") + 1
    samples = rows.select("path", number.alias("stream_id"), "length_size", "payload")
    units = sample_units(samples, "length_size")
    place = (F.col("stream_id") % (1 << 32)) * (1 << 16) + F.col("nal_idx")
    units = units.select(F.shiftright("stream_id", 32).alias("stream_id"), place.alias("nal_idx"), "unit", "error")
    pictures = decoded_pictures(parse_units(units))
    frame = F.row_number().over(Window.partitionBy("stream_id").orderBy("nal_idx")) - 1
    names = rows.where("sample = -1").select("path", F.pmod(F.xxhash64("path"), F.lit(1 << 31)).alias("stream_id"))
    chosen = pictures.withColumn("frame", frame.cast("long")).where(F.col("frame") % every == 0)
    return chosen.join(names, "stream_id").select("path", "frame", "poc", "planes", "error")


# --- streams of intra pictures -------------------------------------------------------------------------------


def _unit(kind: int, payload: bytes) -> bytes:
    return b"\0\0\1" + (kind << 9 | 1).to_bytes(2, "big") + escape(payload)


def intra_slice(key: int, number: int) -> bytes:
    """Header and data of a picture of one unit of 8x8 samples, coded with a mode, a level and its sign from key and number."""
    w = BitWriter().u(1, 1)
    if number == 0:
        w.u(1, 0)
    w.ue(0).ue(2)
    if number:
        w.u(4, 3 * number % 16).ue(0).ue(0)
    w.se(key % 9 - 4)
    if w.n % 8:  # nothing closes a header that ends with a byte
        w.trailing()
    head = w.bytes()
    # the mode that remains, then the sign of the level
    bits = [int(b) for b in f"{(key + number) % 32:05b}"] + [(key + number) % 2]
    ones = {"part_mode", "cbf_luma"} if (key + number) % 3 else {"part_mode"}
    recorder = Recorder(lambda name, inc: bits.pop(0) if name == "bypass" and bits else int(name in ones), 0, max(0, min(51, 26 + key % 9 - 4)))
    slice_data(recorder, Picture(chroma=0, max_tb_log2=3, max_depth=0))
    return head + recorder.bytes()


def intra_stream(key: int) -> bytes:
    """Sets and intra pictures of 8x8 luma samples, as many as the key says; the first is a random-access point."""
    sps = _profile(BitWriter().u(4, 0).u(3, 0).u(1, 1), 1, 30).ue(0).ue(0).ue(8).ue(8).u(1, 0).ue(0).ue(0).ue(0).u(1, 1).ue(1).ue(0).ue(0).ue(0).ue(0).ue(0).ue(1).ue(0).ue(0)
    sps.u(1, 0).u(1, 0).u(1, 0).u(1, 0).ue(0).u(1, 0).u(1, 0).u(1, 0).u(1, 0).u(1, 0).trailing()
    pps = BitWriter().ue(0).ue(0).u(2, 0).u(3, 0).u(2, 0).ue(0).ue(0).se(0).u(2, 0).u(1, 0).se(0).se(0).u(4, 0).u(2, 0).u(1, 0).u(1, 0).u(1, 0).u(1, 0).ue(0).u(1, 0).u(1, 0).trailing()
    slices = [_unit(19 if k == 0 else 1, intra_slice(key, k)) for k in range(1 + key % 8)]
    return b"".join([_unit(33, sps.bytes()), _unit(34, pps.bytes()), *slices])


def intra_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of intra pictures for every part: (stream_id, payload)."""
    ship(spark)
    schema = pa.schema([("stream_id", pa.int64()), ("payload", pa.binary())])
    keys = dealt(table(spark, sf_dir, "part", "p_partkey"), "p_partkey")
    return keys.mapInArrow(_rows_in(lambda row: iter([(row[0], intra_stream(row[0]))]), ["p_partkey"], schema), "stream_id long, payload binary")


def _intra_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_units(nal_units(intra_streams(spark, sf_dir)))


def x11_slice_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bytes of intra slices say: quantiser, the mode that remains, whether a residual is coded, its sign."""
    s = decoded_slices(_intra_units(spark, sf_dir), pictures=False)
    at = lambda path: F.get_json_object("trees", f"$[0][0].{path}")
    return s.select("stream_id", "nal_idx", "qp", at("unit.luma_modes[0].rem").cast("long").alias("rem"), at("transform.unit.luma.levels[0]").cast("long").alias("level"), "zero_words", "error")


def r13_decoded_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intra pictures from bytes, with their order counts."""
    p = decoded_pictures(_intra_units(spark, sf_dir)).select("stream_id", "nal_idx", "poc", F.explode("planes").alias("p"), "error")
    return p.select("stream_id", "nal_idx", "poc", F.col("p.component").cast("long").alias("component"), F.array_join("p.samples", ",").alias("samples"), "error")


def r13_picture_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the buffers of four pictures hold when streams are decoded to their ends: all wait for output, so the oldest go."""
    p = decoded_pictures(_intra_units(spark, sf_dir)).where("error is null")
    rows = p.select("stream_id", "pic_id", "poc", F.lit(False).alias("used"), F.col("output").alias("waiting"), F.lit(4).cast("long").alias("capacity"))
    return decoded_picture_buffer(rows).withColumn("evicted", F.col("evicted").cast("long"))


def intra_movie(key: int) -> bytes:
    """The stream of a key as a movie: the sets in its configuration, a picture a sample."""
    units = split_stream(intra_stream(key))
    return movie_of([len(u).to_bytes(1 + key % 4, "big") + u for u in units[2:]], units[:2], key % 4, key % 2 == 1)


def h13_movie_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second frame of the movies of nations, from files to samples."""
    folder = write_movies(spark, sf_dir, lambda key: intra_movie(key + 1))
    frames = movie_pictures(spark, folder, 2).select(movie_key().alias("id"), "frame", "poc", F.explode("planes").alias("p"), "error")
    return frames.select("id", "frame", "poc", F.array_join("p.samples", ",").alias("samples"), "error")


def t4_tile_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part pictures with uniform tiles, explicit ones where the picture is wide enough, or one tile, from picture sets."""
    p = with_tiles(with_grid(part_pictures(spark, sf_dir)))
    wide = (F.col("pic_id") % 2 == 0) & (F.col("ctb_w") >= 4)
    explicit = F.format_string('"uniform_spacing_flag": false, "num_tile_columns_minus1": 2, "num_tile_rows_minus1": 0, "column_width_minus1": [0, 1], "row_height_minus1": []')
    uniform = F.format_string('"uniform_spacing_flag": true, "num_tile_columns_minus1": %d, "num_tile_rows_minus1": %d', F.col("cols") - 1, F.col("rows") - 1)
    pps = F.when(F.col("pic_id") % 7 == 0, F.lit('{"tiles_enabled_flag": false}')).otherwise(F.format_string('{"tiles_enabled_flag": true, "tiles": {%s}}', F.when(wide, explicit).otherwise(uniform)))
    return tile_map_rows(p.select("pic_id", F.col("ctb_w").alias("across"), F.col("ctb_h").alias("down"), pps.alias("pps")))


def e2_context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of all contexts by initialization type and quantiser; 0 where the type has no value."""
    rows = [(k, i, v) for k in range(3) for i, v in enumerate(context_values(k))]
    values = spark.createDataFrame(rows, "init_type long, place long, value long")
    state, mps = initial_state(F.col("value"), F.col("qp"))
    every = values.withColumn("qp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(51).cast("long"))))
    return every.select("init_type", "place", "qp", F.coalesce(state, F.lit(0)).alias("state"), F.coalesce(mps, F.lit(0)).alias("mps"))


def _script(n: int) -> list[str]:
    return ["bypass" if i % 4 == 3 else f"cu_qp_delta_abs:{i % 2}" if i % 4 == 2 else f"split_cu_flag:{i % 3}" for i in range(n)]


def e10_arithmetic_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty-eight bins, with contexts and without, from bytes that a digest of the key gives."""
    p = dealt(table(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    payload = F.unhex(F.concat(F.lit("7"), F.sha2(F.col("p_partkey").cast("string").cast("binary"), 256), F.lit("0")))
    script = F.array(*(F.lit(s) for s in _script(48)))
    return arithmetic_bins(p.select(F.col("p_partkey").alias("id"), payload.alias("payload"), (F.col("p_partkey") % 3).alias("init_type"), F.col("p_size").cast("long").alias("qp"), script.alias("script")))


QUERIES = {
    "x11_slice_data": x11_slice_data, "r13_decoded_pictures": r13_decoded_pictures, "r13_picture_buffer": r13_picture_buffer, "t4_tile_maps": t4_tile_maps,
    "h13_movie_frames": h13_movie_frames, "e2_context_vectors": e2_context_vectors, "e10_arithmetic_bins": e10_arithmetic_bins,
}

_SLICES_SQL = "s AS (SELECT p_partkey AS stream_id, 2 + k AS nal_idx, p_partkey AS key, k, (p_partkey + k) % 3 <> 0 AS coded, (p_partkey + k) % 2 AS negative FROM (SELECT p_partkey, unnest(range(1 + p_partkey % 8)) AS k FROM part))"
# low bits 3, 6, 9, ... of 16, which never fall back: the count is 3 times the number, and 0 for the first
_POC = "3 * k"


def _state_sql(value: str, qp: str) -> tuple[str, str]:
    before = f"greatest(1, least(126, ((({value} // 16) * 5 - 45) * greatest(0, least(51, {qp})) >> 4) + ({value} % 16) * 8 - 16))"
    return f"CASE WHEN {before} <= 63 THEN 63 - {before} ELSE {before} - 64 END", f"CASE WHEN {before} <= 63 THEN 0 ELSE 1 END"


def _oracle() -> dict[str, str]:
    tile = "((ctb_y + 1) * rows - 1) // ctb_h * cols + ((ctb_x + 1) * cols - 1) // ctb_w"
    state, mps = _state_sql("value", "qp")
    values = ", ".join(f"[{', '.join('NULL' if v is None else str(v) for v in context_values(k))}]" for k in range(3))
    # the decoder of the bins as steps of a recursion: three contexts of the split flag and two of the quantiser's change
    start = {k: context_values(k) for k in range(3)}
    used = [("split_cu_flag", 0), ("split_cu_flag", 1), ("split_cu_flag", 2), ("cu_qp_delta_abs", 0), ("cu_qp_delta_abs", 1)]
    first = "[" + ", ".join("[" + ", ".join(str(start[k][context_place(n, k, i)]) for n, i in used) + "]" for k in range(3)) + "]"
    init_state, init_mps = _state_sql("v", "qp")
    which = "CASE WHEN i % 4 = 3 THEN 0 WHEN i % 4 = 2 THEN 4 + i % 2 ELSE 1 + i % 3 END"
    ranges, after = f"[{', '.join(str(r) for r in LPS_RANGES)}]", f"{AFTER_LPS}"
    bins = f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey % 3 AS kind, p_size::BIGINT AS qp, '7' || sha256(CAST(p_partkey AS VARCHAR)) || '0' AS hex FROM part),
b AS (SELECT id, kind, qp, list_transform(range(264), lambda k: ((instr('0123456789abcdef', substr(hex, CAST(k // 4 + 1 AS BIGINT), 1)) - 1) >> CAST(3 - k % 4 AS INTEGER)) % 2) AS bits FROM p),
c AS (SELECT id, bits, list_transform({first}[CAST(kind + 1 AS BIGINT)], lambda v: {{'s': CAST({init_state} AS BIGINT), 'm': CAST({init_mps} AS BIGINT)}}) AS ctx FROM b),
d AS (SELECT id, -1::BIGINT AS i, 0::BIGINT AS bin, bits, ctx, 510::BIGINT AS r, list_sum(list_transform(range(9), lambda k: bits[k + 1] << CAST(8 - k AS INTEGER)))::BIGINT AS o, 9::BIGINT AS pos FROM c
  UNION ALL SELECT id, i, bin, bits, new_ctx, r << n, (o << n) + coalesce(list_sum(list_transform(range(n), lambda k: bits[pos + k + 1] << CAST(n - 1 - k AS INTEGER))), 0)::BIGINT, pos + n
  FROM (SELECT id, i, bits, pos, bin, r2 AS r, o2 AS o, CAST(CASE WHEN w = 0 THEN 0 ELSE 9 - length(bin(r2)) END AS INTEGER) AS n,
      CASE WHEN w = 0 THEN ctx ELSE list_transform(ctx, lambda x, k: CASE WHEN k <> w THEN x ELSE {{'s': CASE WHEN lps = 0 THEN (CASE WHEN x.s < 62 THEN x.s + 1 ELSE x.s END) ELSE CAST({after}[x.s + 1] AS BIGINT) END,
        'm': CASE WHEN lps = 1 AND x.s = 0 THEN 1 - x.m ELSE x.m END}} END) END AS new_ctx
    FROM (SELECT id, i, bits, ctx, w, CASE WHEN w = 0 THEN pos + 1 ELSE pos END AS pos, lps,
        CASE WHEN w = 0 THEN CAST(o1 >= r AS BIGINT) WHEN lps = 1 THEN 1 - ctx[w].m ELSE ctx[w].m END AS bin,
        CASE WHEN w = 0 THEN r WHEN lps = 1 THEN width ELSE r - width END AS r2, CASE WHEN w = 0 THEN CASE WHEN o1 >= r THEN o1 - r ELSE o1 END WHEN lps = 1 THEN o - (r - width) ELSE o END AS o2
      FROM (SELECT *, CASE WHEN w > 0 AND o >= r - width THEN 1 ELSE 0 END AS lps FROM (SELECT id, i + 1 AS i, bits, ctx, r, o, pos, {which.replace("i %", "(i + 1) %")} AS w, 2 * o + bits[pos + 1] AS o1,
          CASE WHEN {which.replace("i %", "(i + 1) %")} = 0 THEN 0 ELSE CAST({ranges}[ctx[{which.replace("i %", "(i + 1) %")}].s + 1][(r >> 6) % 4 + 1] AS BIGINT) END AS width FROM d WHERE i < 47)))))
SELECT id, i, bin, CAST(NULL AS VARCHAR) AS error FROM d WHERE i >= 0"""
    return {
        "x11_slice_data": f"""WITH {_SLICES_SQL} SELECT stream_id, nal_idx, 22 + key % 9 AS qp, (key + k) % 32 AS rem, CASE WHEN coded THEN 1 - 2 * negative END AS level, 0::BIGINT AS zero_words, CAST(NULL AS VARCHAR) AS error FROM s""",
        "r13_decoded_pictures": f"""WITH {_SLICES_SQL} SELECT stream_id, nal_idx, {_POC} AS poc, 0::BIGINT AS component,
  array_to_string(list_transform(range(64), lambda j: CASE WHEN coded AND negative = 0 THEN 255 ELSE 0 END), ',') AS samples, CAST(NULL AS VARCHAR) AS error FROM s""",
        "r13_picture_buffer": f"""WITH {_SLICES_SQL} SELECT stream_id, nal_idx AS pic_id, CASE WHEN k >= 4 THEN {_POC.replace("k", "(k - 4)")} END AS evicted, least(k + 1, 4) AS n_held,
  array_to_string(list_transform(range(greatest(k - 3, 0), k + 1), lambda j: {_POC.replace("k", "j")}), ',') AS held FROM s""",
        "h13_movie_frames": """SELECT n_nationkey::BIGINT AS id, k AS frame, 3 * k AS poc, array_to_string(list_transform(range(64), lambda j: CASE WHEN (n_nationkey + 1 + k) % 3 <> 0 AND (n_nationkey + 1 + k) % 2 = 0 THEN 255 ELSE 0 END), ',') AS samples,
  CAST(NULL AS VARCHAR) AS error FROM (SELECT n_nationkey, unnest(range(1 + (n_nationkey + 1) % 8)) AS k FROM nation) WHERE k % 2 = 0""",
        "t4_tile_maps": f"""WITH {PARTS_SQL}, b AS (SELECT *, addr_rs % ctb_w AS ctb_x, addr_rs // ctb_w AS ctb_y FROM (SELECT *, unnest(range(ctb_w * ctb_h)) AS addr_rs FROM tiled)),
t AS (SELECT pic_id, addr_rs, CASE WHEN pic_id % 7 = 0 THEN 0 WHEN pic_id % 2 = 0 AND ctb_w >= 4 THEN CASE WHEN ctb_x < 1 THEN 0 WHEN ctb_x < 3 THEN 1 ELSE 2 END ELSE {tile} END::BIGINT AS tile_id FROM b)
SELECT pic_id, addr_rs, row_number() OVER (PARTITION BY pic_id ORDER BY tile_id, addr_rs) - 1 AS addr_ts, tile_id, CAST(NULL AS VARCHAR) AS error FROM t""",
        "e2_context_vectors": f"""WITH v AS (SELECT k AS init_type, unnest([{values}][k + 1]) AS value, unnest(range({context_count()})) AS place FROM (SELECT unnest(range(3)) AS k)), q AS (SELECT *, unnest(range(52)) AS qp FROM v)
SELECT init_type, place, qp, coalesce({state}, 0)::BIGINT AS state, coalesce({mps}, 0)::BIGINT AS mps FROM q""",
        "e10_arithmetic_bins": bins,
    }


ORACLE = _oracle()
