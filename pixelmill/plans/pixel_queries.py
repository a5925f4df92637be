"""Queries of colours, geometry, compositing, palettes and quantisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, geometry
from ..functions.color import num
from ..functions.geometry import Box, Rect
from ..operators import draw, palette, quantize, raster
from ..operators.raster import KEYS
from . import fixtures as fx
from .catalog import add, query
from .fixtures import sql

# --- colour models: canonical to model ----------------------------------------------------------

CLAMPED = "least(greatest({} >> 16, 0), 255)"
LUMA = "((19595 * {r} + 38470 * {g} + 7471 * {b} + 32768) >> 16)"
CB = CLAMPED.format("(-11056 * {r} - 21712 * {g} + 32768 * {b} + 8421376)")
CR = CLAMPED.format("(32768 * {r} - 27440 * {g} - 5328 * {b} + 8421376)")


def _ycc(**c) -> list[str]:
    return [t.format(**c) for t in (LUMA, CB, CR)]


def _straight(c: str, shift: int) -> str:
    return f"CASE WHEN a = 0 THEN 0 WHEN a = 65535 THEN {c} >> {shift} ELSE ({c} * 65535 // a) >> {shift} END"


def _cmyk(r: str, g: str, b: str) -> list[str]:
    w = f"greatest({r}, {g}, {b})"
    return [*(f"CASE WHEN {w} = 0 THEN 0 ELSE ({w} - {c}) * 255 // {w} END" for c in (r, g, b)), f"255 - {w}"]


BYTES = {c: f"({c} >> 8)" for c in "rgb"}
TO_SQL = {
    "c01_to_rgba": ("rgba", [f"{c} >> 8" for c in "rgba"]),
    "c02_to_rgba64": ("rgba64", list("rgba")),
    "c03_to_nrgba": ("nrgba", [*(_straight(c, 8) for c in "rgb"), "a >> 8"]),
    "c04_to_nrgba64": ("nrgba64", [*(_straight(c, 0) for c in "rgb"), "a"]),
    "c05_to_alpha": ("alpha", ["a >> 8"]),
    "c05_to_alpha16": ("alpha16", ["a"]),
    "c06_to_gray": ("gray", ["(19595 * r + 38470 * g + 7471 * b + 32768) >> 24"]),
    "c07_to_gray16": ("gray16", ["(19595 * r + 38470 * g + 7471 * b + 32768) >> 16"]),
    "c12_to_ycbcr": ("ycbcr", _ycc(**BYTES)),
    "c12_to_nycbcra": ("nycbcra", [*_ycc(**{c: f"({_straight(c, 8)})" for c in "rgb"}), "a >> 8"]),
    "c12_to_cmyk": ("cmyk", _cmyk(*BYTES.values())),
}
for _name, (_model, _exprs) in TO_SQL.items():
    _cols = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for e, n in zip(_exprs, color.CONVERSIONS[_model][0]))
    add(_name, lambda s, d, m=_model: raster.convert(fx.canonical(s, d), m), sql(f"SELECT image_id, x, y, {_cols} FROM can", "can"))


def _bytes_query(name: str, builder, names: str, exprs: list[str]) -> None:
    cols = names.split()
    add(name, lambda s, d: fx.orders(s, d).select(*KEYS, *(v.alias(n) for n, v in zip(cols, builder("r", "g", "b")))), sql("SELECT image_id, x, y, " + ", ".join(f"CAST({e} AS BIGINT) AS {n}" for e, n in zip(exprs, cols)) + " FROM px", "px"))


_bytes_query("c08_rgb_to_ycbcr", color.rgb_to_ycbcr, "yy cb cr", _ycc(r="r", g="g", b="b"))
_TO_RGB = ["(r * 65793 + 91881 * (b - 128))", "(r * 65793 - 22554 * (g - 128) - 46802 * (b - 128))", "(r * 65793 + 116130 * (g - 128))"]
_bytes_query("c09_ycbcr_to_rgb", color.ycbcr_to_rgb, "red green blue", [CLAMPED.format(e) for e in _TO_RGB])
_bytes_query("c10_rgb_to_cmyk", color.rgb_to_cmyk, "c m yel k", _cmyk("r", "g", "b"))
_WHITE = "(65535 - a * 257)"
add(
    "c11_cmyk_to_rgb",
    lambda s, d: fx.orders(s, d).select(*KEYS, *(v.alias(n) for n, v in zip(("red", "green", "blue"), color.cmyk_to_rgb("r", "g", "b", "a")))),
    sql("SELECT image_id, x, y, " + ", ".join(f"((65535 - {c} * 257) * {_WHITE} // 65535) >> 8 AS {n}" for c, n in zip("rgb", ("red", "green", "blue"))) + " FROM px", "px"),
)

# --- colour models: model to canonical ----------------------------------------------------------

_YCC16 = [f"least(greatest({e} >> 8, 0), 65535)" for e in _TO_RGB]
FROM_SQL = {
    "rgba": ("rgba", [f"{c} * 257" for c in "rgba"]),
    "rgba64": ("rgba", list("rgba")),
    "nrgba": ("rgba", [*(f"{c} * 257 * a // 255" for c in "rgb"), "a * 257"]),
    "nrgba64": ("rgba", [*(f"{c} * a // 65535" for c in "rgb"), "a"]),
    "alpha": ("a", ["a * 257"] * 4),
    "alpha16": ("a", ["a"] * 4),
    "gray": ("r", ["r * 257"] * 3 + ["65535"]),
    "gray16": ("r", ["r"] * 3 + ["65535"]),
    "ycbcr": ("rgb", [*_YCC16, "65535"]),
    "nycbcra": ("rgba", [*(f"{e} * a * 257 // 65535" for e in _YCC16), "a * 257"]),
    "cmyk": ("rgba", [*(f"(65535 - {c} * 257) * {_WHITE} // 65535" for c in "rgb"), "65535"]),
}
for _model, (_names, _exprs) in FROM_SQL.items():
    _cols = ", ".join(f"CAST({e} AS BIGINT) AS {n}16" for e, n in zip(_exprs, "rgba"))
    _wide = "64" in _model or "16" in _model  # these read 16-bit channels
    add(
        f"c13_from_{_model}",
        lambda s, d, m=_model, n=_names, w=_wide: (fx.canonical if w else fx.orders)(s, d).select(*KEYS, *(v.alias(f"{c}16") for c, v in zip("rgba", color.expand(m, *n)))),
        sql(f"SELECT image_id, x, y, {_cols} FROM {'can' if _wide else 'px'}", "can" if _wide else "px"),
    )

add("c14_sq_diff", lambda s, d: fx.canonical(s, d).select(*KEYS, color.sq_diff("r", "g").alias("d")), sql("SELECT image_id, x, y, ((r - g) * (r - g)) >> 2 AS d FROM can", "can"))


@query("c15_rgba64_at", sql("SELECT CAST(0 AS BIGINT) AS image_id, p.x, p.y, coalesce(can.r, 0) AS r, coalesce(can.g, 0) AS g, coalesce(can.b, 0) AS b, coalesce(can.a, 0) AS a FROM (SELECT c_custkey * 7 % 130 AS x, c_custkey % 40 AS y FROM customer) p LEFT JOIN can ON p.x = can.x AND p.y = can.y", "can"))
def c15(spark: SparkSession, d: str) -> DataFrame:
    points = fx.table(spark, d, "customer").select(num(0).alias("image_id"), (F.col("c_custkey") * 7 % 130).alias("x"), (F.col("c_custkey") % 40).alias("y"))
    return raster.at(fx.canonical(spark, d), points, dict.fromkeys("rgba", 0))


# --- geometry -----------------------------------------------------------------------------------


@query(
    "g01_points",
    sql("SELECT image_id, x, y, x + r AS ax, y + g AS ay, x - r AS sx, y - g AS sy, r * 3 AS mx, g * 3 AS my, (x - r) // 3 AS dx, (y - g) // 3 AS dy, (x = r AND y = g) AS eq FROM px", "px"),
)
def g01(spark: SparkSession, d: str) -> DataFrame:
    x, y, r, g = map(num, ("x", "y", "r", "g"))
    return fx.orders(spark, d).select(*KEYS, (x + r).alias("ax"), (y + g).alias("ay"), (x - r).alias("sx"), (y - g).alias("sy"), (r * 3).alias("mx"), (g * 3).alias("my"), color.div(x - r, 3).alias("dx"), color.div(y - g, 3).alias("dy"), ((x == r) & (y == g)).alias("eq"))


_IN_BOX = "x >= x0 AND x < x1 AND y >= y0 AND y < y1"


@query("g02_points_in_boxes", sql(f"SELECT x, y, box_id FROM px JOIN box ON {_IN_BOX}", "px", "box"))
def g02(spark: SparkSession, d: str) -> DataFrame:
    return raster.in_boxes(fx.orders(spark, d), fx.boxes(spark, d)).select("x", "y", "box_id")


@query("g03_extents", sql("SELECT box_id, x1 - x0 AS dx, y1 - y0 AS dy FROM box", "box"))
def g03(spark: SparkSession, d: str) -> DataFrame:
    b = Box.named()
    return fx.boxes(spark, d).select("box_id", b.dx.alias("dx"), b.dy.alias("dy"))


@query("g04_translate", sql("SELECT box_id, x0 + 3 AS x0, y0 - 4 AS y0, x1 + 3 AS x1, y1 - 4 AS y1 FROM box", "box"))
def g04(spark: SparkSession, d: str) -> DataFrame:
    return fx.boxes(spark, d).select("box_id", *Box.named().shift(3, -4).columns())


_PAIRS = "pr AS (SELECT p.box_id, p.x0 AS ax0, p.y0 AS ay0, p.x1 AS ax1, p.y1 AS ay1, q.x0 AS bx0, q.y0 AS by0, CASE WHEN q.box_id % 5 = 0 THEN q.x0 ELSE q.x1 END AS bx1, q.y1 AS by1 FROM box p JOIN box q ON q.box_id = p.box_id + 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring rectangles a and b; every fifth b is empty."""
    boxes = fx.boxes(spark, d)
    a = boxes.select("box_id", *(F.col(c).alias("a" + c) for c in Box._fields))
    b = boxes.select((F.col("box_id") - 1).alias("box_id"), *((F.when(F.col("box_id") % 5 == 0, F.col("x0")).otherwise(F.col(c)) if c == "x1" else F.col(c)).alias("b" + c) for c in Box._fields))
    return a.join(b, "box_id")


_MEET_EMPTY = "(greatest(ax0, bx0) >= least(ax1, bx1) OR greatest(ay0, by0) >= least(ay1, by1))"
_A_EMPTY, _B_EMPTY = "(ax0 >= ax1 OR ay0 >= ay1)", "(bx0 >= bx1 OR by0 >= by1)"
_EDGES = [(c, "greatest" if c.endswith("0") else "least") for c in Box._fields]
add("g05_intersect", lambda s, d: _pairs(s, d).select("box_id", *Box.named("a").meet(Box.named("b")).columns()), sql("SELECT box_id, " + ", ".join(f"CASE WHEN {_MEET_EMPTY} THEN 0 ELSE {f}(a{c}, b{c}) END AS {c}" for c, f in _EDGES) + " FROM pr", "box", extra=_PAIRS))
add("g06_union", lambda s, d: _pairs(s, d).select("box_id", *Box.named("a").join(Box.named("b")).columns()), sql("SELECT box_id, " + ", ".join(f"CASE WHEN {_A_EMPTY} THEN b{c} WHEN {_B_EMPTY} THEN a{c} ELSE {'least' if f == 'greatest' else 'greatest'}(a{c}, b{c}) END AS {c}" for c, f in _EDGES) + " FROM pr", "box", extra=_PAIRS))
add("g06_bounds", lambda s, d: raster.bounds(fx.boxes(s, d), ["kind"]), sql("SELECT kind, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM box WHERE x0 < x1 AND y0 < y1 GROUP BY kind", "box"))
add(
    "g07_predicates",
    lambda s, d: _pairs(s, d).select("box_id", Box.named("b").empty.alias("empty"), Box.named("a").equals(Box.named("b")).alias("eq"), Box.named("b").within(Box.named("a")).alias("inside"), Box.named("a").overlaps(Box.named("b")).alias("overlaps")),
    sql(f"SELECT box_id, {_B_EMPTY} AS empty, ((ax0 = bx0 AND ay0 = by0 AND ax1 = bx1 AND ay1 = by1) OR ({_A_EMPTY} AND {_B_EMPTY})) AS eq, ({_B_EMPTY} OR (bx0 >= ax0 AND by0 >= ay0 AND bx1 <= ax1 AND by1 <= ay1)) AS inside, (NOT {_A_EMPTY} AND NOT {_B_EMPTY} AND ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1) AS overlaps FROM pr", "box", extra=_PAIRS),
)


@query("g07_overlap_join", sql("SELECT l.box_id AS l_box_id, r.box_id AS r_box_id FROM box l JOIN box r ON l.box_id < r.box_id AND l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1", "box"))
def g07_join(spark: SparkSession, d: str) -> DataFrame:
    boxes = fx.boxes(spark, d)
    return raster.overlapping(boxes, boxes).where("l_box_id < r_box_id").select("l_box_id", "r_box_id")


add("g08_normalise", lambda s, d: fx.orders(s, d).select(*KEYS, *Box.normal("r", "g", "b", "x").columns()), sql("SELECT image_id, x, y, least(r, b) AS x0, least(g, x) AS y0, greatest(r, b) AS x1, greatest(g, x) AS y1 FROM px", "px"))
_M, _BIG = "(r * 1000) * (g * 1000) * (b - 5)", 2147483647
add(
    "g09_checked_sizes",
    lambda s, d: fx.orders(s, d).select(*KEYS, geometry.mul3(num("r") * 1000, num("g") * 1000, num("b") - 5).alias("m"), geometry.add2(num("r") * 9000000, num("g") - 3).alias("p"), geometry.buffer_length(4, Box(num("x"), num("y"), num("x") + num("r"), num("y") + num("g") - 1)).alias("n")),
    sql(f"SELECT image_id, x, y, CASE WHEN b < 5 OR {_M} > {_BIG} THEN -1 ELSE {_M} END AS m, CASE WHEN g < 3 OR r * 9000000 + g - 3 > {_BIG} THEN -1 ELSE r * 9000000 + g - 3 END AS p, CASE WHEN g < 1 THEN NULL ELSE 4 * r * (g - 1) END AS n FROM px", "px"),
)


def _cut(v: str, n: int) -> str:
    return v if n == 1 else f"({v} // {n})"


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    box = Box(*(num(v) for v in (3, 5, 103, 2005)))
    chroma = (geometry.chroma_offset("x", "y", box, 56, k).alias(f"c{k}") for k in geometry.RATIOS)
    return fx.orders(spark, d).select(*KEYS, geometry.pixel_offset("x", "y", box, 400, 4).alias("pix"), geometry.luma_offset("x", "y", box, 112).alias("luma"), *chroma)


add(
    "g10_offsets",
    _offsets,
    sql("SELECT image_id, x, y, (y - 5) * 400 + (x - 3) * 4 AS pix, (y - 5) * 112 + x - 3 AS luma, " + ", ".join(f"({_cut('y', v)} - {_cut('5', v)}) * 56 + {_cut('x', h)} - {_cut('3', h)} AS c{k}" for k, (h, v) in geometry.RATIOS.items()) + " FROM px", "px"),
)


def _sizes(k: str, h: int, v: int) -> str:
    wide = "x1 - x0" if h == 1 else f"(x1 + {h - 1}) // {h} - x0 // {h}"
    high = "y1 - y0" if v == 1 else f"(y1 + {v - 1}) // {v} - y0 // {v}"
    return f"{wide} AS w{k}, {high} AS h{k}"


add(
    "g11_plane_sizes",
    lambda s, d: fx.boxes(s, d).select("box_id", *(c.alias(n + k) for k in geometry.RATIOS for n, c in zip("wh", geometry.plane_sizes(Box.named(), k)[2:]))),
    sql("SELECT box_id, " + ", ".join(_sizes(k, h, v) for k, (h, v) in geometry.RATIOS.items()) + " FROM box", "box"),
)
add("g12_crop", lambda s, d: raster.crop(fx.orders(s, d), Rect(10, 5, 60, 40)), sql("SELECT * FROM px WHERE x >= 10 AND x < 60 AND y >= 5 AND y < 40", "px"))
add("g13_opaque", lambda s, d: raster.opaque(fx.orders(s, d).withColumn("image_id", F.col("y"))), sql("SELECT y AS image_id, bool_and(a = 255) AS opaque FROM px GROUP BY y", "px"))
_POINTS = "pts AS (SELECT c_custkey % 120 AS x, c_custkey // 120 AS y, c_custkey % 256 AS v FROM customer)"


@query("g14_set_pixels", sql("SELECT image_id, px.x, px.y, coalesce(v, r) AS r, coalesce(v + 1, g) AS g, b, a FROM px LEFT JOIN pts ON px.x = pts.x AND px.y = pts.y", "px", extra=_POINTS))
def g14(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    points = fx.table(spark, d, "customer").select(num(0).alias("image_id"), (key % 120).alias("x"), F.floor(key / 120).alias("y"), (key % 256).alias("r"), (key % 256 + 1).alias("g"))
    return raster.put(fx.orders(spark, d), points, ["r", "g"])


add("g15_new_image", lambda s, d: raster.new_image(s, Rect(-3, 2, 61, 40), ("r", "g", "b", "a")), "SELECT CAST(0 AS BIGINT) AS image_id, CAST(i % 64 - 3 AS BIGINT) AS x, CAST(i // 64 + 2 AS BIGINT) AS y, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS g, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS a FROM range(2432) t(i)")

# --- compositing --------------------------------------------------------------------------------

AREA, FROM = Rect(5, 1, 45, 25), (10, 20)
_INSIDE = "(d.x >= 5 AND d.x < 45 AND d.y >= 1 AND d.y < 25)"
_JOINED = "j AS (SELECT d.*, " + _INSIDE + " AS here, coalesce(s.r, 0) AS sr, coalesce(s.g, 0) AS sg, coalesce(s.b, 0) AS sb, coalesce(s.a, 0) AS sa, coalesce(m.a, 0) AS ma FROM {dst} d LEFT JOIN {src} s ON s.x = d.x + 5 AND s.y = d.y + 19 AND " + _INSIDE + " LEFT JOIN (SELECT x, y, g * 257 AS a FROM px) m ON m.x = d.x - 5 AND m.y = d.y - 1 AND " + _INSIDE + ")"


def _over(s: dict, c: str, full: int) -> str:
    return f"CASE WHEN a = 0 OR {s['a']} = {full} THEN {s[c]} WHEN {s['a']} = 0 THEN {c} ELSE {s[c]} + {c} * ({full} - {s['a']}) // {full} END"


_S = {c: f"s{c}" for c in "rgba"}
_DIM = {c: f"(s{c} * ma // 65535)" for c in "rgba"}


def _drawn(exprs: dict, dst: str = "dst", src: str = "can") -> str:
    return sql("SELECT image_id, x, y, " + ", ".join(f"CAST(CASE WHEN here THEN {exprs[c]} ELSE {c} END AS BIGINT) AS {c}" for c in "rgba") + " FROM j", "can", "dst", *([src] if src not in ("can", "px8") else []), extra=("px8 AS (SELECT image_id, x, y, r * a // 255 AS r, g * a // 255 AS g, b * a // 255 AS b, a FROM px), " if src == "px8" else "") + _JOINED.format(dst=dst, src=src))


def _wide_dst(s: SparkSession, d: str) -> DataFrame:
    return raster.canonical(fx.customers(s, d), "rgba", ("r", "g", "b", "a"))


def _drawing(op: str, masked: bool):
    def run(s: SparkSession, d: str) -> DataFrame:
        mask = fx.orders(s, d).select(*KEYS, color.wide("g").alias("a")) if masked else None
        return draw.draw(_wide_dst(s, d), fx.CUSTOMERS, AREA, fx.canonical(s, d), fx.ORDERS, FROM, op, mask, fx.ORDERS)

    return run


_WHOLE = "j AS (SELECT d.*, coalesce(s.r, 0) AS sr, coalesce(s.g, 0) AS sg, coalesce(s.b, 0) AS sb, coalesce(s.a, 0) AS sa FROM dst d LEFT JOIN can s ON s.x = d.x AND s.y = d.y)"
add("d01_draw", lambda s, d: draw.draw(_wide_dst(s, d), fx.CUSTOMERS, fx.CUSTOMERS, fx.canonical(s, d), fx.ORDERS), sql("SELECT image_id, x, y, " + ", ".join(f"CAST({_over(_S, c, 65535)} AS BIGINT) AS {c}" for c in "rgba") + " FROM j", "can", "dst", extra=_WHOLE))


@query("d02_clip", "SELECT CAST(15 AS BIGINT) AS x0, CAST(9 AS BIGINT) AS y0, CAST(30 AS BIGINT) AS x1, CAST(19 AS BIGINT) AS y1")
def d02(spark: SparkSession, d: str) -> DataFrame:
    r = draw.clip(Rect(10, 9, 80, 90), Rect(15, 0, 50, 30), Rect(0, 0, 40, 20), (5, 10), Rect(0, 0, 100, 100), (85, 90))
    return spark.createDataFrame([(r.x0, r.y0, r.x1, r.y1)], "x0 long, y0 long, x1 long, y1 long")


add("d03_over", _drawing("over", False), _drawn({c: _over(_S, c, 65535) for c in "rgba"}))
add("d04_src", _drawing("src", False), _drawn(_S))
add("d05_over_masked", _drawing("over", True), _drawn({c: f"CASE WHEN ma = 0 THEN {c} WHEN ma = 65535 THEN {_over(_S, c, 65535)} ELSE {_over(_DIM, c, 65535)} END" for c in "rgba"}))
add("d06_src_masked", _drawing("src", True), _drawn({c: f"CASE WHEN ma = 0 THEN 0 WHEN ma = 65535 THEN s{c} ELSE {_DIM[c]} END" for c in "rgba"}))
add("d07_fill", lambda s, d: draw.fill(fx.customers(s, d), fx.CUSTOMERS, AREA, (10, 20, 30, 255)), sql(f"SELECT image_id, x, y, CASE WHEN {_INSIDE} THEN 10 ELSE r END AS r, CASE WHEN {_INSIDE} THEN 20 ELSE g END AS g, CASE WHEN {_INSIDE} THEN 30 ELSE b END AS b, a FROM cust d", "cust"))


def _eight(s: SparkSession, d: str) -> DataFrame:
    """Orders as premultiplied bytes."""
    return fx.orders(s, d).select(*KEYS, *(color.div(num(c) * num("a"), 255).alias(c) for c in "rgb"), "a")


add("d08_copy", lambda s, d: draw.draw(fx.customers(s, d), fx.CUSTOMERS, AREA, _eight(s, d), fx.ORDERS, FROM, "src", eight_bit=True), _drawn(_S, "cust", "px8"))
add(
    "d09_over_pixels",
    lambda s, d: fx.canonical(s, d).select(*KEYS, *(v.alias(c) for c, v in zip("rgba", draw.over16(("r", "g", "b", "a"), ("b", "r", "g", F.lit(40000)))))),
    sql("SELECT image_id, x, y, " + ", ".join(f"CAST(CASE WHEN a = 65535 THEN {c} WHEN a = 0 THEN {e} ELSE {c} + {e} * (65535 - a) // 65535 END AS BIGINT) AS {c}" for c, e in zip("rgba", ("b", "r", "g", "40000"))) + " FROM can", "can"),
)
add("d10_over_bytes", lambda s, d: draw.draw(fx.customers(s, d), fx.CUSTOMERS, AREA, _eight(s, d), fx.ORDERS, FROM, "over", eight_bit=True), _drawn({c: f"CASE WHEN sa = 255 THEN s{c} WHEN sa = 0 THEN {c} ELSE s{c} + {c} * (255 - sa) // 255 END" for c in "rgba"}, "cust", "px8"))
add("d11_mask", lambda s, d: fx.canonical(s, d).select(*KEYS, *(v.alias(c) for c, v in zip("rgba", draw.masked(("r", "g", "b", "a"), num("x") * 600)))), sql("SELECT image_id, x, y, " + ", ".join(f"{c} * x * 600 // 65535 AS {c}" for c in "rgba") + " FROM can", "can"))

_SPREAD = "(i // {n} % 32) * 2114"
_CELLS = "cells AS (SELECT i AS cell, " + ", ".join(f"{_SPREAD.format(n=n)} AS {c}" for n, c in ((1024, "r"), (32, "g"), (1, "b"))) + ", 65535 AS a FROM range(32768) t(i))"
_LUT = "lut AS (SELECT cell, arg_min(idx, d * 1000 + idx) AS idx FROM (SELECT cell, idx, " + " + ".join(f"((q.{c} - pal.{c} * 257) * (q.{c} - pal.{c} * 257) >> 2)" for c in "rgba") + " AS d FROM {q} q CROSS JOIN pal) GROUP BY cell)"
_CELL_OF = "(r >> 11) * 1024 + (g >> 11) * 32 + (b >> 11)"
_CELL_LUT = f"{_CELLS}, {_LUT.format(q='cells')}"

add("d12_draw_paletted", lambda s, d: palette.indexed(raster.crop(fx.canonical(s, d), AREA), fx.palette(s, d)), sql(f"SELECT image_id, x, y, idx FROM (SELECT *, {_CELL_OF} AS cell FROM can WHERE x >= 5 AND x < 45 AND y >= 1 AND y < 25) JOIN lut USING (cell)", "can", "pal", extra=_CELL_LUT))


def _planes(s: SparkSession, d: str, ratio: str) -> tuple[DataFrame, DataFrame]:
    h, v = geometry.RATIOS[ratio]
    px = fx.orders(s, d)
    luma = px.select(*KEYS, F.col("r").alias("yy"))
    chroma = px.where((F.col("x") < -(-100 // h)) & (F.col("y") % v == 0)).select("image_id", "x", F.floor(F.col("y") / v).alias("y"), F.col("g").alias("cb"), F.col("b").alias("cr"))
    return luma, chroma


def _ycc_sql(ratio: str) -> str:
    h, v = geometry.RATIOS[ratio]
    joined = f"u AS (SELECT p.image_id, p.x, p.y, p.r, q.g, q.b FROM px p JOIN px q ON q.x = p.x // {h} AND q.y = p.y // {v} * {v})"
    rgb = f"v AS (SELECT x, y, {CLAMPED.format(_TO_RGB[0])} AS r, {CLAMPED.format(_TO_RGB[1])} AS g, {CLAMPED.format(_TO_RGB[2])} AS b FROM u)"
    return sql("SELECT d.image_id, d.x, d.y, " + ", ".join(f"CAST(CASE WHEN {_INSIDE} THEN coalesce(v.{c}, 0) ELSE d.{c} END AS BIGINT) AS {c}" for c in "rgb") + f", CAST(CASE WHEN {_INSIDE} AND v.r IS NULL THEN 0 ELSE 255 END AS BIGINT) AS a FROM cust d LEFT JOIN v ON v.x = d.x + 5 AND v.y = d.y + 19", "px", "cust", extra=f"{joined}, {rgb}")


for _ratio in ("444", "422", "420", "440"):
    add(f"d13_draw_ycbcr_{_ratio}", lambda s, d, k=_ratio: draw.draw_ycbcr(fx.customers(s, d), fx.CUSTOMERS, AREA, *_planes(s, d, k), fx.ORDERS, k, FROM), _ycc_sql(_ratio))

# --- palettes -----------------------------------------------------------------------------------

_NEAREST = _LUT.format(q="(SELECT *, y * 100 + x AS cell FROM can)")
add("p01_nearest", lambda s, d: palette.nearest(fx.canonical(s, d), fx.palette(s, d), KEYS), sql("SELECT CAST(0 AS BIGINT) AS image_id, cell % 100 AS x, cell // 100 AS y, idx FROM lut", "can", "pal", extra=_NEAREST))
add("p02_lookup_table", lambda s, d: palette.lookup_table(s, fx.palette(s, d)), sql("SELECT cell, idx FROM lut", "pal", extra=_CELL_LUT))
add("p02_indexed", lambda s, d: palette.indexed(fx.canonical(s, d), fx.palette(s, d)), sql(f"SELECT image_id, x, y, idx FROM (SELECT *, {_CELL_OF} AS cell FROM can) JOIN lut USING (cell)", "can", "pal", extra=_CELL_LUT))
add("p03_convert", lambda s, d: palette.converted(fx.canonical(s, d), fx.palette(s, d)), sql(f"SELECT p.image_id, p.x, p.y, idx, pal.r, pal.g, pal.b, pal.a FROM (SELECT *, {_CELL_OF} AS cell FROM can) p JOIN lut USING (cell) JOIN pal USING (idx)", "can", "pal", extra=_CELL_LUT))
add("p04_cube_palette", lambda s, d: palette.cube_palette(s), "SELECT i AS idx, " + ", ".join(f"CAST(CASE WHEN i < 216 THEN 255 - i // {n} % 6 * 255 // 5 ELSE 255 - (i - 216) * 255 // 39 END AS BIGINT) AS {c}" for n, c in ((36, "r"), (6, "g"), (1, "b"))) + ", CAST(255 AS BIGINT) AS a FROM range(256) t(i)")

# --- quantisation -------------------------------------------------------------------------------

_HIST = "hist AS (SELECT image_id, r >> 3 AS br, g >> 3 AS bg, b >> 3 AS bb, count(*) AS w, CAST(sum(r) AS BIGINT) AS mr, CAST(sum(g) AS BIGINT) AS mg, CAST(sum(b) AS BIGINT) AS mb FROM px WHERE a > 0 GROUP BY ALL)"
_UNDIM = "un AS (SELECT image_id, " + ", ".join(f"least(CASE WHEN a < 65535 THEN {c} * 65535 // a ELSE {c} END, 65535) >> 8 AS {c}" for c in "rgb") + ", a >> 8 AS a FROM can WHERE a > 0)"
_SUMS = ", ".join(f"CAST(sum({c}) OVER (PARTITION BY {{p}} ORDER BY {{o}}) AS BIGINT) AS {c}" for c in ("w", "mr", "mg", "mb"))
_PREFIX = (
    "grid AS (SELECT i // 1024 AS br, i // 32 % 32 AS bg, i % 32 AS bb FROM range(32768) t(i)), s0 AS (SELECT br, bg, bb, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("w", "mr", "mg", "mb")) + " FROM grid LEFT JOIN hist USING (br, bg, bb)), "
    + f"s1 AS (SELECT br, bg, bb, {_SUMS.format(p='br, bg', o='bb')} FROM s0), s2 AS (SELECT br, bg, bb, {_SUMS.format(p='br, bb', o='bg')} FROM s1), s3 AS (SELECT br, bg, bb, {_SUMS.format(p='bg, bb', o='br')} FROM s2)"
)


def _hist(s: SparkSession, d: str) -> DataFrame:
    return quantize.histogram(fx.orders(s, d))


def _score(low: str, high: str) -> str:
    side = lambda w: "(" + " + ".join(f"CAST({w.format(c)} AS DOUBLE) * {w.format(c)}" for c in ("mr", "mg", "mb")) + f") / {w.format('w')}"
    return f"CAST({side(low)} + {side(high)} AS FLOAT)"


def _cuts(axis: str) -> str:
    sums = ", ".join(f"sum({c}) OVER (ORDER BY {axis}) AS l{c}, sum({c}) OVER () AS t{c}" for c in ("w", "mr", "mg", "mb"))
    return f"SELECT {axis} AS cut, {_score('l{}', '(t{0} - l{0})')} AS score FROM (SELECT {axis}, {sums} FROM (SELECT {axis}, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("w", "mr", "mg", "mb")) + f" FROM hist GROUP BY {axis})) WHERE lw > 0 AND lw < tw"


add("q02_histogram", _hist, sql("SELECT * FROM hist", "px", extra=_HIST))
add("q02_histogram_straight", lambda s, d: quantize.histogram(fx.canonical(s, d), premultiplied=False), sql("SELECT * FROM hist", "can", extra=f"{_UNDIM}, {_HIST.replace('FROM px', 'FROM un')}"))
add("q03_running_sums", lambda s, d: quantize.running_sums(_hist(s, d)), sql("SELECT CAST(0 AS BIGINT) AS image_id, * FROM s3", "px", extra=f"{_HIST}, {_PREFIX}"))
add("q04_volume", lambda s, d: quantize.volume(_hist(s, d), (3, 0, 5), (20, 17, 31)), sql("SELECT image_id, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("w", "mr", "mg", "mb")) + " FROM hist WHERE br BETWEEN 3 AND 20 AND bg BETWEEN 0 AND 17 AND bb BETWEEN 5 AND 31 GROUP BY image_id", "px", extra=_HIST))
for _axis in ("br", "bg", "bb"):
    add(f"q05_cut_scores_{_axis}", lambda s, d, a=_axis: quantize.cut_scores(_hist(s, d), a), sql(f"SELECT CAST(0 AS BIGINT) AS image_id, * FROM ({_cuts(_axis)})", "px", extra=_HIST))
_BEST = "best AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS axis, * FROM ({_cuts(a)})" for k, a in enumerate(("br", "bg", "bb"))) + ") ORDER BY score DESC, axis, cut LIMIT 1)"
_HALVES = "half AS (SELECT CASE WHEN CASE axis WHEN 0 THEN br WHEN 1 THEN bg ELSE bb END <= cut THEN 0 ELSE 1 END AS idx, hist.* FROM hist CROSS JOIN best)"
add("q06_two_colours", lambda s, d: quantize.palettes(_hist(s, d), 2), sql("SELECT CAST(0 AS BIGINT) AS image_id, CAST(idx AS BIGINT) AS idx, " + ", ".join(f"CAST(sum(m{c}) // sum(w) AS BIGINT) AS {c}" for c in "rgb") + ", CAST(255 AS BIGINT) AS a FROM half GROUP BY idx", "px", extra=f"{_HIST}, {_BEST}, {_HALVES}"))
add("q07_map_two", lambda s, d: quantize.mapped(fx.orders(s, d).where("a > 0"), quantize.tags(_hist(s, d), 2)), sql("SELECT image_id, x, y, CAST(CASE WHEN CASE axis WHEN 0 THEN r >> 3 WHEN 1 THEN g >> 3 ELSE b >> 3 END <= cut THEN 0 ELSE 1 END AS BIGINT) AS tag FROM px CROSS JOIN best WHERE a > 0", "px", extra=f"{_HIST}, {_BEST}"))


def _splits(colours: int = 256) -> str:
    """Recursive expressions: the bins of ``hist`` with the box they are in after each split, and the last one's palette ``pal``."""
    sums = " UNION ALL ".join(f"SELECT tag, {k} AS axis, b{c} AS cut, sum(w) AS w, sum(mr) AS mr, sum(mg) AS mg, sum(mb) AS mb FROM state GROUP BY tag, b{c}" for k, c in enumerate("rgb"))
    upto = ", ".join(f"CAST(sum({c}) OVER (PARTITION BY tag, axis ORDER BY cut) AS BIGINT) AS l{c}, CAST(sum({c}) OVER (PARTITION BY tag, axis) AS BIGINT) AS t{c}" for c in ("w", "mr", "mg", "mb"))
    best = f"SELECT tag AS cut_tag, axis, cut FROM (SELECT tag, axis, cut, {upto} FROM ({sums})) WHERE lw < tw ORDER BY {_score('l{}', '(t{0} - l{0})')} DESC, tag, axis, cut LIMIT 1"
    above = "CASE axis WHEN 0 THEN br WHEN 1 THEN bg ELSE bb END > cut"
    step = f"SELECT step + 1, br, bg, bb, w, mr, mg, mb, CASE WHEN tag = cut_tag AND {above} THEN step ELSE tag END FROM state CROSS JOIN ({best}) WHERE step < {colours}"
    state = f"state AS (SELECT CAST(1 AS BIGINT) AS step, br, bg, bb, w, mr, mg, mb, CAST(0 AS BIGINT) AS tag FROM hist UNION ALL {step})"
    means = ", ".join(f"CAST(sum(m{c}) // sum(w) AS BIGINT) AS {c}" for c in "rgb")
    filled = ", ".join(f"coalesce({c}, 0) AS {c}" for c in "rgb")
    return f"{state}, pal AS (SELECT i AS idx, {filled}, CAST(255 AS BIGINT) AS a FROM range({colours}) t(i) LEFT JOIN (SELECT tag, {means} FROM state WHERE step = (SELECT max(step) FROM state) GROUP BY tag) ON tag = i)"


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


add("q01_quantize", lambda s, d: quantize.palettes(_hist(s, d), 256), recursive(sql("SELECT CAST(0 AS BIGINT) AS image_id, idx, r, g, b, a FROM pal", "px", extra=f"{_HIST}, {_splits()}")))
add(
    "q01_palettised",
    lambda s, d: palette.indexed_by_image(fx.canonical(s, d), quantize.palettes(quantize.histogram(fx.canonical(s, d), premultiplied=False))),
    recursive(sql(f"SELECT image_id, x, y, idx FROM (SELECT *, {_CELL_OF} AS cell FROM can) JOIN lut USING (cell)", "can", extra=f"{_UNDIM}, {_HIST.replace('FROM px', 'FROM un')}, {_splits()}, {_CELL_LUT}")),
)
#: A file with a palette of its own colours, as it is read again.
OWN_PALETTE = recursive(sql(f"SELECT p.image_id, p.x, p.y, idx AS c1, pal.r * 257 AS r, pal.g * 257 AS g, pal.b * 257 AS b FROM (SELECT image_id, x, y, {_CELL_OF} AS cell FROM (SELECT image_id, x, y, r * 257 AS r, g * 257 AS g, b * 257 AS b FROM px)) p JOIN lut USING (cell) JOIN pal USING (idx)", "px", extra=f"{_HIST.replace(' WHERE a > 0', '')}, {_splits()}, {_CELL_LUT}"))

# --- the flagship -------------------------------------------------------------------------------


@query(
    "flagship",
    sql("SELECT yy, count(*) AS n FROM (SELECT ((19595 * r + 38470 * g + 7471 * b + 32768) >> 24) AS yy FROM (SELECT " + ", ".join(f"CAST(CASE WHEN here THEN {_over(_S, c, 65535)} ELSE {c} END AS BIGINT) AS {c}" for c in "rgb") + " FROM j)) GROUP BY yy ORDER BY n DESC, yy LIMIT 10", "can", "dst", extra=_JOINED.format(dst="dst", src="can")),
)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Orders over customers, as gray, the ten most frequent levels."""
    drawn = _drawing("over", False)(spark, d)
    (level,) = color.to_gray("r", "g", "b", "a")
    return drawn.groupBy(level.alias("yy")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "yy").limit(10)
