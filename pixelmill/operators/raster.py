"""Pixel relations: grids, lookups, updates, crops and set tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..functions.color import num
from ..functions.geometry import Box, Rect

KEYS = ["image_id", "x", "y"]


def new_image(spark: SparkSession, box: Rect, channels: tuple[str, ...], image_id: int = 0, fill: int = 0) -> DataFrame:
    """A grid of one value: one range of width x height rows, split over the cluster."""
    wide, high = max(0, box.x1 - box.x0), max(0, box.y1 - box.y0)
    i = F.col("id")
    x, y = (i % max(wide, 1)) + box.x0, F.floor(i / max(wide, 1)) + box.y0
    return spark.range(wide * high).select(num(image_id).alias("image_id"), num(x).alias("x"), num(y).alias("y"), *(num(fill).alias(c) for c in channels))


def at(image: DataFrame, points: DataFrame, default: dict[str, int]) -> DataFrame:
    """The pixel at each point (image_id, x, y), ``default`` where there is none."""
    found = points.join(image, KEYS, "left")
    return found.select(*points.columns, *(F.coalesce(num(c), num(v)).alias(c) for c, v in default.items()))


def put(image: DataFrame, points: DataFrame, channels: list[str]) -> DataFrame:
    """The image with pixels set to those of ``points``; points outside it do nothing. Points must be unique."""
    new = points.select(*KEYS, *(F.col(c).alias(f"new_{c}") for c in channels), F.lit(True).alias("new_here"))
    out = image.join(new, KEYS, "left")
    return out.select(*[F.when(F.col("new_here"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in channels else F.col(c) for c in image.columns])


def crop(image: DataFrame, box: Rect) -> DataFrame:
    """The pixels inside ``box``, at their own places."""
    return image.where(box.holds("x", "y"))


def opaque(image: DataFrame, alpha: str = "a", by: str = "image_id") -> DataFrame:
    """Whether all pixels of each image are opaque."""
    return image.groupBy(by).agg(F.coalesce(F.bool_and(F.col(alpha) == 255), F.lit(True)).alias("opaque"))


def canonical(image: DataFrame, model: str, channels: tuple[str, ...]) -> DataFrame:
    """(image_id, x, y, r, g, b, a) in the canonical form."""
    values = color.expand(model, *channels)
    return image.select(*KEYS, *(v.alias(n) for v, n in zip(values, "rgba")))


def convert(image: DataFrame, model: str) -> DataFrame:
    """A canonical image in the channels of ``model``."""
    return image.select(*KEYS, *color.convert(model, "r", "g", "b", "a"))


def bounds(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The smallest rectangle that holds all non-empty ones of each group."""
    box = Box.named()
    return boxes.where(~box.empty).groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


#: Rectangles of up to 2 ** LEAST pixels a side share the finest grid.
LEAST = 4


def _level(prefix: str = "") -> Column:
    """The finest grid (cells of 2 ** level) in which a rectangle lies in at most two cells a side."""
    side = F.greatest(F.col(prefix + "x1") - F.col(prefix + "x0"), F.col(prefix + "y1") - F.col(prefix + "y0"))
    return F.greatest(F.ceil(F.log2(side.cast("double"))), num(LEAST)).cast("int")


def _levels(boxes: DataFrame, prefix: str = "") -> list[int]:
    """The levels in use, some sixty at most."""
    return sorted(r[0] for r in boxes.select(_level(prefix)).distinct().collect())


def _cell(c: str, level: str) -> Column:
    return F.floor(F.col(c) / F.expr(f"shiftleft(1L, {level})"))


def _dealt(boxes: DataFrame, prefix: str, level: str) -> DataFrame:
    """A row for each cell of the grid ``level`` that a rectangle touches."""
    for c in "xy":
        low, high = F.col(f"{prefix}{c}0"), F.col(f"{prefix}{c}1") - 1
        side = F.expr(f"shiftleft(1L, {level})")
        boxes = boxes.withColumn(f"{prefix}c{c}", F.explode(F.sequence(F.floor(low / side), F.floor(high / side))))
    return boxes


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points with each rectangle that holds them: an equi-join on the cells of grids by size, then the exact test.

    A rectangle is dealt to at most four cells of the grid of its size; a point looks into one
    cell of each grid in use.
    """
    boxes = boxes.where(~Box.named().empty).withColumn("level", _level())
    levels = _levels(boxes)
    tiled = _dealt(boxes, "", "level").withColumnsRenamed({"cx": "box_cx", "cy": "box_cy", "level": "box_level"})
    placed = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("cx", _cell("x", "level")).withColumn("cy", _cell("y", "level"))
    met = placed.join(tiled, (F.col("level") == F.col("box_level")) & (F.col("cx") == F.col("box_cx")) & (F.col("cy") == F.col("box_cy")))
    return met.where(Box.named().holds("x", "y")).drop("cx", "cy", "level", "box_cx", "box_cy", "box_level")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of overlapping rectangles (columns l_*, r_*).

    A pair meets in the grid of the larger one's size, where either is dealt to at most four
    cells, and is kept in the one cell that holds the low corner of its intersection, so no
    distinct is needed.  Rectangles of one size meet only their own and larger ones.
    """

    def sides(df: DataFrame, prefix: str) -> DataFrame:
        df = df.select(*(F.col(c).alias(prefix + c) for c in df.columns))
        return df.where(~Box.named(prefix).empty).withColumn(prefix + "level", _level(prefix))

    def raised(df: DataFrame, prefix: str, levels: list[int], least: str) -> DataFrame:
        """Each rectangle in the grids ``levels`` from its own on (least: ``>=``) or above it (``>``)."""
        at = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda n: n >= F.col(prefix + "level") if least == ">=" else n > F.col(prefix + "level"))
        return df.withColumn(prefix + "grid", F.explode(at))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = _dealt(a, "l_", "l_grid"), _dealt(b, "r_", "r_grid")
        both = a.join(b, (F.col("l_grid") == F.col("r_grid")) & (F.col("l_cx") == F.col("r_cx")) & (F.col("l_cy") == F.col("r_cy"))).where(Box.named("l_").overlaps(Box.named("r_")))
        side = F.expr("shiftleft(1L, l_grid)")
        corner = (F.floor(F.greatest("l_x0", "r_x0") / side) == F.col("l_cx")) & (F.floor(F.greatest("l_y0", "r_y0") / side) == F.col("l_cy"))
        return both.where(corner).drop("l_cx", "l_cy", "r_cx", "r_cy", "l_grid", "r_grid", "l_level", "r_level")

    a, b = sides(left, "l_"), sides(right, "r_")
    mine, theirs = _levels(left.where(~Box.named().empty)), _levels(right.where(~Box.named().empty))
    out = met(a.withColumn("l_grid", F.col("l_level")), raised(b, "r_", mine, ">="))
    if not mine or not theirs or theirs[-1] <= mine[0]:  # none on the right is larger than one on the left
        return out
    return out.unionByName(met(raised(a, "l_", theirs, ">"), b.withColumn("r_grid", F.col("r_level"))))


def union_images(images: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, images)
