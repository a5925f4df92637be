"""Block and prediction steps of the codecs as relations, where they are not sequential."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import clamp, num
from ..sources.codecs import jpeg
from .raster import KEYS


def tiles(image: DataFrame, width: int, height: int, channels: list[str], side: int = 8) -> DataFrame:
    """(image_id, bx, by, u, v, channels): blocks with the last row and column repeated outwards.

    A pixel makes its own entry; only those of the last column and row make more.
    """
    wide, high = -(-width // side) * side, -(-height // side) * side
    reach = lambda c, last, end: F.when(F.col(c) == last, F.sequence(num(last), num(end - 1))).otherwise(F.array(num(c)))
    full = image.withColumn("px", F.explode(reach("x", width - 1, wide))).withColumn("py", F.explode(reach("y", height - 1, high)))
    return full.select("image_id", F.floor(F.col("px") / side).alias("bx"), F.floor(F.col("py") / side).alias("by"), (F.col("px") % side).alias("u"), (F.col("py") % side).alias("v"), *(num(c).alias(c) for c in channels))


def halved(image: DataFrame, channel: str) -> DataFrame:
    """Means of 2 x 2 pixels, halves rounded up; pixels outside count as 0."""
    places = [F.floor(F.col(c) / 2).alias(c) for c in ("x", "y")]
    return image.groupBy("image_id", *places).agg(F.shiftright(F.sum(num(channel)) + 2, 2).alias(channel))


def zigzag(spark: SparkSession) -> DataFrame:
    """(z, place): the 64 coefficients' places in the order of the zig-zag."""
    return spark.createDataFrame([(i, int(p)) for i, p in enumerate(jpeg.ZIGZAG)], "z long, place long")


def quant_tables(spark: SparkSession, quality: int) -> DataFrame:
    """(tab, z, q): both example tables scaled for a quality between 1 and 100."""
    rows = [(t, z, int(v)) for t, text in enumerate(jpeg.QUANT) for z, v in enumerate(text.split())]
    q = min(max(quality, 1), 100)
    scale = F.lit(5000 // q if q < 50 else 200 - 2 * q)
    scaled = F.floor((F.col("base") * scale + 50) / 100)
    return spark.createDataFrame(rows, "tab long, z long, base long").select("tab", "z", clamp(scaled, 1, 255).alias("q"))


def rounded(value, step) -> Column:
    """value / step to the nearest integer, halves away from 0."""
    v, s = num(value), num(step)
    half = F.floor((F.abs(v) * 2 + s) / (s * 2))
    return F.when(v < 0, -half).otherwise(half).cast("long")


def dequantised(coefficients: DataFrame, table: DataFrame) -> DataFrame:
    """(block, z, c) times the table's steps, at their places: two joins with 64 rows."""
    spark = coefficients.sparkSession
    steps = table.select("z", "q").join(zigzag(spark), "z")
    return coefficients.join(F.broadcast(steps), "z").select("block", "place", (num("c") * F.col("q")).alias("c"))


def differences(values: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Each value less the one before it, the first less 0."""
    before = F.lag(num(value), 1, 0).over(Window.partitionBy(by).orderBy(order))
    return values.select(by, order, (num(value) - before).alias("diff"))


def undone_differences(values: DataFrame, by: str, order: str, diff: str = "diff") -> DataFrame:
    """The opposite of :func:`differences`: running sums."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return values.select(by, order, F.sum(num(diff)).over(upto).alias("value"))


def predicted(image: DataFrame, channel: str, kind: str) -> DataFrame:
    """(image_id, x, y, d): a byte less its left (``sub``) or upper (``up``) neighbour, mod 256."""
    along, across = ("x", "y") if kind == "sub" else ("y", "x")
    before = F.lag(num(channel), 1, 0).over(Window.partitionBy("image_id", across).orderBy(along))
    return image.select(*KEYS, F.pmod(num(channel) - before, num(256)).alias("d"))


def unpredicted(deltas: DataFrame, kind: str) -> DataFrame:
    """(image_id, x, y, v): running sums mod 256 along rows (``sub``) or columns (``up``)."""
    along, across = ("x", "y") if kind == "sub" else ("y", "x")
    upto = Window.partitionBy("image_id", across).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select(*KEYS, (F.sum("d").over(upto) % 256).alias("v"))


def _transformed(blocks: pd.Series, work) -> pd.Series:
    if not len(blocks):
        return pd.Series([], dtype=object)
    x = np.array([np.asarray(b, np.int64) for b in blocks]).reshape(-1, 8, 8)
    return pd.Series(list(work(x).astype(np.int64).reshape(-1, 64)))


def transform(blocks: DataFrame, column: str, direction: str) -> DataFrame:
    """``column`` (64 integers, rows of a block) through the integer cosine transform.

    ``forward``: samples from 0 to 255 to eight times the coefficients; ``inverse``: coefficients
    to samples less 128.
    """
    work = jpeg.forward if direction == "forward" else jpeg.inverse

    @F.pandas_udf("array<long>")
    def run(values: pd.Series) -> pd.Series:
        return _transformed(values, work)

    return blocks.withColumn(column, run(column))


def gathered(tiled: DataFrame, channel: str) -> DataFrame:
    """(image_id, bx, by, block): tiles as arrays of 64 numbers."""
    cells = F.array_sort(F.collect_list(F.struct((F.col("v") * 8 + F.col("u")).alias("i"), num(channel).alias("c"))))
    return tiled.groupBy("image_id", "bx", "by").agg(F.transform(cells, lambda s: s["c"]).alias("block"))
