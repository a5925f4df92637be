"""Nearest palette colours: an exact search, and the 15-bit table that makes it a lookup."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import FULL, num
from .raster import KEYS

CELLS = 1 << 15


def closest(colours: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For rows of canonical channels the entry with the least squared distance, the first of equals."""
    out = np.empty(len(colours), np.int64)
    for at in range(0, len(colours), 4096):
        part = colours[at : at + 4096]
        total = np.zeros((len(part), len(entries)), np.int64)
        for k in range(4):
            gap = part[:, k, None] - entries[None, :, k]
            total += (gap * gap) >> 2
        out[at : at + 4096] = total.argmin(axis=1)
    return out


def nearest(colours: DataFrame, palette: DataFrame, keys: list[str]) -> DataFrame:
    """keys and idx: the palette entry with the least squared distance, the lowest index of equals.

    ``colours`` has canonical r, g, b, a; the palette (idx, r, g, b, a) bytes.  It has 256 entries
    at most, which is checked as it is read; distances are worked out in Arrow batches.
    """
    rows = palette.select("idx", *"rgba").orderBy("idx").limit(257).collect()
    if not 0 < len(rows) <= 256:
        raise ValueError("a palette has 1 to 256 entries")
    names, entries = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], np.int64) * 257

    @F.pandas_udf("long")
    def find(r: pd.Series, g: pd.Series, b: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series(names[closest(np.column_stack((r, g, b, a)), entries)])

    return colours.select(*keys, find(*(num(c) for c in "rgba")).alias("idx"))


def lookup_table(spark: SparkSession, palette: DataFrame) -> DataFrame:
    """(cell, idx): the nearest entry of each of the 32768 5:5:5 colours, all opaque."""
    level = lambda shift: F.shiftright(F.col("id"), shift).bitwiseAND(F.lit(31).cast("long"))
    spread = lambda v: v * 2048 + v * 64 + v * 2  # noqa: E731  five bits three times
    grid = spark.range(CELLS).select(F.col("id").alias("cell"), spread(level(10)).alias("r"), spread(level(5)).alias("g"), spread(level(0)).alias("b"), num(FULL).alias("a"))
    return nearest(grid, palette, ["cell"])


def cell_of(r, g, b):
    """The 5:5:5 cell of canonical channels."""
    return F.shiftright(num(r), 11) * 1024 + F.shiftright(num(g), 11) * 32 + F.shiftright(num(b), 11)


def indexed(image: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, x, y, idx) of a canonical image by the table: 32768 rows, broadcast, instead of a search per pixel."""
    table = lookup_table(image.sparkSession, palette)
    return image.withColumn("cell", cell_of("r", "g", "b")).join(F.broadcast(table), "cell").select(*KEYS, "idx")


def converted(image: DataFrame, palette: DataFrame) -> DataFrame:
    """Each pixel of a canonical image as its palette colour (bytes)."""
    entries = palette.select(num("idx").alias("idx"), *(num(c).alias(c) for c in "rgba"))
    return indexed(image, palette).join(F.broadcast(entries), "idx").select(*KEYS, "idx", "r", "g", "b", "a")


def cube_palette(spark: SparkSession) -> DataFrame:
    """256 entries: a 6 x 6 x 6 cube from light to dark, then 40 grays."""
    i = F.col("id")
    step = lambda n: 255 - F.floor(F.floor(i / n) % 6 * 255 / 5)
    gray = 255 - F.floor((i - 216) * 255 / 39)
    return spark.range(256).select(i.alias("idx"), *(num(F.when(i < 216, step(n)).otherwise(gray)).alias(c) for c, n in zip("rgb", (36, 6, 1))), num(255).alias("a"))


def indexed_by_image(image: DataFrame, palettes: DataFrame) -> DataFrame:
    """(image_id, x, y, idx) of canonical images with a palette each (image_id, idx, r, g, b, a).

    Only the cells that an image uses are searched, once each: at most 32768 an image.
    """
    placed = image.select(*KEYS, cell_of("r", "g", "b").alias("cell"))
    cells = placed.select("image_id", "cell").distinct()

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        cell, order = left["cell"].to_numpy(), np.argsort(right["idx"].to_numpy())
        levels = np.column_stack([(cell >> s & 31) * 2114 for s in (10, 5, 0)] + [np.full(len(cell), FULL)])  # five bits three times
        idx = np.empty(0, np.int64)
        if len(order) and len(cell):
            entries = np.column_stack([right[c].to_numpy()[order] for c in "rgba"]).astype(np.int64) * 257
            idx = right["idx"].to_numpy()[order][closest(levels, entries)]
        keep = left.slice(0, len(idx))
        return pa.table({"image_id": keep["image_id"], "cell": keep["cell"], "idx": pa.array(idx, pa.int64())})

    entries = palettes.select("image_id", num("idx").alias("idx"), *(num(c).alias(c) for c in "rgba"))
    table = cells.groupBy("image_id").cogroup(entries.groupBy("image_id")).applyInArrow(find, "image_id long, cell long, idx long")
    return placed.join(table.hint("merge"), ["image_id", "cell"]).select(*KEYS, "idx")  # the table grows with the images, so it never goes to the driver
