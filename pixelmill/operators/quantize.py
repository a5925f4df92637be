"""Colour quantisation by splitting boxes of a 5-bit histogram at the best cut.

Histogram, moments' running sums and single cut searches are DataFrame operations.  The whole
split is a chain of up to 255 dependent steps on at most 32768 bins an image: the bins (not the
pixels) of each image go to one grouped function, and images are the unit of parallelism.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import FULL, div, num

SIDE = 32


def surface(image: DataFrame, premultiplied: bool) -> DataFrame:
    """Bytes to bin: those of the image as they are, or a canonical image's without its alpha."""
    if not premultiplied:
        a = num("a")
        straight = lambda c: F.shiftright(F.least(F.when(a < FULL, div(num(c) * FULL, a)).otherwise(num(c)), num(FULL)), 8)
        image = image.where(F.col("a") > 0).select("image_id", *(straight(c).alias(c) for c in "rgb"), F.shiftright(a, 8).alias("a"))
    return image.where(F.col("a") > 0)


def histogram(image: DataFrame, premultiplied: bool = True) -> DataFrame:
    """(image_id, br, bg, bb, w, mr, mg, mb): pixels and channel sums of each occupied bin."""
    bins = [F.shiftright(num(c), 3).alias(f"b{c}") for c in "rgb"]
    return surface(image, premultiplied).groupBy("image_id", *bins).agg(F.count("*").alias("w"), *(F.sum(num(c)).alias(f"m{c}") for c in "rgb"))


def running_sums(hist: DataFrame) -> DataFrame:
    """Moments of all bins up to each bin along all three axes, on the dense 32 x 32 x 32 grid of each image."""
    spark, n = hist.sparkSession, num(SIDE)
    i = F.col("id")
    grid = spark.range(SIDE**3).select(F.floor(i / n / n).alias("br"), (F.floor(i / n) % n).alias("bg"), (i % n).alias("bb"))
    full = hist.select("image_id").distinct().join(grid).join(hist, ["image_id", "br", "bg", "bb"], "left").fillna(0, ["w", "mr", "mg", "mb"])
    for axis, rest in (("bb", ("br", "bg")), ("bg", ("br", "bb")), ("br", ("bg", "bb"))):
        upto = Window.partitionBy("image_id", *rest).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
        full = full.select("image_id", "br", "bg", "bb", *(F.sum(c).over(upto).alias(c) for c in ("w", "mr", "mg", "mb")))
    return full


def volume(hist: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Moments of the bins from low to high, both included, of each image."""
    inside = F.lit(True)
    for axis, a, b in zip(("br", "bg", "bb"), low, high):
        inside = inside & F.col(axis).between(a, b)
    return hist.where(inside).groupBy("image_id").agg(*(F.sum(c).alias(c) for c in ("w", "mr", "mg", "mb")))


def cut_scores(hist: DataFrame, axis: str) -> DataFrame:
    """(image_id, cut, score): for each cut along ``axis`` with pixels on both sides, the sum of moment**2 / weight, as float."""
    sums = hist.groupBy("image_id", F.col(axis).alias("cut")).agg(*(F.sum(c).alias(c) for c in ("w", "mr", "mg", "mb")))
    upto = Window.partitionBy("image_id").orderBy("cut")
    whole = Window.partitionBy("image_id")
    parts = sums.select("image_id", "cut", *(F.sum(c).over(upto).alias(f"{c}_low") for c in ("w", "mr", "mg", "mb")), *(F.sum(c).over(whole).alias(f"{c}_all") for c in ("w", "mr", "mg", "mb")))
    side = lambda of: sum((of(c).cast("double") * of(c).cast("double") for c in ("mr", "mg", "mb")), F.lit(0.0)) / of("w")
    low, high = side(lambda c: F.col(f"{c}_low")), side(lambda c: F.col(f"{c}_all") - F.col(f"{c}_low"))
    return parts.where("w_low > 0 and w_low < w_all").select("image_id", "cut", (low + high).cast("float").alias("score"))


class Splitter:
    """Box splitting on dense moments; boxes are slices of the grid."""

    def __init__(self, bins: np.ndarray, moments: np.ndarray):
        grid = np.zeros((4, SIDE, SIDE, SIDE), np.int64)
        grid[:, bins[0], bins[1], bins[2]] = moments
        self.grid = grid

    def best(self, box: tuple) -> tuple[float, int, int]:
        """(score, axis, last bin of the lower part) of the best cut, (0, -1, -1) if there is none."""
        found = (np.float32(0), -1, -1)
        part = self.grid[(slice(None), *(slice(a, b + 1) for a, b in box))]
        for axis in range(3):
            others = tuple(k + 1 for k in range(3) if k != axis)
            low = np.cumsum(part.sum(axis=others), axis=1)[:, :-1]
            high = part.sum(axis=(1, 2, 3))[:, None] - low
            ok = (low[0] > 0) & (high[0] > 0)
            if not ok.any():
                continue
            low, high = low[:, ok].astype(np.float64), high[:, ok].astype(np.float64)
            score = ((low[1:] ** 2).sum(axis=0) / low[0] + (high[1:] ** 2).sum(axis=0) / high[0]).astype(np.float32)
            k = int(np.argmax(score))
            if score[k] > found[0]:
                found = (score[k], axis, box[axis][0] + int(np.flatnonzero(ok)[k]))
        return found

    def boxes(self, colours: int) -> list[tuple]:
        """The boxes in the order they were made; ends early when no box can be cut."""
        boxes = [((0, SIDE - 1),) * 3]
        cuts = [self.best(boxes[0])]
        while len(boxes) < colours:
            k = max(range(len(boxes)), key=lambda i: (cuts[i][0], -i))
            _, axis, at = cuts[k]
            if axis < 0:
                break
            a, b = boxes[k][axis]
            side = lambda new: tuple(new if j == axis else r for j, r in enumerate(boxes[k]))  # noqa: E731, B023
            boxes[k], new = side((a, at)), side((at + 1, b))
            boxes.append(new)
            cuts[k], cuts_new = self.best(boxes[k]), self.best(new)
            cuts.append(cuts_new)
        return boxes

    def centroid(self, box: tuple) -> tuple[int, int, int] | None:
        w, r, g, b = (int(v) for v in self.grid[(slice(None), *(slice(a, z + 1) for a, z in box))].sum(axis=(1, 2, 3)))
        return (r // w, g // w, b // w) if w else None


def _splitter(table: pa.Table) -> Splitter:
    columns = lambda names: np.stack([table[c].to_numpy() for c in names])
    return Splitter(columns(("br", "bg", "bb")), columns(("w", "mr", "mg", "mb")))


def palettes(hist: DataFrame, colours: int = 256) -> DataFrame:
    """(image_id, idx, r, g, b, a): ``colours`` (2 to 256) entries an image, filled up with black.

    Where an image has too few occupied bins for so many boxes, the split ends there.
    """
    colours = min(max(colours, 2), 256)

    def split(table: pa.Table) -> pa.Table:
        s = _splitter(table)
        rows = [c for c in map(s.centroid, s.boxes(colours)) if c]
        rows += [(0, 0, 0)] * (colours - len(rows))
        r, g, b = (pa.array(v, pa.int64()) for v in zip(*rows))
        return pa.table({"image_id": pa.array([table["image_id"][0].as_py()] * colours, pa.int64()), "idx": pa.array(range(colours), pa.int64()), "r": r, "g": g, "b": b, "a": pa.array([255] * colours, pa.int64())})

    return hist.groupBy("image_id").applyInArrow(split, "image_id long, idx long, r long, g long, b long, a long")


def tags(hist: DataFrame, colours: int = 256) -> DataFrame:
    """(image_id, br, bg, bb, tag): the box that each occupied bin is in."""

    def split(table: pa.Table) -> pa.Table:
        s, tag = _splitter(table), np.zeros((SIDE,) * 3, np.int64)
        for i, box in enumerate(s.boxes(colours)):
            tag[tuple(slice(a, b + 1) for a, b in box)] = i
        bins = [table[c].to_numpy() for c in ("br", "bg", "bb")]
        return pa.table({"image_id": table["image_id"], "br": bins[0], "bg": bins[1], "bb": bins[2], "tag": tag[tuple(bins)]})

    return hist.groupBy("image_id").applyInArrow(split, "image_id long, br long, bg long, bb long, tag long")


def mapped(image: DataFrame, tagged: DataFrame) -> DataFrame:
    """(image_id, x, y, tag) of a byte image: a join on the bin."""
    placed = image.select("image_id", "x", "y", *(F.shiftright(num(c), 3).alias(f"b{c}") for c in "rgb"))
    return placed.join(tagged, ["image_id", "br", "bg", "bb"]).select("image_id", "x", "y", "tag")
