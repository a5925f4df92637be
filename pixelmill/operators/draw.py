"""Compositing as joins on coordinates.

The clip rectangle is worked out first and filters both sides before the join; the source and the
mask are shifted to the destination's coordinates, so that the join is an equi-join on
(image_id, x, y) without a copy of either image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..functions.color import FULL, div, num
from ..functions.geometry import RATIOS, Rect
from .raster import KEYS

RGBA = ("r", "g", "b", "a")
#: Bounds of an image of one colour.
ANYWHERE = Rect(-1_000_000, -1_000_000, 1_000_000, 1_000_000)


def clip(r: Rect, dst: Rect, src: Rect, sp: tuple[int, int], mask: Rect | None = None, mp: tuple[int, int] = (0, 0)) -> Rect:
    """Where is drawn: r within the destination, the source moved from ``sp`` and the mask moved from ``mp`` to r's corner.

    Each step takes the corner of what the step before left; sp and mp themselves don't move.
    """
    r = r.meet(dst)
    r = r.meet(src.shift(r.x0 - sp[0], r.y0 - sp[1]))
    return r if mask is None else r.meet(mask.shift(r.x0 - mp[0], r.y0 - mp[1]))


def over16(s: tuple, d: tuple) -> list[Column]:
    """Source over destination on canonical channels."""
    sa, da = num(s[3]), num(d[3])
    return [F.when((da == 0) | (sa == FULL), num(x)).when(sa == 0, num(y)).otherwise(num(x) + div(num(y) * (FULL - sa), FULL)) for x, y in zip(s, d)]


def over8(s: tuple, d: tuple) -> list[Column]:
    """Source over destination on premultiplied 8-bit channels; it truncates on its own scale, unlike :func:`over16`."""
    sa = num(s[3])
    return [F.when(sa == 255, num(x)).when(sa == 0, num(y)).otherwise(num(x) + div(num(y) * (255 - sa), 255)) for x, y in zip(s, d)]


def masked(c: tuple, alpha) -> list[Column]:
    """Canonical channels dimmed by a mask's alpha."""
    return [div(num(x) * num(alpha), FULL) for x in c]


def _moved(image: DataFrame, r: Rect, origin: tuple[int, int], prefix: str, channels) -> DataFrame:
    """The part of ``image`` that falls on r if ``origin`` falls on r's corner."""
    dx, dy = r.x0 - origin[0], r.y0 - origin[1]
    part = image.where(r.shift(-dx, -dy).holds("x", "y"))
    return part.select("image_id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), *(num(c).alias(prefix + c) for c in channels), F.lit(True).alias(prefix + "here"))


def draw(dst: DataFrame, dst_box: Rect, r: Rect, src: DataFrame, src_box: Rect, sp: tuple[int, int] = (0, 0), op: str = "over", mask: DataFrame | None = None, mask_box: Rect | None = None, mp: tuple[int, int] = (0, 0), eight_bit: bool = False) -> DataFrame:
    """``dst`` with ``src`` drawn on r, through the alpha of ``mask`` if given.

    Channels r, g, b, a are canonical; with ``eight_bit`` they are premultiplied bytes and over
    truncates on that scale (no mask).  op: ``over`` or ``src``.  Reads are of the images before.
    """
    if op not in ("over", "src"):
        raise ValueError(f"no such operator: {op}")
    r = clip(r, dst_box, src_box, sp, mask_box if mask is not None else None, mp)
    if r.empty:
        return dst
    s, d = tuple(f"s_{c}" for c in RGBA), RGBA
    # outside the source's own pixels a colour of nothing is drawn
    joined = dst.join(_moved(src, r, sp, "s_", RGBA), KEYS, "left")
    s = tuple(F.coalesce(num(c), num(0)) for c in s)
    if mask is None:
        drawn = list(s) if op == "src" else (over8 if eight_bit else over16)(s, d)
    else:
        joined = joined.join(_moved(mask, r, mp, "m_", ("a",)), KEYS, "left")
        m = F.coalesce(num("m_a"), num(0))
        dim = masked(s, m)
        if op == "over":
            drawn = [F.when(m == 0, num(c)).when(m == FULL, full).otherwise(part) for c, full, part in zip(d, over16(s, d), over16(tuple(dim), d))]
        else:
            drawn = [F.when(m == 0, num(0)).when(m == FULL, full).otherwise(part) for full, part in zip(s, dim)]
    inside = r.holds("x", "y")
    return joined.select(*[F.when(inside, drawn[RGBA.index(c)]).otherwise(num(c)).alias(c) if c in RGBA else F.col(c) for c in dst.columns])


def fill(dst: DataFrame, dst_box: Rect, r: Rect, colour: tuple[int, int, int, int]) -> DataFrame:
    """``dst`` with one colour on r: no join, a projection."""
    inside = r.meet(dst_box).holds("x", "y") & F.lit(not r.meet(dst_box).empty)
    return dst.select(*[F.when(inside, num(colour[RGBA.index(c)])).otherwise(num(c)).alias(c) if c in RGBA else F.col(c) for c in dst.columns])


def draw_uniform(dst: DataFrame, dst_box: Rect, r: Rect, colour: tuple[int, int, int, int], op: str = "over", eight_bit: bool = False) -> DataFrame:
    """``dst`` with one canonical colour drawn on r."""
    if op == "src":
        return fill(dst, dst_box, r, colour)
    box = r.meet(dst_box)
    drawn = (over8 if eight_bit else over16)(colour, RGBA)
    inside = box.holds("x", "y") & F.lit(not box.empty)
    return dst.select(*[F.when(inside, drawn[RGBA.index(c)]).otherwise(num(c)).alias(c) if c in RGBA else F.col(c) for c in dst.columns])


def upsampled(luma: DataFrame, chroma: DataFrame, ratio: str) -> DataFrame:
    """(image_id, x, y, yy, cb, cr): each pixel with the chroma sample that covers it; an equi-join on the sample's place."""
    h, v = RATIOS[ratio]
    samples = chroma.select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "cb", "cr")
    placed = luma.withColumn("cx", F.floor(F.col("x") / h)).withColumn("cy", F.floor(F.col("y") / v))
    return placed.join(samples, ["image_id", "cx", "cy"]).select(*KEYS, "yy", "cb", "cr")


def draw_ycbcr(dst: DataFrame, dst_box: Rect, r: Rect, luma: DataFrame, chroma: DataFrame, src_box: Rect, ratio: str, sp: tuple[int, int] = (0, 0)) -> DataFrame | None:
    """``dst`` (premultiplied bytes) with planes drawn on r; None for ratios without such a path (411, 410)."""
    if ratio not in ("444", "422", "420", "440"):
        return None
    red, green, blue = color.ycbcr_to_rgb("yy", "cb", "cr")
    src = upsampled(luma, chroma, ratio).select(*KEYS, red.alias("r"), green.alias("g"), blue.alias("b"), num(255).alias("a"))
    return draw(dst, dst_box, r, src, src_box, sp, "src")
