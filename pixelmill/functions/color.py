"""Colour models as column expressions on BIGINT channels.

Every model expands to the canonical form: 16-bit channels, premultiplied by alpha.  All
divisions truncate; all operands are non-negative unless a formula says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..weights import CB_BLUE, CB_GREEN, CR_GREEN, CR_RED, LUMA, TO_CB, TO_CR

FULL = 65535
Channels = tuple[Column, ...]


def num(x) -> Column:
    """A column of BIGINT of a name, a number or a column."""
    if isinstance(x, int):
        return F.lit(x).cast("long")
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def div(a, b) -> Column:
    """Integer division that truncates; null where the divisor is 0."""
    a, b = num(a), num(b)
    return F.when(b != 0, F.call_function("div", a, b))


def clamp(v: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(v, num(low)), num(high))


def wide(c) -> Column:
    """An 8-bit channel on the 16-bit scale."""
    return num(c) * 257


def _weighted(weights, channels, plus: int) -> Column:
    return sum((w * num(c) for w, c in zip(weights, channels)), num(plus))


# --- expansion to canonical 16-bit premultiplied RGBA -------------------------------------------


def from_rgba(r, g, b, a) -> Channels:
    return wide(r), wide(g), wide(b), wide(a)


def from_rgba64(r, g, b, a) -> Channels:
    return num(r), num(g), num(b), num(a)


def from_nrgba(r, g, b, a) -> Channels:
    return *(div(wide(c) * num(a), 255) for c in (r, g, b)), wide(a)


def from_nrgba64(r, g, b, a) -> Channels:
    return *(div(num(c) * num(a), FULL) for c in (r, g, b)), num(a)


def from_alpha(a) -> Channels:
    return (wide(a),) * 4


def from_alpha16(a) -> Channels:
    return (num(a),) * 4


def from_gray(y) -> Channels:
    return wide(y), wide(y), wide(y), num(FULL)


def from_gray16(y) -> Channels:
    return num(y), num(y), num(y), num(FULL)


def _from_ycc(y, cb, cr, shift: int, high: int) -> Channels:
    luma, blue, red = num(y) * 0x10101, num(cb) - 128, num(cr) - 128
    mixed = (luma + CR_RED * red, luma - CB_GREEN * blue - CR_GREEN * red, luma + CB_BLUE * blue)
    return tuple(clamp(F.shiftright(v, shift), 0, high) for v in mixed)


def from_ycbcr(y, cb, cr) -> Channels:
    return *_from_ycc(y, cb, cr, 8, FULL), num(FULL)


def from_nycbcra(y, cb, cr, a) -> Channels:
    return *(div(c * wide(a), FULL) for c in _from_ycc(y, cb, cr, 8, FULL)), wide(a)


def from_cmyk(c, m, y, k) -> Channels:
    white = FULL - wide(k)
    return *(div((FULL - wide(ink)) * white, FULL) for ink in (c, m, y)), num(FULL)


EXPANSIONS: dict[str, tuple[int, Callable[..., Channels]]] = {
    "rgba": (4, from_rgba),
    "rgba64": (4, from_rgba64),
    "nrgba": (4, from_nrgba),
    "nrgba64": (4, from_nrgba64),
    "alpha": (1, from_alpha),
    "alpha16": (1, from_alpha16),
    "gray": (1, from_gray),
    "gray16": (1, from_gray16),
    "ycbcr": (3, from_ycbcr),
    "nycbcra": (4, from_nycbcra),
    "cmyk": (4, from_cmyk),
}


def expand(model: str, *channels) -> Channels:
    """Canonical channels of a colour of ``model``."""
    count, builder = EXPANSIONS[model]
    if len(channels) != count:
        raise ValueError(f"{model} has {count} channels")
    return builder(*channels)


# --- conversion of canonical channels to a model -----------------------------------------------


def to_rgba(r, g, b, a) -> Channels:
    return tuple(F.shiftright(num(c), 8) for c in (r, g, b, a))


def to_rgba64(r, g, b, a) -> Channels:
    return num(r), num(g), num(b), num(a)


def _straight(r, g, b, a, shift: int) -> Channels:
    alpha = num(a)
    over = lambda c: F.when(alpha == 0, num(0)).otherwise(F.shiftright(F.when(alpha == FULL, num(c)).otherwise(div(num(c) * FULL, alpha)), shift))
    return over(r), over(g), over(b), F.shiftright(alpha, shift)


def to_nrgba(r, g, b, a) -> Channels:
    return _straight(r, g, b, a, 8)


def to_nrgba64(r, g, b, a) -> Channels:
    return _straight(r, g, b, a, 0)


def to_alpha(r, g, b, a) -> Channels:
    return (F.shiftright(num(a), 8),)


def to_alpha16(r, g, b, a) -> Channels:
    return (num(a),)


def to_gray(r, g, b, a) -> Channels:
    return (F.shiftright(_weighted(LUMA, (r, g, b), 1 << 15), 24),)


def to_gray16(r, g, b, a) -> Channels:
    return (F.shiftright(_weighted(LUMA, (r, g, b), 1 << 15), 16),)


def rgb_to_ycbcr(r, g, b) -> Channels:
    """8-bit RGB to Y'CbCr."""
    luma = F.shiftright(_weighted(LUMA, (r, g, b), 1 << 15), 16)
    return luma, *(clamp(F.shiftright(_weighted(w, (r, g, b), 257 << 15), 16), 0, 255) for w in (TO_CB, TO_CR))


def ycbcr_to_rgb(y, cb, cr) -> Channels:
    """Y'CbCr to 8-bit RGB."""
    return _from_ycc(y, cb, cr, 16, 255)


def rgb_to_cmyk(r, g, b) -> Channels:
    """8-bit RGB to CMYK; black has no ink but K."""
    white = F.greatest(num(r), num(g), num(b))
    ink = lambda c: F.when(white == 0, num(0)).otherwise(div((white - num(c)) * 255, white))
    return ink(r), ink(g), ink(b), 255 - white


def cmyk_to_rgb(c, m, y, k) -> Channels:
    """CMYK to 8-bit RGB."""
    return tuple(F.shiftright(v, 8) for v in from_cmyk(c, m, y, k)[:3])


def to_ycbcr(r, g, b, a) -> Channels:
    return rgb_to_ycbcr(*to_rgba(r, g, b, a)[:3])


def to_nycbcra(r, g, b, a) -> Channels:
    """Y'CbCr of the straight colour, and alpha."""
    red, green, blue, alpha = to_nrgba(r, g, b, a)
    return *rgb_to_ycbcr(red, green, blue), alpha


def to_cmyk(r, g, b, a) -> Channels:
    return rgb_to_cmyk(*to_rgba(r, g, b, a)[:3])


CONVERSIONS: dict[str, tuple[tuple[str, ...], Callable[..., Channels]]] = {
    "rgba": (("r", "g", "b", "a"), to_rgba),
    "rgba64": (("r", "g", "b", "a"), to_rgba64),
    "nrgba": (("r", "g", "b", "a"), to_nrgba),
    "nrgba64": (("r", "g", "b", "a"), to_nrgba64),
    "alpha": (("a",), to_alpha),
    "alpha16": (("a",), to_alpha16),
    "gray": (("luma",), to_gray),
    "gray16": (("luma",), to_gray16),
    "ycbcr": (("luma", "cb", "cr"), to_ycbcr),
    "nycbcra": (("luma", "cb", "cr", "a"), to_nycbcra),
    "cmyk": (("cyan", "magenta", "yellow", "key"), to_cmyk),
}


def register_model(name: str, channels: tuple[str, ...], builder: Callable[..., Channels]) -> None:
    """Add a user's colour model: ``builder`` maps canonical channels to the model's."""
    CONVERSIONS[name] = (tuple(channels), builder)


def convert(model: str, r, g, b, a, prefix: str = "") -> list[Column]:
    """The channels of ``model``, named, of canonical channels."""
    names, builder = CONVERSIONS[model]
    return [c.alias(prefix + n) for n, c in zip(names, builder(r, g, b, a))]


def sq_diff(x, y) -> Column:
    """A quarter of the squared difference of two 16-bit channels."""
    d = num(x) - num(y)
    return F.shiftright(d * d, 2)
