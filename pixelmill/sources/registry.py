"""Known formats in the order in which they are tried."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..weights import CB_BLUE, CB_GREEN, CR_GREEN, CR_RED
from .codecs import bmp, gif, jpeg, png
from .codecs.base import Config, FormatError, Raster


@dataclass(frozen=True)
class Format:
    name: str
    #: First bytes; ``?`` stands for any byte.
    magic: bytes
    frames: Callable[[bytes], Iterator[Raster]]
    config: Callable[[bytes], Config]


FORMATS: list[Format] = []


def register(name: str, magic: bytes, frames: Callable[[bytes], Iterator[Raster]], config: Callable[[bytes], Config]) -> None:
    FORMATS.append(Format(name, magic, frames, config))


def _one(decode: Callable[[bytes], Raster]) -> Callable[[bytes], Iterator[Raster]]:
    def frames(data: bytes) -> Iterator[Raster]:
        yield decode(data)

    return frames


register("bmp", bmp.MAGIC, _one(bmp.decode), bmp.config)
register("png", png.MAGIC, _one(png.decode), png.config)
for _magic in gif.MAGICS:
    register("gif", _magic, gif.frames, gif.config)
register("jpeg", b"\xff\xd8", _one(jpeg.decode), jpeg.config)


def matches(magic: bytes, data: bytes) -> bool:
    return len(data) >= len(magic) and all(m == 63 or m == d for m, d in zip(magic, data))


def sniffed(data: bytes) -> Format:
    for f in FORMATS:
        if matches(f.magic, data):
            return f
    raise FormatError("image: unknown format")


def magic_column(magic: bytes, content: Column) -> Column:
    """Whether binary content starts with ``magic``: equality of each stretch between wildcards."""
    test, at = F.octet_length(content) >= len(magic), 0
    for part in magic.split(b"?"):
        if part:
            test = test & (F.substring(content, at + 1, len(part)) == F.lit(part))
        at += len(part) + 1
    return test


def sniff(content: Column) -> Column:
    """The format's name, or null: comparisons only, so that other bytes needn't be read."""
    out = F.lit(None).cast("string")
    for f in reversed(FORMATS):
        out = F.when(magic_column(f.magic, content), F.lit(f.name)).otherwise(out)
    return out


def canonical(image: Raster) -> np.ndarray:
    """(height, width, 4) canonical channels."""
    p = image.pixels.astype(np.int64)
    full = np.full(p.shape[:2], 65535)
    if image.model == "paletted":
        return image.palette[p[:, :, 0]] * 257
    if image.model in ("rgba", "rgba64"):
        return p * (257 if image.model == "rgba" else 1)
    if image.model == "nrgba":
        return np.dstack((p[:, :, :3] * 257 * p[:, :, 3:] // 255, p[:, :, 3] * 257))
    if image.model == "nrgba64":
        return np.dstack((p[:, :, :3] * p[:, :, 3:] // 65535, p[:, :, 3]))
    if image.model in ("gray", "gray16"):
        y = p[:, :, 0] * (257 if image.model == "gray" else 1)
        return np.dstack((y, y, y, full))
    if image.model == "ycbcr":
        luma, blue, red = p[:, :, 0] * 0x10101, p[:, :, 1] - 128, p[:, :, 2] - 128
        mixed = (luma + CR_RED * red, luma - CB_GREEN * blue - CR_GREEN * red, luma + CB_BLUE * blue)
        return np.dstack([*(np.clip(v >> 8, 0, 65535) for v in mixed), full])
    if image.model == "cmyk":
        return np.dstack(((65535 - p[:, :, :3] * 257) * (65535 - p[:, :, 3:] * 257) // 65535, full))
    raise FormatError(f"image: no colours of {image.model}")
