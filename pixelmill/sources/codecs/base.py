"""What decoders give and encoders take."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class FormatError(ValueError):
    """The bytes break the format's rules."""


class UnsupportedError(ValueError):
    """The bytes use a part of the format that isn't read."""


@dataclass
class Raster:
    """One image: channels of ``model`` as integers that hold them (height, width, n); paletted ones have the index as the only channel."""

    model: str
    pixels: np.ndarray
    palette: np.ndarray | None = None
    x0: int = 0
    y0: int = 0
    truncated: bool = False
    planes: dict = field(default_factory=dict)

    @property
    def height(self) -> int:
        return self.pixels.shape[0]

    @property
    def width(self) -> int:
        return self.pixels.shape[1]


@dataclass(frozen=True)
class Config:
    """What a header alone tells."""

    format: str
    model: str
    width: int
    height: int


MOST_PIXELS = (1 << 31) - 1


def checked_size(width: int, height: int, pixel_bytes: int = 1) -> None:
    if width < 0 or height < 0 or width * height * pixel_bytes > MOST_PIXELS:
        raise FormatError("huge or negative dimensions")


def packed_rows(data: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Rows of bytes to values of ``depth`` bits, high bits first."""
    if depth == 8:
        return data[:, :width]
    bits = np.unpackbits(data, axis=1).reshape(len(data), -1, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1)))[:, :width]


def pack_rows(values: np.ndarray, depth: int) -> np.ndarray:
    """The opposite of :func:`packed_rows`; rows end on a byte."""
    if depth == 8:
        return values.astype(np.uint8)
    bits = (values[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1
    return np.packbits(bits.reshape(len(values), -1).astype(np.uint8), axis=1)
