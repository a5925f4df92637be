"""BMP: 1, 2, 4, 8, 24 and 32 bits a pixel, uncompressed."""

from __future__ import annotations

import struct

import numpy as np

from .base import Config, FormatError, Raster, UnsupportedError, checked_size, pack_rows, packed_rows

MAGIC = b"BM????\0\0\0\0"
FILE_HEADER = 14
# Lengths of the headers that are read; channel masks that mean plain BGRA.
INFO, V4, V5 = 40, 108, 124
PLAIN_MASKS = (0xFF0000, 0xFF00, 0xFF, 0xFF000000)


def _header(data: bytes) -> dict:
    if len(data) < 2 or data[:2] != b"BM":
        raise FormatError("bmp: no BM")
    if len(data) < FILE_HEADER + 4:
        raise FormatError("bmp: unexpected end")
    offset, length = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if length not in (INFO, V4, V5):
        raise UnsupportedError("bmp: header length")
    if len(data) < FILE_HEADER + length:
        raise FormatError("bmp: unexpected end")
    width, height, planes, depth, compression = struct.unpack_from("<iiHHI", data, 18)
    if width < 0:
        raise UnsupportedError("bmp: negative width")
    if compression == 3 and length > INFO and struct.unpack_from("<4I", data, 54) == PLAIN_MASKS:
        compression = 0
    if planes != 1 or compression != 0 or depth not in (1, 2, 4, 8, 24, 32):
        raise UnsupportedError("bmp: planes, compression or depth")
    colours = 0
    if depth <= 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        if colours > 1 << depth:
            raise UnsupportedError("bmp: too many colours")
    if offset != FILE_HEADER + length + 4 * colours:
        raise UnsupportedError("bmp: offset")
    checked_size(width, abs(height), 4)
    return {"offset": offset, "length": length, "width": width, "height": abs(height), "top_down": height < 0, "depth": depth, "colours": colours}


def config(data: bytes) -> Config:
    h = _header(data)
    model = "paletted" if h["depth"] <= 8 else "rgba" if h["depth"] == 24 else "nrgba"
    return Config("bmp", model, h["width"], h["height"])


def decode(data: bytes) -> Raster:
    h = _header(data)
    w, n, depth = h["width"], h["height"], h["depth"]
    stride = (w * depth + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, offset=min(h["offset"], len(data)))
    if len(body) < stride * n:
        raise FormatError("bmp: unexpected end")
    rows = body[: stride * n].reshape(n, stride)
    if not h["top_down"]:
        rows = rows[::-1]
    if depth <= 8:
        start = FILE_HEADER + h["length"]
        table = np.frombuffer(data, np.uint8, 4 * h["colours"], start).reshape(-1, 4)
        palette = np.column_stack((table[:, 2], table[:, 1], table[:, 0], np.full(len(table), 255))).astype(np.int64)
        index = packed_rows(rows, w, depth).astype(np.int64)
        if index.size and index.max() >= len(palette):
            raise FormatError("bmp: invalid palette index")
        return Raster("paletted", index[:, :, None], palette)
    k = depth // 8
    bgr = rows[:, : w * k].reshape(n, w, k).astype(np.int64)
    if k == 3:
        return Raster("rgba", np.dstack((bgr[:, :, ::-1], np.full((n, w), 255))))
    alpha = bgr[:, :, 3] if h["length"] > INFO else np.full((n, w), 255)  # a short header has no alpha
    return Raster("nrgba", np.dstack((bgr[:, :, 2::-1], alpha)))


#: Bytes that are kept of a pixel until it is known whether all are opaque.
KEPT = {"gray": 1, "paletted": 1, "rgba": 4, "nrgba": 4, "rgba64": 3}


def samples(image: Raster) -> np.ndarray:
    """The index, or blue, green, red and straight alpha; of canonical channels (any other image) no alpha."""
    p = image.pixels
    if image.model not in KEPT:
        raise UnsupportedError(f"bmp: {image.model}")
    if KEPT[image.model] == 1:
        return p[:, :, :1].astype(np.uint8)
    if image.model == "rgba64":
        return (p[:, :, 2::-1] >> 8).astype(np.uint8)
    colour = p[:, :, :3]
    if image.model == "rgba" and not (p[:, :, 3] == 255).all():  # stored straight: 16-bit un-premultiply of bytes
        a = p[:, :, 3:].astype(np.int64) * 257
        colour = np.where(a > 0, (colour.astype(np.int64) * 257 * 65535 // np.maximum(a, 1)) >> 8, 0) & 255
    return np.dstack((colour[:, :, ::-1], p[:, :, 3:])).astype(np.uint8)


def file_of(w: int, h: int, model: str, parts: list[np.ndarray], opaque: bool, palette: np.ndarray | None) -> bytes:
    """8 bits for gray and paletted, 24 for opaque colours, 32 (straight) else; rows from the bottom, padded with zeros."""
    keep = KEPT[model] if KEPT[model] < 4 or not opaque else 3
    entries = np.zeros((256, 4), np.uint8)
    if model == "gray":
        entries[:, :3] = np.arange(256)[:, None]
    elif model == "paletted":
        entries[: len(palette), :3] = palette[:, 2::-1]
    table = entries.tobytes() if keep == 1 else b""
    stride = (w * keep * 8 + 31) // 32 * 4
    padded, at = np.zeros((h, stride), np.uint8), h
    for part in parts:
        n = len(part)
        padded[at - n : at, : w * keep] = part[::-1, :, :keep].reshape(n, -1)
        at -= n
    offset = FILE_HEADER + INFO + len(table)
    head = struct.pack("<2sIHHI", b"BM", offset + padded.size, 0, 0, offset)
    info = struct.pack("<IiiHHIIiiII", INFO, w, h, 1, 8 * keep, 0, padded.size, 0, 0, 256 if table else 0, 0)
    return head + info + table + padded.tobytes()


def encode(image: Raster) -> bytes:
    opaque = image.model in ("rgba", "nrgba") and bool((image.pixels[:, :, 3] == 255).all())
    return file_of(image.width, image.height, image.model, [samples(image)], opaque, image.palette)
