"""Encoding an image in bands: runs of pixels are packed where they lie, bands of rows are coded in tasks of their own, one task joins their bytes.

Pixel rows don't cross an exchange one by one: a batch is sorted into runs of neighbours, and a
run is one row with its bytes.  A band's codes end on a byte and leave the coder in its first
state, so that bands can be joined: GIF codes by clear codes, deflate by a full flush.

GIF and JPEG headers have 16 bits for the height.  A higher image becomes several files, its pages,
each with the image row it starts at (``top``); readers of such files put them together again.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codecs import bmp, gif, png
from .codecs.base import Raster

#: Rows of an image in one band.
ROWS = 64
#: Rows a file can have, where its header bounds them, and rows of a page of a higher image: a multiple of every block's height.
MOST, PAGE = {"gif": 65535, "jpeg": 65535}, 1 << 14
FILES = "image_id long, content binary, top long"
RUNS = "image_id long, band long, y long, x long, n int, data binary"


def limits(fmt: str | None) -> tuple[int, int]:
    """(rows a file can have, rows of a page), for :func:`cut`."""
    return MOST.get(fmt, 1 << 62), PAGE


def cut(high: int, limit: tuple[int, int]) -> list[tuple[int, int]]:
    """First row and row after the last one of each file of an image."""
    most, page = limit
    return [(0, high)] if high <= most else [(a, min(a + page, high)) for a in range(0, high, page)]


def files(image_id, pages: list[tuple[int, bytes]]) -> pa.Table:
    """Rows of ``FILES`` from (top, file)."""
    return pa.table({"image_id": pa.array([image_id] * len(pages), pa.int64()), "content": pa.array([p for _, p in pages], pa.binary()), "top": pa.array([t for t, _ in pages], pa.int64())})


def sample_type(model: str) -> np.dtype:
    return np.dtype("<u2" if model in ("rgba64", "gray16") else np.uint8)


def runs(pixels: DataFrame, channels: list[str], model: str, rows: int | None = ROWS) -> DataFrame:
    """(image_id, band, y, x, n, data): ``n`` neighbours of a row and their samples; band 0 for all if ``rows`` is None."""
    kind = sample_type(model)

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            image, place, value = (b.column(i).to_numpy() for i in range(3))
            follows = (place[1:] == place[:-1] + 1) & (image[1:] == image[:-1])
            if 8 * np.count_nonzero(~follows) > len(place):  # not in the order of rows
                order = np.lexsort((place, image))
                image, place, value = image[order], place[order], value[order]
                follows = (place[1:] == place[:-1] + 1) & (image[1:] == image[:-1])
            samples = np.ascontiguousarray(value).view("<u2").reshape(-1, 4)[:, : len(channels)].astype(kind)
            heads = np.concatenate(([0], np.flatnonzero(~follows) + 1))
            size = samples.itemsize * len(channels)
            ends = np.concatenate((heads, [len(place)])).astype(np.int32) * size
            data = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(samples.tobytes())])
            x = ((place[heads] & 0xFFFFFFFF) ^ (1 << 31)) - (1 << 31)
            y = (place[heads] - x) >> 32
            band = y // rows if rows else np.zeros(len(heads), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(image[heads]), pa.array(band), pa.array(y), pa.array(x), pa.array((np.diff(ends) // size).astype(np.int32)), data], names=["image_id", "band", "y", "x", "n", "data"])

    # three numbers a pixel reach Python: 32 bits each of y and x, up to four samples of 16 bits
    place = F.shiftleft(F.col("y").cast("long"), 32) + F.col("x").cast("long")
    value = reduce(lambda u, v: u.bitwiseOR(v), (F.shiftleft(F.col(c).cast("long").bitwiseAND(F.lit(65535).cast("long")), 16 * i) for i, c in enumerate(channels)))
    return pixels.select(F.col("image_id").cast("long").alias("image_id"), place.alias("place"), value.alias("value")).mapInArrow(pack, RUNS)


def gathered(pixels: DataFrame, channels: list[str], model: str, rows: int = ROWS) -> DataFrame:
    """:func:`runs` with one run a row, for tasks that hold a whole image: pixels in no order would be runs of one pixel there.

    Bands are put together first, each in a task of its own; pixels that a band's smallest rectangle misses are 0.
    """

    def whole(table: pa.Table) -> pa.Table:
        x, y, samples = assembled(table, len(channels), model)
        (high, wide), image, band = samples.shape[:2], table["image_id"][0].as_py(), table["band"][0].as_py()
        ends = (np.arange(high + 1) * (wide * len(channels) * samples.itemsize)).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), high, [None, pa.py_buffer(ends), pa.py_buffer(samples.tobytes())])
        own = {"image_id": np.full(high, image), "band": np.full(high, band), "y": y + np.arange(high), "x": np.full(high, x)}
        return pa.table({**{k: pa.array(v, pa.int64()) for k, v in own.items()}, "n": pa.array(np.full(high, wide, np.int32)), "data": data})

    return runs(pixels, channels, model, rows).groupBy("image_id", "band").applyInArrow(whole, RUNS)


def assembled(table: pa.Table, channels: int, model: str) -> tuple[int, int, np.ndarray]:
    """(x, y, samples) of the smallest rectangle that holds the runs; pixels that are missing are 0."""
    x, y, n = (table[c].to_numpy().astype(np.int64) for c in ("x", "y", "n"))
    x0, y0, wide, high = int(x.min()), int(y.min()), int((x + n).max() - x.min()), int(y.max() - y.min()) + 1
    data = np.concatenate([np.frombuffer(c.buffers()[2], np.uint8)[c.buffers()[1] and _edge(c, 0) : _edge(c, len(c))] for c in table["data"].chunks if len(c)])
    samples = data.view(sample_type(model)).reshape(-1, channels)
    out = np.zeros((high * wide, channels), samples.dtype)
    starts, before = (y - y0) * wide + x - x0, np.cumsum(n) - n
    if len(n) == high and (n == wide).all() and (np.diff(starts) > 0).all():
        out = samples
    else:
        out[np.repeat(starts - before, n) + np.arange(int(n.sum()))] = samples
    return x0, y0, out.reshape(high, wide, channels)


def _edge(chunk: pa.Array, i: int) -> int:
    """Where value ``i`` of a binary array begins."""
    return int(np.frombuffer(chunk.buffers()[1], np.int32, 1, 4 * (chunk.offset + i))[0])


def _samples(fmt: str, raster: Raster) -> np.ndarray:
    """What the format stores of each pixel."""
    return raster.pixels[:, :, :1].astype(np.uint8) if fmt == "gif" else (png if fmt == "png" else bmp).samples(raster)


def _coded(fmt: str, stored: np.ndarray, compress: bool) -> tuple[bytes, int, int]:
    """(bytes, checksum, length before) of rows that can be joined with the next band's."""
    if fmt == "gif":
        return gif.band(stored.tobytes(), compress), 0, stored.size
    if fmt == "bmp":
        return stored.tobytes(), int(stored.shape[2] < 4 or (stored[:, :, 3] == 255).all()), stored.size
    rows = png.filtered(stored.reshape(len(stored), -1), 0, 4).astype(np.uint8).tobytes()
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    return deflate.compress(rows) + deflate.flush(zlib.Z_FULL_FLUSH), zlib.adler32(rows), len(rows)


def _opened(fmt: str, data: bytes, wide: int, high: int) -> np.ndarray:
    """The opposite of :func:`_coded`."""
    if fmt == "gif":
        return gif.band_values(data, wide * high).reshape(high, wide, 1)
    if fmt == "bmp":
        return np.frombuffer(data, np.uint8).reshape(high, wide, -1)
    return np.frombuffer(zlib.decompressobj(-15).decompress(data), np.uint8).reshape(high, 4 * wide + 1)[:, 1:].reshape(high, wide, 4)


def _file(fmt: str, model: str, wide: int, high: int, parts: list[tuple[bytes, int, int]], palette: np.ndarray | None) -> bytes:
    if fmt == "gif":
        return gif.file_of(wide, high, palette, [p for p, _, _ in parts])
    if fmt == "png":
        return png.file_of(wide, high, parts)
    return bmp.file_of(wide, high, model, [np.frombuffer(p, np.uint8).reshape(-1, wide, bmp.KEPT[model]) for p, _, _ in parts], all(o for _, o, _ in parts), palette)


BAND = "image_id long, y long, x long, wide long, high long, checksum long, size long, payload binary"


def coded(packed: DataFrame, fmt: str, model: str, channels: int, palette: np.ndarray | None = None, compress: bool = True) -> DataFrame:
    """Bands of :func:`runs` as the format's codes, each in a task of its own."""

    def code(table: pa.Table) -> pa.Table:
        x, y, samples = assembled(table, channels, model)
        payload, check, size = _coded(fmt, _samples(fmt, Raster(model, samples, palette)), compress)
        row = {"image_id": table["image_id"][0].as_py(), "y": y, "x": x, "wide": samples.shape[1], "high": samples.shape[0], "checksum": check, "size": size, "payload": payload}
        return pa.table({k: pa.array([v], pa.binary() if k == "payload" else pa.int64()) for k, v in row.items()})

    return packed.groupBy("image_id", "band").applyInArrow(code, BAND)


def files_of(bands: pa.Table, fmt: str, model: str, channels: int, palette: np.ndarray | None, compress: bool, limit: tuple[int, int]) -> pa.Table:
    """The file of all bands of an image, or its pages.

    Usually they have the same columns and no row is missing; else (a raster with holes at its
    edges) they are opened and coded again as one.
    """
    rows = sorted(bands.to_pylist(), key=lambda r: r["y"])
    wide, high = rows[0]["wide"], sum(r["high"] for r in rows)
    if all(r["x"] == rows[0]["x"] and r["wide"] == wide for r in rows) and all(a["y"] + a["high"] == b["y"] for a, b in zip(rows, rows[1:])):
        pages = _pages(rows, high, limit)
        if pages:
            return files(rows[0]["image_id"], [(p[0]["y"] - rows[0]["y"], _file(fmt, model, wide, sum(r["high"] for r in p), [(r["payload"], r["checksum"], r["size"]) for r in p], palette)) for p in pages])
    x0, y0 = min(r["x"] for r in rows), rows[0]["y"]
    wide, high = max(r["x"] + r["wide"] for r in rows) - x0, max(r["y"] + r["high"] for r in rows) - y0
    hole = _samples(fmt, Raster(model, np.zeros((1, 1, channels), sample_type(model)), palette))
    full = np.tile(hole, (high, wide, 1))
    for r in rows:
        full[r["y"] - y0 : r["y"] - y0 + r["high"], r["x"] - x0 : r["x"] - x0 + r["wide"]] = _opened(fmt, r["payload"], r["wide"], r["high"])
    return files(rows[0]["image_id"], [(a, _file(fmt, model, wide, b - a, [_coded(fmt, full[a:b], compress)], palette)) for a, b in cut(high, limit)])


def _pages(rows: list[dict], high: int, limit: tuple[int, int]) -> list[list[dict]]:
    """Bands by the page they go to; nothing if a band is too high for a page."""
    if high <= limit[0]:
        return [rows]
    if max(r["high"] for r in rows) > limit[1]:
        return []
    out, room = [], 0
    for r in rows:
        if r["high"] > room:
            out.append([])
            room = limit[1]
        out[-1].append(r)
        room -= r["high"]
    return out


def encode(pixels: DataFrame, fmt: str, model: str, channels: list[str], palette: np.ndarray | None = None, compress: bool = True, rows: int = ROWS) -> DataFrame:
    """(image_id, content, top): gif, png or bmp files; one task joins the bytes of an image's bands."""
    limit = limits(fmt)

    def join(table: pa.Table) -> pa.Table:
        return files_of(table, fmt, model, len(channels), palette, compress, limit)

    bands = coded(runs(pixels, channels, model, rows), fmt, model, len(channels), palette, compress)
    return bands.groupBy("image_id").applyInArrow(join, FILES)
