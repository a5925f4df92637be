"""Encoded images as tables: sniffing, headers, pixels, container parts; and back to bytes.

Files are rows (image_id, content); with ``top`` too if an image may be in several files, its pages
(see :mod:`.bands`), which readers here put together.  Decoding emits pixels in batches of rows, so that memory holds
one image and one batch; a bad file gives an error row, an exception or nothing, as ``mode`` says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bands
from .codecs import bmp, gif, jpeg, png
from .codecs.base import FormatError, Raster, UnsupportedError
from .registry import canonical, sniff, sniffed

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
PIXELS = "image_id long, frame_no int, format string, model string, x long, y long, c1 long, c2 long, c3 long, c4 long, r long, g long, b long, a long, truncated boolean, error string"
#: Pixels in a batch.
BATCH = 1 << 18


def _failures(data: bytes | None, mode: str, work):
    """Rows of ``work(data)``, or what ``mode`` makes of a bad file: (rows, error)."""
    try:
        if data is None:
            raise FormatError("image: no content")
        yield from ((row, None) for row in work(data))
    except (FormatError, UnsupportedError, ValueError, IndexError, KeyError, OverflowError, MemoryError) as e:
        if mode == "FAILFAST":
            raise
        if mode == "PERMISSIVE":
            yield None, f"{type(e).__name__}: {e}"


def _pixel_batches(top_row: int, fmt: str, no: int, image: Raster) -> Iterator[pa.RecordBatch]:
    step = max(1, BATCH // max(1, image.width))
    if image.model == "paletted" and image.pixels.size:
        image.palette[image.pixels.max()]  # an index outside the palette is an error before the first batch
    k = image.pixels.shape[2]
    for top in range(0, image.height, step):
        part = image.pixels[top : top + step]
        rows = canonical(replace(image, pixels=part)).reshape(-1, 4)
        n = len(rows)
        y, x = np.divmod(np.arange(n), image.width)
        raw = part.reshape(n, k)
        own = [pa.array(raw[:, i].astype(np.int64)) if i < k else pa.nulls(n, pa.int64()) for i in range(4)]
        columns = [pa.nulls(n, pa.int64()), pa.array(np.full(n, no, np.int32)), pa.array([fmt] * n), pa.array([image.model] * n), pa.array(x + image.x0), pa.array(y + top + image.y0 + top_row), *own, *(pa.array(rows[:, i]) for i in range(4)), pa.array(np.full(n, image.truncated)), pa.nulls(n, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=_names())


def _names() -> list[str]:
    return [c.split()[0] for c in PIXELS.split(", ")]


def _error(image_id, text: str) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 10, pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([image_id if i == 0 else text if i == 15 else None], t) for i, t in enumerate(kinds)], names=_names())


def decode(files: DataFrame, mode: str = "PERMISSIVE", max_frames: int | None = 1, verify_checksums: bool = False, with_path: bool = False) -> DataFrame:
    """Pixels of all files: own channels c1.. of the model and canonical r, g, b, a (and the files' path).

    The first ``max_frames`` frames (None: all) are read.  A null content and a file of no known
    format are bad files; an image without pixels gives no row.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")

    paged = "top" in files.columns

    def work(data: bytes, top: int):
        f = sniffed(data)
        if f.name == "gif":
            frames = gif.frames(data, max_frames)
        elif f.name == "png":
            frames = iter([png.decode(data, verify_checksums)])
        else:
            frames = f.frames(data)
        found = list(frames)
        if not found:
            raise FormatError(f"{f.name}: no image")
        for no, image in enumerate(found):
            for b in _pixel_batches(top, f.name, no, image):
                yield b

    def rows(batches):
        for b in batches:
            paths = b.column("path").to_pylist() if with_path else [None] * b.num_rows
            tops = b.column("top").to_pylist() if paged else [0] * b.num_rows
            for key, content, path, top in zip(b.column(0).to_pylist(), b.column(1), paths, tops):
                for made, error in _failures(content.as_py(), mode, lambda data, top=top: work(data, top)):
                    made = _error(key, error) if error else made
                    n = made.num_rows
                    extra = [pa.array([path] * n, pa.string())] if with_path else []
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), *made.columns[1:], *extra], names=_names() + ["path"] * with_path)

    return files.select(F.col("image_id").cast("long"), "content", *["path"] * with_path, *["top"] * paged).mapInArrow(rows, PIXELS + ", path string" * with_path)


def parts(files: DataFrame, verify: bool = False) -> DataFrame:
    """Container parts: (image_id, part, kind, place, length, checksum_ok, error) of PNG chunks, JPEG segments, GIF frames; of each page with its ``top``."""
    paged = "top" in files.columns

    def work(data: bytes):
        name = sniffed(data).name
        if name == "png":
            for kind, at, body, _, right in png.chunks(data, verify):
                yield kind, at, len(body), right
        elif name == "jpeg":
            for marker, at, body in jpeg.segments(data):
                yield f"{marker:02X}", at, len(body), None
        elif name == "gif":
            for i, f in enumerate(gif.frames(data)):
                yield "frame", i, f.width * f.height, None
        else:
            c = bmp.config(data)
            yield "image", 0, c.width * c.height, None

    def rows(batches):
        for b in batches:
            out = []
            for key, content, *top in zip(b.column(0).to_pylist(), b.column(1), *[b.column(2).to_pylist() for _ in range(paged)]):
                out += [(key, i, *(row or (None,) * 4), error, *top) for i, (row, error) in enumerate(_failures(content.as_py(), "PERMISSIVE", work))]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), *[pa.int64()] * paged]
            names = ["image_id", "part", "kind", "place", "length", "checksum_ok", "error", *["top"] * paged]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return files.select(F.col("image_id").cast("long"), "content", *["top"] * paged).mapInArrow(rows, "image_id long, part int, kind string, place long, length long, checksum_ok boolean, error string" + ", top long" * paged)


def palettes(files: DataFrame) -> DataFrame:
    """(image_id, idx, r, g, b, a): the palette of each paletted file's first image; pages of an image with the same one count once."""

    def rows(batches):
        for b in batches:
            out = []
            for key, content in zip(b.column(0).to_pylist(), b.column(1)):
                for image, _ in _failures(content.as_py(), "DROPMALFORMED", lambda d: sniffed(d).frames(d)):
                    if image.palette is not None:
                        out += [(key, i, *map(int, c)) for i, c in enumerate(image.palette)]
                    break
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], names=["image_id", "idx", "r", "g", "b", "a"])

    found = files.select(F.col("image_id").cast("long"), "content").mapInArrow(rows, "image_id long, idx long, r long, g long, b long, a long")
    return found.distinct() if "top" in files.columns else found


# --- headers by expressions ---------------------------------------------------------------------


def little(content: Column, at: int, n: int) -> Column:
    """An unsigned little-endian number of ``n`` bytes at a place from 0."""
    return F.conv(F.concat(*(F.hex(F.substring(content, at + 1 + k, 1)) for k in range(n - 1, -1, -1))), 16, 10).cast("long")


def big(content: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, n)), 16, 10).cast("long")


def _signed(v: Column) -> Column:
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def configs(files: DataFrame) -> DataFrame:
    """(image_id, format, color_model, width, height) from headers alone.

    BMP, PNG and GIF headers are at fixed places and read by expressions; a JPEG's frame header has
    to be looked for, by a function that stops there.  Heights of an image's pages are added.
    """

    @F.pandas_udf("struct<model: string, width: long, height: long>")
    def jpeg_config(contents):
        import pandas as pd

        out = []
        for c in contents:
            try:
                got = jpeg.config(bytes(c)) if c is not None else None
                out.append((got.model, got.width, got.height) if got else (None, None, None))
            except (FormatError, UnsupportedError):
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["model", "width", "height"]).astype({"width": "Int64", "height": "Int64"})

    c = F.col("content")
    named = files.select("image_id", "content", sniff(c).alias("format"))
    depth, kind, bits = little(c, 28, 2), big(c, 25, 1), big(c, 24, 1)
    bmp_model = F.when(depth <= 8, "paletted").when(depth == 24, "rgba").when(depth == 32, "nrgba")
    png_model = F.when(kind == 3, "paletted").when(bits == 16, F.when(kind == 0, "gray16").when(kind == 2, "rgba64").otherwise("nrgba64")).when(kind == 0, "gray").when(kind.isin(2, 6), "rgba").when(kind == 4, "nrgba")
    fixed = named.where("format != 'jpeg' or format is null")
    is_ = lambda f: F.col("format") == f
    fixed = fixed.select(
        "image_id",
        "format",
        F.when(is_("bmp"), bmp_model).when(is_("png"), png_model).when(is_("gif"), "paletted").alias("color_model"),
        F.when(is_("bmp"), _signed(little(c, 18, 4))).when(is_("png"), big(c, 16, 4)).when(is_("gif"), little(c, 6, 2)).alias("width"),
        F.when(is_("bmp"), F.abs(_signed(little(c, 22, 4)))).when(is_("png"), big(c, 20, 4)).when(is_("gif"), little(c, 8, 2)).alias("height"),
    )
    found = named.where(is_("jpeg")).withColumn("h", jpeg_config("content"))
    out = fixed.unionByName(found.select("image_id", "format", F.col("h.model").alias("color_model"), "h.width", "h.height"))
    return out.groupBy("image_id", "format", "color_model", "width").agg(F.sum("height").alias("height")) if "top" in files.columns else out


# --- sinks --------------------------------------------------------------------------------------


def encode(pixels: DataFrame, fmt: str, model: str, channels: list[str], palette: np.ndarray | None = None, quality: int = 75, compress: bool = True) -> DataFrame:
    """(image_id, content, top): each image of a pixel table as a file; its rows may come in any order, missing pixels are 0.

    A gif or jpeg of over 65535 rows isn't possible: such an image becomes pages, each with its first row as ``top``.

    gif, png and bmp are coded in bands of rows, each in a task of its own.  A jpeg's blocks are
    coded one after the other, so its rows meet in one task.  gif takes paletted pixels
    with ``palette`` (n, 3 or 4 bytes); without ``compress`` its codes are made in one pass.
    """
    if fmt in ("gif", "png", "bmp"):
        return bands.encode(pixels, fmt, model, channels, palette, compress)
    if fmt != "jpeg":
        raise ValueError(f"no such format: {fmt}")

    limit = bands.limits(fmt)

    def write(table: pa.Table) -> pa.Table:
        samples = bands.assembled(table, len(channels), model)[2]
        return bands.files(table["image_id"][0].as_py(), [(a, jpeg.encode(Raster(model, samples[a:b], palette), quality)) for a, b in bands.cut(len(samples), limit)])

    return bands.gathered(pixels, channels, model).groupBy("image_id").applyInArrow(write, bands.FILES)


def encode_gif(indexed: DataFrame, palettes_by_image: DataFrame) -> DataFrame:
    """(image_id, content, top): GIFs of (image_id, x, y, idx), each with its palette (image_id, idx, r, g, b)."""
    limit = bands.limits("gif")

    def write(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return bands.files(None, [])
        order = np.argsort(right["idx"].to_numpy())
        table = np.column_stack([right[c].to_numpy()[order] for c in "rgb"])
        return bands.files_of(left, "gif", "paletted", 1, table, True, limit)

    own = bands.coded(bands.runs(indexed, ["idx"], "paletted"), "gif", "paletted", 1)
    return own.groupBy("image_id").cogroup(palettes_by_image.groupBy("image_id")).applyInArrow(write, bands.FILES)


#: File endings: format and options, as the command line of an image converter would choose.
ENDINGS = {"bmp": ("bmp", {}), "jpg": ("jpeg", {"quality": 90}), "jpeg": ("jpeg", {"quality": 90}), "png": ("png", {}), "gif": ("gif", {})}


def format_of(path: str) -> tuple[str, dict]:
    end = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if end not in ENDINGS:
        raise ValueError(f"unsupported ending: {path}")
    return ENDINGS[end]
