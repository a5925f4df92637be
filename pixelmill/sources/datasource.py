"""The ``raster`` data source: pixels of image files, read and written by path."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import images


def read(spark: SparkSession, path: str, mode: str = "PERMISSIVE", max_frames: int | None = 1, pattern: str = "*") -> DataFrame:
    """Pixels of the files under ``path`` with the file's path; Spark lists and reads the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return images.decode(files.select(F.xxhash64("path").alias("image_id"), "content", "path"), mode, max_frames, with_path=True)


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs ...) and the place in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class RasterWriter(DataSourceWriter):
    """Writes (name, content) rows as files, first under a hidden name, then in one move; both in the path's own file system."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        place, top = store(self.path)
        place.create_dir(top, recursive=True)
        done = []
        for row in iterator:
            hidden = f"{top}/.{uuid.uuid4().hex}"
            with place.open_output_stream(hidden) as f:
                f.write(bytes(row["content"]))
            done.append((hidden, f"{top}/{row['name']}"))
        return Moves(done)

    def commit(self, messages):
        place, _ = store(self.path)
        for m in messages:
            for hidden, name in m.moves if m else ():
                place.move(hidden, name)

    def abort(self, messages):
        place, _ = store(self.path)
        for m in messages:
            for hidden, _ in m.moves if m else ():
                if place.get_file_info(hidden).type != fs.FileType.NotFound:
                    place.delete_file(hidden)


class Moves(WriterCommitMessage):
    def __init__(self, moves):
        self.moves = moves


class RasterSink(DataSource):
    """``df.write.format("raster").mode("append").save(path)`` of (name, content).

    The path is a URI, or a folder that all nodes mount.
    """

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return RasterWriter(self.options["path"])


def install(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSink)


def write(pixels: DataFrame, path: str, ending: str, model: str, channels: list[str], palette: np.ndarray | None = None) -> None:
    """Each image of a pixel table as ``path``/<image_id>.<ending>; pages after an image's first one as <image_id>-<top>.<ending>."""
    fmt, options = images.format_of(f"x.{ending}")
    install(pixels.sparkSession)
    files = images.encode(pixels, fmt, model, channels, palette, **options)
    files.select(F.concat(F.col("image_id").cast("string"), F.when(F.col("top") > 0, F.concat(F.lit("-"), F.col("top"))).otherwise(""), F.lit(f".{ending}")).alias("name"), "content").write.format("raster").mode("append").save(path)


def transcode(files: DataFrame, ending: str) -> DataFrame:
    """(image_id, content, top) of other files in the format of ``ending``; bad files are left out.

    Pixels pass in canonical form; a GIF gets a palette of its own colours by quantisation.
    """
    from ..functions.color import num
    from ..operators import palette as palettes
    from ..operators import quantize

    fmt, options = images.format_of(f"x.{ending}")
    pixels = images.decode(files, "DROPMALFORMED")
    if fmt != "gif":
        model = "rgba64" if fmt in ("bmp", "jpeg") else "rgba"
        if model == "rgba":
            pixels = pixels.select("image_id", "x", "y", *(F.shiftright(num(c), 8).alias(c) for c in "rgba"))
        return images.encode(pixels, fmt, model, ["r", "g", "b", "a"], **options)
    own = quantize.palettes(quantize.histogram(pixels, premultiplied=False))
    return images.encode_gif(palettes.indexed_by_image(pixels, own), own)


__all__ = ["RasterSink", "install", "read", "transcode", "write"]
