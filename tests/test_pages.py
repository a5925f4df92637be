"""Images higher than a GIF or JPEG can be: files of several pages, read as one image."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.plans import codec_queries, jpeg_queries  # noqa: F401  each registers its queries
from pixelmill.plans.catalog import ORACLES, QUERIES
from pixelmill.sources import bands, datasource, images

GRAYS = np.array([[i, i, i] for i in range(256)])


def column(spark, high: int, wide: int = 2):
    n = F.col("id")
    return spark.range(high * wide, numPartitions=4).select(F.lit(7).cast("long").alias("image_id"), (n % wide).alias("x"), F.floor(n / wide).alias("y"), (n * 31 % 251).alias("g"))


@pytest.mark.parametrize("high", (65535, 65536, 70001))
@pytest.mark.parametrize("compress", (True, False))
def test_high_gif(spark, high, compress):
    px = column(spark, high)
    files = images.encode(px, "gif", "paletted", ["g"], GRAYS, compress=compress).persist()
    assert files.count() == (1 if high == 65535 else -(-high // bands.PAGE))
    got = images.decode(files).select("image_id", "x", "y", F.col("c1").alias("g"))
    assert got.exceptAll(px).count() == 0 and px.exceptAll(got).count() == 0
    (config,) = images.configs(files).collect()
    assert (config["width"], config["height"]) == (2, high)


def test_high_gif_with_holes(spark):
    px = column(spark, 70000).where("not (y between 100 and 20000 or (x = 0 and y > 69000))")
    got = images.decode(images.encode(px, "gif", "paletted", ["g"], GRAYS)).select("image_id", "x", "y", F.col("c1").alias("g"))
    assert got.count() == 140000
    assert px.exceptAll(got).count() == 0 and got.where("g > 0").exceptAll(px).count() == 0


def test_high_jpeg(spark):
    px = column(spark, 66000, 1).withColumn("g", F.floor(F.col("y") / 300))
    files = images.encode(px, "jpeg", "gray", ["g"], quality=100).persist()
    assert [r["top"] for r in files.orderBy("top").collect()] == [k * bands.PAGE for k in range(5)]
    got = images.decode(files).select("x", "y", "c1")
    assert got.count() == 66000
    assert got.join(px, ["x", "y"]).where("abs(c1 - g) <= 2").count() == 66000
    assert [(r["width"], r["height"]) for r in images.configs(files).collect()] == [(1, 66000)]


def test_rows_reach_one_task_whole(spark):
    """Pixels in no order are runs of one pixel; a task with the whole image gets one run a row instead."""
    px = column(spark, 200, 50).orderBy(F.xxhash64("x", "y"))
    got = bands.gathered(px, ["g"], "gray")
    assert got.count() == 200
    table = got.toArrow()
    assert set(table["n"].to_pylist()) == {50}
    assert (bands.assembled(table, 1, "gray")[2].ravel() == np.arange(10000) * 31 % 251).all()
    some = px.where("not (y between 70 and 80 or (x < 9 and y > 130))")
    sparse = bands.assembled(bands.gathered(some, ["g"], "gray").toArrow(), 1, "gray")
    plain = bands.assembled(bands.runs(some, ["g"], "gray", None).toArrow(), 1, "gray")
    assert sparse[:2] == plain[:2] and (sparse[2] == plain[2]).all()


def test_pages_have_names_of_their_own(spark, tmp_path):
    datasource.write(column(spark, 66000, 1), str(tmp_path / "out"), "gif", "paletted", ["g"], GRAYS)
    assert sorted(os.listdir(tmp_path / "out")) == sorted(["7.gif", *(f"7-{k * bands.PAGE}.gif" for k in range(1, 5))])


#: Queries whose files need pages once orders fill more than 65535 rows.
PAGED = [
    "snk10_gif_own_palette",
    "snk13_literal_codes",
    "src02_sniff",
    "src20_gif_first_frame",
    "src23_gif_extensions",
    "src30_jpeg_tables",
    "snk11_gif_given_palette",
    "src21_gif_all_frames",
    "src24_gif_frames",
    "src28_jpeg_segments",
    "snk12_gif_padding",
    "snk18_segments",
    "src05_configs",
    "src22_gif_header",
    "src26_jpeg_round_trip",
    "src38_jpeg_restarts",
    "src35_jpeg_refinement",
    "src26_jpeg_gray",
    "src33_jpeg_flex",
    "snk14_jpeg_quality",
    "src04_decode",
    "src33_jpeg_411",
    "src39_jpeg_rgb",
    "src29_jpeg_config",
    "src33_jpeg_422",
    "src36_jpeg_progressive",
    "src40_jpeg_cmyk",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.01/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", PAGED)
def test_query_in_pages(name, spark, duck, monkeypatch):
    """150 rows of pixels where a file can have 100, in pages of 32."""
    monkeypatch.setattr(bands, "MOST", {"gif": 100, "jpeg": 100})
    monkeypatch.setattr(bands, "PAGE", 32)
    got = QUERIES[name](spark, "/root/testdata/sf0.01")
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
