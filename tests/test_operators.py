"""Operators on small rasters: laws, quirks and edge cases that the SQL oracles don't show."""

import random

import numpy as np


import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelmill.functions.geometry import Rect
from pixelmill.operators import draw, palette, quantize, raster
from pixelmill.sources import datasource, images
from pixelmill.sources.codecs import png
from pixelmill.sources.codecs.base import Raster
from pixelmill.streaming import decode as streaming

INTS = st.integers(-20, 20)
RECTS = st.builds(Rect.of, INTS, INTS, INTS, INTS)


def image(spark, pixels, image_id=0):
    """A frame of {(x, y): (r, g, b, a)}."""
    return spark.createDataFrame([(image_id, x, y, *c) for (x, y), c in pixels.items()], "image_id long, x long, y long, r long, g long, b long, a long")


def pixels(df):
    return {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in df.collect()}


@settings(max_examples=100, deadline=None)
@given(RECTS, RECTS)
def test_rectangles(a, b):
    both = a.meet(b)
    points = {(x, y) for x in range(a.x0, a.x1) for y in range(a.y0, a.y1)} & {(x, y) for x in range(b.x0, b.x1) for y in range(b.y0, b.y1)}
    assert {(x, y) for x in range(both.x0, both.x1) for y in range(both.y0, both.y1)} == points
    assert both == b.meet(a)


def test_empty_grid(spark):
    assert raster.new_image(spark, Rect(), ("r",)).count() == 0


def test_drawing_keeps_offsets_when_clipped(spark):
    """sp does not move with a clipped r: the clipped corner shows the source's sp."""
    dst = image(spark, {(x, 0): (0, 0, 0, 65535) for x in range(4)})
    src = image(spark, {(x, 0): (x + 1, 0, 0, 65535) for x in range(4)})
    got = pixels(draw.draw(dst, Rect(0, 0, 4, 1), Rect(-2, 0, 2, 1), src, Rect(0, 0, 4, 1), (1, 0), "src"))
    assert [got[x, 0][0] for x in range(4)] == [2, 3, 0, 0]


def test_two_scales_of_over(spark):
    dst, src = image(spark, {(0, 0): (200, 200, 200, 255)}), image(spark, {(0, 0): (10, 10, 10, 100)})
    box = Rect(0, 0, 1, 1)
    eight = pixels(draw.draw(dst, box, box, src, box, eight_bit=True))[0, 0]
    assert eight == (10 + 200 * 155 // 255,) * 3 + (100 + 255 * 155 // 255,)
    assert draw.draw(dst, box, Rect(5, 5, 6, 6), src, box) is dst
    with pytest.raises(ValueError):
        draw.draw(dst, box, box, src, box, op="xor")


def test_drawing_onto_itself_reads_the_old_image(spark):
    row = image(spark, {(x, 0): (x, 0, 0, 65535) for x in range(5)})
    box = Rect(0, 0, 5, 1)
    got = pixels(draw.draw(row, box, Rect(1, 0, 5, 1), row, box, (0, 0), "src"))
    assert [got[x, 0][0] for x in range(5)] == [0, 0, 1, 2, 3]


def test_no_such_path_for_some_ratios(spark):
    row = image(spark, {(0, 0): (0, 0, 0, 255)})
    assert draw.draw_ycbcr(row, Rect(0, 0, 1, 1), Rect(0, 0, 1, 1), row, row, Rect(0, 0, 1, 1), "411") is None


def test_table_may_move_exact_colours(spark):
    """The 5:5:5 table answers for a cell, not for a colour, and ignores alpha."""
    entries = spark.createDataFrame([(0, 8, 8, 8, 255), (1, 11, 11, 11, 255)], "idx long, r long, g long, b long, a long")
    dots = image(spark, {(0, 0): (11 * 257, 11 * 257, 11 * 257, 65535), (1, 0): (8 * 257,) * 3 + (0,)})
    assert {r["x"]: r["idx"] for r in palette.indexed(dots, entries).collect()} == {0: 0, 1: 0}
    assert {r["x"]: r["idx"] for r in palette.nearest(dots, entries, ["x"]).collect()} == {0: 1, 1: 0}
    with pytest.raises(ValueError):
        palette.nearest(dots, spark.range(257).selectExpr("id idx", "id r", "id g", "id b", "255 a"), ["x"])


@pytest.mark.parametrize("colours", [1, 2, 5, 300])
def test_few_colours_do_not_break_the_split(spark, colours):
    solid = image(spark, {(x, 0): (40, 50, 60, 255) for x in range(9)})
    got = quantize.palettes(quantize.histogram(solid), colours).orderBy("idx").collect()
    assert len(got) == min(max(colours, 2), 256)
    assert (got[0]["r"], got[0]["g"], got[0]["b"]) == (40, 50, 60)
    assert all((r["r"], r["g"], r["b"], r["a"]) == (0, 0, 0, 255) for r in got[1:])


def test_split_against_plain_search(spark):
    rng = np.random.default_rng(1)
    dots = {(i, 0): (*map(int, rng.integers(0, 256, 3)), 255) for i in range(400)}
    got = [(r["r"], r["g"], r["b"]) for r in quantize.palettes(quantize.histogram(image(spark, dots)), 8).orderBy("idx").collect()]
    groups = [(list(dots.values()), ((0, 31),) * 3)]

    def score(members):
        return sum(sum(m[k] for m in members) ** 2 for k in range(3)) / len(members)

    while len(groups) < 8:
        best = (np.float32(0), None)
        for i, (members, box) in enumerate(groups):
            for axis in range(3):
                for at in range(box[axis][0], box[axis][1]):
                    low, high = [m for m in members if m[axis] >> 3 <= at], [m for m in members if m[axis] >> 3 > at]
                    if low and high and np.float32(score(low) + score(high)) > best[0]:
                        best = (np.float32(score(low) + score(high)), (i, axis, at, low, high))
        i, axis, at, low, high = best[1]
        box = groups[i][1]
        groups[i] = (low, tuple((a, at) if k == axis else (a, b) for k, (a, b) in enumerate(box)))
        groups.append((high, tuple((at + 1, b) if k == axis else (a, b) for k, (a, b) in enumerate(box))))
    assert got == [tuple(sum(m[k] for m in members) // len(members) for k in range(3)) for members, _ in groups]


def files(spark, **content):
    return spark.createDataFrame([(int(k[1:]), None if v is None else bytearray(v)) for k, v in content.items()], "image_id long, content binary")


def test_bad_files(spark):
    good = png.encode(Raster("rgba", np.arange(16).reshape(2, 2, 4)))
    some = files(spark, f1=good, f2=b"rubbish", f3=None, f4=good[:40], f5=b"")
    got = images.decode(some).collect()
    assert {r["image_id"] for r in got if r["error"]} == {2, 3, 4, 5}
    assert sum(r["image_id"] == 1 for r in got) == 4
    assert images.decode(some, "DROPMALFORMED").count() == 4
    with pytest.raises(Exception, match="FormatError"):
        images.decode(some, "FAILFAST").collect()
    with pytest.raises(ValueError):
        images.decode(some, "LOUD")
    assert images.configs(some).where("format is null").count() == 3


def test_files_in_and_out(spark, tmp_path):
    dots = image(spark, {(x, y): (x, y, x + y, 255) for x in range(7) for y in range(5)}, 11)
    out = str(tmp_path / "out")
    datasource.write(dots, out, "png", "rgba", ["r", "g", "b", "a"])
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["11.png"]
    back = datasource.read(spark, out, pattern="*.png")
    assert {(r["x"], r["y"]): (r["c1"], r["c2"], r["c3"], r["c4"]) for r in back.collect()} == pixels(dots)
    query = streaming.stored(spark, out, str(tmp_path / "pixels"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "pixels")).count() == 35


def test_transcoding(spark):
    noise = np.dstack((np.random.default_rng(5).integers(0, 256, (12, 9, 3)), np.full((12, 9), 255)))
    source = files(spark, f7=png.encode(Raster("rgba", noise)), f8=b"rubbish")
    for ending, fmt in (("bmp", "bmp"), ("png", "png"), ("jpg", "jpeg"), ("gif", "gif")):
        got = images.decode(datasource.transcode(source, ending)).collect()
        assert {(r["image_id"], r["format"]) for r in got} == {(7, fmt)}
        if ending in ("bmp", "png"):
            assert all((r["c1"], r["c2"], r["c3"]) == tuple(noise[r["y"], r["x"], :3]) for r in got)
    with pytest.raises(ValueError):
        images.format_of("picture.tif")


def test_user_models(spark):
    from pixelmill.functions import color

    color.register_model("red", ("red",), lambda r, g, b, a: (color.num(r),))
    assert raster.convert(image(spark, {(0, 0): (5, 6, 7, 8)}), "red").columns == ["image_id", "x", "y", "red"]


def test_rectangle_joins_at_all_sizes(spark):
    """Boxes from a pixel to a million a side, empty ones and negative places, against plain loops; few rows are dealt."""
    rng = random.Random(5)
    boxes = []
    for i in range(120):
        x0, y0, side = rng.randrange(-300, 300), rng.randrange(-300, 300), rng.choice([0, 1, 5, 16, 17, 40, 200])
        boxes.append((i, x0, y0, x0 + rng.randrange(side + 1), y0 + side))
    boxes += [(200, -(10**6), -(10**6), 10**6, 10**6), (201, -7, -7, 10**6, -6), (202, 0, 0, 0, 5)]
    df = spark.createDataFrame(boxes, "id long, x0 long, y0 long, x1 long, y1 long")
    full = [b for b in boxes if b[1] < b[3] and b[2] < b[4]]
    meet = lambda a, b: max(a[1], b[1]) < min(a[3], b[3]) and max(a[2], b[2]) < min(a[4], b[4])
    some = df.where("id % 3 = 0 or id >= 200")
    got = sorted((r["l_id"], r["r_id"]) for r in raster.overlapping(df, some).collect())
    assert got == sorted((a[0], b[0]) for a in full for b in full if meet(a, b) and (b[0] % 3 == 0 or b[0] >= 200))
    assert raster.overlapping(df, df.where("id = 202")).count() == 0 == raster.overlapping(df.limit(0), df).count()
    points = [(0, rng.randrange(-320, 320), rng.randrange(-320, 320)) for _ in range(200)]
    placed = raster.in_boxes(spark.createDataFrame(points, "image_id long, x long, y long"), df)
    assert sorted((r["x"], r["y"], r["id"]) for r in placed.collect()) == sorted((x, y, b[0]) for _, x, y in points for b in full if b[1] <= x < b[3] and b[2] <= y < b[4])


def test_cells_of_many_images_stay_off_the_driver(spark):
    px = spark.range(20000).select((F.col("id") % 10).alias("image_id"), F.col("id").alias("x"), F.lit(0).cast("long").alias("y"), *((F.col("id") * k % 65536).alias(c) for c, k in zip("rgb", (7, 11, 13))), F.lit(65535).cast("long").alias("a"))
    table = spark.range(20).select(F.floor(F.col("id") / 2).alias("image_id"), (F.col("id") % 2).alias("idx"), *((F.col("id") % 2 * 255).alias(c) for c in "rgb"), F.lit(255).cast("long").alias("a"))
    out = palette.indexed_by_image(px, table)
    assert len(out.collect()) == 20000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan.split("Initial Plan")[0]
