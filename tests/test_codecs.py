"""Kernels on hand-made bytes, and against the JVM's own image readers and writers."""

import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelmill.sources import registry
from pixelmill.sources import bands, images
from pixelmill.sources.codecs import bmp, gif, jpeg, png
from pixelmill.sources.codecs.base import FormatError, Raster, UnsupportedError

RNG = np.random.default_rng(3)
NOISE = RNG.integers(0, 256, (23, 31, 4))


def smooth(h=45, w=61):
    y, x = np.mgrid[:h, :w]
    return np.dstack((x * 3, y * 4, 255 - x - y, np.full((h, w), 255)))


def jvm_image(spark, data: bytes):
    """(height, width, 3) by the JVM's reader, or None."""
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    w, h = image.getWidth(), image.getHeight()
    flat = np.array([image.getRGB(x, y) & 0xFFFFFF for y in range(h) for x in range(w)])
    return np.dstack((flat >> 16, flat >> 8 & 255, flat & 255)).reshape(h, w, 3)


def jvm_jpeg(spark, pixels, progressive: bool) -> bytes:
    jvm = spark.sparkContext._jvm
    h, w, _ = pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, pixels[y, x, :3])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1 if progressive else 0)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.flush()
    return bytes(out.toByteArray())


def rgb(image: Raster):
    return np.dstack(jpeg.rgb_of(*(image.pixels[:, :, k] for k in range(3))))


def test_jpeg_is_read_by_others(spark):
    p = smooth()
    got = jvm_image(spark, jpeg.encode(Raster("rgba", p), 95))
    assert np.abs(got - p[:, :, :3]).max() <= 16
    gray = jvm_image(spark, jpeg.encode(Raster("gray", p[:, :, :1]), 95))
    assert gray.shape == got.shape


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg_of_others(spark, progressive):
    p = smooth()
    data = jvm_jpeg(spark, p, progressive)
    own = jpeg.decode(data)
    assert (b"\xff\xc2" in data) == progressive
    assert own.model == "ycbcr" and not own.truncated
    theirs = jvm_image(spark, data)
    # readers differ in how they spread chroma samples
    assert np.abs(rgb(own) - theirs).mean() < 3
    assert np.abs(rgb(own) - p[:, :, :3]).max() < 40


def test_other_formats_are_read_by_others(spark):
    assert (jvm_image(spark, png.encode(Raster("rgba", np.dstack((NOISE[:, :, :3], np.full((23, 31), 255)))))) == NOISE[:, :, :3]).all()
    assert (jvm_image(spark, bmp.encode(Raster("nrgba", np.dstack((NOISE[:, :, :3], np.full((23, 31), 255)))))) == NOISE[:, :, :3]).all()
    palette = RNG.integers(0, 256, (256, 3))
    assert (jvm_image(spark, gif.encode(NOISE[:, :, 0], palette)) == palette[NOISE[:, :, 0]]).all()


def test_gif_of_others(spark):
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(40, 30, 13)
    for y in range(30):
        for x in range(40):
            image.setRGB(x, y, -16777216 | (x * 6 // 51 * 51) << 16)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "gif", out)
    data = bytes(out.toByteArray())
    got = gif.decode(data)
    assert (got.palette[got.pixels[:, :, 0]][:, :, :3] == jvm_image(spark, data)).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(2, 8))
def test_lzw_round_trip(data, width):
    data = bytes(b % (1 << width) for b in data)
    assert gif.unlzw(gif.lzw(data, width), width, len(data)).tobytes() == data


@pytest.mark.parametrize("n", [4093, 4094, 4095, 20000, 70000])
def test_lzw_table_limits(n):
    noise = RNG.integers(0, 256, n).astype(np.uint8).tobytes()
    for data in (bytes(n), noise):
        assert gif.unlzw(gif.lzw(data, 8), 8, n).tobytes() == data


@pytest.mark.parametrize("n", [0, 1, 253, 254, 255, 508, 509, 5000])
def test_literal_codes(spark, n):
    noise = RNG.integers(0, 256, n).astype(np.uint8).tobytes()
    assert gif.unlzw(gif.literal(noise), 8, n).tobytes() == noise
    palette = RNG.integers(0, 256, (256, 3))
    data = gif.encode(NOISE[:, :, 0], palette, compress=False)
    assert (jvm_image(spark, data) == palette[NOISE[:, :, 0]]).all()


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("bpp", [1, 3, 4, 8])
def test_png_filters(kind, bpp):
    rows = RNG.integers(0, 256, (9, bpp * 7))
    assert (png.unfilter(png.filtered(rows, kind, bpp), bpp) == rows).all()


def test_png_errors():
    good = png.encode(Raster("rgba", NOISE))
    with pytest.raises(FormatError):
        png.decode(b"nothing")
    with pytest.raises(FormatError):
        png.decode(good[:50])
    broken = bytearray(good)
    broken[30] ^= 1  # the header's checksum
    assert (png.decode(bytes(broken)).pixels == NOISE).all()  # not verified unless asked
    with pytest.raises(FormatError):
        png.decode(bytes(broken), verify=True)
    laced = png.MAGIC + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 1)) + png.chunk(b"IDAT", zlib.compress(bytes(5))) + png.chunk(b"IEND", b"")
    with pytest.raises(UnsupportedError):
        png.decode(laced)


def test_bmp_errors_and_opacity():
    assert len(bmp.encode(Raster("rgba", np.dstack((NOISE[:, :, :3], np.full((23, 31), 255)))))) == 54 + 23 * 96
    data = bmp.encode(Raster("nrgba", NOISE))
    assert struct.unpack_from("<H", data, 28)[0] == 32
    assert (bmp.decode(data).pixels[:, :, 3] == 255).all()  # a 40-byte header has no alpha
    with pytest.raises(UnsupportedError):
        bmp.decode(data[:28] + struct.pack("<H", 16) + data[30:])
    with pytest.raises(FormatError):
        bmp.decode(data[:-1])
    entries = bmp.encode(Raster("paletted", np.full((2, 2, 1), 9), np.array([[1, 2, 3, 255]] * 10)))
    assert (bmp.decode(entries).pixels == 9).all()


def test_gif_frames_and_errors():
    data = gif.encode(NOISE[:, :, 0], np.array([[i, i, i] for i in range(256)]))
    assert len(list(gif.frames(data))) == 1
    assert gif.frames(data.replace(b"GIF89a", b"GIF87a")).__next__().width == 31
    with pytest.raises(FormatError):
        gif.decode(b"GIF90a" + data[6:])
    with pytest.raises(FormatError):
        gif.decode(data[:13] + data[13 + 768 + 10 :][:3])


def test_jpeg_errors():
    data = jpeg.encode(Raster("rgba", smooth()), 75)
    with pytest.raises(FormatError):
        jpeg.decode(data[2:])
    scan = data.index(b"\xff\xda")
    cut = jpeg.decode(data[: (scan + len(data)) // 2])
    assert cut.truncated and cut.pixels.shape == (45, 61, 3)
    with pytest.raises(FormatError):
        jpeg.decode(data[:scan])
    with pytest.raises(UnsupportedError):
        jpeg.encode(Raster("gray", np.zeros((1, 1 << 16, 1))))
    assert (jpeg.scaled_quant(0) == jpeg.scaled_quant(1)).all() and (jpeg.scaled_quant(100) == 1).all()


def test_cosine_transform():
    samples = RNG.integers(0, 256, (500, 8, 8))
    basis = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])
    exact = basis @ (samples - 128.0) @ basis.T
    assert np.abs(jpeg.forward(samples) - 8 * exact).max() < 1
    steps = np.round(exact).astype(int)
    assert np.abs(jpeg.inverse(steps) - basis.T @ steps @ basis).max() < 0.75
    assert np.abs(jpeg.inverse(steps) + 128 - samples).max() <= 2
    assert jpeg.forward(np.full((8, 8), 255))[0, 0] == 8 * 8 * 127 and not jpeg.inverse(np.zeros((8, 8), int)).any()
    assert sorted(jpeg.ZIGZAG) == list(range(64)) and jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]


def test_sniffing():
    assert registry.sniffed(jpeg.encode(Raster("gray", np.zeros((1, 1, 1))))).name == "jpeg"
    assert not registry.matches(b"BM????\0\0\0\0", b"BM1234")
    with pytest.raises(FormatError):
        registry.sniffed(b"plain text")


@pytest.mark.parametrize("fmt,model,channels", [("gif", "paletted", 1), ("png", "nrgba", 4), ("png", "paletted", 1), ("bmp", "rgba", 4), ("bmp", "nrgba", 4), ("bmp", "paletted", 1), ("bmp", "rgba64", 4)])
@pytest.mark.parametrize("case", ["whole", "shuffled", "holes"])
def test_bands_are_the_whole_image(spark, fmt, model, channels, case):
    """Many images of several heights; whatever the bands and the order of rows, the pixels of a file coded at once."""
    rng = np.random.default_rng(7)
    palette = np.column_stack([np.arange(256), 255 - np.arange(256), np.full(256, 9), np.full(256, 255)])
    rows, want = [], {}
    for image in range(5):
        h, w = 1 + 9 * image, 13 + image
        top = 65536 if model == "rgba64" else 256
        p = rng.integers(0, top, (h, w, channels))
        if channels == 4 and image < 3:
            p[..., 3] = top - 1
        x0, y0 = -2 * image, image - 3
        full = [(image, x0 + x, y0 + y, *map(int, p[y, x])) for y in range(h) for x in range(w)]
        if case == "holes":
            gone = set(rng.choice(len(full), len(full) // 4, replace=False).tolist()) - {0, len(full) - 1, w - 1, len(full) - w}
            for k in gone:
                p[k // w, k % w] = 0
            full = [r for k, r in enumerate(full) if k not in gone]
        rows += full
        want[image] = p
    if case == "shuffled":
        rows = [rows[i] for i in rng.permutation(len(rows))]
    names = [f"c{i}" for i in range(channels)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in ["image_id", "x", "y", *names])).repartition(3, "y")
    table = palette if model == "paletted" else None
    files = {r["image_id"]: bytes(r["content"]) for r in bands.encode(df, fmt, model, names, table, rows=4).collect()}
    codec = {"gif": gif, "png": png, "bmp": bmp}[fmt]
    for image, p in want.items():
        alone = gif.encode(p[:, :, 0], table) if fmt == "gif" else codec.encode(Raster(model, p, table))
        one, other = codec.decode(files[image]), codec.decode(alone)
        assert one.model == other.model and np.array_equal(one.pixels, other.pixels)
        if fmt == "bmp":
            assert files[image] == alone


def peak(work) -> int:
    """Bytes held at most while ``work()`` runs."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_png_16_bit_memory():
    rows = np.random.default_rng(5).integers(0, 256, (10_000, 800)).astype(np.uint8)  # 100 pixels of four 16-bit channels
    for kind in range(5):
        assert peak(lambda: png.filtered(rows, kind, 8)) < 8 * rows.size
    data = png.encode_rows(png.filtered(rows, 4, 8)[:500], 100, 500, 16, 6)
    assert peak(lambda: png.decode(data)) < 8 * 500 * 800
    assert np.array_equal(png.decode(data).pixels, rows[:500].reshape(500, 100, 4, 2) @ np.array([256, 1]))


def test_filters_over_a_step():
    rows = np.random.default_rng(6).integers(0, 256, (3 * png.STEP // 800, 800)).astype(np.uint8)
    for kind in range(5):
        whole = png.filtered(rows, kind, 8)
        assert np.array_equal(png.unfilter(whole[:400], 8), rows[:400])
        assert np.array_equal(whole[400:], png.filtered(rows[399:], kind, 8)[1:])


def test_index_outside_the_palette(spark):
    data = gif.encode(np.array([[0, 1], [2, 200]]), np.zeros((256, 3)))
    short = data[:10] + bytes([0xF0]) + data[11:13] + data[13:19] + data[13 + 768 :]  # two entries
    rows = images.decode(spark.createDataFrame([(1, bytearray(short))], "image_id long, content binary")).collect()
    assert len(rows) == 1 and rows[0]["error"].startswith("IndexError")
