"""Queries of JPEG files and their transforms; the SQL does the same integer steps, so samples are compared one by one."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import num
from ..operators import blocks
from ..operators.raster import KEYS, union_images
from ..sources import images
from ..sources.codecs import jpeg
from ..sources.codecs.base import Raster
from . import fixtures as fx
from . import jpeg_sql as q
from .catalog import add, query
from .codec_queries import RGBA, _custom, _opaque
from .fixtures import sql

def _samples(files: DataFrame, n: int) -> DataFrame:
    return images.decode(files).select(*KEYS, *(f"c{i}" for i in range(1, n + 1)))


# --- whole files --------------------------------------------------------------------------------

add("src26_jpeg_round_trip", lambda s, d: _samples(images.encode(_opaque(s, d), "jpeg", "rgba", RGBA, quality=95), 3), sql(q.COLOR_OUT.format("px"), "px", extra=q.color(95)))
add("src26_jpeg_gray", lambda s, d: _samples(images.encode(fx.orders(s, d), "jpeg", "gray", ["g"], quality=95), 1), sql(q.GRAY_OUT, "px", extra=q.gray(95)))
add("snk22_jpeg_padding", lambda s, d: _samples(images.encode(fx.customers(s, d), "jpeg", "rgba", RGBA, quality=80), 3), sql(q.COLOR_OUT.format("cust"), "cust", extra=q.color(80, "cust")))

# many images at once: each is a group of its own, bands and blocks of all are coded side by side
for _format in ("bmp", "png"):
    add(
        f"snk_many_images_{_format}",
        lambda s, d, f=_format: images.decode(images.encode(fx.many(s, d), f, "rgba", RGBA)).select(*KEYS, F.col("c1").alias("r"), F.col("c2").alias("g"), F.col("c3").alias("b")),
        sql("SELECT image_id, x, y, r, g, b FROM many", "many"),
    )
add("snk_many_images_gif", lambda s, d: _samples(images.encode(fx.many(s, d), "gif", "paletted", ["g"], np.array([[i, i, i] for i in range(256)])), 1), sql("SELECT image_id, x, y, g AS c1 FROM many", "many"))
add("snk_many_images_jpeg", lambda s, d: _samples(images.encode(fx.many(s, d), "jpeg", "rgba", RGBA, quality=70), 3), sql(q.COLOR_OUT.format("many"), "many", extra=q.color(70, "many")))

_QUALITIES = (0, 1, 49, 50, 75, 100)


@query("snk14_jpeg_quality", sql(" UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS image_id, px.x, px.y, a.c AS c1 FROM px {q.sample(f'd{k}', 0, 'a')}" for k in _QUALITIES), "px", extra=", ".join((q.GRAY, q.tiled("gp", "t"), *(q.coded("t", f"d{k}", {0: (max(k, 1), 0)}) for k in _QUALITIES)))))
def snk14(spark: SparkSession, d: str) -> DataFrame:
    """Gray files of several qualities, each an image."""
    files = [images.encode(fx.orders(spark, d), "jpeg", "gray", ["g"], quality=k).withColumn("image_id", num(k)) for k in _QUALITIES]
    return _samples(union_images(files), 1)


def _section(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _code_tables(n: int) -> bytes:
    """The first ``n`` example tables: of direct and other coefficients in turn."""
    return _section(0xC4, b"".join(bytes([k % 2 << 4 | k // 2, *map(int, c.split())]) + bytes.fromhex(v) for k, (c, v) in enumerate(jpeg.HUFFMAN[:n])))


def _ended(writer: jpeg.Writer) -> bytes:
    writer.put(0x7F, 7)
    return bytes(writer.out)


def _restarts(p: np.ndarray) -> bytes:
    """A gray file with a restart marker after every row of blocks."""
    h, w, _ = p.shape
    rows, cols = -(-h // 8), -(-w // 8)
    coded = jpeg.quantised(jpeg.tiles(p[:, :, 0], rows, cols), jpeg.scaled_quant(95)[0]).tolist()
    whole = jpeg.encode(Raster("gray", p), 95)
    start = whole.index(b"\xff\xda")
    parts = []
    for row in coded:
        writer, last = jpeg.Writer(), 0
        for b in row:
            last = writer.block(b, last, False)
        parts.append(_ended(writer))
    body = b"".join(part + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, part in enumerate(parts))
    return whole[:start] + _section(0xDD, struct.pack(">H", cols)) + whole[start : start + 10] + body + b"\xff\xd9"


add("src38_jpeg_restarts", lambda s, d: _samples(_custom(fx.orders(s, d), ["g"], _restarts, "jpeg"), 1), sql(q.GRAY_OUT, "px", extra=q.gray(95)))


def _progressive(refined: bool):
    """A gray file of several scans: direct coefficients, two bands; if ``refined``, then the last bit of each."""

    def first(coefficients: list[list[int]], a: int, b: int, low: int) -> bytes:
        writer, last = jpeg.Writer(), 0
        for c in coefficients:
            if a == 0:
                writer.coded(0, 0, (c[0] >> low) - last)
                last = c[0] >> low
                continue
            run = 0
            for v in c[a : b + 1]:
                m = abs(v) >> low
                if not m:
                    run += 1
                    continue
                for _ in range(run // 16):
                    writer.put(*writer.tables[1][0xF0])
                writer.coded(1, run % 16, m if v > 0 else -m)
                run = 0
            if run:
                writer.put(*writer.tables[1][0])
        return _ended(writer)

    def refining(coefficients: list[list[int]], a: int, b: int) -> bytes:
        writer = jpeg.Writer()
        for c in coefficients:
            if a == 0:
                writer.put(c[0] & 1, 1)
                continue
            run, waiting, final = 0, [], max((k for k in range(a, b + 1) if abs(c[k]) == 1), default=-1)

            def send(symbol, extra=(), waiting=waiting):
                writer.put(*writer.tables[1][symbol])
                for bit in (*extra, *waiting):
                    writer.put(bit, 1)
                waiting.clear()

            for k in range(a, b + 1):
                m = abs(c[k])
                if not m:
                    run += 1
                    continue
                while run > 15 and k <= final:
                    send(0xF0)
                    run -= 16
                if m > 1:
                    waiting.append(m & 1)
                else:
                    send(run << 4 | 1, [int(c[k] > 0)])
                    run = 0
            if run or waiting:
                send(0)
        return _ended(writer)

    def make(p: np.ndarray) -> bytes:
        h, w, _ = p.shape
        quant = jpeg.scaled_quant(90)[0]
        coefficients = jpeg.quantised(jpeg.tiles(p[:, :, 0], -(-h // 8), -(-w // 8)), quant).reshape(-1, 64).tolist()
        low, bands = int(refined), ((0, 0), (1, 5), (6, 63))
        scans = [(a, b, low, first(coefficients, a, b, low)) for a, b in bands]
        if refined:
            scans += [(a, b, 0x10, refining(coefficients, a, b)) for a, b in bands]
        head = _section(0xDB, b"\0" + bytes(quant.tolist())) + _section(0xC2, struct.pack(">BHHB", 8, h, w, 1) + b"\1\x11\0") + _code_tables(2)
        return b"\xff\xd8" + head + b"".join(_section(0xDA, bytes([1, 1, 0, a, b, x])) + data for a, b, x, data in scans) + b"\xff\xd9"

    return make


add("src35_jpeg_refinement", lambda s, d: _samples(_custom(fx.orders(s, d), ["g"], _progressive(True), "jpeg"), 1), sql(q.GRAY_OUT, "px", extra=q.gray(90)))
add("src36_jpeg_progressive", lambda s, d: _samples(_custom(fx.orders(s, d), ["g"], _progressive(False), "jpeg"), 1), sql(q.GRAY_OUT, "px", extra=q.gray(90)))


def _components(names: bytes, factors: tuple[int, ...], adobe: int | None, quality: int = 100):
    """A file of as many components as channels, single scan; ``factors``: samples along a row."""

    def make(p: np.ndarray) -> bytes:
        h, w, n = p.shape
        quant, most = jpeg.scaled_quant(quality)[0], max(factors)
        rows, cols = -(-h // 8), -(-w // (8 * most))
        planes = [jpeg.quantised(jpeg.tiles(p[:, :: most // f, k], rows, cols * f), quant).tolist() for k, f in enumerate(factors)]
        writer, last = jpeg.Writer(), [0] * n
        for y in range(rows):
            for x in range(cols):
                for k, f in enumerate(factors):
                    for i in range(f):
                        last[k] = writer.block(planes[k][y][x * f + i], last[k], False)
        comps = b"".join(bytes([names[k], f << 4 | 1, 0]) for k, f in enumerate(factors))
        app = _section(0xEE, b"Adobe" + bytes(6) + bytes([adobe])) if adobe is not None else b""
        head = app + _section(0xDB, b"\0" + bytes(quant.tolist())) + _section(0xC0, struct.pack(">BHHB", 8, h, w, n) + comps) + _code_tables(2)
        return b"\xff\xd8" + head + _section(0xDA, bytes([n]) + b"".join(bytes([names[k], 0]) for k in range(n)) + b"\0\x3f\0") + _ended(writer) + b"\xff\xd9"

    return make


def _components_sql(channels: str, factors: tuple[int, ...], outs: list[str]) -> str:
    most = max(factors)
    planes = " UNION ALL ".join(f"SELECT image_id, CAST({k} AS BIGINT) AS p, x // {most // f} AS x, y, {c} AS c FROM px WHERE x % {most // f} = 0" for k, (c, f) in enumerate(zip(channels, factors)))
    extra = ", ".join((f"gp AS ({planes})", q.tiled("gp", "t"), q.coded("t", "d", {k: (100, 0) for k in range(len(factors))})))
    joins = " ".join(q.sample("d", k, f"s{k}", f"px.x * {f} // {most}", "px.y") for k, f in enumerate(factors))
    return sql(f"SELECT px.image_id, px.x, px.y, {', '.join(outs)} FROM px {joins}", "px", extra=extra)


def _own(files: DataFrame, n: int) -> DataFrame:
    return images.decode(files).select(*KEYS, "model", *(f"c{i}" for i in range(1, n + 1)))


_SAME = [f"s{k}.c AS c{k + 1}" for k in range(3)]
add("src39_jpeg_rgb", lambda s, d: _own(_custom(_opaque(s, d), ["r", "g", "b"], _components(b"RGB", (1, 1, 1), None), "jpeg"), 3), _components_sql("rgb", (1, 1, 1), ["'rgba' AS model", *_SAME]))
add("src40_jpeg_cmyk", lambda s, d: _own(_custom(_opaque(s, d), RGBA, _components(b"CMYK", (1, 1, 1, 1), 0), "jpeg"), 4), _components_sql("rgba", (1, 1, 1, 1), ["'cmyk' AS model", *(f"255 - s{k}.c AS c{k + 1}" for k in range(4))]).replace("a AS c FROM px", "255 AS c FROM px"))
for _name, _factors in (("422", (2, 1, 1)), ("411", (4, 1, 1)), ("flex", (1, 2, 4))):
    add(f"src33_jpeg_{_name}", lambda s, d, f=_factors: _own(_custom(_opaque(s, d), ["g", "r", "b"], _components(b"\1\2\3", f, None), "jpeg"), 3), _components_sql("grb", _factors, ["'ycbcr' AS model", *_SAME]))


# --- entropy coding -----------------------------------------------------------------------------


@query("src27_unstuffed", sql("SELECT x, y, g, 255 - g AS inverted FROM gray", "gray"))
def src27(spark: SparkSession, d: str) -> DataFrame:
    """Rows of bytes with a zero after each 255, read as bits: each byte in two halves, then its complement."""

    @F.pandas_udf("array<struct<g: long, inverted: long>>")
    def read(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            raw = bytes(b for v in r for b in (int(v), 255 - int(v)))
            bits = jpeg.Bits(raw.replace(b"\xff", b"\xff\x00"))
            out.append([(bits.take(4) << 4 | bits.take(4), bits.take(8)) for _ in r])
        return pd.Series(out)

    rows = fx.gray(spark, d).groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", "g"))).alias("v"))
    return rows.select("y", F.posexplode(read(F.transform("v", lambda s: s["g"]))).alias("i", "s")).select(num("i").alias("x"), "y", "s.g", "s.inverted")


@query("src31_huffman_codes", f"WITH {q.CODES} SELECT tab % 2 AS kind, tab // 2 AS name, symbol, code, bits FROM codes")
def src31(spark: SparkSession, d: str) -> DataFrame:
    """(kind, name, symbol, code, bits) as a decoder has them from the table segments of a colour file."""

    @F.pandas_udf("array<struct<kind: int, name: int, symbol: int, code: int, bits: int>>")
    def read(contents: pd.Series) -> pd.Series:
        out = []
        for c in contents:
            tables = jpeg.Decoder(bytes(c)).huff
            out.append([(kind, name, symbol, key - (1 << key.bit_length() - 1), key.bit_length() - 1) for (kind, name), t in tables.items() for key, symbol in t.items()])
        return pd.Series(out)

    return images.encode(fx.customers(spark, d), "jpeg", "rgba", RGBA).select(F.explode(read("content")).alias("s")).select("s.*")


@query("snk16_huffman_codes", f"WITH {q.CODES} SELECT tab, symbol, code, bits FROM codes")
def snk16(spark: SparkSession, d: str) -> DataFrame:
    """(tab, symbol, code, bits) of the writer's four tables."""
    rows = [(t, symbol, *code) for t, table in enumerate(jpeg.Writer().tables) for symbol, code in table.items()]
    return spark.createDataFrame(rows, "tab int, symbol int, code int, bits int")


_VALUE = "CASE WHEN g = 128 THEN 1 ELSE g - 128 END"
_EMITTED = f"""vals AS (SELECT y, x, {_VALUE} AS v FROM gray), sized AS (SELECT *, CAST(length(bin(abs(v))) AS INTEGER) AS size FROM vals),
b AS (SELECT y, string_agg(lpad(bin(code), bits, '0') || lpad(bin(CASE WHEN v > 0 THEN v ELSE v + (1 << size) - 1 END), size, '0'), '' ORDER BY x) || '1111111' AS s
  FROM sized JOIN codes ON codes.tab = 1 AND codes.symbol = (x % 16) * 16 + size GROUP BY y),
bytes AS (SELECT y, i, substr(s, 8 * i + 1, 8) AS byte FROM (SELECT y, s, unnest(generate_series(0, length(s) // 8 - 1)) AS i FROM b))"""


@query("snk17_emitted", sql("SELECT y, string_agg(CASE WHEN byte = '11111111' THEN '1111111100000000' ELSE byte END, '' ORDER BY i) AS bits FROM bytes GROUP BY y", "gray", extra=f"{q.CODES}, {_EMITTED}"))
def snk17(spark: SparkSession, d: str) -> DataFrame:
    """Rows of values as run-length codes: Huffman codes, magnitudes, the ones at the end, a zero after each byte of ones."""

    @F.pandas_udf("string")
    def emit(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            writer = jpeg.Writer()
            for i, v in enumerate(r):
                writer.coded(1, i % 16, int(v))
            out.append("".join(f"{b:08b}" for b in _ended(writer)))
        return pd.Series(out)

    value = F.when(F.col("g") == 128, F.lit(1)).otherwise(F.col("g") - 128).cast("long")
    rows = fx.gray(spark, d).groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", value.alias("v")))).alias("s"))
    return rows.select("y", emit(F.transform("s", lambda s: s["v"])).alias("bits"))


def _segment_sql(quality: int) -> str:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    base = ", ".join(f"({t}, {z}, {v})" for t, text in enumerate(jpeg.QUANT) for z, v in enumerate(text.split()))
    quant = f"SELECT string_agg(CASE WHEN z = 0 THEN printf('%02x', t) ELSE '' END || printf('%02x', least(greatest((v * {scale} + 50) // 100, 1), 255)), '' ORDER BY t, z) FROM (VALUES {base}) x(t, z, v)"
    frame = "SELECT '08' || printf('%04x', max(y) + 1) || printf('%04x', max(x) + 1) || '03012200021101031101' FROM px"
    codes = "SELECT string_agg(part, '' ORDER BY tab, o, k) FROM (SELECT tab, 0 AS o, 0 AS k, printf('%d%d', tab % 2, tab // 2) AS part FROM counts GROUP BY tab UNION ALL SELECT tab, 1, bits, printf('%02x', n) FROM counts UNION ALL SELECT tab, 2, nth, printf('%02x', symbol) FROM symbols)"
    return sql(f"SELECT kind, body FROM (SELECT 'DB' AS kind, ({quant}) AS body UNION ALL SELECT 'C0', ({frame}) UNION ALL SELECT 'C4', ({codes}))", "px", extra=q.CODES)


@query("snk18_segments", _segment_sql(60))
def snk18(spark: SparkSession, d: str) -> DataFrame:
    """The bodies of a colour file's table and frame segments, in hexadecimal.

    Of a raster in pages, equal tables count once and the frames' heights are added: over 65535 they take a fifth digit.
    """

    @F.pandas_udf("array<struct<kind: string, body: string>>")
    def bodies(contents: pd.Series) -> pd.Series:
        return pd.Series([[(f"{m:02X}", body.hex()) for m, _, body in jpeg.segments(bytes(c)) if m in (0xDB, 0xC0, 0xC4)] for c in contents])

    files = images.encode(_opaque(spark, d), "jpeg", "rgba", RGBA, quality=60)
    frame = F.col("kind") == "C0"
    found = files.select("image_id", F.explode(bodies("content")).alias("s")).select("image_id", "s.kind", "s.body")
    cut = found.select("image_id", "kind", F.when(frame, F.conv(F.substring("body", 3, 4), 16, 10).cast("long")).alias("high"), F.when(frame, F.substring("body", 1, 2)).otherwise("").alias("depth"), F.when(frame, F.expr("substring(body, 7)")).otherwise(F.col("body")).alias("rest"))
    whole = cut.groupBy("image_id", "kind", "depth", "rest").agg(F.sum("high").alias("high"))
    return whole.select("kind", F.concat("depth", F.when(frame, F.format_string("%04x", "high")).otherwise(""), "rest").alias("body"))


# --- tiles and transforms -----------------------------------------------------------------------


def _height(px: DataFrame) -> int:
    return px.agg(F.max("y")).first()[0] + 1


def _tiles(s: SparkSession, d: str) -> DataFrame:
    px = fx.orders(s, d)
    return blocks.tiles(px, 100, _height(px), ["r"])


_RED = "gp AS (SELECT image_id, CAST(0 AS BIGINT) AS p, x, y, r AS c FROM px)"
add("snk20_tiles", _tiles, sql('SELECT image_id, bx, "by", u, v, c AS r FROM t', "px", extra=f"{_RED}, {q.tiled('gp', 't')}"))


def _transformed(direction: str, values) -> DataFrame:
    return lambda s, d: blocks.transform(blocks.gathered(_tiles(s, d).withColumn("r", values(F.col("r"))), "r"), "block", direction).select("image_id", "bx", "by", F.posexplode("block").alias("i", "c")).select("image_id", "bx", "by", num("i").alias("place"), "c")


_PLACED = 'SELECT image_id, bx, "by", 8 * v + u AS place, c FROM f'
add("dct1_forward", _transformed("forward", lambda r: r), sql(_PLACED, "px", extra=", ".join((_RED, q.tiled("gp", "t"), q.forward("t", "f")))))
add("dct2_inverse", _transformed("inverse", lambda r: r - 100), sql(_PLACED, "px", extra=", ".join((_RED.replace("r AS c", "r - 100 AS c"), q.tiled("gp", "t"), q.inverse("t", "f")))))


@query("dct3_rotations", sql("SELECT px.image_id, x, y, steps, c * r + s * g AS first, c * g - s * r AS second FROM px CROSS JOIN turns", "px", extra="turns AS (SELECT CAST(n AS BIGINT) AS steps, CAST(floor(f * cos(n * pi() / 16) * 16384 + 0.5) AS BIGINT) AS c, CAST(floor(f * sin(n * pi() / 16) * 16384 + 0.5) AS BIGINT) AS s FROM (VALUES (1, 1.0::DOUBLE), (3, 1.0::DOUBLE), (6, sqrt(2.0::DOUBLE))) t(n, f))"))
def dct3(spark: SparkSession, d: str) -> DataFrame:
    """All pixels' (r, g) through the three rotations of a transform, in 14-bit fixed point."""
    px, out = fx.orders(spark, d), []
    for steps, scale in ((1, 1.0), (3, 1.0), (6, 2**0.5)):
        first, second = jpeg.turned(F.col("r"), F.col("g"), steps, 14, scale)
        out.append(px.select(*KEYS, num(steps).alias("steps"), first.alias("first"), second.alias("second")))
    return out[0].unionByName(out[1]).unionByName(out[2])


add("dct4_zigzag", lambda s, d: blocks.zigzag(s), "SELECT row_number() OVER (ORDER BY i // 8 + i % 8, CASE WHEN (i // 8 + i % 8) % 2 = 1 THEN i // 8 ELSE i % 8 END) - 1 AS z, i AS place FROM range(64) t(i)")
