"""PNG: all colour types and depths without interlace; written as 8-bit RGBA."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from .base import Config, FormatError, Raster, UnsupportedError, checked_size, packed_rows

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Bytes that are predicted at once.
STEP = 1 << 18
#: Colour type: channels, depths, model of 8 bits and less, model of 16.
KINDS = {0: (1, (1, 2, 4, 8, 16), "gray", "gray16"), 2: (3, (8, 16), "rgba", "rgba64"), 3: (1, (1, 2, 4, 8), "paletted", ""), 4: (2, (8, 16), "nrgba", "nrgba64"), 6: (4, (8, 16), "rgba", "nrgba64")}


def chunks(data: bytes, verify: bool = False) -> Iterator[tuple[str, int, bytes, int, bool]]:
    """(type, place, body, stored checksum, whether it holds) of each chunk up to the end one."""
    if data[:8] != MAGIC:
        raise FormatError("png: not a PNG file")
    at = 8
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n:
            raise FormatError("png: unexpected end")
        crc = struct.unpack_from(">I", data, at + 8 + n)[0]
        right = crc == zlib.crc32(data[at + 4 : at + 8 + n])
        if verify and not right:
            raise FormatError("png: invalid checksum")
        yield kind.decode("latin-1"), at, body, crc, right
        if kind == b"IEND":
            return
        at += 12 + n
    raise FormatError("png: unexpected end")


def _header(body: bytes) -> tuple[int, int, int, int]:
    if len(body) != 13:
        raise FormatError("png: bad IHDR length")
    w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
    if kind not in KINDS:
        raise FormatError("png: invalid colour type")
    if depth not in KINDS[kind][1]:
        raise UnsupportedError("png: bit depth")
    if lace:
        raise UnsupportedError("png: interlace")
    checked_size(w, h, 8)
    return w, h, depth, kind


def config(data: bytes) -> Config:
    for name, _, body, *_ in chunks(data):
        if name == "IHDR":
            w, h, depth, kind = _header(body)
            return Config("png", KINDS[kind][3 if depth == 16 else 2], w, h)
    raise FormatError("png: no IHDR")


def unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the row predictions. rows: (height, 1 + bytes), the first byte being the kind."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), np.uint8)
    for i, row in enumerate(rows):
        kind, raw, above = int(row[0]), row[1:], out[i]
        if kind == 0:
            out[i + 1] = raw
        elif kind == 1:  # a running sum per channel
            n = -(-len(raw) // bpp) * bpp
            padded = np.zeros(n, np.uint8)
            padded[: len(raw)] = raw
            out[i + 1] = np.cumsum(padded.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()[: len(raw)]
        elif kind == 2:
            out[i + 1] = raw + above
        elif kind in (3, 4):
            line, up = [0] * bpp + raw.tolist(), [0] * bpp + above.tolist()
            for j in range(bpp, len(line)):
                left, high = line[j - bpp], up[j]
                if kind == 3:
                    guess = (left + high) // 2
                else:
                    corner = up[j - bpp]
                    away = (abs(high - corner), abs(left - corner), abs(left + high - 2 * corner))
                    guess = (left, high, corner)[away.index(min(away))]
                line[j] = (line[j] + guess) & 255
            out[i + 1] = line[bpp:]
        else:
            raise FormatError("png: bad filter type")
    return out[1:]


def filtered(rows: np.ndarray, kind: int, bpp: int) -> np.ndarray:
    """Rows of bytes predicted by one kind of filter, with the kind in front; what it needs beside them holds for ``STEP`` bytes."""
    out = np.empty((len(rows), 1 + rows.shape[1]), np.uint8)
    out[:, 0] = kind
    step = max(1, STEP // max(1, rows.shape[1]))
    for top in range(0, len(rows), step):
        x = rows[max(0, top - 1) : top + step].astype(np.int64)  # from the row above on
        guess, first = 0, min(top, 1)
        if kind:
            left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
            left[:, bpp:], up[1:], corner[1:, bpp:] = x[:, :-bpp], x[:-1], x[:-1, :-bpp]
        if kind == 4:
            away = np.stack((abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)))
            guess = np.choose(np.argmin(away, axis=0), (left, up, corner))
        elif kind:
            guess = (left, up, (left + up) // 2)[kind - 1]
        out[top : top + step, 1:] = (x - guess)[first:] & 255
    return out


def decode(data: bytes, verify: bool = False) -> Raster:
    """8-bit RGBA is given as it is stored (model ``rgba``), which is what :func:`encode` writes."""
    head, palette, body = None, None, []
    for name, _, content, *_ in chunks(data, verify):
        if name == "IHDR":
            head = _header(content)
        elif name == "PLTE":
            table = np.frombuffer(content[: len(content) // 3 * 3], np.uint8).reshape(-1, 3)
            palette = np.column_stack((table, np.full(len(table), 255))).astype(np.int64)
        elif name == "IDAT":
            body.append(content)
    if head is None:
        raise FormatError("png: no IHDR")
    w, h, depth, kind = head
    channels, _, model, model16 = KINDS[kind]
    stride = (w * channels * depth + 7) // 8
    try:
        raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise FormatError(f"png: {e}") from e
    if len(raw) < h * (stride + 1):
        raise FormatError("png: unexpected end")
    rows = unfilter(raw[: h * (stride + 1)].reshape(h, stride + 1), max(1, channels * depth // 8))
    kept = np.dtype(np.uint16 if depth == 16 else np.uint8)
    v = (rows.view(">u2") if depth == 16 else packed_rows(rows, w * channels, depth)).astype(kept).reshape(h, w, channels)
    solid = np.full((h, w), np.iinfo(kept).max, kept)
    if kind == 0 and depth < 8:
        v = v * kept.type(255 // ((1 << depth) - 1))
    elif kind == 2:
        v = np.dstack((v, solid))
    elif kind == 3:
        if palette is None or (v.size and v.max() >= len(palette)):
            raise FormatError("png: palette")
    elif kind == 4:
        v = np.dstack((v[:, :, 0], v[:, :, 0], v[:, :, 0], v[:, :, 1]))
    return Raster(model16 if depth == 16 else model, v, palette if kind == 3 else None)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_rows(rows: np.ndarray, w: int, h: int, depth: int, kind: int, extra: bytes = b"", block: int = 32768) -> bytes:
    """A file of already filtered rows; compressed data in chunks of ``block`` bytes."""
    packed = zlib.compress(rows.tobytes(), 6)
    data = b"".join(chunk(b"IDAT", packed[i : i + block]) for i in range(0, max(1, len(packed)), block))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + extra + data + chunk(b"IEND", b"")


def samples(image: Raster) -> np.ndarray:
    """8-bit RGBA; bytes of ``rgba`` and ``nrgba`` as they are, canonical ones shortened."""
    p = image.pixels
    if image.model == "rgba64":
        p = p >> 8
    elif image.model == "gray":
        p = np.dstack((p, p, p, np.full(p.shape[:2], 255)))
    elif image.model == "paletted":
        p = image.palette[p[:, :, 0]]
    elif image.model not in ("rgba", "nrgba"):
        raise UnsupportedError(f"png: {image.model}")
    return p.astype(np.uint8)


def encode(image: Raster) -> bytes:
    """RGBA without prediction."""
    return encode_rows(filtered(samples(image).reshape(image.height, -1), 0, 4), image.width, image.height, 8, 6)


def joined_checksum(parts: list[tuple[int, int]]) -> int:
    """The Adler-32 of a whole from (checksum, length) of its parts: two sums, of bytes and of all sums so far."""
    bytes_, sums = 1, 0
    for check, n in parts:
        own, own_sums = check & 0xFFFF, check >> 16
        sums = (sums + own_sums + n * (bytes_ - 1)) % 65521
        bytes_ = (bytes_ + own - 1) % 65521
    return sums << 16 | bytes_


def file_of(w: int, h: int, parts: list[tuple[bytes, int, int]], block: int = 32768) -> bytes:
    """A file of 8-bit RGBA from (deflated rows that end with a full flush, their Adler-32, their length)."""
    packed = b"".join((b"\x78\x9c", *(p for p, _, _ in parts), b"\3\0", struct.pack(">I", joined_checksum([(c, n) for _, c, n in parts]))))
    data = b"".join(chunk(b"IDAT", packed[i : i + block]) for i in range(0, len(packed), block))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + data + chunk(b"IEND", b"")
