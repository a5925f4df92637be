"""GIF: palettes, frames and LZW."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from .base import Config, FormatError, Raster, UnsupportedError, checked_size

MAGICS = (b"GIF87a", b"GIF89a")


def _table(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if len(data) < at + 3 * n:
        raise FormatError("gif: unexpected end")
    rgb = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3).astype(np.int64)
    return np.column_stack((rgb, np.full(n, 255))), at + 3 * n


def _screen(data: bytes):
    if data[:6] not in MAGICS:
        raise FormatError("gif: not a GIF file")
    if len(data) < 13:
        raise FormatError("gif: unexpected end")
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    palette, at = _table(data, 13, flags) if flags & 0x80 else (None, 13)
    return w, h, palette, at


def config(data: bytes) -> Config:
    w, h, *_ = _screen(data)
    return Config("gif", "paletted", w, h)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """Sub-blocks joined up to the empty one, and the place after it."""
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    if at >= len(data):
        raise FormatError("gif: unexpected end")
    return b"".join(parts), at + 1


def unlzw(data: bytes, width: int, most: int) -> np.ndarray:
    """Codes of ``width`` + 1 to 12 bits, low bits first, to at most ``most`` bytes."""
    if not 1 < width < 9 and width != 1:
        raise FormatError("gif: code width")
    clear, end = 1 << width, (1 << width) + 1
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, bits, last, out, size = list(roots), width + 1, None, [], 0
    held = count = 0
    for byte in data:
        held |= byte << count
        count += 8
        while count >= bits:
            code = held & ((1 << bits) - 1)
            held >>= bits
            count -= bits
            if code == clear:
                table, bits, last = list(roots), width + 1, None
                continue
            if code == end:
                return np.frombuffer(b"".join(out)[:most], np.uint8)
            if code < len(table):
                run = table[code]
            elif code == len(table) and last:
                run = last + last[:1]
            else:
                raise FormatError("gif: bad code")
            out.append(run)
            size += len(run)
            if last is not None and len(table) < 4096:
                table.append(last + run[:1])
                if len(table) == 1 << bits and bits < 12:
                    bits += 1
            last = run
            if size >= most:
                return np.frombuffer(b"".join(out)[:most], np.uint8)
    return np.frombuffer(b"".join(out)[:most], np.uint8)


def _codes(values: bytes, width: int) -> tuple[list[int], np.ndarray]:
    """Codes of ``values`` after a clear code, and how many bits each takes and one more would take."""
    clear, first = 1 << width, (1 << width) + 2
    codes, heads = [clear], [1]
    put, table, following = codes.append, {}, first
    get, run = table.get, -1
    for v in values:
        key = run << 8 | v
        known = get(key) if run >= 0 else v
        if known is not None:
            run = known
            continue
        put(run)
        table[key] = following
        following += 1
        run = v
        if following == 4096:  # all codes are used
            put(clear)
            heads.append(len(codes))
            table, following = {}, first
            get = table.get
    if run >= 0:
        put(run)
    # the k-th code after a clear one follows k - 1 new entries, which tell its bits
    since = np.arange(len(codes) + 1)
    since -= np.repeat(heads, np.diff([0, *heads[1:], len(codes) + 1]))
    bits = np.maximum(width + 1, np.frexp(np.maximum(first + since - 1, 1))[1])
    bits[0] = width + 1
    return codes, np.minimum(bits, 12)


def _packed(codes: np.ndarray, bits: np.ndarray) -> bytes:
    """Codes of several lengths, low bits first."""
    out = []
    for at in range(0, len(codes), 1 << 16):
        c, n = codes[at : at + (1 << 16), None].astype(np.uint16), bits[at : at + (1 << 16), None]
        out.append((c >> np.arange(12, dtype=np.uint16) & 1).astype(np.uint8)[np.arange(12) < n])
    return np.packbits(np.concatenate(out), bitorder="little").tobytes()


def lzw(values: bytes, width: int = 8) -> bytes:
    """The opposite of :func:`unlzw`, starting with a clear code."""
    codes, bits = _codes(values, width)
    return _packed(np.array([*codes, (1 << width) + 1]), bits)


def _nine(codes: np.ndarray) -> bytes:
    """9-bit codes, eight at a time: nine bytes."""
    short = -len(codes) % 8
    c = np.concatenate((codes, np.zeros(short, np.uint16))).astype("<u8").reshape(-1, 8)
    out = np.empty((len(c), 9), np.uint8)
    low = c[:, 0].copy()
    for k in range(1, 8):
        low |= c[:, k] << np.uint64(9 * k)  # of the last one, its lowest bit
    out[:, :8] = low.view(np.uint8).reshape(-1, 8)
    out[:, 8] = c[:, 7] >> np.uint64(1)
    return out.tobytes()[: (9 * len(codes) + 7) // 8]


def _unchanged(values: bytes) -> np.ndarray:
    """Bytes as codes with a clear code before every 254, so that codes never widen."""
    v = np.frombuffer(values, np.uint8)
    rows = -(-len(v) // 254)
    full = np.zeros((rows, 255), np.uint16)
    full[:, 0] = 256
    flat = np.zeros(rows * 254, np.uint8)
    flat[: len(v)] = v
    full[:, 1:] = flat.reshape(rows, 254)
    return full.reshape(-1)[: len(v) + rows]


def literal(values: bytes) -> bytes:
    """Bytes as 9-bit codes; any reader takes them. They are an eighth larger than the bytes, and made without a loop."""
    return _nine(np.append(_unchanged(values), np.uint16(257)))


def band(values: bytes, compress: bool = True) -> bytes:
    """Codes of a part of an image that end on a byte and with a clear table, in sub-blocks; :func:`file_of` joins such parts."""
    if compress:
        codes, bits = _codes(values, 8)
        used = int(bits.sum())  # the code after the last one is a clear code
        more = -used % 8  # clear codes of nine bits, one bit over a byte each
        data = _packed(np.array(codes + [256] * (1 + more)), np.concatenate((bits, np.full(more, 9))))
    else:
        codes = _unchanged(values)
        data = _nine(np.concatenate((codes, np.full(-len(codes) % 8, 256, np.uint16))))
    whole = len(data) // 255
    blocks = np.full((whole, 256), 255, np.uint8)
    blocks[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return blocks.tobytes() + (bytes([len(rest)]) + rest if rest else b"")


def band_values(data: bytes, count: int) -> np.ndarray:
    """The opposite of :func:`band`."""
    body, _ = _blocks(data + b"\0", 0)
    return unlzw(body, 8, count)


def frames(data: bytes, most: int | None = None) -> Iterator[Raster]:
    """Frames in order, each at its place on the screen; extensions are skipped, unknown bytes ignored."""
    _, _, shared, at = _screen(data)
    done = 0
    while at < len(data) and data[at] != 0x3B and (most is None or done < most):
        kind, at = data[at], at + 1
        if kind == 0x21:
            _, at = _blocks(data, at + 1)
        elif kind == 0x2C:
            if len(data) < at + 9:
                raise FormatError("gif: unexpected end")
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            palette, at = _table(data, at + 9, flags) if flags & 0x80 else (shared, at + 9)
            if palette is None or at >= len(data):
                raise FormatError("gif: no colour table")
            checked_size(w, h)
            width = data[at]
            body, at = _blocks(data, at + 1)
            flat = np.zeros(w * h, np.int64)
            got = unlzw(body, width, w * h)
            flat[: len(got)] = got
            index = flat.reshape(h, w)
            if flags & 0x40:  # stored in four passes
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                index = index[np.argsort(order, kind="stable")]
            yield Raster("paletted", index[:, :, None], palette, x, y, truncated=len(got) < w * h)
            done += 1


def decode(data: bytes) -> Raster:
    """The first frame."""
    for f in frames(data, 1):
        return f
    raise FormatError("gif: no image")


def file_of(width: int, height: int, palette: np.ndarray, bands: list[bytes]) -> bytes:
    """One frame with a global table of 256 entries, filled up with black; alpha is dropped."""
    if width >= 1 << 16 or height >= 1 << 16:
        raise UnsupportedError("gif: image is too large to encode")
    table = np.zeros((256, 3), np.uint8)
    table[: len(palette)] = palette[:, :3]
    screen = struct.pack("<6sHHBBB", b"GIF89a", width, height, 0xF7, 0, 0)
    frame = struct.pack("<BHHHHBB", 0x2C, 0, 0, width, height, 0, 8)
    return b"".join((screen, table.tobytes(), frame, *bands, b"\2\1\1\0\x3b"))  # the end code, 257, in a block of its own


def encode(index: np.ndarray, palette: np.ndarray, compress: bool = True) -> bytes:
    """A file of one band. Uncompressed is far faster."""
    h, w = index.shape
    return file_of(w, h, palette, [band(index.astype(np.uint8).tobytes(), compress)])
