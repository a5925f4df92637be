"""SQL of the integer JPEG steps for DuckDB: tiles, transforms, quantisation, planes.

A plane's samples or coefficients are rows (image_id, p, bx, by, v, u, c): plane, block, row and
column inside the block, value.  A transform's pass is a join with eight sums and differences, a
shift, a join with the rotations' constants, and a shift.
"""

from __future__ import annotations

import math

from ..sources.codecs import jpeg

PARTS = "image_id, p, bx, \"by\""


def _values(rows: list[list[int]], names: str) -> str:
    return "(VALUES " + ", ".join(f"({j}, {n}, {w})" for j, row in enumerate(rows) for n, w in enumerate(row) if w) + f") {names}"


def _fixed(x: float, bits: int) -> int:
    return int(math.floor(x * 2**bits + 0.5))


def _pair(steps: int, bits: int, scale: float) -> tuple[int, int]:
    return _fixed(scale * math.cos(steps * math.pi / 16), bits), _fixed(scale * math.sin(steps * math.pi / 16), bits)


def _forward_matrices(bits: int, whole: int) -> tuple[list, list]:
    forms = [[1] * 8, [1, -1, -1, 1, 1, -1, -1, 1], [0, 1, -1, 0, 0, -1, 1, 0], [1, 0, 0, -1, -1, 0, 0, 1]]
    forms += [[(n == k) - (n == 7 - k) for n in range(8)] for k in (3, 0, 2, 1)]
    (c6, s6), (c3, s3), (c1, s1) = _pair(6, bits, math.sqrt(2)), _pair(3, bits, 1), _pair(1, bits, 1)
    out = [[whole, 0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, c3 - s3, c3 + s3, c1 - s1, c1 + s1], [0, 0, c6, s6, 0, 0, 0, 0], [0, 0, 0, 0, -s3, c3, -c1, -s1]]
    out += [[0, whole, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, c3, s3, s1, -c1], [0, 0, -s6, c6, 0, 0, 0, 0], [0, 0, 0, 0, -s3 - c3, c3 - s3, c1 + s1, s1 - c1]]
    return forms, out


def _inverse_matrices(bits: int, odd_bits: int) -> tuple[list, list]:
    forms = [[1, 0, 0, 0, 1, 0, 0, 0], [1, 0, 0, 0, -1, 0, 0, 0], [0, 0, 1, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 1, 0]]
    forms += [[0, 1, 0, 0, 0, 1, 0, -1], [0, 1, 0, 1, 0, 0, 0, 1], [0, 1, 0, -1, 0, 0, 0, 1], [0, 1, 0, 0, 0, -1, 0, -1]]
    (c6, s6), (c3, s3), (c1, s1) = _pair(6, bits, math.sqrt(0.5)), _pair(3, odd_bits, 1), _pair(1, odd_bits, 1)
    even = [[1, 0, s6, c6], [0, 1, c6, -s6], [0, 1, -c6, s6], [1, 0, -s6, -c6]]
    odd = [[s3, c3, 0, 0], [0, 0, s1, c1], [0, 0, c1, -s1], [c3, -s3, 0, 0]]
    upper = [e + o for e, o in zip(even, odd)]
    return forms, upper + [e + [-w for w in o] for e, o in zip(even[::-1], odd[::-1])]


def _pass(source: str, name: str, along: str, forms: list, out: list, before: str, shift: str, after: str) -> str:
    """One pass; before: of an input c at n; shift: of a form y numbered j; after: of a result z at k."""
    other = "u" if along == "v" else "v"
    one = f"{name}_1 AS (SELECT {PARTS}, {other}, j, sum(w * ({before})) AS y FROM (SELECT *, {along} AS n FROM {source}) JOIN {_values(forms, 'm(j, n, w)')} USING (n) GROUP BY {PARTS}, {other}, j)"
    two = f"{name}_2 AS (SELECT {PARTS}, {other}, k, sum(w * ({shift})) AS z FROM (SELECT * REPLACE (CAST(y AS BIGINT) AS y) FROM {name}_1) JOIN {_values(out, 'm(k, j, w)')} USING (j) GROUP BY {PARTS}, {other}, k)"
    three = f"{name} AS (SELECT {PARTS}, {other}, CAST(k AS BIGINT) AS {along}, {after} AS c FROM (SELECT * REPLACE (CAST(z AS BIGINT) AS z) FROM {name}_2))"
    return ", ".join((one, two, three))


def forward(source: str, name: str) -> str:
    """Expressions up to ``name``: eight times the coefficients of the samples in ``source``."""
    root = _fixed(math.sqrt(2), 12)
    cols = _pass(source, f"{name}_c", "v", *_forward_matrices(18, 1 << 18), "c", "y", f"CASE WHEN k IN (3, 5) THEN (z >> 12) * {root} WHEN k = 0 THEN z - {1024 << 18} ELSE z END")
    root = _fixed(math.sqrt(2), 14)
    rows = _pass(f"{name}_c", name, "u", *_forward_matrices(14, 1), "c", "CASE WHEN j > 1 THEN y >> 14 ELSE y END", f"((CASE WHEN k IN (3, 5) THEN (z >> 14) * {root} ELSE z END) + {1 << 17}) >> 18")
    return f"{cols}, {rows}"


def inverse(source: str, name: str) -> str:
    """Expressions up to ``name``: samples less 128 of the coefficients in ``source``."""
    root = _fixed(math.sqrt(0.5), 8)
    rows = _pass(source, f"{name}_r", "u", *_inverse_matrices(18, 12), f"CASE WHEN n IN (0, 4) THEN c * {1 << 17} WHEN n IN (1, 7) THEN c * 128 WHEN n IN (3, 5) THEN c * {root} ELSE c END", "CASE WHEN j > 3 THEN y >> 2 ELSE y END", "z")
    root = _fixed(math.sqrt(0.5), 14)
    cols = _pass(f"{name}_r", name, "v", *_inverse_matrices(12, 12), f"CASE WHEN n = 0 THEN c + {1 << 19} WHEN n IN (2, 6) THEN c >> 13 WHEN n IN (3, 5) THEN (c >> 13) * {root} ELSE c END", "CASE WHEN j < 2 THEN y >> 2 WHEN j > 3 THEN y >> 14 ELSE y END", "z >> 18")
    return f"{rows}, {cols}"


def steps(name: str, qualities: dict[int, tuple[int, int]]) -> str:
    """``name``(p, v, u, q): steps of each plane; qualities: plane to (quality, example table)."""
    order = ", ".join(f"({z}, {p})" for z, p in enumerate(jpeg.ZIGZAG))
    parts = []
    for p, (quality, table) in qualities.items():
        scale = 5000 // quality if quality < 50 else 200 - 2 * quality
        base = ", ".join(f"({z}, {v})" for z, v in enumerate(jpeg.QUANT[table].split()))
        parts.append(f"SELECT CAST({p} AS BIGINT) AS p, place // 8 AS v, place % 8 AS u, least(greatest((b * {scale} + 50) // 100, 1), 255) AS q FROM (VALUES {order}) o(z, place) JOIN (VALUES {base}) t(z, b) USING (z)")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def coded(source: str, name: str, qualities: dict[int, tuple[int, int]]) -> str:
    """Expressions up to ``name``: what a decoder gives of the samples in ``source``, clipped."""
    half = "(abs(c) + 4 * q) // (8 * q)"
    back = f"{name}_q AS (SELECT {PARTS}, v, u, CAST(CASE WHEN c < 0 THEN -({half}) ELSE {half} END * q AS BIGINT) AS c FROM {name}_f JOIN {name}_s USING (p, v, u))"
    clip = f"{name} AS (SELECT {PARTS}, v, u, least(greatest(c + 128, 0), 255) AS c FROM {name}_i)"
    return ", ".join((forward(source, f"{name}_f"), steps(f"{name}_s", qualities), back, inverse(f"{name}_q", f"{name}_i"), clip))


def tiled(source: str, name: str, unit: int = 8) -> str:
    """``name``: blocks of the planes in ``source`` (image_id, p, x, y, c), edges repeated up to a multiple of ``unit``."""
    cells = f"{name}_e AS (SELECT image_id, p, max(x) AS mx, max(y) AS my FROM {source} GROUP BY image_id, p)"
    side = lambda c: f"generate_series(0, ({c} // {unit} + 1) * {unit} - 1)"
    grid = f"{name}_g AS (SELECT image_id, p, tx, unnest({side('my')}) AS ty, mx, my FROM (SELECT *, unnest({side('mx')}) AS tx FROM {name}_e))"
    out = f"{name} AS (SELECT g.image_id, g.p, tx // 8 AS bx, ty // 8 AS \"by\", ty % 8 AS v, tx % 8 AS u, c FROM {name}_g g JOIN {source} s ON s.image_id = g.image_id AND s.p = g.p AND s.x = least(tx, mx) AND s.y = least(ty, my))"
    return ", ".join((cells, grid, out))


def sample(name: str, plane: int, alias: str, x: str = "x", y: str = "y") -> str:
    """A join with plane ``plane`` at the given places."""
    return f"JOIN {name} {alias} ON {alias}.image_id = px.image_id AND {alias}.p = {plane} AND {alias}.bx = ({x}) // 8 AND {alias}.u = ({x}) % 8 AND {alias}.\"by\" = ({y}) // 8 AND {alias}.v = ({y}) % 8"


YCC = "(19595 * r + 38470 * g + 7471 * b + 32768) >> 16", "least(greatest((-11056 * r - 21712 * g + 32768 * b + 8421376) >> 16, 0), 255)", "least(greatest((32768 * r - 27440 * g - 5328 * b + 8421376) >> 16, 0), 255)"


def color_planes(name: str, source: str = "px") -> str:
    """``name``: luma as it is and chroma halved, of bytes r, g, b, edges repeated up to multiples of 16."""
    full = f"{name}_y AS (" + " UNION ALL ".join(f"SELECT image_id, {k} AS p, x, y, {e} AS c FROM {source}" for k, e in enumerate(YCC)) + ")"
    half = f"{name}_h AS (SELECT image_id, p, (8 * bx + u) // 2 AS x, (8 * \"by\" + v) // 2 AS y, CAST((sum(c) + 2) // 4 AS BIGINT) AS c FROM {name}_t WHERE p > 0 GROUP BY ALL)"
    out = f"{name} AS (SELECT * FROM {name}_t WHERE p = 0 UNION ALL SELECT image_id, p, x // 8, y // 8, y % 8, x % 8, c FROM {name}_h)"
    return ", ".join((full, tiled(f"{name}_y", f"{name}_t", 16), half, out))


#: (tab, symbol, code, bits) of the example tables: codes of a length go on from twice those of the length before.
CODES = (
    "counts AS (SELECT * FROM (VALUES "
    + ", ".join(f"({t}, {i}, {n})" for t, (c, _) in enumerate(jpeg.HUFFMAN) for i, n in enumerate(c.split(), 1))
    + ") t(tab, bits, n)), symbols AS (SELECT * FROM (VALUES "
    + ", ".join(f"({t}, {i}, {int(v, 16)})" for t, (_, s) in enumerate(jpeg.HUFFMAN) for i, v in enumerate(s.split()))
    + ") t(tab, nth, symbol)), firsts AS (SELECT a.tab, a.bits, a.n, coalesce(sum(b.n * (1 << (a.bits - b.bits))), 0) AS code, coalesce(sum(b.n), 0) AS nth FROM counts a LEFT JOIN counts b ON a.tab = b.tab AND b.bits < a.bits GROUP BY ALL), "
    "codes AS (SELECT s.tab, s.symbol, CAST(f.code + s.nth - f.nth AS INTEGER) AS code, f.bits FROM symbols s JOIN firsts f ON s.tab = f.tab AND s.nth >= f.nth AND s.nth < f.nth + f.n)"
)

GRAY = "gp AS (SELECT image_id, CAST(0 AS BIGINT) AS p, x, y, g AS c FROM px)"
GRAY_OUT = f"SELECT px.image_id, px.x, px.y, a.c AS c1 FROM px {sample('d', 0, 'a', 'px.x', 'px.y')}"
COLOR_OUT = "SELECT px.image_id, px.x, px.y, a.c AS c1, b.c AS c2, e.c AS c3 FROM {} AS px " + " ".join((sample("d", 0, "a", "px.x", "px.y"), sample("d", 1, "b", "px.x // 2", "px.y // 2"), sample("d", 2, "e", "px.x // 2", "px.y // 2")))


def gray(quality: int) -> str:
    """Expressions up to ``d``: a gray file's samples."""
    return ", ".join((GRAY, tiled("gp", "t"), coded("t", "d", {0: (quality, 0)})))


def color(quality: int, source: str = "px") -> str:
    """Expressions up to ``d``: luma and halved chroma of a colour file."""
    return ", ".join((color_planes("t", source), coded("t", "d", {0: (quality, 0), 1: (quality, 1), 2: (quality, 1)})))
