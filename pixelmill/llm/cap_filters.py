"""Embedding near-dedup by spherical-cap filters of a random product code.

Vectors are turned by a random rotation and cut into blocks; each block has ``codes`` random unit
directions.  A filter is one direction per block; a vector passes it if the inner products with
them, summed, are ``bar`` or more; several such codes, each with its own rotation, are used.  The list of all filters that a vector passes is decoded block
by block: a part is dropped as soon as the best the other blocks can add stays under the bar.
Near vectors share a filter with high probability.  What meets in a filter is an id and the signs
of 128 random projections; pairs whose signs differ in few places are joined with their vectors and
verified in doubles.  Only filters in which near pairs are many, those of a large group of near
vectors, bring the vectors together, and there links are counted instead of listed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import keyed, small, tidy, written


_PARTS: dict = {}


def cap(dim: int, share: float) -> float:
    """The inner product with a unit vector that a share of all unit vectors (half at most) reach: the cosine of a spherical cap's angle.

    The sphere's points at an angle a from a pole are in proportion to sin(a) ** (dim - 2).
    """
    if dim < 2 or share >= 0.5:
        return 0.0
    angles = np.linspace(0, np.pi / 2, 1 << 16)
    weight = np.sin(angles) ** (dim - 2)
    within = np.concatenate(([0], np.cumsum((weight[1:] + weight[:-1]) / 2)))
    return float(np.cos(np.interp(share, within / (2 * within[-1]), angles)))



@dataclass(frozen=True)
class Code:
    """``copies`` independent codes of blocks x codes directions; a code lets a vector pass about ``expected`` filters."""

    blocks: int
    codes: int
    copies: int
    expected: float = 4.0
    seed: int = 7

    @property
    def filters(self) -> int:
        return self.codes**self.blocks

    def parts(self, dim: int) -> list[tuple]:
        """Rotation, directions by block and bar of each copy; a function of the seed and the sizes alone, made once a worker."""
        if (self, dim) in _PARTS:
            return _PARTS[self, dim]
        out = _PARTS[self, dim] = []
        for copy in range(self.copies):
            r = np.random.default_rng((self.seed, dim, self.blocks, self.codes, copy))
            turn, codes = np.linalg.qr(r.standard_normal((dim, dim)))[0], []
            for size in (len(x) for x in np.array_split(np.arange(dim), self.blocks)):
                c = r.standard_normal((self.codes, size))
                codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) * np.sqrt(size / dim))
            out.append((turn, codes, cap(dim, self.expected / self.filters) if self.filters > 1 else -2.0))
        return out

    def decoded(self, x: np.ndarray, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters of one copy that the rows of ``x`` (unit vectors) pass."""
        turn, codes, bar = part
        y = x @ turn
        cuts = np.cumsum([0, *(c.shape[1] for c in codes)])
        scores = [y[:, a:b] @ c.T for a, b, c in zip(cuts[:-1], cuts[1:], codes)]
        rest = [sum((s.max(axis=1) for s in scores[j + 1 :]), np.zeros(len(x))) for j in range(len(scores))]
        rows, found, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for s, more in zip(scores, rest):
            new = []
            for at in range(0, max(1, len(rows)), 1 << 14):
                r = rows[at : at + (1 << 14)]
                sums = total[at : at + (1 << 14), None] + s[r]
                i, c = np.nonzero(sums + more[r][:, None] >= bar)
                new.append((r[i], found[at : at + (1 << 14)][i] * self.codes + c, sums[i, c]))
            rows, found, total = (np.concatenate(z) for z in zip(*new))
        return rows, found

    def lists(self, x: np.ndarray, parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) over all copies, sorted; a copy's filters are numbered after those of the copies before."""
        found = [self.decoded(x, p) for p in parts]
        rows = np.concatenate([r for r, _ in found])
        filters = np.concatenate([f + k * self.filters for k, (_, f) in enumerate(found)])
        order = np.lexsort((filters, rows))
        return rows[order], filters[order]


def chosen(n: int, dim: int, cosine: float, recall: float = 0.995, together: int = 256, most: int = 64) -> Code:
    """A code for ``n`` vectors: a filter has about ``together`` of them if they lie apart.

    Copies are added until seeded random pairs at the given cosine share a filter with
    probability ``recall``; no data are looked at.  If ``most`` copies don't reach it, filters are
    made wider; the widest is one filter of all vectors, which are then compared without a miss.
    """
    r = np.random.default_rng(11)
    a, b = r.standard_normal((2, 800, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dim > 1:
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = cosine * a + np.sqrt(max(0.0, 1 - cosine**2)) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    else:
        b = a
    filters = max(256, 4 * n // together)
    while filters > 8:
        blocks = min(dim, 2 if filters <= 1 << 16 else 3 if filters <= 1 << 30 else 4)
        codes = max(2, round(filters ** (1 / blocks)))
        code, missed = Code(blocks, codes, most), np.ones(len(a), bool)
        for k, part in enumerate(code.parts(dim)):
            (ra, fa), (rb, fb) = code.decoded(a, part), code.decoded(b, part)
            missed[ra[np.isin(ra * code.filters + fa, rb * code.filters + fb)]] = False
            if missed.mean() <= 1 - recall:
                return Code(blocks, codes, k + 1)
        filters //= 4
    return Code(1, 1, 1)


#: Random directions of a sketch; vectors in one filter are alike to begin with, so 64 would let one in six of them pass.
SIGNS = 128


def signs(x: np.ndarray, seed: int = 13) -> np.ndarray:
    """The signs of each row's inner products with ``SIGNS`` random directions, as longs."""
    planes = np.random.default_rng((seed, x.shape[1])).standard_normal((x.shape[1], SIGNS))
    return np.packbits(x @ planes > 0, axis=1, bitorder="little").view("<i8")


def signs_apart(cosine: float, lost: float = 1e-4) -> int:
    """So many signs that a pair of that cosine differs in more with probability ``lost`` at most (each differs with angle / pi)."""
    p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    chance, k = 0.0, -1
    while chance < 1 - lost and k < SIGNS:
        k += 1
        chance += math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k)
    return k


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, every component finite, not all zero."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _decoded(vectors: DataFrame, codes: dict[int, Code]) -> DataFrame:
    """(c, n, dim, s0, s1, filters): a row for each class with all filters that it passes."""

    def decode(batches):
        for b in batches:
            c, n, vec = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            lengths = np.diff(vec.offsets.to_numpy())
            flat = vec.flatten().to_numpy().astype(np.float64)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            for dim in np.unique(lengths):
                own, code = np.flatnonzero(lengths == dim), codes[int(dim)]
                parts = code.parts(int(dim))
                for at in range(0, len(own), 512):
                    rows = own[at : at + 512]
                    x = flat[starts[rows][:, None] + np.arange(dim)]
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    i, f = code.lists(x, parts)
                    sizes = np.bincount(i, minlength=len(rows))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(f, pa.int64()))
                    s0, s1 = (pa.array(np.ascontiguousarray(s)) for s in signs(x).T)
                    yield pa.RecordBatch.from_arrays([pa.array(c[rows]), pa.array(n[rows]), pa.array(np.full(len(rows), dim, np.int32)), s0, s1, lists], names=["c", "n", "dim", "s0", "s1", "filters"])

    out = vectors.select("c", "n", "vec").mapInArrow(decode, "c long, n long, dim int, s0 long, s1 long, filters array<long>")
    return written(out, "decoded")


def _near(apart: int, dense: int):
    """Pairs of a filter (or of two of its parts) whose signs are near; none but a note if they are over ``dense`` a row."""

    def group(table: pa.Table) -> pa.Table:
        f, one, two = (table[k][0].as_py() for k in ("f", "one", "two"))
        order = np.argsort(table["c"].to_numpy())
        c, part, *words = (table[k].to_numpy()[order] for k in ("c", "part", "s0", "s1"))
        a, b = [], []
        for at in range(0, len(c), 256):
            near = sum(np.bitwise_count((s[at : at + 256, None] ^ s[None, :]).view(np.uint64)) for s in words) <= apart
            if one != two:
                near &= part[at : at + 256, None] != part[None, :]
            i, j = np.nonzero(near)
            later = j > i + at
            a.append(c[i[later] + at])
            b.append(c[j[later]])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a) > dense * len(c):
            a, b = np.array([-1]), np.array([-1])
        n = len(a)
        same = lambda v, kind: pa.array([v] * n, kind)
        return pa.table({"dim": same(table["dim"][0].as_py(), pa.int32()), "f": same(f, pa.int64()), "one": same(one, pa.int32()), "two": same(two, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return group


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)))


def _linked(pairs: DataFrame, rows: DataFrame, cosine: float) -> DataFrame:
    """(a, b, na, nb): pairs (a, b, f) of that cosine whose first common filter is f."""

    def verify(batches):
        for t in batches:
            out = []
            va, vb, fa, fb = (t.column(k) for k in ("va", "vb", "fa", "fb"))
            for k, f in enumerate(t.column("f").to_pylist()):
                x, y = (np.asarray(v[k].values, np.float64) for v in (va, vb))
                if _cosine(x, y) >= cosine and np.intersect1d(fa[k].values, fb[k].values, assume_unique=True)[0] == f:
                    out.append(k)
            yield t.select(["a", "b", "na", "nb"]).take(pa.array(out, pa.int64()))

    for k in "ab":
        pairs = pairs.join(rows.select(F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("vec").alias(f"v{k}"), F.col("filters").alias(f"f{k}")), F.col(k) == F.col(f"c{k}"))
    return pairs.select("a", "b", "na", "nb", "f", "va", "vb", "fa", "fb").mapInArrow(verify, "a long, b long, na long, nb long")


def _verify(cosine: float):
    def group(table: pa.Table) -> pa.Table:
        f, split = table["f"][0].as_py(), table["one"][0].as_py() != table["two"][0].as_py()
        c, n, part = table["c"].to_numpy(), table["n"].to_numpy(), table["part"].to_numpy()
        x = table["vec"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(c), -1)
        x /= np.abs(x).max(axis=1, keepdims=True)
        lengths = np.sqrt((x * x).sum(axis=1))
        close = (x @ x.T) / (lengths[:, None] * lengths[None, :])
        near = close >= cosine + 1e-9
        for i, j in zip(*np.nonzero(np.triu((close >= cosine - 1e-9) & ~near, 1))):  # too near the bar for a product's rounding
            near[i, j] = near[j, i] = float(np.dot(x[i], x[j]) / np.sqrt(np.dot(x[i], x[i]) * np.dot(x[j], x[j]))) >= cosine
        if split:
            near &= part[:, None] != part[None, :]
        np.fill_diagonal(near, False)
        own = np.flatnonzero(near.any(axis=1))
        near, c, n = near[np.ix_(own, own)], c[own], n[own]
        # a pair counts in the first filter that both pass
        lists = table["filters"].combine_chunks().take(pa.array(own))
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        who = np.repeat(np.arange(len(own)), sizes)[flat < f]
        names, column, times = np.unique(flat[flat < f], return_inverse=True, return_counts=True)
        met = np.zeros(near.shape, bool)
        shared = np.cumsum(times > 1) - 1
        keep = times[column] > 1
        who, column = who[keep], shared[column[keep]]
        for at in range(0, int((times > 1).sum()), 2048):
            here = (column >= at) & (column < at + 2048)
            marks = np.zeros((len(own), 2048), np.float32)
            marks[who[here], column[here] - at] = 1
            met |= marks @ marks.T > 0
        links = (near & ~met) @ n
        left, edges = np.ones(len(own), bool), []
        while left.any():  # one edge to each vector reached
            front = [int(np.argmax(left))]
            left[front[0]] = False
            while front:
                i = front.pop()
                hit = np.flatnonzero(near[i] & left)
                left[hit] = False
                front += hit.tolist()
                edges += [(int(c[i]), int(c[j])) for j in hit]
        some = np.flatnonzero(links)
        return pa.table({"c": pa.array(np.concatenate((c[some], [e[0] for e in edges])).astype(np.int64)), "other": pa.array([None] * len(some) + [e[1] for e in edges], pa.int64()), "links": pa.array(np.concatenate((links[some], np.zeros(len(edges)))).astype(np.int64))})

    return group


@tidy
def near_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95, together: int = 1024, recall: float = 0.995, dense: int = 8) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept.

    Equal vectors are one class; classes that share a filter are compared once, and n_links counts
    vectors.  A filter with over ``together`` classes is cut into parts that are compared two by
    two in tasks of their own, so all its pairs are compared and no task's memory grows with it.
    Where near pairs are over ``dense`` a class, vectors are brought to the filter and links are
    counted; elsewhere pairs are joined with their vectors.  Each link counts in the first filter
    that both ends pass.
    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors
    of different lengths don't link.  component_id is the smallest vec_id that links lead to, its
    own included; a null vec_id counts as a vector but is never the smallest.  kept: vec_id equals
    component_id (false for a null id).  Repeated rows each come back and link with each other.
    """
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vec"))
    ok = usable(F.col("vec"))
    rows, _ = keyed(rows.select("vec_id", F.when(ok, F.col("vec")).alias("vec"), F.when(ok, F.xxhash64("vec")).alias("h"), F.when(ok, F.xxhash64(F.lit(1), "vec")).alias("g")), "vectors")
    classes = rows.where("h is not null").groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("vec")).count().collect()}  # a row for each length of vectors
    codes = {dim: chosen(n, dim, cosine, recall) for dim, n in sizes.items()}
    decoded = _decoded(classes, codes)
    listed = decoded.select("dim", "c", "s0", "s1", F.explode("filters").alias("f"))
    crowded = listed.groupBy("dim", "f").agg(F.count("*").alias("m")).where(F.col("m") > together)
    crowded = written(crowded.select(F.col("dim").alias("d2"), F.col("f").alias("f2"), F.ceil(F.col("m") / together).cast("int").alias("parts")), "crowded")

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows (dim, f, c ...) in the filter's unit, or in all units of two parts that its part is in."""
        rows = rows.join(crowded, (F.col("dim") == F.col("d2")) & (F.col("f") == F.col("f2")), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("d2", "f2")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return rows.withColumn("one", F.least("part", "with")).withColumn("two", F.greatest("part", "with")).drop("parts", "with")

    met = dealt(listed).groupBy("dim", "f", "one", "two").applyInArrow(_near(signs_apart(cosine), dense), "dim int, f long, one int, two int, a long, b long")
    met = written(met, "met")
    whole = decoded.join(classes.select(F.col("c").alias("cc"), "vec"), F.col("c") == F.col("cc")).drop("cc")
    pairs = met.where("a >= 0").groupBy("a", "b").agg(F.min("f").alias("f"))
    sparse = written(_linked(pairs, whole, cosine), "pairs")
    hot = written(met.where("a < 0").select(F.col("dim").alias("d3"), F.col("f").alias("f3"), F.col("one").alias("u1"), F.col("two").alias("u2")), "dense")
    hot_rows = dealt(listed.drop("s0", "s1").join(hot.select(F.col("d3").alias("d4"), F.col("f3").alias("f4")).distinct(), (F.col("dim") == F.col("d4")) & (F.col("f") == F.col("f4")), "left_semi"))
    hot_rows = hot_rows.join(hot, (F.col("dim") == F.col("d3")) & (F.col("f") == F.col("f3")) & (F.col("one") == F.col("u1")) & (F.col("two") == F.col("u2")), "left_semi")
    hot_rows = hot_rows.join(whole.select(F.col("c").alias("c5"), "n", "vec", "filters"), F.col("c") == F.col("c5")).drop("c5")
    found = written(hot_rows.groupBy("dim", "f", "one", "two").applyInArrow(_verify(cosine), "c long, other long, links long"), "verified")
    links = found.where("links > 0").select("c", "links").unionByName(sparse.select(F.col("a").alias("c"), F.col("nb").alias("links"))).unionByName(sparse.select(F.col("b").alias("c"), F.col("na").alias("links")))
    links = links.groupBy("c").agg(F.sum("links").alias("links")).withColumnRenamed("c", "lc")
    edges = found.where("other is not null").select(F.col("c").alias("a"), F.col("other").alias("b")).unionByName(sparse.select("a", "b"))
    joined = components(edges, "a", "b")
    ids = written(classes.drop("vec").join(joined, F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c")).join(links, F.col("c") == F.col("lc"), "left"), "rooted")
    least = written(ids.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("m")).where("m > 1").select(F.col("root").alias("r2"), "least"), "least-ids")
    ids = written(ids.join(small(least), F.col("root") == F.col("r2"), "left").select(F.col("h").alias("h2"), F.col("g").alias("g2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("r2").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")), "labels")
    out = rows.join(ids, (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")), "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The same by brute force over all pairs (DuckDB).
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, list_dot_product(e, e) AS s FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (
  SELECT a.vec_id AS p, b.vec_id AS q FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.s > 0 AND b.s > 0
  WHERE list_dot_product(a.e, b.e) / sqrt(a.s * b.s) >= 0.95
), reach AS (
  SELECT vec_id AS p, vec_id AS q FROM v UNION SELECT reach.p, l.q FROM reach JOIN l ON reach.q = l.p
), c AS (
  SELECT p, min(q) AS component_id FROM reach GROUP BY p
), n AS (
  SELECT p, count(*) AS k FROM l GROUP BY p
)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.p = vec_id LEFT JOIN n ON n.p = vec_id
"""
