"""Quality classifier: ordinal regression on graded ratings over hashed text.

P(grade >= j) = sigmoid(score - threshold j), thresholds in order, one score for all grades:
the sum of a document's feature weights over the square root of its tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of bytes: 0 white space and control, 1 letters, digits and non-ASCII, 2 other signs.
KINDS = np.array([0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A token's features: its whole and its first 4, 6 and 8 bytes.
PREFIXES = (4, 6, 8)
#: Hash of the feature "the same token as before".
REPEAT = 0xC6A4A7935BD1E995
#: Bytes hashed at once.
BLOCK = 1 << 18
PRIME = 0x9E3779B97F4A7C15


def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(BLOCK + 1, PRIME, np.uint64), np.full(BLOCK + 1, pow(PRIME, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_UP_DOWN: list = []


def _block(body: bytes, bits: int) -> tuple[np.ndarray, int]:
    if not _UP_DOWN:
        _UP_DOWN.extend(_powers())
    up, down = _UP_DOWN
    x = np.frombuffer(body, np.uint8)
    kind = KINDS[x]
    edge = np.flatnonzero(np.diff(kind, prepend=255, append=255))
    start, end = edge[:-1], edge[1:]
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=total[1:])
    parts = []
    for salt, n in enumerate((None, *PREFIXES)):
        s, e = (start, end) if n is None else (start[end - start > n], None)
        e = s + n if e is None else e
        h = (total[e] - total[s]) * down[s] + np.uint64(salt * 0xD1B54A32D192ED03 % (1 << 64))
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        parts.append((h >> np.uint64(64 - bits)).astype(np.int64))
        if n is None:  # one more feature wherever a token follows its like
            parts.append(np.full(np.count_nonzero(parts[0][1:] == parts[0][:-1]), REPEAT >> (64 - bits), np.int64))
    return np.concatenate(parts), len(start)


def features(text: bytes | None, bits: int) -> tuple[np.ndarray, int]:
    """Feature numbers of the whole text, with repeats, and its number of tokens. A token over a block's end counts as two."""
    if not text:
        return np.empty(0, np.int64), 0
    body = text.translate(LOWER)
    found, n, at, last = [], 0, 0, -1
    while at < len(body):
        to = min(len(body), at + BLOCK)
        if to < len(body):  # cut at a blank if there is one
            cut = body.rfind(b" ", at, to)
            to = cut + 1 if cut > at else to
        f, k = _block(body[at:to], bits)
        found.append(f)
        if k:  # the block's first k features are its tokens
            if f[0] == last:
                found.append(np.array([REPEAT >> (64 - bits)], np.int64))
            last = f[k - 1]
        n, at = n + k, to
    return np.concatenate(found), n


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def score(self, text: bytes | None) -> float:
        f, n = features(text, self.bits)
        return float(self.weights[f].sum(dtype=np.float64) / np.sqrt(n)) if n else 0.0

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2) ... for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, grades: int, rounds: int = 120, rate: float = 0.1, ridge: float = 2e-4, seen: int = 3) -> Model:
    """Maximum likelihood with a ridge, by full-batch Adam. rows: (feature numbers, values, grade)."""
    weights, cuts = np.zeros(1 << bits), np.linspace(-1.0, 1.0, grades - 1) if grades > 1 else np.empty(0)
    if not rows or grades < 2:
        return Model(weights.astype(np.float32), cuts, bits)
    index, value = np.concatenate([r[0] for r in rows]).astype(np.int32), np.concatenate([r[1] for r in rows]).astype(np.float32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    grade = np.array([r[2] for r in rows])
    common = np.bincount(index, minlength=1 << bits) >= seen  # what one or two rows have tells nothing of others
    index, value, owner = index[common[index]], value[common[index]], owner[common[index]]
    share = np.array([(grade >= j).mean() for j in range(1, grades)]).clip(1e-3, 1 - 1e-3)
    cuts = np.log((1 - share) / share)
    cuts = np.maximum.accumulate(cuts + np.arange(len(cuts)) * 1e-3)
    n = len(rows)
    # cuts[j] = base + sum of exp(gap), so that they stay in order
    state = np.concatenate(([cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))))
    m, v, mt, vt = np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(state), np.zeros_like(state)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, rounds + 1):
        cuts = state[0] + np.concatenate(([0.0], np.cumsum(np.exp(state[1:]))))
        score = np.bincount(owner, weights[index] * value, n)
        upper = np.concatenate((np.ones((n, 1)), sigmoid(score[:, None] - cuts[None, :]), np.zeros((n, 1))), axis=1)
        a, b = upper[np.arange(n), grade], upper[np.arange(n), grade + 1]  # P(>= grade), P(>= grade + 1)
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        ds = -(da - db) / n
        dcut = np.zeros(len(cuts))
        np.add.at(dcut, grade[grade > 0] - 1, da[grade > 0] / n)
        top = grade < grades - 1
        np.add.at(dcut, grade[top], -db[top] / n)
        dstate = np.concatenate(([dcut.sum()], [dcut[j + 1 :].sum() * np.exp(state[1 + j]) for j in range(len(cuts) - 1)]))
        grad = np.bincount(index, ds[owner] * value, 1 << bits) + ridge * weights
        for x, g, mm, vv, r in ((weights, grad, m, v, rate), (state, dstate, mt, vt, rate)):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            x -= r * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    cuts = state[0] + np.concatenate(([0.0], np.cumsum(np.exp(state[1:]))))
    return Model(weights.astype(np.float32), cuts, bits)


def train(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", grades: int = 3, bits: int = 18, max_rows: int = 4000) -> Model:
    """Fit on at most ``max_rows`` rated documents (whole texts), those with the least hash of the id.

    Rows with a null id, a null grade or a grade outside 0 .. grades - 1 are left out; without any
    the weights are 0.  A document rated several times counts with each rating, an id that several
    documents have with each of their texts; equal hashes are taken by id, then grade.
    """
    some = ratings.select(F.col(doc_id).alias("i"), F.col(grade).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").between(0, grades - 1))
    some = some.orderBy(F.xxhash64("i"), "i", "y").limit(max_rows)  # a bounded table
    rated = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("binary").alias("body")).join(F.broadcast(some), "i").orderBy(F.xxhash64("i"), "i", "y").limit(max_rows)

    @F.pandas_udf("struct<f: binary, v: binary>")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            f, n = features(t, bits)
            u, c = np.unique(f, return_counts=True)
            out.append((u.astype("<i4").tobytes(), (c / np.sqrt(max(n, 1))).astype("<f4").tobytes()))
        return pd.DataFrame(out, columns=["f", "v"])

    rows = rated.select(hashed("body").alias("x"), "y").select("x.f", "x.v", "y").toLocalIterator()
    return fit([(np.frombuffer(r[0], "<i4"), np.frombuffer(r[1], "<f4"), r[2]) for r in rows], bits, grades)


def graded(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with a struct column ``quality_tails`` (or a free name at the end): score, expected, tails, selected.

    expected is the mean grade; tails holds P(grade >= j) for j from 1; selected: the last of them
    is ``least`` or more.  Null and empty texts have no features: score 0, so the thresholds alone
    decide (they are kept if ``least`` or more of the rated documents without evidence would have
    the top grade).  Repeated rows each come back.
    """
    from .storage import free_name

    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights

    @F.pandas_udf("struct<score: double, expected: double, tails: array<double>, selected: boolean>")
    def rate(texts: pd.Series) -> pd.DataFrame:
        m = shipped.value
        scores = np.array([m.score(t) for t in texts], np.float64)
        tails = m.tails(scores)
        return pd.DataFrame({"score": scores, "expected": tails.sum(axis=1), "tails": list(tails), "selected": tails[:, -1] >= least if tails.shape[1] else np.ones(len(scores), bool)})

    return docs.withColumn(free_name(docs, "quality_tails"), rate(F.col(text).cast("binary")))


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of the label table: 0 toxic, 1 of low quality, 2 good; a null flag gives no grade."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when((F.col("quality") == 0) & (F.col("toxic") == 0), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
