"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint has 64 bits.  Bit position i gets a non-zero label m(i) of radius + 1 bits, dealt
out evenly; each non-zero v gives a mask with the positions whose label has odd overlap with v.
Any ``radius`` labels span less than the whole space, so some v overlaps all of them evenly:
two fingerprints that differ in at most ``radius`` bits agree on that v's mask.  Every pair in
the radius thus meets in one of 2**(radius + 1) - 1 tables, without exception.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .storage import keyed, small, tidy, written

BITS = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of whole text: majority of XXH64 bits over word shingles.

    A-Z is lower-cased; words are maximal runs without ASCII white space; shingles are joined by
    a space, repeats count.  Fewer words than a shingle: the whole sequence; none or null: 0.
    """
    parts = text.lower().split() if text else []
    if not parts:
        return 0
    if len(parts) <= words:
        h = xxhash.xxh64_intdigest(b" ".join(parts), seed)
        return h - (1 << 64) if h >> 63 else h
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    body, digest, n = b" ".join(parts), xxhash.xxh64_intdigest, len(parts) - words + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        h = np.array([digest(body[s:e], seed) for s, e in zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist())], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, words: int = 4, seed: int = 42) -> Column:
    """:func:`fingerprint` as a column; Arrow batches of UTF-8 bytes."""

    @F.pandas_udf(T.LongType())
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words, seed) for t in texts], dtype="int64")

    return made(text.cast("binary"))


def covering_masks(radius: int) -> list[int]:
    """The 2**(radius + 1) - 1 masks over 64 bits, as signed longs."""
    labels = [1 + i % ((2 << radius) - 1) for i in range(BITS)]
    masks = [sum(1 << i for i, m in enumerate(labels) if (m & v).bit_count() & 1) for v in range(1, 2 << radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _ball(mask: int, radius: int) -> list[int]:
    """All differences of at most ``radius`` bits outside ``mask``, as signed longs."""
    free = [i for i in range(BITS) if not (mask >> i) & 1]
    found = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(free, k)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def _spanning(radius: int):
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))
    def made(groups: pd.Series) -> pd.Series:
        out = []
        for g in groups:
            x = np.sort(np.asarray(g, np.int64)).view(np.uint64)
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
            left, links = np.ones(len(x), bool), []
            while left.any():  # breadth first: one link to each fingerprint reached
                edge = [int(np.argmax(left))]
                left[edge[0]] = False
                while edge:
                    i = edge.pop()
                    hit = np.flatnonzero(near[i] & left)
                    left[hit] = False
                    edge += hit.tolist()
                    links += [(int(x[i].view(np.int64)), int(x[j].view(np.int64))) for j in hit]
            out.append(links)
        return pd.Series(out)

    return made


def fingerprint_links(prints: DataFrame, fp: str, radius: int = 4, together: int = 512) -> DataFrame:
    """Links (a, b) of at most ``radius`` bits that connect all that such links connect.

    ``prints`` has distinct fingerprints.  Buckets of two give their pair.  Buckets of up to
    ``together`` are searched in one array and give a spanning forest.  Larger ones are never
    gathered: each fingerprint is dealt to all points within radius / 2 of it on the bits that
    the bucket leaves open.  Two fingerprints share a point exactly if they differ in at most
    ``radius`` bits, and each is linked to the smallest at its point: rows in proportion to the
    bucket, whatever its size.  ``radius`` must be even.
    """
    if radius % 2 or not 0 < radius < BITS:
        raise ValueError("radius must be an even number of bits")
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(m).cast("long")).alias("k")) for t, m in enumerate(masks)))
    keys = prints.select(F.col(fp).alias("fp"), F.explode(tables).alias("x")).select("x.t", "x.k", "fp")
    buckets = written(keys.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "buckets")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = buckets.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    crowds = written(keys.join(buckets.where("n > 2").select("t", "k", "n"), ["t", "k"]), "crowds")
    groups = crowds.where(F.col("n") <= together).groupBy("t", "k").agg(F.collect_list("fp").alias("g"))
    spans = groups.select(F.explode(_spanning(radius)("g")).alias("x")).select("x.a", "x.b")
    large = crowds.where(F.col("n") > together)
    if large.limit(1).count():
        spark = prints.sparkSession
        balls = spark.createDataFrame([(t, _ball(m, radius // 2)) for t, m in enumerate(masks)], "t int, ball array<long>")
        points = large.join(F.broadcast(balls), "t").select("t", "k", "fp", F.explode("ball").alias("d")).select("t", "k", "fp", F.col("fp").bitwiseXOR(F.col("d")).alias("p"))
        least = written(points.groupBy("t", "k", "p").agg(F.min("fp").alias("a"), F.count("*").alias("m")).where("m > 1").select("t", "k", "p", "a"), "points")
        spans = spans.unionByName(points.join(least, ["t", "k", "p"]).where("a != fp").select("a", F.col("fp").alias("b")))
    return pairs.unionByName(spans).where(apart <= radius).distinct()


def _classes(made: DataFrame, radius: int, together: int) -> DataFrame:
    """(print, class, component_id) of each fingerprint in (doc_id, fp)."""
    prints = written(made.groupBy("fp").agg(F.min("doc_id").alias("rep")), "prints")
    linked = written(components(fingerprint_links(prints, "fp", radius, together), "a", "b"), "linked")
    least = written(linked.join(prints, linked.node == prints.fp).groupBy("root").agg(F.min("rep").alias("least")), "least-ids")
    # a large component's prints don't meet at its root: the roots are few, or Spark may split the join
    ids = prints.join(linked, prints.fp == linked.node, "left").join(small(least), "root", "left")
    return written(ids.select(F.col("fp").alias("print"), F.coalesce("root", "fp").alias("class"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")), "classes")


@tidy
def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, radius: int = 4, together: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp long, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most ``radius`` bits lead to, its own
    included.  Null and wordless texts have fingerprint 0 and are linked like any other; a null
    doc_id never is the smallest, so a component of nulls alone has a null id.  Repeated rows
    each come back.
    """
    made = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), words, seed).alias("fp")), "fingerprints")
    ids = _classes(made, radius, together)
    out = made.join(ids, made.fp == ids.print)
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@tidy
def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, radius: int = 4, together: int = 512) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (nulls last), of equal ones one.

    Whole rows are written once and cross one exchange; all the rest is on ids and fingerprints.
    """
    whole = docs.select(*(F.col(c).alias(f"in_{c}") for c in docs.columns), F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), words, seed).alias("fp"))
    whole, key = keyed(whole, "fingerprints")
    made = whole.select("doc_id", "fp", F.col(key).alias("row_key"))
    ids = _classes(made, radius, together)
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("row_key").alias("r"))
    first = made.join(ids, made.fp == ids.print).groupBy("class").agg(F.min(order).alias("f"))
    first = written(first.select(F.col("f.r").alias("first_key")), "firsts")
    # always a shuffle join: the rows that stay have no size bound
    kept = whole.join(first.hint("shuffle_merge"), F.col(key) == F.col("first_key"), "left_semi")
    return kept.select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))
