"""Near-duplicate removal at a Jaccard similarity of word shingles, without a miss.

Two sets of similarity s or more share one of the first n - ceil(s n) + 1 members of either in
any order that is the same for all sets.  Rare members come first, so that few sets meet at one.
Links of near SimHash fingerprints are tried with them.  Sets that meet must also be near by the
parities of their members: bit p of ``PARITY`` says whether an odd number of members falls to p,
so two sets differ in at least as many members as their parities differ in bits.  What is left is
verified by the exact similarity of the whole sets, first one pair of each set, then all pairs
that those links didn't connect.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .simhash import BITS, fingerprint_links
from .storage import keyed, small, tidy, written

#: Rows looked at for frequent members, one in so many; members listed at most.  They order the members, no more.
LOOK, LISTED = 16, 1 << 17
#: Bits of a set's parities, dealt by the first bits of a member.
PARITY = 512


def shingles(text: bytes | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``words`` words, in the text's order, as unsigned longs; fewer words: of them all; none: nothing.

    A-Z is lower-cased; words are maximal runs without ASCII white space.
    """
    parts = text.lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k, body, digest = min(words, len(parts)), b" ".join(parts), xxhash.xxh64_intdigest
    return np.array([digest(body[s:e], seed) for s, e in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _parities(members: np.ndarray) -> np.ndarray:
    """PARITY bits as longs, of distinct members (unsigned longs)."""
    at = (members >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY) & 1).astype(np.uint8)).view("<i8")


def _frequent(docs: DataFrame, text: str, words: int, seed: int) -> np.ndarray:
    """Members found in several of the rows looked at, rarest first."""

    @F.pandas_udf("array<long>")
    def members(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingles(t, words, seed)).view(np.int64) for t in texts])

    some = docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(LOOK)) == 0).select(F.explode(members(F.col(text).cast("binary"))).alias("h"))
    found = some.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(LISTED).collect()
    return np.array([r["h"] for r in reversed(found)], np.int64)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, label: str) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets are that similar."""
    left, right = (sets.select(F.col("key").alias(f"k{x}"), F.col("members").alias(f"m{x}")) for x in "ab")
    both = pairs.select("a", "b").join(left, F.col("a") == F.col("ka")).join(right, F.col("b") == F.col("kb"))
    shared = F.size(F.array_intersect("ma", "mb"))
    return written(both.where(shared >= similarity * (F.size("ma") + F.size("mb") - shared) - 1e-9).select("a", "b"), label)


def _meetings(whole: DataFrame, key: str, similarity: float) -> DataFrame:
    """(a, b, apart): distinct pairs of sets, by their smallest keys, that share so many members of both heads that they may be similar enough.

    Two passes over the heads.  The first only counts, with partial sums before its exchange, and
    keeps the members at which different sets meet; the second brings the sets that have those.
    """
    posts = whole.select(F.col(key).alias("k"), F.xxhash64("x.same").alias("c"), F.posexplode("x.head").alias("i", "h"))
    shared = posts.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
    shared = written(shared.select(F.col("h").alias("member")), "shared")
    met = written(posts.select("h", "k", "i").join(small(shared), F.col("h") == F.col("member"), "left_semi"), "met")
    crowd = met.join(whole.select(F.col(key).alias("key"), "x.same", "x.n", "x.bits"), F.col("k") == F.col("key"))
    crowd = written(crowd.groupBy("h", "same").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("i").alias("i"), F.first("bits").alias("bits")).drop("same"), "crowd")
    a, b = (crowd.select(*(F.col(x).alias(f"{x}{s}") for x in ("k", "n", "i", "h", "bits"))) for s in "ab")
    sized = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9
    apart = sum((F.bit_count(F.col("bitsa")[i].bitwiseXOR(F.col("bitsb")[i])) for i in range(PARITY // 64)), F.lit(0))
    # similarity s needs a shared part of s / (1 + s) of both sizes, so at most (1 - s) / (1 + s) of them may differ
    near = (1 + similarity) * apart <= (1 - similarity) * (F.col("na") + F.col("nb")) + 1e-9
    meets = a.join(b, (F.col("ha") == F.col("hb")) & (F.col("ka") < F.col("kb")) & sized & near)
    met = meets.groupBy("ka", "kb", "na", "nb").agg(F.count("*").alias("m"), F.max("ia").alias("ia"), F.max("ib").alias("ib"), F.first(apart).alias("apart"))
    # all further shared members lie after the last one met, and after the end of the head that ends first
    behind = F.least(F.col("na") - F.col("ia") - 1, F.col("nb") - F.col("ib") - 1, F.ceil(similarity * F.greatest("na", "nb") - 1e-9) - 1)
    enough = (1 + similarity) * (F.col("m") + behind) >= similarity * (F.col("na") + F.col("nb")) - 1e-9
    return met.where(enough).select(F.col("ka").alias("a"), F.col("kb").alias("b"), "apart")


@tidy
def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, seed: int = 42, radius: int = 4, together: int = 512) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (nulls last), of equal ones one.

    Rows are linked if the Jaccard similarity of their sets of word shingles is ``similarity`` or
    more; all such pairs count.  Null and wordless texts have the empty set and are linked to each
    other.  Members are 64-bit hashes.  Whole texts are written once with a key; rows that are few
    (of a checked number) are told to all tasks, else texts cross an exchange.
    """
    place = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text, words, seed))

    @F.pandas_udf("fp long, same binary, n int, head array<long>, bits array<long>")
    def described(texts: pd.Series) -> pd.DataFrame:
        order = place.value
        by = np.argsort(order)
        known = order[by]
        rows = []
        for t in texts:
            h = shingles(t, words, seed)
            u = np.unique(h)
            m, n = u.view(np.int64), len(u)
            rank = np.zeros(n, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, m), len(known) - 1)
                rank = np.where(known[at] == m, by[at] + 1, 0)
            head = m[np.lexsort((m, rank))][: n - math.ceil(similarity * n - 1e-9) + 1]
            rows.append((_majority(h) if n else 0, xxhash.xxh3_128_digest(m.tobytes()), n, head, _parities(u)))
        return pd.DataFrame(rows, columns=["fp", "same", "n", "head", "bits"])

    @F.pandas_udf("array<long>")
    def members(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingles(t, words, seed)).view(np.int64) for t in texts])

    # one look at the shingles: the struct is written whole, else each field would call the function again
    whole, key = keyed(docs.select(*(F.col(c).alias(f"in_{c}") for c in docs.columns), F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t")).withColumn("x", described("t")).drop("t"), "described")
    made = whole.select("doc_id", F.col(key).alias("row_key"), "x.same", "x.n", "x.fp")
    classes = written(made.groupBy("same").agg(F.min("row_key").alias("node"), F.min("n").alias("n"), F.min("fp").alias("fp")), "same")

    prints = written(classes.where("n > 0").groupBy("fp").agg(F.min("node").alias("first")), "prints")
    equal = classes.where("n > 0").join(prints, "fp").where("first != node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(prints.select("fp"), "fp", radius, together)
    for x in "ab":
        links = links.join(prints.select(F.col("fp").alias(f"f{x}"), F.col("first").alias(f"first_{x}")), F.col(x) == F.col(f"f{x}"))
    links = links.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    near = equal.unionByName(links).withColumn("apart", F.lit(-1))  # tried first
    pairs = written(near.unionByName(_meetings(whole, key, similarity)).groupBy("a", "b").agg(F.min("apart").alias("apart")), "pairs")

    wanted = written(pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct(), "wanted")
    found = whole.select(F.col(key).alias("key"), F.col(f"in_{text}").alias("t")).join(small(wanted), F.col("key") == F.col("w"), "left_semi")
    sets = written(found.select("key", members(F.col("t").cast("binary")).alias("members")), "sets")

    ends = pairs.select(F.col("b").alias("of"), F.struct("apart", F.col("a").alias("other")).alias("best"))
    first = ends.groupBy("of").agg(F.min("best").alias("best")).select(F.col("best.other").alias("a"), F.col("of").alias("b"))
    first = written(first, "first")
    good = _verified(first, sets, similarity, "near")
    linked = written(components(good, "a", "b"), "linked")
    rest = pairs.join(first, ["a", "b"], "left_anti")
    for x in "ab":
        rest = rest.join(linked.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}")), F.col(x) == F.col(f"n{x}"), "left")
    rest = written(rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "rest")
    more = _verified(rest, sets, similarity, "more")

    linked = written(components(good.unionByName(more), "a", "b"), "linked")
    ids = classes.join(linked, classes["node"] == linked["node"], "left").select(F.col("same").alias("of"), F.coalesce("root", classes["node"]).alias("class"))
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("row_key").alias("r"))
    placed = written(made.join(ids, F.col("same") == F.col("of")).select("class", "row_key", order.alias("order")), "placed")
    least = placed.groupBy("class").agg(F.min("order").alias("f"), F.count("*").alias("m"))
    least = written(least.where("m > 1").select(F.col("class").alias("in"), F.col("f.r").alias("first_key")), "firsts")
    gone = written(placed.join(small(least), F.col("class") == F.col("in")).where("row_key != first_key").select(F.col("row_key").alias("gone_key")), "gone")
    kept = whole.join(small(gone), F.col(key) == F.col("gone_key"), "left_anti")
    return kept.select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))
