"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter per language, all with the same hash functions; the filters are stored across, so that
row r holds bit r of every language's filter.  The rows of an n-gram's hashes, and-ed, are the set
of languages that contain it.  A filter holds every n-gram that any text learnt of its language
has.  Counts of set bits per language over a text, less what a filter of that fill returns for
n-grams it doesn't hold, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import tidy, written

MULT = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Characters worked on at once.
BLOCK = 1 << 18
#: Lengths of n-grams.
LENGTHS = (3, 4, 5)
#: Rows of a filter table: 16 for each n-gram of the language with most, this many bits of row number at most.
LEAST_BITS, MOST_BITS = 10, 27
#: Bits of a row number inside a part of the table, as it is put together.
PART = 16
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def blocks(text: str | None, lengths: tuple[int, ...] = LENGTHS, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of the lower-cased letters, each other run a blank, a blank at both ends; block by block.

    Each n-gram comes once for each of its places, whatever the blocks; a text without a letter has none.
    """
    tail, end = np.array([32], np.uint64), len(text or "")
    for at in range(0, end, block):
        part = text[at : at + block].replace("\u03a3", "\u03c3").lower()  # no letter's small form depends on its neighbours
        c = np.frombuffer((part + " " * (at + block >= end)).encode("utf-32-le", "replace"), "<u4")
        x = np.where(_letters()[c], c, np.uint32(32)).astype(np.uint64)
        x = x[(x != 32) | (np.concatenate((tail[-1:], x[:-1])) != 32)]
        old, x = len(tail), np.concatenate((tail, x))
        h, found = np.zeros(len(x) + 1, np.uint64), []
        for n in range(1, max(lengths) + 1):
            h = (h[:-1] ^ x[n - 1 :]) * MULT[(n - 1) % len(MULT)]
            h ^= h >> np.uint64(29)
            if n in lengths and len(h):
                found.append(h[max(0, old - n + 1) :] ^ np.uint64(n))  # those with a character of this block
        if found:
            yield np.concatenate(found)
        tail = x[max(0, len(x) - max(lengths) + 1) :]


def grams(text: str | None, lengths: tuple[int, ...] = LENGTHS) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *blocks(text, lengths)])


@dataclass(frozen=True)
class Filters:
    langs: tuple[str, ...]
    #: One row of bits / 8 bytes of languages for each hash value: slice s holds languages 8 s to 8 s + 7.
    slices: np.ndarray
    #: Chance that a filter returns an n-gram that it doesn't hold.
    false: np.ndarray
    lengths: tuple[int, ...]

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Per language, how many of the n-grams its filter returns."""
        one, two = _rows(h, self.slices.shape[1])
        out = []
        for s in self.slices:
            per = np.bincount(s[one] & s[two], minlength=256)
            out += [per[BIT[b]].sum() for b in range(8)]
        return np.array(out[: len(self.langs)], np.float64)

    def predict(self, text: str | None) -> tuple[str, float]:
        total, found = 0, np.zeros(len(self.langs))
        for h in blocks(text, self.lengths):
            total += len(h)
            found += self.hits(h)
        if not self.langs or not total and not (text and any(map(str.isalpha, text))):
            return "und", 0.0
        share = np.maximum(0.0, (found / max(total, 1) - self.false) / (1 - self.false))
        best = int(np.argmax(share))
        sum_ = share.sum()
        return self.langs[best], float(share[best] / sum_) if sum_ > 0 else 0.0


def _rows(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An n-gram's two rows in a table of ``size``."""
    mask = np.uint64(size - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


#: For each bit of a byte, the bytes that have it.
BIT = [np.array([v for v in range(256) if v >> b & 1]) for b in range(8)]


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text mod ``folds`` is ``fold`` (null id: as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def counts(docs: DataFrame, lang: str, text: str, lengths: tuple[int, ...]) -> DataFrame:
    """(lang, gram long, n long): occurrences of each n-gram in all texts of each language, summed per task first."""

    def tally(batches):
        held: dict[str, list] = {}

        def shrink(parts):
            h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            u, inv = np.unique(h, return_inverse=True)
            return [(u, np.bincount(inv, c, len(u)).astype(np.int64))]

        waiting: dict[str, list] = {}
        size: dict[str, int] = {}

        def flush(key):
            if waiting.get(key):
                u, c = np.unique(np.concatenate(waiting.pop(key)), return_counts=True)
                held.setdefault(key, []).append((u, c))
                size[key] = 0
                if len(held[key]) >= 8:
                    held[key] = shrink(held[key])

        def out(key):
            u, c = shrink(held.pop(key))[0]
            for at in range(0, len(u), 100_000):
                some = u[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.string()), pa.array(some.view(np.int64)), pa.array(c[at : at + 100_000])], names=["lang", "gram", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([None], pa.int64()), pa.array([int(c.sum())], pa.int64())], names=["lang", "gram", "n"])

        for b in batches:
            for key, body in zip(b.column(0).to_pylist(), b.column(1)):
                waiting.setdefault(key, [])
                for h in blocks(body.as_py(), lengths):
                    waiting.setdefault(key, []).append(h)
                    size[key] = size.get(key, 0) + len(h)
                    if size[key] > BLOCK * 4:
                        flush(key)
                        if sum(len(p[0]) for p in held[key]) > 4 * BLOCK:  # new n-grams without end: no task holds them all
                            yield from out(key)
        for key in list(waiting):
            flush(key)
            yield from out(key) if key in held else [pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([None], pa.int64()), pa.array([0], pa.int64())], names=["lang", "gram", "n"])]

    found = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("body")).where("lang is not null and body is not null")
    return found.mapInArrow(tally, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _put(table: pa.Table) -> pa.Table:
    """A part of one slice of the table as bytes."""
    block = np.zeros(1 << PART, np.uint8)
    block[table["off"].to_numpy()] = table["mask"].to_numpy().astype(np.uint8)
    return pa.table({"part": table["part"][:1], "slice": table["slice"][:1], "block": pa.array([block.tobytes()], pa.binary())})


@tidy
def learn(docs: DataFrame, lang: str = "lang", text: str = "text", lengths: tuple[int, ...] = LENGTHS) -> Filters:
    """Filters of all documents given: each holds every n-gram of its language's texts.

    The table has 16 rows for each n-gram of the language with most, so that about one in 70
    n-grams that a filter doesn't hold is returned all the same, but 2 ** ``MOST_BITS`` rows at
    most (128 MB for 8 languages); beyond that filters fill up and the correction grows.  It is
    put together by the executors in parts.  The languages' list is ordered by size, then name.
    """
    table = written(counts(docs, lang, text, lengths), "grams")
    totals = {r[0]: r[1] for r in table.where("gram is null").groupBy("lang").agg(F.sum("n")).collect()}  # a row a language
    langs = tuple(sorted(totals, key=lambda k: (-totals[k], k)))
    table = table.where("gram is not null")
    most = max([1, *(r[1] for r in table.groupBy("lang").count().collect())])  # a row a language
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(16 * most)))))
    slices = np.zeros((max(1, -(-len(langs) // 8)), 1 << bits), np.uint8)
    if langs:
        names = table.sparkSession.createDataFrame([(k, i // 8, 1 << i % 8) for i, k in enumerate(langs)], "l string, slice int, bit int")
        both = table.join(F.broadcast(names), F.col("lang") == F.col("l"))  # a row a language
        low = F.lit((1 << bits) - 1).cast("long")
        rows = F.array(F.col("gram").bitwiseAND(low), F.shiftrightunsigned("gram", 32).bitwiseAND(low))
        cells = both.select("slice", "bit", F.explode(rows).alias("row")).groupBy("slice", "row").agg(F.bit_or("bit").alias("mask"))
        cells = cells.select("slice", F.shiftright("row", PART).alias("part"), F.col("row").bitwiseAND(F.lit((1 << PART) - 1).cast("long")).alias("off"), "mask")
        parts = cells.groupBy("part", "slice").applyInArrow(lambda t: _put(t), "part long, slice int, block binary")
        for r in parts.toLocalIterator():  # the table is bounded, and comes part by part
            at = r["part"] << PART
            slices[r["slice"], at : at + (1 << PART)] = np.frombuffer(r["block"], np.uint8)[: 1 << bits]
    fill = np.array([np.count_nonzero(slices[i // 8] & np.uint8(1 << i % 8)) / (1 << bits) for i in range(len(langs))])
    return Filters(langs, slices, fill**2, lengths)


def identified(docs: DataFrame, filters: Filters, text: str = "text") -> Column:
    """A column: struct(lang_pred, score) of whole texts."""
    shipped = docs.sparkSession.sparkContext.broadcast(filters)  # 2**bits bytes for 8 languages

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shipped.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(F.col(text))


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from text and non-null lang of rows that aren't held out.  ``und`` with score 0: a null
    text or one without a letter, or nothing to learn from.  score is the share of the best
    language's corrected count in all languages' (0 if no filter has any n-gram of the text).  Of
    languages with equal counts, none at all among them, the one with most n-grams learnt is
    given, then the first by name.  Texts are worked on in blocks, so a very long one needs no more
    memory than its own.  Repeated rows each come back and count each time.
    """
    filters = learn(docs.where(~held_out(F.col(doc_id))), lang, text, lengths)
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), identified(docs, filters, text).alias("x"))
    return out.select("doc_id", "held_out", "x.lang_pred", "x.score")
