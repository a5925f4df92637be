"""Vector best-fit packing of token pieces into sequences.

A piece's demand vector is (tokens, 1 document, tokens squared of attention).  All three follow
from its length, so a plan needs only the number of pieces of each length: at most ``capacity``
numbers, whatever the corpus' size.  The bin that takes a piece is the one with the best weighted
residual norm (or dot product) of the three.  The plan treats equal bins together; pieces then
find their place by their number among the pieces of their length.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .storage import tidy, written


@dataclass(frozen=True)
class Limits:
    """What a sequence can hold of each resource, and how much each counts in the choice of a bin.

    The cost of attention of a piece is the square of its length.  Without other values the
    number of documents and the cost of attention are those that the tokens alone imply.
    """

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def room(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)

    def need(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], np.int64)


def score(room: np.ndarray, need: np.ndarray, whole: np.ndarray, weights: np.ndarray, rule: str) -> np.ndarray:
    """One number for each row of ``room`` (what a bin has left); the smallest is the best fit.

    norm: weighted square of what would be left.  dot: less the weighted dot product of the
    piece's demand and the bin's load.  All parts are shares of ``whole``.
    """
    if rule == "norm":
        return (((room - need) / whole) ** 2) @ weights
    return -(((need / whole) * (1 - (room - need) / whole)) @ weights)


def plan(lengths: dict[int, int], limits: Limits = Limits(), rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Place ``lengths`` (length: number of pieces): (length, first number, count, first bin, offset).

    Lengths go from long to short, each piece to the bin with the best score of those that can
    take it under every limit.  A bin that took a piece scores better than before, so it is
    filled as far as it goes before the next.  Bins with equal room are neighbours in one row
    (first bin, number of bins): a length adds at most four rows, whatever the number of pieces.
    """
    whole, weights = limits.room(), np.array(limits.weights)
    if any(n <= 0 or (limits.need(n) > whole).any() for n in lengths):
        raise ValueError("a piece is empty or larger than a sequence")
    if (weights <= 0).any():
        raise ValueError("weights must be positive")
    room, first, count = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    segments, bins = [], 0
    for length in sorted(lengths, reverse=True):
        need, left, done = limits.need(length), lengths[length], 0
        fits = np.flatnonzero((room >= need).all(axis=1))
        order = fits[np.lexsort((first[fits], score(room[fits], need, whole, weights, rule)))]
        each = (room[order] // need).min(axis=1)  # pieces that one bin of the row can take
        used = int(np.searchsorted(np.cumsum(each * count[order]), left, "left"))  # rows filled before the one in which the pieces end
        jobs = [(int(room[r, 0]), int(first[r]), int(count[r]), int(k), room[r]) for r, k in zip(order[: used + 1], each)]
        new = []
        for tokens, bin0, n, k, own in jobs:
            full, some = min(n, left // k), left % k if left < n * k else 0
            for b, m, pieces in ((bin0, full, k), (bin0 + full, 1, some)):
                for j in range(pieces if m else 0):
                    segments.append((length, done + j * m, m, b, limits.tokens - tokens + j * length))
                if m and pieces:
                    new.append((own - pieces * need, b, m))
                    done, left = done + pieces * m, left - pieces * m
            rest = n - full - bool(some)
            if rest:
                new.append((own, bin0 + full + bool(some), rest))
        k = int((whole // need).min())
        for n, pieces in ((left // k, k), (1, left % k)):  # new bins
            for j in range(pieces if n else 0):
                segments.append((length, done + j * n, n, bins, j * length))
            if n and pieces:
                new.append((whole - pieces * need, bins, n))
                done, bins = done + pieces * n, bins + n
        keep = np.ones(len(room), bool)
        keep[order[: used + 1]] = False
        keep &= (room > 0).all(axis=1)
        room = np.concatenate((room[keep], np.array([r for r, _, _ in new], np.int64).reshape(-1, 3)))
        first = np.concatenate((first[keep], np.array([b for _, b, _ in new], np.int64)))
        count = np.concatenate((count[keep], np.array([n for _, _, n in new], np.int64)))
    return segments


_TOKENIZERS: dict = {}


class CachedTokenizer:
    """Ids of whole texts; equal runs between white space, and equal pieces, are encoded once.

    The tokenizer drops white space and its pieces never cross it, so a text's ids are those of
    its runs in order, a run's those of its pieces.  New runs are normalised together and split by
    the tokenizer's own pattern; new pieces go to its model as they are.  Both caches keep what
    was used lately: at ``most`` entries the current half becomes the old one, from which entries
    are taken back when they are met again.
    """

    #: Characters of text split at once.
    CHUNK = 1 << 20

    def __init__(self, path: str, most: int = 300_000):
        import json

        import regex
        from tokenizers import Tokenizer

        self.inner, self.most = Tokenizer.from_file(path), most
        self.inner.encode_special_tokens = True
        self.model = self.inner.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.pieces = regex.compile(made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.odd = regex.compile("[\x1c-\x1f]")
        self.blank = regex.compile(r"\s+")
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)} | {32: " "}
        self.runs: list[dict] = [{}, {}]
        self.words: list[dict] = [{}, {}]

    def _known(self, cache: list[dict], keys: set, make) -> dict:
        """The current half of ``cache`` with all ``keys`` in it; make: a list of new keys to their values."""
        young, old = cache
        lost = keys.difference(young)
        if old and lost:
            kept = [k for k in lost if k in old]
            young.update(zip(kept, map(old.__getitem__, kept)))
            lost.difference_update(kept)
        if lost:
            new = list(lost)
            young.update(zip(new, make(new)))
        return young

    def _trim(self, cache: list[dict]) -> None:
        if len(cache[0]) > self.most:
            cache[:] = [{}, cache[0]]

    def _encode(self, words: list[str]) -> list[bytes]:
        tokens = self.model.tokenize
        mapped = " ".join(words).encode("utf-8").decode("latin-1").translate(self.letters).split(" ")
        return [array("I", [t.id for t in tokens(w)]).tobytes() for w in mapped]

    def _normal(self, runs: list[str]) -> list[str]:
        joined = " ".join(runs)
        normal = (joined.lower() if joined.isascii() else self.inner.normalizer.normalize_str(joined)).split(" ")
        return normal if len(normal) == len(runs) else [self.inner.normalizer.normalize_str(r) for r in runs]

    def _spell(self, runs: list[str]) -> list[bytes]:
        runs.sort(key=str.isascii)
        foreign = bisect_left(runs, True, key=str.isascii)
        normal = self._normal(runs[:foreign]) + self._normal(runs[foreign:]) if 0 < foreign < len(runs) else self._normal(runs)
        find = self.pieces.findall
        split = [(r,) if r.isalpha() else find(r) for r in normal]  # letters alone are one piece
        known = self._known(self.words, {w for p in split for w in p}, self._encode)
        out = [known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p)) for p in split]
        self._trim(self.words)
        return out

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The runs of a text, by chunks that end at white space."""
        at = 0
        while at < len(text):
            end = at + self.CHUNK
            if end < len(text):
                gap = self.blank.search(text, end)
                end = gap.start() if gap else len(text)
            some = text[at:end] if at or end < len(text) else text
            yield [p for p in self.blank.split(some) if p] if self.odd.search(some) else some.split()
            at = end

    def all_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; those of short texts are looked up together."""
        out: list[np.ndarray] = []
        group: list[list[str]] = []
        size = 0

        def flush():
            nonlocal size
            known = self._known(self.runs, set().union(*group), self._spell)
            out.extend(np.frombuffer(b"".join(map(known.__getitem__, p)), "<u4") for p in group)
            self._trim(self.runs)
            group.clear()
            size = 0

        for text in texts:
            if len(text) <= self.CHUNK:
                group += self._parts(text) if text else [[]]
                size += len(text)
                if size > self.CHUNK:
                    flush()
                continue
            flush()
            done = len(out)
            for part in self._parts(text):
                group.append(part)
                flush()
            out[done:] = [np.concatenate(out[done:])]
        flush()
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.all_ids([text])[0]


def _tokenizer(path: str) -> CachedTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): a document's ids and ``end_id``, cut if over ``capacity``."""

    def cut(batches):
        t = _tokenizer(tokenizer)
        for b in batches:
            rows = []
            for key, own in zip(b.column(0).to_pylist(), t.all_ids([x or "" for x in b.column(1).to_pylist()])):
                ids = np.append(own, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    rows.append((key, k, at, len(own), zlib.crc32(own.tobytes()), own.astype(np.int64).tolist() if with_ids else None))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [b.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            made = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(made[: 6 if with_ids else 5], names=names[: 6 if with_ids else 5])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("body")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


@tidy
def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits(), rule: str = "norm", end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """All of ``docs`` in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is the end id alone.  Repeated rows are packed each on their own; a null
    doc_id is carried along.  An empty table gives no sequence.  The driver sees only the number
    of pieces of each length.
    """
    cut = written(pieces(docs, tokenizer, doc_id, text, limits.tokens, end_id, with_ids), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most limits.tokens rows
    segments = plan(counts, limits, rule)
    ranked = numbered(cut, "length", ["doc_id", "piece", "ids_crc32"], "place", "packing")
    table = np.array(sorted(segments), np.int64).reshape(-1, 5)  # grows with the lengths in use, not with the corpus
    heads = table[:, 0] << 40
    shipped = docs.sparkSession.sparkContext.broadcast((heads + table[:, 1], table[:, 3], table[:, 4], table[:, 1]))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        keys, first, offset, base = shipped.value
        n = number.to_numpy(np.int64)
        at = np.searchsorted(keys, (length.to_numpy(np.int64) << 40) + n, side="right") - 1
        return pd.DataFrame({"sequence_id": first[at] + n - base[at], "offset": offset[at]})

    out = ranked.withColumn("put", place("length", "place"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "put.sequence_id", "put.offset", *(["ids"] if with_ids else []))


def sequences(pieces_table: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, of ``packed(..., with_ids=True)``; a sequence is bounded by its limits."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces_table.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
