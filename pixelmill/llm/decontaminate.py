"""Benchmark decontamination by an Aho-Corasick automaton over normalised items.

An item's words are cut into blocks of half a window: every window of ``size`` consecutive words
holds a whole block, so the automaton needs the items' blocks alone, one node a character, not all
windows.  Where a block occurs in a text, the words on both sides are compared with the item's;
a run of ``size`` or more equal words is a run of windows.  Shorter items are patterns as a whole.
A text is read once, and hit words are mapped to their bytes in the original.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keyed, small, tidy, written

#: A-Z to a-z; digits, letters and all bytes of non-ASCII characters are kept, the rest is a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of items in one automaton (some 60 bytes of memory each, measured on random words); a larger benchmark takes several.
BLOCK_BYTES = 2 << 20
#: Blocks with more places than this are looked up by the windows around them, not place by place.
PLACES = 16


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes; none of null."""
    return text.translate(NORMAL).split() if text else []


class Scanner:
    """One automaton over items (id, text); it reads a text once and gives hit words and their bytes in the original."""

    def __init__(self, items: list[tuple[object, bytes | None]], size: int = 10, places: int = PLACES):
        self.size, self.step, seen = size, (size + 1) // 2, {}
        self.names, self.words = [], []
        spots, whole = defaultdict(list), defaultdict(set)
        for name, text in items:
            w = [seen.setdefault(x, x) for x in words_of(text)]  # equal words are one object
            if 0 < len(w) < size:
                whole[b" ".join(w)].add(name)
            elif w:
                for at in range(0, len(w) - self.step + 1, self.step):
                    spots[b" ".join(w[at : at + self.step])].append((len(self.words), at))
                self.names.append(name)
                self.words.append(w)
        self.windows: dict[bytes, set] = {}
        self.automaton = ahocorasick.Automaton()
        for key in spots.keys() | whole.keys():
            own = spots.get(key, [])
            if len(own) > places:
                self._windows(own)
                own = None
            self.automaton.add_word(f" {key.decode('latin-1')} ", (key.count(b" ") + 1, own, whole.get(key)))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def _windows(self, places: list[tuple[int, int]]) -> None:
        """The windows that hold a block at these places, and their items."""
        for i, at in places:
            w = self.words[i]
            for k in range(max(0, at + self.step - self.size), min(at, len(w) - self.size) + 1):
                self.windows.setdefault(b" ".join(w[k : k + self.size]), set()).add(self.names[i])

    def _runs(self, w: list[bytes], body: bytes) -> Iterator[tuple[int, int, object]]:
        """(first word, end word, items) of whole short items and of runs of windows."""
        found = list(self.automaton.iter(body.decode("latin-1")))
        if not found:
            return
        blanks = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)  # the k-th blank ends word k - 1
        ends = np.searchsorted(blanks, [f[0] for f in found]).tolist()
        done: dict[tuple, int] = {}  # (item, its place less the text's): where a run of equal words ends
        for end, (_, (n, places, whole)) in zip(ends, found):
            at = end - n
            if whole:
                yield at, end, whole
            if places is None:
                for k in range(max(0, end - self.size), min(at, len(w) - self.size) + 1):
                    items = self.windows.get(b" ".join(w[k : k + self.size]))
                    if items:
                        yield k, k + self.size, items
                continue
            for i, place in places:
                if done.get((i, place - at), 0) >= end:
                    continue
                own, a, b = self.words[i], 0, n
                while at > a and place > a and w[at - a - 1] == own[place - a - 1]:
                    a += 1
                while at + b < len(w) and place + b < len(own) and w[at + b] == own[place + b]:
                    b += 1
                done[i, place - at] = at + b
                if a + b >= self.size:
                    yield at - a, at + b, (self.names[i],)

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray, set]:
        """(number of words, sorted places of hit words, items)."""
        w = words_of(text)
        if not w or self.empty:
            return len(w), np.empty(0, np.int64), set()
        marks, items = np.zeros(len(w) + 1, np.int64), set()
        for first, end, own in self._runs(w, b" " + b" ".join(w) + b" "):
            marks[first] += 1
            marks[end] -= 1
            items.update(own)
        return len(w), np.flatnonzero(np.cumsum(marks[:-1]) > 0), items

    @staticmethod
    def bytes_of(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs of hit words as (start, end) bytes of the original text."""
        if not len(hit):
            return []
        kept = np.frombuffer(b" " + text.translate(NORMAL) + b" ", np.uint8) != 32
        edge = np.flatnonzero(kept[1:] != kept[:-1])  # start, end, start, end ...
        runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
        return [(int(edge[2 * r[0]]), int(edge[2 * r[-1] + 1])) for r in runs]

    def spans(self, text: bytes | None) -> list[tuple[int, int]]:
        return self.bytes_of(text, self.scan(text)[1]) if text else []


#: The automaton that a worker used last, by its block's name: tasks of a block follow each other.
_LAST: dict[str, Scanner] = {}


def _scanner(block: tuple[str, Broadcast], size: int) -> Scanner:
    if block[0] not in _LAST:
        _LAST.clear()
        _LAST[block[0]] = Scanner(block[1].value, size)
    return _LAST[block[0]]


def _blocks(items: Iterator, limit: int) -> Iterator[list]:
    block, n = [], 0
    for item, text in items:
        block.append((item, bytes(text) if text is not None else None))
        n += len(text or b"")
        if n >= limit:
            yield block
            block, n = [], 0
    if block:
        yield block


def _shipped(benchmark: DataFrame, item_id: str, item_text: str, limit: int) -> list[tuple[str, Broadcast]]:
    """The items in blocks of ``limit`` bytes, each told to the tasks that scan for it; the driver holds one at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(item_text).cast("binary")).toLocalIterator()
    context = benchmark.sparkSession.sparkContext
    return [(uuid.uuid4().hex, context.broadcast(b)) for b in _blocks(rows, limit)]


def _marked(docs: DataFrame, block: tuple[str, Broadcast] | None, size: int) -> DataFrame:
    """Per row: all columns but the last, the text, and of this block of items hits (word places), their bytes and item ids."""

    def scan(batches):
        s = _scanner(block, size) if block else Scanner([], size)
        for b in batches:
            found = []
            for t in b.column(b.num_columns - 1):
                text = t.as_py()
                n, hit, items = s.scan(text)
                spans = s.bytes_of(text, hit) if len(hit) else []
                found.append((n, len(hit), spans[0][0] if spans else None, spans[-1][1] if spans else None, hit.tolist(), sorted(items)))
            columns = list(zip(*found)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*b.schema.names[:-1], "n_words", "n_hit", "first_start", "last_end", "hits", "items"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(scan, f"{schema}, n_words long, n_hit long, first_start long, last_end long, hits array<long>, items array<string>")


@tidy
def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, first_start, last_end.

    A document's word is hit if it lies in any occurrence of a window of ``size`` consecutive
    item words (an item of fewer, but not none, is one window).  n_items counts the distinct item
    ids with occurring windows; a null id counts as the empty one.  first_start and last_end: bytes
    of the original text from the first hit word to the end of the last one (null without hits).
    Null and empty texts have no words and no hits; an empty benchmark hits nothing.  Repeated rows
    each come back.  The benchmark is a stated query set: blocks of ``block_bytes`` go through an
    automaton each, so that memory is bounded; with one block (the usual case) texts are read once.
    """
    blocks = _shipped(benchmark, item_id, item_text, block_bytes)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    if len(blocks) <= 1:
        out = _marked(source, blocks[0] if blocks else None, size)
    else:
        source = written(source.select("doc_id", F.monotonically_increasing_id().alias("r"), "body"), "bodies")
        parts = reduce(DataFrame.unionByName, [_marked(source, b, size) for b in blocks])
        out = parts.groupBy("r").agg(
            F.first("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.min("first_start").alias("first_start"),
            F.max("last_end").alias("last_end"),
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
        out = out.withColumn("n_hit", F.size("hits").cast("long"))
    items = F.array_sort(F.array_distinct("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "first_start", "last_end")


@tidy
def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; null texts stay.

    One block of items is a filter; with several, each reads the texts in tasks of its own and the
    rows that are hit go by their keys.
    """
    blocks = _shipped(benchmark, item_id, item_text, block_bytes)
    if not blocks:
        return docs
    if len(blocks) == 1:

        @F.pandas_udf("boolean")
        def hit(texts: pd.Series) -> pd.Series:
            s = _scanner(blocks[0], size)
            return texts.map(lambda t: len(s.scan(t)[1]) > 0).astype(bool)

        return docs.where(~hit(F.col(text).cast("binary")))
    whole, key = keyed(docs, "texts")
    source = whole.select(F.col(key).alias("gone"), F.col(text).cast("binary").alias("body"))
    found = reduce(DataFrame.unionByName, [_marked(source, b, size).where("n_hit > 0").select("gone") for b in blocks])
    gone = small(written(found.distinct(), "hit"))
    return whole.join(gone, F.col(key) == F.col("gone"), "left_anti").select(docs.columns)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
#: Each word with what lies before it.
_CHUNKS = r"regexp_extract_all(text, '[^0-9A-Za-z\x{80}-\x{10FFFF}]*[0-9A-Za-z\x{80}-\x{10FFFF}]+')"
#: The same with a join on windows (DuckDB).
ORACLE = f"""
WITH dw AS (SELECT doc_id, coalesce({_WORDS}, []) AS w, coalesce({_CHUNKS}, []) AS chunks FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM iw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM dwin JOIN win USING (n, k)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit, min(p) AS p0, max(p) AS p1 FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(array_to_string(list_sort(list_distinct(list(item))), ',')) AS h FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
  CAST(CASE WHEN n_hit > 0 THEN list_sum(list_transform(chunks[:p0], lambda c: strlen(c))) - strlen(w[p0]) END AS BIGINT) AS first_start,
  CAST(CASE WHEN n_hit > 0 THEN list_sum(list_transform(chunks[:p1], lambda c: strlen(c))) END AS BIGINT) AS last_end
FROM dw LEFT JOIN places ON dw.doc_id = places.doc_id LEFT JOIN found ON dw.doc_id = found.doc_id
"""
