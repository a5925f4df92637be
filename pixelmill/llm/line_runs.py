"""Line dedup: repeated runs of lines by prefix doubling; DataFrame operations only.

The corpus is a sequence of line ids, one per non-blank line, with a break after each document.
Prefix doubling ranks all suffixes by their first 1, 2, 4 ... lines: rank k + 1 is the place of the
pair (rank k here, rank k 2**k lines on) in sorted order, found with a distributed sort of the
distinct pairs.  Suffixes that share their first l lines are one interval of the suffix array (its
longest-common-prefix value is l or more), and with k = floor(log2 l) the interval is named by
(l, rank k at the start, rank k at the end less 2**k).

A maximal repeated run counts if it has ``min_words`` words.  Any line of a run with that many
words lies in a window of it that is minimal from its first line on, or minimal up to its last
line: two windows per line tell all, each at most ``min_words`` lines long, so the doubling ends
after log2(min_words) rounds however long runs are.  Of the copies of a window, the suffixes of one
interval, all but the first (by document id, then line) go; their union, taken as a running maximum
of ends along each document, is the maximal runs of later copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import ranked
from .storage import free_name, keyed, tidy, written

WORD = r"[^\x09-\x0D\x20]+"


def _solid(text: Column) -> Column:
    """The non-blank lines of a text, in order: (at: place among all lines, words, two hashes)."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("at"), F.regexp_count(line, F.lit(WORD)).cast("long").alias("w"), F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g")))
    return F.filter(lines, lambda x: x["w"] > 0)


def _windows(active: DataFrame, min_words: int) -> DataFrame:
    """(r, first, n): minimal windows of consecutive repeated lines with ``min_words`` words or more."""
    doc = Window.partitionBy("r").orderBy("i")
    run = active.withColumn("run", F.col("i") - F.row_number().over(doc)).withColumn("to", F.sum("w").over(doc)).withColumn("fro", F.col("to") - F.col("w"))
    whole = Window.partitionBy("r", "run")
    # both frames begin at the first row, so each row is added once; falling order makes "after" such a frame
    after = whole.orderBy(F.desc("fro")).rangeBetween(Window.unboundedPreceding, -min_words)
    before = whole.orderBy("to").rangeBetween(Window.unboundedPreceding, -min_words)
    ends = run.select(
        "r",
        "i",
        F.min("i").over(after).alias("next"),
        F.max("i").over(before).alias("prev"),
        F.when(F.max("to").over(whole) >= F.col("fro") + min_words, F.max("i").over(whole)).alias("tail"),
        F.when(F.min("fro").over(whole) <= F.col("to") - min_words, F.min("i").over(whole)).alias("head"),
    )
    last, first = F.coalesce(F.col("next") - 1, "tail"), F.coalesce(F.col("prev") + 1, "head")
    both = F.array(F.struct(F.col("i").alias("first"), last.alias("last")), F.struct(first.alias("first"), F.col("i").alias("last")))
    out = ends.select("r", F.explode(both).alias("x")).where("x.first is not null and x.last is not null")
    return out.select("r", "x.first", (F.col("x.last") - F.col("x.first") + 1).alias("n")).distinct()


def removed_lines(docs: DataFrame, key: str, doc_id: str, text: str, min_words: int = 50) -> DataFrame:
    """(r, i, at): lines (place among the non-blank and among all lines of the text) that are later copies of a run. ``key`` is unique."""
    lines = docs.select(F.col(key).alias("r"), F.col(doc_id).alias("d"), F.posexplode(_solid(F.col(text))).alias("i", "x"))
    lines = written(lines.select("r", "d", F.col("i").cast("long").alias("i"), "x.at", "x.w", "x.h", "x.g"), "lines")
    again = lines.groupBy("h", "g").agg(F.count("*").alias("m")).where("m > 1")
    again = ranked(again.select(F.col("h").alias("hh"), F.col("g").alias("gg")), ["hh", "gg"], "rank", "line-ranks")
    again = written(again, "line-ids")
    active = written(lines.join(again, (F.col("h") == F.col("hh")) & (F.col("g") == F.col("gg"))).select("r", "d", "i", "at", "w", "rank"), "repeated")
    windows = written(_windows(active, min_words).withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int")), "windows")
    depth = windows.groupBy("r").agg(F.max("k").alias("depth"))
    now = written(active.join(depth, "r").select("r", "i", "rank", "depth"), "suffixes")
    ranks, k = now.select("r", "i", "rank", F.lit(0).alias("k")), 0
    while (now := now.where(F.col("depth") > k)).limit(1).count():
        here = Window.partitionBy("r").orderBy("i")
        pairs = now.withColumn("then", F.when(F.lead("i", 1 << k).over(here) == F.col("i") + (1 << k), F.lead("rank", 1 << k).over(here)))
        pairs = written(pairs, "pairs")
        groups = pairs.where("then is not null").groupBy("rank", "then").agg(F.count("*").alias("m")).where("m > 1")
        groups = ranked(groups.select(F.col("rank").alias("one"), F.col("then").alias("two")), ["one", "two"], "pair_rank", "pair-ranks")
        groups = written(groups, "pair-ids")
        found = pairs.join(groups, (F.col("rank") == F.col("one")) & (F.col("then") == F.col("two"))).select("r", "i", F.col("pair_rank").alias("rank"), "depth")
        now, k = written(found, "suffixes"), k + 1
        # only suffixes whose first 2**k lines occur again are ranked; gaps stop the next round by the test of i
        ranks = ranks.unionByName(now.select("r", "i", "rank", F.lit(k).alias("k")))
    at = lambda name, place: ranks.select(F.col("r").alias(f"r_{name}"), F.col("i").alias(f"i_{name}"), F.col("k").alias(f"k_{name}"), F.col("rank").alias(name))
    one, two = at("one", "first"), at("two", "second")
    second = F.col("first") + F.col("n") - F.expr("shiftleft(1L, k)")
    named = windows.withColumn("second", second)
    named = named.join(one, (F.col("r") == F.col("r_one")) & (F.col("first") == F.col("i_one")) & (F.col("k") == F.col("k_one")))
    named = named.join(two, (F.col("r") == F.col("r_two")) & (F.col("second") == F.col("i_two")) & (F.col("k") == F.col("k_two")))
    order = docs.select(F.col(key).alias("r"), F.col(doc_id).alias("d"))
    named = named.select("r", "first", F.col("n").alias("lcp"), "one", "two").join(order, "r")
    place = F.struct(F.col("d").isNull().alias("z"), F.col("d"), F.col("r"), F.col("first"))
    named = written(named.withColumn("place", place), "suffixes-named")
    # an interval of the suffix array whose suffixes share their first ``lcp`` lines: its first place and its size
    intervals = named.groupBy("lcp", "one", "two").agg(F.min("place").alias("least"), F.count("*").alias("m")).where("m > 1")
    intervals = written(intervals.select(F.col("lcp").alias("l"), F.col("one").alias("a"), F.col("two").alias("b"), "least"), "intervals")
    later = named.join(intervals, (F.col("lcp") == F.col("l")) & (F.col("one") == F.col("a")) & (F.col("two") == F.col("b"))).where("place > least")
    # a line goes if an interval that begins at it or before reaches it: one running maximum, no row per line and interval
    ends = later.select("r", F.col("first").alias("i"), F.lit(None).cast("int").alias("at"), (F.col("first") + F.col("lcp") - 1).alias("last"))
    both = active.select("r", "i", "at", F.lit(None).cast("long").alias("last")).unionByName(ends)
    reach = F.max("last").over(Window.partitionBy("r").orderBy("i").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("reach", reach).where("at is not null and reach >= i").select("r", "i", "at")


@tidy
def maximal_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(doc_id, first, last, n_lines): maximal runs of later copies; places among all lines of the text, from 0.

    Neighbouring and overlapping intervals of one text are one run; blank lines don't end it and
    aren't counted.  Null and empty texts and an empty table have none.
    """
    docs, key = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "texts")
    gone = removed_lines(docs, key, "doc_id", "text", min_words)
    run = F.col("i") - F.row_number().over(Window.partitionBy("r").orderBy("i"))
    runs = gone.withColumn("run", run).groupBy("r", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n_lines"))
    return runs.join(docs.select(F.col(key).alias("r"), "doc_id"), "r").select("doc_id", "first", "last", "n_lines")


@tidy
def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> tuple[DataFrame, str, str]:
    """``docs`` with cut texts, a row key and the number of removed lines; the names of those two columns.

    Lines end at a line feed.  A run is consecutive lines of one document, blank ones (no word)
    aside; if it has ``min_words`` words or more and occurs before, its lines go.  "Before" is by
    document id (nulls last), then line; of rows with equal ids one comes first.  A run that
    overlaps its own earlier copy counts too.  Blank lines stay.  A text whose lines all go
    becomes empty; null texts stay null.
    """
    docs, key = keyed(docs, "texts")
    count = free_name(docs, "n_removed")
    gone = removed_lines(docs, key, doc_id, text, min_words).groupBy("r").agg(F.collect_list("at").alias("gone"))
    gone = written(gone, "removed").select(F.col("r").alias("_lr_key"), F.col("gone").alias("_lr_gone"))
    cols = docs.columns
    lines = F.split(F.col(text), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_lr_gone"))
    cut = F.when(F.col("_lr_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    # always a shuffle join: the removed lines have no size bound
    out = docs.join(gone.hint("shuffle_merge"), F.col(key) == F.col("_lr_key"), "left").select(*[cut.alias(c) if c == text else F.col(c) for c in cols], F.coalesce(F.size("_lr_gone"), F.lit(0)).alias(count))
    return out, key, count


#: The same by comparing the windows' own lines (DuckDB).
ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), s AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x09-\x0D\x20]+')) AS w FROM l
), t AS (
  SELECT doc_id, pos, line, w, row_number() OVER p AS i, sum(w) OVER p AS upto FROM s WHERE w > 0 WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
), d AS (
  SELECT doc_id, list(line ORDER BY i) AS body FROM t GROUP BY doc_id
), x AS (
  SELECT a.doc_id, a.i AS i, b.i AS e FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 50
  WHERE b.upto - a.upto + a.w >= 50 AND (b.upto - b.w - a.upto + a.w < 50 OR b.upto - a.upto < 50)
), k AS (
  SELECT x.doc_id, i, e, array_to_string(list_slice(body, i, e), chr(10)) AS run FROM x JOIN d USING (doc_id)
), r AS (
  SELECT doc_id, i, e, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM k
), g AS (
  SELECT DISTINCT t.doc_id, t.pos FROM r JOIN t ON r.doc_id = t.doc_id AND t.i BETWEEN r.i AND r.e WHERE nth > 1
), o AS (
  SELECT s.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY s.pos), '') AS text
  FROM s LEFT JOIN g ON s.doc_id = g.doc_id AND s.pos = g.pos GROUP BY s.doc_id
)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CASE WHEN documents.text IS NULL THEN NULL ELSE o.text END AS text
FROM documents LEFT JOIN o ON documents.doc_id = o.doc_id
"""
