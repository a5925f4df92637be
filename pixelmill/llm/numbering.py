"""Gapless numbering inside groups of any size, without a task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

LOW = (1 << 33) - 1


def numbered(df: DataFrame, group: str, order: list[str], number: str, label: str) -> DataFrame:
    """Add ``number`` (long, from 0, gapless inside each value of the non-null ``group``).

    Rows are numbered in the order of ``order``.  One range exchange sorts all rows by
    (group, order, a tie-break), so a group with a third of all rows spreads over as many
    tasks as its rows fill.  ``monotonically_increasing_id`` holds (partition, index in
    partition); the rows of a group before a partition come from a table of at most
    groups + partitions counts.
    """
    tie, at = "_nb_tie", "_nb_at"
    keys = [group, *order, tie]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    kept = written(ranged.withColumn(at, F.monotonically_increasing_id()), label).withColumn("_nb_part", F.shiftright(at, 33))
    heads = kept.groupBy(F.col(group).alias("_nb_group"), F.col("_nb_part").alias("_nb_in")).agg(F.min(at).alias("_nb_head"), F.count("*").alias("_nb_n"))
    before = F.sum("_nb_n").over(Window.partitionBy("_nb_group").orderBy("_nb_in").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("_nb_group", "_nb_in", (F.coalesce(before, F.lit(0)) - F.col("_nb_head")).alias("_nb_shift"))
    joined = kept.join(heads, (F.col(group) == F.col("_nb_group")) & (F.col("_nb_part") == F.col("_nb_in")))
    return joined.withColumn(number, F.col(at) + F.col("_nb_shift")).drop(at, "_nb_part", "_nb_group", "_nb_in", "_nb_shift")


def ranked(df: DataFrame, order: list[str], number: str, label: str) -> DataFrame:
    """Add ``number``: the place of each row in the order of ``order`` over the whole table, gapless from 0."""
    return numbered(df.withColumn("_nb_all", F.lit(0)), "_nb_all", order, number, label).drop("_nb_all")


def unit_interval(h: Column) -> Column:
    """A 64-bit hash as a double strictly between 0 and 1."""
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)
