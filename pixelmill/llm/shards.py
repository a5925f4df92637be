"""Sharding by weighted rendezvous hashing of record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered, unit_interval
from .storage import tidy, written


def rendezvous(key: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard (int) of a key: the s with the least -ln(u(key, s)) / weight(s).

    u is XXH64 of the key and the shard's number as a number between 0 and 1, so each shard wins
    in proportion to its weight.  A shard's own score depends on nothing else: adding a shard
    moves rows only into it, taking one away moves only its rows, and changing a weight moves
    rows only into or out of that shard.  Ties go to the lowest shard.  A null key is a key like
    any other: all such rows share a shard.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = [F.struct((-F.log(unit_interval(F.xxhash64(*key, F.lit(s)))) / F.lit(float(w))).alias("d"), F.lit(s).alias("s")) for s, w in enumerate(weights)]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["s"]


@tidy
def sharded(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", weights: Sequence[float] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the shards' weights alone decide.  size is the text's UTF-8
    bytes plus 1; a null text has no bytes, so size 1 and CRC-32 0, as an empty one.  slot numbers
    a shard's rows gaplessly from 0 in the order of doc_id, size and text_crc32.  grown_shard is
    the shard if there were one more of weight 1.  Repeated rows each come back, in one shard.
    """
    weights = list(weights or [1.0] * shards)
    data, key = F.coalesce(F.col(text), F.lit("")).cast("binary"), [F.col(doc_id)]
    dealt = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, 1.0]).alias("grown_shard"),
    )
    out = numbered(written(dealt, "dealt"), "shard", ["doc_id", "size", "text_crc32"], "slot", "shards")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, doc_id: str = "doc_id", weights: Sequence[float] | None = None) -> None:
    """Write all of ``docs`` as Parquet folders ``shard=N``; a shard is written by many tasks, never gathered in one."""
    docs.withColumn("shard", rendezvous([F.col(doc_id)], list(weights or [1.0] * shards))).write.partitionBy("shard").parquet(path)
