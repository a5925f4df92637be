"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import tidy, written


def _state(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


@tidy
def components(links: DataFrame, a: str, b: str, most_rounds: int = 64) -> DataFrame:
    """(node, root): every node of ``links`` and the smallest node that links lead to.

    Large-star sends each node's larger neighbours to its smallest neighbour, small-star its
    smaller ones; the links become a forest of stars in about log(nodes) rounds.  A node with
    very many links is only ever aggregated (minimum) and joined by a shuffle join whose two
    sides Spark can split; nothing gathers its neighbours in one place.  Links with a null end
    and loops are left out.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = written(edges.distinct(), "links")
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "least")
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.least("w", "m").alias("v"))
        large = written(large.distinct(), "large")
        least = written(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "least")
        small = large.join(least, F.col("u") == F.col("w")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "small")
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError("the links did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
