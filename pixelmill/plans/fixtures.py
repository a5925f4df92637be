"""Rasters derived from the driver's tables, for Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import from_nrgba, num
from ..functions.geometry import Rect
from ..operators.raster import KEYS
from ..session import ship

#: No image here is higher; a bound for clipping.
TALL = 1 << 20
ORDERS, CUSTOMERS = Rect(0, 0, 100, TALL), Rect(0, 0, 50, TALL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 pixels wide, straight alpha, bytes."""
    t, alpha = table(spark, sf_dir, "orders"), {"1": 255, "2": 192, "3": 128, "4": 64, "5": 0}
    a = F.lit(0)
    for k, v in alpha.items():
        a = F.when(F.substring("o_orderpriority", 1, 1) == k, F.lit(v)).otherwise(a)
    price = lambda n: F.floor(F.col("o_totalprice") * n) % 256
    return t.select(num(0).alias("image_id"), (F.col("o_orderkey") % 100).alias("x"), F.floor(F.col("o_orderkey") / 100).alias("y"), price(1).alias("r"), (F.col("o_custkey") % 256).alias("g"), price(7).alias("b"), num(a).alias("a"))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`orders` in the canonical form."""
    return orders(spark, sf_dir).select(*KEYS, *(v.alias(c) for c, v in zip("rgba", from_nrgba("r", "g", "b", "a"))))


def many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`orders` cut into images of seven rows, opaque."""
    px = orders(spark, sf_dir)
    return px.select(F.floor(F.col("y") / 7).alias("image_id"), "x", (F.col("y") % 7).alias("y"), "r", "g", "b", num(255).alias("a"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 pixels wide, opaque, bytes."""
    t = table(spark, sf_dir, "customer")
    money = lambda n: F.pmod(F.floor(F.col("c_acctbal") * n), F.lit(256)).cast("long")
    return t.select(num(0).alias("image_id"), (F.col("c_custkey") % 50).alias("x"), F.floor(F.col("c_custkey") / 50).alias("y"), money(1).alias("r"), num(F.col("c_nationkey") * 10 % 256).alias("g"), money(3).alias("b"), num(255).alias("a"))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of 64 gray bytes for each embedding."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    level = F.least(F.greatest(F.floor((F.col("v").cast("double") + 1) * 127.5), F.lit(0)), F.lit(255))
    return t.select(num(0).alias("image_id"), num("i").alias("x"), num("vec_id").alias("y"), num(level).alias("g"))


def palette(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    t = table(spark, sf_dir, "part").where(F.col("p_partkey") < size)
    return t.select(num("p_partkey").alias("idx"), *((F.col("p_partkey") * k % 256).alias(c) for c, k in zip("rgb", (37, 91, 53))), num(255).alias("a"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    x0, y0 = F.col("event_id") % 200, F.floor(F.col("event_id") / 200)
    return t.select(F.col("event_id").alias("box_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 1 + F.col("user_id") % 16).alias("x1"), (y0 + 1 + F.floor("value") % 16).alias("y1"), F.col("event_type").alias("kind"))


SQL = {
    "px": "px AS (SELECT CAST(0 AS BIGINT) AS image_id, o_orderkey % 100 AS x, o_orderkey // 100 AS y, CAST(floor(o_totalprice) AS BIGINT) % 256 AS r, o_custkey % 256 AS g, CAST(floor(o_totalprice * 7) AS BIGINT) % 256 AS b, CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 255 WHEN '2' THEN 192 WHEN '3' THEN 128 WHEN '4' THEN 64 ELSE 0 END AS BIGINT) AS a FROM orders)",
    "can": "can AS (SELECT image_id, x, y, r * 257 * a // 255 AS r, g * 257 * a // 255 AS g, b * 257 * a // 255 AS b, a * 257 AS a FROM px)",
    "many": "many AS (SELECT y // 7 AS image_id, x, y % 7 AS y, r, g, b, CAST(255 AS BIGINT) AS a FROM px)",
    "cust": "cust AS (SELECT CAST(0 AS BIGINT) AS image_id, c_custkey % 50 AS x, c_custkey // 50 AS y, ((CAST(floor(c_acctbal) AS BIGINT) % 256) + 256) % 256 AS r, CAST(c_nationkey * 10 % 256 AS BIGINT) AS g, ((CAST(floor(c_acctbal * 3) AS BIGINT) % 256) + 256) % 256 AS b, CAST(255 AS BIGINT) AS a FROM customer)",
    "dst": "dst AS (SELECT image_id, x, y, r * 257 AS r, g * 257 AS g, b * 257 AS b, a * 257 AS a FROM cust)",
    "gray": "gray AS (SELECT CAST(0 AS BIGINT) AS image_id, CAST(i - 1 AS BIGINT) AS x, vec_id AS y, CAST(least(greatest(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5), 0), 255) AS BIGINT) AS g FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))",
    "pal": "pal AS (SELECT p_partkey AS idx, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 53 % 256 AS b, CAST(255 AS BIGINT) AS a FROM part WHERE p_partkey < 64)",
    "box": "box AS (SELECT event_id AS box_id, event_id % 200 AS x0, event_id // 200 AS y0, event_id % 200 + 1 + user_id % 16 AS x1, event_id // 200 + 1 + CAST(floor(value) AS BIGINT) % 16 AS y1, event_type AS kind FROM events)",
}
#: What each expression reads.
NEEDS = {"can": ["px"], "dst": ["cust"], "many": ["px"]}


def sql(body: str, *names: str, extra: str = "") -> str:
    """``body`` after the named expressions and those they need; ``extra``: more expressions."""
    used: list[str] = []
    for n in names:
        used += [k for k in (*NEEDS.get(n, []), n) if k not in used]
    return "WITH " + ", ".join([*(SQL[k] for k in used), *([extra] if extra else [])]) + " " + body
