"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a table and reading it back: a lost executor then
costs one re-read, never a recomputation of what came before.
"""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; only a local session without the setting gets one of its own."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not found and spark.sparkContext.master.startswith("local"):
        if spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set(SETTING, found)
    if not found:
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    for paths in (_paths(spark), *_scopes()):  # before it is written: a part that a failed write leaves is known, too
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _paths(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_llm_paths"):
        spark._llm_paths = []
    return spark._llm_paths


_LOCAL = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


def tables_of(spark: SparkSession, df) -> list[str]:
    """Those of the tables written here that ``df`` (else nothing) still reads."""
    if not isinstance(df, DataFrame):
        return []
    files = df.inputFiles()
    held = {part for f in files for part in f.split("/") if part.startswith("llm-")}
    return [p for p in _paths(spark) if p.rsplit("/", 1)[1] in held]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables written here."""
    jvm, conf, known = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _paths(spark)
    for p in paths:
        if p in known:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)
            known.remove(p)


def release(spark: SparkSession) -> int:
    """Delete all tables written so far; call it when no result that reads them is needed. Returns their number."""
    paths = list(_paths(spark))
    drop(spark, paths)
    return len(paths)


@contextmanager
def scope():
    """The tables that this thread writes inside, as a growing list of paths."""
    made: list[str] = []
    _scopes().append(made)
    try:
        yield made
    finally:
        _scopes().pop()


def tidy(operator):
    """An operator that deletes the tables it wrote and that its result doesn't read any more.

    The result is a DataFrame, a tuple with one in front, or some other value that reads none.
    """

    @functools.wraps(operator)
    def run(*args, **options):
        with scope() as made:
            try:
                out = operator(*args, **options)
            except BaseException:
                if made and (spark := SparkSession.getActiveSession()):
                    drop(spark, list(made))
                raise
        spark = SparkSession.getActiveSession() or next(x.sparkSession for x in (*args, *options.values()) if isinstance(x, DataFrame))
        kept = tables_of(spark, out[0] if isinstance(out, tuple) else out)
        drop(spark, [p for p in made if p not in kept])
        return out

    return run


#: Rows of a long or two that every task may be told: some 2 MB as a hash table.
SMALL = 1 << 16


def small(keys: DataFrame) -> DataFrame:
    """A written table of keys with the way to join it: told to all tasks if it has at most ``SMALL`` rows, else a shuffle."""
    return F.broadcast(keys) if keys.count() <= SMALL else keys.hint("shuffle_merge")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def keyed(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written with a unique long per row, and that column's name.

    Repeated rows and repeated ids stay apart; the key is fixed once written.
    """
    name = free_name(df, "row_key")
    return written(df.withColumn(name, F.monotonically_increasing_id()), label), name
