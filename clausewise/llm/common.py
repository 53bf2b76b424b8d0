"""Shared helpers of the training-data operators.

Work tables go to the folder the session names in ``spark.checkpoint.dir``: every executor and the
driver see it, so a lost executor costs a re-read and not the lineage above it.  Only a local session
without the setting (tests, laptops) gets a folder of its own; a cluster without it is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere here: blank and the control characters tab .. return.
BLANKS = "\x20\t\n\x0b\x0c\r"

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="clausewise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def work_tables(spark: SparkSession, keep: int = 0) -> Iterator[list[str]]:
    """Deletes the tables that ``materialize`` writes inside the block when it ends, but for the ``keep`` last ones.

    What is returned from the block must not read the deleted ones any more.
    """
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        made = _scopes.pop()
        kept = made[len(made) - keep :] if keep else []
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in made[: len(made) - len(kept)]:
            place = hadoop.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        if _scopes:
            _scopes[-1] += kept


#: Bytes and rows of ids or short lists that are sent to every executor at most.
BROADCAST_BYTES = 16 << 20
BROADCAST_ROWS = 250_000


def small_side(df: DataFrame, label: str, width: Column | None = None) -> DataFrame:
    """``df`` as a written table, marked for broadcast if it is small; beyond the bounds the join shuffles.

    ``width`` is a row's size in bytes where that varies.
    """
    table = materialize(df, label)
    rows, size = table.agg(F.count("*"), F.sum(F.lit(16) if width is None else width)).first()
    return F.broadcast(table) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else table


#: A key is hot if it has more than this many rows and than this share of them, so at most ``1 / HOT_SHARE`` keys are.
HOT_ROWS = 2_000
HOT_SHARE = 1e-4


def join_facts(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS, counted: DataFrame | None = None, size: str | None = None, total: int | None = None) -> DataFrame:
    """``rows`` joined to ``facts`` (narrow rows, one for each key), inner or left, with hot keys of ``rows`` dealt out.

    The facts of hot keys, whose number is bounded by ``HOT_SHARE``, go to every executor, so the rows of such a key
    stay where they are; the others meet theirs in a shuffle.  A key's rows are its ``size`` in the written table
    ``facts``, or else counted in the written table ``counted`` (``rows`` itself if none is named), which has ``total`` rows.
    """
    if size:
        total = facts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        sizes = facts.select(key, F.col(size).alias("__rows"))
        facts = facts.drop(size)
    else:
        counted = rows if counted is None else counted
        total = counted.count() if total is None else total
        sizes = counted.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__rows"))
    hot = [r[0] for r in sizes.where(F.col("__rows") > max(hot_rows, total * HOT_SHARE)).select(key).collect()] if total > hot_rows else []
    if not hot:
        return rows.join(facts, key, how)
    names = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], rows.select(key).schema))
    known = F.broadcast(facts.join(names, key, "left_semi"))
    return rows.join(names, key, "left_anti").join(facts, key, how).unionByName(rows.join(names, key, "left_semi").join(known, key, how))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
