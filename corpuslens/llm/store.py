"""Shared storage for intermediate tables.

Lineage is cut by writing a table below the folder named by ``spark.checkpoint.dir``,
which the driver and all executors share; the warehouse, shared as well, where it is unset.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Base URI for intermediate tables: the session's setting, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused URI below the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/{app}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A lost executor costs at most the stages since the last settled table."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.settled_at = path
    return back


def discard(spark: SparkSession, path: str) -> None:
    """Delete a settled table or file folder through Spark's file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver next collects garbage.

    Listeners hold the last plan until they have handled its end, which takes a moment."""
    for _ in range(2):
        time.sleep(1)
        spark._jvm.System.gc()


def settled_path(df: DataFrame) -> str:
    """Folder of a table returned by :func:`settle`."""
    return df.settled_at


#: At most so many groups are taken for hot, and none of at most so many rows (of ids and digests), which any task can hold.
HOT, LEAST_HOT = 512, 1 << 16


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Join rows to groups (one row for each value of ``key``; ``size`` counts the group's rows).

    Groups with more than one row in HOT of ``total``, so at most HOT of them, and of more than
    LEAST_HOT rows are broadcast and their rows stay where they are; only rows of other groups
    are shuffled.  No group of a smaller table can be one of them."""
    if total <= LEAST_HOT:
        return rows.join(groups.hint("merge"), key)
    least = max(LEAST_HOT, total // HOT)
    hot, cold = groups.filter(F.col(size) > least), groups.filter(F.col(size) <= least)
    kept = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return rows.join(F.broadcast(hot), key).unionByName(kept)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
