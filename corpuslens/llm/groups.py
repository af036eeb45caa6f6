"""Groups of any size as task groups of bounded size.

A group whose rows must all meet in pairs is cut by hash into chunks, and every pair of
chunks is a task group (keys, i, j, side), so that no task holds a whole group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_pairs(rows: DataFrame, keys: list[str], members: str, by: Column, chunk: int, order: list[str]) -> DataFrame:
    """``rows`` with i, j, side, where task groups stand together in every partition, side 0 first, each in ``order``.

    ``members`` is the number of rows of a row's group; ``by`` deals them into chunks.  A
    group of at most ``chunk`` rows is one task group."""
    names = [c for c in rows.columns if c != members]
    small = rows.filter(F.col(members) <= chunk).select(*names, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    # by hash, so that no task has to sort a large group to cut it up
    dealt = rows.filter(F.col(members) > chunk).withColumn("chunks", F.ceil(F.col(members) / chunk).cast("int")).withColumn("own", F.pmod(F.xxhash64(by), F.col("chunks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        *names, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = [*keys, "i", "j"]
    return small.unionByName(paired).repartition(parts, *whole).sortWithinPartitions(*whole, "side", *order)


def changes(t, keys: list[str]) -> np.ndarray:
    """Which rows differ from the row before in a key."""
    return np.logical_or.reduce([k[1:] != k[:-1] for k in (np.asarray(t.column(k)) for k in keys)])


def whole_groups(batches, keys: list[str], at_once: int):
    """Tables of some ``at_once`` rows that hold whole task groups; rows of a group stand together."""
    held: list[pa.RecordBatch] = []

    def cut_up(t: pa.Table):
        ends = np.append(np.flatnonzero(changes(t, keys)) + 1, t.num_rows)
        at = 0
        while at < t.num_rows:
            end = int(ends[max(np.searchsorted(ends, at + at_once, "right") - 1, np.searchsorted(ends, at, "right"))])
            yield t.slice(at, end - at)
            at = end

    for batch in batches:
        if not batch.num_rows:
            continue
        # the key's rows are together, so its first row is where the open group begins
        last = np.logical_and.reduce([k == k[-1] for k in (np.asarray(batch.column(k)) for k in keys)])
        cut = int(np.argmax(last))
        if held and cut == 0 and all(held[0].column(k)[0].as_py() == batch.column(k)[0].as_py() for k in keys):
            held.append(batch)
            continue
        done = pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
        yield from cut_up(done)
    if held:
        yield from cut_up(pa.Table.from_batches(held))
