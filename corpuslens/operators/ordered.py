"""Jobs on one ordered stream of rows, without one task that sees the whole stream.

A table is sorted by ranges and every row gets its place in the whole order: the place in
its task, behind the rows of the tasks before.  What depends on the rows before a row is
then computed in segments of the stream, with the state a segment begins with handed on from
the one before, until no state changes any more.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.sources.scratch import settled

#: Rows in a segment of the stream, and times the window at least.
SEGMENT, WINDOWS = 1 << 18, 4
#: Rows that one task may order.
FEW = 100_000


def numbered(df: DataFrame, order: list, place: str = "place") -> DataFrame:
    """Add ``place``: the row's number, from 0, in the order of the given columns.

    Rows are sorted by ranges and written; the driver learns one number for each range."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = settled(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = sorted(rows.groupBy(part.alias("part")).count().collect())  # one row for each range of the sort
    before, at = [], 0
    for r in sizes:
        before.append((r["part"], at))
        at += r["count"]
    table = df.sparkSession.createDataFrame(before, "_part long, _before long")
    joined = rows.withColumn("_part", part).join(F.broadcast(table), "_part")
    return joined.withColumn(place, F.col("_before") + F.col("_at") % (1 << 33)).drop("_at", "_part", "_before")


def earliest(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows in the given order.  A limit ends in one task, so more than FEW rows are told by their places."""
    return df.orderBy(*order).limit(n) if n <= FEW else numbered(df, order, "_place").filter(F.col("_place") < n).drop("_place")


def accepted_in_window(df: DataFrame, digest: Column, window: int, order: list, reset: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """Rows whose digest is not among those of the last ``window`` accepted rows, with their ``place``.

    ``reset`` marks rows before which the window is emptied.  A segment's decisions depend on the
    window it begins with; all segments are run, and those that began with another window
    than the one before ends with are run again.  Each round settles at least one more
    segment from the front; as a window seldom depends on what stood long before, few rounds
    are needed.  Digests and places are all that is moved, and a window has at most ``window`` digests."""
    size = max(segment, WINDOWS * window)
    flags = {"_digest": digest, "_reset": reset if reset is not None else F.lit(False)}
    rows = numbered(df.withColumns(flags), order)
    rows = settled(rows.withColumn("_segment", F.floor(F.col("place") / size)), "stream")
    brief = rows.select("_segment", "place", F.col("_digest").alias("digest"), F.col("_reset").alias("reset"))
    n = rows.agg(F.max("_segment").alias("n")).first()["n"]
    if n is None:
        return rows.drop("_digest", "_reset", "_segment")

    def run(t: pa.Table, held: list[str]) -> tuple[list[bool], list[str]]:
        queue, known, keep = deque(held), set(held), []
        for d, clear in zip(t["digest"].to_pylist(), t["reset"].to_pylist(), strict=True):
            if clear:
                queue.clear()
                known.clear()
            new = d not in known
            keep.append(new)
            if new:
                queue.append(d)
                known.add(d)
                if len(queue) > window:
                    known.discard(queue.popleft())
        return keep, list(queue)

    def decide(mine: pa.Table, state: pa.Table) -> pa.Table:
        """A row for the segment: its accepted places, the window it began with and the one it ends with."""
        mine = mine.sort_by("place")
        held = state["window"][0].as_py() if state.num_rows else []
        keep, end = run(mine, held) if mine.num_rows else ([], held)
        lists = [mine["place"].filter(pa.array(keep, pa.bool_())).to_pylist(), held, end]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
        number = (mine if mine.num_rows else state)["_segment"][0].as_py()
        return pa.table([pa.array([number], pa.int64()), *[pa.array([v], k) for v, k in zip(lists, kinds, strict=True)]], ["_segment", "places", "began", "ended"])

    shape = "_segment long, places array<long>, began array<string>, ended array<string>"
    start = df.sparkSession.createDataFrame([], "_segment long, window array<string>")
    todo, done = brief, None
    while True:
        decided = todo.groupBy("_segment").cogroup(start.groupBy("_segment")).applyInArrow(decide, shape)
        fresh = settled(decided if done is None else decided.unionByName(done), "segments")
        passed = fresh.select((F.col("_segment") + 1).alias("_segment"), F.col("ended").alias("window"))
        due = fresh.join(passed, "_segment", "left").withColumn("window", F.coalesce("window", F.array().cast("array<string>")))
        start = settled(due.filter("window <> began").select("_segment", "window"), "windows")
        if start.isEmpty():
            break
        # segments after a changed one see its new window in the next round
        todo = brief.join(start.select("_segment"), "_segment", "left_semi")
        done = fresh.join(start.select("_segment"), "_segment", "left_anti")
    chosen = fresh.select(F.explode("places").alias("place"))
    return rows.drop("_digest", "_reset", "_segment").join(chosen, "place", "left_semi")
