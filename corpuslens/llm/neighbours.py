"""Nearest neighbours by a block matrix join.

Vectors are reduced where they are read to int8 codes with a scale and the exact norm of
what rounding lost; only codes travel.  Queries and candidates are dealt into blocks, and
each pair of blocks is one task group.  Products of int8 tiles give every distance up to a
known error; a pair survives if its lower bound does not exceed the k-th smallest upper
bound of its query, first within its block and then over all blocks.  Of candidates with
equal vectors a block keeps as many as can be among the nearest, so a vector that many
rows share does not answer with all of them.  Survivors fetch
their original vectors and are computed again in double precision; heaps keep the k
nearest of each query.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.store import settle, table

#: Codes in a block of queries, in a block of candidates (at least the second number), and in a tile.
QUERY_BLOCK, CANDIDATE_BLOCK, LEAST_BLOCK, TILE = 16384, 65536, 4096, 1024
CODES = "vec_id long, dim int, code binary, scale double, norm double, lost double, digest binary"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, the norm of what they stand for, and the norm of the rounding error, per row."""
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(x).max(1) / 127
        codes = np.rint(x / scale[:, None])
        lost = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))
        norm = np.sqrt((codes**2).sum(1)) * scale
    return np.nan_to_num(codes).astype(np.int8), scale, norm, lost


def coded(vectors: DataFrame) -> DataFrame:
    """int8 codes of vectors (columns vec_id, embedding), with a digest of the vector itself."""

    def run(batches):
        for batch in batches:
            ids, lists = np.asarray(batch.column(0)), batch.column(1)
            values = np.asarray(lists.flatten(), float)
            sizes = np.asarray(lists.value_lengths())
            at = np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                own_values = values[at[own][:, None] + np.arange(n)] + 0.0  # zeros have one sign
                codes, scale, norm, lost = quantised(own_values)
                digest = pa.array([xxhash.xxh3_128_digest(v.tobytes()) for v in own_values], pa.binary())
                columns = [pa.array(ids[own]), pa.array(np.full(len(own), n, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, (scale, norm, lost)), digest]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "code", "scale", "norm", "lost", "digest"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, CODES)


def exact_distances(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed in the order of the components."""
    return np.sqrt(np.cumsum((rows - q) ** 2, axis=1)[:, -1])


def first_of_equals(t: pa.Table, k: int) -> pa.Table:
    """Of rows with equal vectors the k with the smallest ids: of equal distances no others can be among the k nearest."""
    equal = np.unique(np.frombuffer(b"".join(t["digest"].to_pylist()), "V16"), return_inverse=True)[1] if t.num_rows else np.zeros(0, np.int64)
    order = np.lexsort((np.asarray(t["vec_id"]), equal))
    new = np.flatnonzero(np.append(True, np.diff(equal[order]) != 0))[: len(order)]
    place = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return t.take(pa.array(np.sort(order[place < k])))


class Codes:
    """Codes of one length, as arrays."""

    def __init__(self, t: pa.Table, dim: int):
        t = t.filter(pa.array(np.asarray(t["dim"]) == dim))
        self.ids, self.scale, self.norm, self.lost = (np.asarray(t[c]) for c in ("vec_id", "scale", "norm", "lost"))
        self.codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.int8).reshape(len(self.ids), dim)


def bounded_pairs(q: Codes, c: Codes, k: int):
    """(query row, candidate row, lower bound, upper bound) of pairs that may be among the k nearest of the block."""
    kind = np.float32 if q.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64  # products stay exact whole numbers
    for first in range(0, len(q.ids), TILE):
        a = slice(first, first + TILE)
        best = np.full((len(q.ids[a]), k), np.inf)
        found = []
        left = q.codes[a].astype(kind)
        for at in range(0, len(c.ids), TILE):
            b = slice(at, at + TILE)
            with np.errstate(over="ignore", invalid="ignore"):
                dots = (left @ c.codes[b].astype(kind).T).astype(float) * q.scale[a, None] * c.scale[b]
                about = np.sqrt(np.maximum(q.norm[a, None] ** 2 + c.norm[b] ** 2 - 2 * dots, 0))
                error = q.lost[a, None] + c.lost[b] + 1e-6 * (q.norm[a, None] + c.norm[b])
                low, high = about - error, about + error
            low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf  # bounds that overflow decide nothing
            low[c.ids[b] == q.ids[a, None]] = high[c.ids[b] == q.ids[a, None]] = np.nan
            best = np.sort(np.partition(np.hstack([best, np.where(np.isnan(high), np.inf, high)]), k - 1, axis=1)[:, :k], axis=1)
            x, y = np.nonzero(low <= best[:, -1:])
            found.append((x, y + at, low[x, y], high[x, y]))
        x, y, low, high = (np.concatenate(f) for f in zip(*found, strict=True))
        stay = low <= best[x, -1]
        yield x[stay] + first, y[stay], low[stay], high[stay]


def block(k: int):
    """Surviving pairs of a block of queries and a block of candidates."""
    kinds = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
        for dim in set(np.asarray(a["dim"]).tolist()) & set(np.asarray(b["dim"]).tolist()):
            q, c = Codes(a, dim), Codes(first_of_equals(b, k + 1), dim)  # one of them may be the query's own
            for x, y, low, high in bounded_pairs(q, c, k):
                for column, v in zip(out, (q.ids[x], c.ids[y], low, high), strict=True):
                    column.append(v)
        return pa.table({n: pa.array(np.concatenate(v), t) for (n, t), v in zip(kinds, out, strict=True)})

    return run


def recomputed(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of pairs with their vectors (q, c); of each query the k nearest of a batch."""

    def run(batches):
        for batch in batches:
            size = np.asarray(batch.column("c").value_lengths())
            same = np.flatnonzero(np.asarray(batch.column("q").value_lengths()) == size)
            heaps: dict[int, list] = defaultdict(list)  # largest on top: (-distance, -vec_id)
            ids, vecs = np.asarray(batch.column("query_id")), np.asarray(batch.column("vec_id"))
            for n in np.unique(size[same]).tolist():
                own = same[size[same] == n]
                q, c = (np.asarray(batch.column(x).take(pa.array(own)).flatten(), float).reshape(-1, n) for x in ("q", "c"))
                with np.errstate(over="ignore"):
                    distance = exact_distances(q, c)
                for i, d, v in zip(ids[own].tolist(), distance.tolist(), vecs[own].tolist(), strict=True):
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], (-d, -v))
                    elif (-d, -v) > heaps[i][0]:
                        heapq.heapreplace(heaps[i], (-d, -v))
            rows = [(i, -v, -d) for i, heap in heaps.items() for d, v in heap]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for the k nearest candidates of each query.

    Both tables have vec_id and embedding; other columns, whatever their names, are
    ignored.  Rows with the query's own vec_id are no candidates; only vectors of the
    query's length are.  Equal distances go to the smaller vec_id.  A query id that
    repeats is answered for its smallest vector; candidate rows that repeat each count.
    Null ids take no part, nor do vectors that are null, empty, zero or hold null or
    non-finite numbers.  An empty table on either side gives no rows.
    """
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    asked = settle(clean(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = candidates.count()
    rows = max(1, -(-asked.count() // QUERY_BLOCK))
    columns = max(1, -(-n // CANDIDATE_BLOCK), min(parts // rows, n // LEAST_BLOCK))
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded(asked).withColumn("r", F.pmod(F.xxhash64("vec_id"), F.lit(rows)).cast("int")).withColumn("c", across(columns))
    right = coded(clean(candidates)).withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(columns)).cast("int")).withColumn("r", across(rows))
    found = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(block(k), "query_id long, vec_id long, low double, high double")
    ordered = Window.partitionBy("query_id").orderBy("high").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    survivors = found.withColumn("bound", F.nth_value("high", k).over(ordered)).filter("bound IS NULL OR low <= bound").select("query_id", "vec_id").distinct()
    pairs = survivors.join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).hint("merge"), "query_id")
    pairs = pairs.join(clean(candidates).select("vec_id", F.col("embedding").alias("c")).hint("merge"), "vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    exact = recomputed(pairs.select("query_id", "vec_id", "q", "c"), k)
    return exact.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of ``embeddings`` for every hundredth of them."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[2] - p[1]) * (p[2] - p[1])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
