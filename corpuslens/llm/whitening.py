"""Whitening of embeddings with MLlib block matrices.

Every entry c becomes the whole number x = floor(SCALE c) + SHIFT, so sums are exact.  Rows
are numbered (place in their task, behind the rows of tasks before it), centred as
(n x - S) / n, where n x - S is a whole number, and dealt into blocks of BLOCK_ROWS rows of a
BlockMatrix.  The scatter is a product of the transposed blocks with the blocks; its
eigenvectors, taken on the driver (one matrix of dimension x dimension), over the roots of
their eigenvalues are the whitening matrix, and a product of the blocks with it projects
all rows.  The covariance of the projected rows is made in the same way and held against
the identity.

A product of a wide matrix with a tall one has one block, so one task would be sent all
rows.  The left factor is therefore laid out with a block column of its own for every GROUP
blocks of rows: the product holds a scatter for each group, and these are summed.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.groups import whole_groups
from corpuslens.llm.store import settle, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
BLOCK_ROWS, GROUP = 1024, 64
#: Eigenvalues up to this share of the largest are zero but for rounding.
TINY = 1e-12
LONGEST = 2**63 - 1


def whole_numbers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector has entries, all of them finite; a value that no long holds counts as not finite."""
    good = rows.filter(F.col(vector).isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda c: c.cast("double")).alias("x"))
    bound = float(2**52)  # SCALE times more is still a long
    good = good.filter((F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < bound) & ~F.isnan(c)))
    return good.withColumn("x", F.transform("x", lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def _numbered(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows of the commonest length (the longer, of equally common ones) numbered from 0; how many, and the length.

    Each task's rows are numbered where they stand and written; the driver sees a number
    for each writing task only."""
    placed = settle(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("size", F.size("x")), "whitening-rows")
    sizes = placed.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if sizes is None:
        return placed, 0, 0
    size = sizes["size"]
    placed = placed.filter(F.col("size") == size)
    task = F.shiftright("at", 33).alias("task")
    # places may have gaps where rows of other lengths stood, so a task's numbers reach to its last place
    ends = sorted(placed.groupBy(task).agg((F.max("at") % (1 << 33) + 1).alias("n")).collect())
    before = np.cumsum([0, *[r["n"] for r in ends]]).tolist()
    parts = rows.sparkSession.createDataFrame([(r["task"], b) for r, b in zip(ends, before, strict=False)], "task long, before long")
    numbered = placed.withColumn("task", F.shiftright("at", 33)).join(F.broadcast(parts), "task")
    return numbered.select("vec_id", "x", (F.col("before") + F.col("at") % (1 << 33)).alias("row")), before[-1], size


def _sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension: one row a task and dimension is exchanged."""

    def run(batches):
        n, s = 0, np.zeros(size, object)
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, size)
            n += len(x)
            for part in np.array_split(x, max(1, len(x) >> 10)):  # a thousand longs of at most 2**62 + SHIFT
                s += part.astype(object).sum(0) if np.abs(part).max(initial=0) > 2**52 else part.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38))], ["i", "n", "s"])

    total = rows.select("x").mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("i").collect()
    return total[0]["n"], [int(r["s"]) for r in total]


BLOCKS = "block int, ids array<long>, place array<int>, deviation array<long>, high int, body binary"


def _blocks(rows: DataFrame, size: int, n: int, sums: list[int], block_rows: int) -> DataFrame:
    """Centred rows in blocks: their ids, places in the block, deviations, and the block's rows as doubles, column after column.

    Places without a row hold zeros, which add nothing to a product."""
    largest = max(map(abs, sums))

    def run(batches):
        for t in whole_groups(batches, ["block"], 1):
            block, place, ids = t.column("block")[0].as_py(), t.column("place").to_numpy(), t.column("vec_id").to_pylist()
            own = np.concatenate([c.flatten().to_numpy() for c in t.column("x").chunks]).reshape(-1, size)
            most = n * int(np.abs(own).max()) + largest
            if size * most * most < 2**63:
                whole = n * own - np.array(sums)
                deviation = (whole * whole).sum(1).tolist()
            else:
                whole = n * own.astype(object) - np.array(sums, object)
                deviation = [int(v) if v <= LONGEST else None for v in (whole * whole).sum(1)]
            body = np.zeros((int(place.max()) + 1, size))
            body[place] = whole.astype(float) / n
            row = ([block], [ids], [place], [deviation], [len(body)], [body.tobytes("F")])
            kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["block", "ids", "place", "deviation", "high", "body"])

    dealt = rows.select("vec_id", "x", (F.col("row") / block_rows).cast("int").alias("block"), (F.col("row") % block_rows).cast("int").alias("place"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "block").sortWithinPartitions("block", "place").mapInArrow(run, BLOCKS)


def _matrix(blocks, columns: int, block_rows: int, rows: int, of_group: int | None = None) -> BlockMatrix:
    """(block, rows in it, body) as a BlockMatrix; with ``of_group``, each group of blocks in a block column of its own."""
    column = (lambda i: 0) if of_group is None else (lambda i: i // of_group)
    wide = 1 if of_group is None else (-(-rows // block_rows) - 1) // of_group + 1
    return BlockMatrix(blocks.map(lambda b: ((b[0], column(b[0])), DenseMatrix(b[1], columns, np.frombuffer(b[2])))), block_rows, columns, rows, wide * columns)


def _scatter(blocks, tall: BlockMatrix, columns: int, block_rows: int, rows: int) -> np.ndarray:
    """Sum of the outer products of all rows: one product of blocks for each group, summed in a tree."""
    product = _matrix(blocks, columns, block_rows, rows, GROUP).transpose().multiply(tall)
    return product.blocks.map(lambda b: b[1].toArray()).treeReduce(lambda a, b: a + b)


def whitened(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row and component up to ``components``.

    Rows whose vector is null, empty, or holds null or non-finite entries, or is not of the
    commonest length, take no part.  Null and repeated vec_ids and repeated rows are rows like
    others; other columns are ignored; an empty table gives no rows.  Components run up to
    the vectors' length; one without variance has a null ``whitened`` and is left out of
    ``identity_error`` (null if there is no other).  A deviation that no long holds is null."""
    spark = rows.sparkSession
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    numbered, places, size = _numbered(whole_numbers(rows, vector))
    if not places:
        return spark.createDataFrame([], schema)
    n, sums = _sums(numbered, size)
    blocks = settle(_blocks(numbered, size, n, sums, block_rows), "whitening-blocks")
    bodies = blocks.select("block", "high", "body").rdd.map(tuple)
    tall = _matrix(bodies, size, block_rows, places)
    values, vectors = np.linalg.eigh(_scatter(bodies, tall, size, block_rows, places) / n)
    order = np.argsort(-values, kind="stable")[: min(components, size)]
    trace, values = float(values.sum()), values[order]
    live = values > TINY * max(float(values[0]), 0.0)
    whitening = vectors[:, order] * np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0)
    k = len(order)
    once = spark.sparkContext.parallelize([((0, 0), DenseMatrix(size, k, whitening.ravel("F")))], 1)
    projected = tall.multiply(BlockMatrix(once, size, k, size, k))
    shape = "block int, high int, body binary"
    rows_of = settle(spark.createDataFrame(projected.blocks.map(lambda b: (b[0][0], b[1].numRows, bytearray(b[1].toArray().ravel("F").tobytes()))), shape), "whitening-projected")
    thin = rows_of.rdd.map(tuple)
    covariance = _scatter(thin, _matrix(thin, k, block_rows, places), k, block_rows, places)[np.ix_(live, live)] / n
    error = float(np.abs(covariance - np.eye(int(live.sum()))).max()) if live.any() else None
    explained = [float(v) / trace if trace > 0 else 0.0 for v in values]

    def run(batches):
        for b in batches:
            for ids, place, deviation, high, body in zip(*(b.column(i) for i in range(5)), strict=True):
                w = np.frombuffer(body.as_py()).reshape(k, high.as_py())[:, place.values.to_numpy()]
                m = w.shape[1]
                of = pa.array(np.repeat(np.arange(m), k))
                cells = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), deviation.values.take(of), pa.array(w.T.ravel(), mask=np.tile(~live, m)), np.tile(explained, m), pa.array([error] * (m * k), pa.float64())]
                yield pa.RecordBatch.from_arrays([ids.values.take(of), *map(pa.array, cells)], names)

    both = blocks.select("block", "ids", "place", "deviation").join(rows_of.hint("merge"), "block")
    return both.select("ids", "place", "deviation", "high", "body").mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every row of ``embeddings``."""
    return whitened(table(spark, sf_dir, "embeddings"))
