"""AUROCs of many bootstrap replicates in one pass over the scores.

Rows are dealt by ranges of (group, score, hash of the key), so a group of any size, and one
score that many rows share, spread over tasks.  A task draws the Poisson(1) weights of its
rows for all replicates at once and keeps, for each group, a summary of replicate columns:
positives, negatives, and pairs in order (twice, a tie once).  Summaries of neighbouring
ranges merge exactly; those of one group meet in blocks of replicates.  No row is written
once for each replicate, and nothing but the scores is sorted.

Weights are hashes of (seed, replicate, key): the same in any partitioning, and the same
for rows of one key in all groups, as paired comparisons need.  ``md5`` draws can be
repeated in SQL; ``philox`` draws are the faster kind for many replicates.
"""

from __future__ import annotations

from fractions import Fraction
from hashlib import md5
from math import ceil, exp, factorial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chances that a Poisson(1) number is at most 0, 1, ...; a draw's weight is how many of them it reaches.
POISSON = [round(exp(-1) * sum(1 / factorial(i) for i in range(k + 1)), 12) for k in range(12)]
LEVELS = np.array([ceil(Fraction(c) * 2**32) for c in POISSON], np.uint64)
#: Replicates that share one md5: each takes eight of its hex digits.
SHARED = 4
#: How a row's weights are packed, one number for each replicate.
WEIGHT = "<u2"
#: Replicates in a block of a summary; cells of a weight matrix held at once.
BLOCK, CELLS = 250, 1 << 19


def draw_words(keys: list, numbers: np.ndarray, seed: int, draws: str = "md5") -> np.ndarray:
    """32 random bits for each key (row) and replicate number (column)."""
    if draws == "philox":
        most = int(numbers.max()) + 1
        rows = [np.random.Philox(key=[seed, int.from_bytes(md5(str(k).encode()).digest()[:8], "big")]).random_raw(-(-most // 2)).view(np.uint32) for k in keys]
        return np.stack(rows)[:, numbers]
    hashed, which = np.unique(numbers // SHARED, return_inverse=True)
    heads = [f"{seed}|{h}".encode() for h in hashed.tolist()]
    tails = [b"" if k is None else b"|" + str(k).encode() for k in keys]
    raw = b"".join([md5(h + t).digest() for t in tails for h in heads])
    return np.frombuffer(raw, ">u4").reshape(len(keys), -1)[:, SHARED * which + numbers % SHARED]


def poisson_weights(keys: list, numbers: np.ndarray, seed: int, draws: str = "md5") -> np.ndarray:
    """Poisson(1) weights of each key in each replicate."""
    return np.searchsorted(LEVELS, draw_words(keys, numbers, seed, draws).astype(np.uint64), side="right")


def unpacked(rows: list[bytes]) -> np.ndarray:
    """The weights of packed rows, a column for each replicate."""
    return np.frombuffer(b"".join(rows), WEIGHT).reshape(len(rows), -1).astype(np.int64)


class Summary:
    """Replicate columns of a range of scores: sums, and those of its first and last score."""

    def __init__(self, first, last, pos, neg, pairs, first_pos, first_neg, last_pos, last_neg):
        self.first, self.last = first, last
        self.pos, self.neg, self.pairs = pos, neg, pairs
        self.first_pos, self.first_neg, self.last_pos, self.last_neg = first_pos, first_neg, last_pos, last_neg

    @classmethod
    def of(cls, values: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Summary:
        """Rows by rising score; NaN is one score above all others."""
        new = np.flatnonzero(np.append(True, (values[1:] != values[:-1]) & ~(np.isnan(values[1:]) & np.isnan(values[:-1]))))
        pos = np.add.reduceat(weights * labels[:, None], new, 0)
        neg = np.add.reduceat(weights * (1 - labels)[:, None], new, 0)
        below = np.cumsum(neg, 0) - neg
        return cls(values[0], values[-1], pos.sum(0), neg.sum(0), (pos * (2 * below + neg)).sum(0), pos[0], neg[0], pos[-1], neg[-1])

    def before(self, other: Summary) -> Summary:
        """This range and the next one as one."""
        same = lambda x, y: x == y or (np.isnan(x) and np.isnan(y))
        pairs = self.pairs + other.pairs + 2 * other.pos * self.neg
        first, last = (self.first_pos, self.first_neg), (other.last_pos, other.last_neg)
        if same(self.last, other.first):
            pairs += self.last_pos * other.first_neg - other.first_pos * self.last_neg
            if same(self.first, self.last):
                first = (self.first_pos + other.first_pos, self.first_neg + other.first_neg)
            if same(other.first, other.last):
                last = (self.last_pos + other.last_pos, self.last_neg + other.last_neg)
        return Summary(self.first, other.last, self.pos + other.pos, self.neg + other.neg, pairs, *first, *last)

    ARRAYS = ("pos", "neg", "pairs", "first_pos", "first_neg", "last_pos", "last_neg")


def auroc_replicates(scores: DataFrame, by: list[str], replicates, seed: int, key: str = "doc_id", label: str = "label", value: str = "value", draws: str = "md5", weights: str | None = None) -> DataFrame:
    """by, b, n_pos, n_neg, auroc of every replicate (a number, or a list of replicate numbers) of every group.

    ``weights`` names a column of packed weights (``WEIGHT``), one for each replicate; without it they are drawn.
    Rows without a score or label take no part; a replicate without rows is left out; one
    of a single class has 0.5.  Sums are exact while a group has fewer than 4e9 rows."""
    numbers = np.arange(replicates) if isinstance(replicates, int) else np.array(sorted(replicates), np.int64)
    spark = scores.sparkSession
    own = scores.filter(F.col(value).isNotNull() & F.col(label).isNotNull())
    own = own.select(*by, F.col(value).cast("double").alias("value"), (F.col(label) == 1).cast("long").alias("label"), F.col(key).cast("string").alias("key"), *([F.col(weights).alias("weights")] if weights else []))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(parts, *by, "value", F.xxhash64("key")).sortWithinPartitions(*by, "value")
    kinds = [f"`{c}` {own.schema[c].dataType.simpleString()}" for c in by]
    at_once = max(16, CELLS // max(1, len(numbers)))
    blocks = [(i, numbers[i : i + BLOCK]) for i in range(0, len(numbers), BLOCK)]

    def summarise(batches):
        part = TaskContext.get().partitionId()
        held: Summary | None = None
        open_: pa.RecordBatch | None = None

        def told():
            for i, of in blocks:
                arrays = [pa.array([getattr(held, c)[i : i + len(of)]], pa.list_(pa.int64())) for c in Summary.ARRAYS]
                yield pa.RecordBatch.from_arrays([*open_.columns, pa.array([part], pa.int32()), pa.array([i], pa.int32()), pa.array([held.first]), pa.array([held.last]), *arrays], [*by, "part", "block", "first", "last", *Summary.ARRAYS])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            values, labels, keys = batch.column("value").to_numpy(), batch.column("label").to_numpy(), batch.column("key").to_pylist()
            packed = batch.column("weights") if weights else None
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                mine = batch.select(by).slice(a, 1)
                if held is not None and mine.to_pylist() != open_.to_pylist():
                    yield from told()
                    held = None
                open_ = mine
                for k in range(a, z, at_once):
                    e = min(z, k + at_once)
                    own_weights = poisson_weights(keys[k:e], numbers, seed, draws) if packed is None else unpacked(packed[k:e].to_pylist())[:, numbers]
                    s = Summary.of(values[k:e], labels[k:e], own_weights)
                    held = s if held is None else held.before(s)
        if held is not None:
            yield from told()

    def merge(t: pa.Table) -> pa.Table:
        """At most one summary a task."""
        rows = sorted(t.select(["part", "first", "last", *Summary.ARRAYS]).to_pylist(), key=lambda r: r["part"])
        whole = None
        for r in rows:
            s = Summary(r["first"], r["last"], *(np.array(r[c], np.int64) for c in Summary.ARRAYS))
            whole = s if whole is None else whole.before(s)
        i = t["block"][0].as_py()
        b = numbers[i : i + BLOCK]
        own = [pa.array([t[c][0].as_py()] * len(b), t.schema.field(c).type) for c in by]
        return pa.Table.from_arrays([*own, pa.array(b), *map(pa.array, (whole.pos, whole.neg, whole.pairs))], [*by, "b", "n_pos", "n_neg", "pairs"])

    arrays = ", ".join(f"{c} array<long>" for c in Summary.ARRAYS)
    parts_ = dealt.mapInArrow(summarise, ", ".join([*kinds, "part int, block int, first double, last double", arrays]))
    out = parts_.groupBy(*by, "block").applyInArrow(merge, ", ".join([*kinds, "b long, n_pos long, n_neg long, pairs long"]))
    both = F.col("n_pos") * F.col("n_neg")
    area = F.when(both > 0, F.col("pairs").cast("double") / (2.0 * both)).otherwise(0.5)
    return out.filter("n_pos + n_neg > 0").select(*by, "b", "n_pos", "n_neg", area.alias("auroc"))
