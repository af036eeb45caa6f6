"""Logistic probes of many streams, seeds and folds, fitted together.

A Newton step of a ridge-regularised logistic model needs two sums over its rows, a gradient
and a Hessian.  One pass over the rows adds up those of all models at once: a row belongs to a
stream (which vectors it holds) and has a fold for each seed, and the model (stream, seed,
fold) is fitted on the rows of its stream that are not in that fold.  Tasks send their sums
row by row of the matrix, Spark adds them up, each model is solved where its sums
meet, and the driver sees the weights only.  A few passes fit all models.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.corpus import stratified_folds

#: Newton steps at most, and the step below which a model is done.
STEPS, DONE = 40, 1e-9
#: The penalty of a dimension that does not vary, in rows; its weight stays zero.
STILL = 1e9

Model = tuple[str, int, int]


def with_folds(acts: DataFrame, k: int, seeds: list[int]) -> DataFrame:
    """``acts`` (doc_id, label, ...) with ``folds``: the row's fold for each seed, dealt within classes."""
    ids = acts.select("doc_id", "label")
    out = acts
    for s in seeds:
        out = out.join(stratified_folds(ids, "label", k, s).select("doc_id", F.col("fold").alias(f"fold_{s}")), "doc_id")
    return out.withColumn("folds", F.array(*[F.col(f"fold_{s}") for s in seeds])).drop(*[f"fold_{s}" for s in seeds])


def _parts(batch: pa.RecordBatch):
    """(stream, labels, vectors, folds) of the rows of each stream of a batch."""
    streams = np.array(batch.column("stream").to_pylist(), object)
    for s in dict.fromkeys(streams.tolist()):
        own = batch.filter(pa.array(streams == s))
        x = np.asarray(own.column("h").flatten(), float).reshape(own.num_rows, -1)
        yield s, np.asarray(own.column("label"), float), x, np.asarray(own.column("folds").flatten()).reshape(own.num_rows, -1)


def _added(rows: DataFrame, sums) -> DataFrame:
    """(stream, seed, fold, i, row): rows i of the matrices that ``sums`` (labels, vectors, folds, stream -> {(seed, fold): matrix}) gives, over all tasks."""

    def partial(batches):
        held: dict[Model, np.ndarray] = {}
        for batch in batches:
            for s, y, x, folds in _parts(batch):
                for (seed, fold), m in sums(y, x, folds, s).items():
                    held[s, seed, fold] = held[s, seed, fold] + m if (s, seed, fold) in held else m
        for (s, seed, fold), m in held.items():
            n = len(m)
            columns = [pa.array([s] * n), pa.array([seed] * n, pa.int32()), pa.array([fold] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["stream", "seed", "fold", "i", "row"])

    parts = rows.select("stream", "label", "h", "folds").mapInArrow(partial, "stream string, seed int, fold int, i int, row array<double>")
    return parts.groupBy("stream", "seed", "fold", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))


def _matrix(t: pa.Table) -> tuple[Model, np.ndarray]:
    t = t.sort_by("i")
    return (t["stream"][0].as_py(), t["seed"][0].as_py(), t["fold"][0].as_py()), np.array(t["row"].to_pylist())


def fit(rows: DataFrame, seeds: list[int], left_out: list[int], c: float = 1.0, n: int = 1000, standardised: bool = True) -> dict[Model, np.ndarray]:
    """Weights (the last is the bias) of the models of all streams, seeds and left-out folds.

    ``rows``: stream, label (0 or 1), h, folds (one for each seed); read once for the scales and
    once a Newton step, so it should be settled.  ``c`` is the inverse strength of the penalty
    for ``n`` rows, on the weights of scaled dimensions if ``standardised``.  Streams may differ
    in dimension; a model without rows has none."""
    spark = rows.sparkSession
    models = [(k, f) for k in range(len(seeds)) for f in left_out]

    def moments(y, x, folds, _):
        out = {}
        for k, f in models:
            own = x[folds[:, k] != f]
            out[seeds[k], f] = np.stack([np.full(x.shape[1], len(own), float), own.sum(0), (own**2).sum(0)])
        return out

    scales: dict[Model, tuple[float, np.ndarray]] = {}
    for r in _added(rows, moments).groupBy("stream", "seed", "fold").agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("m")).collect():  # three rows a model
        count, total, square = (np.array(x["row"]) for x in r["m"])
        m = float(count[0])
        if m == 0:
            continue
        variance = (square - total**2 / m) / max(m - 1, 1)
        penalty = variance if standardised else np.ones(len(total))
        scales[r["stream"], r["seed"], r["fold"]] = m, np.where(variance > 1e-18 * np.maximum(square / m, 1e-300), penalty, STILL * max(m, 1))
    weights = {k: np.zeros(len(p) + 1) for k, (_, p) in scales.items()}
    todo = set(weights)
    for _ in range(STEPS):
        if not todo:
            break
        shared = spark.sparkContext.broadcast((weights, todo))  # a vector for each model

        def newton(y, x, folds, stream, shared=shared):
            held, open_ = shared.value
            one = np.hstack([x, np.ones((len(x), 1))])
            out = {}
            for k, f in models:
                name = stream, seeds[k], f
                own = folds[:, k] != f
                if name not in open_ or not own.any():
                    continue
                z = one[own]
                p = 1 / (1 + np.exp(-np.clip(z @ held[name], -40, 40)))
                out[seeds[k], f] = np.hstack([(z * (p * (1 - p))[:, None]).T @ z, (z.T @ (p - y[own]))[:, None]])
            return out

        def step(t: pa.Table) -> pa.Table:
            name, m = _matrix(t)
            rows_, penalty = scales[name]
            w = shared.value[0][name]
            ridge = np.append(penalty * rows_ / (c * n), 0.0)
            hessian = m[:, :-1] + np.diag(ridge)
            move = np.linalg.solve(hessian + 1e-12 * np.trace(hessian) / len(w) * np.eye(len(w)), m[:, -1] + ridge * w)
            scale = min(1.0, 20.0 / max(float(np.abs(move * np.append(np.sqrt(np.minimum(penalty, 1e6)), 1.0)).max()), 1e-300))
            return pa.table({"stream": [name[0]], "seed": pa.array([name[1]], pa.int32()), "fold": pa.array([name[2]], pa.int32()), "move": pa.array([(scale * move).tolist()], pa.list_(pa.float64()))})

        moves = _added(rows, newton).groupBy("stream", "seed", "fold").applyInArrow(step, "stream string, seed int, fold int, move array<double>").collect()  # a vector for each model
        for r in moves:
            name = r["stream"], r["seed"], r["fold"]
            move = np.array(r["move"])
            weights[name] = weights[name] - move
            if np.abs(move * np.append(np.sqrt(np.minimum(scales[name][1], 1e6)), 1.0)).max() < DONE:
                todo = todo - {name}
        shared.unpersist()
    return weights


def out_of_fold(rows: DataFrame, seeds: list[int], weights: dict[Model, np.ndarray], held: list[int] | None = None) -> DataFrame:
    """stream, seed, fold, doc_id, label, value: every row by the model that did not see it (``held``: folds to score, all if not given)."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            streams = np.array(batch.column("stream").to_pylist(), object)
            for s in dict.fromkeys(streams.tolist()):
                own = batch.filter(pa.array(streams == s))
                x = np.asarray(own.column("h").flatten(), float).reshape(own.num_rows, -1)
                folds = np.asarray(own.column("folds").flatten()).reshape(own.num_rows, -1)
                for k, seed in enumerate(seeds):
                    for f in np.unique(folds[:, k]).tolist():
                        if (s, seed, f) not in shared.value or held is not None and f not in held:
                            continue
                        at = np.flatnonzero(folds[:, k] == f)
                        w = shared.value[s, seed, f]
                        value = np.round(x[at] @ w[:-1] + w[-1], 9)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([s] * len(at)), pa.array([seed] * len(at), pa.int32()), pa.array([f] * len(at), pa.int32()), own.column("doc_id").take(pa.array(at)), own.column("label").take(pa.array(at)), pa.array(value)],
                            ["stream", "seed", "fold", "doc_id", "label", "value"],
                        )

    kinds = dict(rows.dtypes)
    return rows.select("stream", "doc_id", "label", "h", "folds").mapInArrow(run, f"stream string, seed int, fold int, doc_id {kinds['doc_id']}, label {kinds['label']}, value double")
