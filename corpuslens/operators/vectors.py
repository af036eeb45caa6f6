"""Directions, projections and covariances of labelled vectors.

Means come from Spark's vector summariser, which adds vectors up map-side; nothing is
exploded by dimension.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.vectors import cosine, dot, minus, norm, scaled, unit
from corpuslens.operators import metrics as M
from corpuslens.operators.ordered import numbered
from corpuslens.sources.scratch import settled

#: Vectors longer than this are refused by the d-by-d kernels.
MAX_DIM = 8192


def mean_vector(vector: str = "h") -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vector))))


def class_means(acts: DataFrame, by=(), label: str = "label", vector: str = "h") -> DataFrame:
    """by, label, mean, n."""
    return acts.groupBy(*by, label).agg(mean_vector(vector).alias("mean"), F.count(F.lit(1)).alias("n"))


def mean_diff(acts: DataFrame, by=(), label: str = "label", vector: str = "h") -> DataFrame:
    """Direction from the mean of class 0 to the mean of class 1: by, d, d_norm."""
    m = class_means(acts, by, label, vector)
    pick = lambda k: F.max(F.when(F.col(label) == k, F.col("mean")))  # noqa: E731  one row per class
    both = m.groupBy(*by).agg(pick(1).alias("m1"), pick(0).alias("m0"))
    return both.select(*by, minus(F.col("m1"), F.col("m0")).alias("d")).withColumn("d_norm", norm(F.col("d")))


def mean_pool(tok_acts: DataFrame, by: list[str], mask: str | None = None, vector: str = "h") -> DataFrame:
    """Mean of the vectors of each group, of masked-in rows only."""
    rows = tok_acts.filter(F.col(mask) == 1) if mask else tok_acts
    return rows.groupBy(*by).agg(mean_vector(vector).alias(vector), F.count(F.lit(1)).alias("n"))


def project(vector: Column, d: Column, center: Column | None = None) -> Column:
    """(h - center) . d / |d|."""
    return dot(minus(vector, center) if center is not None else vector, d) / F.greatest(norm(d), F.lit(1e-12))


def norm_audit(layers: DataFrame) -> DataFrame:
    """Per layer: AUROC of the vector norm, its direction, and mean and population std by class."""
    scores = layers.select("layer", "label", F.round(norm(F.col("h")), 9).alias("value"))
    area = M.oriented(M.auroc(scores, ["layer"]))
    of = lambda k: F.when(F.col("label") == k, F.col("value"))
    stats = scores.groupBy("layer").agg(
        F.avg(of(1)).alias("mean_1"), F.stddev_pop(of(1)).alias("std_1"), F.avg(of(0)).alias("mean_0"), F.stddev_pop(of(0)).alias("std_0")
    )
    return area.join(stats, "layer")


def recall_label(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Add recall: 1 below the median loss, or above the median score (strictly)."""
    median = df.agg(F.percentile(col, 0.5).alias("median"))
    test = F.col(col) < F.col("median") if kind == "loss" else F.col(col) > F.col("median")
    return df.crossJoin(F.broadcast(median)).withColumn("recall", test.cast("int")).drop("median")


def l2_normalised(acts: DataFrame, vector: str = "h") -> DataFrame:
    return acts.withColumn(vector, unit(F.col(vector)))


def gram_rows(acts: DataFrame, by: list[str], vector: str = "h") -> DataFrame:
    """Sums of outer products: by, i, row (and n, total at i = -1), one partial matrix per task and group."""
    names = [*by, vector]

    def partial(batches):
        sums: dict = {}
        kinds_ = []
        for batch in batches:
            kinds_ = [batch.column(k).type for k in range(len(by))]
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))), strict=True)) if by else [()] * batch.num_rows
            x = np.asarray(batch.column(len(by)).flatten(), float).reshape(batch.num_rows, -1)
            if x.shape[1] > MAX_DIM:
                raise ValueError(f"vectors of {x.shape[1]} dimensions; the limit is {MAX_DIM}")
            for key in set(keys):
                own = x[[k == key for k in keys]]
                n, total, g = sums.get(key, (0, 0.0, 0.0))
                sums[key] = (n + len(own), total + own.sum(0), g + own.T @ own)
        for key, (n, total, g) in sums.items():
            rows = [(-1, np.append(total, n)), *enumerate(g)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k] * len(rows), t) for k, t in zip(key, kinds_, strict=True)), pa.array([i for i, _ in rows], pa.int32()), pa.array([r.tolist() for _, r in rows], pa.list_(pa.float64()))],
                [*by, "i", "row"],
            )

    kinds = dict(acts.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), "i int, row array<double>"])
    added = vector_to_array(Summarizer.sum(array_to_vector("row")))
    return acts.select(*names).mapInArrow(partial, schema).groupBy(*by, "i").agg(added.alias("row"))


def covariances(acts: DataFrame, by: list[str], vector: str = "h") -> DataFrame:
    """Sample covariance rows: by, i, row."""
    g = gram_rows(acts, by, vector)
    totals = g.filter("i < 0").select(*by, F.slice("row", F.lit(1), F.size("row") - 1).alias("total"), F.element_at("row", -1).alias("n"))
    joined = g.filter("i >= 0").join(F.broadcast(totals), by) if by else g.filter("i >= 0").crossJoin(F.broadcast(totals))  # one row per group
    one = (F.col("row"), scaled(F.col("total"), F.get("total", F.col("i")) / F.col("n")))
    return joined.select(*by, "i", scaled(minus(*one), 1.0 / (F.col("n") - 1)).alias("row"))


def contrastive_pca(acts: DataFrame, k: int = 10, alpha: float = 1.0) -> list[tuple[float, float, list[float]]]:
    """Top k eigenpairs of C1 - alpha C0 by absolute value: (value, explained share, vector); d rows per class reach the driver."""
    rows = covariances(acts, ["label"]).collect()  # 2 d rows of d numbers, d <= MAX_DIM
    c = {y: np.array([r["row"] for r in sorted((r for r in rows if r["label"] == y), key=lambda r: r["i"])]) for y in (0, 1)}
    values, vectors = np.linalg.eigh(c[1] - alpha * c[0])
    order = np.argsort(-np.abs(values), kind="stable")[:k]
    whole = np.abs(values).sum()
    return [(float(values[j]), float(abs(values[j]) / whole), vectors[:, j].tolist()) for j in order]


def paired_differences(acts: DataFrame) -> DataFrame:
    """pair, h: the i-th vector of class 1 less the i-th of class 0, each class in the order of doc_id; the larger class's rest has no pair."""
    placed = numbered(acts.select("label", "doc_id", "h"), ["label", "doc_id"])
    first = placed.groupBy("label").agg(F.min("place").alias("first"))
    own = settled(placed.join(F.broadcast(first), "label").withColumn("pair", F.col("place") - F.col("first")), "pairs")  # a row for each class
    of = lambda y: own.filter(F.col("label") == y).select("pair", F.col("h").alias(f"h{y}"))
    return of(1).join(of(0), "pair").select("pair", minus(F.col("h1"), F.col("h0")).alias("h"))


def paired_pca(acts: DataFrame, k: int = 10) -> list[tuple[float, float, list[float]]]:
    """Top k principal directions of the paired differences: (variance, share of all, vector); d rows reach the driver.

    The pairing is arbitrary, so this shows variance within classes as well; :func:`contrastive_pca` does not."""
    rows = covariances(paired_differences(acts).withColumn("all", F.lit(0)), ["all"]).collect()  # d rows of d numbers, d <= MAX_DIM
    values, vectors = np.linalg.eigh(np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])]))
    whole = max(float(values.sum()), 1e-12)
    return [(float(values[j]), float(values[j] / whole), vectors[:, j].tolist()) for j in np.argsort(-values, kind="stable")[:k]]


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles in degrees between the spaces spanned by the rows of a and b."""
    qa, qb = np.linalg.qr(a.T)[0], np.linalg.qr(b.T)[0]
    return np.degrees(np.arccos(np.clip(np.linalg.svd(qa.T @ qb, compute_uv=False), -1, 1)))


def paired_shift(a: DataFrame, b: DataFrame, d: DataFrame) -> DataFrame:
    """Vectors before and after: cosine and score shift along d (one row), by doc_id."""
    both = a.select("doc_id", F.col("h").alias("h0")).join(b.select("doc_id", F.col("h").alias("h1")), "doc_id").crossJoin(F.broadcast(d.select("d")))
    return both.select("doc_id", cosine(F.col("h0"), F.col("h1")).alias("cosine"), (project(F.col("h1"), F.col("d")) - project(F.col("h0"), F.col("d"))).alias("shift"))


def random_directions(n: int, dim: int, seed: int) -> np.ndarray:
    """Unit rows from hash-seeded normals (Box-Muller), the same in SQL and here."""
    import hashlib

    def u01(*parts) -> float:
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0

    x = np.array([[np.sqrt(-2 * np.log(1 - u01(seed, k, i, 0))) * np.cos(2 * np.pi * u01(seed, k, i, 1)) for i in range(dim)] for k in range(n)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def direction_scores(acts: DataFrame, directions: np.ndarray, vector: str = "h") -> DataFrame:
    """Scores along each direction, one block product per batch: direction, label, value."""
    shared = acts.sparkSession.sparkContext.broadcast(directions)

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            s = x @ shared.value.T
            n = s.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(n, dtype=np.int32), len(x))), pa.array(np.repeat(np.asarray(batch.column(0)), n)), pa.array(s.ravel())], ["direction", "label", "value"]
            )

    return acts.select("label", vector).mapInArrow(run, "direction int, label int, value double")


def spaced_layers(n_layers: int, about: int = 9, also: int | None = None) -> list[int]:
    """The first, every (n / about)-th and the last layer, and one more that is wanted in any case."""
    if n_layers < 1:
        return []
    found = {0, *range(0, n_layers, max(1, n_layers // about)), n_layers - 1}
    return sorted(found if also is None else found | {also})


def layer_angles(bases: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas by layer: rows (layer, name, v) of two bases to min, mean and max angle."""
    parts = [np.stack(g["v"]) for _, g in bases.groupby("name")]
    angle = principal_angles(*parts)
    return pd.DataFrame({"layer": [bases["layer"].iloc[0]], "min_deg": [angle.min()], "mean_deg": [angle.mean()], "max_deg": [angle.max()]})
