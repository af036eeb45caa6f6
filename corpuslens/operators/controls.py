"""Controls of subspace erasure: how much of a frozen probe's AUROC goes when other things are erased.

The residual e = h - decode(encode(h)) is erased along a basis U, h - U U^T e, and the
probe is scored on what is left.  A probe is linear, so an erased score is the plain
score less (U^T w) . (U^T e): every control of a batch of vectors is one block product,
and altered vectors are never built.  Controls:

* ``primary``: U holds the leading directions of the residual's covariance.
* ``identity``: nothing is erased.
* ``random``: U is a random orthonormal basis of the same rank.
* ``noise``: isotropic noise, in each row of the length that ``primary`` takes away,
  drawn from (seed, doc_id) so that it does not depend on the partitioning.
* ``mask``: a share of the dictionary's features is left out of decoding, the residual
  and its leading directions follow from that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import metrics as M
from corpuslens.operators import vectors as V
from corpuslens.operators.dictionary import Dictionary

N_RANDOM, N_NOISE, N_MASK, MASK_SHARE = 100, 100, 20, 0.05


def masks(n_features: int, n_seeds: int, share: float = MASK_SHARE, seed: int = 0) -> list[np.ndarray]:
    """Positions of the features each seed leaves out, at least one."""
    n = max(1, round(share * n_features))
    return [np.random.Generator(np.random.Philox([seed, s])).choice(n_features, n, replace=False) for s in range(n_seeds)]


def random_bases(dim: int, rank: int, n_seeds: int, seed: int = 0) -> list[np.ndarray]:
    """Orthonormal bases (dim x rank)."""
    if not 0 < rank < dim:
        raise ValueError("the rank must lie between 0 and the dimension")
    return [np.linalg.qr(np.random.Generator(np.random.Philox([seed, s])).standard_normal((dim, rank)))[0] for s in range(n_seeds)]


def noise_along(ids, weights: np.ndarray, n_seeds: int, seed: int = 0) -> np.ndarray:
    """Projections on each probe of a unit vector drawn for each (seed, id): ids x seeds x probes."""
    dim = weights.shape[1]
    out = np.zeros((len(ids), n_seeds, len(weights)))
    for i, ident in enumerate(ids):
        g = np.random.Generator(np.random.Philox([seed, int(ident) % (1 << 64)])).standard_normal((n_seeds, dim))
        out[i] = g @ weights.T / (np.linalg.norm(g, axis=1, keepdims=True) + 1e-12)
    return out


def residuals(acts: DataFrame, dictionary: Dictionary, left_out: list) -> DataFrame:
    """mask, resid: the residual when decoding leaves out the features of each mask (an index, or -1 for none)."""
    shared = acts.sparkSession.sparkContext.broadcast((dictionary, left_out))  # size checked by Dictionary

    def run(batches):
        own, picks = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).to_pylist(), float)
            z = own.encode(x)
            e = x - own.decode(z)
            for k, pick in enumerate([None, *picks]):
                part = e if pick is None else e + z[:, pick] @ own.dec[pick]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k - 1, np.int32)), pa.array(list(part), pa.list_(pa.float64()))], ["mask", "resid"])

    return acts.select("h").mapInArrow(run, "mask int, resid array<double>")


def leading_directions(acts: DataFrame, dictionary: Dictionary, rank: int, left_out: list) -> dict[int, np.ndarray]:
    """Per mask (-1: none) the ``rank`` leading directions (dim x rank) of the residual's covariance.

    Second moments are summed by Spark; dim rows of dim numbers for each mask reach the driver."""
    rows = V.covariances(residuals(acts, dictionary, left_out), ["mask"], "resid").collect()
    out = {}
    for mask in {r["mask"] for r in rows}:
        c = np.array([r["row"] for r in sorted((r for r in rows if r["mask"] == mask), key=lambda r: r["i"])])
        out[mask] = np.linalg.eigh(c)[1][:, ::-1][:, :rank]
    return out


def control_scores(acts: DataFrame, dictionary: Dictionary, bank: list, rank: int, n_random: int = N_RANDOM, n_noise: int = N_NOISE, n_mask: int = N_MASK, seed: int = 0) -> DataFrame:
    """control, seed, probe, label, value: every document under every control.

    ``bank``: (seed, weights, bias) of frozen probes on unscaled vectors."""
    left_out = masks(len(dictionary.ids), n_mask, seed=seed)
    lead = leading_directions(acts, dictionary, rank, left_out)
    if not lead:
        return acts.sparkSession.createDataFrame([], "control string, seed int, probe int, label int, value double")
    weights = np.array([w for _, w, _ in bank], float)
    bias = np.array([b for _, _, b in bank], float)
    rotated = np.array([weights @ q @ q.T for q in random_bases(weights.shape[1], rank, n_random, seed)]).reshape(-1, weights.shape[1])
    shared = acts.sparkSession.sparkContext.broadcast((dictionary, left_out, lead, rotated, weights, bias))
    names = pa.array(["primary", "identity", "random", "noise", "mask"])
    probes = np.array([s for s, _, _ in bank], np.int32)

    def run(batches):
        own, picks, basis, turned, w, b = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(2).to_pylist(), float)
            z = own.encode(x)
            e = x - own.decode(z)
            plain = x @ w.T + b
            taken = e @ basis[-1]
            size = np.linalg.norm(taken, axis=1)
            erased = lambda part, u: plain - (part @ u) @ (w @ u).T
            parts = [(0, 0, erased(e, basis[-1])), (1, 0, plain)]
            parts += [(2, s, plain - e @ turned[s * len(w) : (s + 1) * len(w)].T) for s in range(len(turned) // len(w))]
            if n_noise:
                along = noise_along(batch.column(0).to_pylist(), w, n_noise, seed) * size[:, None, None]
                parts += [(3, s, plain + along[:, s]) for s in range(n_noise)]
            parts += [(4, s, erased(e + z[:, pick] @ own.dec[pick], basis[s])) for s, pick in enumerate(picks)]
            for kind, s, value in parts:
                n = value.size
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(np.full(n, kind))), pa.array(np.full(n, s, np.int32)), pa.array(np.tile(probes, len(x))),
                        pa.array(np.repeat(np.asarray(batch.column(1)), len(w))), pa.array(np.round(value.ravel(), 9)),
                    ],
                    ["control", "seed", "probe", "label", "value"],
                )

    return acts.select("doc_id", F.col("label").cast("int").alias("label"), "h").mapInArrow(run, "control string, seed int, probe int, label int, value double")


def ablation_controls(scores: DataFrame) -> DataFrame:
    """Per control: seeds, and mean, population std and percentiles over seeds of the probes' mean AUROC."""
    area = M.auroc(scores, ["control", "seed", "probe"]).groupBy("control", "seed").agg(F.avg("auroc").alias("auroc"))
    pct = [F.percentile("auroc", p).alias(f"pct{round(p * 100):02d}") for p in (0.05, 0.5, 0.95)]
    return area.groupBy("control").agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("auroc").alias("mean"), F.stddev_pop("auroc").alias("std"), *pct)
