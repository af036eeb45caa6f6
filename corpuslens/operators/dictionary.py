"""Sparse dictionaries: encoding, decoding, residual audits, and dictionary health.

A dictionary is a table feature_id, w (encoder row), b_enc, and optionally w_dec (else
tied) and theta.  It is a model of fixed size, broadcast to the tasks after a size check;
vectors stream through one block product and only sparse codes or scores come out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.draws import u01
from corpuslens.functions.vectors import cosine, minus, norm, scaled
from corpuslens.operators import metrics as M
from corpuslens.operators.vectors import gram_rows, mean_vector, project

#: Largest dictionary that is broadcast, in numbers.
MAX_NUMBERS = 1 << 28


class Dictionary:
    """The matrices of a dictionary table, and its encode and decode rules."""

    def __init__(self, table: DataFrame, b_dec: np.ndarray, kind: str = "relu", k: int | None = None):
        if table.count() * len(b_dec) > MAX_NUMBERS:
            raise ValueError("the dictionary is too large to broadcast")
        rows = table.orderBy("feature_id").collect()  # a model, not data; its size is checked
        self.ids = np.array([r["feature_id"] for r in rows], np.int32)
        self.w = np.array([r["w"] for r in rows], float)
        self.dec = np.array([r["w_dec"] for r in rows], float) if "w_dec" in table.columns else self.w
        self.b = np.array([r["b_enc"] for r in rows], float)
        self.theta = np.array([r["theta"] for r in rows], float) if "theta" in table.columns else None
        self.b_dec, self.kind, self.k = np.asarray(b_dec, float), kind, k

    def encode(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.b_dec) @ self.w.T + self.b
        if self.kind == "topk":
            order = np.lexsort((np.broadcast_to(self.ids, z.shape), -z), axis=1)
            kept = np.zeros_like(z)
            np.put_along_axis(kept, order[:, : self.k], np.take_along_axis(z, order[:, : self.k], 1), 1)
            z = kept
        z = np.maximum(z, 0)
        return np.where(z > self.theta, z, 0) if self.kind == "jumprelu" else z

    def decode(self, z: np.ndarray) -> np.ndarray:
        return z @ self.dec + self.b_dec


def fitted_bias(acts: DataFrame) -> np.ndarray:
    """The mean vector, as decoder bias."""
    return np.array(acts.agg(mean_vector().alias("m")).first()["m"])


def encode(acts: DataFrame, dictionary: Dictionary, keys=("doc_id", "label"), vector: str = "h") -> DataFrame:
    """Sparse codes: keys, feature_id, z (z > 0 only)."""
    shared = acts.sparkSession.sparkContext.broadcast(dictionary)
    n = len(keys)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = shared.value
            z = own.encode(np.asarray(batch.column(n).flatten(), float).reshape(batch.num_rows, -1))
            row, col = np.nonzero(z > 0)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(at) for i in range(n)), pa.array(own.ids[col]), pa.array(z[row, col])], [*keys, "feature_id", "z"]
            )

    kinds = dict(acts.dtypes)
    return acts.select(*keys, vector).mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "feature_id int, z double"]))


def decompose(acts: DataFrame, dictionary: Dictionary, keys=("doc_id", "label"), vector: str = "h") -> DataFrame:
    """keys, h, recon, resid (h - recon) and l0, in one pass; dense codes never leave a batch."""
    shared = acts.sparkSession.sparkContext.broadcast(dictionary)
    n = len(keys)
    doubles = pa.list_(pa.float64())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(n).flatten(), float).reshape(batch.num_rows, -1)
            z = shared.value.encode(x)
            r = shared.value.decode(z)
            arrays = [pa.array(list(v), doubles) for v in (x, r, x - r)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *arrays, pa.array((z > 0).sum(1).astype(np.int32))], [*keys, "h", "recon", "resid", "l0"])

    kinds = dict(acts.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "h array<double>, recon array<double>, resid array<double>, l0 int"])
    return acts.select(*keys, vector).mapInArrow(run, schema)


STREAMS = ("h", "recon", "resid")


def stream_scores(parts: DataFrame, d: DataFrame) -> DataFrame:
    """Long scores: doc_id, label, score ("k_h", "norm_h", ...), value; ``d`` is one row."""
    wide = parts.crossJoin(F.broadcast(d.select("d")))
    pairs = [F.struct(F.lit(f"k_{s}").alias("score"), project(F.col(s), F.col("d")).alias("value")) for s in STREAMS]
    pairs += [F.struct(F.lit(f"norm_{s}").alias("score"), norm(F.col(s)).alias("value")) for s in STREAMS]
    return wide.select("doc_id", "label", F.explode(F.array(*pairs)).alias("s")).select("doc_id", "label", "s.score", F.round("s.value", 9).alias("value"))


def decomposition_audit(parts: DataFrame, d: DataFrame) -> DataFrame:
    """Where the label's signal lives: AUROC of direction score and norm in vector, reconstruction and residual.

    AUROC does not depend on centring; drop = vector less reconstruction, preserved =
    reconstruction over vector, is_dark = recon < .60 and resid > .65."""
    area = M.oriented(M.auroc(stream_scores(parts, d), ["score"]))
    names = [f"{a}_{s}" for a in ("k", "norm") for s in STREAMS]
    w = area.groupBy().pivot("score", names).agg(F.max("auroc_bi"))
    return w.select(
        *names, (F.col("k_h") - F.col("k_recon")).alias("drop"), (F.col("k_recon") / F.col("k_h")).alias("preserved"), ((F.col("k_recon") < 0.60) & (F.col("k_resid") > 0.65)).alias("is_dark")
    )


def recon_quality(parts: DataFrame, size: int) -> DataFrame:
    """Squared error (summed over dimensions), row cosine, active features, their share (sparsity), error ratio; means over rows."""
    err = norm(F.col("resid"))
    return parts.agg(
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"), F.avg(cosine(F.col("h"), F.col("recon"))).alias("cosine"), F.avg("l0").alias("l0"),
        F.avg(F.col("l0") / size).alias("sparsity"), F.avg(err / (norm(F.col("h")) + 1e-12)).alias("error_ratio"),
    )


def eval_summary(parts: DataFrame, codes: DataFrame, size: int) -> DataFrame:
    """Unexplained variance, mean squared error over all entries, mean L1 of codes, share of features that never fire."""
    mean = parts.agg(mean_vector("h").alias("m"))
    err, dev = norm(F.col("resid")), norm(minus(F.col("h"), F.col("m")))
    a = parts.crossJoin(F.broadcast(mean)).agg((F.sum(err * err) / F.sum(dev * dev)).alias("fvu"), (F.sum(err * err) / F.sum(F.size("h"))).alias("mse"), F.count(F.lit(1)).alias("n"))
    c = codes.agg(F.sum("z").alias("l1"), F.count_distinct("feature_id").alias("alive"))
    return a.crossJoin(c).select("n", "fvu", "mse", (F.col("l1") / F.col("n")).alias("l1_mean"), F.col("l1").alias("l1_sum"), (1 - F.col("alive") / size).alias("dead_fraction"))


def random_dictionary(spark, n: int, dim: int, seed: int, kind: str = "gaussian") -> DataFrame:
    """feature_id, w: unit rows of hash-seeded normals, or of uniform numbers in (-1, 1)."""
    draw = lambda i, k: u01(F.lit(seed), F.col("feature_id"), i, F.lit(k))
    if kind == "gaussian":
        x = lambda i: F.sqrt(-2 * F.log(1 - draw(i, 0))) * F.cos(2 * F.pi() * draw(i, 1))
    else:
        x = lambda i: 2 * draw(i, 0) - 1
    rows = spark.range(n).select(F.col("id").cast("int").alias("feature_id")).withColumn("w", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), x))
    return rows.select("feature_id", scaled(F.col("w"), 1.0 / norm(F.col("w"))).alias("w"))


def feature_alignment(dictionary: DataFrame, d: DataFrame) -> DataFrame:
    """feature_id, cosine of the decoder row with the direction (one row)."""
    return dictionary.crossJoin(F.broadcast(d.select("d"))).select("feature_id", cosine(F.col("w"), F.col("d")).alias("cos"))


#: Added to the diagonal of a Gram matrix of features; feature subsets drawn at once.
RIDGE, DRAWS_AT_ONCE = 1e-8, 50


def feature_sufficiency(basis: np.ndarray, features: np.ndarray) -> np.ndarray | float:
    """Share of an orthonormal basis (rows) that lies in the span of the feature rows; sets of equal size (one axis more) at once.

    From the Gram matrix of the features with a ridge, by Cholesky factors: features may be
    dependent, or more than there are dimensions."""
    gram = features @ np.swapaxes(features, -1, -2) + RIDGE * np.eye(features.shape[-2])
    along = features @ basis.T
    half = np.linalg.solve(np.linalg.cholesky(gram), along)
    share = (half**2).sum((-1, -2)) / len(basis)
    return float(share) if features.ndim == 2 else share


def sufficiency_of_all(dictionary: DataFrame, basis: np.ndarray) -> float:
    """The same for a whole dictionary (column w), from the sums of outer products of its rows: d x d numbers reach the driver."""
    rows = gram_rows(dictionary.select("w"), [], "w").filter("i >= 0").orderBy("i").collect()
    gram = np.array([r["row"] for r in rows])
    return float(np.trace(basis @ gram @ np.linalg.solve(gram + RIDGE * np.eye(len(gram)), basis.T)) / len(basis))


def sufficiency_null(spark, basis: np.ndarray, features: np.ndarray, sizes: list[int], n_random: int, seed: int) -> DataFrame:
    """size, draw, value: sufficiency of drawn feature subsets of each size, many at once in each task.

    Draw i of a size depends on seed, size and i only.  Sizes above the number of features are left out."""
    sizes = sorted({s for s in sizes if s <= len(features)})
    shared = spark.sparkContext.broadcast((basis, features))  # a dictionary that the caller has checked
    at_once = max(1, min(DRAWS_AT_ONCE, n_random))
    blocks = -(-n_random // at_once)

    def run(batches):
        s, w = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                size, first = sizes[i // blocks], i % blocks * at_once
                draws = range(first, min(first + at_once, n_random))
                pick = np.stack([np.random.Generator(np.random.Philox(key=[seed, size << 32 | k])).permutation(len(w))[:size] for k in draws])
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(pick), pa.int32()), pa.array(draws, pa.int64()), pa.array(feature_sufficiency(s, w[pick]))], ["size", "draw", "value"])

    tasks = len(sizes) * blocks
    return spark.range(tasks).repartition(max(1, min(tasks, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "size int, draw long, value double")


def null_table(null: DataFrame, observed: DataFrame) -> DataFrame:
    """Per size: mean, population std, percentiles, extremes, and the observed value (size, observed) with its percentile rank."""
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    joined = null.join(F.broadcast(observed), "size", "left")  # a row for each size
    rank = 100.0 * F.avg((F.col("value") <= F.col("observed")).cast("int"))
    out = joined.groupBy("size").agg(F.count(F.lit(1)).alias("n_random"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), q.alias("q"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.max("observed").alias("observed"), rank.alias("percentile_rank"))
    return out.select("size", "n_random", "mean", "std", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "lowest", "highest", "observed", "percentile_rank")


# -- ablation ---------------------------------------------------------------------------
def feature_label_corr(codes: DataFrame, n_docs: DataFrame) -> DataFrame:
    """|point-biserial r| of each feature's code with the label, from sums over its non-zero codes.

    ``n_docs``: one row n, p (documents, positives).  Features active in fewer than two texts get 0."""
    y = F.col("label")
    s = codes.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("k"), F.sum("z").alias("s1"), F.sum(F.col("z") * F.col("z")).alias("s2"), F.sum(F.col("z") * y).alias("sy")
    )
    j = s.crossJoin(F.broadcast(n_docs))
    n, p = F.col("n"), F.col("p")
    cov = F.col("sy") - F.col("s1") * p / n
    var = (F.col("s2") - F.col("s1") * F.col("s1") / n) * (p - p * p / n)
    return j.select("feature_id", F.when((F.col("k") >= 2) & (var > 0), F.abs(cov / F.sqrt(var))).otherwise(0.0).alias("r"), F.col("k").alias("n_active"))


def rank_features(codes: DataFrame, n_docs: DataFrame, criterion: str) -> DataFrame:
    """feature_id, score: mean |z| of members ("member"), or |difference of class means| ("diff")."""
    s = codes.groupBy("feature_id").agg(F.sum(F.when(F.col("label") == 1, F.col("z")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("z")).otherwise(0.0)).alias("b"))
    j = s.crossJoin(F.broadcast(n_docs))
    a, b = F.col("a") / F.col("p"), F.col("b") / (F.col("n") - F.col("p"))
    return j.select("feature_id", (a if criterion == "member" else F.abs(a - b)).alias("score"))


def ranked(scores: DataFrame, column: str) -> DataFrame:
    """Add place (from 1): larger first, then feature_id; a table of features, not of data."""
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round(column, 9)), "feature_id")))


#: Least drop of the reconstruction's AUROC, and most change of the probe's, for features to carry the direction alone.
EXTRACTION_DROP, PROBE_CHANGE = 0.05, 0.02


def selection_grid(codes: DataFrame, base: DataFrame, weights: DataFrame, ranked_: DataFrame, depths: list[int], probe) -> DataFrame:
    """criterion, k, recon_auroc, extraction_drop, probe_auroc, probe_delta, passes_extraction, preserves_probe, verdict.

    ``ranked_``: criterion, feature_id, place.  ``probe`` gives the AUROCs of fresh probes on
    codes without the features of each of some named lists: of none, and of each cell's.  The verdict, at the deepest k of a criterion only: whether the AUROC of the reconstruction
    drops by EXTRACTION_DROP at least and the probe's changes by PROBE_CHANGE at most."""
    spark = codes.sparkSession
    cells = ranked_.withColumn("k", F.explode(F.array(*map(F.lit, depths)))).filter(F.col("place") <= F.col("k")).select("criterion", "k", "feature_id")
    area = M.auroc(ablated_scores(codes, base, weights, cells, ["criterion", "k"]).withColumn("value", F.round("recon", 9)), ["criterion", "k"])
    whole = M.auroc(base.withColumn("value", F.round("k_recon", 9)).select("label", "value")).first()["auroc"]
    names = cells.groupBy("criterion", "k").agg(F.sort_array(F.collect_list("feature_id")).alias("ids")).collect()  # a row for each cell, k ids each
    found = probe({"all": []} | {f"{r['criterion']}-{r['k']}": r["ids"] for r in names})
    before = found["all"]
    probes = spark.createDataFrame([(r["criterion"], r["k"], float(found[f"{r['criterion']}-{r['k']}"])) for r in names], "criterion string, k int, probe_auroc double")
    deep = spark.createDataFrame([(c, max(r["k"] for r in names if r["criterion"] == c)) for c in {r["criterion"] for r in names}], "criterion string, last int")
    out = area.join(F.broadcast(probes), ["criterion", "k"]).join(F.broadcast(deep), "criterion").withColumn("extraction_drop", whole - F.col("auroc")).withColumn("probe_delta", F.col("probe_auroc") - before)
    good, kept = F.round("extraction_drop", 9) >= EXTRACTION_DROP, F.round(F.abs("probe_delta"), 9) <= PROBE_CHANGE
    return out.select(
        "criterion", "k", F.col("auroc").alias("recon_auroc"), "extraction_drop", "probe_auroc", "probe_delta",
        good.alias("passes_extraction"), kept.alias("preserves_probe"), F.when(F.col("k") == F.col("last"), good & kept).alias("verdict"),
    )


def ablated_scores(codes: DataFrame, base: DataFrame, weights: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """Direction scores of reconstruction and residual after features are removed, by linearity.

    ``base``: doc_id, label, k_recon, k_resid; ``weights``: feature_id, c (its decoder row
    along the direction); ``chosen``: by, feature_id.  Nothing is decoded again."""
    part = codes.join(F.broadcast(weights), "feature_id").join(F.broadcast(chosen), "feature_id").groupBy(*by, "doc_id").agg(F.sum(F.col("z") * F.col("c")).alias("cut"))  # tables of features
    grid = base.crossJoin(F.broadcast(chosen.select(*by).distinct()))
    cut = F.coalesce("cut", F.lit(0.0))
    return grid.join(part, [*by, "doc_id"], "left").select(*by, "doc_id", "label", (F.col("k_recon") - cut).alias("recon"), (F.col("k_resid") + cut).alias("resid"))


# -- health -----------------------------------------------------------------------------
def feature_stats(codes: DataFrame, dictionary: DataFrame, n_tokens: DataFrame) -> DataFrame:
    """Per feature (dead ones too): fire count, frequency, sum, sum of squares, max, mean and std when active."""
    z = F.col("z")
    s = codes.groupBy("feature_id").agg(F.count(F.lit(1)).alias("fires"), F.sum(z).alias("total"), F.sum(z * z).alias("total_sq"), F.max(z).alias("largest"))
    j = dictionary.select("feature_id").join(s, "feature_id", "left").crossJoin(F.broadcast(n_tokens.select(F.col("n").alias("n_tokens"))))
    fires = F.coalesce("fires", F.lit(0))
    mean = F.col("total") / F.col("fires")
    return j.select(
        "feature_id", fires.alias("fires"), (fires / F.col("n_tokens")).alias("freq"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("total_sq", F.lit(0.0)).alias("total_sq"),
        F.coalesce("largest", F.lit(0.0)).alias("largest"), F.coalesce(mean, F.lit(0.0)).alias("mean_active"),
        F.coalesce(F.sqrt(F.greatest(F.col("total_sq") / F.col("fires") - mean * mean, F.lit(0.0))), F.lit(0.0)).alias("std_active"),
    )


def health_summary(stats: DataFrame) -> DataFrame:
    """Counts of dead, rare, alive, healthy and always-on features, and a verdict on the dead share."""
    f = F.col("freq")
    c = stats.agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(f == 0).alias("dead"), F.count_if((f > 0) & (f < 1e-4)).alias("rare"), F.count_if(f > 0).alias("alive"),
        F.count_if(f >= 1e-3).alias("healthy"), F.count_if(f > 0.5).alias("always_on"), *[F.count_if(f >= t).alias(f"at_least_{n}") for n, t in (("1e5", 1e-5), ("1e4", 1e-4), ("1e3", 1e-3), ("1e2", 1e-2))],
    )
    share = F.col("dead") / F.col("n_features")
    return c.withColumn("verdict", F.when(share > 0.5, "COLLAPSED").when(share > 0.3, "MANY_DEAD").otherwise("ACCEPTABLE"))


def freq_histogram(stats: DataFrame) -> DataFrame:
    """Features by decade of frequency: 0 for none, then up to 1e-6, ..., 1."""
    f = F.col("freq")
    place = F.when(f == 0, 0)
    for i, edge in enumerate((1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1)):
        place = place.when(f < edge, i + 1)
    return stats.groupBy(place.otherwise(7).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def l0_by_threshold(codes: DataFrame, n_tokens: DataFrame, thresholds=(0.0, 1e-3, 1e-2)) -> DataFrame:
    """Mean active features per token above each threshold."""
    c = codes.agg(*[F.count_if(F.col("z") > t).alias(f"c{i}") for i, t in enumerate(thresholds)]).crossJoin(n_tokens)
    return c.select(*[(F.col(f"c{i}") / F.col("n")).alias(f"l0_{i}") for i in range(len(thresholds))])


def top_firing(stats: DataFrame, n_features: int, pct: float = 0.01) -> DataFrame:
    """The most firing share of features, at least one."""
    return stats.select("feature_id", "freq").orderBy(F.desc("freq"), "feature_id").limit(max(1, int(pct * n_features)))


def alive_features(dictionary: DataFrame, stats: DataFrame) -> DataFrame:
    """feature_id, alive: decoder norm at least a tenth of the median and frequency at least 1e-5."""
    n = dictionary.select("feature_id", norm(F.col("w")).alias("w_norm"))
    median = n.agg(F.percentile("w_norm", 0.5).alias("median"))
    return n.join(stats.select("feature_id", "freq"), "feature_id").crossJoin(F.broadcast(median)).select(
        "feature_id", ((F.col("w_norm") >= 0.1 * F.col("median")) & (F.col("freq") >= 1e-5)).alias("alive")
    )


def top_contexts(codes: DataFrame, k: int, salts: int = 16) -> DataFrame:
    """The k strongest documents of each feature with the place of its maximum: feature_id, rank, doc_id, pos, activation.

    Within a document the maximum is an aggregate; the best k are first taken in salted
    parts of a feature, so an always-on feature is no hot window."""
    best = codes.groupBy("feature_id", "doc_id").agg(F.max(F.struct("z", (-F.col("pos")).alias("p"))).alias("m"))
    rows = best.select("feature_id", "doc_id", F.col("m.z").alias("activation"), (-F.col("m.p")).alias("pos"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    order = (F.desc(F.round("activation", 9)), F.asc("doc_id"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("feature_id", "salt").orderBy(*order))).filter(F.col("r") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("feature_id").orderBy(*order))).filter(F.col("rank") <= k)
    return last.select("feature_id", "rank", "doc_id", "pos", "activation")


def with_windows(contexts: DataFrame, tokens: DataFrame, width: int) -> DataFrame:
    """Contexts with ``window``: the tokens (doc_id, pos, token) up to ``width`` places round the maximum, joined by blanks.

    Only the kept contexts, few a feature, meet the tokens, each at 2 * width + 1 places."""
    at = contexts.withColumn("at", F.explode(F.sequence(F.col("pos") - width, F.col("pos") + width)))
    near = at.join(tokens.select("doc_id", F.col("pos").alias("at"), "token"), ["doc_id", "at"])
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ")
    return near.groupBy(*contexts.columns).agg(words.alias("window"))


def random_summary(areas: DataFrame) -> DataFrame:
    """stream: mean, sample std and number over the seeds of random ablations."""
    return areas.groupBy("stream").agg(F.avg("auroc").alias("mean"), F.coalesce(F.stddev_samp("auroc"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n_seeds"))


def usage_balance(stats: DataFrame, target: float) -> DataFrame:
    return stats.agg(F.avg(F.pow(F.col("freq") - target, 2)).alias("usage_balance"), F.avg("freq").alias("mean_rate"))


