"""Bootstraps, permutation nulls and tests.

Every row has a Poisson(1) weight in every replicate, from a hash draw.  AUROCs of all
replicates come from ``replicates.auroc_replicates``, which draws the weights inside the tasks.
Rates at a false-positive rate need the whole curve of a replicate; for them rows are written
out with their weights.  Where class sizes must stay, rows are drawn with replacement from
numbered groups, and a row carries how often it was drawn.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.draws import u01
from corpuslens.functions.vectors import cosine
from corpuslens.operators import metrics as M
from corpuslens.operators import vectors as V
from corpuslens.operators.corpus import exact_rank
from corpuslens.operators.replicates import CELLS, POISSON, SHARED, WEIGHT, auroc_replicates
from corpuslens.sources.scratch import settled

#: Places of a group whose draws are counted by one task at a time.
PLACES = 1024
#: What to do with a replicate that holds one class only: leave it out, take the metric's value for it, or draw again.
SINGLE_CLASS, REDRAWS = ("skip", "keep", "redraw"), 10


def weighted(scores: DataFrame, replicates: int, seed: int, key: str = "doc_id") -> DataFrame:
    """Rows of every replicate b with their weight; rows of weight 0 are left out."""
    rows = scores.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.floor(F.col("b") / SHARED).cast("string"), F.col(key).cast("string")))
    draw = F.conv(F.substr(hashed, 8 * (F.col("b") % SHARED) + 1, F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)
    weight = sum((draw >= F.lit(c)).cast("int") for c in POISSON)
    return rows.withColumn("weight", weight).filter("weight > 0")


def stratified_weights(scores: DataFrame, replicates: int, seed: int, by: list[str], key: str = "doc_id") -> DataFrame:
    """``scores`` with ``weights``: how often each row is drawn in each replicate (packed), as many draws with replacement from each group as it has rows.

    Draw j of replicate b has the same hash in all groups and falls on a place of the group's seeded
    order.  Tasks make the draws of a range of j for all replicates and groups, and send each range of
    PLACES places its hits in one piece, so no row is written for a draw.  Rows that are never drawn go."""
    own = exact_rank(scores, by, seed, key)
    chunk = max(1, CELLS // replicates)
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    ranges = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))))
    dealt = ranges.repartition(parts, "chunk").sortWithinPartitions("chunk")
    kinds = [f"`{c}` {sizes.schema[c].dataType.simpleString()}" for c in by]

    def hits(batches):
        held, draws = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                n, at = batch.column("n")[i].as_py(), batch.column("chunk")[i].as_py()
                if at != held:
                    tails = [str(j).encode() for j in range(at * chunk, (at + 1) * chunk)]
                    heads = [f"{seed}|{b}|".encode() for b in range(replicates)]
                    raw = b"".join([md5(h + t).digest()[:4] for h in heads for t in tails])
                    held, draws = at, np.frombuffer(raw, ">u4").reshape(replicates, chunk) / 4294967296.0
                place = np.floor(draws[:, : n - at * chunk] * n).astype(np.int64)
                hit = (place % PLACES * replicates + np.arange(replicates)[:, None]).ravel().astype("<u4")
                bucket = (place // PLACES).ravel()
                order = np.argsort(bucket, kind="stable")
                hit, bucket = hit[order], bucket[order]
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                group = batch.select(by).slice(i, 1).columns
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    yield pa.RecordBatch.from_arrays([*group, pa.array([bucket[a]]), pa.array([hit[a:z].tobytes()], pa.binary())], [*by, "bucket", "hits"])

    def counted(t: pa.Table) -> pa.Table:
        w = np.zeros(PLACES * replicates, np.int64)
        for piece in t["hits"].to_pylist():
            w += np.bincount(np.frombuffer(piece, "<u4"), minlength=len(w))
        w = w.reshape(PLACES, replicates)
        at = np.flatnonzero(w.any(1))
        if w.max(initial=0) > np.iinfo(WEIGHT).max:
            raise ValueError("a row was drawn too often for a packed weight")
        group = [pa.array([t[c][0].as_py()] * len(at), t.schema.field(c).type) for c in by]
        packed = pa.array([x.tobytes() for x in w[at].astype(WEIGHT)], pa.binary())
        return pa.Table.from_arrays([*group, pa.array(t["bucket"][0].as_py() * PLACES + at), packed], [*by, "place", "weights"])

    pieces = dealt.mapInArrow(hits, ", ".join([*kinds, "bucket long, hits binary"]))
    weights = pieces.groupBy(*by, "bucket").applyInArrow(counted, ", ".join([*kinds, "place long, weights binary"]))
    # made of few sizes, the weights look small enough to be sent to all tasks, which they are not
    return own.withColumn("place", F.col("place").cast("long")).join(weights.hint("merge"), [*by, "place"]).drop("place")


def interval(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean, 2.5 and 97.5 percentiles, sample std and number of replicates."""
    q = F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))
    out = values.groupBy(*by).agg(F.avg(column).alias("mean"), q.alias("q"), F.stddev_samp(column).alias("std"), F.count(column).alias("n_valid"))
    return out.select(*by, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "std", "n_valid")


def replicates_of(scores: DataFrame, by: list[str], groups: list[str], replicates: int, seed: int, metric: str = "auroc", single_class: str = "skip", key: str = "doc_id") -> DataFrame:
    """by, groups, b, metric of every replicate; rows of a key get the same weight in all ``groups`` of a replicate."""
    if single_class not in SINGLE_CLASS:
        raise ValueError(f"single_class is one of {SINGLE_CLASS}")
    keys = [*by, *groups, "b"]

    def of(numbers: int | list[int], seed: int) -> DataFrame:
        if metric == "auroc":
            return auroc_replicates(scores, keys[:-1], numbers, seed, key).withColumnRenamed("auroc", "metric")
        rows = weighted(scores, replicates, seed, key)
        return M.METRICS[metric](rows if isinstance(numbers, int) else rows.filter(F.col("b").isin(numbers)), keys, "weight")

    values = of(replicates, seed)
    lost = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    if single_class == "skip":
        values = values.filter(~lost)
    for attempt in range(1, REDRAWS + 1 if single_class == "redraw" else 1):
        values = settled(values, "replicates")  # each attempt reads it several times
        missing = settled(values.filter(lost).select(*by, "b").distinct(), "missing")
        numbers = [r["b"] for r in missing.select("b").distinct().collect()]  # at most `replicates`
        if not numbers:
            break
        again = settled(of(numbers, seed + 1_000_003 * attempt).join(missing, [*by, "b"], "left_semi"), "redrawn")  # a draw may also leave no row
        values = values.join(again.select(*by, "b").distinct(), [*by, "b"], "left_anti").unionByName(again)
    return values.select(*keys, "metric")


def bootstrap_ci(scores: DataFrame, by: list[str], replicates: int, seed: int, metric: str = "auroc", single_class: str = "skip") -> DataFrame:
    """Interval of a metric by group."""
    return interval(replicates_of(scores, by, [], replicates, seed, metric, single_class), by, "metric")


def long_scores(wide: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """One row per score name: keep, score, value."""
    pairs = F.array(*[F.struct(F.lit(n).alias("score"), F.col(n).alias("value")) for n in names])
    return wide.select(*keep, F.explode(pairs).alias("s")).select(*keep, "s.score", "s.value")


def full_signs(wide: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, sign_a, sign_b, margin: how each score is oriented on the full sample, and the difference of the oriented AUROCs."""
    full = M.oriented(M.auroc(long_scores(wide, [a, b], [*by, "label"]), [*by, "score"]))
    pick = lambda n, c: F.max(F.when(F.col("score") == n, F.col(c)))
    return full.groupBy(*by).agg(pick(a, "sign").alias("sign_a"), pick(b, "sign").alias("sign_b"), (pick(a, "auroc_bi") - pick(b, "auroc_bi")).alias("margin"))


def paired_difference(wide: DataFrame, a: str, b: str, replicates: int, seed: int, by: list[str], signed: bool = False, metric: str = "auroc", single_class: str = "skip") -> DataFrame:
    """Difference of the metrics of scores a and b over the same draws: by, b, delta.

    With ``signed`` each score is first oriented as on the full sample, once for all replicates."""
    rows = wide
    if signed:
        rows = wide.join(F.broadcast(full_signs(wide, a, b, by).drop("margin")), by)  # one row per group
        rows = rows.withColumn(a, F.col(a) * F.col("sign_a")).withColumn(b, F.col(b) * F.col("sign_b")).drop("sign_a", "sign_b")
    own = replicates_of(long_scores(rows, [a, b], [*by, "doc_id", "label"]), by, ["score"], replicates, seed, metric, single_class)
    pick = lambda n: F.max(F.when(F.col("score") == n, F.col("metric")))
    return own.groupBy(*by, "b").agg((pick(a) - pick(b)).alias("delta")).filter("delta IS NOT NULL")


def margin_table(wide: DataFrame, a: str, b: str, replicates: int, seed: int, by: list[str]) -> DataFrame:
    """by, margin of the full sample, its interval with locked signs, and whether that excludes zero."""
    ci = interval(paired_difference(wide, a, b, replicates, seed, by, signed=True), by, "delta")
    excludes = (F.col("low") > 0) | (F.col("high") < 0)
    return full_signs(wide, a, b, by).select(*by, "margin").join(ci, by).withColumn("excludes_zero", excludes)


def refresh_intervals(scores: DataFrame, old: DataFrame, by: list[str], replicates: int, seed: int, metric: str = "auroc") -> DataFrame:
    """Intervals computed anew beside the recorded ones (by, low, high of ``old``), with their differences; groups never recorded have null."""
    new = bootstrap_ci(scores, by, replicates, seed, metric)
    was = old.select(*by, F.col("low").alias("old_low"), F.col("high").alias("old_high"))
    return new.join(was, by, "left").withColumn("d_low", F.col("low") - F.col("old_low")).withColumn("d_high", F.col("high") - F.col("old_high"))


def append_history(history: DataFrame, refreshed: DataFrame, by: list[str], run: int) -> DataFrame:
    """The history (by, run, low, high) with the refreshed intervals as a further run."""
    return history.unionByName(refreshed.select(*by, F.lit(run).alias("run"), "low", "high"))


def permuted_labels(rows: DataFrame, permutations: int, seed: int, key: str = "doc_id") -> DataFrame:
    """rows for each permutation m with ``permuted``: the P smallest draws are 1, so class sizes stay."""
    p = rows.agg(F.sum("label").alias("p"))
    grid = rows.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    ranked = exact_rank(grid, ["m"], seed, key, also=("m",))
    return ranked.crossJoin(F.broadcast(p)).withColumn("permuted", (F.col("place") < F.col("p")).cast("int")).drop("place", "p")


def sign_test(rows: DataFrame, margin: str, excludes: str = "excludes_zero") -> DataFrame:
    """Exact one-sided sign test of positive margins, and a decision.

    ACCEPT: p < .05 and at least three rows whose interval excludes zero; NUANCED: p < .05
    and at least two; else NULL."""
    c = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(margin) > 0).alias("k"), F.count_if(excludes).alias("n_excluding"))
    # C(n, i) by the product of (n - j) / (j + 1)
    comb = lambda i: F.aggregate(F.sequence(F.lit(1), i), F.lit(1.0), lambda a, j: a * (F.col("n") - i + j) / j)
    terms = F.transform(F.sequence(F.col("k"), F.col("n")), lambda i: F.when(i == 0, 1.0).otherwise(comb(F.greatest(i, F.lit(1)))))
    p = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.pow(F.lit(2.0), F.col("n"))
    small = F.col("p_value") < 0.05
    decision = F.when(small & (F.col("n_excluding") >= 3), "ACCEPT").when(small & (F.col("n_excluding") >= 2), "NUANCED").otherwise("NULL")
    return c.withColumn("p_value", F.round(p, 9)).withColumn("decision", decision)


def permuted_directions(acts: DataFrame, d_r, permutations: int, seed: int, alpha: float = 1.0) -> DataFrame:
    """m, c: cosine of the first contrastive direction under permuted labels with a fixed direction ``d_r``.

    The places of every permutation's ones are gathered per row; each task adds up the
    outer products of its ones for all permutations by one block product each, and one
    small matrix a permutation is solved where its sums meet."""
    ones = permuted_labels(acts.select("doc_id", "label"), permutations, seed).filter("permuted = 1")
    held = ones.groupBy("doc_id").agg(F.collect_list("m").alias("ms"))  # at most `permutations` numbers
    rows = acts.select("doc_id", "h").join(held, "doc_id", "left").select("h", "ms")
    d_r = np.asarray(d_r, float)

    def partial(batches):
        sums = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            x = np.hstack([x, np.ones((len(x), 1))])  # the last row and column hold sums and counts
            mask = np.zeros((permutations + 1, len(x)), bool)
            mask[permutations] = True
            for i, own in enumerate(batch.column(1).to_pylist()):
                mask[own or [], i] = True
            for m in range(permutations + 1):
                own = x[mask[m]]
                sums[m] = sums.get(m, 0.0) + own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([g.ravel().tolist() for g in sums.values()], pa.list_(pa.float64()))], ["m", "g"])

    parts = rows.mapInArrow(partial, "m int, g array<double>")
    whole = parts.filter(F.col("m") == permutations).select(F.col("g").alias("whole"))

    def covariance(g: np.ndarray) -> np.ndarray:
        n = g[-1, -1]
        return (g[:-1, :-1] - np.outer(g[-1, :-1], g[-1, :-1]) / n) / (n - 1)

    total = sum(np.array(r["whole"]) for r in whole.collect())  # one d-by-d matrix a task

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        size = len(d_r) + 1
        one = np.sum(np.stack(own["g"]), axis=0).reshape(size, size)
        values, vectors = np.linalg.eigh(covariance(one) - alpha * covariance(total.reshape(size, size) - one))
        v = vectors[:, int(np.argmax(np.abs(values)))]
        return pd.DataFrame({"m": [int(own["m"].iloc[0])], "c": [float(v @ d_r / (np.linalg.norm(v) * np.linalg.norm(d_r) + 1e-12))]})

    return parts.filter(F.col("m") < permutations).groupBy("m").applyInPandas(solve, "m int, c double")


def null_summary(null: DataFrame, observed: float) -> DataFrame:
    """Two-sided p-value (#{|c| >= |observed|} + 1) / (M + 1), mean, sample std and 2.5 and 97.5 percentiles of a null (column c)."""
    q = F.percentile("c", F.array(F.lit(0.025), F.lit(0.975)))
    p = (F.count_if(F.abs("c") >= abs(observed)) + 1) / (F.count(F.lit(1)) + 1.0)
    out = null.agg(F.avg("c").alias("mean"), F.stddev_samp("c").alias("std"), q.alias("q"), p.alias("p_value"), F.count(F.lit(1)).alias("n"))
    return out.select(F.lit(float(observed)).alias("observed"), "mean", "std", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p_value", "n")


def heldout_streams(parts: DataFrame, splits: int, frac: float, seed: int) -> DataFrame:
    """split, doc_id, label, stream, value: scores of held-out rows along the mean difference fitted on the others.

    ``parts``: doc_id, label, h, recon, resid.  Each class is cut at round(frac * n) places of
    its own order in every split.  The AUROC does not depend on centring, so none is done."""
    grid = parts.select("doc_id", "label").withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    sizes = parts.groupBy("label").agg(F.count(F.lit(1)).alias("n_class"))
    ranked = exact_rank(grid, ["split", "label"], seed, also=("split",)).join(F.broadcast(sizes), "label")  # one row per class
    cut = ranked.select("doc_id", "split", (F.col("place") < F.bround(F.col("n_class") * frac)).alias("in_a"))
    rows = parts.join(cut, "doc_id")
    d = V.mean_diff(rows.filter("in_a"), ["split"]).select("split", "d")
    b = rows.filter("NOT in_a").join(F.broadcast(d), "split")  # one direction a split
    pairs = [F.struct(F.lit(s).alias("stream"), F.round(V.project(F.col(s), F.col("d")), 9).alias("value")) for s in ("h", "recon", "resid")]
    cosine_ = F.round(cosine(F.col("h"), F.col("recon")), 9)
    return b.select("split", "doc_id", "label", cosine_.alias("recon_cos"), F.explode(F.array(*pairs)).alias("s")).select("split", "doc_id", "label", "recon_cos", "s.stream", "s.value")


def heldout_splits(streams: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Per split: class sizes, AUROC of the three streams, row cosine, and the drop (vector less reconstruction) with its interval."""
    area = M.auroc(streams, ["split", "stream"])
    pick = lambda n: F.max(F.when(F.col("stream") == n, F.col("auroc")))
    wide = area.groupBy("split").agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), *[pick(n).alias(f"auroc_{n}") for n in ("h", "recon", "resid")])
    cos = streams.filter("stream = 'h'").groupBy("split").agg(F.avg("recon_cos").alias("recon_cos"))
    two = streams.filter("stream <> 'resid'").groupBy("split", "doc_id", "label").agg(*[F.max(F.when(F.col("stream") == n, F.col("value"))).alias(n) for n in ("h", "recon")])
    ci = interval(paired_difference(two, "h", "recon", replicates, seed, ["split"]), ["split"], "delta")
    return wide.join(cos, "split").join(ci.withColumnsRenamed({"mean": "drop", "low": "drop_low", "high": "drop_high", "std": "drop_std"}).drop("n_valid"), "split")


def heldout_decision(splits: DataFrame, inside: DataFrame, least_resid: float = 0.70) -> DataFrame:
    """Summary over splits against the drop within the partition (``inside``: one row mean, std), the 2-sigma check and the decision.

    ACCEPT: the mean drop is within one sigma and the mean residual AUROC at least
    ``least_resid``; MARGINAL: within two sigma; else NULL."""
    names = ("auroc_h", "auroc_recon", "auroc_resid", "recon_cos", "drop")
    q = F.percentile("drop", F.array(F.lit(0.025), F.lit(0.975)))
    s = splits.agg(*[F.avg(n).alias(f"{n}_mean") for n in names], *[F.stddev_pop(n).alias(f"{n}_std") for n in names], q.alias("q"), F.count(F.lit(1)).alias("n_splits"))
    j = s.crossJoin(F.broadcast(inside.select(F.col("mean").alias("inside_drop"), F.col("std").alias("inside_sigma"))))
    off, sigma = F.abs(F.col("drop_mean") - F.col("inside_drop")), F.col("inside_sigma")
    decision = F.when((off <= sigma) & (F.col("auroc_resid_mean") >= least_resid), "ACCEPT").when(off <= 2 * sigma, "MARGINAL").otherwise("NULL")
    return (
        j.withColumn("drop_low", F.col("q")[0]).withColumn("drop_high", F.col("q")[1]).drop("q")
        .withColumn("drop_difference", F.col("drop_mean") - F.col("inside_drop")).withColumn("threshold", F.col("inside_drop") - 2 * sigma)
        .withColumn("check_passed", F.col("drop_mean") > F.col("threshold")).withColumn("decision", decision)
    )


def holm(df: DataFrame, p: str, by: list[str], key: str) -> DataFrame:
    """Holm-Bonferroni adjusted p-values within each family.

    Places and running maxima are taken in buckets of p, so a large family is not sorted
    by one task; of equal p-values the first in order has the largest factor, so all get its value."""
    counts = df.groupBy(*by, p).agg(F.count(F.lit(1)).alias("n_same"))
    sizes = counts.groupBy(*by).agg(F.sum("n_same").alias("n_all"))
    placed = M.cumulated(counts, by, p, {"n_before": "n_same"}).join(sizes, by)
    scaled = M.bucketed(placed.withColumn("scaled", (F.col("n_all") - F.col("n_before")) * F.col(p)), p)
    inner = Window.partitionBy(*by, "bucket").orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = scaled.groupBy(*by, "bucket").agg(F.max("scaled").alias("top"))
    outer = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*by, "bucket", F.max("top").over(outer).alias("top_before"))
    run = scaled.withColumn("run", F.max("scaled").over(inner)).join(before, [*by, "bucket"])
    adjusted = run.select(*by, p, F.least(F.greatest("run", F.coalesce("top_before", "run")), F.lit(1.0)).alias("p_adjusted"))
    return df.join(adjusted, [*by, p])


def bootstrap_kernel(wide: DataFrame, names: list[str], group: str, replicates: int, seed: int) -> DataFrame:
    """AUROCs of every replicate: group, b, one column per score (null for a replicate of one class); the same draws for all scores.

    For many replicates: draws come from a counter-based generator."""
    long_ = long_scores(wide, names, [group, "doc_id", "label"])
    values = auroc_replicates(long_, [group, "score"], replicates, seed, draws="philox").filter("n_pos > 0 AND n_neg > 0")
    return values.groupBy(group, "b").agg(*[F.max(F.when(F.col("score") == n, F.col("auroc"))).alias(n) for n in names])
