"""Queries of probes, confound checks, nulls that refit, and streams."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpuslens.functions.draws import r6
from corpuslens.functions.vectors import scaled
from corpuslens.operators import controls as K
from corpuslens.operators import corpus as C
from corpuslens.operators import dictionary as D
from corpuslens.operators import metrics as M
from corpuslens.operators import probes as P
from corpuslens.operators import vectors as V
from corpuslens.operators.ordered import numbered
from corpuslens.plans.base import CTE, acts, dictionary, pool, query, scratch, settled, table
from corpuslens.plans.corpus_queries import KEY, STRIP
from corpuslens.plans.metric_queries import _pairs
from corpuslens.plans.vector_queries import TOP, _dict, _token_codes
from corpuslens.streaming import streams as S

ROUNDED = ("auroc", "auroc_bi", "tpr_0_01", "tpr_0_05", "fold_mean", "fold_std")


def _card(out):
    return out.select(*[r6(c).alias(c) if c in ROUNDED else c for c in out.columns])


@query("c6_bow_audit")
def c6(spark, d):
    return _card(P.bow_audit(pool(spark, d, "toxic")))


@query("c7_length_audit")
def c7(spark, d):
    return _card(P.length_audit(pool(spark, d)))


def _halves(spark, d):
    p = C.split_frac(pool(spark, d, "toxic"), 0.7, 17)
    return p.filter("in_a"), p.filter("NOT in_a")


@query("c8_bow_forest")
def c8(spark, d):
    return _card(P.bow_forest(*_halves(spark, d)))


@query("c9_tfidf_logistic")
def c9(spark, d):
    return _card(P.tfidf_logistic(*_halves(spark, d)))


@query("h1_linear_probe")
def h1(spark, d):
    """Standardised on the training folds, and as they are."""
    own, plain = (_card(P.linear_probe(acts(spark, d), standardised=s)).withColumn("standardised", F.lit(s)) for s in (True, False))
    return own.unionByName(plain)


@query("h2_probe_bank")
def h2(spark, d):
    """A frozen bank over seeds and folds, fitted on raw vectors, scored on vectors with and without d_K."""
    a, seeds = acts(spark, d), [0, 1, 2]
    bank, digest = P.fold_bank(a, seeds)
    w = a.crossJoin(F.broadcast(V.mean_diff(a)))
    cut = w.withColumn("h", F.zip_with("h", scaled(scaled(F.col("d"), 1.0 / F.col("d_norm")), V.project(F.col("h"), F.col("d"))), lambda x, y: x - y))
    both = P.fold_scores(a, bank, seeds).withColumn("kind", F.lit("raw")).unionByName(P.fold_scores(cut, bank, seeds).withColumn("kind", F.lit("erased")))
    return M.auroc(both, ["kind", "seed", "fold"]).select("kind", "seed", "fold", r6("auroc").alias("auroc"), F.lit(digest).alias("bank_sha256"))


@query("h3_mlp_probe")
def h3(spark, d):
    """256 hidden units against a linear probe, with intervals."""
    out = _card(P.mlp_against_linear(acts(spark, d), 64))
    return out.select("probe", *[r6(c).alias(c) if c in ("low", "high", "gap", "gap_low", "gap_high") else c for c in out.columns if c != "probe"])


@query("h4_code_probe")
def h4(spark, d):
    """Probe on sparse codes before and after the 16 features that follow the label most are dropped."""
    a, w = _dict(spark, d)
    codes = D.encode(a, w)
    n = a.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    top = [r[0] for r in D.ranked(D.feature_label_corr(codes, n), "r").filter("place <= 16").select("feature_id").collect()]  # 16 ids
    before = _card(P.code_probe(codes, len(w.ids), a)).withColumn("dropped", F.lit(0))
    return before.unionByName(_card(P.code_probe(codes, len(w.ids), a, top)).withColumn("dropped", F.lit(len(top))))


@query("h5_probe_components")
def h5(spark, d):
    """Direction score against a fresh probe on vector, reconstruction and residual, also at unit length."""
    a, w = _dict(spark, d)
    out = P.component_table(settled(D.decompose(a, w), "decomposed"), V.mean_diff(a))
    return out.select("stream", *[r6(c).alias(c) for c in ("direction_auroc", "probe_auroc", "fold_mean", "fold_std", "gap")])


@query("g6_permutation_probe")
def g6(spark, d):
    """AUROC of probes refitted on permuted labels with fresh folds, over all vectors."""
    null = P.permutation_probe(acts(spark, d), 100, 5, 6)
    return null.agg(r6(F.avg("auroc")).alias("mean"), r6(F.stddev_samp("auroc")).alias("std"), r6(F.max("auroc")).alias("highest"), F.count(F.lit(1)).alias("n"))


@query("g8_random_subsets")
def g8(spark, d):
    """Sufficiency of the features that follow d_K, against 1,000 random subsets of as many, of 50 and of 100."""
    a, w = _dict(spark, d)
    basis = np.array([v for _, _, v in V.contrastive_pca(a, 10)])
    dk = np.array(V.mean_diff(a).first()["d"])
    along = np.abs(w.dec @ dk) / np.linalg.norm(w.dec, axis=1)
    chosen = np.flatnonzero(along > 2 * along.mean())
    seen = spark.createDataFrame([(len(chosen), D.feature_sufficiency(basis, w.dec[chosen]))], "size int, observed double")
    out = D.null_table(D.sufficiency_null(spark, basis, w.dec, [len(chosen), 50, 100], 1000, 8), seen)
    return out.select("size", "n_random", *[r6(c).alias(c) for c in out.columns[2:]])


@query("i8_ablation_controls")
def i8(spark, d):
    """AUROC of a frozen probe after erasing d_K, each of 100 random directions, or nothing.

    Erasing u changes a score by (h.u)(u.w), so one pass scores all directions."""
    a = acts(spark, d)
    (_, weights, bias), = P.probe_bank(a, [0])
    dk = np.array(V.mean_diff(a).first()["d"])
    names = ["identity", "d_k", *(f"random_{i}" for i in range(100))]
    u = np.vstack([np.zeros_like(dk), dk / np.linalg.norm(dk), V.random_directions(100, len(dk), 31)])
    along = u @ weights
    table_ = spark.createDataFrame([(i, n, float(along[i])) for i, n in enumerate(names)], "direction int, control string, c double")  # a row a direction
    own = a.select("label", F.concat("h", F.array(F.aggregate(F.zip_with("h", F.array(*[F.lit(float(x)) for x in weights]), lambda p, q: p * q), F.lit(float(bias)), lambda s, x: s + x))).alias("h"))
    # the last component carries the plain score; directions read it with a unit weight
    whole = np.hstack([-u * along[:, None], np.ones((len(u), 1))])
    scored = V.direction_scores(own, whole).join(F.broadcast(table_), "direction").select("control", "label", F.round("value", 9).alias("value"))
    return M.auroc(scored, ["control"]).select("control", r6("auroc").alias("auroc"))


@query("i8_residual_controls")
def i8_residual(spark, d):
    """AUROC of frozen probes after the residual's leading directions are erased, and under four controls."""
    a, w = _dict(spark, d)
    out = K.ablation_controls(K.control_scores(a, w, P.probe_bank(a, [0, 1]), rank=10))
    return out.select("control", "n_seeds", *[r6(c).alias(c) for c in ("mean", "std", "pct05", "pct50", "pct95")])


@query("i9_decisive_rule")
def i9_decisive(spark, d):
    """Whether the drop from erasing the residual's leading directions beats its controls, at three ranks."""
    from corpuslens.operators import cohort

    a, w = _dict(spark, d)
    bank, rows = P.probe_bank(a, [0]), None
    for rank in (2, 5, 10):
        own = K.ablation_controls(K.control_scores(a, w, bank, rank=rank))
        own = own.withColumn("cell", F.lit(rank))
        rows = own if rows is None else rows.unionByName(own)
    pick = lambda n, c: F.max(F.when(F.col("control") == n, F.col(c)))
    cells = rows.groupBy("cell").agg(
        pick("identity", "mean").alias("auroc_h"), (pick("identity", "mean") - pick("primary", "mean")).alias("delta"),
        pick("random", "pct05").alias("random_pct05"), pick("noise", "pct05").alias("noise_pct05"), pick("mask", "mean").alias("mask_mean"), pick("mask", "std").alias("mask_std"),
    )
    return cells.select("cell", r6("delta").alias("delta")).join(cohort.decisive(cells), "cell")


@query("i2_rank_by_probe")
def i2_probe(spark, d):
    """Features by their weight in a probe on scaled codes."""
    a, w = _dict(spark, d)
    return D.ranked(P.rank_by_probe(D.encode(a, w), a, len(w.ids)), "score").select("feature_id", r6("score").alias("score"), "place")


def beta_p(rho: float, n: int) -> float:
    """Two-sided p-value of a correlation by Student's t, with the incomplete beta's continued fraction."""
    if n < 3 or not abs(rho) < 1:
        return 0.0 if n >= 3 else 1.0
    a, b, x = (n - 2) / 2, 0.5, 1 - rho * rho
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0

    def fraction(p, q, y):
        c, dd = 1.0, 1 / max(1 - (p + q) * y / (p + 1), 1e-300)
        h = dd
        for m in range(1, 500):
            for t in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                dd = 1 / (1 + t * dd)
                c = 1 + t / c
                h *= c * dd
            if abs(c * dd - 1) < 1e-14:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


@query("f11_spearman_p")
def f11(spark, d):
    p = F.pandas_udf(lambda r, n: pd.Series([beta_p(float(x), int(k)) for x, k in zip(r, n, strict=True)]), "double")
    return M.spearman(_pairs(spark, d), "x", "y", ["lang"]).select("lang", "n", r6("rho").alias("rho"), r6(p("rho", "n")).alias("p_value"))


@query("l1_corpus_stream", f"SELECT DISTINCT md5({KEY}) AS digest FROM documents WHERE length({STRIP}) >= 20 AND md5({KEY}) NOT IN (SELECT md5({KEY}) FROM documents JOIN labels USING (doc_id))")
def l1(spark, d):
    """The stream drained once; which copy of a text stays is arrival order, the digests are not."""
    src, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs.repartition(6).write.parquet(src)
    own = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(F.md5(C.dedupe_key()).alias("digest"))
    S.corpus_stream(spark, src, own, out, scratch(spark, "stream-state")).awaitTermination()
    return spark.read.schema("digest STRING").json(out).select("digest")


@query("l2_health_stream", "SELECT feature_id, count(*) AS fires, round(sum(z), 5) AS total, round(sum(z * z), 5) AS total_sq, round(max(z), 6) AS largest FROM codes_t GROUP BY feature_id")
def l2(spark, d):
    a, w = _dict(spark, d)
    src, out = scratch(spark, "codes"), scratch(spark, "health")
    D.encode(a, w).select("feature_id", "z").repartition(3).write.parquet(src)
    S.health_stream(spark, src, out, scratch(spark, "state")).awaitTermination()
    return S.newest(spark, out).select("feature_id", "fires", F.round("total", 5).alias("total"), F.round("total_sq", 5).alias("total_sq"), r6("largest").alias("largest"))


LATE = "SELECT doc_id % 5 AS step, doc_id * 37 % 1000 AS minute FROM documents"


@query(
    "l1_late_rows",
    f"""WITH f AS ({LATE}), w AS (SELECT step, max(max(minute)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 200 AS mark FROM f GROUP BY step)
    SELECT count(*) AS n_read, count(*) FILTER (minute <= mark) AS n_late FROM f JOIN w USING (step)""",
)
def l1l(spark, d):
    """Files of texts with time stamps in no order: how many rows came later than the watermark of 200 minutes.

    Spark raises the watermark after a batch, and holds the next batch's rows against the one before."""
    src, out = scratch(spark, "stamped-in"), scratch(spark, "stamped-out")
    minute = (F.col("doc_id") * 37 % 1000).cast("double")
    docs = table(spark, d, "documents").select("doc_id", "text", F.timestamp_seconds(1_700_000_000 + 60 * minute).alias("stamp"), (F.col("doc_id") % 5).alias("step"))
    docs.repartition("step").write.partitionBy("step").parquet(src)
    S.arrived_in_order(spark, src)
    query_ = S.timed_corpus_stream(spark, src, out, scratch(spark, "stamped-state"), "200 minutes")
    query_.awaitTermination()
    return docs.agg(F.count(F.lit(1)).alias("n_read")).withColumn("n_late", F.lit(S.late_rows(query_)).cast("long"))


#: Tokens of a step, the budget, steps of a window, and the rate below which a feature is dead.
STEP, BUDGET, EVERY, DEAD = 24, 100, 2, 0.05
CTE["step_t"] = f"SELECT doc_id, CAST(sum(1) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) // {STEP} AS step FROM acts_t"
CTE["taken_t"] = f"SELECT doc_id, step FROM step_t WHERE step < {-(-BUDGET // STEP)}"


#: Steps in a file of the stream.
FILE = 512


def _budgeted(spark, d):
    """The stream of vectors in steps, run to its budget: its tables."""
    a, w = _dict(spark, d)
    src, out = scratch(spark, "steps-in"), scratch(spark, "steps-out")
    placed = numbered(a.select("doc_id"), ["doc_id"])
    codes = D.encode(a, w).groupBy("doc_id").agg(F.collect_list(F.struct("feature_id", "z")).alias("codes"))  # at most the model's features
    rows = placed.join(codes, "doc_id", "left").select(F.col("doc_id").alias("token"), "codes", F.floor(F.col("place") / STEP).alias("step"))
    rows = rows.withColumn("file", F.floor(F.col("step") / FILE))
    rows.repartition("file").write.partitionBy("file").parquet(src)
    S.arrived_in_order(spark, src)
    return S.budgeted_health_stream(spark, src, out, scratch(spark, "steps-state"), BUDGET, EVERY)


@query("l2_health_budget", "SELECT feature_id, count(*) AS fires, round(sum(z), 5) AS total, round(sum(z * z), 5) AS total_sq, round(max(z), 6) AS largest, (SELECT count(*) FROM taken_t) AS n_tokens FROM codes_t JOIN taken_t USING (doc_id) GROUP BY feature_id")
def l2b(spark, d):
    """Sums of the steps until the budget of tokens is reached; later steps are not read."""
    t = _budgeted(spark, d)
    n = t["steps"].agg(F.sum("tokens").alias("n_tokens"))
    out = t["sums"].crossJoin(F.broadcast(n))  # one row
    return out.select("feature_id", "fires", F.round("total", 5).alias("total"), F.round("total_sq", 5).alias("total_sq"), r6("largest").alias("largest"), "n_tokens")


@query(
    "l2_dead_by_window",
    f"""WITH s AS (SELECT step // {EVERY} AS w, count(*) AS tokens, count(DISTINCT step) AS n FROM taken_t GROUP BY 1), f AS (SELECT step // {EVERY} AS w, feature_id, count(*) AS fires FROM codes_t JOIN taken_t USING (doc_id) GROUP BY ALL)
    SELECT s.w AS "window", tokens, count(*) FILTER (coalesce(fires, 0) / greatest(tokens, 1) < {DEAD}) AS n_dead FROM s CROSS JOIN dict_t LEFT JOIN f ON f.w = s.w AND f.feature_id = dict_t.feature_id WHERE n = {EVERY} GROUP BY s.w, tokens""",
)
def l2w(spark, d):
    """Features that hardly fire in each window of two steps; counters begin anew with each."""
    t = _budgeted(spark, d)
    return S.dead_by_window(t["windows"], t["steps"], dictionary(spark, d), EVERY, DEAD)


@query("l3_topk_stream", TOP)
def l3(spark, d):
    src, out = scratch(spark, "codes"), scratch(spark, "contexts")
    _token_codes(spark, d).repartition(3).write.parquet(src)
    S.topk_stream(spark, src, 5, out, scratch(spark, "state")).awaitTermination()
    return S.newest(spark, out).select("feature_id", "rank", "doc_id", "pos", r6("activation").alias("activation"))


