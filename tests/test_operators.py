"""Hand-computed tables and properties of the operators."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions.draws import words_of
from corpuslens.operators import cohort as K
from corpuslens.operators import controls
from corpuslens.operators import corpus as C
from corpuslens.operators import dictionary as D
from corpuslens.operators import metrics as M
from corpuslens.operators import probes as P
from corpuslens.operators import replicates as B
from corpuslens.operators import resample as R
from corpuslens.operators import textfeat as X
from corpuslens.operators import tokenscores as T
from corpuslens.operators import vectors as V
from corpuslens.plans.model_queries import beta_p
from corpuslens.sources.texts import vector_manifest


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_auroc_ties_and_single_class(spark):
    s = spark.createDataFrame([("t", 1, 0.5), ("t", 0, 0.5), ("t", 1, 0.7), ("t", 0, 0.2), ("t", 1, 0.2), ("s", 1, 1.0), ("s", 1, 2.0)], "g string, label int, value double")
    got = {r["g"]: r["auroc"] for r in M.auroc(s, ["g"]).collect()}
    assert got["t"] == pytest.approx((0.5 + 1 + 1 + 1 + 0.5) / 6)
    assert got["s"] == 0.5


def test_auroc_of_reverse_and_partitions(spark):
    s = spark.range(500).select((F.col("id") % 3 == 0).cast("int").alias("label"), (F.xxhash64("id") % 40).cast("double").alias("value"))
    a = one(M.auroc(s))["auroc"]
    assert one(M.auroc(s.withColumn("value", -F.col("value"))))["auroc"] == pytest.approx(1 - a)
    assert one(M.auroc(s.repartition(7)))["auroc"] == a


def test_tpr_zero_when_a_negative_leads(spark):
    s = spark.createDataFrame([(0, 9.0), (1, 5.0), (1, 4.0), (0, 1.0)], "label int, value double")
    assert one(M.tpr_at_fpr(s, (), (0.01,)))["tpr_0_01"] == 0.0


def test_impute(spark):
    s = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, float("nan")), (1, float("inf")), (1, None), (2, float("nan"))], "g int, value double")
    got = sorted((r["g"], r["value"]) for r in M.impute(s, ["g"]).collect())
    assert got == [(1, 1.0), (1, 2.0), (1, 2.0), (1, 2.0), (1, 3.0), (2, 0.0)]


def test_dedupe_key_and_window(spark):
    texts = ["a  b", " a b ", "A b", "x" * 4096 + "1", "x" * 4096 + "2", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = sorted(r["n_copies"] for r in C.dedupe_exact(df).collect())
    assert groups == [1, 1, 2, 2]
    kept = C.dedupe_window(df, 1000).count()
    assert kept == len(groups)
    assert C.dedupe_window(df.limit(3).select(F.col("doc_id"), F.when(F.col("doc_id") == 1, "z").otherwise("q").alias("text")), 1).count() == 3


def test_short_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["", " ", "a", "a b", "a b c", "a b c d e f g"])], "doc_id long, text string")
    assert [r[0] for r in df.orderBy("doc_id").select(F.size(words_of(F.col("text")))).collect()] == [0, 0, 1, 2, 3, 7]
    out = {r["doc_id"]: r["text"].split() for r in C.shuffle_windows(df, 1).collect()}
    assert out[3] == ["a", "b"] and sorted(out[4]) == ["a", "b", "c"]
    assert out[5][3] == "d" and sorted(out[5]) == list("abcdefg")


def test_grams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(X.grams(F.col("t"), 3)).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_min_k(spark):
    for n in (1, 4, 5, 9, 10):
        lp = spark.range(n).select(F.lit(1).alias("doc_id"), (-F.col("id")).cast("double").alias("logp"))
        m = max(1, math.floor(0.2 * n))
        assert one(T.min_k(lp, (0.2,)))["min_k_20"] == pytest.approx(sum(-x for x in range(n - m, n)) / m)


def test_rouge_l(spark):
    df = spark.createDataFrame([(list("abcd"), list("acd")), (list("ab"), list("ab"))], "pred array<string>, gold array<string>")
    got = [(r["lcs"], r["exact"]) for r in T.rouge_l(df).collect()]
    assert got == [(2, False), (2, True)]


def test_exact_split_and_folds(spark):
    df = spark.range(101).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in C.split_exact(df, "label", 0.7, 1).filter("in_a").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {1: round(26 * 0.7), 0: round(75 * 0.7)}
    assert C.stratified_folds(df, "label", 5, 1).count() == 101


def test_mix_sources_ignores_zero_weight(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    got = {r["source"]: r["n"] for r in C.mix_sources(df, {"s0": 3.0, "s1": 1.0, "s2": -1.0}, 80, 1).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) == {"s0", "s1"} and sum(got.values()) == 80 and got["s0"] > got["s1"]


def test_decomposition_adds_up(spark):
    rng = np.random.default_rng(0)
    a = spark.createDataFrame([(i, i % 2, rng.normal(size=6).tolist()) for i in range(40)], "doc_id long, label int, h array<double>")
    table = spark.createDataFrame([(i, rng.normal(size=6).tolist(), -0.1) for i in range(9)], "feature_id int, w array<double>, b_enc double")
    w = D.Dictionary(table, np.zeros(6))
    for r in D.decompose(a, w).collect():
        assert np.allclose(np.array(r["recon"]) + np.array(r["resid"]), r["h"])
    top = D.encode(a, D.Dictionary(table, np.zeros(6), "topk", 2)).groupBy("doc_id").count()
    assert top.agg(F.max("count")).first()[0] <= 2
    assert D.encode(a, D.Dictionary(table, np.zeros(6), "topk", 9)).count() == D.encode(a, w).count()


def test_covariance(spark):
    x = np.random.default_rng(1).normal(size=(50, 3))
    a = spark.createDataFrame([(1, r.tolist()) for r in x], "label int, h array<double>").repartition(5)
    rows = sorted(V.covariances(a, ["label"]).collect(), key=lambda r: r["i"])
    assert np.allclose([r["row"] for r in rows], np.cov(x.T))


def test_principal_angles():
    e = np.eye(4)
    assert np.allclose(V.principal_angles(e[:2], e[1:3]), [0, 90])


def plain_auroc(v, y, w):
    p, n = ((np.repeat(v[y == c], w[y == c])) for c in (1, 0))
    return np.mean((p[:, None] > n) + 0.5 * (p[:, None] == n)) if len(p) and len(n) else 0.5


def test_summaries_of_ranges_merge_to_the_whole():
    """Ranges of any size, also of one score that goes on in the next, give the AUROC of all rows."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        v, y, w = np.sort(rng.integers(0, 4, n)).astype(float), rng.integers(0, 2, n), rng.integers(0, 3, (n, 5))
        v[v == 3] = np.nan
        cuts = [0, *sorted(rng.choice(np.arange(1, n), min(n - 1, 4), replace=False).tolist()), n] if n > 1 else [0, 1]
        whole = None
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            own = B.Summary.of(v[a:z], y[a:z], w[a:z])
            whole = own if whole is None else whole.before(own)
        for k in range(5):
            assert whole.pos[k] == w[y == 1, k].sum() and whole.neg[k] == w[y == 0, k].sum()
            both = int(whole.pos[k] * whole.neg[k])
            assert (whole.pairs[k] / (2 * both) if both else 0.5) == pytest.approx(plain_auroc(np.nan_to_num(v, nan=9.0), y, w[:, k]))


@pytest.mark.parametrize("draws", ["md5", "philox"])
def test_auroc_replicates(spark, draws):
    """Groups over many tasks, a score that a third of the rows share, null scores, labels and keys."""
    rng = np.random.default_rng(5)
    rows = [(int(g), i if i % 50 else None, int(y), 0.5 if i % 3 == 0 else float(round(x, 1))) for i, (g, y, x) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 2, 400), rng.normal(size=400), strict=True))]
    s = spark.createDataFrame([*rows, (0, 1, None, 0.5), (1, 1, 1, None)], "grp int, doc_id long, label int, value double").repartition(5)
    numbers = [0, 3, 6, 7, 301]
    got = {(r["grp"], r["b"]): r for r in B.auroc_replicates(s, ["grp"], numbers, 9, draws=draws).collect()}
    assert len(got) == 3 * len(numbers)
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        v, y = np.array([r[3] for r in own]), np.array([r[2] for r in own])
        w = B.poisson_weights([r[1] for r in own], np.array(numbers), 9, draws)
        for k, b in enumerate(numbers):
            assert got[g, b]["auroc"] == pytest.approx(plain_auroc(v, y, w[:, k])) and got[g, b]["n_pos"] == w[y == 1, k].sum()
    wide = B.poisson_weights(list(range(300)), np.arange(64), 1, draws)
    assert abs(wide.mean() - 1) < 0.03 and abs(wide.var() - 1) < 0.06
    assert B.auroc_replicates(s.limit(0), ["grp"], 3, 1).count() == 0



@pytest.mark.parametrize(
    ("margins", "excluding", "p", "decision"),
    [
        ([1.0] * 7, 7, 0.0078125, "ACCEPT"),
        ([1.0] * 5, 4, 0.03125, "ACCEPT"),
        ([1.0] * 5, 2, 0.03125, "NUANCED"),  # two intervals exclude zero
        ([1.0] * 5, 1, 0.03125, "NULL"),
        ([1.0] * 4, 4, 0.0625, "NULL"),  # p is not below .05, whatever the intervals
        ([1.0] * 6 + [-1.0], 7, 0.0625, "NULL"),
        ([1.0] * 7 + [0.0], 8, 0.03515625, "ACCEPT"),  # a zero margin is a row, not a positive one
    ],
)
def test_sign_test(spark, margins, excluding, p, decision):
    rows = spark.createDataFrame([(m, i < excluding) for i, m in enumerate(margins)], "m double, excludes_zero boolean")
    r = one(R.sign_test(rows, "m"))
    assert (r["n"], r["k"], r["p_value"], r["decision"]) == (len(margins), sum(m > 0 for m in margins), p, decision)


def test_published_rules(spark):
    """Expected values are worked out from the rules' text."""
    # sparsity is the share of active features
    parts = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 0.0], 3), ([0.0, 2.0], [0.0, 1.0], [0.0, 1.0], 1)], "h array<double>, recon array<double>, resid array<double>, l0 int")
    q = one(D.recon_quality(parts, 8))
    assert (q["sparsity"], q["l0"], q["mse"]) == (0.25, 2.0, 0.5)
    # exactly .3 of dead features is acceptable, exactly .5 no collapse
    for dead, verdict in ((3, "ACCEPTABLE"), (4, "MANY_DEAD"), (5, "MANY_DEAD"), (6, "COLLAPSED")):
        stats = spark.createDataFrame([(0.0 if i < dead else 0.2,) for i in range(10)], "freq double")
        assert one(D.health_summary(stats))["verdict"] == verdict
    # first cohort less second; one material metric makes the whole material
    five, six = (spark.createDataFrame([("m", "a", x, 0.02), ("m", "b", 0.5, 0.01)], "model string, metric string, mean double, std double") for x in (0.60, 0.61))
    delta = {r["metric"]: r for r in K.cohort_delta(five, six, ["model", "metric"]).collect()}
    assert (delta["a"]["d_mean"], delta["a"]["status"], delta["b"]["status"]) == (-0.01, "MATERIAL", "NEGLIGIBLE")
    total = one(K.materiality(K.cohort_delta(five, six, ["model", "metric"]), ["model"]))
    assert (total["verdict"], total["reason"], total["n_metrics"]) == ("MATERIAL", "a", 2)
    # grids: stable below .05, verdict by the seeds' probes, flags outside [.45, .65]
    cells = spark.createDataFrame([("c", "4", s, 0.70 + 0.01 * s) for s in range(3)], "criterion string, depth string, seed int, value double")
    for probes, verdict, flagged in (((0.45, 0.50, 0.55), "ABSENT", []), ((0.44, 0.50, 0.55), "WEAK", [0]), ((0.50, 0.56, 0.60), "WEAK", []), ((0.50, 0.50, 0.66), "MIXED", [2])):
        base = spark.createDataFrame([(s, 0.70, p, 0.8, 0.6) for s, p in enumerate(probes)], "seed int, base double, probe double, original double, recon double")
        grid = K.grid_summary(cells, base)
        assert one(grid)["stable"] and one(grid)["max_dev"] == 0.02 and one(K.grid_verdict(grid, base))["verdict"] == verdict
        assert [r["seed"] for r in K.grid_flags(base).collect()] == flagged
    above = spark.createDataFrame([(1, 0.7, 0.5, 0.60, 0.61)], "seed int, base double, probe double, original double, recon double")
    assert one(K.grid_flags(above))["flags"] == "reconstruction above original"
    # a missing metric fails its claim
    claims = spark.createDataFrame([("x", "x", 1.0, None), ("y", "y", 1.0, None), ("z", "z", 1.0, 0.1)], "path string, label string, expected double, tol double")
    held = spark.createDataFrame([("x", 1.002), ("z", 1.2)], "path string, value double")
    assert {r["label"]: r["status"] for r in K.verify_claims(claims, held).collect()} == {"x": "PASS", "y": "FAIL", "z": "FAIL"}
    # gates by name; the variance gate counts at rank 50 only
    gates = spark.createDataFrame(
        [(1, 0.85, 0.01, 100, 60, 50, 0.10), (2, 0.84, 0.31, 99, 50, 50, 0.09), (3, 0.9, 0.30, 100, 11, 10, 0.0)],
        "cell int, recon_cos double, err_ratio double, alive int, rank_eff int, k int, var_50 double",
    )
    assert {r["cell"]: (r["passed"], r["reasons"]) for r in K.ablation_gates(gates).collect()} == {1: (True, ""), 2: (False, "recon_cos; err_ratio; alive; rank; variance"), 3: (True, "")}
    rule = spark.createDataFrame([(1, 0.2, 0.73, 0.70, 0.69, 0.05, 0.04), (2, 0.2, 0.73, 0.50, 0.69, 0.05, 0.04)], "cell int, delta double, auroc_h double, random_pct05 double, noise_pct05 double, mask_mean double, mask_std double")
    got = {r["cell"]: r for r in K.decisive(rule).collect()}
    # masks: .2 must exceed .73 - .05 + 3 * .04
    assert got[1]["beats_random"] and got[1]["beats_noise"] and not got[1]["beats_mask"] and not got[1]["passes"] and not got[2]["beats_random"]


def test_heldout_decision(spark):
    splits = spark.createDataFrame([(0.8, 0.6, 0.7, 0.9, 0.15), (0.8, 0.6, 0.8, 0.9, 0.25)], "auroc_h double, auroc_recon double, auroc_resid double, recon_cos double, drop double")
    for mean, sigma, decision, passed in ((0.21, 0.02, "ACCEPT", True), (0.23, 0.02, "MARGINAL", True), (0.25, 0.02, "NULL", False)):
        r = one(R.heldout_decision(splits, spark.createDataFrame([(mean, sigma)], "mean double, std double")))
        assert (r["decision"], r["check_passed"]) == (decision, passed) and r["drop_mean"] == pytest.approx(0.2) and r["drop_std"] == pytest.approx(0.05)
    low = splits.withColumn("auroc_resid", F.lit(0.69))
    assert one(R.heldout_decision(low, spark.createDataFrame([(0.2, 0.02)], "mean double, std double")))["decision"] == "MARGINAL"


def test_poisson_bootstrap_by_brute_force(spark):
    rng = np.random.default_rng(3)
    n, b = 40, 30
    rows = [(i, int(y), float(v)) for i, (y, v) in enumerate(zip(rng.integers(0, 2, n), rng.integers(0, 6, n), strict=True))]
    s = spark.createDataFrame([(0, *r) for r in rows], "grp int, doc_id long, label int, value double")

    def u(seed, k, i):
        return int(hashlib.md5(f"{seed}|{k // 4}|{i}".encode()).hexdigest()[8 * (k % 4) :][:8], 16) / 2**32

    want = []
    for k in range(b):
        w = [sum(u(4, k, i) >= c for c in R.POISSON) for i in range(n)]
        p, q = ([v for (i, y, v), m in zip(rows, w, strict=True) if y == c for _ in range(m)] for c in (1, 0))
        want.append(np.mean([[(x > z) + 0.5 * (x == z) for z in q] for x in p]))
    got = [r["metric"] for r in R.replicates_of(s, ["grp"], [], b, 4).orderBy("b").collect()]
    assert got == pytest.approx(want)
    assert abs(np.mean([sum(u(4, k, i) >= c for c in R.POISSON) for k in range(b) for i in range(n)]) - 1) < 0.1
    # conventions for replicates of one class: left out, kept, or drawn again
    few = spark.createDataFrame([(0, 0, 1, 0.5), (0, 1, 0, 0.25)], "grp int, doc_id long, label int, value double")
    skip, keep, redraw = (R.replicates_of(few, ["grp"], [], 60, 4, single_class=c).collect() for c in R.SINGLE_CLASS)
    assert len(skip) < len(keep) == len(redraw) <= 60 and {r["metric"] for r in skip} == {1.0} and {r["metric"] for r in keep} == {0.5, 1.0}
    assert sum(r["metric"] == 0.5 for r in redraw) < sum(r["metric"] == 0.5 for r in keep)
    rate = R.replicates_of(s, ["grp"], [], 5, 4, "tpr_at_5%").collect()
    assert len(rate) == 5 and all(0 <= r["metric"] <= 1 for r in rate)
    with pytest.raises(ValueError):
        R.replicates_of(s, ["grp"], [], 5, 4, single_class="other")


def test_permuted_directions_by_numpy(spark):
    x, labels, acts, *_ = _small_model(spark)
    d_r = np.arange(6) - 2.0
    got = {r["m"]: r["c"] for r in R.permuted_directions(acts.repartition(3), d_r, 4, 11).collect()}
    marks = {(r["m"], r["doc_id"]) for r in R.permuted_labels(acts.select("doc_id", "label"), 4, 11).filter("permuted = 1").collect()}
    for m in range(4):
        y = np.array([(m, i) in marks for i in range(len(x))])
        assert y.sum() == labels.sum()
        values, vectors = np.linalg.eigh(np.cov(x[y].T) - np.cov(x[~y].T))
        v = vectors[:, np.argmax(np.abs(values))]
        assert abs(got[m]) == pytest.approx(abs(v @ d_r) / np.linalg.norm(d_r))


def test_permutation_probe_by_numpy(spark):
    x, labels, acts, *_ = _small_model(spark)
    got = {r["m"]: r["auroc"] for r in P.permutation_probe(acts.repartition(3), 2, 3, 13).collect()}
    marks = {(r["m"], r["doc_id"]) for r in R.permuted_labels(acts.select("doc_id", "label"), 2, 13).filter("permuted = 1").collect()}
    for m in range(2):
        y = np.array([(m, i) in marks for i in range(len(x))])
        fold = np.array([int(3 * (int(hashlib.md5(f"14|{m}|{i}".encode()).hexdigest()[:8], 16) / 2**32)) for i in range(len(x))])
        score = np.zeros(len(x))
        for f in range(3):
            own = fold != f
            mean, std = x[own].mean(0), x[own].std(0)
            z, t = (x[own] - mean) / std, 2.0 * y[own] - 1
            w = np.linalg.solve(z.T @ z + np.eye(6), z.T @ t)
            score[~own] = (x[~own] - mean) / std @ w + t.sum() / (own.sum() + 1)
        p, q = score[y], score[~y]
        assert got[m] == pytest.approx(np.mean((p[:, None] > q) + 0.5 * (p[:, None] == q)), abs=1e-6)


def test_repeated_rows_change_the_digest(spark):
    rows = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.25, 2.0])], "doc_id long, h array<double>").withColumn("g", F.lit(0))
    of = lambda df: one(vector_manifest(df, ["g"]))["digest"]
    doubled = rows.unionByName(rows)
    other = doubled.withColumn("doc_id", F.col("doc_id") + 5)
    assert len({of(rows), of(doubled), of(other)}) == 3 and of(doubled) == of(doubled.repartition(3))


def test_short_partition_is_an_error(spark):
    texts = spark.createDataFrame([(i, f"{i} " + "x" * 700) for i in range(4)], "doc_id long, text string")
    with pytest.raises(ValueError):
        C.disjoint_partition(texts, texts.filter("doc_id = 0"), 4, strict=True)
    assert C.disjoint_partition(texts, texts.filter("doc_id = 0"), 3, strict=True).count() == 3
    proof = one(C.disjointness_proof(texts.filter("doc_id < 2").select(C.sha().alias("sha256")), texts.filter("doc_id = 0"), texts))
    assert proof["n_intersection"] == 1 and len(proof["examples"]) == 64


def test_holm(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(p)], "g int, k int, p double")
    got = [r["p_adjusted"] for r in R.holm(df, "p", ["g"], "k").orderBy("k").collect()]
    assert got == pytest.approx([0.04, 0.09, 0.09, 0.025, 0.5])


def test_seed_gap(spark):
    rec = spark.createDataFrame([("m", s, "x", v) for s, v in ((1, 0.5), (2, None), (3, 0.7))], "model string, seed int, metric string, value double")
    roster = spark.createDataFrame([("m", s) for s in range(1, 6)], "model string, seed int")
    r = one(K.seed_summary(rec, roster))
    assert (r["n"], r["mean"], r["missing_seeds"]) == (2, 0.6, "2,4,5")


def test_harmonised_means(spark):
    rec = spark.createDataFrame([("m", 1, "x", 0.25)], "model string, seed int, metric string, value double")
    assert one(K.seed_summary(rec, spark.createDataFrame([("m", 1)], "model string, seed int")))["std"] == 0.0


def test_correlation_p_value():
    assert beta_p(0.0, 20) == pytest.approx(1.0)
    assert beta_p(0.5, 20) == pytest.approx(0.024770, abs=1e-5)


def test_top_contexts_ties(spark):
    rows = [(1, d, p, 1.0) for d in range(5) for p in range(2)] + [(1, 9, 0, 2.0)]
    codes = spark.createDataFrame(rows, "feature_id int, doc_id long, pos int, z double")
    got = [(r["doc_id"], r["pos"]) for r in D.top_contexts(codes, 3).orderBy("rank").collect()]
    assert got == [(9, 0), (0, 0), (1, 0)]


def _small_model(spark):
    g = np.random.Generator(np.random.Philox(5))
    x = g.standard_normal((60, 6)) * [3, 2, 1, 1, 1, 1]
    labels = (x[:, 0] + g.standard_normal(60) > 0).astype(int)
    w = g.standard_normal((10, 6))
    acts = spark.createDataFrame([(i, int(y), v.tolist()) for i, (y, v) in enumerate(zip(labels, x, strict=True))], "doc_id long, label int, h array<double>")
    table = spark.createDataFrame([(i, v.tolist(), -0.5) for i, v in enumerate(w)], "feature_id int, w array<double>, b_enc double")
    bank = [(0, g.standard_normal(6), 0.25), (7, g.standard_normal(6), -1.0)]
    return x, labels, acts, D.Dictionary(table, np.full(6, 0.1)), bank


def test_residual_controls_by_brute_force(spark):
    x, labels, acts, own, bank = _small_model(spark)
    rank = 2
    rows = controls.control_scores(acts.repartition(5), own, bank, rank, n_random=3, n_noise=2, n_mask=2, seed=9)
    got = {}
    for r in rows.collect():
        got.setdefault((r["control"], r["seed"], r["probe"]), []).append((r["label"], r["value"]))
    z = own.encode(x)

    def erased(decoded, u=None):
        e = x - decoded
        if u is None:
            u = np.linalg.svd(e - e.mean(0))[2][:rank].T
        return x - e @ u @ u.T

    full = own.decode(z)
    expected = {("primary", 0): erased(full), ("identity", 0): x}
    for s, q in enumerate(controls.random_bases(6, rank, 3, 9)):
        assert np.allclose(q.T @ q, np.eye(rank))
        expected["random", s] = erased(full, q)
    for s, pick in enumerate(controls.masks(10, 2, seed=9)):
        cut = z.copy()
        cut[:, pick] = 0
        expected["mask", s] = erased(own.decode(cut))
    for (control, s), h in expected.items():
        for p, w, b in bank:
            want = sorted(zip(labels.tolist(), (h @ w + b).tolist(), strict=True))
            assert np.allclose(sorted(got[control, s, p]), want, atol=1e-6), control
    assert len(got) == 2 * (1 + 1 + 3 + 2 + 2)
    card = {r["control"]: r for r in controls.ablation_controls(rows).collect()}
    assert card["noise"]["n_seeds"] == 2 and card["identity"]["std"] == 0
    assert card["random"]["pct05"] <= card["random"]["pct50"] <= card["random"]["pct95"]


def test_noise_has_unit_length_and_its_own_seed():
    along = controls.noise_along([3, 4], np.eye(6), 5, 1)
    assert np.allclose(np.linalg.norm(along, axis=2), 1)
    assert np.allclose(along[1], controls.noise_along([4], np.eye(6), 5, 1)[0])
    assert not np.allclose(along[0], along[1])


def test_controls_of_no_vectors(spark):
    _, _, acts, own, bank = _small_model(spark)
    assert controls.control_scores(acts.limit(0), own, bank, 2, 1, 1, 1).count() == 0


def test_rank_by_probe_finds_the_label(spark):
    rows = [(i, i % 2, f, z) for i in range(40) for f, z in ((0, 1.0 + i % 7), (3, 2.0)) if f == 0 or i % 2]
    codes = spark.createDataFrame(rows, "doc_id long, label int, feature_id int, z double")
    docs = spark.range(41).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS label")
    score = {r["feature_id"]: r["score"] for r in P.rank_by_probe(codes, docs, 4).collect()}
    assert max(score, key=score.get) == 3 and score[1] == score[2] == 0
    dense = {r["doc_id"]: r["h"] for r in P.code_arrays(codes, 4, docs).collect()}
    assert len(dense) == 41 and dense[40] == [0.0] * 4 and dense[3] == [4.0, 0.0, 0.0, 2.0]
