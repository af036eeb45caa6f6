"""Queries of metrics, resampling and cohort aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.draws import r6, u01
from corpuslens.operators import cohort as K
from corpuslens.operators import metrics as M
from corpuslens.operators import resample as R
from corpuslens.operators import vectors as V
from corpuslens.operators.replicates import POISSON, SHARED
from corpuslens.plans.base import CTE, acts, query, scratch, settled, table, u
from corpuslens.plans.vector_queries import DOT, area_sql, warea_sql
from corpuslens.sources.texts import read_records

CTE["ev_t"] = "SELECT user_id % 7 AS grp, event_id, CAST(event_type = (SELECT min(event_type) FROM events) AS INTEGER) AS label, round(value, 1) AS value FROM events"
CTE["li_t"] = "SELECT l_linestatus AS grp, CAST(l_returnflag = 'R' AS INTEGER) AS label, CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem"


def events(spark, d):
    """Scores by group: grp, event_id, label, value with many ties."""
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("t"))
    return e.crossJoin(F.broadcast(first)).select((F.col("user_id") % 7).alias("grp"), "event_id", (F.col("event_type") == F.col("t")).cast("int").alias("label"), F.round("value", 1).alias("value"))


def lines(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("grp"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_extendedprice").cast("double").alias("value")
    )


AREA = "SELECT grp, n_pos, n_neg, round(auroc, 6) AS auroc FROM ({})"


@query("f1_auroc", AREA.format(area_sql("SELECT grp, label, value FROM ev_t", "grp")))
def f1(spark, d):
    return M.auroc(events(spark, d), ["grp"]).select("grp", "n_pos", "n_neg", r6("auroc").alias("auroc"))


@query("f1_auroc_volume", AREA.format(area_sql("SELECT grp, label, value FROM li_t", "grp")))
def f1v(spark, d):
    return M.auroc(lines(spark, d), ["grp"]).select("grp", "n_pos", "n_neg", r6("auroc").alias("auroc"))


@query(
    "f2_auroc_oriented",
    f"SELECT grp, round(greatest(auroc, 1 - auroc), 6) AS auroc_bi, CASE WHEN 1 - auroc > auroc THEN -1 ELSE 1 END AS sign FROM ({area_sql('SELECT grp, label, value FROM ev_t', 'grp')})",
)
def f2(spark, d):
    return M.oriented(M.auroc(events(spark, d), ["grp"])).select("grp", r6("auroc_bi").alias("auroc_bi"), "sign")


CTE["roc_t"] = """SELECT grp, value AS threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY grp) AS tp_all, sum(n) OVER (PARTITION BY grp) AS fp_all FROM (
    SELECT grp, value, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM ev_t GROUP BY ALL) WINDOW w AS (PARTITION BY grp ORDER BY value DESC ROWS UNBOUNDED PRECEDING)"""


@query(
    "f3_tpr_at_fpr",
    "SELECT grp, " + ", ".join(f"round(coalesce(max(tp / tp_all) FILTER (fp / fp_all <= {f}), 0), 6) AS tpr_{str(f).replace('.', '_')}" for f in (0.001, 0.01, 0.05)) + " FROM roc_t GROUP BY grp",
)
def f3(spark, d):
    out = M.tpr_at_fpr(events(spark, d), ["grp"])
    return out.select("grp", *[r6(c).alias(c) for c in out.columns if c != "grp"])


@query("f4_roc_curve", "SELECT grp, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / tp_all, 6) AS tpr, round(fp / fp_all, 6) AS fpr FROM roc_t")
def f4(spark, d):
    return M.roc_points(events(spark, d), ["grp"]).select("grp", "threshold", "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query("f4_youden", "SELECT grp, threshold, round(j, 6) AS youden_j FROM (SELECT grp, threshold, tp / tp_all - fp / fp_all AS j, row_number() OVER (PARTITION BY grp ORDER BY round(tp / tp_all - fp / fp_all, 12) DESC, threshold DESC) AS r FROM roc_t) WHERE r = 1")
def f4y(spark, d):
    return M.youden(events(spark, d), ["grp"]).select("grp", "threshold", r6("youden_j").alias("youden_j"))


@query("f5_impute", "WITH x AS (SELECT grp, event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS v FROM ev_t), m AS (SELECT grp, median(v) AS m FROM x GROUP BY grp) SELECT event_id, round(coalesce(v, m, 0), 6) AS value FROM x JOIN m USING (grp)")
def f5(spark, d):
    odd = F.when(F.col("event_id") % 39 == 0, float("nan")).when(F.col("event_id") % 26 == 0, float("inf")).when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("value"))
    return M.impute(events(spark, d).withColumn("value", odd), ["grp"]).select("event_id", r6("value").alias("value"))


@query(
    "f6_metric_card",
    f"""SELECT grp, round(auroc, 6) AS auroc, sign, round(t1, 6) AS tpr_0_01, round(t5, 6) AS tpr_0_05 FROM (SELECT *, CASE WHEN 1 - auroc > auroc THEN -1 ELSE 1 END AS sign FROM ({area_sql('SELECT grp, label, value FROM ev_t', 'grp')}))
    JOIN (SELECT grp, coalesce(max(tp / tp_all) FILTER (fp / fp_all <= 0.01), 0) AS t1, coalesce(max(tp / tp_all) FILTER (fp / fp_all <= 0.05), 0) AS t5 FROM roc_t GROUP BY grp) USING (grp)""",
)
def f6(spark, d):
    return M.metric_card(events(spark, d), ["grp"]).select("grp", r6("auroc").alias("auroc"), "sign", r6("tpr_0_01").alias("tpr_0_01"), r6("tpr_0_05").alias("tpr_0_05"))


@query(
    "f7_split_agreement",
    """WITH m AS (SELECT doc_id, CAST(-h[1] < (SELECT median(-h[1]) FROM acts_t) AS INTEGER) AS a, CAST(h[2] > (SELECT median(h[2]) FROM acts_t) AS INTEGER) AS b FROM acts_t),
    c AS (SELECT count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a = 1 AND b = 0) AS fp, count(*) FILTER (a = 0 AND b = 1) AS fn, count(*) FILTER (a = 0 AND b = 0) AS tn FROM m),
    r AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM c)
    SELECT tp, fp, fn, tn, round((tp + tn) / greatest(tp + fp + fn + tn, 1), 6) AS agreement, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-9), 6) AS f1 FROM r""",
)
def f7(spark, d):
    a = acts(spark, d).select("doc_id", (-F.col("h")[0]).alias("loss"), F.col("h")[1].alias("score"))
    both = V.recall_label(V.recall_label(a, "loss", "loss").withColumnRenamed("recall", "a"), "score", "score").withColumnRenamed("recall", "b")
    return M.split_agreement(both, "a", "b")


@query(
    "f8_quartile_table",
    """WITH q AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS q FROM documents) SELECT CAST(n_chars >= q[1] AS INTEGER) + CAST(n_chars >= q[2] AS INTEGER) + CAST(n_chars >= q[3] AS INTEGER) AS quartile, count(*) AS n,
    round(avg(n_chars), 6) AS mean_x, round(stddev_pop(n_chars), 6) AS std_x, round(avg(doc_id), 6) AS mean_y, round(stddev_pop(doc_id), 6) AS std_y FROM documents, q GROUP BY 1""",
)
def f8(spark, d):
    return M.quartile_table(table(spark, d, "documents").select("n_chars", "doc_id"), "n_chars", "doc_id")


CTE["sp_t"] = "SELECT lang, CAST(n_chars AS DOUBLE) AS x, CAST(doc_id % 97 AS DOUBLE) AS y, CAST(doc_id % 31 AS DOUBLE) AS z FROM documents"
RANK = "rank() OVER (PARTITION BY lang ORDER BY {0}) + (count(*) OVER (PARTITION BY lang, {0}) - 1) / 2.0"
CTE["rk_t"] = f"SELECT lang, x, y, {RANK.format('x')} AS rx, {RANK.format('y')} AS ry, {RANK.format('z')} AS rz FROM sp_t"


def _pairs(spark, d):
    return table(spark, d, "documents").select("lang", F.col("n_chars").cast("double").alias("x"), (F.col("doc_id") % 97).cast("double").alias("y"), (F.col("doc_id") % 31).cast("double").alias("z"))


@query("f9_spearman", "SELECT lang, count(*) AS n, round(corr(rx, ry), 6) AS rho, round(corr(x, y), 6) AS pearson FROM rk_t GROUP BY lang")
def f9(spark, d):
    return M.spearman(_pairs(spark, d), "x", "y", ["lang"]).select("lang", "n", r6("rho").alias("rho"), r6("pearson").alias("pearson"))


@query(
    "f10_partial_spearman",
    f"""WITH f AS (SELECT lang, regr_slope(rx, rz) AS bx, regr_intercept(rx, rz) AS ax, regr_slope(ry, rz) AS b_y, regr_intercept(ry, rz) AS ay FROM rk_t GROUP BY lang),
    e AS (SELECT lang, round(rx - ax - bx * rz, 9) AS ex, round(ry - ay - b_y * rz, 9) AS ey FROM rk_t JOIN f USING (lang)), k AS (SELECT lang, {RANK.format('ex')} AS a, {RANK.format('ey')} AS b FROM e)
    SELECT lang, count(*) AS n, round(corr(a, b), 4) AS partial_rho FROM k GROUP BY lang""",
)
def f10(spark, d):
    return M.partial_spearman(_pairs(spark, d), "x", "y", "z", ["lang"]).select("lang", "n", F.round("partial_rho", 4).alias("partial_rho"))


@query("f12_score_histogram", "SELECT label, CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 21 ELSE floor(value / 10.0) + 1 END AS INTEGER) AS bin, count(*) AS n FROM ev_t GROUP BY ALL")
def f12(spark, d):
    return M.score_histogram(events(spark, d), ["label"], 0.0, 200.0, 20)


@query("f12_pooled_auroc", f"SELECT round(avg(auroc), 6) AS mean_auroc, round(stddev_samp(auroc), 6) AS std_auroc, count(*) AS n_groups FROM ({area_sql('SELECT grp, label, value FROM ev_t', 'grp')})")
def f12p(spark, d):
    return M.auroc(events(spark, d), ["grp"]).agg(r6(F.avg("auroc")).alias("mean_auroc"), r6(F.stddev_samp("auroc")).alias("std_auroc"), F.count(F.lit(1)).alias("n_groups"))


# -- resampling -------------------------------------------------------------------------
def scores(spark, d):
    """Two scores of vectors: doc_id, label, a, b."""
    return acts(spark, d).select("doc_id", "label", F.round(F.col("h")[0], 3).alias("a"), F.round(F.col("h")[1] - F.col("h")[2], 3).alias("b"))


def named(s):
    """The scores as first and second, as b is the replicate's number in draws; grp: seven groups."""
    return s.withColumnsRenamed({"a": "first", "b": "second"}).withColumn("grp", (F.col("doc_id") % 7).cast("int"))


CTE["two_t"] = "SELECT doc_id, label, CAST(doc_id % 7 AS INTEGER) AS grp, round(h[1], 3) AS a, round(h[2] - h[3], 3) AS b FROM acts_t"
CTE["lng_t"] = "SELECT doc_id, label, grp, unnest(['a', 'b']) AS s, unnest([a, b]) AS value FROM two_t"
REPLICATES = 10_000
Q = "round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.025), 6) AS low, round(quantile_cont({c}, 0.975), 6) AS high, round(stddev_samp({c}), 6) AS std, count(*) AS n_valid"


def weights_sql(rows: str, replicates: int, seed: int, key: str = "doc_id") -> str:
    """The SQL form of resample.weighted; the replicate is r.  Weights are drawn once a key."""
    x = f"(CAST(('0x' || substr(md5(concat_ws('|', {seed}, r // {SHARED}, {key})), 8 * (r % {SHARED}) + 1, 8)) AS UBIGINT) / 4294967296.0)"
    drawn = f"SELECT {key}, r, len(list_filter({POISSON}, lambda c: x >= c)) AS w FROM (SELECT *, {x} AS x FROM (SELECT {key}, unnest(range({replicates})) AS r FROM (SELECT DISTINCT {key} FROM ({rows}))))"
    return f"SELECT * FROM ({rows}) JOIN (SELECT * FROM ({drawn}) WHERE w > 0) USING ({key})"


def _ci(out):
    return [r6(c).alias(c) for c in ("mean", "low", "high", "std")] + [out["n_valid"]]


G1 = f"SELECT grp, r, n_pos, n_neg, auroc FROM ({warea_sql(weights_sql('SELECT doc_id, grp, label, a AS value FROM two_t', REPLICATES, 1), 'grp, r')})"


@query("g1_bootstrap_ci", f"SELECT grp, {Q.format(c='auroc')} FROM ({G1}) WHERE n_pos > 0 AND n_neg > 0 GROUP BY grp")
def g1(spark, d):
    out = R.bootstrap_ci(named(scores(spark, d)).select("grp", "doc_id", "label", F.col("first").alias("value")), ["grp"], REPLICATES, 1)
    return out.select("grp", *_ci(out))


RATE_SQL = """SELECT r, max(tp) AS n_pos, max(fp) AS n_neg, coalesce(max(CASE WHEN fp <= {t} * nf AND tpr IS NOT NULL AND fp / nullif(nf, 0) <= {t} THEN tpr END), 0) AS rate FROM (
    SELECT *, tp / nullif(max(tp) OVER (PARTITION BY r), 0) AS tpr, max(fp) OVER (PARTITION BY r) AS nf FROM (
    SELECT r, value, sum(p) OVER o AS tp, sum(n) OVER o AS fp FROM (
    SELECT r, value, CAST(coalesce(sum(w) FILTER (label = 1), 0) AS DOUBLE) AS p, CAST(coalesce(sum(w) FILTER (label = 0), 0) AS DOUBLE) AS n FROM ({rows}) GROUP BY ALL)
    WINDOW o AS (PARTITION BY r ORDER BY value DESC ROWS UNBOUNDED PRECEDING))) GROUP BY r"""


@query("g1_bootstrap_tpr", f"SELECT {Q.format(c='rate')} FROM ({RATE_SQL.format(t=0.05, rows=weights_sql('SELECT doc_id, label, a AS value FROM two_t', 200, 9))})")
def g1t(spark, d):
    """True-positive rate at 5 % false positives; replicates of one class keep the metric's value for it."""
    s = named(scores(spark, d)).select(F.lit(0).alias("all"), "doc_id", "label", F.col("first").alias("value"))
    out = R.bootstrap_ci(s, ["all"], 200, 9, "tpr_at_5%", "keep")
    return out.select(*_ci(out))


@query("g1_bootstrap_kernel")
def g1k(spark, d):
    """10,000 replicates of two scores by group, from the kernel."""
    out = R.bootstrap_kernel(named(scores(spark, d)), ["first", "second"], "grp", 10_000, 7)
    out = R.interval(out.select("grp", (F.col("first") - F.col("second")).alias("delta")), ["grp"], "delta")
    return out.select("grp", *_ci(out))


SIGN = f"SELECT grp, s, CASE WHEN 1 - auroc > auroc THEN -1 ELSE 1 END AS sign, greatest(auroc, 1 - auroc) AS bi FROM ({area_sql('SELECT grp, s, label, value FROM lng_t', 'grp, s')})"


def _delta_sql(replicates: int, seed: int, sign: bool) -> str:
    """grp, r, delta."""
    value = f"SELECT doc_id, grp, s, label, value * sign AS value FROM lng_t JOIN ({SIGN}) USING (grp, s)" if sign else "SELECT doc_id, grp, s, label, value FROM lng_t"
    area = warea_sql(weights_sql(value, replicates, seed), "grp, s, r")
    return f"SELECT grp, r, max(auroc) FILTER (s = 'a') - max(auroc) FILTER (s = 'b') AS delta FROM ({area}) WHERE n_pos > 0 AND n_neg > 0 GROUP BY grp, r"


@query("g2_paired_bootstrap", f"SELECT grp, {Q.format(c='delta')} FROM ({_delta_sql(REPLICATES, 2, False)}) GROUP BY grp")
def g2(spark, d):
    out = R.interval(R.paired_difference(named(scores(spark, d)), "first", "second", REPLICATES, 2, ["grp"]), ["grp"], "delta")
    return out.select("grp", *_ci(out))


CTE["margin_t"] = f"""SELECT grp, margin, low, high, (low > 0 OR high < 0) AS excludes_zero, mean, std, n_valid FROM (SELECT grp, max(bi) FILTER (s = 'a') - max(bi) FILTER (s = 'b') AS margin FROM ({SIGN}) GROUP BY grp)
    JOIN (SELECT grp, avg(delta) AS mean, quantile_cont(delta, 0.025) AS low, quantile_cont(delta, 0.975) AS high, stddev_samp(delta) AS std, count(*) AS n_valid FROM ({_delta_sql(REPLICATES, 3, True)}) GROUP BY grp) USING (grp)"""


def _margins(spark, d):
    return R.margin_table(named(scores(spark, d)), "first", "second", REPLICATES, 3, ["grp"])


@query("g3_margin_bootstrap", "SELECT grp, round(margin, 6) AS margin, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(std, 6) AS std, n_valid, excludes_zero FROM margin_t")
def g3(spark, d):
    out = _margins(spark, d)
    return out.select("grp", r6("margin").alias("margin"), *_ci(out), "excludes_zero")


@query(
    "g4_stratified_bootstrap",
    f"""WITH own AS (SELECT doc_id % 3 AS fold, label, a, b, row_number() OVER (PARTITION BY doc_id % 3, label ORDER BY {u('4', 'doc_id')}, doc_id) - 1 AS idx, count(*) OVER (PARTITION BY doc_id % 3, label) AS n FROM two_t),
    dr AS (SELECT fold, label, r, CAST(floor({u('4', 'r', 'j')} * n) AS BIGINT) AS idx FROM (SELECT fold, label, n, r, unnest(range(n)) AS j FROM (SELECT DISTINCT fold, label, n FROM own), (SELECT unnest(range(500)) AS r))),
    lng AS (SELECT fold, r, label, unnest(['a', 'b']) AS s, unnest([a, b]) AS value FROM dr JOIN own USING (fold, label, idx)),
    dl AS (SELECT r, avg(auroc) FILTER (s = 'a') - avg(auroc) FILTER (s = 'b') AS delta FROM ({area_sql("SELECT fold, r, s, label, value FROM lng", 'fold, r, s')}) GROUP BY r)
    SELECT round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high, round(avg(CAST(delta <= 0 AS INTEGER)), 6) AS p_value, count(*) AS n_valid FROM dl""",
)
def g4(spark, d):
    s = scores(spark, d).withColumnsRenamed({"a": "first", "b": "second"}).withColumn("fold", F.col("doc_id") % 3)
    drawn = R.stratified_weights(s, 500, 4, ["fold", "label"])
    area = R.auroc_replicates(R.long_scores(drawn, ["first", "second"], ["fold", "doc_id", "label", "weights"]), ["fold", "score"], 500, 4, weights="weights")
    w = area.groupBy("b").pivot("score", ["first", "second"]).agg(F.avg("auroc"))
    delta = w.withColumn("delta", F.col("first") - F.col("second"))
    q = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    out = delta.agg(r6(F.avg("delta")).alias("mean"), q.alias("q"), r6(F.avg((F.col("delta") <= 0).cast("int"))).alias("p_value"), F.count(F.lit(1)).alias("n_valid"))
    return out.select("mean", r6(F.col("q")[0]).alias("low"), r6(F.col("q")[1]).alias("high"), "p_value", "n_valid")


def _recall_direction(a):
    from corpuslens.plans.vector_queries import _recall

    return V.mean_diff(_recall(a), label="recall").select(F.col("d").alias("dr"))


@query("g5_permutation_null")
def g5(spark, d):
    """Cosine of the first contrastive direction with d_R, refitted for 1,000 permutations of the labels."""
    import numpy as np

    a = acts(spark, d)
    dr = np.array(_recall_direction(a).first()["dr"])
    own = np.array(V.contrastive_pca(a, 1)[0][2])
    seen = float(own @ dr / (np.linalg.norm(own) * np.linalg.norm(dr) + 1e-12))
    null = settled(R.permuted_directions(a, dr, 1000, 5).withColumn("c", F.abs("c")), "null")  # an eigenvector has no sign
    out = R.null_summary(null, abs(seen))
    return out.select(*[r6(c).alias(c) for c in out.columns if c != "n"], "n")


@query(
    "g5_mean_diff_null",
    f"""WITH pm AS (SELECT m, h, row_number() OVER (PARTITION BY m ORDER BY {u('5', 'm', 'doc_id')}, doc_id) <= (SELECT sum(label) FROM acts_t) AS y FROM acts_t, (SELECT unnest(range(100)) AS m)),
    dd AS (SELECT m, list(x ORDER BY i) AS v FROM (SELECT m, i, avg(x) FILTER (y) - avg(x) FILTER (NOT y) AS x FROM (SELECT m, y, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM pm) GROUP BY ALL) GROUP BY m),
    c AS (SELECT {DOT}(d.v, r.v) / (sqrt({DOT}(d.v, d.v)) * sqrt({DOT}(r.v, r.v)) + 1e-12) AS c FROM dd d, dr_t r), o AS (SELECT {DOT}(d.v, r.v) / (sqrt({DOT}(d.v, d.v)) * sqrt({DOT}(r.v, r.v)) + 1e-12) AS o FROM dk_t d, dr_t r)
    SELECT round(max(o), 6) AS observed, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS std, round(quantile_cont(c, 0.025), 6) AS low, round(quantile_cont(c, 0.975), 6) AS high, round((count(*) FILTER (abs(c) >= abs(o)) + 1) / (count(*) + 1.0), 6) AS p_value FROM c, o""",
)
def g5m(spark, d):
    """The same for the mean difference, 100 permutations."""
    from corpuslens.functions.vectors import cosine

    a = acts(spark, d)
    dr = _recall_direction(a)
    null = V.mean_diff(R.permuted_labels(a, 100, 5), ["m"], "permuted").crossJoin(F.broadcast(dr)).select(cosine(F.col("d"), F.col("dr")).alias("c"))
    seen = V.mean_diff(a).crossJoin(F.broadcast(dr)).select(cosine(F.col("d"), F.col("dr")).alias("o")).first()["o"]
    out = R.null_summary(null, seen)
    return out.select(*[r6(c).alias(c) for c in ("observed", "mean", "std", "low", "high", "p_value")])


@query(
    "g7_random_directions",
    f"""WITH g AS (SELECT k, list(x ORDER BY i) AS v FROM (SELECT k, i, sqrt(-2 * ln(1 - {u('7', 'k', 'i', '0')})) * cos(2 * pi() * {u('7', 'k', 'i', '1')}) AS x FROM (SELECT unnest(range(100)) AS k), (SELECT unnest(range(64)) AS i)) GROUP BY k),
    a AS ({area_sql(f"SELECT k, label, round({DOT}(h, v) / sqrt({DOT}(v, v)), 9) AS value FROM acts_t, g", 'k')})
    SELECT round(avg(auroc), 6) AS mean, round(stddev_pop(auroc), 6) AS std, round(min(auroc), 6) AS lowest, round(max(auroc), 6) AS highest, round(quantile_cont(auroc, 0.025), 6) AS low, round(quantile_cont(auroc, 0.975), 6) AS high,
    round(avg(greatest(auroc, 1 - auroc)), 6) AS mean_bi, count(*) AS n FROM a""",
)
def g7(spark, d):
    s = V.direction_scores(acts(spark, d), V.random_directions(100, 64, 7)).withColumn("value", F.round("value", 9))
    a = M.oriented(M.auroc(s, ["direction"]))
    q = F.percentile("auroc", F.array(F.lit(0.025), F.lit(0.975)))
    out = a.agg(
        r6(F.avg("auroc")).alias("mean"), r6(F.stddev_pop("auroc")).alias("std"), r6(F.min("auroc")).alias("lowest"), r6(F.max("auroc")).alias("highest"), q.alias("q"),
        r6(F.avg("auroc_bi")).alias("mean_bi"), F.count(F.lit(1)).alias("n"),
    )
    return out.withColumn("low", r6(F.col("q")[0])).withColumn("high", r6(F.col("q")[1])).drop("q")


@query(
    "g9_sign_test",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (margin > 0) AS k, count(*) FILTER (excludes_zero) AS n_excluding FROM margin_t), p AS (SELECT n, k, n_excluding, round((SELECT sum(gamma(n + 1) / (gamma(i + 1) * gamma(n - i + 1))) FROM (SELECT unnest(range(k, n + 1)) AS i)) / pow(2, n), 9) AS p_value FROM c)
    SELECT *, CASE WHEN p_value < 0.05 AND n_excluding >= 3 THEN 'ACCEPT' WHEN p_value < 0.05 AND n_excluding >= 2 THEN 'NUANCED' ELSE 'NULL' END AS decision FROM p""",
)
def g9(spark, d):
    """Over the margins of seven groups, with their intervals."""
    return R.sign_test(_margins(spark, d), "margin")


@query(
    "g10_holm",
    f"""WITH p AS (SELECT lang, doc_id, {u('10', 'doc_id')} / 50 AS p FROM documents), s AS (SELECT *, (count(*) OVER (PARTITION BY lang) - row_number() OVER (PARTITION BY lang ORDER BY p, doc_id) + 1) * p AS s FROM p)
    SELECT lang, doc_id, round(least(max(s) OVER (PARTITION BY lang ORDER BY p, doc_id ROWS UNBOUNDED PRECEDING), 1), 6) AS p_adjusted FROM s""",
)
def g10(spark, d):
    p = table(spark, d, "documents").select("lang", "doc_id", (u01(F.lit(10), F.col("doc_id")) / 50).alias("p"))
    return R.holm(p, "p", ["lang"], "doc_id").select("lang", "doc_id", r6("p_adjusted").alias("p_adjusted"))


SPLITS, HELD_REPLICATES = 10, 10_000
CTE["held_t"] = f"""SELECT s AS split, doc_id, label, {DOT}(h, r) / (sqrt({DOT}(h, h)) * sqrt({DOT}(r, r)) + 1e-12) AS c, round({DOT}(h, v) / sqrt({DOT}(v, v)), 9) AS h, round({DOT}(r, v) / sqrt({DOT}(v, v)), 9) AS recon, round({DOT}(e, v) / sqrt({DOT}(v, v)), 9) AS resid
    FROM cut_t JOIN res_t USING (doc_id, label) JOIN (SELECT s, list(x ORDER BY i) AS v FROM (SELECT s, i, avg(x) FILTER (label = 1) - avg(x) FILTER (label = 0) AS x FROM (SELECT s, label, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM cut_t JOIN acts_t USING (doc_id, label) WHERE a) GROUP BY ALL) GROUP BY s) USING (s) WHERE NOT a"""
CTE["cut_t"] = f"SELECT s, doc_id, label, row_number() OVER (PARTITION BY s, label ORDER BY {u('100', 's', 'doc_id')}, doc_id) <= round_even(0.7 * count(*) OVER (PARTITION BY s, label), 0) AS a FROM acts_t, (SELECT CAST(unnest(range({SPLITS})) AS INTEGER) AS s)"
_HELD_TWO = "SELECT split, doc_id, label, unnest(['h', 'recon']) AS stream, unnest([h, recon]) AS value FROM held_t"
_HELD = "SELECT split, doc_id, label, unnest(['h', 'recon', 'resid']) AS stream, unnest([h, recon, resid]) AS value FROM held_t"
CTE["splits_t"] = f"""SELECT split, n_pos, n_neg, auroc_h, auroc_recon, auroc_resid, recon_cos, drop, drop_low, drop_high, drop_std FROM
    (SELECT split, max(n_pos) AS n_pos, max(n_neg) AS n_neg, max(auroc) FILTER (stream = 'h') AS auroc_h, max(auroc) FILTER (stream = 'recon') AS auroc_recon, max(auroc) FILTER (stream = 'resid') AS auroc_resid FROM ({area_sql(_HELD, 'split, stream')}) GROUP BY split)
    JOIN (SELECT split, avg(c) AS recon_cos FROM held_t GROUP BY split) USING (split)
    JOIN (SELECT split, avg(d) AS drop, quantile_cont(d, 0.025) AS drop_low, quantile_cont(d, 0.975) AS drop_high, stddev_samp(d) AS drop_std FROM (SELECT split, r, max(auroc) FILTER (stream = 'h') - max(auroc) FILTER (stream = 'recon') AS d
    FROM ({warea_sql(weights_sql(_HELD_TWO, HELD_REPLICATES, 6), 'split, stream, r')}) WHERE n_pos > 0 AND n_neg > 0 GROUP BY split, r) GROUP BY split) USING (split)"""
HELD = ("auroc_h", "auroc_recon", "auroc_resid", "recon_cos", "drop")


def _heldout(spark, d):
    """Settled splits of the held-out audit, and the decomposed vectors."""
    from corpuslens.operators import dictionary as D
    from corpuslens.plans.vector_queries import _dict

    a, w = _dict(spark, d)
    parts = settled(D.decompose(a, w), "decomposed")
    return settled(R.heldout_splits(settled(R.heldout_streams(parts, SPLITS, 0.7, 100), "streams"), HELD_REPLICATES, 6), "splits"), parts


@query("g11_heldout_direction", "SELECT split, n_pos, n_neg, " + ", ".join(f"round({c}, 6) AS {c}" for c in (*HELD, "drop_low", "drop_high", "drop_std")) + " FROM splits_t")
def g11(spark, d):
    """Direction fitted on 70 % of each class, ten times; the three streams of the rest, and the drop with its interval."""
    s = _heldout(spark, d)[0]
    return s.select("split", "n_pos", "n_neg", *[r6(c).alias(c) for c in (*HELD, "drop_low", "drop_high", "drop_std")])


_IN = f"SELECT doc_id, label, unnest(['h', 'recon']) AS stream, unnest([round({DOT}(h, v) / sqrt({DOT}(v, v)), 9), round({DOT}(r, v) / sqrt({DOT}(v, v)), 9)]) AS value FROM res_t, dk_t"


@query(
    "g11_heldout_summary",
    f"""WITH ins AS (SELECT avg(d) AS inside_drop, stddev_samp(d) AS inside_sigma FROM (SELECT r, max(auroc) FILTER (stream = 'h') - max(auroc) FILTER (stream = 'recon') AS d FROM ({warea_sql(weights_sql(_IN, REPLICATES, 8), 'stream, r')}) WHERE n_pos > 0 AND n_neg > 0 GROUP BY r)),
    s AS (SELECT {", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in HELD)}, quantile_cont(drop, 0.025) AS drop_low, quantile_cont(drop, 0.975) AS drop_high, count(*) AS n_splits FROM splits_t)
    SELECT {", ".join(f"round({c}_mean, 6) AS {c}_mean, round({c}_std, 6) AS {c}_std" for c in HELD)}, round(drop_low, 6) AS drop_low, round(drop_high, 6) AS drop_high, n_splits, round(inside_drop, 6) AS inside_drop, round(inside_sigma, 6) AS inside_sigma,
    round(drop_mean - inside_drop, 6) AS drop_difference, round(inside_drop - 2 * inside_sigma, 6) AS threshold, drop_mean > inside_drop - 2 * inside_sigma AS check_passed,
    CASE WHEN abs(drop_mean - inside_drop) <= inside_sigma AND auroc_resid_mean >= 0.70 THEN 'ACCEPT' WHEN abs(drop_mean - inside_drop) <= 2 * inside_sigma THEN 'MARGINAL' ELSE 'NULL' END AS decision FROM s, ins""",
)
def g11s(spark, d):
    """The drop on held-out rows against that within the partition."""
    from corpuslens.operators import dictionary as D

    splits, parts = _heldout(spark, d)
    wide = parts.crossJoin(F.broadcast(V.mean_diff(parts).select("d"))).select(F.lit(0).alias("all"), "doc_id", "label", *[F.round(V.project(F.col(c), F.col("d")), 9).alias(c) for c in D.STREAMS[:2]])
    inside = R.interval(R.paired_difference(wide, "h", "recon", REPLICATES, 8, ["all"]), ["all"], "delta")
    out = R.heldout_decision(splits, inside)
    plain = ("n_splits", "check_passed", "decision")
    return out.select(*[r6(c).alias(c) for c in out.columns if c not in plain], *plain)


G12 = f"SELECT grp, quantile_cont(auroc, 0.025) AS low, quantile_cont(auroc, 0.975) AS high FROM ({warea_sql(weights_sql('SELECT doc_id, grp, label, a AS value FROM two_t', 100, 12), 'grp, r')}) WHERE n_pos > 0 AND n_neg > 0 AND grp < 5 GROUP BY grp"


@query(
    "g12_refresh_intervals",
    f"""WITH old AS ({G12}), nw AS (SELECT grp, quantile_cont(auroc, 0.025) AS low, quantile_cont(auroc, 0.975) AS high FROM ({G1}) WHERE n_pos > 0 AND n_neg > 0 GROUP BY grp)
    SELECT grp, round(o.low, 6) AS old_low, round(o.high, 6) AS old_high, round(n.low, 6) AS low, round(n.high, 6) AS high, round(n.low - o.low, 6) AS d_low, round(n.high - o.high, 6) AS d_high, CASE WHEN o.low IS NULL THEN 1 ELSE 2 END AS n_runs FROM nw n LEFT JOIN old o USING (grp)""",
)
def g12(spark, d):
    """Records of an earlier run (100 replicates, five groups) read back, refreshed with 10,000 replicates, and appended to the history."""
    s = named(scores(spark, d)).select("grp", "doc_id", "label", F.col("first").alias("value"))
    path = scratch(spark, "intervals")
    R.bootstrap_ci(s.filter("grp < 5"), ["grp"], 100, 12).select("grp", F.lit(0).alias("run"), "low", "high").write.parquet(path)
    history = spark.read.parquet(path)
    new = R.refresh_intervals(s, history, ["grp"], REPLICATES, 1)
    runs = R.append_history(history, new, ["grp"], 1).groupBy("grp").agg(F.count(F.lit(1)).cast("int").alias("n_runs"))
    return new.join(runs, "grp").select("grp", *[r6(c).alias(c) for c in ("old_low", "old_high", "low", "high", "d_low", "d_high")], "n_runs")


# -- cohort -----------------------------------------------------------------------------
CTE["rec_t"] = """SELECT model, seed, metric, CASE WHEN model = 'de' AND seed = 2 AND metric = 'toxic' THEN NULL ELSE value END AS value FROM (
    SELECT model, seed, unnest(['chars', 'toxic', 'quality']) AS metric, unnest([c, t, q]) AS value FROM (
    SELECT lang AS model, CAST(doc_id % 6 AS INTEGER) AS seed, round(avg(n_chars) / 1000, 6) AS c, round(avg(toxic), 6) AS t, round(avg(quality), 6) AS q FROM documents JOIN labels USING (doc_id) GROUP BY ALL)) WHERE NOT (model = 'es' AND seed = 3)"""


def records(spark, d):
    """Run records made of the labelled documents: model (language), seed, metric, value; a seed and a value are missing."""
    r = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    w = r.groupBy(F.col("lang").alias("model"), (F.col("doc_id") % 6).cast("int").alias("seed")).agg(
        F.round(F.avg("n_chars") / 1000, 6).alias("chars"), F.round(F.avg("toxic"), 6).alias("toxic"), F.round(F.avg("quality"), 6).alias("quality")
    )
    long = w.filter(~((F.col("model") == "es") & (F.col("seed") == 3))).unpivot(["model", "seed"], ["chars", "toxic", "quality"], "metric", "value")
    gap = (F.col("model") == "de") & (F.col("seed") == 2) & (F.col("metric") == "toxic")
    return long.withColumn("value", F.when(~gap, F.col("value")))


CTE["sum_t"] = "SELECT model, metric, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(min(value), 6) AS lowest, round(max(value), 6) AS highest, string_agg(seed || ':' || CAST(round(value * 1e6) AS BIGINT), ',' ORDER BY seed) AS values_e6 FROM rec_t WHERE value IS NOT NULL GROUP BY model, metric"


def _roster(spark, d):
    return table(spark, d, "documents").select(F.col("lang").alias("model")).distinct().withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(5))))


@query(
    "k1_seed_summary",
    """WITH ro AS (SELECT DISTINCT lang AS model, unnest(range(6)) AS seed FROM documents), ms AS (SELECT model, metric, string_agg(seed, ',' ORDER BY seed) AS missing_seeds FROM (SELECT model, CAST(seed AS INTEGER) AS seed, metric FROM ro, (SELECT DISTINCT metric FROM rec_t)
    EXCEPT SELECT model, seed, metric FROM rec_t WHERE value IS NOT NULL) GROUP BY ALL) SELECT sum_t.*, coalesce(missing_seeds, '') AS missing_seeds FROM sum_t LEFT JOIN ms USING (model, metric)""",
)
def k1(spark, d):
    return K.seed_summary(records(spark, d), _roster(spark, d))


@query("k2_prefer", "SELECT model, seed, metric, coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NOT NULL THEN 'primary' WHEN b.value IS NOT NULL THEN 'fallback' END AS origin FROM (SELECT * FROM rec_t WHERE seed < 4) a FULL JOIN (SELECT model, seed, metric, round(value + 1, 6) AS value FROM rec_t WHERE seed > 1) b USING (model, seed, metric)")
def k2(spark, d):
    r = records(spark, d)
    return K.prefer(r.filter("seed < 4"), r.filter("seed > 1").withColumn("value", F.round(F.col("value") + 1, 6)), ["model", "seed", "metric"])


CTE["delta_t"] = """SELECT model, metric, round(round(a.m, 6) - round(b.m, 6), 6) AS d_mean, round(abs(round(a.m, 6) - round(b.m, 6)), 6) AS abs_d, round(round(a.s, 6) - round(b.s, 6), 6) AS d_std, CASE WHEN round(abs(round(a.m, 6) - round(b.m, 6)), 6) >= 0.005 THEN 'MATERIAL' ELSE 'NEGLIGIBLE' END AS status
    FROM (SELECT model, metric, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM rec_t WHERE seed < 5 AND value IS NOT NULL GROUP BY ALL) a JOIN (SELECT model, metric, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM rec_t WHERE value IS NOT NULL GROUP BY ALL) b USING (model, metric)"""


def _deltas(spark, d):
    r, ro = records(spark, d), _roster(spark, d)
    return K.cohort_delta(K.seed_summary(r.filter("seed < 5"), ro), K.seed_summary(r, ro), ["model", "metric"])


@query("k3_cohort_delta", "SELECT * FROM delta_t")
def k3(spark, d):
    """Five seeds against six."""
    return _deltas(spark, d)


@query("k3_materiality", "SELECT model, count(*) AS n_metrics, coalesce(string_agg(metric, ', ' ORDER BY metric) FILTER (status = 'MATERIAL'), '') AS reason, CASE WHEN count(*) FILTER (status = 'MATERIAL') > 0 THEN 'MATERIAL' ELSE 'NEGLIGIBLE' END AS verdict FROM delta_t GROUP BY model")
def k3m(spark, d):
    return K.materiality(_deltas(spark, d), ["model"])


@query("k4_noise_floor", "SELECT model, metric, mean, std, round(CASE WHEN std > 0 THEN mean / std END, 6) AS n_sigma FROM sum_t")
def k4(spark, d):
    return K.noise_floor(K.seed_summary(records(spark, d), _roster(spark, d)))


@query("k5_outliers", "SELECT model, seed, metric, round(value, 6) AS value, round(z, 6) AS z FROM (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM rec_t WINDOW w AS (PARTITION BY model, metric)) WHERE abs(z) > 1.5")
def k5(spark, d):
    return K.outliers(records(spark, d), 1.5)


@query(
    "k5_prior_comparison",
    """WITH p AS (SELECT model, metric, round(avg(value), 6) AS prior_mean FROM rec_t WHERE seed < 3 AND value IS NOT NULL GROUP BY ALL)
    SELECT model, metric, mean, prior_mean, round(mean - prior_mean, 6) AS d_mean, round(CASE WHEN std > 0 THEN (mean - prior_mean) / std END, 6) AS n_sigma, abs(mean - prior_mean) > 2 * std AS outside FROM sum_t JOIN p USING (model, metric)""",
)
def k5p(spark, d):
    r, ro = records(spark, d), _roster(spark, d)
    return K.prior_comparison(K.seed_summary(r, ro), K.seed_summary(r.filter("seed < 3"), ro), ["model", "metric"])


@query("k6_sign_tally", "SELECT metric, count(*) FILTER (value > 0.5) AS k, count(*) AS n, count(*) FILTER (value > 0.5) || '/' || count(*) AS tally FROM rec_t GROUP BY ROLLUP (metric)")
def k6(spark, d):
    return K.sign_tally(records(spark, d), "metric", F.col("value") > 0.5)


_BASE = "SELECT seed, max(value) FILTER (metric = 'quality') AS base, max(value) FILTER (metric = 'toxic') AS probe, max(value) FILTER (metric = 'quality') AS original, max(value) FILTER (metric = 'chars') AS recon FROM rec_t WHERE model = 'en' GROUP BY seed"
CTE["grid_t"] = f"""SELECT criterion, depth, count(*) AS n, round(avg(dev), 6) AS mean_dev, round(max(abs(dev)), 6) AS max_dev, round(max(abs(dev)), 6) < 0.05 AS stable FROM (SELECT model AS criterion, metric AS depth, value - base AS dev FROM rec_t JOIN ({_BASE}) USING (seed)) WHERE dev IS NOT NULL GROUP BY ALL"""


def _grid(spark, d):
    """Cells and baseline of a selection grid, made of the run records."""
    r = records(spark, d)
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    base = r.filter("model = 'en'").groupBy("seed").agg(pick("quality").alias("base"), pick("toxic").alias("probe"), pick("quality").alias("original"), pick("chars").alias("recon"))
    return r.filter("value IS NOT NULL").select(F.col("model").alias("criterion"), F.col("metric").alias("depth"), "seed", "value"), base


@query("k7_grid_summary", "SELECT * FROM grid_t")
def k7(spark, d):
    return K.grid_summary(*_grid(spark, d))


@query(
    "k7_grid_verdict",
    f"""SELECT round(m, 6) AS max_dev, m < 0.05 AS stable, round(lo, 6) AS probe_min, round(av, 6) AS probe_mean, round(hi, 6) AS probe_max, CASE WHEN hi <= 0.55 AND lo >= 0.45 THEN 'ABSENT' WHEN hi <= 0.60 THEN 'WEAK' ELSE 'MIXED' END AS verdict
    FROM (SELECT max(max_dev) AS m FROM grid_t), (SELECT min(probe) AS lo, avg(probe) AS av, max(probe) AS hi FROM ({_BASE}))""",
)
def k7v(spark, d):
    cells, base = _grid(spark, d)
    return K.grid_verdict(K.grid_summary(cells, base), base)


@query(
    "k7_grid_flags",
    f"SELECT seed, flags FROM (SELECT seed, concat_ws('; ', CASE WHEN probe < 0.45 OR probe > 0.65 THEN 'probe out of range' END, CASE WHEN original - recon < 0 THEN 'reconstruction above original' END) AS flags FROM ({_BASE})) WHERE flags <> ''",
)
def k7f(spark, d):
    return K.grid_flags(_grid(spark, d)[1])


@query("k8_quality_tier", "SELECT model, seed, value, CASE WHEN value >= 0.90 THEN 'strict' WHEN value >= 0.85 THEN 'permissive' ELSE 'excluded' END AS tier FROM rec_t WHERE metric = 'quality'")
def k8(spark, d):
    return K.quality_tier(records(spark, d).filter("metric = 'quality'")).select("model", "seed", "value", "tier")


@query("k9_intervention_table", "SELECT model, " + ", ".join(f"round(max(value) FILTER (seed = {i}), 6) AS \"{i}\"" for i in range(4)) + " FROM rec_t WHERE metric = 'chars' GROUP BY model")
def k9(spark, d):
    return K.wide_table(records(spark, d).filter("metric = 'chars'"), "model", "seed", [0, 1, 2, 3], "value")


K9_FIELDS = ("chars", "quality")
K9_CELL = "CASE WHEN {c} IS NULL THEN '-' ELSE printf('%.4f', {c}) END"


@query(
    "k9_markdown",
    "WITH w AS (SELECT model, " + ", ".join(f"max(value) FILTER (metric = '{f}' AND seed = {i}) AS {f}_{i}" for f in K9_FIELDS for i in (0, 2, 4)) + " FROM rec_t WHERE seed % 2 = 0 GROUP BY model) SELECT model AS key, '| ' || model || "
    + " || ".join(f"' | ' || {K9_CELL.format(c=f'{f}_{i}')}" for f in K9_FIELDS for i in (0, 2, 4)) + " || ' |' AS line FROM w",
)
def k9m(spark, d):
    """Two fields of each model by seed as lines of a table; records of an unfinished epoch (odd seeds) are left out."""
    r = records(spark, d).groupBy("model", "seed").pivot("metric", list(K9_FIELDS)).agg(F.first("value", ignorenulls=True))
    r = r.withColumn("epoch", F.when(F.col("seed") % 2 == 1, F.col("seed")))
    return K.markdown(K.wide_fields(r, "model", "seed", [0, 2, 4], list(K9_FIELDS), "epoch"))


CTE["claims_t"] = "SELECT model || '/' || metric AS path, model || '/' || metric AS label, round(mean, 3) + CASE WHEN model = 'fr' THEN 0.01 ELSE 0 END AS expected FROM sum_t UNION ALL SELECT 'none/none', 'none/none', 1.0"
CHECK = "SELECT label, round(mean, 6) AS actual, round(abs(mean - expected), 6) AS diff, CASE WHEN round(abs(mean - expected), 9) <= 0.002 THEN 'PASS' ELSE 'FAIL' END AS status FROM claims_t LEFT JOIN sum_t ON path = model || '/' || metric"


def _checked(spark, d):
    s = K.seed_summary(records(spark, d), _roster(spark, d)).select(F.concat_ws("/", "model", "metric").alias("path"), F.col("mean").alias("value"), "model")
    claims = s.select("path", F.col("path").alias("label"), (F.round("value", 3) + F.when(F.col("model") == "fr", 0.01).otherwise(0.0)).alias("expected"), F.lit(None).cast("double").alias("tol"))
    lost = s.agg(F.lit("none/none").alias("path"), F.lit("none/none").alias("label"), F.lit(1.0).alias("expected"), F.lit(None).cast("double").alias("tol"))
    return K.verify_claims(claims.unionByName(lost), s)


@query("k10_verify_claims", CHECK)
def k10(spark, d):
    return _checked(spark, d)


@query("k10_claims_summary", f"SELECT count(*) FILTER (status = 'PASS') AS n_pass, count(*) AS n, count(*) FILTER (status = 'PASS') = count(*) AS ok FROM ({CHECK})")
def k10s(spark, d):
    return K.claims_summary(_checked(spark, d))


@query(
    "k11_validate_records",
    """WITH r AS (SELECT vec_id AS key, CASE WHEN vec_id % 50 = 0 THEN NULL ELSE label END AS label, CASE WHEN vec_id % 30 = 0 THEN 63 ELSE 64 END AS na, 64 AS nb FROM embeddings)
    SELECT key, concat_ws('; ', CASE WHEN label IS NULL THEN 'missing label' END, CASE WHEN na <> nb THEN 'a and b differ in length' END, CASE WHEN na <> 64 THEN 'a has not 64 entries' END) AS problems FROM r""",
)
def k11(spark, d):
    """Records written as JSON and read with a declared schema."""
    e = table(spark, d, "embeddings")
    path = scratch(spark, "records")
    short = F.when(F.col("vec_id") % 30 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    e.select(F.struct(F.col("vec_id").alias("key"), F.when(F.col("vec_id") % 50 != 0, F.col("label")).alias("label"), short.alias("a"), F.col("embedding").alias("b")).alias("run")).write.json(path)
    back = read_records(spark, path, "run STRUCT<key: BIGINT, label: INT, a: ARRAY<FLOAT>, b: ARRAY<FLOAT>>", {"key": "run.key", "label": "run.label", "a": "run.a", "b": "run.b"})
    return K.validate_records(back, ["label"], ["a", "b"], 64)


@query(
    "k12_merge_intervals",
    "SELECT key, label, round(coalesce(n.low, o.low), 6) AS low, round(coalesce(n.high, o.high), 6) AS high FROM (SELECT model || '/' || metric AS key, model AS label, lowest AS low, highest AS high FROM sum_t WHERE model <> 'es') o FULL JOIN (SELECT model || '/' || metric AS key, mean - std AS low, mean + std AS high FROM sum_t WHERE model <> 'en') n USING (key)",
)
def k12(spark, d):
    s = K.seed_summary(records(spark, d), _roster(spark, d)).withColumn("key", F.concat_ws("/", "model", "metric"))
    old = s.filter("model <> 'es'").select("key", F.col("model").alias("label"), F.col("lowest").alias("low"), F.col("highest").alias("high"))
    new = s.filter("model <> 'en'").select("key", (F.col("mean") - F.col("std")).alias("low"), (F.col("mean") + F.col("std")).alias("high"))
    return K.merge_intervals(old, new)


@query(
    "k12_drop_intervals",
    """SELECT model, round(a.mean - b.mean, 6) AS drop, round(a.mean - b.mean - (a.highest - a.lowest) / 2 - (b.highest - b.lowest) / 2, 6) AS low, round(a.mean - b.mean + (a.highest - a.lowest) / 2 + (b.highest - b.lowest) / 2, 6) AS high
    FROM (SELECT * FROM sum_t WHERE metric = 'chars') a JOIN (SELECT * FROM sum_t WHERE metric = 'toxic') b USING (model)""",
)
def k12d(spark, d):
    """The difference of two metrics of each model, with the interval by which half widths add up."""
    s = K.seed_summary(records(spark, d), _roster(spark, d)).select("model", "metric", F.col("mean").alias("value"), F.col("lowest").alias("low"), F.col("highest").alias("high"))
    return K.drop_intervals(s, ["model"], "metric", "chars", "toxic")


@query(
    "k13_model_table",
    "SELECT model, arg_max(metric, mean) AS top_metric, round(max(mean), 6) AS top_mean, min(n) < 6 AS provisional, n_docs FROM sum_t JOIN (SELECT lang AS model, count(*) AS n_docs FROM documents GROUP BY lang) USING (model) GROUP BY model, n_docs",
)
def k13(spark, d):
    s = K.seed_summary(records(spark, d), _roster(spark, d))
    own = s.groupBy("model").agg(F.max_by("metric", "mean").alias("top_metric"), r6(F.max("mean")).alias("top_mean"), (F.min("n") < 6).alias("provisional"))
    return own.join(table(spark, d, "documents").groupBy(F.col("lang").alias("model")).agg(F.count(F.lit(1)).alias("n_docs")), "model")


CHECKPOINTS = """SELECT lang, lpad(CAST(n_chars // 500 AS VARCHAR), 6, '0') AS name, CASE WHEN NOT (lang = 'fr' AND doc_id % 2 = 0) THEN source || '-' || doc_id END AS key, doc_id AS path, CASE WHEN doc_id % 5 <> 0 THEN (doc_id * 37 % 101 - 50) / 10.0 END AS delta FROM documents"""


@query(
    "k14_latest_checkpoint",
    f"""WITH c AS ({CHECKPOINTS}), l AS (SELECT * FROM c JOIN (SELECT lang, max(name) AS name FROM c GROUP BY lang) USING (lang, name)),
    s AS (SELECT lang, name, max(path) FILTER (key IS NULL) AS single, arg_min(path, key) FILTER (key IS NOT NULL) AS first, (SELECT path FROM l b WHERE b.lang = l.lang AND key IS NOT NULL AND delta IS NOT NULL ORDER BY abs(delta), key LIMIT 1) AS best FROM l GROUP BY lang, name)
    SELECT lang, name, kind, CASE WHEN single IS NOT NULL THEN single WHEN kind = 'first' THEN first ELSE best END AS path FROM s, (SELECT unnest(['first', 'best_ppl']) AS kind)""",
)
def k14c(spark, d):
    """The first and the best checkpoint of the last run of each model."""
    docs = table(spark, d, "documents")
    rows = docs.select(
        "lang", F.lpad(F.floor(F.col("n_chars") / 500).cast("string"), 6, "0").alias("name"), F.col("doc_id").alias("path"),
        F.when(~((F.col("lang") == "fr") & (F.col("doc_id") % 2 == 0)), F.concat_ws("-", "source", F.col("doc_id").cast("string"))).alias("key"),
        F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") * 37 % 101 - 50) / 10.0).alias("delta"),
    )
    both = [K.latest_checkpoint(rows, ["lang"], s).withColumn("kind", F.lit(s)) for s in K.SELECT]
    return both[0].unionByName(both[1]).select("lang", "name", "kind", "path")


@query("k14_latest_run", "SELECT lang, source, arg_max(doc_id, lpad(CAST(n_chars AS VARCHAR), 8, '0') || '-' || lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS path, max(lpad(CAST(n_chars AS VARCHAR), 8, '0') || '-' || lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS name FROM documents GROUP BY ALL")
def k14(spark, d):
    runs = table(spark, d, "documents").select("lang", "source", F.col("doc_id").alias("path"), F.concat_ws("-", F.lpad(F.col("n_chars").cast("string"), 8, "0"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("name"))
    return K.latest_run(runs, ["lang", "source"])


CTE["cells_t"] = f"""SELECT grp AS cell, recon_cos, err_ratio, alive, least(n - 1, 64) AS rank_eff, 10 * (grp + 1) AS k, var_50 FROM
    (SELECT CAST(doc_id % 5 AS INTEGER) AS grp, count(*) AS n, avg({DOT}(h, r) / (sqrt({DOT}(h, h)) * sqrt({DOT}(r, r)) + 1e-12)) AS recon_cos, avg(sqrt({DOT}(e, e)) / (sqrt({DOT}(h, h)) + 1e-12)) AS err_ratio,
    avg({DOT}(e[1:50], e[1:50])) / avg({DOT}(e, e)) AS var_50 FROM res_t GROUP BY 1) JOIN (SELECT CAST(doc_id % 5 AS INTEGER) AS grp, count(DISTINCT feature_id) AS alive FROM codes_t GROUP BY 1) USING (grp)"""


@query(
    "i9_gate_cells",
    """SELECT cell, reasons = '' AS passed, reasons FROM (SELECT cell, concat_ws('; ', CASE WHEN recon_cos < 0.85 THEN 'recon_cos' END, CASE WHEN err_ratio NOT BETWEEN 0.01 AND 0.30 THEN 'err_ratio' END, CASE WHEN alive < 100 THEN 'alive' END,
    CASE WHEN rank_eff <= k THEN 'rank' END, CASE WHEN k = 50 AND var_50 < 0.10 THEN 'variance' END) AS reasons FROM cells_t)""",
)
def i9(spark, d):
    """Named gates on the cells of five groups of vectors at ranks 10 to 50."""
    from corpuslens.functions.vectors import cosine, dot, norm
    from corpuslens.operators import dictionary as D
    from corpuslens.plans.vector_queries import _dict

    a, w = _dict(spark, d)
    grp = (F.col("doc_id") % 5).cast("int").alias("cell")
    e = F.col("resid")
    parts = D.decompose(a, w).groupBy(grp).agg(
        F.count(F.lit(1)).alias("n"), F.avg(cosine(F.col("h"), F.col("recon"))).alias("recon_cos"), F.avg(norm(e) / (norm(F.col("h")) + 1e-12)).alias("err_ratio"),
        (F.avg(dot(F.slice(e, 1, 50), F.slice(e, 1, 50))) / F.avg(dot(e, e))).alias("var_50"),
    )
    alive = D.encode(a, w).groupBy(grp).agg(F.count_distinct("feature_id").alias("alive"))
    cells = parts.join(alive, "cell").withColumn("rank_eff", F.least(F.col("n") - 1, F.lit(64))).withColumn("k", 10 * (F.col("cell") + 1))
    return K.ablation_gates(cells)
