"""Queries of vectors, directions, dictionaries, ablation and dictionary health."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpuslens.functions.draws import r6, u01
from corpuslens.functions.vectors import cosine, norm, scaled
from corpuslens.operators import dictionary as D
from corpuslens.operators import metrics as M
from corpuslens.operators import vectors as V
from corpuslens.plans.base import CTE, acts, dictionary, layers, query, settled, table, u

DOT = "list_dot_product"


def area_sql(rows: str, by: str) -> str:
    """SELECT by, n_pos, n_neg, auroc over rows (by, label, value)."""
    return f"""SELECT {by}, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg,
    CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (2 * below + n)) / (2.0 * sum(p) * sum(n)) ELSE 0.5 END AS auroc FROM (
    SELECT *, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT {by}, value, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM ({rows}) WHERE value IS NOT NULL GROUP BY ALL)) GROUP BY {by}"""


def warea_sql(rows: str, by: str) -> str:
    """The same over rows (by, label, value, w) that count w times."""
    return f"""SELECT {by}, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg,
    CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (2 * below + n)) / (2.0 * sum(p) * sum(n)) ELSE 0.5 END AS auroc FROM (
    SELECT *, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT {by}, value, CAST(coalesce(sum(w) FILTER (label = 1), 0) AS BIGINT) AS p, CAST(coalesce(sum(w) FILTER (label = 0), 0) AS BIGINT) AS n FROM ({rows}) WHERE value IS NOT NULL GROUP BY ALL)) GROUP BY {by}"""


CTE["ldk_t"] = "SELECT layer, list(m ORDER BY i) AS v FROM (SELECT layer, i, avg(x) FILTER (label = 1) - avg(x) FILTER (label = 0) AS m FROM (SELECT layer, label, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM layers_t) GROUP BY ALL) GROUP BY layer"
CTE["lscore_t"] = f"SELECT layer, label, round({DOT}(h, v) / sqrt({DOT}(v, v)), 9) AS value FROM layers_t JOIN ldk_t USING (layer)"


@query(
    "e3_direction_audit",
    f"SELECT layer, n_pos, n_neg, round(auroc, 6) AS auroc, round(greatest(auroc, 1 - auroc), 6) AS auroc_bi, CASE WHEN 1 - auroc > auroc THEN -1 ELSE 1 END AS sign FROM ({area_sql('SELECT layer, label, value FROM lscore_t', 'layer')})",
)
def e3(spark, d):
    """Mean-difference direction of each layer, projection on it, and how well that separates the classes."""
    a = layers(spark, d)
    scores = a.join(F.broadcast(V.mean_diff(a, ["layer"])), "layer").select("layer", "label", F.round(V.project(F.col("h"), F.col("d")), 9).alias("value"))  # one row per layer
    return M.oriented(M.auroc(scores, ["layer"])).select("layer", "n_pos", "n_neg", r6("auroc").alias("auroc"), r6("auroc_bi").alias("auroc_bi"), "sign")


@query("e1_mean_pool", "SELECT g AS grp, i AS dim, round(avg(x), 6) AS mean FROM (SELECT doc_id // 20 AS g, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM acts_t WHERE doc_id % 3 <> 0) GROUP BY ALL")
def e1(spark, d):
    rows = acts(spark, d).withColumn("grp", F.floor(F.col("doc_id") / 20)).withColumn("mask", (F.col("doc_id") % 3 != 0).cast("int"))
    return V.mean_pool(rows, ["grp"], "mask").select("grp", F.posexplode("h").alias("p", "m")).select("grp", (F.col("p") + 1).cast("long").alias("dim"), r6("m").alias("mean"))


CTE["lnorm_t"] = f"SELECT layer, label, sqrt({DOT}(h, h)) AS value FROM layers_t"


@query(
    "e2_norm_audit",
    f"""SELECT layer, round(auroc, 6) AS auroc, sign, round(mean_1, 6) AS mean_1, round(std_1, 6) AS std_1, round(mean_0, 6) AS mean_0, round(std_0, 6) AS std_0 FROM (
    SELECT *, CASE WHEN 1 - auroc > auroc THEN -1 ELSE 1 END AS sign FROM ({area_sql('SELECT layer, label, round(value, 9) AS value FROM lnorm_t', 'layer')})) JOIN (
    SELECT layer, avg(value) FILTER (label = 1) AS mean_1, stddev_pop(value) FILTER (label = 1) AS std_1, avg(value) FILTER (label = 0) AS mean_0, stddev_pop(value) FILTER (label = 0) AS std_0 FROM lnorm_t GROUP BY layer) USING (layer)""",
)
def e2(spark, d):
    rows = V.norm_audit(layers(spark, d).withColumn("h", F.col("h")))
    return rows.select("layer", r6("auroc").alias("auroc"), "sign", *[r6(c).alias(c) for c in ("mean_1", "std_1", "mean_0", "std_0")])


@query("e3_mean_diff", "SELECT i AS dim, round(avg(x) FILTER (label = 1) - avg(x) FILTER (label = 0), 6) AS d FROM dim_t GROUP BY i")
def e3d(spark, d):
    return V.mean_diff(acts(spark, d)).select(F.posexplode("d").alias("p", "x")).select((F.col("p") + 1).cast("long").alias("dim"), r6("x").alias("d"))


@query(
    "e4_covariance",
    "SELECT a.label, CAST(a.i AS INTEGER) AS i, b.i AS j, round(covar_samp(a.x, b.x), 6) AS c FROM dim_t a JOIN dim_t b USING (doc_id) GROUP BY ALL",
)
def e4(spark, d):
    return V.covariances(acts(spark, d), ["label"]).select("label", (F.col("i") + 1).alias("i"), F.posexplode("row").alias("p", "x")).select("label", "i", (F.col("p") + 1).cast("long").alias("j"), r6("x").alias("c"))


@query("e4_contrastive_pca")
def e4p(spark, d):
    found = V.contrastive_pca(acts(spark, d), 10)
    return spark.createDataFrame([(i, round(v, 6), round(e, 6)) for i, (v, e, _) in enumerate(found)], "comp int, eigenvalue double, explained double")


@query(
    "e4_paired_covariance",
    """WITH r AS (SELECT label, h, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS k FROM acts_t), d AS (SELECT a.k, i, a.h[i] - b.h[i] AS x FROM r a JOIN r b USING (k), (SELECT unnest(range(1, 65)) AS i) WHERE a.label = 1 AND b.label = 0)
    SELECT CAST(a.i AS INTEGER) AS i, b.i AS j, round(covar_samp(a.x, b.x), 6) AS c FROM d a JOIN d b USING (k) GROUP BY ALL""",
)
def e4pc(spark, d):
    """Covariance of the differences of vectors paired across classes."""
    rows = V.covariances(V.paired_differences(acts(spark, d)).withColumn("all", F.lit(0)), ["all"])
    return rows.select((F.col("i") + 1).alias("i"), F.posexplode("row").alias("p", "x")).select("i", (F.col("p") + 1).cast("long").alias("j"), r6("x").alias("c"))


@query("e4_paired_pca")
def e4pp(spark, d):
    """Principal directions of the paired differences, and their angle to the first contrastive direction."""
    found, own = V.paired_pca(acts(spark, d), 10), np.array(V.contrastive_pca(acts(spark, d), 1)[0][2])
    return spark.createDataFrame([(i, round(v, 6), round(e, 6), round(abs(float(np.array(x) @ own)), 6)) for i, (v, e, x) in enumerate(found)], "comp int, variance double, explained double, along_first double")


def _recall(a):
    """Vectors of members with recall from a stand-in loss, -h[1]."""
    return V.recall_label(a.filter("label = 1").withColumn("loss", -F.col("h")[0]), "loss", "loss")


@query("e5_principal_angles")
def e5(spark, d):
    a = layers(spark, d).filter("layer > 0")
    rows = []
    for layer in (1, 2):
        own = a.filter(F.col("layer") == layer)
        for name, part in (("k", own), ("r", _recall(own).drop("label").withColumnRenamed("recall", "label"))):
            rows += [(layer, name, v) for _, _, v in V.contrastive_pca(part.select("label", "h"), 5)]
    bases = spark.createDataFrame(rows, "layer int, name string, v array<double>")
    out = bases.groupBy("layer").applyInPandas(V.layer_angles, "layer int, min_deg double, mean_deg double, max_deg double")
    return out.select("layer", *[r6(c).alias(c) for c in ("min_deg", "mean_deg", "max_deg")])


@query("e6_recall_label", "SELECT doc_id, CAST(-h[1] < (SELECT median(-h[1]) FROM acts_t WHERE label = 1) AS INTEGER) AS recall FROM acts_t WHERE label = 1")
def e6(spark, d):
    return _recall(acts(spark, d)).select("doc_id", "recall")


@query("e7_project", f"SELECT doc_id, round({DOT}(list_transform(list_zip(h, b), lambda p: p[1] - p[2]), v) / sqrt({DOT}(v, v)), 6) AS score FROM acts_t, dk_t, bdec_t")
def e7(spark, d):
    a = acts(spark, d)
    mean = a.agg(V.mean_vector().alias("c"))
    return a.crossJoin(F.broadcast(V.mean_diff(a))).crossJoin(F.broadcast(mean)).select("doc_id", r6(V.project(F.col("h"), F.col("d"), F.col("c"))).alias("score"))


CTE["dr_t"] = "SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(x) FILTER (r = 1) - avg(x) FILTER (r = 0) AS m FROM (SELECT unnest(h) AS x, generate_subscripts(h, 1) AS i, CAST(-h[1] < (SELECT median(-h[1]) FROM acts_t WHERE label = 1) AS INTEGER) AS r FROM acts_t WHERE label = 1) GROUP BY i)"


@query(
    "e8_channel_scores",
    f"""WITH c AS (SELECT doc_id, list_transform(list_zip(h, b), lambda p: p[1] - p[2]) AS c FROM acts_t, bdec_t)
    SELECT doc_id, round(abs({DOT}(c, k.v)) / sqrt({DOT}(k.v, k.v)), 6) AS abs_k, round(abs({DOT}(c, r.v)) / sqrt({DOT}(r.v, r.v)), 6) AS abs_r, round(sqrt({DOT}(c[1:4], c[1:4])), 6) AS sub FROM c, dk_t k, dr_t r""",
)
def e8(spark, d):
    a = acts(spark, d)
    mean = a.agg(V.mean_vector().alias("c"))
    dr = V.mean_diff(_recall(a), label="recall").select(F.col("d").alias("dr"))
    w = a.crossJoin(F.broadcast(V.mean_diff(a).select("d"))).crossJoin(F.broadcast(dr)).crossJoin(F.broadcast(mean))
    centred = F.zip_with("h", "c", lambda x, y: x - y)
    return w.select("doc_id", r6(F.abs(V.project(centred, F.col("d")))).alias("abs_k"), r6(F.abs(V.project(centred, F.col("dr")))).alias("abs_r"), r6(norm(F.slice(centred, 1, 4))).alias("sub"))


def _dict(spark, d, kind="relu", k=None, seed=0):
    a = acts(spark, d)
    return a, D.Dictionary(dictionary(spark, d, seed), D.fitted_bias(a), kind, k)


@query("e9_encode", "SELECT doc_id, feature_id, round(z, 6) AS z FROM codes_t")
def e9(spark, d):
    a, w = _dict(spark, d)
    return D.encode(a, w).select("doc_id", "feature_id", r6("z").alias("z"))


PRE = f"SELECT a.doc_id, d.feature_id, {DOT}(d.w, list_transform(list_zip(a.h, b.b), lambda p: p[1] - p[2])) + d.b_enc AS z FROM acts_t a, dict_t d, bdec_t b"


@query("e9_encode_topk", f"SELECT doc_id, feature_id, round(z, 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY z DESC, feature_id) AS r FROM ({PRE})) WHERE r <= 8 AND z > 0")
def e9t(spark, d):
    a, w = _dict(spark, d, "topk", 8)
    return D.encode(a, w).select("doc_id", "feature_id", r6("z").alias("z"))


@query("e9_encode_jumprelu", f"SELECT doc_id, feature_id, round(z, 6) AS z FROM ({PRE}) WHERE z > 0.1 + (feature_id % 4) / 10.0::DOUBLE")
def e9j(spark, d):
    a = acts(spark, d)
    table = dictionary(spark, d).withColumn("theta", F.lit(0.1) + (F.col("feature_id") % 4) / 10.0)
    return D.encode(a, D.Dictionary(table, D.fitted_bias(a), "jumprelu")).select("doc_id", "feature_id", r6("z").alias("z"))


@query("e10_decompose", "SELECT doc_id, round(h[1] - r[1], 6) AS first, round(sqrt(list_sum(list_transform(list_zip(h, r), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS err, round(sqrt(list_dot_product(r, r)), 6) AS recon_norm FROM recon_t")
def e10(spark, d):
    a, w = _dict(spark, d)
    return D.decompose(a, w).select("doc_id", r6(F.col("resid")[0]).alias("first"), r6(norm(F.col("resid"))).alias("err"), r6(norm(F.col("recon"))).alias("recon_norm"))


CTE["res_t"] = "SELECT doc_id, label, h, r, list_transform(list_zip(h, r), lambda p: p[1] - p[2]) AS e FROM recon_t"
CTE["streams_t"] = f"""SELECT doc_id, label, s AS score, round(CASE WHEN t = 'k' THEN {DOT}(x, v) / sqrt({DOT}(v, v)) ELSE sqrt({DOT}(x, x)) END, 9) AS value FROM (
    SELECT doc_id, label, t || '_' || n AS s, t, x, v FROM (SELECT doc_id, label, 'h' AS n, h AS x FROM res_t UNION ALL SELECT doc_id, label, 'recon', r FROM res_t UNION ALL SELECT doc_id, label, 'resid', e FROM res_t), (SELECT unnest(['k', 'norm']) AS t), dk_t)"""
CTE["sarea_t"] = area_sql("SELECT score, label, value FROM streams_t", "score")


@query(
    "e11_decomposition_audit",
    """WITH w AS (SELECT """
    + ", ".join(f"max(greatest(auroc, 1 - auroc)) FILTER (score = '{n}') AS {n}" for n in ("k_h", "k_recon", "k_resid", "norm_h", "norm_recon", "norm_resid"))
    + """ FROM sarea_t) SELECT round(k_h, 6) AS k_h, round(k_recon, 6) AS k_recon, round(k_resid, 6) AS k_resid, round(norm_h, 6) AS norm_h, round(norm_recon, 6) AS norm_recon,
    round(norm_resid, 6) AS norm_resid, round(k_h - k_recon, 6) AS drop, round(k_recon / k_h, 6) AS preserved, (k_recon < 0.60 AND k_resid > 0.65) AS is_dark FROM w""",
)
def e11(spark, d):
    a, w = _dict(spark, d)
    out = D.decomposition_audit(D.decompose(a, w), V.mean_diff(a))
    return out.select(*[r6(c).alias(c) for c in out.columns if c != "is_dark"], "is_dark")


@query(
    "e12_recon_quality",
    f"""WITH l AS (SELECT doc_id, count(*) AS l0 FROM codes_t GROUP BY doc_id) SELECT count(*) AS n, round(avg({DOT}(e, e)), 6) AS mse, round(avg({DOT}(h, r) / (sqrt({DOT}(h, h)) * sqrt({DOT}(r, r)) + 1e-12)), 6) AS cosine,
    round(avg(coalesce(l0, 0)), 6) AS l0, round(avg(coalesce(l0, 0) / 128.0), 6) AS sparsity, round(avg(sqrt({DOT}(e, e)) / (sqrt({DOT}(h, h)) + 1e-12)), 6) AS error_ratio FROM res_t LEFT JOIN l USING (doc_id)""",
)
def e12(spark, d):
    a, w = _dict(spark, d)
    out = D.recon_quality(D.decompose(a, w), len(w.ids))
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


@query(
    "e13_eval_summary",
    f"""WITH v AS (SELECT sum({DOT}(e, e)) AS se, sum(list_sum(list_transform(list_zip(h, b), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS sv, sum(len(h)) AS m, count(*) AS n FROM res_t, bdec_t),
    c AS (SELECT sum(z) AS l1, count(DISTINCT feature_id) AS alive FROM codes_t)
    SELECT n, round(se / sv, 6) AS fvu, round(se / m, 6) AS mse, round(l1 / n, 6) AS l1_mean, round(l1, 6) AS l1_sum, round(1 - alive / 128.0, 6) AS dead_fraction FROM v, c""",
)
def e13(spark, d):
    a, w = _dict(spark, d)
    out = D.eval_summary(D.decompose(a, w), D.encode(a, w), len(w.ids))
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


@query(
    "e14_direction_coverage",
    f"""WITH z AS (SELECT feature_id, greatest(0, {DOT}(w, list_transform(list_zip(k.v, b.b), lambda p: p[1] - p[2])) + b_enc) AS z FROM dict_t, dk_t k, bdec_t b),
    r AS (SELECT list(coalesce(s, 0) + b.b[i] ORDER BY i) AS r FROM (SELECT i, sum(z * x) AS s FROM (SELECT feature_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM dict_t) JOIN z USING (feature_id) GROUP BY i), bdec_t b),
    e AS (SELECT v, r, list_transform(list_zip(v, r), lambda p: p[1] - p[2]) AS e FROM r, dk_t)
    SELECT round({DOT}(v, r) / (sqrt({DOT}(v, v)) * sqrt({DOT}(r, r)) + 1e-12), 6) AS cosine, round(sqrt({DOT}(e, e)) / sqrt({DOT}(v, v)), 6) AS residual_fraction FROM e""",
)
def e14(spark, d):
    """Cosine of d_K with its own reconstruction, and the part left over."""
    a, w = _dict(spark, d)
    one = V.mean_diff(a).select(F.lit(0).cast("long").alias("doc_id"), F.lit(1).alias("label"), F.col("d").alias("h"))
    p = D.decompose(one, w)
    return p.select(r6(cosine(F.col("h"), F.col("recon"))).alias("cosine"), r6(norm(F.col("resid")) / norm(F.col("h"))).alias("residual_fraction"))


ALIGN = f"SELECT feature_id, {DOT}(w, v) / (sqrt({DOT}(w, w)) * sqrt({DOT}(v, v)) + 1e-12) AS cos FROM dict_t, dk_t"


@query("e15_feature_alignment", f"SELECT feature_id, round(cos, 6) AS cos FROM ({ALIGN}) ORDER BY round(abs(cos), 9) DESC, feature_id LIMIT 10")
def e15(spark, d):
    out = D.feature_alignment(dictionary(spark, d), V.mean_diff(acts(spark, d)))
    return out.orderBy(F.desc(F.round(F.abs("cos"), 9)), "feature_id").limit(10).select("feature_id", r6("cos").alias("cos"))


@query("e15_mean_alignment", f"SELECT round(avg(abs(cos)), 6) AS mean_all, round(avg(abs(cos)) FILTER (feature_id < 32), 6) AS mean_subset FROM ({ALIGN})")
def e15m(spark, d):
    out = D.feature_alignment(dictionary(spark, d), V.mean_diff(acts(spark, d)))
    return out.agg(r6(F.avg(F.abs("cos"))).alias("mean_all"), r6(F.avg(F.when(F.col("feature_id") < 32, F.abs("cos")))).alias("mean_subset"))


@query("e16_feature_sufficiency")
def e16(spark, d):
    a, w = _dict(spark, d)
    basis = np.array([v for _, _, v in V.contrastive_pca(a, 10)])
    rows = [(n, round(D.feature_sufficiency(basis, w.dec[:n]), 6)) for n in (8, 16, 32, 50, 100)]
    rows.append((len(w.ids), round(D.sufficiency_of_all(dictionary(spark, d), basis), 6)))  # more features than dimensions
    return spark.createDataFrame(rows, "n_features int, sufficiency double")


@query(
    "e17_l2_audit",
    f"""WITH s AS (SELECT label, unnest([{{'k': 'raw', 'x': h}}, {{'k': 'l2', 'x': list_transform(h, lambda x: x / greatest(sqrt({DOT}(h, h)), 1e-12))}}]) AS r, v FROM acts_t, dk_t)
    SELECT k AS kind, n_pos, n_neg, round(auroc, 6) AS auroc FROM ({area_sql(f"SELECT r.k AS k, label, round({DOT}(r.x, v) / sqrt({DOT}(v, v)), 9) AS value FROM s", "k")})""",
)
def e17(spark, d):
    a = acts(spark, d)
    dk = V.mean_diff(a)
    both = a.withColumn("kind", F.lit("raw")).unionByName(V.l2_normalised(a).withColumn("kind", F.lit("l2"))).crossJoin(F.broadcast(dk))
    s = both.select("kind", "label", F.round(V.project(F.col("h"), F.col("d")), 9).alias("value"))
    return M.auroc(s, ["kind"]).select("kind", "n_pos", "n_neg", r6("auroc").alias("auroc"))


N_LAYERS, DICTIONARY_LAYER, WIDTH = 40, 22, 16
SPACED = V.spaced_layers(N_LAYERS, also=DICTIONARY_LAYER)


@query(
    "e18_spaced_layers",
    f"""WITH l AS (SELECT DISTINCT unnest(list_concat([0, {N_LAYERS - 1}, {DICTIONARY_LAYER}], range(0, {N_LAYERS}, {max(1, N_LAYERS // 9)}))) AS layer),
    s AS (SELECT CAST(layer AS INTEGER) AS layer, label, round({DOT}(h[layer + 1:layer + {WIDTH}], v[layer + 1:layer + {WIDTH}]) / sqrt({DOT}(v[layer + 1:layer + {WIDTH}], v[layer + 1:layer + {WIDTH}])), 9) AS value FROM acts_t, dk_t, l)
    SELECT layer, round(auroc, 6) AS auroc, row_number() OVER (ORDER BY auroc DESC, layer) = 1 AS is_best FROM ({area_sql('SELECT layer, label, value FROM s', 'layer')})""",
)
def e18s(spark, d):
    """Direction AUROC of some of forty layers (windows of the vectors): first, last, every fourth and that of the dictionary."""
    a = acts(spark, d)
    cut = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.slice("h", n + 1, WIDTH).alias("h")) for n in SPACED])).alias("l")
    rows = a.select("doc_id", "label", cut).select("doc_id", "label", "l.layer", "l.h")
    scored = rows.join(F.broadcast(V.mean_diff(rows, ["layer"]).select("layer", "d")), "layer")  # a row for each layer
    area = M.auroc(scored.select("layer", "label", F.round(V.project(F.col("h"), F.col("d")), 9).alias("value")), ["layer"])
    best = area.agg(F.min_by("layer", F.struct(-F.col("auroc"), "layer")).alias("best"))  # one row
    return area.crossJoin(F.broadcast(best)).select("layer", r6("auroc").alias("auroc"), (F.col("layer") == F.col("best")).alias("is_best"))


@query("e18_layer_sweep", f"SELECT arg_max(layer, auroc) AS best_layer, round(max(auroc), 6) AS best_auroc, count(*) AS n_layers FROM ({area_sql('SELECT layer, label, value FROM lscore_t', 'layer')})")
def e18(spark, d):
    a = layers(spark, d)
    s = a.join(F.broadcast(V.mean_diff(a, ["layer"])), "layer").select("layer", "label", F.round(V.project(F.col("h"), F.col("d")), 9).alias("value"))
    return M.auroc(s, ["layer"]).agg(F.max_by("layer", "auroc").alias("best_layer"), r6(F.max("auroc")).alias("best_auroc"), F.count(F.lit(1)).alias("n_layers"))


@query(
    "e19_paired_shift",
    f"""WITH p AS (SELECT doc_id, h, list_transform(h, lambda x, i: x * (CASE WHEN i % 2 = 0 THEN 1.1::DOUBLE ELSE 0.9::DOUBLE END)) AS g FROM acts_t),
    s AS (SELECT {DOT}(h, g) / (sqrt({DOT}(h, h)) * sqrt({DOT}(g, g)) + 1e-12) AS c, ({DOT}(g, v) - {DOT}(h, v)) / sqrt({DOT}(v, v)) AS s FROM p, dk_t)
    SELECT count(*) AS n, round(avg(c), 6) AS mean_cosine, round(avg(s), 6) AS mean_shift, round(quantile_cont(s, 0.05), 6) AS p05, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.95), 6) AS p95 FROM s""",
)
def e19(spark, d):
    a = acts(spark, d)
    b = a.withColumn("h", F.transform("h", lambda x, i: x * F.when(i % 2 == 1, 1.1).otherwise(0.9)))
    s = V.paired_shift(a, b, V.mean_diff(a))
    q = F.percentile("shift", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return s.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("cosine")).alias("mean_cosine"), r6(F.avg("shift")).alias("mean_shift"), q.alias("q")).select(
        "n", "mean_cosine", "mean_shift", r6(F.col("q")[0]).alias("p05"), r6(F.col("q")[1]).alias("p50"), r6(F.col("q")[2]).alias("p95")
    )


def _random_sql(x: str) -> str:
    return f"""WITH g AS (SELECT feature_id, i, {x} AS x FROM (SELECT feature_id, unnest(range(64)) AS i FROM dict_t))
    SELECT feature_id, CAST(i AS INTEGER) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY feature_id)), 6) AS x FROM g"""


def _random_rows(spark, d, kind: str):
    """As many unit rows as the dictionary has features, of its dimension."""
    a, w = _dict(spark, d)
    out = D.random_dictionary(spark, len(w.ids), w.w.shape[1], 21, kind)
    return out.select("feature_id", F.posexplode("w").alias("i", "x")).select("feature_id", "i", r6("x").alias("x"))


@query("e20_random_dictionary", _random_sql(f"sqrt(-2 * ln(1 - {u('21', 'feature_id', 'i', '0')})) * cos(2 * pi() * {u('21', 'feature_id', 'i', '1')})"))
def e20(spark, d):
    return _random_rows(spark, d, "gaussian")


@query("e20_uniform_dictionary", _random_sql(f"2 * {u('21', 'feature_id', 'i', '0')} - 1"))
def e20u(spark, d):
    return _random_rows(spark, d, "uniform")


# -- ablation ---------------------------------------------------------------------------
CTE["ndoc_t"] = "SELECT count(*) AS n, sum(label) AS p FROM acts_t"
CTE["corr_t"] = "SELECT feature_id, CASE WHEN k >= 2 AND v > 0 THEN abs(c / sqrt(v)) ELSE 0 END AS r, k AS n_active FROM (SELECT feature_id, count(*) AS k, sum(z * label) - sum(z) * max(p) / max(n) AS c, (sum(z * z) - sum(z) * sum(z) / max(n)) * (max(p) - max(p) * max(p) / max(n)) AS v FROM codes_t, ndoc_t GROUP BY feature_id)"


def _counts(a):
    return a.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))


@query("i1_feature_label_corr", "SELECT feature_id, round(r, 6) AS r, n_active, CAST(row_number() OVER (ORDER BY round(r, 9) DESC, feature_id) AS INTEGER) AS place FROM corr_t")
def i1(spark, d):
    a, w = _dict(spark, d)
    return D.ranked(D.feature_label_corr(D.encode(a, w), _counts(a)), "r").select("feature_id", r6("r").alias("r"), "n_active", "place")


@query(
    "i2_rank_features",
    """WITH s AS (SELECT feature_id, coalesce(sum(z) FILTER (label = 1), 0) / max(p) AS a, coalesce(sum(z) FILTER (label = 0), 0) / (max(n) - max(p)) AS b FROM codes_t, ndoc_t GROUP BY feature_id)
    SELECT 'member' AS criterion, feature_id, round(a, 6) AS score FROM s UNION ALL SELECT 'diff', feature_id, round(abs(a - b), 6) FROM s""",
)
def i2(spark, d):
    a, w = _dict(spark, d)
    codes, n = D.encode(a, w), _counts(a)
    one = lambda c: D.rank_features(codes, n, c).select(F.lit(c).alias("criterion"), "feature_id", r6("score").alias("score"))
    return one("member").unionByName(one("diff"))


def _base(spark, d):
    a, w = _dict(spark, d)
    dk = V.mean_diff(a)
    parts = D.decompose(a, w).crossJoin(F.broadcast(dk.select("d")))
    base = parts.select("doc_id", "label", V.project(F.col("recon"), F.col("d")).alias("k_recon"), V.project(F.col("resid"), F.col("d")).alias("k_resid"))
    weights = dictionary(spark, d).crossJoin(F.broadcast(dk.select("d"))).select("feature_id", V.project(F.col("w"), F.col("d")).alias("c"))
    return a, D.encode(a, w), base, weights


def _areas(s, by):
    both = s.select(*by, "label", F.explode(F.array(*[F.struct(F.lit(n).alias("stream"), F.round(n, 9).alias("value")) for n in ("recon", "resid")])).alias("x")).select(*by, "label", "x.stream", "x.value")
    return M.auroc(both, [*by, "stream"])


CTE["base_t"] = f"SELECT doc_id, label, {DOT}(r, v) / sqrt({DOT}(v, v)) AS recon, {DOT}(e, v) / sqrt({DOT}(v, v)) AS resid FROM res_t, dk_t"
CTE["fw_t"] = f"SELECT feature_id, {DOT}(w, v) / sqrt({DOT}(v, v)) AS c FROM dict_t, dk_t"


def _ablate_sql(chosen: str, by: str) -> str:
    rows = f"""SELECT {by}, stream, label, round(CASE WHEN stream = 'recon' THEN recon - cut ELSE resid + cut END, 9) AS value FROM (
    SELECT g.*, b.label, b.recon, b.resid, coalesce(cut, 0) AS cut, stream FROM base_t b CROSS JOIN (SELECT DISTINCT {by} FROM chosen) g CROSS JOIN (SELECT unnest(['recon', 'resid']) AS stream)
    LEFT JOIN (SELECT {by}, doc_id, sum(z * c) AS cut FROM codes_t JOIN fw_t USING (feature_id) JOIN chosen USING (feature_id) GROUP BY ALL) USING ({by}, doc_id))"""
    return f"WITH chosen AS ({chosen}) SELECT {by}, stream, round(auroc, 6) AS auroc FROM ({area_sql(rows, f'{by}, stream')})"


@query(
    "i3_ablate_topk",
    _ablate_sql("SELECT k, feature_id FROM (SELECT feature_id, row_number() OVER (ORDER BY round(r, 9) DESC, feature_id) AS place FROM corr_t), (SELECT unnest([4, 16, 64, -1]) AS k) WHERE place <= k OR k = -1", "k"),
)
def i3(spark, d):
    a, codes, base, weights = _base(spark, d)
    places = D.ranked(D.feature_label_corr(codes, _counts(a)), "r")
    chosen = places.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (4, 16, 64, -1)]))).filter("place <= k OR k = -1").select("k", "feature_id")  # -1: all that are ever active
    return _areas(D.ablated_scores(codes, base, weights, chosen, ["k"]), ["k"]).select("k", "stream", r6("auroc").alias("auroc"))


RANDOM = f"SELECT seed, feature_id FROM (SELECT seed, feature_id, row_number() OVER (PARTITION BY seed ORDER BY {u('seed', 'feature_id')}, feature_id) AS place FROM (SELECT DISTINCT feature_id FROM codes_t), (SELECT unnest(range(10)) AS seed)) WHERE place <= 16"


def _random_areas(spark, d):
    from pyspark.sql import Window

    _, codes, base, weights = _base(spark, d)
    ever = codes.select("feature_id").distinct().withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(9))))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(u01(F.col("seed"), F.col("feature_id")), "feature_id"))
    chosen = ever.withColumn("place", place).filter("place <= 16").select("seed", "feature_id")
    return _areas(D.ablated_scores(codes, base, weights, chosen, ["seed"]), ["seed"])


@query("i4_ablate_random", _ablate_sql(RANDOM, "seed"))
def i4(spark, d):
    """Ten seeds of 16 features that are ever active."""
    return _random_areas(spark, d).select("seed", "stream", r6("auroc").alias("auroc"))


@query("i4_random_summary", f"SELECT stream, round(avg(auroc), 5) AS mean, round(stddev_samp(auroc), 5) AS std, count(*) AS n_seeds FROM ({_ablate_sql(RANDOM, 'seed')}) GROUP BY stream")
def i4s(spark, d):
    out = D.random_summary(_random_areas(spark, d).withColumn("auroc", r6("auroc")))
    return out.select("stream", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n_seeds")


@query(
    "i5_selection_grid",
    """WITH s AS (SELECT feature_id, coalesce(sum(z) FILTER (label = 1), 0) / max(p) AS a, coalesce(sum(z) FILTER (label = 0), 0) / (max(n) - max(p)) AS b FROM codes_t, ndoc_t GROUP BY feature_id),
    q AS (SELECT 'member' AS criterion, feature_id, a AS score FROM s UNION ALL SELECT 'diff', feature_id, abs(a - b) FROM s),
    r AS (SELECT criterion, feature_id, row_number() OVER (PARTITION BY criterion ORDER BY round(score, 9) DESC, feature_id) AS place FROM q),"""
    + _ablate_sql("SELECT criterion || '-' || k AS cell, feature_id FROM r, (SELECT unnest([8, 32]) AS k) WHERE place <= k", "cell").removeprefix("WITH"),
)
def i5(spark, d):
    a, codes, base, weights = _base(spark, d)
    cells = None
    for c in ("member", "diff"):
        p = D.ranked(D.rank_features(codes, _counts(a), c), "score").withColumn("k", F.explode(F.array(F.lit(8), F.lit(32)))).filter(F.col("place") <= F.col("k"))
        p = p.select(F.concat_ws("-", F.lit(c), "k").alias("cell"), "feature_id")
        cells = p if cells is None else cells.unionByName(p)
    return _areas(D.ablated_scores(codes, base, weights, cells, ["cell"]), ["cell"]).select("cell", "stream", r6("auroc").alias("auroc"))


@query("i5_selection_verdict")
def i5v(spark, d):
    """Each criterion at its depths: extraction drop, change of a probe on the codes, and the verdict at the deepest."""
    from corpuslens.operators import probes as P

    a, codes, base, weights = _base(spark, d)
    n = _counts(a)
    size = dictionary(spark, d).count()
    picks = {
        "member": D.rank_features(codes, n, "member"), "diff": D.rank_features(codes, n, "diff"),
        "corr": D.feature_label_corr(codes, n).withColumnRenamed("r", "score"), "probe": P.rank_by_probe(codes, a, size),
    }
    ranked = None
    for name, scores in picks.items():
        own = D.ranked(scores, "score").filter(F.col("place") <= 32).select(F.lit(name).alias("criterion"), "feature_id", "place")
        ranked = own if ranked is None else ranked.unionByName(own)
    grid = D.selection_grid(codes, base, weights, settled(ranked, "ranked"), [8, 32], lambda drops: {r["stream"]: r["auroc"] for r in M.auroc(P.code_probes(codes, size, drops, a), ["stream"]).collect()})
    return grid.select("criterion", "k", *[r6(c).alias(c) for c in ("recon_auroc", "extraction_drop", "probe_auroc", "probe_delta")], "passes_extraction", "preserves_probe", "verdict")


@query("i6_residual_pcs")
def i6(spark, d):
    """Principal directions of the residual: singular value, and share of variance up to it."""
    a, w = _dict(spark, d)
    rows = V.covariances(D.decompose(a, w).select(F.lit(0).alias("g"), "resid"), ["g"], "resid").orderBy("i").collect()  # d rows
    values = np.linalg.eigvalsh(np.array([r["row"] for r in rows]))[::-1]
    share = np.cumsum(values) / values.sum()
    return spark.createDataFrame([(i, round(float(np.sqrt(max(v, 0) * (a.count() - 1))), 5), round(float(s), 6)) for i, (v, s) in enumerate(zip(values, share, strict=True))], "comp int, singular double, captured double")


@query(
    "i7_ablate_subspace",
    f"SELECT doc_id, round(sqrt({DOT}(x, x)), 6) AS left_norm, round({DOT}(x, v), 6) + 0.0::DOUBLE AS along FROM (SELECT doc_id, v, list_transform(list_zip(h, v), lambda p: p[1] - {DOT}(h, v) / {DOT}(v, v) * p[2]) AS x FROM acts_t, dk_t)",
)
def i7(spark, d):
    """Vectors with their part along d_K taken out."""
    a = acts(spark, d)
    w = a.crossJoin(F.broadcast(V.mean_diff(a)))
    unit_d = scaled(F.col("d"), 1.0 / F.col("d_norm"))
    x = F.zip_with("h", scaled(unit_d, V.project(F.col("h"), F.col("d"))), lambda p, q: p - q)
    return w.withColumn("x", x).select("doc_id", r6(norm(F.col("x"))).alias("left_norm"), r6(F.aggregate(F.zip_with("x", "d", lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)).alias("along"))


# -- health -----------------------------------------------------------------------------
CTE["nt_t"] = "SELECT count(*) AS n FROM acts_t"
CTE["stats_f"] = """SELECT d.feature_id, coalesce(k, 0) AS fires, coalesce(k, 0) / CAST(n AS DOUBLE) AS freq, coalesce(t, 0) AS total, coalesce(q, 0) AS total_sq, coalesce(m, 0) AS largest, coalesce(t / k, 0) AS mean_active,
    coalesce(sqrt(greatest(q / k - (t / k) * (t / k), 0)), 0) AS std_active FROM dict_t d CROSS JOIN nt_t LEFT JOIN (SELECT feature_id, count(*) AS k, sum(z) AS t, sum(z * z) AS q, max(z) AS m FROM codes_t GROUP BY feature_id) USING (feature_id)"""


def _stats(spark, d):
    a, w = _dict(spark, d)
    n = a.agg(F.count(F.lit(1)).alias("n"))
    return a, w, n, D.feature_stats(D.encode(a, w), dictionary(spark, d), n)


@query("j1_feature_stats", "SELECT feature_id, fires, round(freq, 6) AS freq, round(total, 6) AS total, round(total_sq, 6) AS total_sq, round(largest, 6) AS largest, round(mean_active, 6) AS mean_active, round(std_active, 6) AS std_active FROM stats_f")
def j1(spark, d):
    s = _stats(spark, d)[3]
    return s.select("feature_id", "fires", *[r6(c).alias(c) for c in s.columns[2:]])


@query(
    "j2_health_summary",
    """WITH c AS (SELECT count(*) AS n_features, count(*) FILTER (freq = 0) AS dead, count(*) FILTER (freq > 0 AND freq < 1e-4) AS rare, count(*) FILTER (freq > 0) AS alive, count(*) FILTER (freq >= 1e-3) AS healthy,
    count(*) FILTER (freq > 0.5) AS always_on, count(*) FILTER (freq >= 1e-5) AS at_least_1e5, count(*) FILTER (freq >= 1e-4) AS at_least_1e4, count(*) FILTER (freq >= 1e-3) AS at_least_1e3, count(*) FILTER (freq >= 1e-2) AS at_least_1e2 FROM stats_f)
    SELECT *, CASE WHEN dead / n_features > 0.5 THEN 'COLLAPSED' WHEN dead / n_features > 0.3 THEN 'MANY_DEAD' ELSE 'ACCEPTABLE' END AS verdict FROM c""",
)
def j2(spark, d):
    return D.health_summary(_stats(spark, d)[3])


@query("j3_freq_histogram", "SELECT CASE WHEN freq = 0 THEN 0 WHEN freq < 1e-6 THEN 1 WHEN freq < 1e-5 THEN 2 WHEN freq < 1e-4 THEN 3 WHEN freq < 1e-3 THEN 4 WHEN freq < 1e-2 THEN 5 WHEN freq < 1e-1 THEN 6 ELSE 7 END AS bin, count(*) AS n FROM stats_f GROUP BY 1")
def j3(spark, d):
    return D.freq_histogram(_stats(spark, d)[3])


@query("j4_l0_by_threshold", "SELECT round(count(*) FILTER (z > 0) / max(n), 6) AS l0_0, round(count(*) FILTER (z > 1e-3) / max(n), 6) AS l0_1, round(count(*) FILTER (z > 1e-2) / max(n), 6) AS l0_2 FROM codes_t, nt_t")
def j4(spark, d):
    a, w, n, _ = _stats(spark, d)
    out = D.l0_by_threshold(D.encode(a, w), n)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("j5_top_firing", "SELECT feature_id, round(freq, 6) AS freq FROM stats_f ORDER BY stats_f.freq DESC, feature_id LIMIT 6")
def j5(spark, d):
    _, w, _, s = _stats(spark, d)
    return D.top_firing(s, len(w.ids), 0.05).select("feature_id", r6("freq").alias("freq"))


@query("j6_alive_features", f"WITH w AS (SELECT feature_id, sqrt({DOT}(w, w)) AS m FROM dict_t) SELECT feature_id, (m >= 0.1 * (SELECT median(m) FROM w) AND freq >= 1e-5) AS alive FROM w JOIN stats_f USING (feature_id)")
def j6(spark, d):
    return D.alive_features(dictionary(spark, d), _stats(spark, d)[3])


def _token_codes(spark, d):
    """Vectors as tokens: 20 to a document."""
    a, w = _dict(spark, d)
    codes = D.encode(a, w)
    return codes.select(F.floor(F.col("doc_id") / 20).alias("doc_id"), (F.col("doc_id") % 20).cast("int").alias("pos"), "feature_id", F.round("z", 9).alias("z"))


CTE["tcodes_t"] = "SELECT doc_id // 20 AS doc_id, CAST(doc_id % 20 AS INTEGER) AS pos, feature_id, round(z, 9) AS z FROM codes_t"
TOP = """SELECT feature_id, CAST(rank AS INTEGER) AS rank, doc_id, pos, round(z, 6) AS activation FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY z DESC, doc_id) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY feature_id, doc_id ORDER BY z DESC, pos) AS r FROM tcodes_t) WHERE r = 1) WHERE rank <= 5"""


CTE["word_t"] = "SELECT vec_id // 20 AS doc_id, CAST(vec_id % 20 AS INTEGER) AS pos, 'w' || label AS token FROM embeddings"


@query("j7_top_contexts", f"SELECT feature_id, rank, doc_id, t.pos, activation, string_agg(token, ' ' ORDER BY w.pos) AS \"window\" FROM ({TOP}) t JOIN word_t w USING (doc_id) WHERE w.pos BETWEEN t.pos - 3 AND t.pos + 3 GROUP BY feature_id, rank, doc_id, t.pos, activation")
def j7(spark, d):
    """With the tokens (here named by the vector's label) three places round the maximum."""
    top = D.top_contexts(_token_codes(spark, d), 5).select("feature_id", "rank", "doc_id", "pos", r6("activation").alias("activation"))
    words = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("doc_id"), (F.col("vec_id") % 20).cast("int").alias("pos"), F.concat(F.lit("w"), F.col("label")).alias("token"))
    return D.with_windows(top, words, 3)


@query("j8_usage_balance", "SELECT round(avg((freq - 0.05) * (freq - 0.05)), 6) AS usage_balance, round(avg(freq), 6) AS mean_rate FROM stats_f")
def j8(spark, d):
    out = D.usage_balance(_stats(spark, d)[3], 0.05)
    return out.select(r6("usage_balance").alias("usage_balance"), r6("mean_rate").alias("mean_rate"))
