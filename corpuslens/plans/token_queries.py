"""Queries of token-level scores, over a unigram model of the documents' words.

A word's log-probability is ln(count / total) in a model fitted on a stated set of
documents: all of them ("orig", and "lower" for lower-cased words), English ones ("ref"),
label 0 ("prefix_non") and label 1 ("prefix_mem"), the last three with add-one counts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.draws import r6, words_of
from corpuslens.operators import metrics as M
from corpuslens.operators import tokenscores as T
from corpuslens.operators import unigrams as U
from corpuslens.operators.textfeat import zlib_len
from corpuslens.plans.base import CTE, pool, query, table, u


def token_lp(spark, d, conds=("orig",)):
    """doc_id, cond, pos, logp for the asked conditions."""
    words = U.words_in(table(spark, d, "documents"))
    out = None
    for cond in conds:
        own = words.withColumn("token", F.lower("token")) if cond == "lower" else words
        if cond == "ref":
            fit = U.words_in(table(spark, d, "documents").filter("lang = 'en'"))
        elif cond.startswith("prefix"):
            fit = U.words_in(pool(spark, d).filter(F.col("label") == (0 if cond == "prefix_non" else 1)))
        else:
            fit = own
        part = U.scored(own.select("doc_id", "pos", "token"), U.unigram(fit, cond not in ("orig", "lower"))).select("doc_id", F.lit(cond).alias("cond"), "pos", "logp")
        out = part if out is None else out.unionByName(part)
    return out


def with_stats(spark, d, lp):
    """Add mu and sigma of ln p over the vocabulary, weighted by p."""
    model = U.unigram(U.words_in(table(spark, d, "documents")))
    p = F.exp("logp")
    s = model.agg(F.sum(p * F.col("logp")).alias("mu"), F.sum(p * F.col("logp") * F.col("logp")).alias("m2"))
    s = s.select("mu", F.sqrt(F.col("m2") - F.col("mu") * F.col("mu")).alias("sigma"))
    return lp.crossJoin(F.broadcast(s))


def _model(words: str, smooth: bool = False) -> str:
    add, base = (1, "(total + kinds)") if smooth else (0, "total")
    return f"SELECT token, ln((c + {add}) / CAST({base} AS DOUBLE)) AS logp FROM (SELECT token, count(*) AS c FROM {words} GROUP BY token), (SELECT count(*) AS total, count(DISTINCT token) AS kinds FROM {words})"


def _floor(words: str) -> str:
    return f"(SELECT ln(1.0 / (count(*) + count(DISTINCT token))) FROM {words})"


CTE["lower_t"] = "SELECT doc_id, pos, lower(token) AS token FROM tokens_t"
CTE["en_t"] = "SELECT token FROM tokens_t SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') USING (doc_id)"
CTE["non_t"] = "SELECT token FROM tokens_t SEMI JOIN (SELECT doc_id FROM pool_t WHERE label = 0) USING (doc_id)"
CTE["mem_t"] = "SELECT token FROM tokens_t SEMI JOIN (SELECT doc_id FROM pool_t WHERE label = 1) USING (doc_id)"
for _n, _w, _s in (("orig", "tokens_t", False), ("lower", "lower_t", False), ("ref", "en_t", True), ("non", "non_t", True), ("mem", "mem_t", True)):
    CTE[f"m_{_n}"] = _model(_w, _s)
CTE["lp_orig"] = "SELECT doc_id, 'orig' AS cond, pos, logp FROM tokens_t JOIN m_orig USING (token)"
CTE["lp_lower"] = "SELECT doc_id, 'lower' AS cond, pos, logp FROM lower_t JOIN m_lower USING (token)"
CTE["lp_ref"] = f"SELECT doc_id, 'ref' AS cond, pos, coalesce(logp, {_floor('en_t')}) AS logp FROM tokens_t LEFT JOIN m_ref USING (token)"
CTE["lp_non"] = f"SELECT doc_id, 'prefix_non' AS cond, pos, coalesce(logp, {_floor('non_t')}) AS logp FROM tokens_t LEFT JOIN m_non USING (token)"
CTE["lp_mem"] = f"SELECT doc_id, 'prefix_mem' AS cond, pos, coalesce(logp, {_floor('mem_t')}) AS logp FROM tokens_t LEFT JOIN m_mem USING (token)"
CTE["stats_t"] = "SELECT mu, sqrt(m2 - mu * mu) AS sigma FROM (SELECT sum(exp(logp) * logp) AS mu, sum(exp(logp) * logp * logp) AS m2 FROM m_orig)"
CTE["ctx_t"] = "SELECT doc_id, pos, token, coalesce(lag(token) OVER (PARTITION BY doc_id ORDER BY pos), '') AS prev FROM tokens_t"
CTE["bi_t"] = "SELECT prev, token, ln(c / CAST(sum(c) OVER (PARTITION BY prev) AS DOUBLE)) AS logp FROM (SELECT prev, token, count(*) AS c FROM ctx_t GROUP BY ALL)"


@query("d1_loss", "SELECT doc_id, round(avg(logp), 6) AS loss_score, count(*) AS n_tokens FROM lp_orig GROUP BY doc_id")
def d1(spark, d):
    return T.mean_logp(token_lp(spark, d)).select("doc_id", r6("loss_score").alias("loss_score"), "n_tokens")


@query("d2_zlib")
def d2(spark, d):
    z = table(spark, d, "documents").select("doc_id", F.greatest(zlib_len("text"), F.lit(1)).alias("z"))
    return T.mean_logp(token_lp(spark, d)).join(z, "doc_id").select("doc_id", r6(F.col("loss_score") / F.col("z")).alias("zlib_score"))


def _low(name: str, k: str) -> str:
    return f"round(list_sum(list_sort({name})[1:greatest(1, CAST(floor({k}::DOUBLE * len({name})) AS INTEGER))]) / greatest(1, floor({k}::DOUBLE * len({name}))), 6)"


@query("d3_min_k", f"SELECT doc_id, {_low('lp', '0.1')} AS min_k_10, {_low('lp', '0.2')} AS min_k_20 FROM (SELECT doc_id, list(logp) AS lp FROM lp_orig GROUP BY doc_id)")
def d3(spark, d):
    return T.min_k(token_lp(spark, d)).select("doc_id", r6("min_k_10").alias("min_k_10"), r6("min_k_20").alias("min_k_20"))


@query("d4_min_k_pp", f"SELECT doc_id, {_low('z', '0.2')} AS min_k_pp_20 FROM (SELECT doc_id, list((logp - mu) / (sigma + 1e-8)) AS z FROM lp_orig, stats_t GROUP BY doc_id)")
def d4(spark, d):
    return T.min_k_pp(with_stats(spark, d, token_lp(spark, d))).select("doc_id", r6("min_k_pp_20").alias("min_k_pp_20"))


@query(
    "d5_position_stats",
    """WITH s AS (SELECT prev, avg(logp) AS mu, stddev_samp(logp) AS sigma, sum(exp(logp) * logp) AS mu_w,
    sqrt(greatest(sum(exp(logp) * logp * logp) - sum(exp(logp) * logp) * sum(exp(logp) * logp), 0) + 1e-12) AS sigma_w FROM bi_t GROUP BY prev)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(mu_w, 6) AS mu_w, round(sigma_w, 5) AS sigma_w FROM ctx_t JOIN s USING (prev)""",
)
def d5(spark, d):
    """Every place of every document."""
    places = U.words_in(table(spark, d, "documents"))
    v = U.bigram(places)
    w = T.position_stats(v, True, ["prev"]).withColumnsRenamed({"mu": "mu_w", "sigma": "sigma_w"})
    own = T.position_stats(v, False, ["prev"]).join(w, "prev")
    return U.at_places(places, own, v).select("doc_id", F.col("pos").cast("int").alias("pos"), r6("mu").alias("mu"), r6("sigma").alias("sigma"), r6("mu_w").alias("mu_w"), (F.round("sigma_w", 5) + F.lit(0.0)).alias("sigma_w"))


def _wide(*conds: str) -> str:
    return " JOIN ".join(f"(SELECT doc_id, avg(logp) AS ll_{c}, count(*) AS n_{c} FROM lp_{c} GROUP BY doc_id) {'' if i == 0 else 'USING (doc_id)'}" for i, c in enumerate(conds))


@query("d6_lowercase", f"SELECT doc_id, round(ll_lower / least(ll_orig, -1e-8), 6) AS score FROM {_wide('orig', 'lower')}")
def d6(spark, d):
    w = T.by_condition(token_lp(spark, d, ("orig", "lower")), ["orig", "lower"])
    return w.select("doc_id", r6(T.lowercase_ratio(w)).alias("score"))


@query("d7_reference", f"SELECT doc_id, round(ll_orig - ll_ref, 6) AS score FROM {_wide('orig', 'ref')}")
def d7(spark, d):
    w = T.by_condition(token_lp(spark, d, ("orig", "ref")), ["orig", "ref"])
    return w.select("doc_id", r6(T.reference_difference(w)).alias("score"))


@query(
    "d8_neighbour",
    f"""WITH nb AS (SELECT doc_id, nb, token, count(*) OVER (PARTITION BY doc_id, nb) AS k FROM (SELECT doc_id, unnest([0, 1]) AS nb, pos, token FROM tokens_t) WHERE {u('13', 'doc_id', 'nb', 'pos')} > 0.3),
    whole AS (SELECT doc_id, nb, token FROM (SELECT doc_id, unnest([0, 1]) AS nb, token FROM tokens_t) ANTI JOIN nb USING (doc_id, nb) UNION ALL SELECT doc_id, nb, token FROM nb),
    each AS (SELECT doc_id, nb, avg(logp) AS lp FROM whole JOIN m_orig USING (token) GROUP BY ALL)
    SELECT doc_id, round(own - near, 6) AS neighbour_score FROM (SELECT doc_id, avg(logp) AS own FROM lp_orig GROUP BY doc_id) JOIN (SELECT doc_id, avg(lp) AS near FROM each GROUP BY doc_id) USING (doc_id)""",
)
def d8(spark, d):
    words = U.words_in(table(spark, d, "documents")).drop("prev")
    return T.neighbour_score(U.scored(words, U.unigram(words), U.WIDE), 2, 0.3, 13).select("doc_id", r6("neighbour_score").alias("neighbour_score"))


@query(
    "d9_conditional",
    f"SELECT doc_id, round(CASE WHEN n_orig < 10 OR abs(ll_orig) < 1e-10 THEN 0 ELSE ll_non / ll_orig END, 6) AS score FROM {_wide('orig', 'non')}",
)
def d9(spark, d):
    w = T.by_condition(token_lp(spark, d, ("orig", "prefix_non")), ["orig", "prefix_non"])
    return w.select("doc_id", r6(T.conditional_ratio(w)).alias("score"))


@query(
    "d10_contrastive",
    f"SELECT doc_id, gamma, round(CASE WHEN n_orig < 10 OR abs(ll_orig) < 1e-10 THEN 0 ELSE (ll_non - gamma * ll_mem) / ll_orig END, 6) AS score FROM {_wide('orig', 'non', 'mem')}, (SELECT unnest([0.25::DOUBLE, 0.5, 1.0]) AS gamma)",
)
def d10(spark, d):
    w = T.by_condition(token_lp(spark, d, ("orig", "prefix_non", "prefix_mem")), ["orig", "prefix_non", "prefix_mem"])
    g = w.withColumn("gamma", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0))))
    return g.select("doc_id", "gamma", r6(T.contrastive_ratio(g, F.col("gamma"))).alias("score"))


@query(
    "d11_perplexity",
    """WITH b AS (SELECT lang, exp(-sum(logp) / count(*)) AS ppl, count(*) AS n_tokens FROM lp_orig JOIN documents USING (doc_id) GROUP BY lang),
    r AS (SELECT lang, exp(-sum(logp) / count(*)) AS ppl FROM lp_ref JOIN documents USING (doc_id) GROUP BY lang)
    SELECT lang, round(b.ppl, 6) AS ppl, round(r.ppl, 6) AS ppl_ref, round(r.ppl - b.ppl, 6) AS delta, n_tokens FROM b JOIN r USING (lang)""",
)
def d11(spark, d):
    lang = table(spark, d, "documents").select("doc_id", "lang")
    lp = token_lp(spark, d, ("orig", "ref")).join(lang, "doc_id")
    b = T.perplexity(lp.filter("cond = 'orig'"), ["lang"])
    r = T.perplexity(lp.filter("cond = 'ref'"), ["lang"]).select("lang", F.col("ppl").alias("ppl_ref"))
    return b.join(r, "lang").select("lang", r6("ppl").alias("ppl"), r6("ppl_ref").alias("ppl_ref"), r6(F.col("ppl_ref") - F.col("ppl")).alias("delta"), "n_tokens")


@query(
    "d11_best_by_ppl",
    """WITH r AS (SELECT lang, source AS key, exp(-sum(logp) / count(*)) AS ppl FROM lp_orig JOIN documents USING (doc_id) GROUP BY ALL),
    b AS (SELECT lang, exp(-sum(logp) / count(*)) AS base FROM lp_orig JOIN documents USING (doc_id) GROUP BY lang)
    SELECT lang, arg_min(key, abs(ppl - base)) AS key, round(min(abs(ppl - base)), 6) AS delta FROM r JOIN b USING (lang) GROUP BY lang""",
)
def d11b(spark, d):
    meta = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("key"))
    lp = token_lp(spark, d).join(meta, "doc_id")
    runs = T.perplexity(lp, ["lang", "key"]).join(T.perplexity(lp, ["lang"]).select("lang", F.col("ppl").alias("base")), "lang")
    return T.best_by_ppl(runs.withColumn("delta", F.col("ppl") - F.col("base")), ["lang"]).select("lang", "key", r6("delta").alias("delta"))


@query("d12_rouge_l")
def d12(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", words_of(F.col("text")).alias("w"))
    gold = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("gold"))
    return T.rouge_l(turns.withColumnRenamed("w", "pred").join(gold, ["conv_id", "turn"])).select("conv_id", "turn", "n", "lcs", r6("rouge_l").alias("rouge_l"), "exact")


_LONG = "SELECT cond, doc_id, probe, value FROM (SELECT cond, doc_id, unnest(['loss', 'min_k_20']) AS probe, unnest([avg(logp), list_avg(list_sort(list(logp))[1:greatest(1, CAST(floor(0.2 * count(*)) AS BIGINT))])]) AS value FROM (SELECT * FROM lp_orig UNION ALL SELECT * FROM lp_lower UNION ALL SELECT * FROM lp_ref) GROUP BY cond, doc_id)"


@query(
    "d13_probe_by_condition",
    f"""WITH s AS ({_LONG}),
    g AS (SELECT cond, probe, round(value, 9) AS value, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM s JOIN pool_t USING (doc_id) GROUP BY ALL),
    c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cond, probe ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
    a AS (SELECT cond, probe, sum(p * (2 * below + n)) / (2.0 * sum(p) * sum(n)) AS auroc FROM c GROUP BY cond, probe)
    SELECT probe, round(o, 6) AS auroc_orig, round(l, 6) AS auroc_lower, round(r, 6) AS auroc_ref, round(o - l, 6) AS drop, round((r - l) / nullif(o - l, 0), 6) AS recovery, (o - l > 0.05 AND r > 0.55) AS replicates
    FROM (SELECT probe, max(auroc) FILTER (cond = 'orig') AS o, max(auroc) FILTER (cond = 'lower') AS l, max(auroc) FILTER (cond = 'ref') AS r FROM a GROUP BY probe)""",
)
def d13(spark, d):
    """Loss and min-k by condition; drop from the first to the second, and the share of it the third recovers."""
    docs = table(spark, d, "documents")
    model = U.conditions(docs)  # of all texts; only those with a label have a place in the table
    words = U.words_in(U.of_ids(docs, table(spark, d, "labels"))).select("doc_id", "token")
    wide = U.by_frequency(words, model, "token", "c", share=U.WIDE)
    return _probe_table(T.probe_scores(wide, ["orig", "lower", "ref"]), pool(spark, d))


@query("d13_zlib_probe")
def d13z(spark, d):
    """The same with the loss over the text's compressed size; compression has no SQL form."""
    size = table(spark, d, "documents").select("doc_id", F.greatest(zlib_len("text"), F.lit(1)).alias("z"))
    s = T.mean_logp(token_lp(spark, d, ("orig", "lower", "ref")), ("cond", "doc_id")).join(size, "doc_id")
    return _probe_table(s.select("cond", "doc_id", F.lit("zlib").alias("probe"), (F.col("loss_score") / F.col("z")).alias("value")), pool(spark, d))


def _probe_table(scores, labels):
    s = scores.join(labels.select("doc_id", "label"), "doc_id").withColumn("value", F.round("value", 9))
    w = M.auroc(s, ["cond", "probe"]).groupBy("probe").pivot("cond", ["orig", "lower", "ref"]).agg(F.max("auroc"))
    drop = F.col("orig") - F.col("lower")
    recovery = (F.col("ref") - F.col("lower")) / F.nullif(drop, F.lit(0.0))
    return w.select(
        "probe", r6("orig").alias("auroc_orig"), r6("lower").alias("auroc_lower"), r6("ref").alias("auroc_ref"), r6(drop).alias("drop"), r6(recovery).alias("recovery"), ((drop > 0.05) & (F.col("ref") > 0.55)).alias("replicates")
    )


@query(
    "d14_greedy_tokens",
    "WITH g AS (SELECT prev, first(token ORDER BY round(logp, 9) DESC, token) AS best FROM bi_t GROUP BY prev) SELECT doc_id, CAST(pos AS INTEGER) AS pos, best AS token FROM ctx_t JOIN g USING (prev)",
)
def d14(spark, d):
    """The likeliest word at every place of every document."""
    places = U.words_in(table(spark, d, "documents"))
    model = U.bigram(places)
    return U.at_places(places.drop("token"), T.greedy_tokens(model, ["prev"]), model).select("doc_id", F.col("pos").cast("int").alias("pos"), "token")
