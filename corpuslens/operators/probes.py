"""Out-of-fold classifiers: probes on vectors and codes, and confound checks on texts.

Probes on vectors and codes are fitted together by ``irls``; other fits are Spark ML on a
DataFrame.  Feature steps are fitted on the training folds only.
"""

from __future__ import annotations

import hashlib
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.draws import terms_of, u01, words_of
from corpuslens.functions.vectors import dot
from corpuslens.operators import irls
from corpuslens.operators import metrics as M
from corpuslens.operators import resample as R
from corpuslens.operators import vectors as V
from corpuslens.operators.corpus import stratified_folds
from corpuslens.operators.ordered import earliest, numbered
from corpuslens.operators.textfeat import grams, ngram_counts, tfidf, vocabulary
from corpuslens.operators.unigrams import SENT
from corpuslens.sources.scratch import settled


def logistic(features: str, c: float = 1.0, n: int = 1000) -> LogisticRegression:
    """Ridge-regularised logistic regression; c is the inverse strength for n rows."""
    return LogisticRegression(featuresCol=features, labelCol="label", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=50)


def scaled_logistic(c: float = 1.0, n: int = 1000) -> list:
    return [StandardScaler(inputCol="features", outputCol="scaled", withMean=True), logistic("scaled", c, n)]


def scores_of(model, test: DataFrame, keep: list[str]) -> DataFrame:
    """keep, value: the fitted model's score for class 1."""
    column = "rawPrediction" if "rawPrediction" in model.transform(test.limit(0)).columns else "probability"
    return model.transform(test).select(*keep, F.round(vector_to_array(column)[1], 9).alias("value"))


def out_of_fold(df: DataFrame, stages: list, k: int, seed: int) -> DataFrame:
    """doc_id, label, fold, value: each row scored by the model fitted on the other folds.

    The folds' fits are independent jobs, started side by side."""
    return scored_folds(settled(stratified_folds(df, "label", k, seed), "folds"), [[s.copy() for s in stages] for _ in range(k)])


def scored_folds(dealt: DataFrame, stages: list[list]) -> DataFrame:
    """The same of settled rows with their fold, and with the stages of each fold."""
    k = len(stages)

    @inheritable_thread_target(dealt.sparkSession)
    def fit(fold: int):
        return Pipeline(stages=stages[fold]).fit(dealt.filter(F.col("fold") != fold))

    with ThreadPool(k) as pool:
        models = pool.map(fit, range(k))
    out = None
    for fold, model in enumerate(models):
        part = scores_of(model, dealt.filter(F.col("fold") == fold), ["doc_id", "label", "fold"])
        out = part if out is None else out.unionByName(part)
    return out


LEVELS = (("SEVERE", 0.90), ("MODERATE", 0.70), ("MILD", 0.55))


def confound_level(area):
    level = F.when(area >= LEVELS[0][1], LEVELS[0][0])
    for name, least in LEVELS[1:]:
        level = level.when(area >= least, name)
    return level.otherwise("NEGLIGIBLE")


def summary(scores: DataFrame) -> DataFrame:
    """Pooled AUROC and low-rate TPR, fold mean and population std, and the confound level."""
    scores = settled(scores, "scores")  # models run once
    pooled = M.metric_card(scores.select("label", "value"))
    folds = M.auroc(scores, ["fold"]).agg(F.avg("auroc").alias("fold_mean"), F.stddev_pop("auroc").alias("fold_std"), F.count(F.lit(1)).alias("n_folds"))
    return pooled.crossJoin(folds).withColumn("level", confound_level(F.col("auroc_bi")))


def text_terms(pool: DataFrame, n: int = 2) -> DataFrame:
    return pool.select("doc_id", "label", grams(terms_of(F.col("text")), n).alias("terms"))


def fold_vocabularies(rows: DataFrame, k: int, vocab: int, min_df: float) -> list[dict[str, int]]:
    """For each fold, the terms of the other folds' texts (fold, terms) with the number of these texts: terms of at least ``min_df`` texts, the most frequent ``vocab``, ties by term.

    Terms are counted once by fold; a fold's own counts are taken from the whole."""
    n_docs = dict(rows.groupBy("fold").count().collect())  # one row a fold
    least = [min_df if min_df >= 1 else min_df * (sum(n_docs.values()) - n_docs.get(f, 0)) for f in range(k)]
    row = lambda total, df: lambda t: F.struct(t.alias("gram"), F.lit(total).alias("total"), F.lit(df).alias("df"))
    each = F.concat(F.transform("terms", row(1, 0)), F.transform(F.array_distinct("terms"), row(0, 1)))
    flat = rows.select("fold", F.explode(each).alias("t")).select("fold", "t.*")
    of = lambda c, f: F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}_{f}")
    counts = flat.groupBy("gram").agg(*[of(c, f) for f in range(k) for c in ("total", "df")])
    counts = settled(counts.filter(F.greatest(*[F.col(f"df_{f}") - F.lit(least[f]) for f in range(k)], F.lit(-1.0)) >= 0), "term-counts")
    top = None
    for f in range(k):
        own = counts.select(F.lit(f).alias("fold"), "gram", F.col(f"total_{f}").alias("total"), F.col(f"df_{f}").alias("df")).filter(F.col("df") >= least[f])
        own = earliest(own, [F.desc("total"), "gram"], vocab)
        top = own if top is None else top.unionByName(own)
    out: list[dict[str, int]] = [{} for _ in range(k)]
    for r in settled(top, "vocabularies").select("fold", "gram", "df").collect():  # at most `vocab` rows a fold
        out[r["fold"]][r["gram"]] = r["df"]
    return out


def bow_audit(pool: DataFrame, k: int = 5, seed: int = 0, tfidf: bool = True, vocab: int = 50_000, min_df: float = 2.0) -> DataFrame:
    """Vocabulary confound: can words tell the labels apart?  The vocabulary is the training folds' own.

    Texts become counts of the terms of any fold's vocabulary once; a fold's weights, ln((1 + N) / (1 + df)) + 1,
    are zero for terms that are not in its own."""
    folds = settled(stratified_folds(pool.select("doc_id", "label").distinct(), "label", k, seed), "folds")
    few = folds.limit(SENT + 1).count() <= SENT  # as many as there are labelled texts
    rows = text_terms(pool).join(F.broadcast(folds) if few else folds, ["doc_id", "label"])
    words = fold_vocabularies(rows, k, vocab, min_df)
    union = sorted(set().union(*words))
    n_docs = dict(rows.groupBy("fold").count().collect())  # one row a fold
    counts = CountVectorizerModel.from_vocabulary(union, "terms", "counts").transform(rows)
    dealt = settled(counts.select("doc_id", "label", "fold", "counts"), "counts")
    stages = []
    for f in range(k):
        n = sum(n_docs.values()) - n_docs.get(f, 0)
        weights = DenseVector([(np.log((n + 1) / (words[f][w] + 1)) + 1 if tfidf else 1.0) if w in words[f] else 0.0 for w in union])
        scaled = ElementwiseProduct(inputCol="counts", outputCol="weighted", scalingVec=weights)
        stages.append([scaled, Normalizer(inputCol="weighted", outputCol="features"), logistic("features")] if tfidf else [scaled, logistic("weighted")])
    return summary(scored_folds(dealt, stages))


def length_features_vector(pool: DataFrame, feature: str) -> DataFrame:
    size = F.length("text") if feature == "chars" else F.size(words_of(F.col("text")))
    return pool.select("doc_id", "label", array_to_vector(F.array(size.cast("double"))).alias("features"))


def length_audit(pool: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """Length confound: a classifier on each length alone (feature: chars, words), and the worst level as headline."""
    out = None
    for feature in ("chars", "words"):
        row = summary(out_of_fold(length_features_vector(pool, feature), scaled_logistic(), k, seed)).withColumn("feature", F.lit(feature))
        out = row if out is None else out.unionByName(row)
    worst = out.agg(F.max("auroc_bi").alias("worst")).select(confound_level(F.col("worst")).alias("headline"))
    return out.crossJoin(F.broadcast(worst))


def train_test(train: DataFrame, test: DataFrame, stages: list) -> DataFrame:
    """AUROC on the test rows of a model fitted on the training rows."""
    train, test = settled(train, "train"), settled(test, "test")
    return M.oriented(M.auroc(scores_of(Pipeline(stages=stages).fit(train), test, ["doc_id", "label"])))


def bow_forest(train: DataFrame, test: DataFrame, trees: int = 500, depth: int = 2, seed: int = 0) -> DataFrame:
    stages = [
        CountVectorizer(inputCol="terms", outputCol="features", minDF=0.05),
        RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=10, seed=seed),
    ]
    return train_test(text_terms(train, 1), text_terms(test, 1), stages)


def tfidf_logistic(train: DataFrame, test: DataFrame, min_df: float = 0.02) -> DataFrame:
    """AUROC on the test texts of a logistic fit on sublinear TF-IDF of the training texts' vocabulary.

    Weights are made from tables of grams, before they become vectors."""
    own, other = (settled(ngram_counts(x), "grams") for x in (train, test))
    n = train.count()
    words = vocabulary(own, min_df, n_docs=n)
    places = settled(numbered(words, ["gram"], "at"), "vocabulary")
    size = max(1, places.count())
    docs = train.sparkSession.createDataFrame([(n,)], "n long")

    def vectors(counts: DataFrame, texts: DataFrame) -> DataFrame:
        w = tfidf(counts, places, docs, sublinear=True).join(F.broadcast(places.select("gram", "at")), "gram")  # grams in one text of fifty at least
        held = w.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("at").cast("int"), "w"))).alias("m"))
        rows = texts.select("doc_id", "label").join(held, "doc_id", "left")
        x = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
        return rows.select("doc_id", "label", array_to_vector(x).alias("features"))

    return train_test(vectors(own, train), vectors(other, test), [logistic("features")])


def vectors_of(acts: DataFrame, column: str = "h") -> DataFrame:
    return acts.select("doc_id", "label", array_to_vector(F.col(column)).alias("features"))


def stream_rows(streams: dict[str, DataFrame], k: int, seeds: list[int]) -> DataFrame:
    """Settled rows of named streams (doc_id, label, h each) with their folds, for irls."""
    out = None
    for name, own in streams.items():
        part = own.select(F.lit(name).alias("stream"), "doc_id", "label", "h")
        out = part if out is None else out.unionByName(part)
    first = next(iter(streams.values())).select("doc_id", "label")
    folds = irls.with_folds(first, k, seeds).select("doc_id", "folds")
    return settled(out.join(folds, "doc_id"), "probe-rows")


def linear_scores(acts: DataFrame, k: int = 5, seed: int = 0, column: str = "h", standardised: bool = True) -> DataFrame:
    """doc_id, label, fold, value of every row by the probe fitted on the other folds."""
    rows = stream_rows({column: acts.select("doc_id", "label", F.col(column).alias("h"))}, k, [seed])
    return irls.out_of_fold(rows, [seed], irls.fit(rows, [seed], list(range(k)), standardised=standardised)).select("doc_id", "label", "fold", "value")


def linear_probe(acts: DataFrame, k: int = 5, seed: int = 0, column: str = "h", standardised: bool = True) -> DataFrame:
    return summary(linear_scores(acts, k, seed, column, standardised))


def mlp_scores(acts: DataFrame, dim: int, hidden: int = 256, k: int = 5, seed: int = 0) -> DataFrame:
    net = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label", layers=[dim, hidden, 2], maxIter=50, seed=seed)
    return out_of_fold(vectors_of(acts), [StandardScaler(inputCol="features", outputCol="scaled", withMean=True), net], k, seed)


def mlp_against_linear(acts: DataFrame, dim: int, hidden: int = 256, k: int = 5, seed: int = 0, replicates: int = 1000) -> DataFrame:
    """probe (mlp, linear): pooled out-of-fold AUROC and rates, the AUROC's interval, and the interval of mlp less linear over the same draws."""
    names = ["doc_id", "label", "fold", "value"]
    both = {n: settled(x.select(names), n) for n, x in (("mlp", mlp_scores(acts, dim, hidden, k, seed)), ("linear", linear_scores(acts, k, seed)))}
    out = None
    for n, x in both.items():
        ci = R.bootstrap_ci(x.withColumn("probe", F.lit(n)), ["probe"], replicates, seed)
        row = summary(x).withColumn("probe", F.lit(n)).join(ci.select("probe", "low", "high"), "probe")
        out = row if out is None else out.unionByName(row)
    pair = both["mlp"].select("doc_id", "label", F.col("value").alias("mlp")).join(both["linear"].select("doc_id", F.col("value").alias("linear")), "doc_id").withColumn("all", F.lit(0))
    gap = R.interval(R.paired_difference(pair, "mlp", "linear", replicates, seed, ["all"]), ["all"], "delta")
    return out.crossJoin(F.broadcast(gap.select(F.col("mean").alias("gap"), F.col("low").alias("gap_low"), F.col("high").alias("gap_high"))))


def component_table(parts: DataFrame, d: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """stream (vector, reconstruction, residual, and each scaled to unit length): AUROC along d, a fresh probe's, and probe less direction.

    That gap is the circularity gap: what a direction fitted on whole vectors misses of a stream.
    The probes of all streams are fitted together."""
    streams = {}
    for column in ("h", "recon", "resid"):
        own = parts.select("doc_id", "label", F.col(column).alias("h"))
        streams[column], streams[f"{column}_l2"] = own, V.l2_normalised(own)
    rows = stream_rows(streams, k, [seed])
    along = rows.crossJoin(F.broadcast(d.select("d"))).select("stream", "label", F.round(V.project(F.col("h"), F.col("d")), 9).alias("value"))  # one direction
    direction = M.oriented(M.auroc(along, ["stream"])).select("stream", F.col("auroc_bi").alias("direction_auroc"))
    scored = settled(irls.out_of_fold(rows, [seed], irls.fit(rows, [seed], list(range(k)))), "scores")
    probe = M.oriented(M.auroc(scored, ["stream"])).select("stream", F.col("auroc_bi").alias("probe_auroc"))
    folds = M.auroc(scored, ["stream", "fold"]).groupBy("stream").agg(F.avg("auroc").alias("fold_mean"), F.stddev_pop("auroc").alias("fold_std"))
    return direction.join(probe, "stream").join(folds, "stream").withColumn("gap", F.col("probe_auroc") - F.col("direction_auroc"))


def permutation_probe(acts: DataFrame, permutations: int, folds: int, seed: int, ridge: float = 1.0) -> DataFrame:
    """m, auroc of ridge probes refitted on permuted labels with fresh folds, over all rows.

    A ridge probe needs only sums of outer products: those of a permutation's folds are
    added up by tasks, each small system is solved once, and every row is scored by the
    probe that did not see it."""
    rows = settled(R.permuted_labels(acts.select("doc_id", "label", "h"), permutations, seed).withColumn("fold", F.floor(u01(F.lit(seed + 1), F.col("m"), F.col("doc_id")) * folds).cast("int")), "permuted")

    def sums(batches):
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            m, fold, y = (np.asarray(batch.column(c)) for c in (0, 1, 2))
            x = np.asarray(batch.column(3).flatten(), float).reshape(batch.num_rows, -1)
            z = np.hstack([x, np.ones((len(x), 1)), (2.0 * y - 1)[:, None]])
            for key in set(zip(m.tolist(), fold.tolist(), strict=True)):
                own = z[(m == key[0]) & (fold == key[1])]
                held[key] = held.get(key, 0.0) + own.T @ own
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([g.ravel().tolist() for g in held.values()], pa.list_(pa.float64()))], ["m", "fold", "g"]
        )

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        size = int(round(np.sqrt(len(own["g"].iloc[0]))))
        total = np.sum(np.stack(own["g"]), axis=0).reshape(size, size)
        out = []
        for fold in range(folds):
            mine = [g for f, g in zip(own["fold"], own["g"], strict=True) if f == fold]
            g = total - (np.sum(mine, axis=0).reshape(size, size) if mine else 0.0)
            n, mean = g[-2, -2], g[-2, :-2] / max(g[-2, -2], 1)
            std = np.sqrt(np.maximum(np.diag(g)[:-2] / max(n, 1) - mean**2, 0)) + 1e-12
            # sums of standardised vectors, from sums of plain ones
            zz = (g[:-2, :-2] - n * np.outer(mean, mean)) / np.outer(std, std)
            zy = (g[:-2, -1] - mean * g[-2, -1]) / std
            w = np.linalg.solve(zz + ridge * np.eye(len(zz)), zy) / std
            out.append((int(own["m"].iloc[0]), fold, w.tolist(), float(g[-2, -1] / max(n + ridge, 1) - w @ mean)))
        return pd.DataFrame(out, columns=["m", "fold", "w", "b"])

    grams_ = rows.select("m", "fold", "permuted", "h").mapInArrow(sums, "m int, fold int, g array<double>")
    fits = settled(grams_.groupBy("m").applyInPandas(solve, "m int, fold int, w array<double>, b double"), "fits")  # permutations * folds rows
    scored = rows.join(F.broadcast(fits), ["m", "fold"]).select("m", F.col("permuted").alias("label"), F.round(dot(F.col("h"), F.col("w")) + F.col("b"), 9).alias("value"))
    return M.auroc(scored, ["m"]).select("m", "auroc")


def code_arrays(codes: DataFrame, n_features: int, docs: DataFrame) -> DataFrame:
    """doc_id, label, h: a document's codes as a dense array; documents (doc_id, label) without codes are zero."""
    m = codes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "z"))).alias("m"))  # at most n_features
    x = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return docs.select("doc_id", "label").join(m, "doc_id", "left").select("doc_id", "label", x.alias("h"))


def code_probes(codes: DataFrame, n_features: int, drops: dict[str, list[int]], docs: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """stream, doc_id, label, fold, value: probes on codes without the features of each named list, all fitted together."""
    dense = settled(code_arrays(codes, n_features, docs), "codes")
    without = lambda ids: F.transform("h", lambda x, i: F.when(i.isin(ids), 0.0).otherwise(x)) if ids else F.col("h")
    rows = stream_rows({n: dense.select("doc_id", "label", without(list(ids)).alias("h")) for n, ids in drops.items()}, k, [seed])
    return settled(irls.out_of_fold(rows, [seed], irls.fit(rows, [seed], list(range(k)))), "scores").select("stream", "doc_id", "label", "fold", "value")


def code_probe(codes: DataFrame, n_features: int, docs: DataFrame, drop: list[int] = (), k: int = 5, seed: int = 0) -> DataFrame:
    return summary(code_probes(codes, n_features, {"codes": drop}, docs, k, seed))


def rank_by_probe(codes: DataFrame, docs: DataFrame, n_features: int) -> DataFrame:
    """feature_id, score: absolute weight in a ridge probe on codes scaled to unit deviation (not centred)."""
    rows = settled(code_arrays(codes, n_features, docs).select("label", array_to_vector("h").alias("features")), "codes")
    stages = [StandardScaler(inputCol="features", outputCol="scaled", withMean=False), logistic("scaled", 1.0, max(rows.count(), 1))]
    weights = Pipeline(stages=stages).fit(rows).stages[-1].coefficients.toArray()
    return codes.sparkSession.createDataFrame([(i, abs(float(w))) for i, w in enumerate(weights)], "feature_id int, score double")  # one row a feature


def fold_bank(acts: DataFrame, seeds: list[int], folds: int = 5) -> tuple[dict, str]:
    """One probe per seed and fold, fitted on the other folds, all together: weights by (stream, seed, fold), and a digest of all weights.

    The bank is frozen: altered vectors are scored by the probe of their own fold."""
    bank = irls.fit(stream_rows({"h": acts}, folds, seeds), seeds, list(range(folds)))
    digest = hashlib.sha256(b"".join(np.round(bank[k] + 0.0, 9).tobytes() for k in sorted(bank))).hexdigest()
    return bank, digest


def fold_scores(acts: DataFrame, bank: dict, seeds: list[int], folds: int = 5) -> DataFrame:
    """doc_id, label, seed, fold, value of a frozen bank; the folds are those of the fit."""
    return irls.out_of_fold(stream_rows({"h": acts}, folds, seeds), seeds, bank).drop("stream")


def probe_bank(acts: DataFrame, seeds: list[int]) -> list[tuple[int, np.ndarray, float]]:
    """One probe per seed, fitted on a drawn 70 %: (seed, weights, bias) for unscaled vectors."""
    drawn = [(u01(F.lit(s), F.col("doc_id")) >= 0.7).cast("int") for s in seeds]
    rows = settled(acts.select(F.lit("h").alias("stream"), "doc_id", "label", "h", F.array(*drawn).alias("folds")), "probe-rows")
    bank = irls.fit(rows, seeds, [1])
    return [(s, bank["h", s, 1][:-1], float(bank["h", s, 1][-1])) for s in seeds]


def bank_scores(acts: DataFrame, bank: list, column: str = "h") -> DataFrame:
    """doc_id, label, seed, value of a frozen bank on (altered) vectors; the bank is a literal of the plan."""
    each = F.array(
        *[
            F.struct(
                F.lit(s).alias("seed"),
                (F.aggregate(F.zip_with(column, F.array(*[F.lit(float(x)) for x in w]), lambda p, q: p * q), F.lit(0.0), lambda a, x: a + x) + b).alias("value"),
            )
            for s, w, b in bank
        ]
    )
    return acts.select("doc_id", "label", F.explode(each).alias("s")).select("doc_id", "label", "s.seed", F.round("s.value", 9).alias("value"))
