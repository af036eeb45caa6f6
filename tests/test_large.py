"""What showed on larger tables only, on small ones."""

import functools
import math
import random
from collections import Counter
from hashlib import md5

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.draws import above, u01
from corpuslens.operators import cohort as K
from corpuslens.operators import corpus as C
from corpuslens.operators import probes as P
from corpuslens.operators import resample as R
from corpuslens.operators import tokenscores as T
from corpuslens.operators import unigrams as U
from corpuslens.operators.corpus import stratified_folds
from corpuslens.operators.replicates import unpacked
from corpuslens.sources.scratch import scratch
from corpuslens.streaming import streams as S


def test_markdown_rounds_the_exact_value(spark):
    """3.64815 is a little less than its decimal form, 0.00015 a little less, 2.00005 a little more, and 0.03125 a tie."""
    values = [3.64815, 0.00015, 2.00005, 0.03125, -3.64815, 1e23, float("inf"), None]
    wide = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "model int, x double").repartition(3)
    want = {i: f"| {i} | {'-' if v is None else '%.4f' % v} |" for i, v in enumerate(values)}
    assert want[0] == "| 0 | 3.6481 |"
    assert {r["key"]: r["line"] for r in K.markdown(wide).collect()} == want


@pytest.mark.parametrize("places, cells", [(1024, 1 << 19), (4, 7 * 9)])
def test_stratified_weights(spark, monkeypatch, places, cells):
    """Draws with replacement against plain ones; a row is written once, whatever the number of replicates."""
    monkeypatch.setattr(R, "PLACES", places)
    monkeypatch.setattr(R, "CELLS", cells)
    rows = [(i, i % 3, int(i % 5 < 2), round(i * 37 % 11 / 10, 3)) for i in range(70)] + [(900, 7, 1, 0.5), (901, 7, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, fold long, label int, value double").repartition(3)
    draw = lambda *parts: int(md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32
    want = {}
    for group in {(f, y) for _, f, y, _ in rows}:
        own = sorted((r for r in rows if r[1:3] == group), key=lambda r: (draw(4, r[0]), r[0]))
        for b in range(9):
            for j in range(len(own)):
                i = own[int(draw(4, b, j) * len(own))][0]
                want.setdefault(i, [0] * 9)[b] += 1
    drawn = R.stratified_weights(df, 9, 4, ["fold", "label"])
    got = drawn.collect()
    assert len(got) == len(want) and {r["doc_id"]: unpacked([r["weights"]])[0].tolist() for r in got} == want
    area = R.auroc_replicates(drawn, ["fold"], 9, 4, weights="weights").collect()
    assert len(area) == 36
    for r in area:
        pairs = [(w * want[j][r["b"]], (x > y) + (x == y) / 2) for i, f, a, x in rows for j, g, c, y in rows if f == g == r["fold"] and a and not c and i in want and j in want and x is not None and y is not None for w in [want[i][r["b"]]]]
        total = sum(w for w, _ in pairs)
        assert r["auroc"] == pytest.approx(sum(w * s for w, s in pairs) / total if total else 0.5)


@pytest.mark.parametrize("budget, every, batches", [(50, 2, 7), (23, 3, 4), (10_000, 2, 10), (1, 1, 1)])
def test_budgeted_stream_of_files_with_many_steps(spark, budget, every, batches):
    """Files of three steps, windows that two files share, and no batch after the budget."""
    rows = [(s, 10 * s + i, [(f, 0.5 + i) for f in range(4) if (s + i + f) % 3 == 0] or None) for s in range(30) for i in range(1 + s % 4)]
    df = spark.createDataFrame(rows, "step long, token long, codes array<struct<feature_id: int, z: double>>").withColumn("file", F.floor(F.col("step") / 3))
    src, out = scratch(spark, "many-in"), scratch(spark, "many-out")
    df.repartition("file").write.partitionBy("file").parquet(src)
    S.arrived_in_order(spark, src)
    got = S.budgeted_health_stream(spark, src, out, scratch(spark, "many-state"), budget, every)
    sizes = [1 + s % 4 for s in range(30)]
    taken = [s for s in range(30) if sum(sizes[:s]) < budget]
    assert sorted(map(tuple, got["steps"].collect())) == [(s, sum(sizes[:s]), sizes[s]) for s in taken]
    codes = [(s, f, z) for s, _, c in rows if s in taken for f, z in c or []]
    assert {r["feature_id"]: (r["fires"], r["total"], r["largest"]) for r in got["sums"].collect()} == {f: (len(z), sum(z), max(z)) for f in range(4) for z in [[z for _, g, z in codes if g == f]] if z}
    assert {(r["window"], r["feature_id"]): r["fires"] for r in got["windows"].collect()} == Counter((s // every, f) for s, f, _ in codes)
    assert spark.read.parquet(f"{out}/steps").select("v").distinct().count() == batches


TEXTS = [(1, "A a a b A c", "en"), (2, "a  d", "de"), (3, "", "en"), (4, None, "en"), (5, "a", None), (6, "B b É é a C c c", "en"), (7, "only", "fr")]


@pytest.mark.parametrize("share", [2, 1 << 17])
@pytest.mark.parametrize("sent", [2, 100])
def test_conditions_of_one_pass(spark, monkeypatch, share, sent):
    """Three models from one table of words, texts gathered once, those without a label left out of the scores only."""
    monkeypatch.setattr(U, "SENT", sent)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").repartition(3)
    ids = [1, 2, 3, 5, 6, 6, 99]
    words = U.words_in(U.of_ids(docs, spark.createDataFrame([(i,) for i in ids], "doc_id long"))).select("doc_id", "token")
    wide = U.by_frequency(words, U.conditions(docs), "token", "c", share=share)
    flat = [(i, w, lang) for i, t, lang in TEXTS for w in (t or "").split()]
    seen, low, en = Counter(w for _, w, _ in flat), Counter(w.lower() for _, w, _ in flat), Counter(w for _, w, lang in flat if lang == "en")
    of = {"orig": lambda w: math.log(seen[w] / len(flat)), "lower": lambda w: math.log(low[w.lower()] / len(flat)), "ref": lambda w: math.log((en[w] + 1) / (sum(en.values()) + len(en)))}
    want = {}
    for i in (1, 2, 5, 6):
        for c, f in of.items():
            lp = sorted(f(w) for j, w, _ in flat if j == i)
            least = max(1, int(0.2 * len(lp)))
            want |= {(c, i, "loss"): sum(lp) / len(lp), (c, i, "min_k_20"): sum(lp[:least]) / least}
    got = {(r["cond"], r["doc_id"], r["probe"]): r["value"] for r in T.probe_scores(wide, list(of)).collect()}
    assert got == pytest.approx(want)


def test_neighbours_of_one_pass(spark):
    """Copies are means over kept places, as of copies that are written out and scored; a copy without words is the text."""
    docs = spark.createDataFrame([(i, " ".join("abcdefg"[j % 7] for j in range(i % 5)) or None) for i in range(60)], "doc_id long, text string").repartition(3)
    words = U.words_in(docs)
    model = U.unigram(words)
    logp = {r["token"]: r["logp"] for r in model.collect()}
    copies = C.make_neighbours(docs, 3, 0.7, 13).collect()
    assert any(r["text"] == "a" for r in copies)
    mean = lambda t: sum(logp[w] for w in t.split()) / len(t.split())
    want = {r["doc_id"]: mean(r["text"]) - sum(mean(c["text"]) for c in copies if c["doc_id"] == r["doc_id"]) / 3 for r in docs.collect() if r["text"]}
    got = T.neighbour_score(U.scored(words, model, 1 << 17), 3, 0.7, 13).collect()
    assert {r["doc_id"]: r["neighbour_score"] for r in got} == pytest.approx(want)


@pytest.mark.parametrize("p", [0.0, 0.3, 0.5, 0.999, 1.0])
def test_draw_above(spark, p):
    rows = spark.range(3000).select(u01(F.lit(5), F.col("id")).alias("u"), above(p, F.lit(5), F.col("id")).alias("more")).collect()
    assert all((r["u"] > p) == r["more"] for r in rows)


@pytest.mark.parametrize("weighted", [True, False])
def test_audit_of_one_count(spark, weighted):
    """Against a vocabulary, document frequencies and weights that each fold counts anew."""
    rng = random.Random(3)
    rows = [(i, i % 3 % 2, " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"][i % 3 % 2 :]) for _ in range(i % 9))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string").repartition(3)
    stages = [CountVectorizer(inputCol="terms", outputCol="counts", minDF=2.0), IDF(inputCol="counts", outputCol="idf")]

    def plain():
        dealt = stratified_folds(P.text_terms(df), "label", 3, 0).cache()
        for f in range(3):
            train, test = dealt.filter(F.col("fold") != f), dealt.filter(F.col("fold") == f)
            counts = stages[0].fit(train)
            own = [counts]
            if weighted:
                idf = stages[1].fit(counts.transform(train)).idf.toArray()
                own += [ElementwiseProduct(inputCol="counts", outputCol="weighted", scalingVec=DenseVector(idf + 1.0)), Normalizer(inputCol="weighted", outputCol="features")]
            model = Pipeline(stages=[*own, P.logistic("features" if weighted else "counts")]).fit(train)
            yield P.scores_of(model, test, ["doc_id", "label", "fold"])

    want = P.summary(functools.reduce(DataFrame.unionByName, plain())).first().asDict()
    assert P.bow_audit(df, 3, tfidf=weighted).first().asDict() == pytest.approx(want, abs=1e-6)


def test_vocabularies_of_folds(spark):
    """Most frequent first, ties by term, frequencies of the other folds' texts only."""
    rows = [(0, ["a", "a", "b", "z"]), (0, ["b", "c"]), (1, ["a", "c", "c"]), (1, ["c", "d", "z"]), (2, ["d", "e", "e", "e"]), (2, [])]
    df = spark.createDataFrame(rows, "fold int, terms array<string>").repartition(2)
    want = []
    for f in range(3):
        own = [t for g, t in rows if g != f]
        total, seen = Counter(w for t in own for w in t), Counter(w for t in own for w in set(t))
        kept = sorted((w for w in seen if seen[w] >= 2), key=lambda w: (-total[w], w))[:2]
        want.append({w: seen[w] for w in kept})
    assert P.fold_vocabularies(df, 3, 2, 2.0) == want
