"""Models fitted in one pass, feature subsets, tree scans and records, against plain versions."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import cohort as K
from corpuslens.operators import dictionary as D
from corpuslens.operators import irls
from corpuslens.operators import probes as P
from corpuslens.operators import tokenscores as T
from corpuslens.operators import unigrams as U
from corpuslens.operators import vectors as V
from corpuslens.plans.base import settled
from corpuslens.sources.trees import Scanner, needed_literal, tree_scan


def plain_fit(x, y, c, n, standardised):
    """Newton steps on scaled, centred dimensions; weights and bias for the vectors as they are."""
    mean, std = x.mean(0), x.std(0, ddof=1) if standardised else np.ones(x.shape[1])
    live = x.std(0) > 0
    std = np.where(live, std, 1.0)
    z = np.hstack([(x - mean) / std * live, np.ones((len(x), 1))])
    ridge = np.append(np.full(x.shape[1], len(x) / (c * n)), 0.0)
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-12), z.T @ (p - y) + ridge * w)
    raw = w[:-1] / std * live
    return np.append(raw, w[-1] - raw @ mean)


@pytest.mark.parametrize("standardised", [True, False])
def test_probes_fitted_together(spark, standardised):
    rng = np.random.default_rng(1)
    n, dim, seeds = 120, 5, [3, 8]
    x = rng.normal(size=(n, dim)) * [1, 5, 0.1, 2, 0] + [0, 3, 0, -1, 7]  # the last dimension does not vary
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0] + 0.3 * x[:, 3]))).astype(int)
    acts = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "doc_id long, label int, h array<double>").repartition(4)
    half = acts.withColumn("h", F.slice("h", 1, 2))
    rows = P.stream_rows({"whole": acts, "half": half}, 3, seeds)
    folds = {r["doc_id"]: r["folds"] for r in rows.filter("stream = 'half'").collect()}
    weights = irls.fit(rows, seeds, [0, 1, 2], c=1.0, n=100, standardised=standardised)
    assert len(weights) == 2 * 2 * 3
    scores = irls.out_of_fold(rows, seeds, weights).collect()
    assert len(scores) == 2 * 2 * n
    got = {(r["stream"], r["seed"], r["doc_id"]): r for r in scores}
    for (stream, seed, fold), w in weights.items():
        own = x if stream == "whole" else x[:, :2]
        inside = np.array([folds[i][seeds.index(seed)] != fold for i in range(n)])
        want = plain_fit(own[inside], y[inside], 1.0, 100, standardised)
        assert np.allclose(own @ want[:-1] + want[-1], own @ w[:-1] + w[-1], atol=1e-6)
        for i in np.flatnonzero(~inside).tolist():
            r = got[stream, seed, i]
            assert r["fold"] == fold and r["label"] == y[i] and r["value"] == pytest.approx(own[i] @ want[:-1] + want[-1], abs=1e-6)


def test_probes_that_separate_all(spark):
    acts = spark.createDataFrame([(i, i % 2, [10.0 * (i % 2), 1.0]) for i in range(40)], "doc_id long, label int, h array<double>")
    assert P.linear_probe(acts, 4).first()["auroc"] == 1.0
    bank = P.probe_bank(acts, [1, 2])
    assert len(bank) == 2 and all(np.isfinite(w).all() and np.isfinite(b) for _, w, b in bank)


def test_sufficiency_of_dependent_and_many_features(spark):
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(6, 2)))[0].T
    few = rng.normal(size=(3, 6))
    q = np.linalg.qr(few.T)[0]
    assert D.feature_sufficiency(basis, few) == pytest.approx(np.linalg.norm(q.T @ basis.T) ** 2 / 2, abs=1e-6)
    assert D.feature_sufficiency(basis, np.vstack([few, few])) == pytest.approx(D.feature_sufficiency(basis, few), abs=1e-5)
    many = rng.normal(size=(20, 6))
    assert D.feature_sufficiency(basis, many) == pytest.approx(1.0, abs=1e-6)
    both = D.feature_sufficiency(basis, np.stack([few, many[:3]]))
    assert both.tolist() == pytest.approx([D.feature_sufficiency(basis, few), D.feature_sufficiency(basis, many[:3])])
    for own in (few, many):
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(own)], "feature_id int, w array<double>").repartition(3)
        assert D.sufficiency_of_all(df, basis) == pytest.approx(D.feature_sufficiency(basis, own), abs=1e-6)


def test_null_of_subsets(spark):
    rng = np.random.default_rng(3)
    basis, features = np.linalg.qr(rng.normal(size=(8, 3)))[0].T, rng.normal(size=(30, 8))
    null = settled(D.sufficiency_null(spark, basis, features, [4, 9, 99], 120, 5), "null")
    rows = null.collect()
    assert sorted((r["size"], r["draw"]) for r in rows) == [(s, i) for s in (4, 9) for i in range(120)]
    again = {(r["size"], r["draw"]): r["value"] for r in D.sufficiency_null(spark, basis, features, [4, 9], 120, 5).collect()}
    assert all(again[r["size"], r["draw"]] == pytest.approx(r["value"]) for r in rows)
    seen = spark.createDataFrame([(4, 0.5)], "size int, observed double")
    table = {r["size"]: r for r in D.null_table(null, seen).collect()}
    own = np.array([r["value"] for r in rows if r["size"] == 4])
    t = table[4]
    assert (t["n_random"], t["percentile_rank"]) == (120, pytest.approx(100 * np.mean(own <= 0.5)))
    assert [t[c] for c in ("mean", "std", "p50", "p95", "p99", "lowest", "highest")] == pytest.approx([own.mean(), own.std(), *np.percentile(own, [50, 95, 99]), own.min(), own.max()])
    assert table[9]["observed"] is None and table[9]["percentile_rank"] is None


def test_common_subsequences_bit_by_bit():
    rng = random.Random(4)

    def table(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                now = best[j + 1]
                best[j + 1] = before + 1 if x == y else max(best[j + 1], best[j])
                before = now
        return best[-1]

    pairs = [([rng.choice("abc") for _ in range(rng.randrange(90))], [rng.choice("abcd") for _ in range(rng.randrange(200))]) for _ in range(200)] + [(None, ["a"]), ([], [])]
    a, b = (pd.Series([p[i] for p in pairs]) for i in (0, 1))
    assert T.lcs_len.func(a, b).tolist() == [table(x or [], y or []) for x, y in pairs]


def test_literals_that_every_match_holds():
    assert needed_literal(r"runs/old/\d+") == "runs/old/" and needed_literal(r"(?i)abc") == "" and needed_literal(r"a|b") == ""
    assert needed_literal(r"x?secret=[a-z]+") == "secret=" and needed_literal(r"[ab]+") == ""
    rng = random.Random(1)
    patterns = {"path": r"/srv/u\d{2,}", "word": r"\b(north|south)\b", "key": r"key=[a-z]+", "any": r"(?i)tmp"}
    scanner = Scanner(patterns)
    for _ in range(200):
        text = " ".join(rng.choice(["/srv/u1", "/srv/u22", "north", "northern", "key=", "key=ab", "TMP", "x\n", "y"]) for _ in range(8))
        want = [(n, m[0], text[: m.start()].count("\n") + 1) for n, p in patterns.items() if (m := re.search(p, text))]
        assert scanner.first_matches(text) == want


def test_tree_scan(spark, tmp_path):
    for name, body in {"a.txt": "x\nkey=ab key=cd", "deep/er/b.py": "u = '/srv/u22'", "deep/c.md": "key=zz", "vendor/d.txt": "key=no", "deep/vendor/e.txt": "key=no", "f.bin": "key=no", "vendored/g.txt": "key=yes", "h.txt": ""}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    (tmp_path / "i.txt").write_bytes(b"\xff\xfe key=odd")
    got = sorted(map(tuple, tree_scan(spark, f"file://{tmp_path}", {"key": r"key=[a-z]+", "path": r"/srv/u\d+"}, ["txt", ".py"], ["vendor"]).collect()))
    assert got == [("a.txt", "key", "key=ab", 2), ("deep/er/b.py", "path", "/srv/u22", 1), ("i.txt", "key", "key=odd", 1), ("vendored/g.txt", "key", "key=yes", 1)]


def test_spaced_layers():
    assert V.spaced_layers(32) == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27, 30, 31] and V.spaced_layers(6) == [0, 1, 2, 3, 4, 5]
    assert V.spaced_layers(40, also=22)[6] == 22 and V.spaced_layers(1) == [0] and V.spaced_layers(0) == []


def test_which_checkpoint(spark):
    rows = [("m", "run1", None, "old", None), ("m", "run2", "l1_b", "b", 0.5), ("m", "run2", "l1_a", "a", -0.7), ("m", "run2", "l1_c", "c", None), ("s", "r", None, "only", 3.0), ("s", "r", "k", "other", 0.0), ("n", "r", "k", "k", None)]
    df = spark.createDataFrame(rows, "model string, name string, key string, path string, delta double")
    of = lambda *a, **k: {r["model"]: r["path"] for r in K.latest_checkpoint(df, ["model"], *a, **k).collect()}
    assert of() == {"m": "a", "s": "only", "n": "k"}
    assert of("best_ppl") == {"m": "b", "s": "only", "n": None}
    assert of(key="l1_c") == {"m": "c", "s": "only", "n": None}
    with pytest.raises(ValueError):
        of("last")


def test_intervals_of_drops_and_markdown(spark):
    rows = [("m", "original", 0.8, 0.75, 0.85), ("m", "recon", 0.6, 0.58, 0.62), ("n", "original", 0.7, 0.6, 0.8)]
    df = spark.createDataFrame(rows, "model string, kind string, value double, low double, high double")
    assert list(map(tuple, K.drop_intervals(df, ["model"], "kind", "original", "recon").collect())) == [("m", 0.2, 0.13, 0.27)]
    records = spark.createDataFrame([("m", "base", 1.5, None, None), ("m", "erased", None, 7, None), ("m", "base", 9.0, 9, 1)], "model string, stage string, x double, n int, epoch int")
    wide = K.wide_fields(records, "model", "stage", ["base", "erased"], ["x", "n"], "epoch")
    assert K.markdown(wide).first()["line"] == "| m | 1.5000 | - | - | 7 |"


def test_paired_differences(spark):
    rng = np.random.default_rng(6)
    x = {i: rng.normal(size=4) for i in range(31)}
    label = {i: int(i % 3 == 0) for i in x}
    acts = spark.createDataFrame([(i, label[i], v.tolist()) for i, v in x.items()], "doc_id long, label int, h array<double>").repartition(5)
    one, zero = ([x[i] for i in sorted(x) if label[i] == y] for y in (1, 0))
    want = np.array([a - b for a, b in zip(one, zero)])
    got = sorted((r["pair"], r["h"]) for r in V.paired_differences(acts).collect())
    assert [p for p, _ in got] == list(range(11)) and np.allclose([h for _, h in got], want)
    _, s, vt = np.linalg.svd(want - want.mean(0))
    for (value, share, vector), size, v in zip(V.paired_pca(acts, 3), s, vt):
        assert value == pytest.approx(size**2 / 10) and share == pytest.approx(size**2 / (s**2).sum()) and abs(np.dot(vector, v)) == pytest.approx(1)


@pytest.mark.parametrize("frequent", [2, 512])
def test_words_by_frequency(spark, monkeypatch, frequent):
    """Places of frequent words, of other words, and of words that the model does not know."""
    monkeypatch.setattr(U, "FREQUENT", frequent)
    texts = [(1, "a a a b a c"), (2, "a  d"), (3, ""), (4, None), (5, "a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    words = U.words_in(docs)
    flat = [(i, p, w, ([""] + (t or "").split())[p]) for i, t in texts for p, w in enumerate((t or "").split())]
    assert sorted((r["doc_id"], r["pos"], r["token"], r["prev"]) for r in words.collect()) == sorted(flat)
    model = U.unigram(U.words_in(docs.filter("doc_id < 2")), True)
    seen = [w for i, _, w, _ in flat if i == 1]
    want = sorted((i, p, round(np.log((seen.count(w) + 1) / (len(seen) + len(set(seen)))), 9)) for i, p, w, _ in flat)
    assert sorted((r["doc_id"], r["pos"], round(r["logp"], 9)) for r in U.scored(words, model).collect()) == want
    bi = U.bigram(words)
    pairs = [(b, w) for _, _, w, b in flat]
    assert {(r["prev"], r["token"]): round(r["logp"], 9) for r in bi.collect()} == {(b, w): round(np.log(pairs.count((b, w)) / sum(x == b for x, _ in pairs)), 9) for b, w in pairs}
    best = U.at_places(words.drop("token"), T.greedy_tokens(bi, ["prev"]), bi)
    assert sorted((r["doc_id"], r["pos"], r["token"]) for r in best.collect()) == sorted((i, p, min({w for x, w in pairs if x == b}, key=lambda w: (-pairs.count((b, w)), w))) for i, p, _, b in flat)
