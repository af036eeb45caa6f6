"""Token counts, periodic runs and whitening against brute force, and their edge cases."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm import runs, token_counts, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
rng = random.Random(7)
TEXTS = [
    (1, "Hello there"), (2, ""), (3, None), (4, "   "), (5, "▁ x a▁▁ b"), (6, "<s> </s> \x00 x"), (7, "日本語テキスト" * 3000), (8, "a" * 30000), (9, "ab" * 15011), (10, "x y" * 9000), (11, " " * 20000),
    (12, "the quick brown fox " * 3000), (13, "".join(rng.choice("ab") for _ in range(30000))), (14, "\n\n\t " * 5000), (15, "é\x80𝒳" * 9000), (None, "a" * 30000), (8, "a" * 30000), (16, " ".join(f"wörd{i % 977} 12.5" for i in range(12000))), (None, None),
]


def null_last(x):
    return -1 if x is None else x


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", 1, 1, "p") for i, t in TEXTS], "doc_id long, text string, key string, seam int, n_tokens int, part string").repartition(3)


@pytest.mark.parametrize(("core", "overlap"), [(2000, 60), (16384, 256)])
def test_token_counts_as_the_library(docs, core, overlap):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((null_last(i), len((t or "").encode()), len(whole.encode(t or "")), len(whole.encode(t or "")) > 4096) for i, t in TEXTS)
    got = sorted((null_last(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, MODEL, core=core, overlap=overlap).collect())
    assert got == want
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0


def test_a_seam_without_a_stable_place_is_widened(spark, monkeypatch):
    """A text of one letter, cut where its pieces cannot meet, is encoded again with wider overlaps."""
    text, used, plain = "a" * 9001, [], token_counts._cores
    monkeypatch.setattr(token_counts, "_cores", lambda t, core, overlap: (used.append((core, overlap)), plain(t, core, overlap))[1])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = token_counts.token_counts(df, MODEL, core=1001, overlap=3).collect()[0]["n_tokens"]
    m = token_counts.Pieces(MODEL)
    assert got == len(m.ids(m.prefix + text)) and len(used) > 1


def test_stable_boundaries_are_those_of_whole_encodings():
    """Spliced at any stable common boundary, two encodings give that of the whole text."""
    m = token_counts.Pieces(MODEL)
    for k in range(300):
        text = "".join(rng.choice(["a", "b", "the", " ", "ing", "tion", "日"]) for _ in range(rng.randrange(4, 40)))
        cut, back = sorted(rng.sample(range(len(text) + 1), 2))[::-1]
        left, right = m.ids(text[:cut]), m.ids(text[back:])
        ends_l, ends_r = np.append(0, np.cumsum(m.chars[left])), np.append(0, np.cumsum(m.chars[right])) + back
        for i in range(1, len(left) + 1):
            for j in np.flatnonzero(ends_r[:-1] == ends_l[i]).tolist():
                if m.plain[left[i - 1]] and m.plain[right[j]] and m.stable(int(left[i - 1]), int(right[j])):
                    assert [*left[:i], *right[j:]] == m.ids(text).tolist(), (k, text)


def brute_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            n = e - s + q
            if e > s and n >= max(6, 4 * q) and not any(q % r == 0 and all(w[i] == w[i + r] for i in range(s, s + n - r)) for r in range(1, q)):
                found.append((s, n, q))
            s = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def made_words(n, kinds):
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.choice([0, 1, 2]) if n > 8 else 0):
        s = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - s) // 3))
        for i in range(s + p, min(n, s + rng.randrange(p, 6 * p + 1))):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("short", [1, 3, 16])
def test_runs_as_brute_force(short):
    texts = [made_words(rng.choice([0, 1, 5, 6, 7, 30, 200, 600]), rng.choice([1, 2, 3, 50])) for _ in range(250)]
    at = np.cumsum([0, *map(len, texts)])
    start, length, period = runs.find_runs(np.array([x for w in texts for x in w]), np.array(list(map(len, texts))), short)
    got = [[] for _ in texts]
    for i, s, n, q in zip(np.searchsorted(at, start, "right") - 1, start, length, period, strict=True):
        got[i].append((int(s - at[i]), int(n), int(q)))
    assert got == [brute_runs(w) for w in texts]
    assert period.max() > 64


def expected(i, text, planted):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    if planted and i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute_runs(w)
    drop = {k for s, m, q in found for k in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (null_last(i), len(found), *best, math.floor(Fraction(1000 * best[1], best[2])) if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


@pytest.mark.parametrize("planted", [False, True])
def test_periodic_runs(spark, planted):
    rows = [(i, " ".join(f"w{x}é" for x in made_words(rng.randrange(200), 4))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "a a a a a a"), (204, "a a a a a"), (203, "a a a a a a"), (None, "x y " * 5), (205, "  lead\x0b\x0ctrail \r"), (206, "\x1c\x85\xa0 " * 8), (207, ("long " * 7 + "text ") * 4000)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, runs string, start int").repartition(3)
    key = lambda r: (r[0], r[6], r[7])
    got = runs.periodic_runs(df, source=runs._planted if planted else None).collect()
    assert sorted(((null_last(r[0]), *r[1:]) for r in map(tuple, got)), key=key) == sorted((expected(i, t, planted) for i, t in rows), key=key)
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "go  a b a b a b a b stop"), (2, "n n n n n n"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["collapsed"], [tuple(x) for x in r["runs"]]) for r in runs.periodic_runs(df, with_texts=True).collect()}
    assert got == {1: ("go a b stop", [(1, 8, 2)]), 2: ("n", [(0, 6, 1)]), 3: ("", [])}


def test_words_of_texts():
    texts = pa.array(["a b a b a b a b", None, "c " * 50, ""])
    assert runs.words_of(texts)[1].tolist() == [8, 0, 50, 0]


VECTORS = "vec_id long, embedding array<float>, block string, n int"


def reference(rows, k):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return x, ((n * x - s) ** 2).sum(1), (x - s / n) @ vectors, values, np.cov(x.T, bias=True).trace()


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_whitening(spark, monkeypatch, block_rows):
    monkeypatch.setattr(whitening, "GROUP", 3)
    draws = np.random.default_rng(4)
    good = [(i, draws.normal(size=10) * np.arange(1, 11)) for i in range(150)]
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in good] + [(5, [1.0] * 10)] * 20 + [(None, [0.0] * 10), (149, [-3.5] * 10)]
    bad = [(900, None), (901, [None] * 10), (902, [1.0] * 9 + [float("nan")]), (903, [float("inf")] * 10), (904, []), (905, [1.0] * 4), (906, [3e38] * 10)]
    df = spark.createDataFrame([(i, v, "b", 1) for i, v in good + bad], VECTORS).repartition(4)
    got = whitening.whitened(df, block_rows=block_rows).collect()
    x, deviation, centred, values, trace = reference(good, 8)
    assert len(got) == 8 * len(good) and {r["n"] for r in got} == {len(good)} and {r["identity_error"] for r in got}.pop() < 1e-9
    for k in range(8):
        own = [r for r in got if r["component"] == k + 1]
        assert sorted((null_last(r["vec_id"]), r["deviation"]) for r in own) == sorted((null_last(i), d) for (i, _), d in zip(good, deviation.tolist(), strict=True))
        assert all(abs(r["explained"] - values[k] / trace) < 1e-9 for r in own)
        want = sorted((null_last(i), v) for (i, _), v in zip(good, centred[:, k] / np.sqrt(values[k]), strict=True))
        gap = lambda sign: max(abs(a[1] - b[1]) for a, b in zip(sorted((null_last(r["vec_id"]), sign * r["whitened"]) for r in own), want, strict=True))  # noqa: B023, E731
        assert min(gap(1), gap(-1)) < 1e-8


def test_whitening_without_rows_or_variance(spark):
    df = spark.createDataFrame([(1, None, "b", 1)], VECTORS)
    assert whitening.whitened(df).count() == 0 and whitening.whitened(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], "b", 1) for i in range(3)], VECTORS)
    got = whitening.whitened(same).collect()
    assert [(r["deviation"], r["whitened"], r["identity_error"]) for r in got] == [(0, None, None)] * 6
    line = spark.createDataFrame([(i, [float(i), 2.0, 0.0], "b", 1) for i in range(4)], VECTORS)
    got = whitening.whitened(line).collect()
    assert sorted({(r["component"], r["whitened"] is None) for r in got}) == [(1, False), (2, True), (3, True)] and got[0]["identity_error"] < 1e-12


def test_deviations_beyond_machine_numbers(spark):
    big = [(i, [float(2**40 + i), float(-i)], "b", 1) for i in range(40)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>, block string, n int")
    x = [[1024 * int(c) + 100000 for c in v] for _, v, _, _ in big]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((40 * c - t) ** 2 for c, t in zip(x[i], s, strict=True)) for i in range(40)}
    assert {r["vec_id"]: r["deviation"] for r in whitening.whitened(df).collect()} == want
