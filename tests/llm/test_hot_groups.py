"""Groups that hold a large part of the rows, with the split on and off."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import nearcopies, neighbours, simhash, store, token_files, warc


@pytest.mark.parametrize("hot", [1, 4, 10**9])
def test_join_hot_is_a_join(spark, monkeypatch, hot):
    """No group, some or all are hot; the rows are those of a plain join."""
    monkeypatch.setattr(store, "HOT", hot)
    monkeypatch.setattr(store, "LEAST_HOT", 0)
    rng = random.Random(3)
    keys = [0] * 300 + [1] * 80 + [rng.randrange(2, 60) for _ in range(200)] + [None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int").repartition(5)
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first")).filter("k IS NULL OR k % 7 != 3")
    want = sorted(map(tuple, rows.join(groups, "k").select("k", "i", "n", "first").collect()))
    got = sorted(map(tuple, store.join_hot(rows, groups, "k", "n", len(keys)).select("k", "i", "n", "first").collect()))
    assert got == want and len(got) > 500


@pytest.mark.parametrize("hot", [3, 10**9])
def test_near_copies_and_simhash_with_hot_groups(spark, monkeypatch, hot):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 5) for _ in range(200)) for _ in range(6)]
    texts = [base[0]] * 60
    for i in range(60):
        w = base[i % 6].split()
        w[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    results = []
    for value, least in ((512, 1 << 16), (hot, 0)):
        monkeypatch.setattr(store, "HOT", value)
        monkeypatch.setattr(store, "LEAST_HOT", least)
        near = sorted(map(tuple, nearcopies.near_copies(docs).collect()))
        results.append((near, sorted(map(tuple, simhash.near_duplicates(docs).collect()))))
    assert results[0] == results[1]
    assert {c for _, c in results[0][0]} == {0, 61, 62, 63, 64, 65}  # one component for each text that was changed


def test_revisits_of_one_payload_in_most_pages(spark, monkeypatch):
    monkeypatch.setattr(store, "HOT", 4)
    monkeypatch.setattr(store, "LEAST_HOT", 0)
    pages = spark.createDataFrame([(i, "u", "boilerplate " * 20 if i % 3 else f"own {i} " * 20) for i in range(90)], "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.with_roles(pages).collect()}
    assert got == {i: (("response", None) if i % 3 == 0 or i == 1 else ("revisit", 1)) for i in range(90)}


def test_a_vector_that_most_rows_share(spark):
    """Equal vectors answer with the smallest ids, and no more pairs are looked at than can be among the nearest."""
    rng = np.random.default_rng(2)
    rows = [(i, ([0.5, -1.0, 2.0, 0.0] if i % 3 else rng.normal(size=4).tolist())) for i in range(600)] + [(1, [0.5, -1.0, 2.0, -0.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = neighbours.nearest(df.filter("vec_id % 50 = 0"), df, 5).collect()
    x = {}
    for i, v in rows:
        x.setdefault(i, np.asarray(v, np.float32).astype(float))
    for q in {r["query_id"] for r in got}:
        all_ = sorted((float(neighbours.exact_distances(x[q], np.asarray(v, np.float32).astype(float)[None])[0]), i) for i, v in rows if i != q)
        assert [(r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == all_[:5]
    t = pa.Table.from_batches(neighbours.coded(df).toArrow().to_batches())
    assert neighbours.first_of_equals(t, 6).num_rows == 200 + 6 and neighbours.first_of_equals(t.slice(0, 0), 6).num_rows == 0


def test_small_reads_become_blocks():
    data = bytes(random.Random(1).randbytes(1000))
    asked = []

    def read(n, at):
        asked.append(n)
        return data[at : at + n]

    small = token_files.buffered(read, len(data), 64, 3)
    for at in range(0, 1000, 3):
        for n in (0, 1, 8, 40, 100):
            assert small(n, at) == data[at : at + n]
    asked.clear()
    assert [small(1, at) for at in range(640, 704)] == [data[at : at + 1] for at in range(640, 704)] and len(asked) <= 1


@pytest.mark.parametrize(("chunk", "carried"), [(512, 256), (7, 256), (7, 40)])
def test_pairs_of_a_band_value(spark, monkeypatch, chunk, carried):
    """All nodes under one band value, none joined yet: sure pairs and verified ones join what brute force joins."""
    monkeypatch.setattr(nearcopies, "CHUNK", chunk)
    monkeypatch.setattr(nearcopies, "CARRIED", carried)
    rng = random.Random(9)
    texts = []
    for size in (150, 150, 100):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(1, 3)):
                own[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    nodes = nearcopies.sketches(docs).cache()
    sets = nearcopies.shingle_sets(docs, 5, np.full(1 << 10, 255, np.uint8)).cache()
    open_ = nodes.select(F.lit(1).cast("long").alias("band"), "node", F.col("node").alias("root"), F.lit(len(texts)).cast("long").alias("members"))
    found = nearcopies.across(open_, nodes, sets, 0.8).cache()
    sure = {(bytes(r["a"]), bytes(r["b"])) for r in found.filter("sure").collect()}
    checked = {(bytes(r["a"]), bytes(r["b"])) for r in nearcopies.verified(found.filter("NOT sure").select("a", "b"), sets).collect()}
    of = {nearcopies._node(nearcopies.shingles(t)): nearcopies._set(pa.scalar(nearcopies._packed(nearcopies.shingles(t)))) for t in texts}
    names = sorted(of)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if nearcopies._alike(of[a], of[b], 0.8)}
    assert sure | checked <= want and (carried < 60 or not checked) and (carried > 60 or checked)

    def joined(pairs):
        root = {n: n for n in names}
        for a, b in pairs:
            x, y = sorted((root[a], root[b]))
            root = {n: x if r == y else r for n, r in root.items()}
        return root

    assert joined(sure | checked) == joined(want) and len(want) > 30
