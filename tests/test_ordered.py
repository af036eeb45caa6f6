"""Jobs on ordered streams against plain loops."""

import hashlib
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import corpus as C
from corpuslens.operators import ordered as O


def queue_of(keys, window, resets=()):
    """Places accepted by one pass with one queue."""
    queue, kept = deque(), []
    for i, k in enumerate(keys):
        if i in resets:
            queue.clear()
        if k not in queue:
            kept.append(i)
            queue.append(k)
            if len(queue) > window:
                queue.popleft()
    return kept


def test_places_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(300)] + [(None, 300)]
    want = {i: p for p, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "a int, i int").repartition(parts)
        assert {r["i"]: r["place"] for r in O.numbered(df, ["a", "i"]).collect()} == want
    assert O.numbered(df.limit(0), ["a"]).count() == 0


def test_earliest_by_limit_and_by_places(spark, monkeypatch):
    df = spark.range(100).repartition(5)
    order = [F.col("id") % 10, "id"]
    few = sorted(r["id"] for r in O.earliest(df, order, 23).collect())
    monkeypatch.setattr(O, "FEW", 5)
    assert sorted(r["id"] for r in O.earliest(df, order, 23).collect()) == few and O.earliest(df, order, 23).columns == ["id"]


@pytest.mark.parametrize(("window", "segment", "kinds"), [(1, 4, 3), (3, 12, 5), (5, 20, 9), (10, 40, 12), (200, 1000, 50)])
def test_window_over_segments(spark, window, segment, kinds):
    """Windows that hang on what was accepted long before go from segment to segment."""
    rng = random.Random(window)
    keys = [rng.randrange(kinds) for _ in range(400)]
    keys[100:160] = [0] * 60  # a segment that accepts next to nothing
    resets = {i for i in range(400) if rng.random() < 0.01}
    df = spark.createDataFrame([(i, f"text {k}", i in resets) for i, k in enumerate(keys)], "doc_id long, text string, cycle_start boolean").repartition(6)
    got = [r["place"] for r in C.dedupe_window(df, window, segment=segment).collect()]
    assert sorted(got) == queue_of(keys, window)
    again = C.dedupe_window(df, window, reset=F.col("cycle_start"), segment=segment)
    assert sorted(r["doc_id"] for r in again.collect()) == queue_of(keys, window, resets)
    assert set(again.columns) == {"doc_id", "text", "cycle_start", "place"}


def test_window_edge_cases(spark):
    df = spark.createDataFrame([(2, None), (2, None), (None, "x"), (1, "x"), (3, " x ")], "doc_id long, text string")
    assert sorted(r["place"] for r in C.dedupe_window(df, 10).collect()) == [0, 2]
    assert C.dedupe_window(df.limit(0), 10).count() == 0
    whole = C.dedupe_window(df, 100).count()
    assert whole == C.dedupe_exact(df).count()  # a window without end is the global dedupe


@pytest.mark.parametrize("a_task", [1024, 4])
def test_sources_that_begin_anew(spark, monkeypatch, a_task):
    monkeypatch.setattr(C, "CYCLES_A_TASK", a_task)
    df = spark.createDataFrame([(i, "abc"[min(i // 5, 2)]) for i in range(40)], "doc_id long, source string").repartition(3)
    got = C.mix_sources(df, {"a": 1.0, "b": 3.0, "c": 2.0}, 200, 7, cycle=("a", "b")).orderBy("time").collect()
    assert len(got) == 200
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert [r["cycle"] for r in own] == sorted(r["cycle"] for r in own)
        whole = [sorted(r["doc_id"] for r in own if r["cycle"] == c) for c in range(own[-1]["cycle"])]
        assert len(whole) > 3 and all(w == sorted({r["doc_id"] for r in own}) for w in whole)
        orders = {tuple(r["doc_id"] for r in own if r["cycle"] == c) for c in range(own[-1]["cycle"])}
        assert len(orders) > 1  # every cycle has its own order
    assert sorted(r["doc_id"] for r in got if r["source"] == "c") == list(range(10, 40))  # used up, once
    b, a = (sum(r["source"] == s for r in got) for s in "ba")
    assert 2.4 < b / a < 3.6
    assert C.mix_sources(df, {"a": -1.0, "b": 0.0}, 6, 7).count() == 6  # without weights all count alike
    once = C.mix_sources(df, {"a": 1.0, "b": 3.0}, 200, 7)
    assert once.count() == 10 and {r["cycle"] for r in once.collect()} == {0}


def draw(seed, *parts):
    return int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("mode", C.STEP_MODES)
def test_token_steps(spark, mode):
    sizes = {1: 3, 2: 0, 3: 7, 4: 1, 5: 0, 6: 0, 7: 12, 8: 2, 9: 5}
    docs = spark.createDataFrame([(i,) for i in sizes], "doc_id long").repartition(3)
    toks = spark.createDataFrame([(i, p, "t") for i, n in sizes.items() for p in range(n)], "doc_id long, pos int, token string").repartition(4)
    buffers = [sorted([(i, p) for i in ids for p in range(sizes[i])], key=lambda t: (draw(3, *t), t)) for ids in ((1, 2), (3, 4), (5, 6), (7, 8), (9,))]
    want, step, budget = [], 6, 17
    if mode == "accumulate":
        flat = [t for b in buffers for t in b]
        want = [(k // step, k % step, *t) for k, t in enumerate(flat) if k // step < min(len(flat) // step, 3)]
    else:
        for no, b in enumerate([b for b in buffers if b][:3]):
            own = b if len(b) >= step else sorted(b) * step
            want += [(no, k, *t) for k, t in enumerate(own[:step])]
    got = C.token_steps(docs, toks, 2, step, budget, 3, mode).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 18
    with pytest.raises(ValueError):
        C.token_steps(docs, toks, 2, step, budget, 3, "once")
