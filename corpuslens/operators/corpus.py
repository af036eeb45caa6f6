"""Corpus hygiene: cleaning, deduplication, mixing, splits, crops and perturbations.

Random choices are hash draws (functions.draws.u01), so they do not depend on
partitioning; choices of a share of rows are thresholds on draws, not sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.draws import stripped, u01, words_of
from corpuslens.operators.ordered import SEGMENT, accepted_in_window, earliest, numbered
from corpuslens.sources.scratch import settled

#: Times that one task writes out a row of a source that begins anew.
CYCLES_A_TASK = 1024


def clean_texts(df: DataFrame, min_chars: int = 1, max_chars: int | None = None) -> DataFrame:
    """Stripped texts of at least ``min_chars``, cut to ``max_chars``; null texts go."""
    out = df.withColumn("text", stripped("text")).filter(F.length("text") >= min_chars)
    return out.withColumn("text", F.substring("text", 1, max_chars)) if max_chars else out


def filter_texts(df: DataFrame, min_chars: int = 200, drop_empty: bool = True) -> DataFrame:
    """Rows whose stripped text is long enough; the text itself stays as it is."""
    size = F.length(stripped("text"))
    return df.filter((size >= min_chars) & ((size > 0) if drop_empty else F.lit(True)))


def dedupe_key(text: str = "text", ws: bool = True, lower: bool = False, max_chars: int = 4096) -> Column:
    """What two texts must share to count as one: stripped, blanks collapsed, first ``max_chars``."""
    key = stripped(F.coalesce(F.col(text), F.lit("")))
    key = F.regexp_replace(key, r"\s+", " ") if ws else key
    key = F.lower(key) if lower else key
    return F.substring(key, 1, max_chars)


def dedupe_exact(df: DataFrame, order: str = "doc_id", **key) -> DataFrame:
    """First row of each group of equal keys with the group's size.

    Only a 128-bit digest and the order column are shuffled, combined map-side."""
    digests = df.select(order, F.md5(dedupe_key(**key)).alias("digest"))
    return digests.groupBy("digest").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n_copies"))


def dedupe_window(df: DataFrame, window: int, order: str = "doc_id", reset: Column | None = None, segment: int = SEGMENT, **key) -> DataFrame:
    """Rows of the stream in ``order`` whose key was not accepted among the last ``window`` accepted rows, with their ``place``.

    ``reset`` marks rows before which the memory is cleared, as at the start of a new cycle."""
    digest = F.md5(dedupe_key(**key))
    return accepted_in_window(df, digest, window, [F.col(order), digest], reset, segment)


def mix_sources(df: DataFrame, weights: dict[str, float], n: int, seed: int, source: str = "source", key: str = "doc_id", cycle=()) -> DataFrame:
    """n rows drawn from sources by weight, each source without replacement until it is used up.

    A row's virtual time is its draw times the source's size over the weight, the time
    at which it would be drawn; the n earliest stay.  Negative weights count as 0; if
    all are 0, all sources count alike.  Sources in ``cycle`` begin anew when used up, in a new
    order: cycle c takes the time from c to c + 1 sizes over the weight (column ``cycle``)."""
    w = {k: max(v, 0.0) for k, v in weights.items()}
    if not any(w.values()):
        w = dict.fromkeys(w, 1.0)
    w = {k: v for k, v in w.items() if v > 0}
    rows = df.filter(F.col(source).isin(list(w)))
    sizes = {r[0]: r[1] for r in rows.groupBy(source).count().collect()}  # one row per weighted source
    again = [k for k in sizes if k in cycle]
    # until this time the cycling sources alone give n rows, as each has all its whole cycles by then
    until = (n + sum(sizes[k] for k in again)) / sum(w[k] for k in again) if again else float("inf")
    times = {k: -int(-until * w[k] // sizes[k]) if k in again else 1 for k in sizes}
    of = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(source)] if table else F.lit(None)
    if max(times.values(), default=1) > CYCLES_A_TASK:  # rows that come back very often are written out by many tasks
        first = F.explode(F.sequence(F.lit(0), F.floor((of(times) - 1) / CYCLES_A_TASK).cast("int"))).alias("turn")
        rows = rows.select("*", first).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        one = F.sequence(F.col("turn") * CYCLES_A_TASK, F.least((F.col("turn") + 1) * CYCLES_A_TASK, of(times)).cast("int") - 1)
        rows = rows.withColumn("cycle", F.explode(one)).drop("turn")
    else:
        rows = rows.withColumn("cycle", F.explode(F.sequence(F.lit(0), of(times).cast("int") - 1)))
    time = (F.col("cycle") + u01(F.lit(seed) + F.col("cycle"), F.col(key))) * of(sizes) / of(w)
    return earliest(rows.withColumn("time", time).filter(F.col("time") <= until), ["time", key, "cycle"], n)


def seeded_shuffle(df: DataFrame, seed: int, epoch: int = 0, key: str = "doc_id") -> DataFrame:
    """All rows in the order of their draws."""
    return df.orderBy(u01(F.lit(seed + epoch), F.col(key)), key)


def sample_n(df: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """n rows without replacement: those with the smallest draws, in the order of the key."""
    return earliest(df, [u01(F.lit(seed), F.col(key)), F.col(key)], n).orderBy(key)


def sha(c: str = "text") -> Column:
    return F.sha2(F.col(c), 256)


def disjoint_candidates(stream: DataFrame, min_chars: int, low: int, high: int) -> DataFrame:
    """Rows long enough, flagged by the length window, with their digest."""
    rows = stream.filter(F.length(stripped("text")) >= min_chars)
    return rows.withColumn("in_window", F.length("text").between(low, high)).withColumn("sha256", sha())


def disjoint_partition(stream: DataFrame, pool: DataFrame, n_docs: int, min_chars: int = 200, low: int = 620, high: int = 1024, seed: int = 0, strict: bool = False) -> DataFrame:
    """n_docs texts whose digests are not in the pool, without own duplicates, in seeded order.

    Digests, not texts, meet in the joins; a text is read for the winners only.  With
    ``strict`` too few texts are an error."""
    rows = disjoint_candidates(stream, min_chars, low, high).filter("in_window").select("doc_id", "sha256")
    own = pool.select(sha().alias("sha256")).distinct()
    fresh = rows.join(own, "sha256", "left_anti").groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    picked = fresh.orderBy(u01(F.lit(seed), F.col("doc_id")), "doc_id").limit(n_docs)
    if strict and (found := picked.count()) < n_docs:
        raise ValueError(f"{n_docs} texts were asked for and {found} are left")
    return picked


def disjointness_proof(selected: DataFrame, pool: DataFrame, stream: DataFrame, min_chars: int = 200, low: int = 620, high: int = 1024) -> DataFrame:
    """One row of counts that shows the selected digests and the pool share nothing."""
    rows = disjoint_candidates(stream, min_chars, low, high)
    own = pool.select(sha().alias("sha256")).distinct()
    marked = rows.join(own.withColumn("hit", F.lit(1)), "sha256", "left")
    counts = marked.agg(
        F.count(F.lit(1)).alias("n_stream"),
        F.count_if(~F.col("in_window")).alias("n_length_rejects"),
        F.count_if(F.col("in_window") & F.col("hit").isNotNull()).alias("n_collisions"),
    )
    chosen = selected.select("sha256").distinct()
    shared = chosen.join(own, "sha256", "left_semi")
    few = shared.orderBy("sha256").limit(10).agg(F.array_join(F.array_sort(F.collect_list("sha256")), ",").alias("examples"))
    both = shared.agg(F.count(F.lit(1)).alias("n_intersection")).crossJoin(few)
    sizes = own.agg(F.count(F.lit(1)).alias("n_pool")).crossJoin(chosen.agg(F.count(F.lit(1)).alias("n_selected")))
    return counts.crossJoin(both).crossJoin(sizes)  # rows of one


def split_frac(df: DataFrame, frac: float, seed: int, key: str = "doc_id") -> DataFrame:
    """Add in_a: a draw below ``frac``; per class as overall, without a sort."""
    return df.withColumn("in_a", u01(F.lit(seed), F.col(key)) < frac)


def exact_rank(df: DataFrame, by: list[str], seed: int, key: str = "doc_id", buckets: int = 64, also: tuple = ()) -> DataFrame:
    """Add ``place``: the row's number (from 0) in its group's seeded order; ``also``: columns that enter the draw.

    Draws are uniform, so equal slices of [0, 1) are equal parts of every group, however
    large; a row's place is its place in the slice plus the sizes of the slices before."""
    drawn = df.withColumn("draw", u01(F.lit(seed), *[F.col(c) for c in also], F.col(key))).withColumn("slice", F.floor(F.col("draw") * buckets).cast("int"))
    sizes = drawn.groupBy(*by, "slice").agg(F.count(F.lit(1)).alias("n_slice"))
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "slice", F.coalesce(F.sum("n_slice").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy(*by, "slice").orderBy("draw", key)) - 1
    return drawn.withColumn("local", local).join(offsets, [*by, "slice"]).withColumn("place", F.col("local") + F.col("offset")).drop("local", "offset", "slice", "draw")


def stratified_folds(df: DataFrame, label: str, k: int, seed: int, key: str = "doc_id") -> DataFrame:
    """Add fold: places within the class dealt round."""
    return exact_rank(df, [label], seed, key).withColumn("fold", (F.col("place") % k).cast("int")).drop("place")


def split_exact(df: DataFrame, label: str, frac: float, seed: int, key: str = "doc_id") -> DataFrame:
    """Add in_a for the first round(frac * n) places of each class."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    ranked = exact_rank(df, [label], seed, key).join(F.broadcast(sizes), label)  # one row per class
    return ranked.withColumn("in_a", F.col("place") < F.bround(F.col("n_class") * frac)).drop("place", "n_class")


def crop_tokens(df: DataFrame, length: int, random_crop: bool, seed: int, ids: str = "ids", key: str = "doc_id", pad: str = "") -> DataFrame:
    """Windows of ``length`` tokens (prefix, or at a drawn place), padded on the right, with a mask."""
    n = F.size(ids)
    start = F.when(n > length, F.floor(u01(F.lit(seed), F.col(key)) * (n - length + 1)).cast("int")).otherwise(0) if random_crop else F.lit(0)
    own = F.slice(ids, start + 1, F.lit(length))
    kept = F.least(n, F.lit(length))
    filled = F.concat(own, F.array_repeat(F.lit(pad), F.lit(length) - kept))
    mask = F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(length) - kept))
    return df.select(key, filled.alias("ids"), mask.alias("mask"), start.alias("start"))


#: The six orders of three words, by draw.
ORDERS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))


def shuffle_windows(df: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """Texts with the first three of every four words in a drawn order; the fourth is an anchor.

    A last group shuffles only if it has three words."""
    words = words_of(F.col("text"))
    n = F.size("w")
    orders = F.array(*[F.array(*[F.lit(x) for x in o]) for o in ORDERS])

    def moved(i):
        group = F.floor(i / 4).cast("int")
        draw = F.floor(u01(F.lit(seed), F.col(key), group) * 6).cast("int")
        whole = group * 4 + 3 <= n
        at = F.when((i % 4 == 3) | ~whole, i).otherwise(group * 4 + orders[draw][(i % 4).cast("int")])
        return F.col("w")[at.cast("int")]

    out = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), moved), " ")).otherwise("")
    return df.withColumn("w", words).select(key, out.alias("text"))


def make_neighbours(df: DataFrame, n: int, p: float, seed: int, key: str = "doc_id") -> DataFrame:
    """n copies of each text with words left out with probability p; a copy left empty keeps its text."""
    base = df.select(key, "text", words_of(F.col("text")).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("nb"))
    kept = F.filter("w", lambda w, i: u01(F.lit(seed), F.col(key), F.col("nb"), i) > p)
    return base.select(key, "nb", F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.col("text")).alias("text"))


def token_budget(tokens: DataFrame, budget: int, batch: int, seed: int) -> DataFrame:
    """The ``budget`` tokens with the smallest draws, in numbered batches: batch_no, doc_id, pos."""
    drawn = tokens.select("doc_id", "pos").withColumn("draw", u01(F.lit(seed), F.col("doc_id"), F.col("pos")))
    chosen = numbered(earliest(drawn, ["draw", "doc_id", "pos"], budget), ["draw", "doc_id", "pos"])
    return chosen.select(F.floor(F.col("place") / batch).cast("int").alias("batch_no"), "doc_id", "pos")


#: What a training step does with a buffer of texts: fill the step from it alone, or carry what is left to the next.
STEP_MODES = ("repeat", "accumulate")


def token_steps(docs: DataFrame, tokens: DataFrame, texts: int, step: int, budget: int, seed: int, mode: str) -> DataFrame:
    """Training steps of ``step`` tokens until ``budget`` is reached: batch_no, slot, doc_id, pos.

    Documents come in the order of their ids, ``texts`` of them are a buffer, and a buffer's tokens come
    in drawn order.  ``repeat``: every buffer with tokens makes one step; of more tokens the first are
    taken, fewer are repeated in reading order until the step is full.  ``accumulate``: buffers
    follow each other, and what does not fill a step is carried to the next; a last
    unfinished step is left out.  Places are counted by ranges, in no single task."""
    if mode not in STEP_MODES:
        raise ValueError(f"mode is one of {STEP_MODES}")
    steps = -(-budget // step)
    # repeated ids are one document, as tokens know ids only
    buffers = numbered(docs.select("doc_id").distinct(), ["doc_id"]).select("doc_id", F.floor(F.col("place") / texts).alias("buffer"))
    own = tokens.select("doc_id", "pos").join(buffers, "doc_id").withColumn("draw", u01(F.lit(seed), F.col("doc_id"), F.col("pos")))
    if mode == "accumulate":
        whole = numbered(own, ["buffer", "draw", "doc_id", "pos"])
        full = F.floor(F.lit(whole.count()) / step)
        out = whole.withColumn("batch_no", F.floor(F.col("place") / step)).filter((F.col("batch_no") < full) & (F.col("batch_no") < steps))
        return out.select(F.col("batch_no").cast("int").alias("batch_no"), (F.col("place") % step).cast("int").alias("slot"), "doc_id", "pos")
    sizes = numbered(own.groupBy("buffer").agg(F.count(F.lit(1)).alias("n")), ["buffer"], "batch_no").filter(F.col("batch_no") < steps)
    sized = own.join(sizes, "buffer").withColumn("draw", F.when(F.col("n") >= step, F.col("draw")).otherwise(0.0))
    placed = settled(numbered(sized, ["buffer", "draw", "doc_id", "pos"]), "steps")
    first = placed.groupBy("buffer").agg(F.min("place").alias("first"))
    ranked = placed.join(first, "buffer").withColumn("rank", F.col("place") - F.col("first")).filter(F.col("rank") < step)
    slots = F.explode(F.sequence(F.col("rank"), F.lit(step - 1).cast("long"), F.greatest(F.col("n"), F.lit(1).cast("long")))).alias("slot")
    return ranked.select(F.col("batch_no").cast("int").alias("batch_no"), slots, "doc_id", "pos").withColumn("slot", F.col("slot").cast("int"))
