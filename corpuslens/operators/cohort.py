"""Aggregation and checks over many run records.

Records are long: model, seed, metric, value (null: missing)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.draws import r6


def seed_summary(records: DataFrame, roster: DataFrame) -> DataFrame:
    """Per model and metric: n, mean, sample std (0 for one), min, max, values by seed, and missing seeds of the roster (model, seed)."""
    held = records.filter(F.col("value").isNotNull())
    s = held.groupBy("model", "metric").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("std"), r6(F.min("value")).alias("lowest"), r6(F.max("value")).alias("highest"),
        # millionths, as text is the same in every engine
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seed", F.round(F.col("value") * 1e6).cast("long").alias("v")))), lambda x: F.concat_ws(":", x["seed"], x["v"])), ",").alias("values_e6"),
    )
    wanted = roster.crossJoin(F.broadcast(held.select("metric").distinct()))  # one row per metric
    missing = wanted.join(held, ["model", "seed", "metric"], "left_anti").groupBy("model", "metric").agg(F.array_join(F.sort_array(F.collect_list("seed")), ",").alias("missing_seeds"))
    return s.join(missing, ["model", "metric"], "left").withColumn("missing_seeds", F.coalesce("missing_seeds", F.lit("")))


def prefer(primary: DataFrame, fallback: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The primary record's value, else the fallback's, and which it is."""
    a, b = primary.withColumnRenamed(value, "a").select(*keys, "a"), fallback.withColumnRenamed(value, "b").select(*keys, "b")
    return a.join(b, keys, "full").select(*keys, F.coalesce("a", "b").alias(value), F.when(F.col("a").isNotNull(), "primary").when(F.col("b").isNotNull(), "fallback").alias("origin"))


def cohort_delta(a: DataFrame, b: DataFrame, keys: list[str], threshold: float = 0.005) -> DataFrame:
    """Mean and std of the first summary less those of the second; MATERIAL from the threshold on, else NEGLIGIBLE."""
    x, y = a.select(*keys, F.col("mean").alias("ma"), F.col("std").alias("sa")), b.select(*keys, F.col("mean").alias("mb"), F.col("std").alias("sb"))
    d = F.col("ma") - F.col("mb")
    return x.join(y, keys).select(
        *keys, r6(d).alias("d_mean"), r6(F.abs(d)).alias("abs_d"), r6(F.col("sa") - F.col("sb")).alias("d_std"), F.when(F.round(F.abs(d), 6) >= threshold, "MATERIAL").otherwise("NEGLIGIBLE").alias("status")
    )


def materiality(deltas: DataFrame, by: list[str], metric: str = "metric") -> DataFrame:
    """by, verdict over all metrics (MATERIAL if any is), number of metrics, and the metrics that are, as reason."""
    over = F.array_sort(F.collect_list(F.when(F.col("status") == "MATERIAL", F.col(metric))))
    out = deltas.groupBy(*by).agg(F.count(F.lit(1)).alias("n_metrics"), F.array_join(over, ", ").alias("reason"))
    return out.withColumn("verdict", F.when(F.col("reason") == "", "NEGLIGIBLE").otherwise("MATERIAL"))


def noise_floor(summary: DataFrame) -> DataFrame:
    """Mean over the std between seeds; null if there is no spread."""
    return summary.select("model", "metric", "mean", "std", r6(F.when(F.col("std") > 0, F.col("mean") / F.col("std"))).alias("n_sigma"))


def outliers(records: DataFrame, z: float = 2.0) -> DataFrame:
    """Seeds further than z sample deviations from their model's mean."""
    w = Window.partitionBy("model", "metric")
    scored = records.withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0)))
    return scored.filter(F.abs("z") > z).select("model", "seed", "metric", r6("value").alias("value"), r6("z").alias("z"))


def sign_tally(records: DataFrame, by: str, test) -> DataFrame:
    """Positive cases of each group and over all, as counts and as text; the total's group is null."""
    t = records.rollup(by).agg(F.count_if(test).alias("k"), F.count(F.lit(1)).alias("n"))
    return t.withColumn("tally", F.format_string("%d/%d", "k", "n"))


def prior_comparison(summary: DataFrame, prior: DataFrame, keys: list[str], sigmas: float = 2.0) -> DataFrame:
    """Mean of a cohort against that of a prior one, in the cohort's deviations; outside beyond ``sigmas`` of them."""
    j = summary.join(prior.select(*keys, F.col("mean").alias("prior_mean")), keys)
    d = F.col("mean") - F.col("prior_mean")
    return j.select(*keys, "mean", "prior_mean", r6(d).alias("d_mean"), r6(F.when(F.col("std") > 0, d / F.col("std"))).alias("n_sigma"), F.coalesce(F.abs(d) > sigmas * F.col("std"), F.lit(False)).alias("outside"))


def grid_summary(cells: DataFrame, baseline: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """criterion, depth: mean and largest deviation from the seed's own baseline; stable if that stays below the tolerance."""
    d = cells.join(baseline.select("seed", "base"), "seed").withColumn("dev", F.col("value") - F.col("base"))
    out = d.groupBy("criterion", "depth").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("dev")).alias("mean_dev"), r6(F.max(F.abs("dev"))).alias("max_dev"))
    return out.withColumn("stable", F.col("max_dev") < tolerance)


def grid_verdict(grid: DataFrame, baseline: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """One row: largest deviation over the grid, and what the probes of the seeds (``probe`` of the baseline) say.

    ABSENT if all seeds are within [.45, .55], WEAK if none exceeds .60, else MIXED."""
    top = grid.agg(r6(F.max("max_dev")).alias("max_dev"))
    p = baseline.agg(F.min("probe").alias("probe_min"), F.avg("probe").alias("probe_mean"), F.max("probe").alias("probe_max"))
    verdict = F.when((F.col("probe_max") <= 0.55) & (F.col("probe_min") >= 0.45), "ABSENT").when(F.col("probe_max") <= 0.60, "WEAK").otherwise("MIXED")
    return top.crossJoin(p).select("max_dev", (F.col("max_dev") < tolerance).alias("stable"), r6("probe_min").alias("probe_min"), r6("probe_mean").alias("probe_mean"), r6("probe_max").alias("probe_max"), verdict.alias("verdict"))


def grid_flags(baseline: DataFrame) -> DataFrame:
    """seed, flags: probes outside [.45, .65], and reconstructions that separate better than the vectors."""
    odd = F.when((F.col("probe") < 0.45) | (F.col("probe") > 0.65), "probe out of range")
    rise = F.when(F.col("original") - F.col("recon") < 0, "reconstruction above original")
    return baseline.select("seed", F.concat_ws("; ", odd, rise).alias("flags")).filter("flags <> ''")


def quality_tier(records: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    return records.withColumn("tier", F.when(v >= 0.90, "strict").when(v >= 0.85, "permissive").otherwise("excluded"))


def wide_table(records: DataFrame, row: str, column: str, columns: list, value: str) -> DataFrame:
    """One row per ``row`` with a column for each named ``column`` value."""
    return records.groupBy(row).pivot(column, columns).agg(r6(F.first(value, ignorenulls=True)))


def wide_fields(records: DataFrame, row: str, column: str, columns: list, fields: list[str], final: str | None = None) -> DataFrame:
    """One row per ``row`` with a column ``field_value`` for each field and ``column`` value; only rows whose ``final`` is null count, if that is given."""
    own = records.filter(F.col(final).isNull()) if final else records
    of = lambda f, v: F.first(F.when(F.col(column) == v, F.col(f)), ignorenulls=True).alias(f"{f}_{v}")
    return own.groupBy(row).agg(*[of(f, v) for f in fields for v in columns])


def fixed(c, places: int) -> Column:
    """A double with so many places, rounded from its exact value as C and SQL do; Java's format rounds its shortest decimal form."""

    @F.pandas_udf("string")
    def shown(x: pd.Series) -> pd.Series:
        return x.map(lambda v: f"{v:.{places}f}")

    return shown(F.col(c).cast("double"))


def markdown(table: DataFrame, places: int = 4) -> DataFrame:
    """Each row as a line of a Markdown table, numbers with so many places; null shows as a dash."""
    shown = lambda c, t: fixed(c, places) if t in ("double", "float") else F.col(c).cast("string")
    cells = [F.when(F.col(c).isNull(), "-").otherwise(shown(c, t)) for c, t in table.dtypes]
    return table.select(F.col(table.columns[0]).alias("key"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def verify_claims(claims: DataFrame, metrics: DataFrame, tolerance: float = 0.002) -> DataFrame:
    """PASS within the tolerance, FAIL beyond it or if the metric is missing: label, status, actual, diff."""
    j = claims.join(metrics.select("path", F.col("value").alias("actual")), "path", "left")
    diff = F.abs(F.col("actual") - F.col("expected"))
    ok = F.round(diff, 9) <= F.coalesce(F.col("tol"), F.lit(tolerance))
    return j.select("label", r6("actual").alias("actual"), r6(diff).alias("diff"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("status"))


def claims_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if(F.col("status") == "PASS").alias("n_pass"), F.count(F.lit(1)).alias("n")).withColumn("ok", F.col("n_pass") == F.col("n"))


def validate_records(records: DataFrame, required: list[str], arrays: list[str], n: int | None = None) -> DataFrame:
    """key, problems: missing values, arrays of unequal length, or of another length than n."""
    tests = [F.when(F.col(c).isNull(), f"missing {c}") for c in required]
    tests += [F.when(F.size(arrays[0]) != F.size(c), f"{arrays[0]} and {c} differ in length") for c in arrays[1:]]
    if n is not None:
        tests.append(F.when(F.size(arrays[0]) != n, f"{arrays[0]} has not {n} entries"))
    return records.select("key", F.concat_ws("; ", *tests).alias("problems"))


def merge_intervals(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Newer intervals win; the old label stays."""
    o = old.select(key, "label", F.col("low").alias("ol"), F.col("high").alias("oh"))
    m = new.select(key, F.col("low").alias("nl"), F.col("high").alias("nh"))
    return o.join(m, key, "full").select(key, "label", r6(F.coalesce("nl", "ol")).alias("low"), r6(F.coalesce("nh", "oh")).alias("high"))


def drop_intervals(intervals: DataFrame, by: list[str], kind: str, first: str, second: str) -> DataFrame:
    """by, drop, low, high: value of kind ``first`` less that of ``second``, with a conservative interval, as half widths add up.

    ``intervals``: by, kind, value, low, high.  Rows that lack one of the kinds are left out."""
    of = lambda k, c: F.max(F.when(F.col(kind) == k, F.col(c)))
    half = lambda k: (of(k, "high") - of(k, "low")) / 2
    out = intervals.groupBy(*by).agg((of(first, "value") - of(second, "value")).alias("drop"), (half(first) + half(second)).alias("half")).filter("drop IS NOT NULL AND half IS NOT NULL")
    return out.select(*by, r6("drop").alias("drop"), r6(F.col("drop") - F.col("half")).alias("low"), r6(F.col("drop") + F.col("half")).alias("high"))


def latest_run(runs: DataFrame, by: list[str]) -> DataFrame:
    """The path of the run with the last name."""
    return runs.groupBy(*by).agg(F.max_by("path", "name").alias("path"), F.max("name").alias("name"))


#: Which checkpoint of a run with several is taken: the first by key, or that which changes perplexity least.
SELECT = ("first", "best_ppl")


def latest_checkpoint(checkpoints: DataFrame, by: list[str], select: str = "first", key: str | None = None) -> DataFrame:
    """by, name, key, path: a checkpoint of the run with the last name.

    ``checkpoints``: by, name, key (null: the run's only one), path, delta (change of
    perplexity, may be null).  A checkpoint without a key is taken if there is one, else the
    named ``key``, else by ``select``; a run without the key, or without any delta for ``best_ppl``,
    has a null path."""
    if select not in SELECT:
        raise ValueError(f"select is one of {SELECT}")
    last = checkpoints.groupBy(*by).agg(F.max("name").alias("name"))
    own = checkpoints.join(last, [*by, "name"])
    one = F.struct("key", "path")
    if key is not None:
        best = F.max(F.when(F.col("key") == key, one))
    elif select == "first":
        best = F.min_by(F.when(F.col("key").isNotNull(), one), F.col("key"))
    else:
        best = F.min(F.when(F.col("key").isNotNull() & F.col("delta").isNotNull(), F.struct(F.abs("delta").alias("size"), "key", "path")))
    chosen = own.groupBy(*by, "name").agg(F.max(F.when(F.col("key").isNull(), one)).alias("single"), best.alias("best"))
    pick = lambda c: F.when(F.col("single").isNotNull(), F.col(f"single.{c}")).otherwise(F.col(f"best.{c}"))
    return chosen.select(*by, "name", pick("key").alias("key"), pick("path").alias("path"))


def gate_cells(cells: DataFrame, gates: dict) -> DataFrame:
    """cell, passed, reasons: every gate (name: condition) that does not hold is named."""
    failed = F.concat_ws("; ", *[F.when(~F.coalesce(test, F.lit(False)), name) for name, test in gates.items()])
    return cells.select("cell", (failed == "").alias("passed"), failed.alias("reasons"))


#: The bounds of the gates of an ablation cell.
MIN_COSINE, ERROR_RATIO, MIN_ALIVE, PRIMARY_RANK, MIN_VARIANCE = 0.85, (0.01, 0.30), 100, 50, 0.10


def ablation_gates(cells: DataFrame, min_alive: int = MIN_ALIVE) -> DataFrame:
    """cell, passed, reasons of ablation cells (cell, recon_cos, err_ratio, alive, rank_eff, k, var_50).

    The share of variance in 50 directions counts at the primary rank only."""
    c = F.col
    gates = {
        "recon_cos": c("recon_cos") >= MIN_COSINE,
        "err_ratio": c("err_ratio").between(*ERROR_RATIO),
        "alive": c("alive") >= min_alive,
        "rank": c("rank_eff") > c("k"),
        "variance": (c("k") != PRIMARY_RANK) | (c("var_50") >= MIN_VARIANCE),
    }
    return gate_cells(cells, gates)


def decisive(cells: DataFrame) -> DataFrame:
    """cell, beats_random, beats_noise, beats_mask, passes: a drop (``delta``) against the controls.

    It must exceed those of 95 of 100 random bases and noises (auroc_h less their 5th
    percentile), and that of the masks by three deviations."""
    d, h = F.col("delta"), F.col("auroc_h")
    out = cells.select(
        "cell", (d > h - F.col("random_pct05")).alias("beats_random"), (d > h - F.col("noise_pct05")).alias("beats_noise"),
        (d > h - F.col("mask_mean") + 3 * F.col("mask_std")).alias("beats_mask"),
    )
    return out.withColumn("passes", F.col("beats_random") & F.col("beats_noise") & F.col("beats_mask"))
