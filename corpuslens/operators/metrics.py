"""Grouped classification metrics over long score tables.

Scores are first collapsed to distinct values with counts, and cumulative counts are
taken in value buckets: within a bucket by a window, across buckets by a table of
bucket totals.  One huge group is therefore never sorted by one task, and integer
arithmetic keeps the results exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.draws import r6

#: Value buckets per group; totals per group and bucket are the only serial part.
BUCKETS = 64


def bucketed(df: DataFrame, value: str, buckets: int = BUCKETS) -> DataFrame:
    """Add ``bucket``: the place of ``value`` among approximate quantiles of the whole table (one row, broadcast)."""
    cuts = df.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000).alias("cuts"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")


def cumulated(df: DataFrame, by: list[str], value: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Sums over all rows of the group that come before each distinct value (exclusive).

    ``df`` has one row per (by, value); ``sums`` maps new names to columns."""
    dealt = bucketed(df, value)
    order = F.desc(value) if descending else F.asc(value)
    before = Window.partitionBy(*by, "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "bucket").agg(*[F.sum(c).alias(f"{n}_t") for n, c in sums.items()])
    run = Window.partitionBy(*by).orderBy(F.desc("bucket") if descending else F.asc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "bucket", *[F.coalesce(F.sum(f"{n}_t").over(run), F.lit(0)).alias(f"{n}_o") for n in sums])
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{n}_l") for n, c in sums.items()])
    joined = local.join(offsets, [*by, "bucket"])
    return joined.select(*df.columns, *[(F.col(f"{n}_l") + F.col(f"{n}_o")).alias(n) for n in sums])


def _keyed(scores: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (scores, list(by)) if by else (scores.withColumn("all_rows", F.lit(0)), ["all_rows"])


def value_counts(scores: DataFrame, by: list[str], label: str = "label", value: str = "value", weight: str | None = None) -> DataFrame:
    """(by, value, n_pos, n_neg) of rows with a label and a score; ``weight`` counts a row so many times."""
    one = F.col(weight) if weight else F.lit(1)
    return (
        scores.filter(F.col(value).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(value).alias("value"))
        .agg(F.sum(F.when(F.col(label) == 1, one).otherwise(0)).alias("n_pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(one)).alias("n_neg"))
    )


def auroc(scores: DataFrame, by=(), label: str = "label", value: str = "value", weight: str | None = None) -> DataFrame:
    """Area under the ROC curve with ties as one half; 0.5 if a class is absent: by, n_pos, n_neg, auroc."""
    scores, keys = _keyed(scores, by)
    counts = cumulated(value_counts(scores, keys, label, value, weight), keys, "value", {"below": "n_neg"})
    area = F.sum(F.col("n_pos") * (2 * F.col("below") + F.col("n_neg")))
    out = counts.groupBy(*keys).agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), area.alias("u2"))
    both = F.col("n_pos") * F.col("n_neg")
    return out.select(
        *by, "n_pos", "n_neg", F.when(both > 0, F.col("u2").cast("double") / (2.0 * both)).otherwise(0.5).alias("auroc")
    )


def oriented(df: DataFrame, a: str = "auroc") -> DataFrame:
    """Add auroc_bi = max(a, 1-a) and sign (-1 only if the reverse is strictly better)."""
    return df.withColumn("auroc_bi", F.greatest(F.col(a), 1 - F.col(a))).withColumn("sign", F.when(1 - F.col(a) > F.col(a), -1).otherwise(1))


def roc_points(scores: DataFrame, by=(), label: str = "label", value: str = "value", weight: str | None = None) -> DataFrame:
    """One row per distinct score: threshold, tpr and fpr of "score >= threshold"."""
    scores, keys = _keyed(scores, by)
    counts = cumulated(value_counts(scores, keys, label, value, weight), keys, "value", {"tp": "n_pos", "fp": "n_neg"}, descending=True)
    totals = counts.groupBy(*keys).agg(F.sum("n_pos").alias("p"), F.sum("n_neg").alias("n"))
    share = lambda x, t: F.when(F.col(t) > 0, x.cast("double") / F.col(t)).otherwise(0.0)
    return counts.join(totals, keys).select(
        *by,
        F.col("value").alias("threshold"),
        share(F.col("tp") + F.col("n_pos"), "p").alias("tpr"),
        share(F.col("fp") + F.col("n_neg"), "n").alias("fpr"),
        (F.col("tp") + F.col("n_pos")).alias("tp"),
        (F.col("fp") + F.col("n_neg")).alias("fp"),
    )


def tpr_at(points: DataFrame, fpr: float) -> Column:
    """Largest true-positive rate among ROC points whose false-positive rate is at most ``fpr``."""
    return F.coalesce(F.max(F.when(points["fpr"] <= fpr, points["tpr"])), F.lit(0.0))


def tpr_at_fpr(scores: DataFrame, by=(), fprs=(0.001, 0.01, 0.05), label: str = "label", value: str = "value") -> DataFrame:
    """True-positive rates at the given false-positive rates; (0, 0) always counts."""
    points = roc_points(scores, by, label, value)
    names = [f"tpr_{str(f).replace('.', '_')}" for f in fprs]
    return points.groupBy(*by).agg(*[tpr_at(points, f).alias(n) for f, n in zip(fprs, names, strict=True)])


def _area(scores: DataFrame, by, weight: str | None = None) -> DataFrame:
    return auroc(scores, by, weight=weight).withColumnRenamed("auroc", "metric")


def _rate(fpr: float):
    def metric(scores: DataFrame, by, weight: str | None = None) -> DataFrame:
        points = roc_points(scores, by, weight=weight)
        return points.groupBy(*by).agg(F.max("tp").alias("n_pos"), F.max("fp").alias("n_neg"), tpr_at(points, fpr).alias("metric"))

    return metric


#: Metrics by name, for the bootstraps: (scores, by, weight) -> by, n_pos, n_neg, metric.
METRICS = {"auroc": _area, "tpr_at_0.1%": _rate(0.001), "tpr_at_1%": _rate(0.01), "tpr_at_5%": _rate(0.05)}


def youden(scores: DataFrame, by=(), label: str = "label", value: str = "value") -> DataFrame:
    """Threshold with the largest tpr - fpr; of equals the largest threshold."""
    points = roc_points(scores, by, label, value)
    j = F.col("tpr") - F.col("fpr")
    best = F.max(F.struct(F.round(j, 12).alias("j"), "threshold"))
    return points.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.threshold").alias("threshold"), F.col("b.j").alias("youden_j"))


def metric_card(scores: DataFrame, by=()) -> DataFrame:
    """AUROC, orientation and true-positive rates of every score."""
    area = oriented(auroc(scores, by))
    return area.join(tpr_at_fpr(scores, by, (0.01, 0.05)), list(by)) if by else area.crossJoin(tpr_at_fpr(scores, by, (0.01, 0.05)))


def impute(scores: DataFrame, by=(), value: str = "value") -> DataFrame:
    """Non-finite and null scores become the group's median of finite ones, or 0."""
    scores, keys = _keyed(scores, by)
    finite = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    medians = scores.groupBy(*keys).agg(F.percentile(finite, 0.5).alias("median"))
    return scores.join(medians, keys).withColumn(value, F.coalesce(finite, "median", F.lit(0.0))).drop("median", *([] if by else ["all_rows"]))


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Average rank of each distinct value: by, value, rank."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_same"))
    run = cumulated(counts, by, value, {"n_before": "n_same"})
    return run.select(*by, value, (F.col("n_before") + (F.col("n_same") + 1) / 2.0).alias(f"rank_{value}"))


def spearman(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Spearman and Pearson correlation of two columns, with the number of rows."""
    df, keys = _keyed(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), by)
    ranked = df.join(average_ranks(df, keys, x), [*keys, x]).join(average_ranks(df, keys, y), [*keys, y])
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(f"rank_{x}", f"rank_{y}").alias("rho"), F.corr(x, y).alias("pearson"))
    return out.select(*by, "n", "rho", "pearson")


def partial_spearman(df: DataFrame, x: str, y: str, z: str, by=()) -> DataFrame:
    """Spearman correlation of the ranks of x and y after a linear fit on the rank of z is taken out."""
    df, keys = _keyed(df, by)
    ranked = df
    for c in (x, y, z):
        ranked = ranked.join(average_ranks(df, keys, c), [*keys, c])
    rx, ry, rz = (f"rank_{c}" for c in (x, y, z))
    fit = ranked.groupBy(*keys).agg(
        F.regr_slope(rx, rz).alias("bx"), F.regr_intercept(rx, rz).alias("ax"), F.regr_slope(ry, rz).alias("b_y"), F.regr_intercept(ry, rz).alias("ay")
    )
    rest = ranked.join(fit, keys).select(
        *keys,
        F.round(F.col(rx) - F.col("ax") - F.col("bx") * F.col(rz), 9).alias("ex"),
        F.round(F.col(ry) - F.col("ay") - F.col("b_y") * F.col(rz), 9).alias("ey"),
    )
    return spearman(rest, "ex", "ey", by).select(*by, "n", F.col("rho").alias("partial_rho"))


def split_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two 0/1 columns: counts, agreement, precision, recall, F1."""
    c = df.agg(
        F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("tp"),
        F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("fp"),
        F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("fn"),
        F.count_if((F.col(a) == 0) & (F.col(b) == 0)).alias("tn"),
    )
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return c.select(
        "tp", "fp", "fn", "tn",
        r6((F.col("tp") + F.col("tn")) / F.greatest(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.lit(1))).alias("agreement"),
        r6(p).alias("precision"), r6(r).alias("recall"), r6(2 * p * r / F.greatest(p + r, F.lit(1e-9))).alias("f1"),
    )


def quartile_table(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows by quartile of x (right-open at p25, p50, p75): n, mean and population std of x and y."""
    cuts = df.agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    quarter = sum((F.col(x) >= F.col("q")[i]).cast("int") for i in range(3))
    return (
        df.crossJoin(F.broadcast(cuts))
        .groupBy(quarter.alias("quartile"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            r6(F.avg(x)).alias("mean_x"), r6(F.stddev_pop(x)).alias("std_x"), r6(F.avg(y)).alias("mean_y"), r6(F.stddev_pop(y)).alias("std_y"),
        )
    )


def score_histogram(scores: DataFrame, by: list[str], low: float, high: float, bins: int, value: str = "value") -> DataFrame:
    """Rows by equal-width bin (0: below, bins+1: at or above the end)."""
    place = F.when(F.col(value) < low, 0).when(F.col(value) >= high, bins + 1).otherwise(F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int") + 1)
    return scores.groupBy(*by, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
