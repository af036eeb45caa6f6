"""Exact deduplication with a heavy-hitter split.

1. Each row is reduced to (id, SHA-256 of its normalised text); only these
   narrow rows travel.
2. Misra-Gries summaries of the digests, one row a partition, are merged in a tree
   to one summary of at most ``counters`` digests, among them every digest held by
   more than ``n / counters`` rows.
3. These candidates are broadcast and counted exactly; those above the threshold are
   the verified winners.  They are broadcast and their rows are resolved on the map
   side, without a shuffle.
4. All other digests, none of which is frequent, go through an ordinary
   aggregate and join on the digest.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.store import settle, table

COUNTERS = 4096
#: Summaries merged by one task; three levels suffice for 4 million partitions.
FAN, LEVELS = 160, 3


def normalised(text):
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def cut_back(held: Counter, counters: int) -> Counter:
    """A summary with at most ``counters`` entries; what is taken off each keeps the guarantee."""
    if len(held) <= counters:
        return held
    cut = sorted(held.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in held.items() if v > cut})


def misra_gries(batches, counters: int) -> Counter:
    """Summary of a stream of value batches with at most ``counters`` entries.

    The batch is counted first and merged; subtracting the (counters+1)-th
    largest count keeps the guarantee: error <= n / (counters + 1)."""
    held: Counter = Counter()
    for values in batches:
        held.update(Counter(values))
        held = cut_back(held, counters)
    return held


def summary(digests: DataFrame, counters: int) -> DataFrame:
    """One row (g, digests, counts, n) for the whole table: its Misra-Gries summary and number of rows."""
    schema = "g long, digests array<binary>, counts array<long>, n long"

    def row(g: int, held: Counter, n: int) -> pd.DataFrame:
        return pd.DataFrame({"g": [g], "digests": [list(held)], "counts": [list(held.values())], "n": [n]})

    def local(batches):
        from pyspark import TaskContext

        seen = 0

        def values():
            nonlocal seen
            for pdf in batches:
                seen += len(pdf)
                yield pdf["digest"].tolist()

        held = misra_gries(values(), counters)
        if seen:
            yield row(TaskContext.get().partitionId(), held, seen)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        held: Counter = Counter()
        for keys, counts in zip(rows["digests"], rows["counts"], strict=True):
            held.update(dict(zip(keys, (int(c) for c in counts), strict=True)))
            held = cut_back(held, counters)
        return row(int(rows["g"].iloc[0]), held, int(rows["n"].sum()))

    merged = digests.select("digest").mapInPandas(local, schema)
    for _ in range(LEVELS):
        merged = merged.withColumn("g", F.floor(F.col("g") / FAN)).groupBy("g").applyInPandas(merge, schema)
    return merged


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Verified heavy digests: digest, keep_id, group_size (at most ``counters`` rows)."""
    merged = settle(summary(digests, counters), "exact-summary")  # one row
    n = merged.agg(F.sum("n")).first()[0] or 0
    candidates = merged.select(F.explode("digests").alias("digest"))
    # bounded: a summary holds at most `counters` digests of 32 bytes
    return (
        digests.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") > F.lit(n / counters))
    )


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Groups of equal normalised texts: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` has doc_id and text; other columns are ignored.  A null text counts
    as empty and groups with empty texts; rows with a null doc_id keep their place
    and form groups as any other (the smallest non-null id stays).  Repeated rows
    with the same doc_id and text give one output row each, all marked kept.  An
    empty table gives an empty result.
    """
    digests = settle(
        docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")), "exact-digests"
    )
    heavy = settle(frequent_digests(digests, counters), "exact-heavy")
    columns = ["doc_id", "digest", "keep_id", "group_size"]
    # bounded: at most `counters` rows of some 60 bytes pass the exact count
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    hot = marked.filter(F.col("group_size").isNotNull()).select(columns)
    cold = marked.filter(F.col("group_size").isNull()).select("doc_id", "digest")
    groups = cold.groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    rest = cold.join(groups.hint("merge"), "digest").select(columns)
    return hot.unionByName(rest).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for its text."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM n
"""
