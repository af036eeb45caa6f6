"""Text features and model-free baselines."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from corpuslens.functions.draws import terms_of, words_of
from corpuslens.operators.ordered import earliest
from corpuslens.sources.scratch import settled

#: Grams that are sent to all tasks.
SENT = 100_000


def length_features(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Characters, words between blanks, and terms of each text."""
    return df.select(
        key, F.length("text").alias("char_count"), F.size(words_of(F.col("text"))).alias("word_count"), F.size(terms_of(F.col("text"))).alias("term_count")
    )


@F.pandas_udf(IntegerType())
def zlib_len(text: pd.Series) -> pd.Series:
    """Bytes of the zlib-compressed text; null counts as empty."""
    return text.map(lambda t: len(zlib.compress((t or "").encode()))).astype("int32")


def grams(terms: Column, n: int) -> Column:
    """All runs of 1..n terms, joined by a blank."""


    def runs(k: int) -> Column:
        # neighbours side by side, so that the terms are not looked up again for each run
        m = F.size(terms) - (k - 1)
        made = F.slice(terms, F.lit(1), m)
        for j in range(1, k):
            made = F.zip_with(made, F.slice(terms, F.lit(j + 1), m), lambda x, y: F.concat(x, F.lit(" "), y))
        return F.when(m > 0, made).otherwise(F.array().cast("array<string>"))

    return F.concat(terms, *[runs(k) for k in range(2, n + 1)])


#: Function words of English that may be left out.
STOP_WORDS = (
    "a about after all also an and any are as at be because been before being both but by can could did do does down each few for from had has have he her here him his how i if in into is it its "
    "just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until "
    "up very was we were what when where which while who whom why will with would you your"
).split()


def ngram_counts(df: DataFrame, n: int = 2, key: str = "doc_id", stop_words: list[str] = ()) -> DataFrame:
    """doc_id, gram, tf; ``stop_words`` are taken out before runs are formed."""
    terms = terms_of(F.col("text"))
    if stop_words:
        terms = F.filter(terms, lambda t: ~t.isin(list(stop_words)))
    rows = df.select(key, terms.alias("terms")).select(key, F.explode(grams(F.col("terms"), n)).alias("gram"))
    return rows.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, min_df: int | float = 2, max_features: int | None = None, n_docs: int | None = None) -> DataFrame:
    """gram, df, total of grams in at least ``min_df`` texts; the most frequent ``max_features``, ties by gram.

    A ``min_df`` below 1 is a share of ``n_docs`` texts."""
    least = min_df if min_df >= 1 else min_df * n_docs
    out = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= least)
    return earliest(out, [F.desc("total"), "gram"], max_features) if max_features else out


def tfidf(counts: DataFrame, vocab: DataFrame, n_docs: DataFrame, sublinear: bool = False, key: str = "doc_id") -> DataFrame:
    """doc_id, gram, w: tf times ln((1+N)/(1+df))+1, scaled to length one per text.

    ``n_docs`` is one row (column n).  A vocabulary of at most SENT grams is sent to the
    counts, so that a gram that most texts hold is not gathered in one task."""
    tf = F.lit(1.0) + F.log("tf") if sublinear else F.col("tf").cast("double")
    held = settled(vocab.select("gram", "df"), "vocabulary")
    few = held.limit(SENT + 1).count() <= SENT
    raw = counts.join(F.broadcast(held) if few else held, "gram").crossJoin(F.broadcast(n_docs))
    raw = raw.select(key, "gram", (tf * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0)).alias("raw"))
    size = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("size"))
    return raw.join(size, key).select(key, "gram", (F.col("raw") / F.col("size")).alias("w"))


def label_features(contexts: DataFrame, n: int = 3, k: int = 8, by: str = "feature_id") -> DataFrame:
    """The k most frequent n-grams (of 3 characters at least) in each feature's contexts: rank, gram, count."""
    words = words_of(F.lower("context"))
    rows = contexts.select(by, words.alias("w")).select(by, F.explode(grams(F.col("w"), n)).alias("gram")).filter(F.length("gram") >= 3)
    counts = rows.groupBy(by, "gram").agg(F.count(F.lit(1)).alias("count"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("count"), "gram"))
    return counts.withColumn("rank", place).filter(F.col("rank") <= k)
