"""Word models of corpora, and their application to words of texts.

Words are very unevenly frequent: one word may be a tenth of all places.  A model counts
its words, so those with more than one in FREQUENT of all places, at most FREQUENT of them, are
known; they are sent to the places, and only the places of other words are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.draws import words_of
from corpuslens.sources.scratch import settled

FREQUENT = 512
#: The same for models whose table is narrow: words with more than one in WIDE of all places are sent.
WIDE = 1 << 17
#: Ids that are sent to all tasks.
SENT = 1_000_000


def words_in(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, pos (from 0), token, prev (the word before, empty at a text's start) of every word."""
    w = F.col("w")
    before = F.when(F.size(w) > 0, F.concat(F.array(F.lit("")), F.slice(w, F.lit(1), F.size(w) - 1))).otherwise(w)
    rows = docs.select(*keep, words_of(F.col("text")).alias("w"))
    return rows.select(*keep, F.posexplode(F.arrays_zip(w.alias("token"), before.alias("prev"))).alias("pos", "t")).select(*keep, "pos", F.col("t.token").alias("token"), F.col("t.prev").alias("prev"))


def of_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is among ``ids``; few ids are sent to the texts, so that these stay where they are."""
    held = settled(ids.select(key).distinct(), "ids")
    few = held.limit(SENT + 1).count() <= SENT
    return docs.join(F.broadcast(held) if few else held, key, "left_semi")


def by_frequency(rows: DataFrame, table: DataFrame, key: str, size: str, how: str = "inner", share: int | None = None) -> DataFrame:
    """Join ``rows`` to a settled ``table`` of one row for each key, whose column ``size`` counts how often it is met."""
    total = table.agg(F.sum(size)).first()[0] or 0
    share = share or FREQUENT
    often = table.filter(F.col(size) > total / share)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(table.filter(F.col(size) <= total / share), key, how)
    return rows.join(F.broadcast(often), key).unionByName(rest)


def unigram(words: DataFrame, smooth: bool = False) -> DataFrame:
    """token, c, logp of a settled unigram model; with ``smooth`` the unseen word has ln(1 / (total + kinds)), column unseen."""
    counts = settled(words.groupBy("token").agg(F.count(F.lit(1)).alias("c")), "counts")
    total = counts.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))  # one row
    add = 1 if smooth else 0
    base = F.col("total") + (F.col("kinds") if smooth else F.lit(0))
    return settled(counts.crossJoin(F.broadcast(total)).select("token", "c", F.log((F.col("c") + add) / base).alias("logp"), F.log(F.lit(1.0) / base).alias("unseen")), "unigram")


def conditions(docs: DataFrame) -> DataFrame:
    """token, c, orig, lower, ref: the log-probability of each word of ``docs`` (text, lang), of its lower-cased form, and in English texts with add-one counts; settled.

    The words are counted once; the three models are sums over their table."""
    words = words_in(docs, ("lang",))
    counts = settled(words.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("lang") == "en").alias("c_ref")), "counts").withColumn("low", F.lower("token"))
    total = counts.agg(F.sum("c").alias("total"), (F.sum("c_ref") + F.count_if(F.col("c_ref") > 0)).alias("base"))  # one row
    low = counts.groupBy("low").agg(F.sum("c").alias("c_low"))
    logp = [F.log(F.col("c") / F.col("total")).alias("orig"), F.log(F.col("c_low") / F.col("total")).alias("lower"), F.log((F.col("c_ref") + 1) / F.col("base")).alias("ref")]
    return settled(counts.join(low, "low").crossJoin(F.broadcast(total)).select("token", "c", *logp), "conditions")


def scored(words: DataFrame, model: DataFrame, share: int | None = None) -> DataFrame:
    """``words`` (with a column token) with their logp; words that the model does not know have its ``unseen``."""
    floor = model.agg(F.max("unseen").alias("floor"))  # one row
    found = by_frequency(words, model.select("token", "c", "logp"), "token", "c", "left", share)
    return found.crossJoin(F.broadcast(floor)).withColumn("logp", F.coalesce("logp", "floor")).drop("floor", "c")


def bigram(places: DataFrame) -> DataFrame:
    """prev, token, n_prev, logp of a settled bigram model: the vocabulary of a place is what follows its preceding word anywhere.

    A place's distribution depends on that word only, so statistics are taken once a word
    and then joined to the places; successors are never listed for each place."""
    pairs = settled(places.groupBy("prev", "token").agg(F.count(F.lit(1)).alias("c")), "pairs")
    total = settled(pairs.groupBy("prev").agg(F.sum("c").alias("n_prev")), "totals")
    return settled(by_frequency(pairs, total, "prev", "n_prev").select("prev", "token", "n_prev", F.log(F.col("c") / F.col("n_prev")).alias("logp")), "bigram")


def at_places(places: DataFrame, table: DataFrame, model: DataFrame) -> DataFrame:
    """``places`` with what ``table`` (one row for each prev) says of the word before."""
    sizes = model.groupBy("prev").agg(F.max("n_prev").alias("n_prev"))
    return by_frequency(places, settled(table.join(sizes, "prev"), "by-word"), "prev", "n_prev").drop("n_prev")
