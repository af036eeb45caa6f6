"""A corpus pipeline over the operators of ``corpuslens.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import exact_dedup, nearcopies, packing, secrets, toxicity
from corpuslens.llm.store import settle, table

#: Ids that are broadcast.
DROPPED = 200_000


def _keep(docs: DataFrame, judged: DataFrame, kept: Column) -> DataFrame:
    """Rows of ``docs`` without those whose doc_id is only in rows of ``judged`` that are not ``kept``.

    All rows of a doc_id stay if one of them does, so repeated rows and rows without an
    id (a key like others) are never lost.  Other columns may have any names.  Only ids are
    shuffled; the ids to drop are sent to the texts if they are at most DROPPED (of 8 bytes
    each), and joined else."""
    ids = judged.groupBy("doc_id").agg(F.max(kept).alias("stays")).filter(~F.col("stays")).select(F.col("doc_id").alias("dropped_id"))
    ids = settle(ids, "dropped")
    ids = F.broadcast(ids) if ids.limit(DROPPED + 1).count() <= DROPPED else ids.hint("merge")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["dropped_id"]), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject.

    The score is a function of the text, so it is applied where the rows are read.  Null and
    empty texts have no matches and stay; repeated rows are judged one by one."""
    lexicon, weights = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean_rows(docs, lexicon, weights)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts: the smallest doc_id.

    Null and empty texts are one group; rows that repeat the doc_id that stays all stay."""
    return _keep(docs, exact_dedup.exact_dedup(docs), F.col("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard similarity
    of at least 0.8): the smallest doc_id.

    SimHash links come first, MinHash bands add what they cannot reach; all pairs are
    verified.  Null, empty and blank texts are one component; rows that repeat the doc_id
    that stays all stay."""
    classes = nearcopies.near_copies(docs)
    return _keep(docs, classes, F.col("component_id").eqNullSafe(F.col("doc_id")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by ``[kind]``; n_chars follows the text.

    Findings are joined back to documents through the ledger's blobs.  Null and empty texts
    and repeated rows pass through."""
    versions = docs.select(F.col("doc_id").alias("version_id"), "text")
    findings = secrets.scan_versions(versions)[0].filter(F.size("kinds") > 0)
    return secrets.masked(docs, findings)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; repeated rows are packed once each."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: The toxicity stage is learned and the packing stage solves a program: no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
