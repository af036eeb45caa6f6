"""Reading and writing texts, labelled pools, run records and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_FIELDS = ("text", "content", "document")


def read_texts(spark: SparkSession, path: str, field: str | None = None, fields=TEXT_FIELDS) -> DataFrame:
    """doc_id, text, source from JSON lines: the given field, or the first that a row has.

    Lines that do not parse and blank texts are left out; doc_id is the file's own, or a
    hash of source and text."""
    names = [field] if field else list(fields)
    schema = "doc_id BIGINT, source STRING, _corrupt_record STRING, " + ", ".join(f"`{n}` STRING" for n in names)
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    text = F.coalesce(*[F.col(n) for n in names])
    source = F.coalesce("source", F.input_file_name())
    return (
        raw.filter(F.col("_corrupt_record").isNull())
        .select(F.col("doc_id"), text.alias("text"), source.alias("source"))
        .filter(F.length(F.trim("text")) > 0)
        .withColumn("doc_id", F.coalesce("doc_id", F.xxhash64("source", "text")))
    )


def labelled_pool(members: DataFrame, nonmembers: DataFrame) -> DataFrame:
    """doc_id, text, label: members are 1, non-members 0."""
    own = lambda df, k: df.select("doc_id", "text", F.lit(k).alias("label"))
    return own(members, 1).unionByName(own(nonmembers, 0))


def finite(c: str) -> Column:
    """Null for NaN and infinities, which JSON has no form for."""
    return F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; non-finite doubles become null.  Spark's commit makes the files appear at once."""
    cols = [finite(n).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary (few rows) as one JSON document ``{"rows": [...]}``; non-finite doubles become null."""
    cols = [finite(n).alias(n) if t in ("double", "float") else F.col(n) for n, t in summary.dtypes]
    one = summary.select(F.struct(*cols).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    one.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_records(spark: SparkSession, path: str, schema: str, fields: dict[str, str], multi_line: bool = False) -> DataFrame:
    """One row per nested record with the named dotted paths; missing values are null."""
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return raw.select(*[F.col(p).alias(n) for n, p in fields.items()])


def vector_manifest(acts: DataFrame, by: list[str], vector: str = "h") -> DataFrame:
    """Rows, length and an order-free digest of the vectors of each group.

    The digest adds up two halves of each row's MD5 (of doc_id and the components in
    millionths), so rows that repeat do not cancel out and any engine can compute it."""
    own = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.array_join(F.transform(vector, lambda x: F.round(x * 1e6).cast("long").cast("string")), ",")))
    part = lambda at: F.sum(F.conv(F.substring(own, at, 15), 16, 10).cast("decimal(38,0)"))
    return acts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d_model"), F.concat_ws("-", part(1).cast("string"), part(17).cast("string")).alias("digest"))


def pattern_scan(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """path, label, match: the first match of each pattern in each body that has one.

    Patterns are literals of the plan, one pass over the bodies, no join."""
    found = F.array(*[F.struct(F.lit(n).alias("label"), F.regexp_extract("body", p, 0).alias("match")) for n, p in patterns.items()])
    return files.select("path", F.explode(F.filter(found, lambda s: s["match"] != "")).alias("s")).select("path", "s.label", "s.match")
