"""Secret scanning with an incremental ledger of blobs.

Every version of every path is reduced to a content address (SHA-256 of its text).
The ledger is a stored table of the (blob, rule version) pairs scanned so far and what
was found.  A run scans each blob that the ledger does not hold under the current rules
once, whatever number of paths and versions share it, appends it to the ledger, and joins
findings back to all of them.  A rule set's version follows from its content, so changed
rules never find an old blob scanned.

Texts move only to be scanned: if the unseen blobs are few, as when a known corpus has
grown a little, their ids are broadcast to the texts; if they are many, the texts are
joined to them.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.arrays import small_batches
from corpuslens.llm.store import fresh_path, settle, table, unused

#: Kind, pattern, the group whose length counts, least length.
RULES = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The same matches, found faster: a run that is too short is passed over at once.
FASTER = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


def rule_version(rules) -> str:
    """Name of a rule set by its content."""
    return hashlib.sha256(repr(tuple(map(tuple, rules))).encode()).hexdigest()[:16]


RULE_VERSION = rule_version(RULES)

#: Up to so many unseen blobs, or versions with findings (of SPANS spans in all), are broadcast.
BROADCAST_ROWS, SPANS = 10_000, 100_000

LEDGER = "blob binary, rule_version string, kinds array<string>, starts array<int>, ends array<int>"
KEYWORD = re.compile(r"(?ai:passw|secret|token|api_?key)")


def scan(text: str, rules=RULES) -> list[tuple[int, int, str]]:
    """Spans (start, rule number, end) of all kinds in code points, in order of start, then rule.

    Matches of one kind are leftmost and do not overlap; those whose group is too
    short are dropped after matching."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(rules):
        own = (kind, pattern, group, least) in RULES  # fast forms hold for the built-in rules only
        if own and kind == "access" and "AKIA" not in text:
            continue
        if own and kind == "assign" and ("=" not in text and ":" not in text or not KEYWORD.search(text)):
            continue
        for m in re.finditer(FASTER.get(kind, pattern) if own else pattern, text):
            if len(m.group(group)) >= least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def scan_blobs(blobs: DataFrame, rules=RULES, version: str | None = None) -> DataFrame:
    """Ledger rows for blobs (columns blob, text)."""
    names = [r[0] for r in rules]
    version = version or rule_version(rules)

    def run(batches):
        for batch in small_batches(batches):
            found = [scan(t or "", rules) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([version] * len(found), pa.string()),
                    pa.array([[names[k] for _, k, _ in f] for f in found], pa.list_(pa.string())),
                    pa.array([[s for s, _, _ in f] for f in found], pa.list_(pa.int32())),
                    pa.array([[e for _, _, e in f] for f in found], pa.list_(pa.int32())),
                ],
                ["blob", "rule_version", "kinds", "starts", "ends"],
            )

    return blobs.select("blob", "text").mapInArrow(run, LEDGER)


def open_ledger(spark: SparkSession, uri: str) -> DataFrame:
    """The ledger stored at ``uri``; an empty one is begun if there is none."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(uri)
    return spark.read.schema(LEDGER).parquet(uri)


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, version: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Scan a table of versions (columns version_id, text) against a ledger.

    ``version_id`` names one version of one path.  Returns the findings (version_id,
    blob, kinds, starts, ends; one row per row of ``versions``, repeated rows and null
    ids included) and the new rows of the ledger, settled.  Null texts count as empty;
    other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    version = version or rule_version(rules)
    address = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob")
    addressed = settle(versions.select("version_id", address), "blob-addresses")
    blobs = addressed.groupBy("blob").agg(F.min("version_id").alias("version_id"))
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == version).select("blob").distinct()
        blobs = blobs.join(known.hint("merge"), "blob", "left_anti")
    # one holder of each unseen blob
    holders = settle(blobs.select(F.col("blob").alias("b"), F.col("version_id").alias("v")), "unseen")
    few = holders.limit(broadcast_rows + 1).count() <= broadcast_rows
    texts = versions.select("version_id", "text", address)
    wanted = F.broadcast(holders) if few else holders.hint("merge")
    held = texts.join(wanted, F.col("version_id").eqNullSafe(F.col("v")) & (F.col("blob") == F.col("b")), "left_semi")
    new = settle(scan_blobs(held, rules, version).dropDuplicates(["blob"]), "ledger-rows")
    seen = new if ledger is None else new.unionByName(ledger.filter(F.col("rule_version") == version))
    hits = seen.filter(F.size("kinds") > 0).select("blob", "kinds", "starts", "ends").dropDuplicates(["blob"])
    empty = F.array()
    findings = addressed.join(hits.hint("merge"), "blob", "left").select(
        "version_id",
        "blob",
        F.coalesce("kinds", empty.cast("array<string>")).alias("kinds"),
        F.coalesce("starts", empty.cast("array<int>")).alias("starts"),
        F.coalesce("ends", empty.cast("array<int>")).alias("ends"),
    )
    return findings, new


def update(versions: DataFrame, uri: str, rules=RULES) -> DataFrame:
    """Findings of all versions (columns version_id, text), by way of the ledger stored at ``uri``, which learns the unseen blobs.

    A run that ends early leaves the ledger as it was, or with its rows appended; blobs
    scanned by two runs at once count once."""
    spark = versions.sparkSession
    findings, new = scan_versions(versions, open_ledger(spark, uri), rules)
    new.write.mode("append").parquet(uri)
    return findings


def masked(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; n_chars, if there, follows.

    ``findings`` are rows of :func:`scan_versions` (version_id: doc_id).  Overlapping
    spans are replaced as one, named after the first.  Other columns, whatever their
    names, pass through; null and empty texts stay as they are."""
    found = unused(docs, "found")
    distinct = settle(findings.dropDuplicates(["version_id", "blob"]), "findings")
    n, spans = distinct.agg(F.count(F.lit(1)), F.sum(F.size("kinds"))).first()
    own = distinct.select(F.struct("version_id", "blob", "kinds", "starts", "ends").alias(found))
    own = F.broadcast(own) if n <= BROADCAST_ROWS and (spans or 0) <= SPANS else own.hint("merge")
    address = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    names = docs.columns
    joined = docs.join(own, docs["doc_id"].eqNullSafe(own[found]["version_id"]) & (address == own[found]["blob"]), "left")
    columns_ = [F.col(found)[c].alias(unused(docs, c)) for c in ("kinds", "starts", "ends")]
    kinds, starts, ends = (unused(docs, c) for c in ("kinds", "starts", "ends"))

    def replace(batches):
        for batch in small_batches(batches):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            out = columns["text"].to_pylist()
            hit = [i for i, k in enumerate(columns[kinds].to_pylist()) if k]
            for i in hit:
                text, at, parts = out[i], 0, []
                for kind, a, b in zip(*(columns[c][i].as_py() for c in (kinds, starts, ends)), strict=True):
                    if a >= at:
                        parts += [text[at:a], f"[{kind}]"]
                    at = max(at, b)
                out[i] = "".join([*parts, text[at:]])
            columns["text"] = pa.array(out, columns["text"].type)
            if "n_chars" in columns and hit:
                sizes = columns["n_chars"].to_pylist()
                for i in hit:
                    sizes[i] = len(out[i])
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return joined.select(*names, *columns_).mapInArrow(replace, docs.schema)


def digest_columns(findings: DataFrame) -> DataFrame:
    """Counts by kind and the joined spans of findings."""
    spans = F.array_join(
        F.transform(
            F.arrays_zip("kinds", "starts", "ends"),
            lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")),
        ),
        ",",
    )
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return findings.select(
        F.col("version_id").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
    )


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every row of ``documents``, each distinct text scanned once, by way of a stored ledger.

    The ledger decides what is scanned, so the spans are the base spans."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), "text")
    return digest_columns(update(docs, fresh_path(spark, "ledger")))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, 'assign' AS kind, 0 AS no, 6 AS least,
         regexp_split_to_array(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS p,
         regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS f,
         regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS g FROM t
  UNION ALL
  SELECT doc_id, 'access', 1, 20, regexp_split_to_array(t, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}') FROM t
  UNION ALL
  SELECT doc_id, 'hex', 2, 24, regexp_split_to_array(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}') FROM t
), u AS (SELECT doc_id, kind, no, least, p, f, g, unnest(range(1, len(f) + 1)) AS i FROM m WHERE len(f) > 0),
s AS (
  SELECT doc_id, kind, no, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS a, length(f[i]) AS n
  FROM u WHERE length(g[i]) >= least
), d AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, no) AS spans
  FROM s GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN d USING (doc_id)
"""
