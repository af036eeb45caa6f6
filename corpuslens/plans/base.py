"""Registry of queries, and the tables they share in Spark and SQL form.

Spark functions take (spark, sf_dir).  ``CTE`` holds the same tables as DuckDB common
table expressions; ``with_cte`` puts those that a twin names, and what they need, in front.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources.scratch import scratch, settled  # noqa: F401  shared by all plans

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def with_cte(sql: str) -> str:
    """SQL preceded by the common tables it uses, directly or through others."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in CTE:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(CTE[name])
                order.append(name)

    need(sql)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS ({CTE[n]})" for n in order)
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a query and its twin."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_cte(sql)
        return f

    return add


def u(*parts: str) -> str:
    """The SQL form of functions.draws.u01."""
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS UBIGINT) / 4294967296.0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark, sf_dir, label: str = "quality") -> DataFrame:
    """Labelled documents: doc_id, text, label."""
    own = table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("int").alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(own, "doc_id")


def acts(spark, sf_dir) -> DataFrame:
    """Vectors: doc_id, label, h (64 doubles)."""
    k = (F.lit(10.0) + F.col("vec_id") % 10) / 10.0
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        (F.col("label") < 5).cast("int").alias("label"),
        F.transform("embedding", lambda x: x.cast("double") * k).alias("h"),
    )


def layers(spark, sf_dir) -> DataFrame:
    """Vectors of three layers: layer, doc_id, label, h."""
    a = acts(spark, sf_dir)
    cut = lambda n, start, size: a.select(F.lit(n).alias("layer"), "doc_id", "label", F.slice("h", start, size).alias("h"))
    return cut(0, 1, 64).unionByName(cut(1, 1, 32)).unionByName(cut(2, 33, 32))


def dictionary(spark, sf_dir, seed: int = 0) -> DataFrame:
    """A tied dictionary: feature_id, w, b_enc (features 15, 31, ... are dead)."""
    return (
        table(spark, sf_dir, "embeddings")
        .filter((F.col("vec_id") >= 64 * seed) & (F.col("vec_id") < 64 * seed + 128))
        .select(
            (F.col("vec_id") - 64 * seed).cast("int").alias("feature_id"),
            F.transform("embedding", lambda x: x.cast("double")).alias("w"),
            F.when((F.col("vec_id") - 64 * seed) % 16 == 15, -5.0).otherwise(-0.3).alias("b_enc"),
        )
    )


def tokens(spark, sf_dir) -> DataFrame:
    """Words of documents: doc_id, pos (from 0), token."""
    from corpuslens.functions.draws import words_of

    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words_of(F.col("text"))).alias("pos", "token"))


_LP = "SELECT t.doc_id, t.pos, {token} AS token FROM tokens_t t"
CTE = {
    "pool_t": "SELECT doc_id, text, CAST(quality AS INTEGER) AS label FROM documents JOIN labels USING (doc_id)",
    "acts_t": "SELECT vec_id AS doc_id, CAST(label < 5 AS INTEGER) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (CAST(10 + vec_id % 10 AS DOUBLE) / 10)) AS h FROM embeddings",
    "layers_t": "SELECT 0 AS layer, doc_id, label, h FROM acts_t UNION ALL SELECT 1, doc_id, label, h[1:32] FROM acts_t UNION ALL SELECT 2, doc_id, label, h[33:64] FROM acts_t",
    "dim_t": "SELECT doc_id, label, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM acts_t",
    "dict_t": "SELECT CAST(vec_id AS INTEGER) AS feature_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w, CASE WHEN vec_id % 16 = 15 THEN -5.0::DOUBLE ELSE -0.3::DOUBLE END AS b_enc FROM embeddings WHERE vec_id < 128",
    "bdec_t": "SELECT list(m ORDER BY i) AS b FROM (SELECT i, avg(x) AS m FROM dim_t GROUP BY i)",
    "dk_t": "SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(x) FILTER (label = 1) - avg(x) FILTER (label = 0) AS m FROM dim_t GROUP BY i)",
    "codes_t": "SELECT * FROM (SELECT a.doc_id, a.label, d.feature_id, greatest(0, list_dot_product(d.w, list_transform(list_zip(a.h, b.b), lambda p: p[1] - p[2])) + d.b_enc) AS z FROM acts_t a, dict_t d, bdec_t b) WHERE z > 0",
    "recon_t": "SELECT a.doc_id, a.label, a.h, list_transform(list_zip(coalesce(r.r, list_transform(a.h, lambda x: 0.0::DOUBLE)), b.b), lambda p: p[1] + p[2]) AS r FROM acts_t a CROSS JOIN bdec_t b LEFT JOIN (SELECT doc_id, list(s ORDER BY i) AS r FROM (SELECT c.doc_id, d.i, sum(c.z * d.x) AS s FROM codes_t c JOIN (SELECT feature_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM dict_t) d USING (feature_id) GROUP BY ALL) GROUP BY doc_id) r USING (doc_id)",
    "tokens_t": "SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, CASE WHEN s = '' THEN [] ELSE string_split_regex(s, '\\s+') END AS w FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents))",
}
