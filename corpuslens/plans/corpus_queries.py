"""Queries of sources, corpus hygiene and text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.draws import r6, u01, words_of
from corpuslens.operators import corpus as C
from corpuslens.operators import textfeat as X
from corpuslens.plans.base import layers, pool, query, scratch, table, tokens, u
from corpuslens.sources import texts as S
from corpuslens.sources.trees import tree_scan

STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
KEY = rf"substr(regexp_replace({STRIP}, '\s+', ' ', 'g'), 1, 4096)"
WORDS = rf"(CASE WHEN {STRIP} = '' THEN [] ELSE string_split_regex({STRIP}, '\s+') END)"
TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


@query("a1_read_texts", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE length(trim(text)) > 0")
def a1(spark, d):
    """Texts written as JSON lines under three field names, with bad lines, and read again."""
    docs = table(spark, d, "documents")
    path = scratch(spark, "jsonl")
    on = lambda k: F.when(F.col("doc_id") % 3 == k, F.col("text"))
    good = F.to_json(F.struct("doc_id", "source", on(0).alias("text"), on(1).alias("content"), on(2).alias("document")))
    bad = F.when(F.col("doc_id") % 10 == 0, F.lit('{"text": ')).when(F.col("doc_id") % 10 == 1, F.lit('{"text": "  "}'))
    docs.select(F.explode(F.array_compact(F.array(good, bad))).alias("value")).write.text(path)
    return S.read_texts(spark, path).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("a2_labelled_pool", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n, CAST(label AS INTEGER) AS label FROM pool_t")
def a2(spark, d):
    p = pool(spark, d)
    return S.labelled_pool(p.filter("label = 1"), p.filter("label = 0")).select("doc_id", F.length("text").alias("n"), "label")


@query("a3_sample_n", f"SELECT doc_id FROM documents ORDER BY {u('11', 'doc_id')}, doc_id LIMIT 100")
def a3(spark, d):
    return C.sample_n(table(spark, d, "documents").select("doc_id"), 100, 11)


@query("a4_read_records", "SELECT doc_id, CAST(n_chars AS DOUBLE) AS size, lang, CAST(NULL AS DOUBLE) AS missing FROM documents")
def a4(spark, d):
    """Nested records written as JSON and flattened by dotted paths."""
    path = scratch(spark, "records")
    table(spark, d, "documents").select(
        "doc_id", F.struct(F.struct(F.col("n_chars").cast("double").alias("size")).alias("inner"), "lang").alias("meta")
    ).write.json(path)
    schema = "doc_id BIGINT, meta STRUCT<inner: STRUCT<size: DOUBLE, missing: DOUBLE>, lang: STRING>"
    return S.read_records(spark, path, schema, {"doc_id": "doc_id", "size": "meta.inner.size", "lang": "meta.lang", "missing": "meta.inner.missing"})


@query("a5_write_jsonl", "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE round(value, 6) END AS value FROM events")
def a5(spark, d):
    """Non-finite values become null in JSON."""
    path = scratch(spark, "summary")
    odd = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.round("value", 6))
    S.write_jsonl(table(spark, d, "events").select("event_id", odd.alias("value")), path)
    return spark.read.schema("event_id BIGINT, value DOUBLE").json(path)


@query("a5_write_summary", "SELECT lang, count(*) AS n_docs, round(avg(n_chars), 3) AS mean_chars, CAST(NULL AS DOUBLE) AS odd FROM documents GROUP BY lang")
def a5s(spark, d):
    """A summary table as one JSON document, read back."""
    path = scratch(spark, "summary")
    own = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n_chars"), 3).alias("mean_chars"), F.lit(float("nan")).alias("odd"))
    S.write_summary(own, path)
    back = spark.read.schema("rows ARRAY<STRUCT<lang: STRING, n_docs: BIGINT, mean_chars: DOUBLE, odd: DOUBLE>>").json(path)
    return back.select(F.explode("rows").alias("r")).select("r.*")


@query(
    "a6_vector_manifest",
    """WITH m AS (SELECT layer, label, len(h) AS d, md5(concat_ws('|', doc_id, array_to_string(list_transform(h, lambda x: CAST(round(x * 1e6) AS BIGINT)), ','))) AS m FROM layers_t)
    SELECT layer, label, count(*) AS n, CAST(max(d) AS INTEGER) AS d_model, CAST(sum(CAST(('0x' || m[1:15]) AS HUGEINT)) AS VARCHAR) || '-' || CAST(sum(CAST(('0x' || m[17:31]) AS HUGEINT)) AS VARCHAR) AS digest FROM m GROUP BY ALL""",
)
def a6(spark, d):
    return S.vector_manifest(layers(spark, d), ["layer", "label"])


PATTERNS = {"mail": r"[A-Za-z0-9_.]+@[a-z0-9]+\.[a-z]+", "link": r"http://[a-z0-9.]+", "page": r"page=[0-9]+"}


@query(
    "a7_pattern_scan",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT page_id AS path, '{n}' AS label, regexp_extract(html, '{p}') AS match FROM pages" for n, p in PATTERNS.items()) + ") WHERE match <> ''",
)
def a7(spark, d):
    return S.pattern_scan(table(spark, d, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("body")), PATTERNS)


EXTENSIONS, VENDOR = ["txt"], "area=vendor"


@query(
    "a7_tree_scan",
    "WITH f AS (SELECT page_id // 50 AS folder, string_agg(coalesce(html, ''), chr(10) ORDER BY page_id) AS body FROM pages WHERE page_id % 5 <> 0 GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT * FROM (SELECT 'area=site/folder=' || folder AS place, '{n}' AS label, regexp_extract(body, '{p}') AS match FROM f) WHERE match <> ''" for n, p in PATTERNS.items()),
)
def a7t(spark, d):
    """Pages written as a tree of text files, one folder excluded and one extension left out, and scanned."""
    root = scratch(spark, "tree")
    area = F.when(F.col("page_id") % 5 == 0, "vendor").otherwise("site").alias("area")
    pages = table(spark, d, "pages").select(area, F.floor(F.col("page_id") / 50).alias("folder"), "page_id", F.coalesce("html", F.lit("")).alias("value"))
    dealt = pages.repartition("area", "folder").sortWithinPartitions("area", "folder", "page_id").drop("page_id")
    dealt.write.partitionBy("area", "folder").text(root)
    dealt.select("area", "folder", F.col("value").alias("other")).write.mode("append").partitionBy("area", "folder").json(root)
    found = tree_scan(spark, root, PATTERNS, EXTENSIONS, [VENDOR])
    return found.select(F.regexp_extract("path", r"(area=\w+/folder=\d+)/[^/]+$", 1).alias("place"), "label", "match")


@query("b1_clean_texts", f"SELECT doc_id, md5(substr({STRIP}, 1, 500)) AS h FROM documents WHERE length({STRIP}) >= 20")
def b1(spark, d):
    return C.clean_texts(table(spark, d, "documents").select("doc_id", "text"), 20, 500).select("doc_id", F.md5("text").alias("h"))


@query("b2_filter_texts", f"SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents WHERE length({STRIP}) >= 200")
def b2(spark, d):
    return C.filter_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.length("text").alias("n"))


@query("b3_dedupe_key", f"SELECT doc_id, md5({KEY}) AS key FROM documents")
def b3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(C.dedupe_key()).alias("key"))


@query("b4_dedupe_exact", f"SELECT md5({KEY}) AS digest, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1")
def b4(spark, d):
    return C.dedupe_exact(table(spark, d, "documents"))


def window_sql(stream: str, window: int) -> str:
    """Rows of ``stream`` (k from 1, doc_id, d, reset) that are accepted, one after the other."""
    return f"""WITH RECURSIVE s AS MATERIALIZED ({stream}), f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS doc_id, false AS fresh, CAST([] AS VARCHAR[]) AS q UNION ALL
    SELECT k, doc_id, fresh, CASE WHEN fresh THEN list_slice(list_append(q, d), greatest(1, len(q) + 2 - {window}), len(q) + 1) ELSE q END FROM (
    SELECT k, doc_id, d, q, NOT list_contains(q, d) AS fresh FROM (SELECT s.k, s.doc_id, s.d, CASE WHEN s.reset THEN [] ELSE f.q END AS q FROM f JOIN s ON s.k = f.k + 1)))
    SELECT doc_id, k - 1 AS place FROM f WHERE fresh"""


@query("b5_dedupe_window", window_sql(f"SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, md5({KEY}) AS d, false AS reset FROM documents", 100))
def b5(spark, d):
    return C.dedupe_window(table(spark, d, "documents").select("doc_id", "text"), 100).select("doc_id", "place")


@query("b5_dedupe_window_reset", window_sql(f"SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, md5({KEY}) AS d, doc_id % 400 = 0 AS reset FROM documents", 1000))
def b5r(spark, d):
    """A long memory that is cleared before every 400th document, as at the start of a cycle."""
    return C.dedupe_window(table(spark, d, "documents").select("doc_id", "text"), 1000, reset=F.col("doc_id") % 400 == 0).select("doc_id", "place")


WEIGHTS = {"en": 0.5, "fr": 0.3, "de": 0.2, "es": 0.0}


@query(
    "b6_mix_sources",
    f"""WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), w AS (SELECT * FROM (VALUES ('en', 0.5::DOUBLE), ('fr', 0.3::DOUBLE), ('de', 0.2::DOUBLE)) v(lang, w))
    SELECT doc_id, lang, round(time, 6) AS time FROM (SELECT doc_id, lang, {u('3', 'doc_id')} * n / w AS time FROM documents JOIN s USING (lang) JOIN w USING (lang)) ORDER BY time, doc_id LIMIT 200""",
)
def b6(spark, d):
    return C.mix_sources(table(spark, d, "documents").select("doc_id", "lang"), WEIGHTS, 200, 3, "lang").select("doc_id", "lang", r6("time").alias("time"))


@query(
    "b6_mix_cycle",
    f"""WITH c AS (SELECT 2 * count(*) AS n FROM documents), s AS (SELECT lang, count(*) AS n_s, w, lang <> 'en' AS again FROM documents JOIN (SELECT * FROM (VALUES ('en', 0.5::DOUBLE), ('fr', 0.3::DOUBLE), ('de', 0.2::DOUBLE)) v(lang, w)) USING (lang) GROUP BY lang, w),
    t AS (SELECT (max(c.n) + sum(n_s) FILTER (again)) / sum(w) FILTER (again) AS until FROM s, c), r AS (SELECT *, unnest(range(CASE WHEN again THEN CAST(ceil(until * w / n_s) AS BIGINT) ELSE 1 END)) AS cycle FROM s, t),
    e AS (SELECT doc_id, lang, CAST(cycle AS INTEGER) AS cycle, (cycle + {u('3 + cycle', 'doc_id')}) * n_s / w AS time, until FROM documents JOIN r USING (lang))
    SELECT doc_id, lang, cycle, round(time, 6) AS time FROM (SELECT * FROM e WHERE time <= until ORDER BY time, doc_id, cycle LIMIT (SELECT n FROM c))""",
)
def b6c(spark, d):
    """Twice as many rows as there are documents: two sources begin anew as often as needed, the third is used up."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return C.mix_sources(docs, WEIGHTS, 2 * docs.count(), 3, "lang", cycle=("fr", "de")).select("doc_id", "lang", "cycle", r6("time").alias("time"))


@query("b7_seeded_shuffle", f"SELECT doc_id, {u('6', 'doc_id')} AS place FROM documents")
def b7(spark, d):
    return C.seeded_shuffle(table(spark, d, "documents").select("doc_id"), 5, 1).select("doc_id", u01(F.lit(6), F.col("doc_id")).alias("place"))


@query("b8_limit_after", f"SELECT doc_id FROM documents WHERE length({STRIP}) >= 200 ORDER BY doc_id LIMIT 150")
def b8(spark, d):
    return C.filter_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id").orderBy("doc_id").limit(150)


CAND = rf"""cand AS (SELECT doc_id, sha256(text) AS sha256, length(text) BETWEEN 620 AND 1024 AS in_window FROM documents ANTI JOIN labels USING (doc_id) WHERE length({STRIP}) >= 200),
own AS (SELECT DISTINCT sha256(text) AS sha256 FROM documents JOIN labels USING (doc_id)),
chosen AS (SELECT sha256, min(doc_id) AS doc_id FROM cand WHERE in_window AND sha256 NOT IN (SELECT sha256 FROM own) GROUP BY sha256),
picked AS (SELECT * FROM chosen ORDER BY {u('9', 'doc_id')}, doc_id LIMIT 50)"""


def _split(spark, d):
    docs, own = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels").select("doc_id")
    return docs.join(own, "doc_id", "left_anti"), docs.join(own, "doc_id", "left_semi")


@query("b9_disjoint_partition", f"WITH {CAND} SELECT sha256, doc_id FROM picked")
def b9(spark, d):
    stream, own = _split(spark, d)
    return C.disjoint_partition(stream, own, 50, seed=9)


@query(
    "b10_disjointness_proof",
    f"""WITH {CAND} SELECT count(*) AS n_stream, count(*) FILTER (NOT in_window) AS n_length_rejects,
    count(*) FILTER (in_window AND sha256 IN (SELECT sha256 FROM own)) AS n_collisions,
    (SELECT count(*) FROM picked WHERE sha256 IN (SELECT sha256 FROM own)) AS n_intersection, '' AS examples,
    (SELECT count(*) FROM own) AS n_pool, (SELECT count(*) FROM picked) AS n_selected FROM cand""",
)
def b10(spark, d):
    stream, own = _split(spark, d)
    return C.disjointness_proof(C.disjoint_partition(stream, own, 50, seed=9), own, stream)


@query(
    "b11_splits",
    f"""SELECT doc_id, label, CAST((rn - 1) % 5 AS INTEGER) AS fold, rn - 1 < round_even(n * 0.7, 0) AS in_a FROM (
    SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {u('4', 'doc_id')}, doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM pool_t)""",
)
def b11(spark, d):
    p = pool(spark, d).select("doc_id", "label")
    return C.split_exact(C.stratified_folds(p, "label", 5, 4), "label", 0.7, 4).select("doc_id", "label", "fold", "in_a")


@query(
    "b12_crop_tokens",
    f"""WITH w AS (SELECT doc_id, {WORDS} AS ids FROM documents), s AS (SELECT *, CASE WHEN len(ids) > 64 THEN CAST(floor({u('8', 'doc_id')} * (len(ids) - 63)) AS INTEGER) ELSE 0 END AS start FROM w)
    SELECT doc_id, start, least(len(ids), 64) AS n_kept, md5(array_to_string(ids[start + 1:start + 64], ' ')) AS h FROM s""",
)
def b12(spark, d):
    ids = table(spark, d, "documents").select("doc_id", words_of(F.col("text")).alias("ids"))
    kept = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    return C.crop_tokens(ids, 64, True, 8).select(
        "doc_id", "start", kept.cast("long").alias("n_kept"), F.md5(F.array_join(F.slice("ids", F.lit(1), kept), " ")).alias("h")
    )


@query("b12_pad_stats", f"SELECT count(*) AS n, CAST(sum(least(len(w), 64)) AS BIGINT) AS n_tokens, CAST(sum(greatest(64 - len(w), 0)) AS BIGINT) AS n_pad FROM (SELECT {WORDS} AS w FROM documents)")
def b12p(spark, d):
    n = F.size(words_of(F.col("text")))
    return table(spark, d, "documents").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.least(n, F.lit(64))).alias("n_tokens"), F.sum(F.greatest(64 - n, F.lit(0))).alias("n_pad")
    )


@query(
    "b13_shuffle_windows",
    f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
    e AS (SELECT doc_id, len(w) AS n, w, unnest(range(len(w))) AS i FROM w),
    g AS (SELECT *, i // 4 AS g, CAST(floor({u('2', 'doc_id', 'i // 4')} * 6) AS INTEGER) AS o FROM e),
    m AS (SELECT doc_id, i, w[1 + (CASE WHEN i % 4 = 3 OR g * 4 + 3 > n THEN i ELSE g * 4 + [[0,1,2],[0,2,1],[1,0,2],[1,2,0],[2,0,1],[2,1,0]][o + 1][i % 4 + 1] END)] AS t FROM g)
    SELECT doc_id, md5(coalesce(string_agg(t, ' ' ORDER BY i), '')) AS h FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id""",
)
def b13(spark, d):
    return C.shuffle_windows(table(spark, d, "documents").select("doc_id", "text"), 2).select("doc_id", F.md5("text").alias("h"))


@query(
    "b14_neighbours",
    f"""WITH w AS (SELECT doc_id, text, {WORDS} AS w FROM documents), n AS (SELECT *, unnest([0, 1, 2]) AS nb FROM w),
    e AS (SELECT doc_id, nb, unnest(w) AS t, unnest(range(len(w))) AS i FROM n),
    k AS (SELECT doc_id, nb, string_agg(t, ' ' ORDER BY i) AS t FROM e WHERE {u('7', 'doc_id', 'nb', 'i')} > 0.2 GROUP BY ALL)
    SELECT doc_id, nb, md5(coalesce(t, text)) AS h FROM n LEFT JOIN k USING (doc_id, nb)""",
)
def b14(spark, d):
    return C.make_neighbours(table(spark, d, "documents").select("doc_id", "text"), 3, 0.2, 7).select("doc_id", "nb", F.md5("text").alias("h"))


@query(
    "b15_token_budget",
    f"""SELECT CAST((rn - 1) // 100 AS INTEGER) AS batch_no, doc_id, CAST(pos AS INTEGER) AS pos FROM (
    SELECT doc_id, pos, row_number() OVER (ORDER BY {u('5', 'doc_id', 'pos')}, doc_id, pos) AS rn FROM tokens_t) WHERE rn <= 1000""",
)
def b15(spark, d):
    return C.token_budget(tokens(spark, d), 1000, 100, 5)


BUFFERS = f"""b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS buffer FROM (SELECT DISTINCT doc_id FROM documents)), o AS (SELECT buffer, doc_id, pos, {u('5', 'doc_id', 'pos')} AS draw FROM tokens_t JOIN b USING (doc_id))"""
STEP, BUDGET = 1500, 60_000


@query(
    "b15_token_steps_accumulate",
    f"""WITH {BUFFERS} SELECT CAST((k - 1) // {STEP} AS INTEGER) AS batch_no, CAST((k - 1) % {STEP} AS INTEGER) AS slot, doc_id, CAST(pos AS INTEGER) AS pos FROM (
    SELECT *, row_number() OVER (ORDER BY buffer, draw, doc_id, pos) AS k, count(*) OVER () AS n FROM o) WHERE (k - 1) // {STEP} < least(n // {STEP}, {BUDGET // STEP})""",
)
def b15a(spark, d):
    """Steps that carry what is left of a buffer of eight documents."""
    return C.token_steps(table(spark, d, "documents"), tokens(spark, d), 8, STEP, BUDGET, 5, "accumulate")


@query(
    "b15_token_steps_repeat",
    f"""WITH {BUFFERS}, z AS (SELECT buffer, count(*) AS n, row_number() OVER (ORDER BY buffer) - 1 AS batch_no FROM o GROUP BY buffer),
    k AS (SELECT *, row_number() OVER (PARTITION BY buffer ORDER BY CASE WHEN n >= {STEP} THEN draw ELSE 0 END, doc_id, pos) - 1 AS j FROM o JOIN z USING (buffer) WHERE batch_no < {BUDGET // STEP})
    SELECT CAST(batch_no AS INTEGER) AS batch_no, CAST(slot AS INTEGER) AS slot, doc_id, CAST(pos AS INTEGER) AS pos FROM (SELECT *, unnest(range(j, {STEP}, n)) AS slot FROM k WHERE j < {STEP})""",
)
def b15r(spark, d):
    """Steps of one buffer of eight documents each; too few tokens are repeated."""
    return C.token_steps(table(spark, d, "documents"), tokens(spark, d), 8, STEP, BUDGET, 5, "repeat")


@query("c1_length_features", f"SELECT doc_id, CAST(length(text) AS INTEGER) AS char_count, CAST(len({WORDS}) AS INTEGER) AS word_count, CAST(len({TERMS}) AS INTEGER) AS term_count FROM documents")
def c1(spark, d):
    return X.length_features(table(spark, d, "documents"))


@query("c2_random_score", f"SELECT doc_id, {u('1', 'doc_id')} AS score FROM documents")
def c2(spark, d):
    return table(spark, d, "documents").select("doc_id", u01(F.lit(1), F.col("doc_id")).alias("score"))


@query("c3_zlib_len")
def c3(spark, d):
    return table(spark, d, "documents").select("doc_id", X.zlib_len("text").alias("zlib_bytes"))


GRAMS = f"""t AS (SELECT doc_id, {TERMS} AS t FROM pool_t), g AS (
    SELECT doc_id, gram, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS gram FROM t UNION ALL
    SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM t) GROUP BY ALL),
    v AS (SELECT gram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM g GROUP BY gram HAVING count(*) >= 3 ORDER BY total DESC, gram LIMIT 2000)"""


@query("c4_vocabulary", f"WITH {GRAMS} SELECT * FROM v")
def c4(spark, d):
    return X.vocabulary(X.ngram_counts(pool(spark, d)), 3, 2000)


STOPPED = f"list_filter({TERMS}, lambda w: w NOT IN ({', '.join(repr(w) for w in X.STOP_WORDS)}))"


@query("c4_vocabulary_stopped", f"WITH {GRAMS.replace(TERMS, STOPPED).replace('HAVING count(*) >= 3', 'HAVING count(*) >= 0.02 * (SELECT count(*) FROM pool_t)').replace('LIMIT 2000', 'LIMIT 500')} SELECT * FROM v")
def c4s(spark, d):
    """Without function words, grams in at least one text in fifty, the 500 most frequent."""
    p = pool(spark, d)
    return X.vocabulary(X.ngram_counts(p, stop_words=X.STOP_WORDS), 0.02, 500, p.count())


@query(
    "c5_tfidf",
    f"""WITH {GRAMS}, r AS (SELECT doc_id, gram, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS raw FROM g JOIN v USING (gram), (SELECT count(*) AS n FROM pool_t))
    SELECT doc_id, gram, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS w FROM r""",
)
def c5(spark, d):
    p = pool(spark, d)
    counts = X.ngram_counts(p)
    n = p.agg(F.count(F.lit(1)).alias("n"))
    return X.tfidf(counts, X.vocabulary(counts, 3, 2000), n).select("doc_id", "gram", r6("w").alias("w"))


@query(
    "c10_label_features",
    f"""WITH c AS (SELECT label AS feature_id, {WORDS.replace('text', 'lower(text)')} AS t FROM pool_t),
    g AS (SELECT feature_id, unnest(t) AS gram FROM c UNION ALL SELECT feature_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM c
    UNION ALL SELECT feature_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM c),
    n AS (SELECT feature_id, gram, count(*) AS count FROM g WHERE length(gram) >= 3 GROUP BY ALL)
    SELECT * FROM (SELECT feature_id, gram, count, CAST(row_number() OVER (PARTITION BY feature_id ORDER BY count DESC, gram) AS INTEGER) AS rank FROM n) WHERE rank <= 8""",
)
def c10(spark, d):
    return X.label_features(pool(spark, d).select(F.col("label").alias("feature_id"), F.col("text").alias("context")))
