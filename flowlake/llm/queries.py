"""Queries of the text operators over the whole driver tables, with SQL where it can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import centroids, crosstok, decontaminate, langid, line_rules, lm, near_dup, pieces, secrets, shards, topk, toxicity, url_filter
from flowlake.llm.common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


OP3_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') FROM benchmark),
sets AS (
  SELECT side, id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words WHERE w <> ['']),
items AS (SELECT id AS item_id, len(s) AS item_size, unnest(s) AS h FROM sets WHERE side = 'i'),
docs AS (SELECT id AS doc_id, unnest(s) AS h FROM sets WHERE side = 'd'),
shared AS (SELECT doc_id, item_id, item_size, count(*) AS shared FROM docs JOIN items USING (h) GROUP BY ALL)
SELECT doc_id, item_id, item_size::INTEGER AS item_size, shared::INTEGER AS shared, shared / item_size AS containment
FROM shared WHERE shared >= 0.8 * item_size - 1e-9
"""


@query("op3_decontaminate", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return decontaminate.search(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    row_number() OVER () AS r
  FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
judged AS (
  SELECT r, list_filter(lines, lambda x:
    len(regexp_extract_all(x, '[|>»•·]')) < 3
    AND NOT regexp_matches(lower(x), '(all rights reserved|terms of service|terms of use|privacy policy|cookie policy|accept cookies|enable javascript|click here|sign up for our newsletter|subscribe to our newsletter)')
    AND NOT (length(regexp_replace(x, '[^\p{L}]', '', 'g')) >= 20 AND regexp_replace(x, '[^\p{L}]', '', 'g') = upper(regexp_replace(x, '[^\p{L}]', '', 'g')))
    AND NOT (len(regexp_extract_all(x, '[#*$%&|<>]|!!')) * 10 > length(x))
    AND NOT (NOT regexp_matches(x, '[.!?…:;"''”»)\]][\x20\x09-\x0D]*$') AND length(trim(x)) < 20)) AS ok
  FROM d),
facts AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words, len(lines) - len(ok) AS n_lines_removed,
    len(w) - len(list_filter(regexp_split_to_array(array_to_string(ok, chr(10)), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS lost_words
  FROM d JOIN judged USING (r) LEFT JOIN cov USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND 100 * lost_words <= 50 * n_words AS kept,
  n_lines_removed::BIGINT AS n_lines_removed, lost_words::BIGINT AS lost_words FROM failed
"""


@query("op4_quality_rules", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_lines_removed lost_words"
    return judged.select(*names.split()[:-1], F.col("lost_words").cast("long"))


OP5_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
k AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') END AS url_key,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM p),
l AS (SELECT DISTINCT url_key FROM k WHERE '.' || host || '.' LIKE '%.spam-farm.%' OR '.' || host || '.' LIKE '%.cheap-pills.%')
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN url_key IN (SELECT url_key FROM l) THEN 'block' ELSE 'allow' END AS verdict,
  url_key IS NOT NULL AND url_key IN (SELECT url_key FROM l) AS listed FROM k
"""


@query("op5_url_filter", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", ["page_id", "url"])
    return url_filter.judge(pages, url_filter.listed_from(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


@query("op7_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query("op1_near_dup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return found.select("doc_id", "class_id", "copy_of")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    weights = toxicity.fit(docs, labels.where(id_remainder("doc_id", 5) != 0))
    scored = toxicity.score(docs, weights)
    return scored.select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    found = langid.fit_predict(docs, id_remainder("doc_id", 4) != 2)
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op8_language_model")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    learning = docs.where(id_remainder("doc_id", 7) != 2)
    model = lm.fit(learning, id_remainder("doc_id", 7) == 5)
    scored = lm.score(docs, model)
    return scored.select(
        "doc_id", (id_remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(model["total"]).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte",
    )


@query("op10_pieces")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces_of(spark, table(spark, sf_dir, "documents", ["doc_id", "text"]))


OP12_ROUND = """
a{i} AS (SELECT vec_id, v, arg_min(k, [d, k]) AS k, min(d) AS d FROM (
  SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{i}) GROUP BY ALL),
s{i} AS (SELECT k, p, sum(v[p])::BIGINT AS s, count(*) AS n FROM (SELECT k, v, unnest(range(1, 65)) AS p FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM s{i} GROUP BY k),
c{j} AS (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k)),"""

OP12_SQL = (
    """
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS c FROM kept QUALIFY k < 16),"""
    + "".join(OP12_ROUND.replace("GROUP BY ALL),\ns", "GROUP BY vec_id, v),\ns").format(i=i, j=i + 1) for i in range(4))
    + """
t AS (SELECT a3.vec_id, a3.k, a3.d, c3.c FROM a3 JOIN c3 USING (k))
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM t"""
)


@query("op12_centroids", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = centroids.cluster(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
    return centroids.with_inertia(rows, centres)


OP13_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, e.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM e AS q, e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


@query("op13_exact_topk", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), F.col("vec_id") % 50 == 0)


@query("op11_crosstok")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda groups: hashlib.sha256(groups.encode()).hexdigest() if groups else ""
    aligned = crosstok.align(table(spark, sf_dir, "documents", ["doc_id", "text"]), use=digest)
    sums = crosstok.link_sums(aligned, crosstok.link_counts(aligned))
    return sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
