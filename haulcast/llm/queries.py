"""One query per corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulcast.llm import (collocations, exact_dedup, license_scan, mixing, near_dedup, packing, periodic_runs, quality, secret_scan,
                          toxicity, url_filter, vector_search, warc)
from haulcast.llm.registry import QUERIES, SQL, query, table
from haulcast.llm.text import LOWER, UPPER, WORD


@query("op5_exact_dedup", f"""
WITH texts AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


@query("op9_url_filter", url_filter.judge_urls_sql())
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query("op2_harmonic_packing")
def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op7_warc_archives", f"""
WITH sums AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest
  FROM pages),
largest AS (
  SELECT *, CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest)
                 ELSE page_id END AS response
  FROM sums)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM largest""")
def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@query("op4_source_mixing")
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


@query("op1_compression_quality")
def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


@query("op3_convolutional_toxicity")
def op3_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query("op10_minhash_near_dedup", f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM split),
sizes AS (SELECT doc_id, count(shingle) AS n FROM split LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
  WHERE 100 * shared >= {near_dedup.PERCENT} * (sa.n + sb.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""")
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(table(spark, sf_dir, "documents"))


@query("op6_pivot_search", """
WITH whole AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.n, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint AS score
  FROM whole q JOIN whole c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::int AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op6_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_products(table(spark, sf_dir, "embeddings"))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op11_collocations", f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
f AS (
  SELECT lang, w[i:i + k - 1] AS p, k, count(*) AS a FROM places, (SELECT unnest([1, 2, 3]) AS k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL),
candidates AS (SELECT * FROM f WHERE k > 1 AND a >= {collocations.LEAST}),
cuts AS (
  SELECT c.lang, c.p, c.a, x.a AS l, y.a AS r, x.k AS cut,
         (1000000::hugeint * c.a * c.a // (x.a::hugeint * y.a))::bigint AS score
  FROM candidates c JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.p = c.p[1:x.k]
  JOIN f y ON y.lang = c.lang AND y.p = c.p[x.k + 1:c.k]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
covers AS (
  SELECT lang, p[1:2] AS p, a FROM candidates WHERE k = 3 UNION ALL SELECT lang, p[2:3], a FROM candidates WHERE k = 3),
covered AS (SELECT lang, p, max(a) AS most FROM covers GROUP BY ALL),
kept AS (
  SELECT lowest.*, array_to_string(p, ' ') AS phrase FROM lowest LEFT JOIN covered USING (lang, p)
  WHERE 100 * coalesce(most, 0) < {collocations.COVER_PERCENT} * a)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score
FROM kept JOIN (SELECT lang, sum(a)::bigint AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang)
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= {collocations.TOP}""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_license_scan", license_scan.licence_sql())
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licence_labels(license_scan.scan_licences(table(spark, sf_dir, "documents")))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.with_planted_loops(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.find_runs(planted))
