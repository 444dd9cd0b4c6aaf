"""The queries of the thirteen operators and of the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cap_filters, filter_audit, importance, language_codes, line_quality, multiprobe, ngram_join, pieces, secret_scan, source_mix, suffix_dedup, token_files, warc_bundles
from ._shared import lean


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(_table(spark, sf_dir, "documents"))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.archive_digest(_table(spark, sf_dir, "pages"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality_digest(_table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_digest(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_codes.language_digest(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings_digest(_table(spark, sf_dir, "documents"), secret_scan.train(secret_scan.labelled_findings(spark)))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digest(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.embedding_digest(_table(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_digest(_table(spark, sf_dir, "documents"), ngram_join.JoinRule(words=3, percent=90, slack_percent=20))


def op11_crc_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.search_digest(_table(spark, sf_dir, "embeddings"))


def op13_filter_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_warc_bundles, op3_line_quality, op4_source_mix, op5_token_files, op6_language_codes, op7_secret_scan, op8_pieces, op9_cap_filters, op10_ngram_join, op11_crc_resample, op12_multiprobe, op13_filter_cube)}
#: The base rules and the line limits of ``line_quality.LineLimits()``.
_QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
spots AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM words WHERE len(ws) > 2),
grams AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM spots),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
raw_lines AS (SELECT rid, host, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT rid, host, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM raw_lines),
full_lines AS (SELECT * FROM lines WHERE norm <> ''),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY rid),
hosts AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
common AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT rid) AS n_docs FROM full_lines GROUP BY host, norm) JOIN hosts USING (host) WHERE n_docs > 20 AND 100 * n_docs > 10 * host_docs),
removed AS (SELECT rid, sum(length(norm) - length(replace(norm, ' ', '')) + 1) AS n_removed_words FROM full_lines JOIN common USING (host, norm) GROUP BY rid),
s AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
  FROM d JOIN words USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN removed USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND NOT (100 * (n_words - n_removed_words) < 50 * n_words) AS kept FROM j
"""

#: The rule of revisits over whole payloads.
_ARCHIVE_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
t AS (SELECT *, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS top FROM p)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to, url FROM t
"""
#: Least nodes that nodes reach over the links of ``links`` (x < y).
_REACH = "reach AS (SELECT id AS node, id AS root FROM nodes UNION SELECT CASE WHEN l.x = r.node THEN l.y ELSE l.x END, r.root FROM reach r JOIN links l ON r.node = l.x OR r.node = l.y)"
#: All pairs of vectors by their cosine.
_COSINE_SQL = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT * FROM nodes WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.id AS x, b.id AS y FROM good a JOIN good b ON a.id < b.id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
{_REACH},
ends AS (SELECT id, count(*) AS n FROM (SELECT x AS id FROM links UNION ALL SELECT y FROM links) GROUP BY id)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, id = root AS kept FROM (SELECT node AS id, min(root) AS root FROM reach GROUP BY node) LEFT JOIN ends USING (id)
"""
#: All pairs of documents that share a shingle.
_JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents),
nodes AS (SELECT id, CASE WHEN len(w) = 0 THEN w WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
e AS (SELECT id, len(g) AS n, unnest(g) AS k FROM nodes),
links AS (SELECT a.id AS x, b.id AS y FROM e a JOIN e b ON a.k = b.k AND a.id < b.id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
{_REACH}
SELECT id AS doc_id, len(g) AS n_shingles, root AS component_id FROM nodes JOIN (SELECT node AS id, min(root) AS root FROM reach GROUP BY node) USING (id)
"""

#: Every document's place of removal in every order.
_AUDIT_SQL = r"""
WITH marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lead FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
flags AS (SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > lead, false)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN marks USING (doc_id)),
cases AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails),
k AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, k.i AS step, o[k.i] AS f, o[1:k.i - 1] AS earlier FROM orders, k),
told AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS failed, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_fails FROM steps, cases),
sums AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, f, sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND failed THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND failed THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failed THEN toxic ELSE 0 END) AS toxic_lost FROM told GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM sums
"""

ORACLE_SQL: dict[str, str] = {"op2_warc_bundles": _ARCHIVE_SQL, "op3_line_quality": _QUALITY_SQL, "op9_cap_filters": _COSINE_SQL, "op10_ngram_join": _JACCARD_SQL, "op13_filter_cube": _AUDIT_SQL}
