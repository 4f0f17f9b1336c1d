"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_polytope, hilbert, line_rules, minhash, packing, sentence_dedup, sentencepiece, toxicity, warc, weak_labels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.quality(table(spark, sf_dir, "documents"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", "n_ids", F.crc32(F.encode("decoded", "UTF-8")).alias("decoded_crc32"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op7_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = (
    op1_weak_label_quality,
    op2_cross_polytope,
    op3_best_fit_packing,
    op4_sentencepiece,
    op5_hilbert_shards,
    op6_substring_dedup,
    op7_line_frequency_rules,
    op8_minhash_near_dedup,
    op9_warc_round_trip,
    op10_toxicity,
)
QUERIES = {f.__name__: f for f in _ALL}

#: Words as in the contract; A-Z alone goes to lower case.
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, text, {_WORDS.format('text')} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g) WHERE c >= 2) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, line, {_WORDS.format('line')} AS lw FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
ll AS (SELECT *, regexp_replace({_LOWER.format("array_to_string(lw, ' ')")}, '[0-9]+', '0', 'g') AS norm FROM l WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ll GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
hot AS (SELECT c.* FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM ll GROUP BY source, norm) c JOIN hosts h ON h.source IS NOT DISTINCT FROM c.source WHERE c.n > {line_rules.LEAST_DOCS} AND c.n > {line_rules.SHARE} * h.docs),
gone AS (SELECT ll.doc_id, sum(len(lw)) AS n FROM ll JOIN hot ON hot.source IS NOT DISTINCT FROM ll.source AND hot.norm = ll.norm GROUP BY ll.doc_id),
s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(coalesce(d.text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= {line_rules.LEAST_WORDS} AND n_words - removed_words >= {line_rules.LEAST_SHARE} * n_words AS kept FROM s
"""

OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END) AS t FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE x.norm > 0 AND y.norm > 0 AND list_dot_product(x.e, y.e) / x.norm / y.norm >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.a AS vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM reach r LEFT JOIN n ON n.a = r.a GROUP BY r.a
"""

OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), '') AS digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

ORACLE_SQL = {"op2_cross_polytope": OP2_SQL, "op7_line_frequency_rules": OP7_SQL, "op8_minhash_near_dedup": OP8_SQL, "op9_warc_round_trip": OP9_SQL}
