"""The queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import new_path
from . import byte_bpe, clustering, collocations, exact_dedup, near_dedup, packing, passages, personal_data, quality, sharding, suffixes, token_counts, warc
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_differencing_pack")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_sharded_warc")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read_back(read_table(spark, sf_dir, "pages"), new_path(spark, "archives")).drop("payload", "url")


@query("op3_anchor_expansion")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data_digest(personal_data.find_personal_data(read_table(spark, sf_dir, "documents")))


@query("op4_paragraph_bands")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(read_table(spark, sf_dir, "documents"))


@query("op5_folded_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_documents(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.encoding_digest(byte_bpe.decode_documents(encoded, ranks))


_EXACT_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST) AS k,
             count(*) OVER (PARTITION BY norm) AS n,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id FROM t)
SELECT doc_id, keep_id, n AS group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


@query("op6_exact_dedup", _EXACT_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


@query("op7_prob_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


_GRID = ", ".join(f"('{rule}', {cut})" for rule, cuts in quality.CUTOFFS.items() for cut in cuts)
_QUALITY_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
w AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM s)),
d AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS c FROM w) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT p) AS covered FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY rid),
f AS (SELECT s.rid, doc_id, lang, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  len(ls) AS n_lines, coalesce(covered, 0) AS n_repeat_words FROM s LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(n_symbols / nullif(word_chars, 0), 0) AS v_symbols,
  coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS v_lines, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS v_repeats,
  coalesce(word_chars / nullif(n_words, 0), 0) AS v_length FROM f),
v AS (SELECT rid, lang, rule, CASE rule WHEN 'symbols' THEN v_symbols WHEN 'lines' THEN v_lines WHEN 'repeats' THEN v_repeats ELSE v_length END AS x,
  cut FROM b, (VALUES {_GRID}) AS g(rule, cut)),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) >= 1),
held AS (SELECT rid FROM b JOIN good USING (doc_id) WHERE NOT base_failed),
k AS (SELECT lang, rule, cut, count(*) AS n, count(*) FILTER (x > cut) AS k FROM v JOIN held USING (rid) GROUP BY ALL),
safe AS (SELECT lang, rule, min(cut) AS cut FROM (SELECT *, CASE WHEN k >= n * {quality.RISK / 4} THEN 1 ELSE list_sum(list_transform(range(0, k + 1),
  lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({quality.RISK / 4}) + (n - j) * ln(1 - {quality.RISK / 4})))) END AS tail FROM k)
  WHERE tail <= {quality.DOUBT} / (SELECT 40 * count(DISTINCT coalesce(lang, '?')) FROM k) GROUP BY ALL),
bad AS (SELECT DISTINCT rid FROM v JOIN safe ON v.rule = safe.rule AND v.lang IS NOT DISTINCT FROM safe.lang AND v.cut = safe.cut WHERE x > v.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept
FROM b LEFT JOIN bad ON b.rid = bad.rid
"""


@query("op8_risk_controlled_rules", _QUALITY_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("stratum")


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_stratified_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), 8)


@query("op11_phrase_collocations", collocations.collocations_sql("documents"))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


@query("op12_suffix_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


@query("op13_centroid_clusters", clustering.cluster_sql("embeddings"))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(read_table(spark, sf_dir, "embeddings"))
