"""Claim check over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.plans import claim_check as cc

from . import views as v
from .registry import check, read, with_ctes

_CLEAN = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(?s)^---.*?\\n---', ''), '(?s)```.*?```', ' ', 'g'), 'https?://\\S+', ' ', 'g'),
  '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\b[0-9a-f]{12,64}\\b', ' ', 'g')"""
CLEAN = f"cleaned AS (SELECT doc_id, {_CLEAN} AS text FROM docs)"
# RE2 has no look-around: characters beside a number are consumed, so every separator that may
# stand on both sides of two numbers is doubled first
_CLASS = "\\pL\\pN_"
TOKENS = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),1) AS line_no
  FROM cleaned),
 hits AS (SELECT doc_id, line_no, unnest(regexp_extract_all(regexp_replace(line, '([^{_CLASS}.,/%-])', '\\1\\1', 'g'),
  '(?:^|[^{_CLASS}.\\-/])(-?\\p{{Nd}}[\\p{{Nd}},]*(?:\\.\\p{{Nd}}+)?(?:[eE]-?\\p{{Nd}}+)?%?)(?:$|[^{_CLASS}/])', 1)) AS t FROM lines),
 tokens AS (SELECT doc_id, line_no, rtrim(t,'%') AS token, suffix(t,'%') AS percent FROM hits)"""


@check("clean_text", with_ctes("SELECT doc_id, text FROM cleaned", v.CLAIM_DOCS, CLEAN))
def clean_text(spark, sf):
    return v.claim_docs(spark, sf).select("doc_id", cc.clean_markup(F.col("text")).alias("text"))


def _tokens(spark, sf):
    docs = v.claim_docs(spark, sf).select("doc_id", cc.clean_markup(F.col("text")).alias("text"))
    return cc.number_tokens(docs, "doc_id", "text")


@check("number_tokens", with_ctes("SELECT doc_id, line_no, token, percent FROM tokens", v.CLAIM_DOCS, CLEAN, TOKENS))
def number_tokens(spark, sf):
    return _tokens(spark, sf)


# the documents hold no number with an exponent, whose spellings are tested by hand
@check("number_forms", with_ctes("""
SELECT DISTINCT token, percent, unnest(list_distinct(list_filter([plain,
  CASE WHEN regexp_full_match(plain,'-?[0-9]+') THEN CAST(CAST(plain AS HUGEINT) AS VARCHAR) END,
  CASE WHEN percent THEN format('{:.3f}', CAST(plain AS DOUBLE)/100) END,
  CASE WHEN percent THEN format('{:.4f}', CAST(plain AS DOUBLE)/100) END], lambda x: x IS NOT NULL))) AS form
FROM (SELECT DISTINCT token, percent, replace(token,',','') AS plain FROM tokens)""", v.CLAIM_DOCS, CLEAN, TOKENS))
def number_forms(spark, sf):
    distinct = _tokens(spark, sf).select("token", "percent").distinct()
    return distinct.select("token", "percent", F.explode(cc.token_forms(F.col("token"), F.col("percent"))).alias("form"))


_KNOWN = "known AS (SELECT DISTINCT unnest(regexp_extract_all(props, '-?[0-9]+')) AS form FROM events)"


@check("known_numbers", with_ctes("SELECT form FROM known", _KNOWN))
def known_numbers(spark, sf):
    return cc.known_numbers(read(spark, sf, "events"), "props")


@check("allowlist", """SELECT DISTINCT unnest([lpad(CAST(p_partkey AS VARCHAR),7,'0'), CAST(p_partkey AS VARCHAR)]) AS form FROM part WHERE p_partkey%5<>0""")
def allowlist(spark, sf):
    """Allow-list lines with comments, blanks and lines that hold nothing else."""
    key = F.col("p_partkey")
    line = F.when(key % 5 == 0, F.lit("  # nothing")).otherwise(F.concat(F.lit(" "), F.lpad(key.cast("string"), 7, "0"), F.lit("  # part")))
    return cc.allowlist_numbers(read(spark, sf, "part").select(line.alias("line")), "line")


@check("unsupported_claims", with_ctes("""
SELECT doc_id, token, percent, count(*) AS places, min(line_no) AS first_line FROM tokens
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.form IN (rtrim(replace(token,',','')),
  CASE WHEN NOT contains(token,'.') THEN CAST(TRY_CAST(replace(token,',','') AS HUGEINT) AS VARCHAR) END,
  CASE WHEN percent THEN format('{:.3f}', TRY_CAST(replace(token,',','') AS DOUBLE)/100) END,
  CASE WHEN percent THEN format('{:.4f}', TRY_CAST(replace(token,',','') AS DOUBLE)/100) END))
GROUP BY 1,2,3""", v.CLAIM_DOCS, CLEAN, TOKENS, _KNOWN))
def unsupported_claims(spark, sf):
    known = cc.known_numbers(read(spark, sf, "events"), "props")
    return cc.unsupported_claims(_tokens(spark, sf), known, "doc_id")
