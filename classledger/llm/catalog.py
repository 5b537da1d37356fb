"""Registered queries of the numbered operators, over whole tables with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import (decontamination, extraction, jaccard, line_dedup, packing, periodic_runs, quality, scoring, substrings, token_counts,
               url_filter, warc, whitening)
from .tables import read


def op1_decontamination(spark, d):
    return decontamination.find_items(read(spark, d, "documents", "doc_id", "text"),
                                      read(spark, d, "benchmark", "item_id", "text")).drop("key")


def op2_extraction(spark, d):
    return extraction.extract(read(spark, d, "pages", "page_id", "url", "html"))


def op3_substrings(spark, d):
    return substrings.remove_repeats(read(spark, d, "documents", "doc_id", "text")).drop("text")


def op4_url_filter(spark, d):
    return url_filter.judge_urls(read(spark, d, "pages", "page_id", "url"))


def op5_token_counts(spark, d):
    return token_counts.token_counts(read(spark, d, "documents", "doc_id", "text"))


def op6_quality(spark, d):
    return quality.judge(read(spark, d, "documents", "doc_id", "text"), read(spark, d, "labels", "doc_id", "quality"))


def op7_scoring(spark, d):
    return scoring.score_documents(read(spark, d, "documents", "doc_id", "text"))


def op8_packing(spark, d):
    return packing.pack_documents(read(spark, d, "documents", "doc_id", "text"))


def op9_warc(spark, d):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/classledger/archive-{uuid.uuid4().hex}"
    warc.write_archive(read(spark, d, "pages", "page_id", "url", "html"), path)
    return warc.read_archive(spark, path)


def op10_jaccard(spark, d):
    return jaccard.similar_documents(read(spark, d, "documents", "doc_id", "text"))


def op11_whitening(spark, d):
    return whitening.whiten(read(spark, d, "embeddings", "vec_id", "embedding"))


def op12_lines(spark, d):
    kept = line_dedup.dedup_lines(read(spark, d, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_runs(spark, d):
    texts = periodic_runs.with_planted_periods(read(spark, d, "documents", "doc_id", "text"))
    return periodic_runs.run_digests(periodic_runs.collapse_runs(texts))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_extraction, op3_substrings, op4_url_filter, op5_token_counts, op6_quality, op7_scoring, op8_packing, op9_warc, op10_jaccard, op11_whitening,
    op12_lines, op13_runs)}

#: White space that a line's ends lose, as a DuckDB expression.
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bare base32 of a SHA-1 in hex: each five hex digits are four characters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, {5 * (k // 4) + 1}, 5))::INTEGER >> {15 - 5 * (k % 4)}) & 31) + 1, 1)"
    for k in range(32))

ORACLE_SQL: dict[str, str] = {
    "op9_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS s,
        min(page_id) OVER (PARTITION BY h) AS first_page FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_page THEN first_page END AS refers_to FROM d""",
    "op12_lines": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT r, doc_id, u.i, ls[u.i] AS line, translate(trim(ls[u.i], {_SPACES}), '{_UPPER}', '{_LOWER}') AS k
  FROM docs, unnest(range(1, len(ls) + 1)) AS u(i)),
hit AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT l.*, hit.k IS NOT NULL AND l.doc_id <> hit.keeper AS gone FROM lines l LEFT JOIN hit ON l.k = hit.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id""",
}
