"""Queries of word-budget chunks; in SQL a recursion goes through a text sentence by sentence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sentences, smart_chunks
from ..jsstr import word_count
from ..operators.budget import budget_chunks
from ..sources import text_formats
from . import adapters as A
from .queries import PARAGRAPHS, query

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_WORDS = r"len(regexp_extract_all({0}, '[^\s]+'))"
_CLEAN = f"list_transform({{0}}, lambda x: {_TRIM.format('x')})"


def _usual(text: str) -> str:
    """Sentences with a terminator, then what their lengths leave over of the text."""
    found = rf"regexp_extract_all({text}, '[^.!?\n]+[.!?]+\s*')"
    rest = _TRIM.format(f"substr({text}, CAST(coalesce(list_sum(list_transform({found}, lambda x: length(x))), 0) AS BIGINT) + 1)")
    every = f"list_concat({_CLEAN.format(found)}, CASE WHEN {rest} <> '' THEN [{rest}] ELSE [] END)"
    return f"CASE WHEN len({every}) = 0 THEN [{text}] ELSE {every} END"


def _lossless(text: str) -> str:
    return rf"list_filter({_CLEAN.format(rf"regexp_extract_all({text}, '[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+')")}, lambda x: x <> '')"


def _chunks(source: str, split, budget: int) -> str:
    """CTEs from `source`(k, text) to `chunks`(k, no, first, last, words, chunk)."""
    return f"""whole AS (SELECT k, {_TRIM.format('text')} AS w FROM {source} WHERE regexp_matches(text, '[^\\s]')),
cut AS (SELECT k, {split('w')} AS s FROM whole),
sized AS (SELECT k, s, list_transform(s, lambda x: {_WORDS.format('x')}) AS n FROM cut),
walk AS (
  SELECT k, 1 AS i, n[1] AS total, 0 AS no FROM sized
  UNION ALL
  SELECT k, i + 1, CASE WHEN total + n[i + 1] > {budget} THEN n[i + 1] ELSE total + n[i + 1] END, no + CASE WHEN total + n[i + 1] > {budget} THEN 1 ELSE 0 END FROM walk JOIN sized USING (k) WHERE i < len(n)
),
chunks AS (SELECT k, no, min(i) - 1 AS first, max(i) - 1 AS last, CAST(sum(n[i]) AS BIGINT) AS words, {_TRIM.format("string_agg(s[i], ' ' ORDER BY i)")} AS chunk FROM walk JOIN sized USING (k) GROUP BY k, no)"""


_DOCS = "docs AS (SELECT doc_id AS k, text FROM documents WHERE text IS NOT NULL)"


@query(f"WITH RECURSIVE {_DOCS}, {_chunks('docs', _usual, 50)} SELECT k AS doc_id, no AS chunk_no, chunk FROM chunks")
def txt_smart_chunks(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", smart_chunks(F.col("text"), 50).alias("c")).select("doc_id", F.posexplode("c").alias("chunk_no", "chunk"))


@query(f"WITH RECURSIVE {_DOCS}, {_chunks('docs', _lossless, 50)} SELECT k AS doc_id, no AS chunk_no, chunk FROM chunks")
def txt_chunks_lossless(spark, sf_dir):
    """Sentence chunks of 50 words that keep every character but white space."""
    docs = A.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", smart_chunks(F.col("text"), 50, lossless=True).alias("c")).select("doc_id", F.posexplode("c").alias("chunk_no", "chunk"))


@query(
    rf"""WITH RECURSIVE {PARAGRAPHS}, few AS (SELECT file_id, seg_no, text FROM paragraphs WHERE {_WORDS.format('text')} <= 30),
long AS (SELECT file_id || ':' || seg_no AS k, text FROM paragraphs WHERE {_WORDS.format('text')} > 30), {_chunks('long', _lossless, 30)},
pieces AS (SELECT file_id, seg_no, 0 AS no, text FROM few
  UNION ALL SELECT CAST(string_split(k, ':')[1] AS BIGINT), CAST(string_split(k, ':')[2] AS BIGINT), no, chunk FROM chunks)
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY seg_no, no) - 1 AS INTEGER) AS seg_no, md5(text) AS digest FROM pieces"""
)
def txt_word_budget(spark, sf_dir):
    """Paragraphs, the long ones in chunks of 30 words."""
    return text_formats.txt_segments(A.document_files(spark, sf_dir), chunk_size=30, lossless=True).select("file_id", "seg_no", F.md5("text").alias("digest"))


@query(f"WITH RECURSIVE {_DOCS}, {_chunks('docs', _lossless, 40)} SELECT k AS file_id, CAST(no AS BIGINT) AS chunk_no, CAST(first AS BIGINT) AS first_seg, CAST(last AS BIGINT) AS last_seg, words FROM chunks")
def word_budget_starts(spark, sf_dir):
    """Where chunks of 40 words begin and end, for sentences that are rows of their own: no file is walked through."""
    docs = A.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = docs.select(F.col("doc_id").alias("file_id"), F.posexplode(sentences(F.col("text"), lossless=True)).alias("seg_no", "s"))
    return budget_chunks(rows.select("file_id", F.col("seg_no").cast("long").alias("seg_no"), word_count(F.col("s")).alias("words")), 40)
