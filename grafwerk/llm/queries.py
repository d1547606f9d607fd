"""The registered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafwerk.llm import decontam, jaccard, langid, linededup, packing, pii, quality, tokenpack, tokens, toxicity
from grafwerk.llm.common import held_out, load, scratch_dir, store


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.train(docs, load(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), ["doc_id"])


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.identify(docs, keep=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(load(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat token files of all documents, counted by a separator scan."""
    uri = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    where = store(tokens.write_token_files(load(spark, sf_dir, "documents"), uri), "token-index")
    counted = tokens.count_tokens(spark, uri, tokens.encoder().separator)
    return counted.join(where, ["file", "ordinal"]).select("doc_id", "n_tokens", "finished")


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrices of all documents; a row for each segment."""
    uri = f"{scratch_dir(spark)}/packed-{uuid.uuid4().hex}"
    return tokenpack.write_packed(load(spark, sf_dir, "documents"), uri)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_pii, op3_packing, op4_decontamination, op5_language, op6_jaccard_join, op7_line_dedup, op8_quality, op9_token_counts, op10_token_packing)
}

_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op6_jaccard_join": rf"""
        WITH RECURSIVE base AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingle AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM base
        ), size AS (
            SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
        ), pair AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), link AS (
            SELECT p.a, p.b FROM pair p JOIN size x ON x.doc_id = p.a JOIN size y ON y.doc_id = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
        ), reached AS (
            SELECT doc_id, doc_id AS other FROM base UNION SELECT r.doc_id, l.b FROM reached r JOIN link l ON l.a = r.other
        )
        SELECT b.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(other) FROM reached r WHERE r.doc_id = b.doc_id) AS component_id
        FROM base b LEFT JOIN size USING (doc_id)""",
    "op7_line_dedup": f"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), line AS (
            SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
        ), keyed AS (
            SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM line
        ), repeated AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), marked AS (
            SELECT k.*, coalesce(k.doc_id <> r.keeper, false) AS dropped FROM keyed k LEFT JOIN repeated r USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op8_quality": r"""
        WITH base AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), word AS (
            SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS pos FROM base
        ), three AS (
            SELECT doc_id, pos, w AS a, lead(w, 1) OVER d AS b, lead(w, 2) OVER d AS c FROM word
            WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
        ), again AS (
            SELECT doc_id, pos FROM (
                SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM three WHERE c IS NOT NULL
            ) WHERE n >= 2
        ), covered AS (
            SELECT doc_id, count(DISTINCT pos + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
        ), stats AS (
            SELECT b.doc_id, len(words) AS n_words,
                   length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_text_lines,
                   coalesce(c.n, 0) AS n_repeat_words,
                   length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters,
                   length(regexp_replace(text, '[^0-9]+', '', 'g')) AS n_digits,
                   length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_capitals,
                   len(regexp_extract_all(text, '(^|\n)[ \t]*[-*•]')) AS n_bullets
            FROM base b LEFT JOIN covered c USING (doc_id)
        ), judged AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                   10 * n_symbols > 3 * n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_text_lines)
                   OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 2 * n_letters < word_chars
                   OR 10 * n_digits > 3 * word_chars OR 10 * n_capitals > 6 * word_chars OR 10 * n_bullets > 9 * n_text_lines AS rejected
            FROM stats
        )
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
               CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
               CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
        FROM judged""",
}
