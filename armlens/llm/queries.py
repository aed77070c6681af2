"""The operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import (
    byte_bpe, conversation_repair, exact_dedup, html_text, langid, packing, periodic_runs, pii, sentencepiece_fst, simhash,
    topk, toxicity, warc)
from .common import table, tuned


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(tuned(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "sequences_bound")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(tuned(spark), sf_dir, "pages"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(tuned(spark), sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5, "vec_id", "embedding", 256)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(tuned(spark), sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(tuned(spark), sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.token_counts(
        table(tuned(spark), sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(tuned(spark), sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(tuned(spark), sf_dir, "documents"), shingle=4, distance=4)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = warc.archive_pages(table(tuned(spark), sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(
        table(tuned(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.planted_repeats(table(tuned(spark), sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(tuned(spark), sf_dir, "conversations")
    return conversation_repair.digests(conversation_repair.damaged(conversations), conversations)


QUERIES = (
    op1_best_fit_packing, op2_html_extraction, op3_exact_top_k, op4_personal_data, op5_toxicity, op6_exact_dedup,
    op7_sentencepiece, op8_language_id, op9_simhash, op10_warc, op11_byte_bpe,
    op12_periodic_runs, op13_conversation_repair)

ORACLE_SQL = {
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_exact_top_k": """
        WITH v AS (
            SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings
            WHERE len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(max(list_inner_product(q.v, c.v)) AS BIGINT) AS score
            FROM v q, v c
            WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
            GROUP BY ALL
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
        FROM scored
        QUALIFY rank <= 5
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
        ),
        letters AS (
            SELECT page_id, html, [
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       (CAST('0x' || substr(sha, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) % 32 + 1, 1)
                FOR i IN range(32)] AS l
            FROM p
        ),
        kept AS (
            SELECT page_id, html, l, max(page_id) OVER (PARTITION BY html) AS first FROM letters
        )
        SELECT page_id, strlen(html) AS payload_bytes, array_to_string(l, '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM kept
    """,
    "op13_conversation_repair": r"""
        WITH RECURSIVE crc_table AS (
            SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
            FROM (SELECT unnest(range(256)) AS b)
        ),
        crc AS (
            SELECT list(v ORDER BY b) AS t FROM crc_table
        ),
        named AS (
            SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
        ),
        faults AS (
            SELECT name, xor(4294967295, list_reduce(
                [CAST(4294967295 AS BIGINT)] || [CAST(ascii(name[i]) AS BIGINT) FOR i IN range(1, length(name) + 1)],
                lambda c, x: xor(c >> 8, t[CAST(xor(c % 256, x) AS BIGINT) + 1]))) % 20 AS fault
            FROM named, crc
        ),
        known AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
            FROM conversations
        ),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM known JOIN faults USING (name), range(2) AS copies(copy)
            WHERE fault <> 0 AND (copy = 0 OR fault = 3)
        ),
        numbered AS (
            SELECT *, left(role, 1) AS initial, row_number() OVER conv AS n
            FROM damaged
            WINDOW conv AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text))
        ),
        ordered AS (
            SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen,
                   NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
                   NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
            FROM numbered
        ),
        reads(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        inserts(p, q, letters, lines) AS (VALUES
            (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
            (0, 2, 'I', E'user:\n'), (1, 2, 'I', E'user:\n'), (3, 2, 'I', E'user:\n'), (2, 3, 'I', E'assistant:\n'),
            (0, 3, 'II', E'user:\nassistant:\n'), (1, 3, 'II', E'user:\nassistant:\n')),
        edits AS (
            SELECT conv_id, n, reads.p, reads.q, 'K' AS letter, CASE WHEN cut THEN 5 ELSE 0 END AS cost, role || ':' || text || E'\n' AS line
            FROM ordered JOIN reads USING (initial) WHERE NOT blank AND NOT seen
            UNION ALL
            SELECT conv_id, n, reads.p, reads.q, 'R', CASE WHEN cut THEN 6 ELSE 1 END,
                   CASE reads.initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text || E'\n'
            FROM ordered, reads WHERE NOT blank AND NOT seen AND reads.initial <> 's'
            UNION ALL
            SELECT conv_id, n, p, p, 'D', 2, '' FROM ordered, range(4) AS states(p)
        ),
        steps AS (
            SELECT e.conv_id, e.n, i.p, e.q, min({c: e.cost + 5 * length(i.letters), a: i.letters || e.letter, t: i.lines || e.line}) AS best
            FROM edits e JOIN inserts i ON i.q = e.p
            GROUP BY ALL
        ),
        cells AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS q, {c: CAST(0 AS BIGINT), a: '', t: ''} AS best FROM ordered
            UNION ALL
            SELECT s.conv_id, s.n, CAST(s.q AS BIGINT),
                   min({c: CAST(cells.best.c + s.best.c AS BIGINT), a: cells.best.a || s.best.a, t: cells.best.t || s.best.t})
            FROM cells JOIN steps s ON s.conv_id IS NOT DISTINCT FROM cells.conv_id AND s.n = cells.n + 1 AND s.p = cells.q
            GROUP BY s.conv_id, s.n, s.q
        ),
        ended AS (
            SELECT conv_id, min({c: best.c + 5 * length(i.letters), a: best.a || i.letters, t: best.t || i.lines}) AS best
            FROM cells JOIN inserts i ON i.p = cells.q AND i.q IN (0, 3)
            WHERE (conv_id, n) IN (SELECT (conv_id, max(n)) FROM ordered GROUP BY conv_id)
            GROUP BY conv_id
        ),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
                   count(*) FILTER (NOT blank AND NOT seen AND cut) AS truncated,
                   count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM ordered GROUP BY conv_id
        )
        SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(ended.best.c, 0) AS cost,
               coalesce(ended.best.a, '') AS audit, sha256(coalesce(ended.best.t[:-2], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) every
        LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM every.conv_id
        LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM every.conv_id
    """,
}
