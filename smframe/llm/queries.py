"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smframe.llm import bpe, conversation_repair, filter_audit, fingerprints, language_id, lattice, line_dedup, mixing, ngram_join, quality, secrets, sharding, token_counts
from smframe.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranking = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, ranking).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(token_counts.VOCABULARY))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.VOCABULARY))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs, public_tokenizers.path(language_id.VOCABULARY)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_secrets": op1_secrets, "op2_quality": op2_quality, "op3_line_dedup": op3_line_dedup, "op4_mixing": op4_mixing, "op5_sharding": op5_sharding, "op6_ngram_join": op6_ngram_join, "op7_token_counts": op7_token_counts, "op8_embeddings": op8_embeddings, "op9_fingerprints": op9_fingerprints, "op10_bpe": op10_bpe, "op11_language_id": op11_language_id, "op12_filter_audit": op12_filter_audit, "op13_conversation_repair": op13_conversation_repair, "pipeline": pipeline}

ORACLE = {
    "op4_mixing": """
        WITH n AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY source),
        t AS (SELECT sum(n) AS total, sum(sqrt(n::DOUBLE)) AS w FROM n),
        r AS (SELECT s, total / w * sqrt(n::DOUBLE) / n AS rate FROM n, t),
        k AS (SELECT s, rate, unnest(range(0, (ceil(rate + 10 * sqrt(rate) + 20))::BIGINT + 1)) AS k FROM r),
        p AS (SELECT s, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM k),
        c AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS cdf FROM p),
        u AS (SELECT *, (('0x' || substr(md5('17/' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
        m AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(c.k)::INTEGER AS copies
              FROM u LEFT JOIN c ON u.source IS NOT DISTINCT FROM c.s AND c.cdf < u.u GROUP BY ALL)
        SELECT doc_id, text, lang, source, n_chars, unnest(range(0, copies))::INTEGER AS copy, copies FROM m WHERE copies > 0
    """,
    "op12_filter_audit": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS lowest FROM d),
        l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     (len(ws) < 100)::INTEGER + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INTEGER
                     + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::INTEGER
                     + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER + 16 * coalesce(w.doc_id > lowest, false)::INTEGER AS mask
              FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
        n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM f GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
        p AS (SELECT '' AS o, 0 AS m UNION ALL SELECT o || f, m + bit FROM p, x WHERE m & bit = 0),
        s AS (SELECT p.o AS filter_order, k.k AS step, bit,
                     (SELECT coalesce(sum(b.bit), 0) FROM x b WHERE position(b.f IN p.o) < k.k)::INTEGER AS before
              FROM p, (SELECT unnest(range(1, 6)) AS k) k, x WHERE length(p.o) = 5 AND x.f = p.o[k.k])
        SELECT part, filter_order, step::INTEGER AS step,
               coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
               coalesce(sum(g) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
               coalesce(sum(t) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost,
               coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit > 0), 0)::BIGINT AS shapley
        FROM n, s GROUP BY part, filter_order, step, before, bit
    """,
    # CRC-32 by its table; the least (cost, audit) of each state, row by row; inserted turns precede a row's own edit
    "op13_conversation_repair": r"""
        WITH RECURSIVE
        crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                          xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS h
                   FROM keyed, crc),
        damaged AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
                           CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                           unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy
                    FROM hashed WHERE h <> 0),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                            rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
        r AS (SELECT *, role[1] AS initial, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                     lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au') AS wrong FROM numbered),
        totals AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                          count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (wrong) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
        ins AS (SELECT unnest(['0', '1', '2', '3', '0', '1', '3', '0', '1', '2', '3']) AS s, unnest(['', '', '', '', 'I', 'I', 'I', 'II', 'II', 'I', 'II']) AS op,
                       unnest(['0', '1', '2', '3', '2', '2', '2', '3', '3', '3', '3']) AS s2, unnest(['', '', '', '', 'user:', 'user:', 'user:', 'user:|assistant:', 'user:|assistant:', 'assistant:', 'user:|assistant:']) AS said),
        moves AS (SELECT s, s2 AS m, op, 2 * length(op) AS c, CASE said WHEN '' THEN [] ELSE string_split(said, '|') END AS said FROM ins
                  UNION ALL SELECT '2', '2', 'II', 4, ['assistant:', 'user:']),
        walk AS (
            SELECT conv_id, 0::BIGINT AS i, '0' AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM totals
            UNION ALL
            SELECT conv_id, i, s, cost, audit, said FROM (
                SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) AS best FROM (
                    SELECT w.conv_id, r.i, e.e, CASE e.e WHEN 'D' THEN m.m WHEN 'K' THEN CASE r.initial WHEN 's' THEN '1' WHEN 'u' THEN '2' ELSE '3' END WHEN 'R' THEN CASE m.m WHEN '2' THEN '3' ELSE '2' END END AS s,
                           w.cost + m.c + CASE e.e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + (e.e <> 'D' AND r.fault = 't')::INTEGER AS cost, w.audit || m.op || e.e AS audit,
                           w.said || m.said || CASE e.e WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE m.m WHEN '2' THEN 'assistant:' ELSE 'user:' END || r.text] END AS said
                    FROM walk w JOIN r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1 JOIN moves m ON m.s = w.s, (SELECT unnest(['D', 'K', 'R']) AS e) e
                    WHERE e.e = 'D' OR r.fault NOT IN ('b', 'd') AND (e.e = 'R' OR r.initial = 's' AND m.m = '0' OR r.initial = 'u' AND m.m <> '2' OR r.initial = 'a' AND m.m = '2')))
            WHERE best = 1),
        ended AS (SELECT w.conv_id, w.cost + m.c AS cost, w.audit || m.op AS audit, w.said || m.said AS said
                  FROM walk w JOIN totals t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.n JOIN moves m ON m.s = w.s WHERE m.m IN ('0', '3')),
        best AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
    """,
}
