"""The thin queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, exact_dedup, html_extract, lm_score, minhash, mixing, packing, simhash, substring_dedup, token_counts, toxicity, warc
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.copies(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, (source_size * 3)::DOUBLE AS lim FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE
        - coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY lim / w, source NULLS LAST) AS place FROM r),
t AS (SELECT source, source_size, coalesce(least(lim, w * (SELECT arg_min(level, place) FROM l WHERE level * w <= lim)), 0.0) AS target FROM l),
p AS (SELECT *, floor(rate)::BIGINT AS times, rate - floor(rate) AS f, ('0x' || substr(md5('mix:source:' || coalesce(source, 'null')), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u
      FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)),
j AS (SELECT doc_id, size, source, lpad(length(bin(size))::VARCHAR, 2, '0') || rpad(substr(bin(size), 2, 2), 2, '0') AS kind,
        ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS draw FROM d),
n AS (SELECT source, kind, list_sort(list(draw)) AS draws, count(*) AS n, sum(count(*)) OVER (PARTITION BY source ORDER BY kind) - count(*) AS k FROM j GROUP BY source, kind),
c AS (SELECT n.source, kind, source_size, target, times, CASE WHEN floor(u + (k + n) * f) > floor(u + k * f) THEN draws[(floor(u + (k + n) * f) - floor(u + k * f))::BIGINT] ELSE -1 END AS cut
      FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, size * (times + CASE WHEN draw <= cut THEN 1 ELSE 0 END) AS taken FROM j JOIN c ON j.source IS NOT DISTINCT FROM c.source AND j.kind = c.kind
"""

def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 3
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"), third("y_id") != 1)
    got = toxicity.scored(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(third("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.grouped(table(spark, sf_dir, "documents"), size=3, num=85)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_extract.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repairs(table(spark, sf_dir, "conversations"), damage=True)


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
hit AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
found AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(lag(role) OVER (PARTITION BY conv ORDER BY i), 1) || left(role, 1) AS two
  FROM placed),
edits(q, edit, initial, becomes, cost, r) AS (VALUES
  (0, 'D', '', '', 3, 0), (1, 'D', '', '', 3, 1), (2, 'D', '', '', 3, 2), (3, 'D', '', '', 3, 3),
  (0, 'K', 's', '', 0, 1), (0, 'K', 'u', '', 0, 2), (1, 'K', 'u', '', 0, 2), (3, 'K', 'u', '', 0, 2), (2, 'K', 'a', '', 0, 3),
  (0, 'R', '', 'user', 2, 2), (1, 'R', '', 'user', 2, 2), (3, 'R', '', 'user', 2, 2), (2, 'R', '', 'assistant', 2, 3)),
inserts(r, cost, audit, lines, q) AS (VALUES
  (0, 0, '', '', 0), (1, 0, '', '', 1), (2, 0, '', '', 2), (3, 0, '', '', 3), (0, 2, 'I', chr(10) || 'user:', 2), (1, 2, 'I', chr(10) || 'user:', 2), (3, 2, 'I', chr(10) || 'user:', 2),
  (2, 2, 'I', chr(10) || 'assistant:', 3), (0, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3), (1, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3)),
step(conv, i, q, best) AS (
  SELECT conv, 0::BIGINT, q, {'cost': cost::BIGINT, 'audit': audit, 'lines': lines} FROM (SELECT DISTINCT conv_id AS conv FROM conversations), inserts WHERE r = 0
  UNION ALL
  SELECT s.conv, s.i + 1, n.q, min({'cost': s.best.cost + e.cost + n.cost + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': s.best.audit || e.edit || n.audit,
    'lines': s.best.lines || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || e.becomes || ':' || f.text END || n.lines})
  FROM step s JOIN found f ON f.conv IS NOT DISTINCT FROM s.conv AND f.i = s.i + 1
  JOIN edits e ON e.q = s.q AND (e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (e.edit <> 'K' OR e.initial = left(f.role, 1))
  JOIN inserts n ON n.r = e.r GROUP BY s.conv, s.i + 1, n.q),
total AS (
  SELECT c.conv, count(f.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id AS conv FROM conversations) c LEFT JOIN found f ON f.conv IS NOT DISTINCT FROM c.conv GROUP BY c.conv),
ended AS (SELECT s.conv, min(best) AS best FROM step s JOIN total t ON s.conv IS NOT DISTINCT FROM t.conv AND s.i = t.n WHERE q IN (0, 3) GROUP BY s.conv)
SELECT t.conv AS conv_id, gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit, sha256(substr(best.lines, 2)) AS repaired_sha256
FROM total t JOIN ended e ON t.conv IS NOT DISTINCT FROM e.conv
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS newest FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN newest <> page_id OR page_id IS NULL AND newest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN newest <> page_id OR page_id IS NULL THEN newest END AS refers_to
FROM g
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op2_html_extract": op2_html_extract, "op3_simhash": op3_simhash, "op4_packing": op4_packing, "op5_substring_dedup": op5_substring_dedup, "op6_minhash": op6_minhash, "op7_lm_score": op7_lm_score, "op8_toxicity": op8_toxicity, "op9_token_counts": op9_token_counts, "op10_mixing": op10_mixing, "op11_conversation_repair": op11_conversation_repair, "op12_warc": op12_warc, "op13_alignment": op13_alignment}
SQL = {"op1_exact_dedup": OP1_SQL, "op10_mixing": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_warc": OP12_SQL}
