"""Registered queries: exact deduplication, mixing and packing."""

from __future__ import annotations

from modsift.llm import exact_dedup, mixing, packing
from modsift.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_exact_dedup(spark, folder):
    return exact_dedup.exact_groups(table(spark, folder, "documents"), keep="largest")


OP8_SQL = """
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
g AS (SELECT t, MAX(doc_id) AS keep_id, COUNT(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op6_mix_sources(spark, folder):
    plan = mixing.mixing_plan(table(spark, folder, "documents"))
    return plan.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken", "rate", "copies")


# Targets in closed form: sources by the level at which they reach their cap; those below the first level that
# leaves its source uncapped stay at their cap.
MIX_SQL = """
sized AS (SELECT *, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {documents}),
sources AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (ROW_NUMBER() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM sources
),
levels AS (
  SELECT *,
    (SELECT SUM(source_size) FROM sources) - 3 * COALESCE(SUM(source_size) OVER before, 0) AS left_size,
    SUM(weight) OVER () - COALESCE(SUM(weight) OVER before, 0) AS left_weight
  FROM weighed
  WINDOW before AS (ORDER BY 3.0 * source_size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (
  SELECT CAST(left_size AS DOUBLE) / CAST(left_weight AS DOUBLE) AS v, left_size, left_weight FROM levels
  WHERE 3 * source_size * left_weight > left_size * weight ORDER BY 3.0 * source_size / weight, source IS NULL, encode(source) LIMIT 1
),
targets AS (
  SELECT source, source_size,
    CASE WHEN 3 * source_size * l.left_weight <= l.left_size * weight THEN CAST(3 * source_size AS DOUBLE) ELSE weight * l.v END AS target
  FROM weighed CROSS JOIN level l
),
rated AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('mix-1:' || COALESCE(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) AS drawn
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
offsets AS (SELECT unnest(range(32)) AS k),
trials AS (
  SELECT source, k, ABS(CAST(SUM(CASE WHEN CAST((drawn + k * 140737488355328) % 4503599627370496 AS DOUBLE) < (rate - floor(rate)) * 4503599627370496.0::DOUBLE THEN size ELSE 0 END) AS BIGINT)
    - (ANY_VALUE(target) - floor(ANY_VALUE(rate)) * ANY_VALUE(source_size))) AS off
  FROM rated CROSS JOIN offsets GROUP BY source, k
),
chosen AS (SELECT source, CAST(ARG_MIN(k, (off, k)) AS BIGINT) AS k FROM trials GROUP BY source),
mixed AS (
  SELECT r.*, CAST(floor(rate) AS INTEGER)
    + CAST(CAST((drawn + k * 140737488355328) % 4503599627370496 AS DOUBLE) < (rate - floor(rate)) * 4503599627370496.0::DOUBLE AS INTEGER) AS copies
  FROM rated r JOIN chosen c ON r.source IS NOT DISTINCT FROM c.source
)
"""

OP6_SQL = "WITH " + MIX_SQL.format(documents="documents") + (
    "SELECT doc_id, size, source_size, target, size * copies AS taken, rate, copies FROM mixed"
)


def op7_pack(spark, folder):
    return packed_digest(table(spark, folder, "documents"))


def packed_digest(docs):
    placed = packing.pack_documents(docs, tokenizer_path())
    return packing.with_ids_crc32(placed).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op6_mix_sources": op6_mix_sources, "op7_pack": op7_pack, "op8_exact_dedup": op8_exact_dedup}
SQL = {"op6_mix_sources": OP6_SQL, "op8_exact_dedup": OP8_SQL}
