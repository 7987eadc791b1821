"""Logical tables of the engine, derived by Spark from the given tables, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_MS = 1704067200000  # 2024-01-01T00:00:00Z, start of the synthetic arrival clock


def raw_texts(t) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        "source",
        "lang",
        (F.lit(BASE_MS) + F.col("doc_id") * 1000).alias("timestamp"),
    )


def mixed_docs(t) -> DataFrame:
    """Documents with some words and full stops turned Chinese, so Han rules have work to do."""
    body = F.replace(F.replace("text", F.lit(" the "), F.lit("的好")), F.lit(". "), F.lit("。"))
    return t.documents.select("doc_id", "lang", "source", body.alias("text"))


MIXED_SQL = """mixed AS (SELECT doc_id, lang, source,
  replace(replace(text, ' the ', '的好'), '. ', '。') AS text FROM documents)"""


def forum(t) -> DataFrame:
    d = F.col("doc_id")
    return mixed_docs(t).select(
        d.alias("id"),
        F.col("text").alias("content"),
        "lang",
        F.when(d % 11 != 0, d % 150).alias("vote_count"),
        (d % 60).alias("comment_count"),
        (d % 1000 + 1).alias("view_count"),
        (d % 20).alias("favorite_count"),
        (d % 7).alias("share_count"),
        F.when(d % 3 == 0, "answer").when(d % 3 == 1, "question").otherwise("article").alias("type"),
        F.col("source").alias("topic"),
    )


FORUM_SQL = MIXED_SQL + """, forum AS (SELECT doc_id AS id, text AS content, lang,
  CASE WHEN doc_id % 11 <> 0 THEN doc_id % 150 END AS vote_count, doc_id % 60 AS comment_count,
  doc_id % 1000 + 1 AS view_count, doc_id % 20 AS favorite_count, doc_id % 7 AS share_count,
  CASE WHEN doc_id % 3 = 0 THEN 'answer' WHEN doc_id % 3 = 1 THEN 'question' ELSE 'article' END AS type,
  source AS topic FROM mixed)"""


def requests(t) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("model_"), F.col("user_id") % 3).alias("model_name"),
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "signup", "pending")
        .otherwise("completed")
        .alias("status"),
        F.col("value").alias("duration_ms"),
        F.col("ts").alias("created_at"),
        "user_id",
    )


REQUESTS_SQL = """requests AS (SELECT event_id AS request_id, 'model_' || (user_id % 3) AS model_name,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'completed' END AS status,
  value AS duration_ms, ts AS created_at, user_id FROM events)"""


def labeled_texts(t) -> DataFrame:
    """Documents with their labels where present: label 1 means violation."""
    labels = t.labels.select("doc_id", F.col("toxic").alias("label"), F.col("quality").alias("quality_label"))
    return t.documents.join(labels, "doc_id", "left")


LABELED_SQL = """labeled AS (SELECT d.*, l.toxic AS label, l.quality AS quality_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def job_events(t) -> DataFrame:
    kind = F.col("event_type")
    return t.events.select(
        F.col("user_id").alias("job_id"),
        "ts",
        "event_id",
        F.when(kind == "signup", "pending").when(kind == "click", "running").when(kind == "view", "running")
        .when(kind == "purchase", "completed").otherwise("failed").alias("status"),
        F.when(kind == "error", F.concat(F.lit("error "), F.col("event_id"))).otherwise("").alias("error"),
        "value",
    )


JOB_EVENTS_SQL = """job_events AS (SELECT user_id AS job_id, ts, event_id,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'view' THEN 'running'
    WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN event_type = 'error' THEN 'error ' || event_id ELSE '' END AS error, value FROM events)"""


def jobs(t) -> DataFrame:
    """Training jobs out of orders: status, algorithm, creator, duration and accuracy."""
    o = F.col("o_orderkey")
    return t.orders.select(
        o.alias("job_id"),
        F.concat(F.lit("job "), F.col("o_orderpriority")).alias("job_name"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "TRAINING")
        .otherwise("FAILED").alias("status"),
        F.element_at(F.array(*map(F.lit, ["SVM", "KMEANS", "BERT"])), (o % 3 + 1).cast("int")).alias("algorithm"),
        F.element_at(F.array(*map(F.lit, ["CLASSIFICATION", "CLUSTERING"])), (o % 2 + 1).cast("int")).alias("model_type"),
        F.col("o_custkey").alias("created_by"),
        F.col("o_totalprice").alias("duration"),
        F.when(o % 5 != 0, (o % 101) / 100).alias("accuracy"),
        F.col("o_orderdate").alias("created_at"),
    )


JOBS_SQL = """jobs AS (SELECT o_orderkey AS job_id, 'job ' || o_orderpriority AS job_name,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'TRAINING' ELSE 'FAILED' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'SVM' WHEN 1 THEN 'KMEANS' ELSE 'BERT' END AS algorithm,
  CASE o_orderkey % 2 WHEN 0 THEN 'CLASSIFICATION' ELSE 'CLUSTERING' END AS model_type,
  o_custkey AS created_by, o_totalprice AS duration,
  CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 101) / 100.0::DOUBLE END AS accuracy,
  o_orderdate AS created_at FROM orders)"""


def log_lines(t) -> DataFrame:
    level = (
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN")
        .when(F.col("event_type") == "signup", "DEBUG").otherwise("INFO")
    )
    return t.events.select(
        "event_id",
        F.concat(
            F.lit("svc-"), F.col("user_id") % 7, F.lit(" | ["), level, F.lit("] request "), F.col("event_id"),
            F.when(F.col("event_id") % 13 == 0, " Timeout").otherwise(""),
        ).alias("line"),
    )


LOG_LINES_SQL = """log_lines AS (SELECT event_id, 'svc-' || (user_id % 7) || ' | [' ||
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END
  || '] request ' || event_id || CASE WHEN event_id % 13 = 0 THEN ' Timeout' ELSE '' END AS line FROM events)"""


def access_lines(t) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ["200", "404", "500", "403", "301"])), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select(
        "event_id",
        F.concat(F.lit("10.0.0."), F.col("user_id"), F.lit(" - GET / "), status).alias("line"),
    )


ACCESS_LINES_SQL = """access_lines AS (SELECT event_id, '10.0.0.' || user_id || ' - GET / ' ||
  CASE event_id % 5 WHEN 0 THEN '200' WHEN 1 THEN '404' WHEN 2 THEN '500' WHEN 3 THEN '403' ELSE '301' END AS line
  FROM events)"""


def qa_pairs(t) -> DataFrame:
    """User turns with the assistant turn that follows at once."""
    from modsift.operators.instruct import conversation_pairs

    return conversation_pairs(t.conversations, "conv_id", "turn", "role", "text")


QA_SQL = """qa AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

# --- SQL fragments (RE2 spelling) -----------------------------------------------------
U16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def u16(c: str) -> str:
    return U16.format(c)


def tok(c: str, lower: bool = True) -> str:
    body = f"lower({c})" if lower else c
    return (
        f"list_filter(regexp_extract_all({body}, '[\\x{{4e00}}-\\x{{9fff}}]|"
        f"(?:[a-zA-Z0-9_]|[^\\x{{4e00}}-\\x{{9fff}}\\P{{L}}]|\\p{{N}})+'), lambda x: length(x) <= 20)"
    )


SPECIAL_SQL = "'[^\\x{4e00}-\\x{9fa5}\\w\\s.,!?;:\"''()\\[\\]{}\\-]'"
URL_SQL = "'https?://[\\w\\-._~:/?#\\[\\]@!$&''()*+,;=%]+'"
EMAIL_SQL = "'[\\w\\.-]+@[\\w\\.-]+\\.[a-zA-Z]{2,}'"
PHONE_SQL = "'1[3-9]\\d{9}|\\d{3,4}-\\d{7,8}'"


def clean_sql(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', '', 'g')"
    for pattern, to in ((URL_SQL, ""), (EMAIL_SQL, ""), (PHONE_SQL, ""), (SPECIAL_SQL, " "), ("'\\s+'", " ")):
        out = f"regexp_replace({out}, {pattern}, '{to}', 'g')"
    return f"trim({out})"


def sentences_sql(c: str, cls: str = ".!?。！？", plus: str = "+") -> str:
    body = f"regexp_replace({c}, '[{cls}]+$', '')"
    return (
        f"CASE WHEN {c} = '' THEN 1 WHEN {body} = '' THEN 0 "
        f"ELSE 1 + len(regexp_extract_all({body}, '[{cls}]{plus}')) END"
    )
