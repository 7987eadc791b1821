"""Queries: finders, aggregates, paging, retention, deduplication, joins, keyed updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsift.functions import scores as S
from modsift.functions import text as T
from modsift.operators import relational as R
from modsift.operators import evaluation as E
from modsift.operators.corpus import term_counts
from modsift.operators.features import remove_stop_words
from modsift.operators.similarity import near_duplicate_clusters, similar_sets
from modsift.plans import fixtures as fx
from modsift.plans.registry import query
from modsift.plans.text_queries import STOP, STOP_SQL

TS = "%Y-%m-%d %H:%M:%S"


def stamp(c, name=None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or c)


# --- finders ---------------------------------------------------------------------
@query(
    "f12_label_finders",
    f"""WITH {fx.LABELED_SQL} SELECT doc_id, 'labeled' AS finder FROM labeled WHERE label IS NOT NULL
      UNION ALL SELECT doc_id, 'unlabeled' FROM labeled WHERE label IS NULL
      UNION ALL SELECT doc_id, 'violation' FROM labeled WHERE label = 1
      UNION ALL SELECT event_id, 'reprocess' FROM events WHERE (props::JSON ->> 'k')::INT >= 50
      UNION ALL SELECT doc_id, 'features' FROM documents WHERE len(regexp_split_to_array(text, ' ')) BETWEEN 100 AND 200""",
)
def _(t):
    d = fx.labeled_texts(t).select("doc_id", "label")
    flagged = t.events.withColumn(
        "processing_metadata", F.to_json(F.struct((F.get_json_object("props", "$.k").cast("int") >= 50).alias("needsReprocessing")))
    )
    with_features = t.documents.select("doc_id", F.split("text", " ").alias("features"))
    return R.union_sources(
        R.texts_labeled(d).select("doc_id", F.lit("labeled").alias("finder")),
        R.texts_unlabeled(d).select("doc_id", F.lit("unlabeled").alias("finder")),
        R.texts_by_label(d, 1).select("doc_id", F.lit("violation").alias("finder")),
        R.texts_needing_reprocessing(flagged).select(F.col("event_id").alias("doc_id"), F.lit("reprocess").alias("finder")),
        R.texts_with_features(with_features, "features", 100, 200).select("doc_id", F.lit("features").alias("finder")),
    )


@query(
    "f13_length_and_creation_range",
    """SELECT doc_id AS id, 'length' AS finder FROM documents WHERE strlen(text) BETWEEN 500 AND 1500
      UNION ALL SELECT event_id, 'created' FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'""",
)
def _(t):
    a = R.texts_by_length_between(t.documents, "text", 500, 1500).select(F.col("doc_id").alias("id"), F.lit("length").alias("finder"))
    b = R.created_between(t.events, "ts", "2024-01-10 00:00:00", "2024-01-12 12:00:00")
    return a.union(b.select("event_id", F.lit("created")))


@query(
    "f14_keyword_search",
    f"""SELECT doc_id FROM (SELECT doc_id, text, {fx.tok('text')} AS tk FROM documents)
      WHERE contains(text, 'thanedble') OR len(list_filter(tk, lambda x: contains(x, 'tionoutre'))) > 0 OR contains(lower(text), 'tionoutre') OR list_contains(tk, 'reaulion')""",
)
def _(t):
    d = t.documents.select("doc_id", "text", T.tokenize("text", lower=True).alias("tk"))
    hit = R.keyword_hit("thanedble", "text") | R.keyword_hit("tionoutre", F.lower("text"), "tk") | F.array_contains("tk", "reaulion")
    return d.where(hit).select("doc_id")


@query(
    "f15_search_jobs",
    f"""WITH {fx.JOBS_SQL} SELECT job_id, job_name, status FROM jobs WHERE contains(lower(job_name), 'urgent') AND status = 'COMPLETED'
      AND algorithm = 'SVM' AND created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'""",
)
def _(t):
    j = fx.jobs(t).withColumn("description", F.col("algorithm"))
    return R.search_jobs(
        j, "URGENT", equals={"status": "COMPLETED", "algorithm": "SVM", "model_type": None}, ts="created_at",
        start="1996-01-01", end="1998-12-31",
    ).select("job_id", "job_name", "status")


@query(
    "f16_metric_finders",
    f"""WITH {fx.JOBS_SQL} SELECT job_id, 'slow' AS finder FROM jobs WHERE duration > 400000 UNION ALL
      SELECT job_id, 'accurate' FROM jobs WHERE accuracy BETWEEN 0.9 AND 0.95 UNION ALL SELECT job_id, 'unscored' FROM jobs WHERE accuracy IS NULL""",
)
def _(t):
    j = fx.jobs(t)
    return R.union_sources(
        R.filter_metric(j, "duration", above=400000).select("job_id", F.lit("slow").alias("finder")),
        R.filter_metric(j, "accuracy", low=0.9, high=0.95).select("job_id", F.lit("accurate").alias("finder")),
        R.filter_metric(j, "accuracy", present=False).select("job_id", F.lit("unscored").alias("finder")),
    )


@query(
    "f17_audit_records_between",
    "SELECT event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20 00:00:00'",
)
def _(t):
    return R.created_between(t.events.where("event_type = 'error'"), "ts", start="2024-01-20 00:00:00").select("event_id")


@query(
    "f18_job_state_predicates",
    f"""WITH {fx.JOBS_SQL} SELECT count(*) FILTER (status IN ('TRAINING', 'PREPARING', 'EVALUATING')) AS running,
      count(*) FILTER (status IN ('COMPLETED', 'FAILED', 'CANCELLED')) AS finished FROM jobs""",
)
def _(t):
    return fx.jobs(t).agg(F.count_if(R.is_running("status")).alias("running"), F.count_if(R.is_finished("status")).alias("finished"))


# --- aggregates ---------------------------------------------------------------------
@query("a1_count_by_source", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return R.count_by(t.documents, "source")


@query("a1_count_by_label", f"WITH {fx.LABELED_SQL} SELECT label, count(*) AS n FROM labeled WHERE label IS NOT NULL GROUP BY 1")
def _(t):
    return R.count_by(fx.labeled_texts(t).select("label"), "label", skip_null=True)


@query(
    "a2_count_jobs_by",
    f"""WITH {fx.JOBS_SQL} SELECT 'status' AS dimension, status AS value, count(*) AS n FROM jobs GROUP BY 2 UNION ALL
      SELECT 'model_type', model_type, count(*) FROM jobs GROUP BY 2 UNION ALL SELECT 'algorithm', algorithm, count(*) FROM jobs GROUP BY 2
      UNION ALL SELECT 'created_by', created_by::VARCHAR, count(*) FROM jobs GROUP BY 2""",
)
def _(t):
    return R.count_each(fx.jobs(t), ["status", "model_type", "algorithm", "created_by"])


@query(
    "a3_average_text_shape",
    f"""SELECT round(avg(strlen(text)), 6) AS avg_text_length, round(avg(len({fx.tok('text')})), 6) AS avg_token_count,
      round(avg(n_chars + 28), 6) AS avg_feature_dimension FROM documents""",
)
def _(t):
    d = t.documents.withColumn("tk", T.tokenize("text", lower=True)).withColumn("dim", F.col("n_chars") + 28)
    r = R.average_text_shape(d, "text", "tk", "dim")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query(
    "a4_data_quality_statistics",
    f"""WITH {fx.LABELED_SQL} SELECT count(*) AS total, count(*) FILTER (strlen(text) > 0) AS with_content,
      count(*) FILTER (len({fx.tok('text')}) > 0) AS with_tokens, count(*) FILTER (n_chars > 1000) AS with_features, count(label) AS with_label FROM labeled""",
)
def _(t):
    d = fx.labeled_texts(t).withColumn("tk", T.tokenize("text", lower=True)).withColumn("features", F.when(F.col("n_chars") > 1000, F.col("n_chars")))
    return R.data_quality_statistics(d, "text", "tk", "features", "label")


@query(
    "a5_preprocessing_statistics",
    f"""WITH {fx.LABELED_SQL} SELECT coalesce(source, 'all') AS source, grouping(source) = 1 AS is_total, count(*) AS total, round(avg(strlen(text)), 6) AS avg_text_length,
      round(avg(len({fx.tok('text')})), 6) AS avg_token_count, count(n_chars) AS with_features, count(label) AS with_label FROM labeled GROUP BY ROLLUP (source)""",
)
def _(t):
    d = fx.labeled_texts(t).withColumn("tk", T.tokenize("text", lower=True))
    r = R.preprocessing_statistics(d, "text", "tk", "n_chars", "label", "source")
    return (
        r.withColumn("source", F.coalesce("source", F.lit("all")))
        .withColumn("avg_text_length", F.round("avg_text_length", 6))
        .withColumn("avg_token_count", F.round("avg_token_count", 6))
    )


@query("a6_job_averages", f"WITH {fx.JOBS_SQL} SELECT round(avg(duration), 4) AS avg_duration, round(avg(accuracy), 6) AS avg_accuracy FROM jobs")
def _(t):
    return fx.jobs(t).agg(F.round(F.avg("duration"), 4).alias("avg_duration"), F.round(F.avg("accuracy"), 6).alias("avg_accuracy"))


@query(
    "a7_job_statistics",
    f"""WITH {fx.JOBS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed,
      count(*) FILTER (status = 'TRAINING') AS training, round(count(*) FILTER (status = 'COMPLETED') * 100.0::DOUBLE / count(*), 6) AS success_rate FROM jobs""",
)
def _(t):
    r = R.job_statistics(fx.jobs(t), "status", ["COMPLETED", "FAILED", "TRAINING"])
    return r.withColumn("success_rate", F.round("success_rate", 6))


@query(
    "a8_jobs_with_extreme",
    f"""WITH {fx.JOBS_SQL} SELECT job_id, 'best' AS which FROM jobs WHERE accuracy = (SELECT max(accuracy) FROM jobs)
      UNION ALL SELECT job_id, 'shortest' FROM jobs WHERE duration = (SELECT min(duration) FROM jobs)""",
)
def _(t):
    j = fx.jobs(t)
    best = R.rows_with_extreme(j, "accuracy").select("job_id", F.lit("best").alias("which"))
    return best.union(R.rows_with_extreme(j, "duration", largest=False).select("job_id", F.lit("shortest")))


@query(
    "a9_request_statistics",
    f"""WITH {fx.REQUESTS_SQL} SELECT count(*) AS total_requests, count(*) FILTER (status = 'completed') AS completed_requests,
      count(*) FILTER (status = 'failed') AS failed_requests, round(avg(duration_ms) FILTER (status = 'completed' AND duration_ms > 0), 6) AS average_latency,
      round(count(*) FILTER (created_at > (SELECT max(created_at) FROM requests) - INTERVAL 1 HOUR) / 3600.0::DOUBLE, 6) AS requests_per_second FROM requests""",
)
def _(t):
    r = R.request_statistics(fx.requests(t))
    return r.withColumn("average_latency", F.round("average_latency", 6)).withColumn("requests_per_second", F.round("requests_per_second", 6))


@query(
    "a10_requests_by_model_and_status",
    f"""WITH {fx.REQUESTS_SQL} SELECT model_name, status, count(*) AS n,
      round(count(*) FILTER (created_at > (SELECT max(created_at) FROM requests) - INTERVAL 2 DAY) / 172800.0::DOUBLE, 8) AS recent_rps FROM requests GROUP BY 1, 2""",
)
def _(t):
    r = fx.requests(t)
    now = r.agg(F.max("created_at").alias("m")).scalar()
    recent = F.col("created_at") > now - F.expr("INTERVAL 2 DAY")
    return r.groupBy("model_name", "status").agg(F.count("*").alias("n"), F.round(F.count_if(recent) / 172800.0, 8).alias("recent_rps"))


@query(
    "a11_model_statistics",
    """WITH m AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'loaded' WHEN 1 THEN 'unloaded' WHEN 2 THEN 'error' ELSE 'loading' END AS status FROM part)
      SELECT count(*) AS total_models, count(*) FILTER (status = 'loaded') AS loaded_models, count(*) FILTER (status = 'unloaded') AS unloaded_models,
      count(*) FILTER (status = 'error') AS error_models FROM m""",
)
def _(t):
    status = F.element_at(F.array(*map(F.lit, ["loaded", "unloaded", "error", "loading"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return R.model_statistics(t.part.select(status.alias("status")))


LATENCY_SQL = """SELECT {g} AS grp, count(*) AS n, round(avg(duration_ms), 6) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
  list_sort(list(duration_ms))[(count(*) * 95 // 100) + 1] AS p95_ms, list_sort(list(duration_ms))[(count(*) * 99 // 100) + 1] AS p99_ms,
  round(count(*) FILTER (status = 'failed') / count(*)::DOUBLE, 6) AS error_rate FROM requests GROUP BY 1"""


@query("a12_latency_profile", f"WITH {fx.REQUESTS_SQL} {LATENCY_SQL.format(g='model_name')}")
def _(t):
    r = E.latency_profile(fx.requests(t), ["model_name"], "duration_ms", F.col("status") == "failed")
    return r.select(F.col("model_name").alias("grp"), "n", F.round("avg_ms", 6).alias("avg_ms"), "min_ms", "max_ms", "p95_ms", "p99_ms", F.round("error_rate", 6).alias("error_rate"))


@query(
    "a12_latency_profile_with_nulls",
    """WITH r AS (SELECT CASE WHEN user_id % 3 <> 2 THEN 'model_' || (user_id % 3) END AS grp,
        CASE WHEN event_type <> 'error' OR event_id % 2 = 1 THEN value END AS ms, event_type = 'error' AS failed FROM events),
      s AS (SELECT grp, count(*) AS n, round(avg(ms), 6) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms, count(*) FILTER (failed) / count(*)::DOUBLE AS rate,
        list_sort(list(ms) FILTER (ms IS NOT NULL)) AS v FROM r GROUP BY 1)
      SELECT grp, n, avg_ms, min_ms, max_ms, v[least(len(v) * 95 // 100, len(v) - 1) + 1] AS p95_ms, v[least(len(v) * 99 // 100, len(v) - 1) + 1] AS p99_ms,
        round(rate, 6) AS error_rate FROM s""",
)
def _(t):
    kind = F.col("event_type")
    r = t.events.select(
        F.when(F.col("user_id") % 3 != 2, F.concat(F.lit("model_"), F.col("user_id") % 3)).alias("grp"),
        F.when((kind != "error") | (F.col("event_id") % 2 == 1), F.col("value")).alias("ms"), kind,
    )
    r = E.latency_profile(r, ["grp"], "ms", kind == "error")
    return r.select("grp", "n", F.round("avg_ms", 6).alias("avg_ms"), "min_ms", "max_ms", "p95_ms", "p99_ms", F.round("error_rate", 6).alias("error_rate"))


@query(
    "a13_today_count",
    "SELECT count(*) FILTER (event_type = 'click') AS total_processed, count(*) FILTER (ts::DATE = DATE '2024-01-15') AS today_processed FROM events",
)
def _(t):
    return R.processing_counts(t.events, "event_type", "click", "ts", "2024-01-15")


@query(
    "a14_log_level_stats",
    f"""WITH {fx.LOG_LINES_SQL} SELECT count(*) FILTER (contains(lower(line), 'info')) AS info, count(*) FILTER (contains(lower(line), 'warn')) AS warn,
      count(*) FILTER (contains(lower(line), 'error')) AS error, count(*) FILTER (contains(lower(line), 'debug')) AS debug, count(*) AS total FROM log_lines""",
)
def _(t):
    return R.log_level_stats(fx.log_lines(t))


@query(
    "a14_busiest_services",
    f"WITH {fx.LOG_LINES_SQL} SELECT trim(split_part(line, '|', 1)) AS service, count(*) AS n_lines FROM log_lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)
def _(t):
    return R.busiest_services(fx.log_lines(t))


@query(
    "a14_error_patterns",
    f"""WITH {fx.LOG_LINES_SQL} SELECT pattern, event_id, rank FROM (SELECT pattern, event_id, row_number() OVER (PARTITION BY pattern ORDER BY event_id) AS rank
      FROM log_lines, (VALUES ('ERROR'), ('FATAL'), ('Exception'), ('Error'), ('Failed'), ('Timeout'), ('Connection refused'), ('Out of memory'), ('Disk full')) p(pattern)
      WHERE contains(lower(line), lower(pattern))) WHERE rank <= 5""",
)
def _(t):
    return R.error_pattern_matches(fx.log_lines(t), "event_id").select("pattern", "event_id", "rank")


@query(
    "a18_metric_summary",
    """SELECT user_id AS task, event_type AS metric, round(avg(value::DECIMAL(10,2)::DOUBLE), 6) AS avg_value, max(value::DECIMAL(10,2))::DOUBLE AS max_value,
      arg_max(value, ts)::DECIMAL(10,2)::DOUBLE AS last_value FROM events GROUP BY 1, 2""",
)
def _(t):
    r = R.metric_summary(t.events, "user_id", "event_type", "value", "ts", "event_id")
    return r.select(
        F.col("user_id").alias("task"), F.col("event_type").alias("metric"), F.round("avg_value", 6).alias("avg_value"),
        F.col("max_value").cast("double").alias("max_value"), F.col("last_value").cast("double").alias("last_value"),
    )


@query(
    "a18_metric_pivot",
    """SELECT user_id AS task, coalesce(max(value::DECIMAL(10,2)) FILTER (event_type = 'click'), 0)::DOUBLE AS click,
      coalesce(max(value::DECIMAL(10,2)) FILTER (event_type = 'error'), 0)::DOUBLE AS error FROM events GROUP BY 1""",
)
def _(t):
    r = R.metric_summary(t.events, "user_id", "event_type", "value", "ts", "event_id")
    p = R.pivot_metric(r, "user_id", "event_type", "max_value", ["click", "error"])
    return p.select(F.col("user_id").alias("task"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("click", "error")])


@query(
    "a19_access_log_clients",
    f"WITH {fx.ACCESS_LINES_SQL} SELECT split_part(line, ' ', 1) AS client, count(*) AS requests FROM access_lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(t):
    return R.access_log_clients(fx.access_lines(t))


@query("a19_access_log_errors", f"WITH {fx.ACCESS_LINES_SQL} SELECT event_id FROM access_lines WHERE regexp_matches(line, '404|500|403')")
def _(t):
    return R.access_log_errors(fx.access_lines(t)).select("event_id")


# --- paging, top-k, retention ---------------------------------------------------------
@query(
    "l1_page",
    f"WITH {fx.JOBS_SQL} SELECT job_id, strftime(created_at, '{TS}') AS created FROM jobs ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 40",
)
def _(t):
    return R.page(fx.jobs(t), [F.desc("created_at"), F.asc("job_id")], 20, 40).select("job_id", stamp("created_at", "created"))


@query(
    "l1_page_after",
    f"""WITH {fx.JOBS_SQL} SELECT job_id FROM jobs WHERE created_at < TIMESTAMP '1997-06-01' OR (created_at = TIMESTAMP '1997-06-01' AND job_id > 5000)
      ORDER BY created_at DESC, job_id LIMIT 25""",
)
def _(t):
    return R.page_after(fx.jobs(t), "created_at", "job_id", F.lit("1997-06-01").cast("timestamp_ntz"), F.lit(5000), 25).select("job_id")


@query(
    "l2_recent_jobs",
    f"""WITH {fx.JOBS_SQL} (SELECT job_id, 'recent' AS list FROM jobs ORDER BY created_at DESC, job_id LIMIT 10)
      UNION ALL (SELECT job_id, 'running' FROM jobs WHERE status = 'TRAINING' ORDER BY created_at, job_id LIMIT 10)""",
)
def _(t):
    j = fx.jobs(t)
    recent = R.page(j, [F.desc("created_at"), F.asc("job_id")], 10).select("job_id", F.lit("recent").alias("list"))
    running = R.page(j.where(R.is_running("status")), [F.asc("created_at"), F.asc("job_id")], 10)
    return recent.union(running.select("job_id", F.lit("running")))


@query(
    "l3_slowest_processing",
    "SELECT event_id, (props::JSON ->> 'k')::DECIMAL(20,4)::DOUBLE AS took FROM events ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(t):
    return R.slowest_processing(t.events, "props", "$.k", "event_id", 10).select("event_id", F.col("processing_time").cast("double").alias("took"))


@query(
    "l4_top_vocabulary",
    f"""SELECT word, n AS frequency FROM (SELECT word, count(*) AS n FROM (SELECT unnest({fx.tok('text')}) AS word FROM documents WHERE lang = 'en') GROUP BY 1)
      ORDER BY n DESC, word LIMIT 20 OFFSET 10""",
)
def _(t):
    words = t.documents.where("lang = 'en'").select(F.explode(T.tokenize("text", lower=True)).alias("word"))
    return R.page(R.count_by(words, "word", name="frequency"), [F.desc("frequency"), F.asc("word")], 20, 10)


@query(
    "l5_retain_latest",
    "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 3",
)
def _(t):
    return R.retain_latest(t.events, ["user_id"], "ts", "event_id", 3).select("user_id", "event_id", "rank")


@query(
    "l6_cap_per_source",
    "SELECT source, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 7",
)
def _(t):
    return R.cap_per_source(t.documents.select("source", "doc_id"), "source", "doc_id", 7).select("source", "doc_id", "rank")


@query(
    "l6_large_cap_per_source",
    "SELECT event_type, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM events) WHERE rank <= 1500",
)
def _(t):
    return R.cap_per_source(t.events.select("event_type", "event_id"), "event_type", "event_id", 1500).select("event_type", "event_id", "rank")


@query(
    "l7_union_sources",
    """SELECT 'file' AS origin, doc_id::VARCHAR AS id, strlen(text) AS bytes FROM documents UNION ALL
      SELECT 'web', page_id::VARCHAR, strlen(html) FROM pages UNION ALL SELECT 'api', conv_id || ':' || turn, strlen(text) FROM conversations""",
)
def _(t):
    return R.union_sources(
        t.documents.select(F.lit("file").alias("origin"), F.col("doc_id").cast("string").alias("id"), F.octet_length("text").alias("bytes")),
        t.pages.select(F.lit("web").alias("origin"), F.col("page_id").cast("string").alias("id"), F.octet_length("html").alias("bytes")),
        t.conversations.select(F.octet_length("text").alias("bytes"), F.concat("conv_id", F.lit(":"), "turn").alias("id"), F.lit("api").alias("origin")),
    )


@query(
    "l8_keep_after_delete",
    f"""WITH {fx.JOBS_SQL} SELECT job_id FROM jobs WHERE NOT (created_at < TIMESTAMP '1997-01-01' OR status = 'FAILED' OR coalesce(accuracy < 0.2, false) OR job_id = 7)""",
)
def _(t):
    gone = (
        (F.col("created_at") < F.lit("1997-01-01").cast("timestamp_ntz")) | (F.col("status") == "FAILED")
        | (F.col("accuracy") < 0.2) | (F.col("job_id") == 7)
    )
    return R.keep_after_delete(fx.jobs(t), gone).select("job_id")


# --- deduplication, similarity, joins ---------------------------------------------------
@query(
    "j1_dedup_exact",
    "SELECT doc_id, source, sha256(text) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
)
def _(t):
    return R.dedup_exact(t.documents, "text", ["doc_id"]).select("doc_id", "source", "content_hash")


@query(
    "j1_dedup_exact_with_nulls",
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN text END AS text FROM documents)
      SELECT doc_id, sha256(text) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM d) WHERE rn = 1 OR text IS NULL""",
)
def _(t):
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 17 != 0, F.col("text")).alias("text"))
    return R.dedup_exact(d, "text", ["doc_id"]).select("doc_id", "content_hash")


@query(
    "j2_dedup_cleaned_report",
    f"""SELECT count(*) AS total, count(DISTINCT c) AS unique_texts, count(*) - count(DISTINCT c) AS duplicates,
      round((count(*) - count(DISTINCT c)) / count(*)::DOUBLE, 6) AS duplicate_rate FROM (SELECT {fx.clean_sql('text')} AS c FROM documents)""",
)
def _(t):
    r = R.dedup_report(t.documents.select(T.clean_text("text").alias("c")), "c")
    return r.withColumn("duplicate_rate", F.round("duplicate_rate", 6))


# All pairs of texts that share a token, counted; links between equal and different sets alike.
_LINKED = f"""WITH RECURSIVE tk AS (SELECT doc_id, list_sort(list_distinct(list_filter({fx.tok('text')}, lambda x: x NOT IN {STOP_SQL}))) AS s FROM documents),
      keyed AS (SELECT doc_id, s, array_to_string(s, chr(10)) AS k FROM tk WHERE len(s) > 0),
      reps AS (SELECT k, min(doc_id) AS rep, count(*) AS copies, len(any_value(s)) AS n, any_value(s) AS s FROM keyed GROUP BY k),
      words AS (SELECT rep, n, unnest(s) AS w FROM reps),
      met AS (SELECT a.rep AS x, b.rep AS y, a.n AS nx, b.n AS ny, count(*) AS shared FROM words a JOIN words b
        ON a.w = b.w AND a.rep < b.rep AND a.n >= 0.85 * b.n AND b.n >= 0.85 * a.n GROUP BY ALL),
      links AS (SELECT x, y FROM met WHERE shared >= 0.85 * (nx + ny - shared)),
      both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links)"""


@query(
    "j8_near_duplicate_clusters",
    f"""{_LINKED},
      r(n, root) AS (SELECT rep, rep FROM reps UNION SELECT y, root FROM r JOIN both_ways ON x = n),
      c AS (SELECT n, min(root) AS cluster FROM r GROUP BY 1)
      SELECT tk.doc_id, coalesce(c.cluster, tk.doc_id) AS cluster FROM tk LEFT JOIN keyed USING (doc_id) LEFT JOIN reps ON reps.k = keyed.k LEFT JOIN c ON c.n = reps.rep""",
)
def _(t):
    d = t.documents.select("doc_id", T.drop_words(T.tokenize("text", lower=True), STOP).alias("tk"))
    return near_duplicate_clusters(d, "doc_id", "tk")


@query(
    "j7_similarity_join",
    f"""{_LINKED},
      others AS (SELECT x AS rep, sum(copies) AS n FROM both_ways JOIN reps ON reps.rep = y GROUP BY 1)
      SELECT tk.doc_id, CAST(coalesce(reps.copies - 1, 0) + coalesce(others.n, 0) AS BIGINT) AS n_links
      FROM tk LEFT JOIN keyed USING (doc_id) LEFT JOIN reps ON reps.k = keyed.k LEFT JOIN others ON others.rep = reps.rep""",
)
def _(t):
    d = t.documents.select("doc_id", T.drop_words(T.tokenize("text", lower=True), STOP).alias("tk"))
    return similar_sets(d, "doc_id", "tk").select("doc_id", "n_links")


@query("j4_anti_join_processed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return R.anti_join_processed(t.documents.select("doc_id"), t.labels, "doc_id", "doc_id")


@query("j5_semi_join_ids", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    return R.semi_join_ids(t.documents.select("doc_id", "n_chars"), t.labels.where("toxic = 1"), "doc_id")


@query(
    "j6_tasks_and_models",
    """SELECT o_orderkey, c_mktsegment, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def _(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    o = t.orders.select("o_orderkey", "o_custkey").join(lines, "o_orderkey")
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return o.join(c, "o_custkey").select("o_orderkey", "c_mktsegment", "n_lines")


@query("j6_orphans", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return R.orphans(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey")


@query(
    "j7_similarity_of_pairs",
    f"""WITH {fx.QA_SQL}, f AS (SELECT conv_id, turn, {fx.tok('question')} AS a, {fx.tok('answer')} AS b FROM qa),
      s AS (SELECT conv_id, turn, list_distinct(list_filter(a, lambda x: x NOT IN {STOP_SQL})) AS a, list_distinct(list_filter(b, lambda x: x NOT IN {STOP_SQL})) AS b FROM f)
    SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END, 6) AS similarity FROM s""",
)
def _(t):
    tokens = lambda c: T.drop_words(T.tokenize(c, lower=True), STOP)
    pairs = fx.qa_pairs(t).select("conv_id", "turn", tokens("question").alias("a"), tokens("answer").alias("b"))
    return R.similarity_of_pairs(pairs, "a", "b").select("conv_id", "turn", F.round("similarity", 6).alias("similarity"))


@query(
    "j9_similar_by_feature_overlap",
    """WITH tgt AS (SELECT unnest(embedding)::DOUBLE AS b FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a FROM embeddings WHERE vec_id <> 0)
      SELECT vec_id, count(*) FILTER (abs(a - b) < 0.01::DOUBLE) AS overlap FROM x, tgt GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(t):
    r = R.similar_by_feature_overlap(t.embeddings, "vec_id", "embedding", 0, 0.01, 10)
    return r.select("vec_id", F.col("overlap").cast("long").alias("overlap"))


@query(
    "j9_similar_to_targets",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a FROM embeddings),
      g AS (SELECT vec_id AS target, unnest(embedding)::DOUBLE AS b FROM embeddings WHERE vec_id % 100 = 0),
      s AS (SELECT target, vec_id, count(*) FILTER (abs(a - b) < 0.01::DOUBLE) AS overlap FROM g JOIN x ON vec_id <> target GROUP BY 1, 2)
      SELECT target, vec_id, overlap, CAST(row_number() OVER (PARTITION BY target ORDER BY overlap DESC, vec_id) AS INTEGER) AS rank FROM s
      QUALIFY row_number() OVER (PARTITION BY target ORDER BY overlap DESC, vec_id) <= 10""",
)
def _(t):
    return R.similar_to_targets(t.embeddings, "vec_id", "embedding", F.col("vec_id") % 100 == 0, 0.01, 10)


@query(
    "j10_lexicon_join",
    f"""SELECT doc_id, len(k) AS n, len(tk) - len(k) AS removed FROM (SELECT doc_id, tk, list_filter(tk, lambda x: x NOT IN {STOP_SQL}) AS k FROM (SELECT doc_id, {fx.tok('text')} AS tk FROM documents))""",
)
def _(t):
    d = t.documents.select("doc_id", T.tokenize("text", lower=True).alias("tk"))
    lexicon = d.select(F.explode("tk").alias("word")).where(F.col("word").isin(STOP)).distinct()
    return remove_stop_words(d, "tk", lexicon, "doc_id").select(
        "doc_id", F.size("filtered_tokens").alias("n"), (F.size("tk") - F.size("filtered_tokens")).alias("removed")
    )


# --- keyed updates ------------------------------------------------------------------------
@query(
    "u1_upsert_vocabulary",
    f"""WITH w AS (SELECT doc_id, lang, unnest({fx.tok('text')}) AS word FROM documents)
      SELECT word, lang AS language, count(*) FILTER (doc_id % 2 = 0) + count(*) FILTER (doc_id % 2 = 1) AS frequency FROM w GROUP BY 1, 2""",
)
def _(t):
    d = t.documents.select("doc_id", F.col("lang").alias("language"), T.tokenize("text", lower=True).alias("tk"))
    w = term_counts(d, "doc_id", "tk", "language").select("doc_id", F.col("term").alias("word"), "language", F.col("tf").alias("frequency"))
    known = w.where("doc_id % 2 = 0").groupBy("word", "language").agg(F.sum("frequency").alias("frequency"))
    return R.upsert_vocabulary(known, w.where("doc_id % 2 = 1"))


@query(
    "u2_apply_status_events",
    f"""WITH {fx.JOB_EVENTS_SQL}, f AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) FILTER (status = 'running') AS started_at,
      max(ts) FILTER (status IN ('completed', 'failed')) AS ended_at, arg_max(error, (ts, event_id)) FILTER (error <> '') AS error FROM job_events GROUP BY 1)
      SELECT c_custkey AS job_id, coalesce(f.status, 'stored') AS status, strftime(coalesce(f.started_at, TIMESTAMP '2020-01-01'), '{TS}') AS started_at,
      strftime(f.ended_at, '{TS}') AS ended_at, f.error FROM customer LEFT JOIN f ON f.job_id = c_custkey""",
)
def _(t):
    jobs = t.customer.select(
        F.col("c_custkey").alias("job_id"), F.lit("stored").alias("status"), F.lit("2020-01-01").cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("ended_at"), F.lit(None).cast("string").alias("error"),
    )
    r = R.apply_status_events(fx.job_events(t), "job_id", "ts", "event_id", "status", "error", jobs)
    return r.select("job_id", "status", stamp("started_at"), stamp("ended_at"), "error")


@query(
    "u3_progress_percent",
    """SELECT p_partkey, (p_size * 100 // 40)::INT AS collected_pct,
      round(least(100.0::DOUBLE, ((p_size % 10) / 10.0::DOUBLE + (p_size % 7) / 7.0::DOUBLE / 10.0::DOUBLE) * 100), 6) AS training_pct FROM part""",
)
def _(t):
    n = F.col("p_size")
    return t.part.select(
        "p_partkey", S.progress_percent(n, F.lit(40)).alias("collected_pct"),
        F.round(S.training_progress(n % 10, F.lit(10), n % 7, F.lit(7)), 6).alias("training_pct"),
    )


@query("u4_upsert_latest", "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1")
def _(t):
    e = t.events.select("user_id", "ts", "event_id", "value")
    return R.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("u5_live_rows", "SELECT event_id FROM events WHERE event_type <> 'signup'")
def _(t):
    e = t.events.withColumn("deleted_at", F.when(F.col("event_type") == "signup", F.col("ts")))
    return R.live_rows(e).select("event_id")


@query(
    "u6_apply_metric_updates",
    """WITH j AS (SELECT c_custkey AS job_id, c_acctbal AS loss, 0.5::DOUBLE AS accuracy FROM customer),
      u AS (SELECT user_id AS job_id, (ts::DATE, event_id) AS ts, CASE WHEN event_type = 'click' THEN value END AS loss, CASE WHEN event_type = 'view' THEN value / 1000 END AS accuracy FROM events),
      n AS (SELECT job_id, arg_max(loss, ts) FILTER (loss IS NOT NULL) AS loss, arg_max(accuracy, ts) FILTER (accuracy IS NOT NULL) AS accuracy FROM u GROUP BY 1)
      SELECT j.job_id, coalesce(n.loss, j.loss) AS loss, round(coalesce(n.accuracy, j.accuracy), 8) AS accuracy FROM j LEFT JOIN n ON n.job_id = j.job_id""",
)
def _(t):
    j = t.customer.select(F.col("c_custkey").alias("job_id"), F.col("c_acctbal").alias("loss"), F.lit(0.5).alias("accuracy"))
    u = t.events.select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("date").alias("ts"), F.when(F.col("event_type") == "click", F.col("value")).alias("loss"),
        F.when(F.col("event_type") == "view", F.col("value") / 1000).alias("accuracy"),
    )
    r = R.apply_metric_updates(j, u, "job_id", ["loss", "accuracy"], "ts", "event_id")
    return r.select("job_id", "loss", F.round("accuracy", 8).alias("accuracy"))
