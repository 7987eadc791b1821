"""Finders, aggregates, paging, deduplication, joins and keyed updates over the engine's tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from modsift import values as V
from modsift.functions import text as T
from modsift.functions.text import as_col
from modsift.operators.scale import first_per_key, last_per_key, stored, top_n_per_key

RUNNING_STATES = ("TRAINING", "PREPARING", "EVALUATING")
FINISHED_STATES = ("COMPLETED", "FAILED", "CANCELLED")


# --- finders ---------------------------------------------------------------------
def all_of(conditions: list[Column | None]) -> Column:
    """Conjunction of the conditions given; None means 'not asked'."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def texts_labeled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNotNull())


def texts_unlabeled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNull())


def texts_by_label(df: DataFrame, value, label: str = "label") -> DataFrame:
    return df.where(F.col(label) == value)


def texts_with_features(df: DataFrame, features: str = "features", low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows with features; the bounds, when given, apply to the number of features."""
    size = F.size(features)
    return df.where(
        all_of([F.col(features).isNotNull(), size >= low if low is not None else None,
                size <= high if high is not None else None])
    )


def texts_needing_reprocessing(df: DataFrame, metadata: str = "processing_metadata") -> DataFrame:
    return df.where(F.get_json_object(metadata, "$.needsReprocessing") == "true")


def texts_by_length_between(df: DataFrame, text: str, low: int, high: int) -> DataFrame:
    return df.where(T.byte_length(text).between(low, high))


def created_between(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Rows in the closed time range; an open end is left out of the filter."""
    return df.where(
        all_of([
            F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType) if start is not None else None,
            F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType) if end is not None else None,
        ])
    )


def keyword_hit(keyword: str, text: Column | str, tokens: Column | str | None = None) -> Column:
    """Whether the text or any token contains the keyword, wildcards taken literally."""
    hit = as_col(text).contains(keyword)
    return hit if tokens is None else hit | F.exists(as_col(tokens), lambda t: t.contains(keyword))


def search_keyword(df: DataFrame, keyword: str, text: str, tokens: str | None = None) -> DataFrame:
    return df.where(keyword_hit(keyword, text, tokens))


def tokens_containing(df: DataFrame, token: str, tokens: str) -> DataFrame:
    return df.where(F.array_contains(tokens, token))


def search_jobs(
    df: DataFrame, text: str | None = None, text_columns: tuple[str, ...] = ("job_name", "description"),
    equals: dict[str, object] | None = None, ts: str | None = None, start=None, end=None,
) -> DataFrame:
    hits = None
    if text is not None:
        hits = reduce(
            lambda a, b: a | b,
            [F.coalesce(F.lower(c).contains(text.lower()), F.lit(False)) for c in text_columns],
        )
    same = [F.col(k) == v for k, v in (equals or {}).items() if v is not None]
    found = df.where(all_of([hits, *same]))
    return created_between(found, ts, start, end) if ts else found


def filter_metric(df: DataFrame, metric: str, above=None, low=None, high=None, present: bool | None = None) -> DataFrame:
    """Threshold finder: strictly above, inside a closed range, or (not) present."""
    c = F.col(metric)
    return df.where(
        all_of([
            c > above if above is not None else None,
            c.between(low, high) if low is not None else None,
            (c.isNotNull() if present else c.isNull()) if present is not None else None,
        ])
    )


def is_running(status: Column | str) -> Column:
    return as_col(status).isin(*RUNNING_STATES)


def is_finished(status: Column | str) -> Column:
    return as_col(status).isin(*FINISHED_STATES)


def live_rows(df: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    return df.where(F.col(deleted_at).isNull())


# --- counts and averages ---------------------------------------------------------------
def count_by(df: DataFrame, *keys: str, skip_null: bool = False, name: str = "n") -> DataFrame:
    if skip_null:
        df = df.where(all_of([F.col(k).isNotNull() for k in keys]))
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def count_each(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Counts per value of each key in one pass: (dimension, value, n)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys])
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias(name))


def data_quality_statistics(df: DataFrame, content: str, tokens: str, features: str, label: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(F.octet_length(content), F.lit(0)) > 0).alias("with_content"),
        F.count_if(F.coalesce(F.size(tokens), F.lit(0)) > 0).alias("with_tokens"),
        F.count_if(F.col(features).isNotNull()).alias("with_features"),
        F.count_if(F.col(label).isNotNull()).alias("with_label"),
    )


def average_text_shape(df: DataFrame, content: str, tokens: str, dimension: str) -> DataFrame:
    return df.agg(
        F.avg(F.octet_length(content)).alias("avg_text_length"),
        F.avg(F.size(tokens)).alias("avg_token_count"),
        F.avg(dimension).alias("avg_feature_dimension"),
    )


def preprocessing_statistics(df: DataFrame, content: str, tokens: str, features: str, label: str, source: str) -> DataFrame:
    """Counts and averages per source, plus one row over all sources (source is null, is_total true)."""
    return df.rollup(source).agg(
        (F.grouping(source) == 1).alias("is_total"),
        F.count("*").alias("total"),
        F.avg(F.octet_length(content)).alias("avg_text_length"),
        F.avg(F.size(tokens)).alias("avg_token_count"),
        F.count(features).alias("with_features"),
        F.count(label).alias("with_label"),
    )


def job_statistics(df: DataFrame, status: str, states: list[str]) -> DataFrame:
    """One row: a count per state and the share of completed among finished, in percent."""
    counts = [F.count_if(F.col(status) == s).alias(s.lower()) for s in states]
    done = F.count_if(F.col(status) == "COMPLETED")
    total = F.count("*")
    return df.agg(total.alias("total"), *counts, F.when(total > 0, done * 100.0 / total).otherwise(0.0).alias("success_rate"))


def rows_with_extreme(df: DataFrame, metric: str, largest: bool = True) -> DataFrame:
    """Every row that ties for the extreme of a metric; nulls do not take part."""
    best = df.agg((F.max(metric) if largest else F.min(metric)).alias("m")).scalar()
    return df.where(F.col(metric) == best)


def request_statistics(df: DataFrame, now: Column | None = None, window: str = "INTERVAL 1 HOUR", seconds: float = 3600.0) -> DataFrame:
    """Totals, mean latency of completed requests and the recent request rate.

    ``now`` defaults to the newest request of the table.
    """
    now = df.agg(F.max("created_at").alias("m")).scalar() if now is None else now
    done = F.col("status") == "completed"
    return df.agg(
        F.count("*").alias("total_requests"),
        F.count_if(done).alias("completed_requests"),
        F.count_if(F.col("status") == "failed").alias("failed_requests"),
        F.coalesce(F.avg(F.when(done & (F.col("duration_ms") > 0), F.col("duration_ms"))), F.lit(0.0)).alias("average_latency"),
        (F.count_if(F.col("created_at") > now - F.expr(window)) / F.lit(seconds)).alias("requests_per_second"),
    )


def model_statistics(df: DataFrame, status: str = "status") -> DataFrame:
    return df.agg(
        F.count("*").alias("total_models"),
        F.count_if(F.col(status) == "loaded").alias("loaded_models"),
        F.count_if(F.col(status) == "unloaded").alias("unloaded_models"),
        F.count_if(F.col(status) == "error").alias("error_models"),
    )


def processing_counts(df: DataFrame, source: str, value: str, ts: str, day) -> DataFrame:
    """Rows of a source in all, and rows of any source on one day."""
    return df.agg(
        F.count_if(F.col(source) == value).alias("total_processed"),
        F.count_if(F.to_date(ts) == F.lit(day).cast("date")).alias("today_processed"),
    )


def corpus_quality_report(df: DataFrame, text: str) -> DataFrame:
    """Totals of valid (10..1000 bytes), distinct and Chinese texts.

    Copies are counted by content hash first: the second step sees each text once.
    """
    size = T.byte_length(text)
    per_text = df.groupBy(F.sha2(F.col(text), 256).alias("h")).agg(
        F.count("*").alias("n"),
        F.max(size).alias("bytes"),
        F.max(T.contains_chinese(text)).alias("zh"),
    )
    valid = F.col("bytes").between(10, 1000)
    n = F.col("n")
    return per_text.agg(
        F.sum("n").alias("total"),
        F.sum(F.when(valid, n).otherwise(0)).alias("valid"),
        F.count("*").alias("unique_texts"),
        F.sum(F.when(F.col("zh"), n).otherwise(0)).alias("chinese"),
        (F.sum(n * F.col("bytes")) / F.sum("n")).alias("avg_length"),
        (F.sum(F.when(valid, n).otherwise(0)) * 100.0 / F.sum("n")).alias("quality_score"),
    )


def metric_summary(df: DataFrame, task: str, metric: str, value: str, ts: str, tie: str) -> DataFrame:
    amount = F.col(value).cast("decimal(10,2)")
    return df.groupBy(task, metric).agg(
        F.avg(amount.cast("double")).alias("avg_value"),
        F.max(amount).alias("max_value"),
        F.max_by(amount, F.struct(ts, tie)).alias("last_value"),
    )


def pivot_metric(summary: DataFrame, task: str, metric: str, value: str, names: list[str]) -> DataFrame:
    return summary.groupBy(task).pivot(metric, names).agg(F.max(value))


# --- log lines -----------------------------------------------------------------------------
def log_level_stats(lines: DataFrame, line: str = "line") -> DataFrame:
    def has(word: str) -> Column:
        return F.count_if(F.lower(line).contains(word.lower())).alias(word.lower())

    return lines.agg(has("INFO"), has("WARN"), has("ERROR"), has("DEBUG"), F.count("*").alias("total"))


def busiest_services(lines: DataFrame, line: str = "line", k: int = 5) -> DataFrame:
    service = F.regexp_extract(line, r"^[^|]*", 0)
    return (
        lines.groupBy(F.trim(service).alias("service"))
        .agg(F.count("*").alias("n_lines"))
        .orderBy(F.desc("n_lines"), F.asc("service"))
        .limit(k)
    )


def error_pattern_matches(lines: DataFrame, order: str, line: str = "line", patterns: list[str] | None = None, first: int = 5) -> DataFrame:
    """The first matching lines of every error pattern, case-insensitive."""
    patterns = V.LOG_ERROR_PATTERNS if patterns is None else patterns
    hits = F.filter(
        F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(F.lower(F.col(line)), F.lower(p))
    )
    matched = lines.select(order, line, F.explode(hits).alias("pattern"))
    return top_n_per_key(matched, ["pattern"], [F.asc(order)], first)


def access_log_clients(lines: DataFrame, line: str = "line", k: int = 10) -> DataFrame:
    client = F.regexp_extract(line, r"^\s*(\S+)", 1)
    return (
        lines.groupBy(client.alias("client")).agg(F.count("*").alias("requests"))
        .orderBy(F.desc("requests"), F.asc("client")).limit(k)
    )


def access_log_errors(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.where(F.col(line).rlike("404|500|403"))


# --- paging, retention ------------------------------------------------------------------------
def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, ts: str, row_id: str, last_ts, last_id, limit: int) -> DataFrame:
    """Keyset page for newest-first order: a filter instead of skipping rows."""
    older = (F.col(ts) < last_ts) | ((F.col(ts) == last_ts) & (F.col(row_id) > last_id))
    return df.where(older).orderBy(F.desc(ts), F.asc(row_id)).limit(limit)


def slowest_processing(df: DataFrame, metadata: str, path: str, row_id: str, k: int) -> DataFrame:
    took = F.get_json_object(metadata, path).try_cast("decimal(20,4)")
    return df.withColumn("processing_time", took).where("processing_time IS NOT NULL").orderBy(
        F.desc("processing_time"), F.asc(row_id)
    ).limit(k)


def retain_latest(df: DataFrame, keys: list[str], ts: str, tie: str, n: int) -> DataFrame:
    return top_n_per_key(df, keys, [F.desc(ts), F.desc(tie)], n)


def cap_per_source(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    return top_n_per_key(df, [source], [F.asc(order)], n)


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_after_delete(df: DataFrame, condition: Column) -> DataFrame:
    """The rows a delete leaves behind; rows where the condition is unknown stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


# --- deduplication and similarity ----------------------------------------------------------------
def dedup_exact(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Keep the first row of every distinct content, by SHA-256; rows without content are no copies of each other.

    ``order`` is a total order.  Only hash and order are aggregated and shuffled; the rows that stay are then
    found by them, and Spark reads and moves just the columns asked for.
    """
    keyed = df.withColumn("content_hash", F.sha2(F.col(text), 256))
    firsts = keyed.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min(F.struct(*order)).alias("__first"))
    firsts = firsts.select(F.col("content_hash").alias("__hash"), *[F.col(f"__first.`{c}`").alias(f"__{i}") for i, c in enumerate(order)])
    same = F.col("content_hash") == F.col("__hash")
    for i, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"__{i}"))
    kept = keyed.where(F.col("content_hash").isNotNull()).join(firsts, same, "left_semi")
    return kept.unionByName(keyed.where(F.col("content_hash").isNull())).select(*df.columns, "content_hash")


def dedup_report(df: DataFrame, cleaned: str) -> DataFrame:
    per_text = df.groupBy(F.sha2(F.col(cleaned), 256).alias("h")).agg(F.count("*").alias("n"))
    return per_text.agg(
        F.sum("n").alias("total"),
        F.count("*").alias("unique_texts"),
        (F.sum("n") - F.count("*")).alias("duplicates"),
        ((F.sum("n") - F.count("*")) / F.sum("n")).alias("duplicate_rate"),
    )


def similarity_of_pairs(pairs: DataFrame, left_tokens: str, right_tokens: str, threshold: float | None = None) -> DataFrame:
    """Jaccard similarity of each given pair of token lists; optionally only pairs at or above a threshold."""
    out = pairs.withColumn("similarity", T.jaccard(left_tokens, right_tokens))
    return out if threshold is None else out.where(F.col("similarity") >= threshold)


def similar_by_feature_overlap(df: DataFrame, row_id: str, features: str, target_id, threshold: float, k: int) -> DataFrame:
    """Top k rows by the number of value pairs (i, j) closer than ``threshold`` to the target's vector.

    The target vector is one row, read as a scalar; every other row is scored on its own.
    """
    target = df.where(F.col(row_id) == target_id).select(F.transform(features, lambda x: x.cast("double"))).scalar()
    scored = df.where(F.col(row_id) != target_id).withColumn("__target", target)
    near = F.aggregate(
        features,
        F.lit(0),
        lambda acc, a: acc + F.size(F.filter("__target", lambda b: F.abs(a.cast("double") - b) < threshold)),
    )
    return (
        scored.select(row_id, near.alias("overlap"))
        .orderBy(F.desc("overlap"), F.asc(row_id))
        .limit(k)
    )


TARGET_BLOCK = 2048


def _pooled(batch) -> tuple[np.ndarray, np.ndarray]:
    """Finite values of a column of number lists, ascending, with the place of the row that each comes from."""
    column = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    owner = np.repeat(np.arange(len(column)), np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64))
    finite = np.isfinite(values)
    values, owner = values[finite], owner[finite]
    order = np.argsort(values, kind="stable")
    return values[order], owner[order]


def _first_where(holds, n: int, size: int) -> np.ndarray:
    """Per element the first place in 0..n at which ``holds(places)``, which stays true once it is, is true (n: nowhere)."""
    low, high = np.zeros(size, np.int64), np.full(size, n, np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        yes = open_ & holds(np.minimum(middle, n - 1))
        high, low = np.where(yes, middle, high), np.where(open_ & ~yes, middle + 1, low)
    return low


def _best_of_blocks(threshold: float, k: int, kind: pa.DataType):
    """A block of rows and one of targets -> the k best rows of the block for each target.

    The rows' values are sorted once; a target's value meets a range of them, found by the exact test, and the ranges of
    all its values add up to how often each value counts.
    """

    def run(key, rows: pa.Table, targets: pa.Table) -> pa.Table:
        found = {"target": [], "row": [], "overlap": []}
        if len(rows) and len(targets):
            rows = rows.sort_by("row")
            ids = rows.column("row").combine_chunks()
            values, owner = _pooled(rows.column("v"))
            sought, of = _pooled(targets.column("w"))
            n, place = len(values), {x: i for i, x in enumerate(ids.to_pylist())}
            if n and len(sought):
                start = _first_where(lambda at: values[at] - sought > -threshold, n, len(sought))
                end = _first_where(lambda at: ~(values[at] - sought < threshold), n, len(sought))
            else:
                start = end = np.zeros(len(sought), np.int64)
            by_target = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[by_target], np.arange(len(targets) + 1))
            for i, target in enumerate(targets.column("target").to_pylist()):
                mine = by_target[bounds[i] : bounds[i + 1]]
                steps = np.bincount(start[mine], minlength=n + 1) - np.bincount(end[mine], minlength=n + 1)
                counts = np.bincount(owner, weights=np.cumsum(steps[:n]), minlength=len(ids)).astype(np.int64)
                rank = counts * len(ids) + np.arange(len(ids))[::-1]  # more pairs first, then smaller ids
                if target in place:
                    rank[place[target]] = -1
                best = np.argpartition(rank, -k)[-k:] if len(rank) > k else np.arange(len(rank))
                best = best[rank[best] >= 0]
                found["target"] += [target] * len(best)
                found["row"].append(ids.take(pa.array(best)))
                found["overlap"].append(counts[best])
        rows = pa.chunked_array(found["row"], kind)
        overlap = np.concatenate(found["overlap"]) if found["overlap"] else np.empty(0, np.int64)
        return pa.table({"target": pa.array(found["target"], kind), "row": rows, "overlap": pa.array(overlap, pa.int64())})

    return run


def similar_to_targets(df: DataFrame, row_id: str, features: str, is_target: Column, threshold: float, k: int, block: int = TARGET_BLOCK) -> DataFrame:
    """(target, row id, overlap, rank): for every target row the k other rows with the most value pairs (i, j) closer than ``threshold``.

    Every block of targets meets every block of rows in a task of its own, which returns k rows per target, so pairs of
    values and of rows never become rows of a table.  Null and non-finite values meet nothing.  Ties go to the
    smaller id; rows without a pair rank last, with overlap 0.  Rows under one id count as one, null ids are left out.
    """
    kind = df.schema[row_id].dataType
    id_type = kind.simpleString()
    values = F.transform(F.coalesce(features, F.array().cast(df.schema[features].dataType)), lambda x: x.cast("double"))
    known = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("row"), values.alias("v"), F.coalesce(is_target, F.lit(False)).alias("t"))
    pooled = known.groupBy("row").agg(
        F.flatten(F.collect_list("v")).alias("v"), F.flatten(F.collect_list(F.when(F.col("t"), F.col("v")))).alias("w"), F.max("t").alias("t")
    )
    pooled = stored(pooled)
    n_rows, n_targets = pooled.agg(F.count("*"), F.count_if("t")).first()
    parts = lambda n: max(1, -(-n // block))
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(parts(n))).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(parts(n) - 1)))
    rows = pooled.select(part(n_rows).alias("i"), copies(n_targets).alias("j"), "row", "v")
    targets = pooled.where("t").select(copies(n_rows).alias("i"), part(n_targets).alias("j"), F.col("row").alias("target"), "w")
    arrow = to_arrow_type(kind)
    best = rows.groupBy("i", "j").cogroup(targets.groupBy("i", "j")).applyInArrow(
        _best_of_blocks(threshold, k, arrow), f"target {id_type}, row {id_type}, overlap long"
    )
    ranked = top_n_per_key(best, ["target"], [F.desc("overlap"), F.asc("row")], k)
    return ranked.select("target", F.col("row").alias(row_id), "overlap", "rank")


def anti_join_processed(raw: DataFrame, processed: DataFrame, raw_id: str, processed_raw_id: str) -> DataFrame:
    done = processed.select(F.col(processed_raw_id).alias(raw_id)).distinct()
    return raw.join(done, raw_id, "left_anti")


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.join(keys, child_key, "left_anti")


# --- keyed updates -----------------------------------------------------------------------------------
def upsert_vocabulary(vocabulary: DataFrame, increments: DataFrame) -> DataFrame:
    """Insert unseen (word, language) pairs, add to the frequency of known ones."""
    return (
        vocabulary.select("word", "language", "frequency")
        .unionByName(increments.select("word", "language", "frequency"))
        .groupBy("word", "language")
        .agg(F.sum("frequency").alias("frequency"))
    )


def upsert_latest(current: DataFrame, changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    return last_per_key(union_sources(current, changes), keys, [F.col(v) for v in version])


def apply_status_events(
    events: DataFrame, job: str, ts: str, tie: str, status: str, error: str, jobs: DataFrame | None = None
) -> DataFrame:
    """Fold a status event log into one row per job.

    Every 'running' sets the start anew, the last terminal event the end; an error message counts only
    when non-empty.  One aggregate, reduced before the shuffle.  ``jobs`` (job, status, started_at, ended_at,
    error) are the stored rows: jobs without events stay as they are, and what no event sets keeps its stored value.
    """
    order = F.struct(ts, tie)
    terminal = F.col(status).isin("completed", "failed")
    folded = events.groupBy(job).agg(
        F.max_by(status, order).alias("status"),
        F.max(F.when(F.col(status) == "running", F.col(ts))).alias("started_at"),
        F.max(F.when(terminal, F.col(ts))).alias("ended_at"),
        F.max_by(F.when(F.col(error) != "", F.col(error)), F.when(F.col(error) != "", order)).alias("error"),
    )
    if jobs is None:
        return folded
    names = ["status", "started_at", "ended_at", "error"]
    new = folded.select(F.col(job).alias("__job"), *[F.col(c).alias(f"__{c}") for c in names])
    joined = jobs.join(new, jobs[job] == F.col("__job"), "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in names}).drop("__job", *[f"__{c}" for c in names])


def apply_metric_updates(jobs: DataFrame, updates: DataFrame, job: str, metrics: list[str], ts: str, tie: str) -> DataFrame:
    """Partial updates: the latest non-null value of each metric wins, null leaves the old value; ``tie`` orders equal times."""
    latest = updates.groupBy(job).agg(
        *[
            F.max_by(F.col(m), F.when(F.col(m).isNotNull(), F.struct(ts, tie))).alias(f"__new_{m}")
            for m in metrics
        ]
    )
    joined = jobs.join(latest, job, "left")
    for m in metrics:
        joined = joined.withColumn(m, F.coalesce(f"__new_{m}", m)).drop(f"__new_{m}")
    return joined
