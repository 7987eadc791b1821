"""Structured Streaming: message sources, the processing chain, sinks with replay safety."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from modsift.functions import scores as S
from modsift.operators.features import forum_features, process_texts
from modsift.operators.scale import compute_once
from modsift.sources.sinks import error_rows, path_exists
from modsift.streaming.windows import LATENESS

RAW_MESSAGE = (
    "id STRING, content STRING, dataSource STRING, labels ARRAY<STRING>, "
    "metadata MAP<STRING,STRING>, createdAt TIMESTAMP"
)


# --- sources -----------------------------------------------------------------------
def read_raw_text_stream(spark: SparkSession, path: str | None = None, kafka: dict[str, str] | None = None, per_trigger: int = 100) -> DataFrame:
    """JSON text messages from a folder of files or a Kafka topic (connector jar needed).

    ``per_trigger``: files per micro-batch, or offsets per micro-batch.
    """
    if kafka:
        lines = (
            spark.readStream.format("kafka").option("startingOffsets", "earliest")
            .option("maxOffsetsPerTrigger", per_trigger).options(**kafka).load()
            .select(F.col("value").cast("string").alias("value"))
        )
    else:
        lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    return parse_messages(lines, "value")


def parse_messages(lines: DataFrame, value: str, schema: str = RAW_MESSAGE) -> DataFrame:
    """Parsed message fields; ``parse_error`` is set where the JSON or its id or content is missing."""
    parsed = compute_once(lines.select(F.col(value).alias("raw_message")), "m", F.from_json("raw_message", schema)).select("raw_message", "m.*")
    bad = F.col("id").isNull() | F.col("content").isNull()
    return parsed.withColumn("parse_error", F.when(bad, F.lit("unreadable message")))


# --- transformations ---------------------------------------------------------------------
def dedup_stream(df: DataFrame, text: str, ts: str, delay: str = LATENESS) -> DataFrame:
    """Drop repeats of a content seen within the watermark delay; state is bounded by time."""
    hashed = df.withColumn("content_hash", F.sha2(F.col(text), 256))
    if not df.isStreaming:
        return hashed.dropDuplicates(["content_hash"])
    return hashed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_hash"])


def process_messages(messages: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Text processing with the parse error folded into success/error; same for tables and streams."""
    done = process_texts(messages, "content", stop_words)
    ok = F.col("parse_error").isNull() & F.coalesce(F.col("success"), F.lit(False))
    return done.withColumn("error", F.coalesce("parse_error", "error", F.when(~ok, F.lit("processing failed")))).withColumn(
        "success", ok
    ).withColumn("tag_label", S.label_from_tags(F.coalesce("labels", F.array().cast("array<string>"))))


def process_forum_records(records: DataFrame, min_quality: float = 0.6) -> DataFrame:
    """Forum chain in its cheap-first order: content rules, quality gate, processing, forum features."""
    valid = records.where(S.forum_content_valid("content", "vote_count"))
    scored = valid.withColumn("quality_score", S.assess_quality("content", "vote_count", "comment_count"))
    good = scored.where(F.col("quality_score") >= min_quality).withColumn("quality_label", S.quality_label("quality_score"))
    return forum_features(process_texts(good, "content"), "content")


# --- sinks -----------------------------------------------------------------------------------
def with_retries(fn: Callable[[], None], attempts: int = 3, backoff: float = 1.0) -> None:
    """Run a sink action again on failure, waiting longer each time; the last failure is raised."""
    for attempt in range(1, attempts + 1):
        try:
            return fn()
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(backoff * attempt)


def write_batch_folder(df: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Write one micro-batch to its own folder; a replayed batch replaces itself, another run's batches stay."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")


def unseen(batch: DataFrame, path: str | list[str], run: str, batch_id: int, key: str = "id", target_key: str = "raw_text_id") -> DataFrame:
    """The rows of a micro-batch whose id is not in the target (or any of several) yet.

    The batch's own folder does not count, so that a replayed batch writes the same rows again.  Only the key
    column of the target is read; Spark joins it to the small batch without moving it where it can.
    """
    spark, other = batch.sparkSession, (F.col("run") != run) | (F.col("batch_id") != batch_id)
    for target in [path] if isinstance(path, str) else path:
        if path_exists(spark, target):
            done = spark.read.parquet(target).where(other)
            batch = batch.join(done.select(F.col(target_key).alias(key)), key, "left_anti")
    return batch


def skip_processed(batch: DataFrame, path: str | list[str], run: str, batch_id: int, key: str = "id", target_key: str = "raw_text_id") -> DataFrame:
    """``unseen``, each id once."""
    return unseen(batch, path, run, batch_id, key, target_key).dropDuplicates([key])  # last, so that known ids are not sorted with their contents


def named_failures(messages: DataFrame) -> DataFrame:
    """Unreadable messages get the digest of the message as id, so that they never stand for the id of a readable one; only they keep the message."""
    unreadable = F.col("parse_error").isNotNull()
    digest = F.sha2(F.coalesce("raw_message", F.lit("")), 256)
    return messages.withColumn("id", F.when(unreadable, digest).otherwise(F.col("id"))).withColumn("raw_message", F.when(unreadable, F.col("raw_message")))


def processed_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").alias("raw_text_id"), F.col("cleaned").alias("content"), F.col("dataSource").alias("source"),
        "tokens", "statistical", "sentiment", "language", "processing_metadata", "tag_label",
    )


def feature_messages(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").alias("key"),
        F.to_json(F.struct(F.col("id").alias("textId"), F.struct("statistical", "sentiment", "language").alias("textFeatures"))).alias("value"),
    )


def process_stream(
    messages: DataFrame, out: str, checkpoint: str, stop_words: list[str] | None = None,
    attempts: int = 3, trigger: dict | None = None,
) -> StreamingQuery:
    """Failures to ``errors``, the rest to ``processed`` and ``features``; ids that are in either already are skipped.

    Unreadable messages are failures too: their ``errors`` row holds the message, and its SHA-256 as id.  Offsets are
    committed after the sinks return (checkpoint) and every sink folder is keyed by checkpoint and batch id, so
    neither a lost executor nor a restart, also with a fresh checkpoint, doubles a row.  ``processed`` is written last:
    an id in it has its features, so a batch that failed between the sinks is taken up again, not skipped as done.
    Equal contents with different ids are different texts.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def sink(arrived: DataFrame, batch_id: int) -> None:
        fresh = skip_processed(named_failures(arrived), [f"{out}/processed", f"{out}/errors"], run, batch_id)
        batch = process_messages(fresh, stop_words).persist()
        try:
            good = batch.where("success")
            features = unseen(feature_messages(good), f"{out}/features", run, batch_id, "key", "key")
            with_retries(lambda: write_batch_folder(features, f"{out}/features", run, batch_id), attempts)
            bad = error_rows(batch.where("NOT success"), "id", "dataSource", "error", kept=["raw_message"])
            with_retries(lambda: write_batch_folder(bad, f"{out}/errors", run, batch_id), attempts)
            with_retries(lambda: write_batch_folder(processed_columns(good), f"{out}/processed", run, batch_id), attempts)
        finally:
            batch.unpersist()

    return (
        messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def write_parse_errors(messages: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Unreadable messages to their own dead-letter folder."""
    bad = messages.where(F.col("parse_error").isNotNull()).select("raw_message", F.col("parse_error").alias("error"))
    return (
        bad.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def micro_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Hand each micro-batch to a function of DataFrames, with retries."""
    return (
        df.writeStream.foreachBatch(lambda b, i: with_retries(lambda: handle(b, i)))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def collect_progress(df: DataFrame, task: str, max_count: int) -> DataFrame:
    """Running count and progress per collection task (update mode on streams)."""
    return df.groupBy(task).agg(F.count("*").alias("collected")).withColumn(
        "progress", S.progress_percent("collected", F.lit(max_count))
    )
