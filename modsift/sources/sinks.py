"""Writers and message envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE_SCHEMA = "message_id STRING, type STRING, source STRING, timestamp LONG, data STRING, metadata MAP<STRING,STRING>"


# --- envelopes ---------------------------------------------------------------------
def wrap_envelope(df: DataFrame, kind: str, key: str, source: str, data: str, seconds: str, metadata: Column | None = None) -> DataFrame:
    """(key, value) rows; the message id is a hash of type and key, so replays repeat it."""
    body = F.struct(
        F.sha2(F.concat(F.lit(f"{kind}|"), F.col(key).cast("string")), 256).alias("message_id"),
        F.lit(kind).alias("type"),
        F.col(source).alias("source"),
        F.col(seconds).cast("long").alias("timestamp"),
        F.to_json(data).alias("data"),
        (metadata if metadata is not None else F.create_map().cast("map<string,string>")).alias("metadata"),
    )
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(body).alias("value"))


def unwrap_envelope(df: DataFrame, data_schema: str, value: str = "value") -> DataFrame:
    parsed = df.select(F.from_json(value, ENVELOPE_SCHEMA).alias("e")).select("e.*")
    return parsed.withColumn("data", F.from_json("data", data_schema))


# --- batch sinks -----------------------------------------------------------------------
def write_raw_texts(df: DataFrame, path: str) -> None:
    """Append raw texts, one folder per source, metadata as JSON."""
    out = df.withColumn("metadata", F.to_json("metadata")) if dict(df.dtypes).get("metadata", "").startswith("map") else df
    out.write.mode("append").partitionBy("source").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


KEY_BUCKET = "key_bucket"


def key_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def processed_keys(spark: SparkSession, path: str, key: str, buckets: list[int]) -> DataFrame:
    """The keys of a target in some of its buckets: other buckets' files are not listed or read, of these only the key column."""
    return spark.read.parquet(path).where(F.col(KEY_BUCKET).isin(buckets)).select(key, KEY_BUCKET)


def write_processed(df: DataFrame, path: str, key: str = "raw_text_id", buckets: int = 64) -> None:
    """Append only rows whose raw text is not in the target yet; copies inside the input are dropped.

    The target has a folder per bucket of the key's hash, so an append reads back only the keys that share a bucket with
    its own.  ``buckets`` is fixed by the first append; a table of many rows wants more of them.  A null key is a key.
    """
    spark = df.sparkSession
    fresh = df.drop(KEY_BUCKET).dropDuplicates([key]).withColumn(KEY_BUCKET, key_bucket(key, buckets))
    if path_exists(spark, path):
        touched = sorted(r[0] for r in df.select(key_bucket(key, buckets)).distinct().collect())  # bucket numbers
        done = processed_keys(spark, path, key, touched).select(F.col(key).alias("__done"), F.col(KEY_BUCKET).alias("__bucket"))
        fresh = fresh.join(done, (F.col(KEY_BUCKET) == F.col("__bucket")) & F.col(key).eqNullSafe(F.col("__done")), "left_anti")
    # Rows of a bucket meet in one task, so an append adds one file to each bucket that it touches.
    fresh.repartition(KEY_BUCKET).write.mode("append").partitionBy(KEY_BUCKET).parquet(path)


def error_rows(df: DataFrame, raw_id: str, source: str, error: str, now: Column | None = None, kept: Sequence[str] = ()) -> DataFrame:
    """Dead-letter rows of the failed records, with the columns ``kept`` as they are."""
    return df.where(F.col(error).isNotNull()).select(
        F.col(raw_id).alias("raw_text_id"), F.col(source).alias("source"), F.col(error).alias("error"),
        (F.current_timestamp() if now is None else now).alias("ts"), *kept,
    )


def write_errors(df: DataFrame, path: str, raw_id: str, source: str, error: str) -> None:
    error_rows(df, raw_id, source, error).write.mode("append").json(path)


def write_training_jsonl(records: DataFrame, path: str, record: str = "record") -> None:
    records.select(F.to_json(record).alias("value")).write.mode("overwrite").text(path)


def rewrite_keeping(df: DataFrame, path: str, partition: str) -> None:
    """Replace the table by ``df``, partition by partition; partitions that ``df`` no longer has are removed.

    ``df`` may be read from ``path`` itself: partitions are overwritten one by one (dynamic overwrite), and the
    emptied ones are deleted last.  If a run fails between the two, the emptied partitions are still there beside the new
    rows; running it again finishes the work.
    """
    spark = df.sparkSession
    named = lambda d: d.select(F.col(partition).cast("string").alias("p")).distinct()
    emptied = named(spark.read.parquet(path)).exceptAll(named(df)).collect() if path_exists(spark, path) else []  # folder names
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    for row in emptied:
        name = "__HIVE_DEFAULT_PARTITION__" if row.p is None else spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(row.p)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def append_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 500, **options: str) -> None:
    """Append to a database table in batches; needs the driver jar on the cluster."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_size), **options).mode("append").save()
