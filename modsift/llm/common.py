"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modsift.session import ensure_checkpoint_dir

HOT_KEYS = 2000
BATCH_BYTES = 8 << 20


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table that later steps read again to the shared folder, and read it back (cuts lineage)."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage of a narrow table with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def bounded_batches(spark) -> None:
    """Arrow batches by bytes, so that very long texts do not pile up in one batch of a Python task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod5(column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo 5; rows without an id count as remainder 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5, F.lit(1))


def free_name(wanted: str, columns: list[str]) -> str:
    """A helper column name that the table does not use (names clash without regard to case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def with_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal", rows_per_piece: int = 200_000) -> DataFrame:
    """Number the rows of a narrow table from 0 in a total order, without a one-task window.

    The rows are cut into value ranges and sorted inside them; the table is then written, so that
    the position of a row (piece number and place in it) is fixed, and the pieces' row counts, one
    row each, give the offsets.
    """
    pieces = max(1, -(-df.count() // rows_per_piece))
    at = F.monotonically_increasing_id()
    cut = df.repartitionByRange(pieces, *order).sortWithinPartitions(*order).withColumn("__at", at)
    cut = checkpointed(cut.withColumn("__piece", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("__piece").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # One row per 200 000 rows of the table, a few bytes each.
    return (
        cut.join(F.broadcast(offsets) if pieces < 100_000 else offsets, "__piece")
        .withColumn(name, F.col("__before") + F.col("__at"))
        .drop("__piece", "__at", "__before")
    )


def join_small_or_hot(facts: DataFrame, keyed: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of facts to one row per key; ``weight`` in ``keyed`` counts the facts of a key.

    ``keyed`` is stored already.  Keys above total / HOT_KEYS are at most HOT_KEYS in number by
    counting and are broadcast; the facts they match are not moved.  Only if other keys exist are the
    facts shuffled, those already matched under a salt.
    """
    payload = [c for c in keyed.columns if c != key]
    used = [*facts.columns, *payload]
    hot_, cold_, found_, salt, routed_key = (free_name(n, used) for n in ("__hot", "__cold", "__found", "__salt", "__routed"))
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_KEYS > total
    few = keyed.where(hot).select(key, F.struct(*payload).alias(hot_))
    found = facts.join(F.broadcast(few), key, "left")
    if keyed.where(~hot).isEmpty():
        return found.select(*facts.columns, f"{hot_}.*")
    cold = keyed.where(~hot).select(F.col(key).alias(routed_key), F.lit(0).alias(salt), F.struct(*payload).alias(cold_))
    matched = F.col(hot_).isNotNull()
    routed = found.withColumn(routed_key, F.when(~matched, F.col(key))).withColumn(
        salt, F.when(matched, F.floor(F.rand(7) * (1 << 30)).cast("int") + 1).otherwise(0)
    )
    joined = routed.join(cold, [routed_key, salt], "left").withColumn(found_, F.coalesce(hot_, cold_))
    return joined.select(*facts.columns, f"{found_}.*")
