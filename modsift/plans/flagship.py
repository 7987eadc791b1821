"""The headline question: per source, how many distinct valid documents, how readable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsift.functions import scores as S
from modsift.functions import text as T
from modsift.operators.features import readability_score
from modsift.operators.scale import compute_once, first_per_key


def source_quality(docs: DataFrame, row_id: str, text: str, source: str, stop_words: list[str]) -> DataFrame:
    """Two shuffles: one of narrow rows by content hash, one by source (partial sums).

    Every row is scored before the copies go, so that no text is sorted or shuffled.
    """
    cleaned = compute_once(docs.select(row_id, source, text), "cleaned", T.clean_text(text)).drop(text)
    valid = cleaned.where(S.processed_length_ok("cleaned"))
    tokens = compute_once(valid, "k", T.drop_words(T.tokenize("cleaned", lower=True), stop_words))
    rows = compute_once(tokens, "readability", readability_score("cleaned", "k")).withColumn("h", F.sha2("cleaned", 256))
    scored = first_per_key(rows.select(row_id, source, "readability", "h"), ["h"], [F.col(row_id)])
    return scored.groupBy(source).agg(
        F.count("*").alias("distinct_docs"),
        F.count_if(F.col("readability") >= 0.4).alias("readable_docs"),
        F.round(F.avg("readability"), 6).alias("mean_readability"),
    )
