"""Registered queries: trained classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsift.llm import langid, quality
from modsift.llm.common import crc_mod5, table


def quality_model(spark, docs, folder):
    return quality.train_ranking(docs, quality.training_labels(table(spark, folder, "labels")))


def op2_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.with_quality(docs, quality_model(spark, docs, folder))
    return scored.select(
        "doc_id", (crc_mod5() == 0).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted")
    )


def op5_language(spark, folder):
    docs = table(spark, folder, "documents")
    model = langid.train_languages(langid.training_documents(docs))
    judged = langid.with_language(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", (crc_mod5() == 0).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op2_quality": op2_quality, "op5_language": op5_language}
SQL: dict[str, str] = {}
