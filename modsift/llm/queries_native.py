"""Registered queries: fingerprints, license and secret scans (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsift.llm import fingerprint, license_texts, licenses, secrets
from modsift.llm.common import table


def op3_fingerprint(spark, folder):
    return fingerprint.edited_fingerprints(table(spark, folder, "documents"))


def op4_secrets(spark, folder):
    found = secrets.scan_secrets(table(spark, folder, "documents"))
    return found.select("doc_id", "place", "nth", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "n_chars", "probability", "is_secret")


def op9_licenses(spark, folder):
    templates = spark.createDataFrame(license_texts.TEMPLATES, "license_id string, text string")
    return licenses.scan_licenses(table(spark, folder, "documents"), templates)


QUERIES = {"op3_fingerprint": op3_fingerprint, "op4_secrets": op4_secrets, "op9_licenses": op9_licenses}
SQL: dict[str, str] = {}
