"""Registered query: token ids in binary record files, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsift.llm import records
from modsift.llm.common import table
from modsift.llm.queries_exact import tokenizer_path


def op12_records(spark, folder):
    back = records.round_trip(table(spark, folder, "documents"), tokenizer_path())
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op12_records": op12_records}
SQL: dict[str, str] = {}
