"""Registered queries: near-duplicates, fingerprints and repeated passages."""

from __future__ import annotations

from modsift.llm import near_dedup, substring_dedup
from modsift.llm.common import table


def op10_near_dedup(spark, folder):
    return near_dedup.near_classes(table(spark, folder, "documents"))


def op1_repeated_passages(spark, folder):
    found = substring_dedup.repeated_passages(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op1_repeated_passages": op1_repeated_passages, "op10_near_dedup": op10_near_dedup}
SQL: dict[str, str] = {}
