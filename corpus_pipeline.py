"""A training-corpus pipeline: each stage works on what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  ``run``
writes the result of every stage to the shared folder and rereads it as the next one's documents.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from modsift.llm import exact_dedup, mixing, near_dedup, quality
from modsift.llm.common import free_name, table, written
from modsift.llm.queries_exact import packed_digest
from modsift.llm.queries_models import quality_model


def stage_quality(spark, docs, sf_dir):
    """Documents that the quality model rejects go."""
    score = free_name("quality_score", docs.columns)
    scored = quality.with_quality(docs, quality_model(spark, docs, sf_dir), score)
    return scored.where(scored[score] >= quality.CUT).drop(score)


def stage_exact_dedup(spark, docs, sf_dir):
    return exact_dedup.drop_exact(docs, keep="largest")


def stage_near_dedup(spark, docs, sf_dir):
    """One document of each class of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def stage_mixing(spark, docs, sf_dir):
    return mixing.mix_sources(docs)


def stage_packing(spark, docs, sf_dir):
    return packed_digest(docs)


STAGES = [
    ("quality", stage_quality),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

ORACLE_SQL = None  # trained scores, signatures and tokens have no SQL form; tests/llm checks each stage by brute force


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
