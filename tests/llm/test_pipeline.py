from collections import Counter

import corpus_pipeline as P
from modsift.llm import near_dedup, quality
from modsift.llm.queries_models import quality_model

from .conftest import FOLDER


def test_stages_one_by_one(spark, documents):
    docs, seen = documents, []
    for name, stage in P.STAGES:
        before = docs
        docs = stage(spark, docs, FOLDER).cache()
        rows = docs.collect()
        seen.append(name)
        if name != "packing":
            assert docs.columns == documents.columns
        if name == "quality":
            model = quality_model(spark, before, FOLDER)
            good = {r.doc_id for r in quality.with_quality(before, model).where("score >= 0.3").collect()}
            assert {r.doc_id for r in rows} == good and 0 < len(good) < before.count()
        elif name == "exact_dedup":
            best = {}
            for r in before.collect():
                best[r.text] = max(best.get(r.text, -1), r.doc_id)
            assert {(r.text, r.doc_id) for r in rows} == set(best.items()) and len(rows) == len(best)
        elif name == "near_dedup":
            classes = near_dedup.near_classes(before).collect()
            assert sorted(r.doc_id for r in rows) == sorted({r.class_id for r in classes})
        elif name == "mixing":
            counts = Counter(r.doc_id for r in rows)
            assert set(counts) <= {r.doc_id for r in before.collect()} and max(counts.values()) <= 3
        else:
            assert {r.doc_id for r in rows} == {r.doc_id for r in before.collect()}
    assert seen == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_run_equals_stages(spark):
    a = P.run(spark, FOLDER).select("doc_id", "start", "length", "ids_crc32")
    assert a.count() > 0 and a.exceptAll(P.run(spark, FOLDER).select("doc_id", "start", "length", "ids_crc32")).count() == 0


def test_stages_on_an_empty_table(spark, documents):
    docs = documents.limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
