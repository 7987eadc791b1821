"""Steps whose work or memory has to grow no faster than their input."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from modsift.functions import text as T
from modsift.operators import augment as G
from modsift.operators import relational as R
from modsift.operators import similarity as S
from modsift.operators import word_vectors as WV
from modsift.operators.scale import join_counted_keys
from modsift.plans.ml_queries import labeled_features
from modsift.sources import pages as P


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ngrams_do_not_copy_the_row_for_each_gram(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (None,)], "t ARRAY<STRING>").select("t", T.ngrams("t", 3).alias("g"))
    assert [r.g for r in df.collect()] == [["a", "b", "c", "a_b", "b_c", "a_b_c"], [], []]
    assert "slice(" not in plan_of(df)


def test_few_keys_move_no_fact(spark):
    facts = spark.range(1000).select("id", F.concat(F.lit("k"), F.col("id") % 7).alias("k"))
    keyed = facts.where("k <> 'k3'").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        all_ways = [join_counted_keys(facts, keyed, "k", "n", how, hot_keys=h, few=f) for h, f in ((1, 0), (2000, 0), (2000, 100))]
        assert len({tuple(sorted(map(tuple, d.collect()), key=str)) for d in all_ways}) == 1
        assert "hash(" in plan_of(all_ways[0]) and "hash(" not in plan_of(all_ways[2])


def test_vectors_of_rare_words_come_from_a_join(spark):
    words = spark.createDataFrame([(f"w{i}", 100 // (i + 1), i) for i in range(9)], "word STRING, n LONG, word_id INT")
    vectors = spark.createDataFrame([(i, [float(i), 1.0, -1.0]) for i in range(9)], "word_id INT, vector ARRAY<FLOAT>")
    ids = spark.createDataFrame([(r, p, (r * p) % 9) for r in range(12) for p in range(7)], "__row INT, position INT, word_id INT")
    rows = WV.row_places(ids)
    near, far = ({r["__row"]: r.embedding for r in WV.document_vectors(rows, vectors, words, 3, hot).collect()} for hot in (10_000, 2))
    assert near.keys() == far.keys() == set(range(12)) and all(np.allclose(near[r], far[r]) for r in near)


def test_similar_to_targets_pools_rows_of_one_id(spark):
    rows = [(1, [0.0, 0.1]), (1, [0.2]), (2, [0.05, 0.15]), (2, [0.15]), (3, None), (None, [0.0]), (4, [0.11])]
    df = spark.createDataFrame(rows, "id LONG, x ARRAY<DOUBLE>")
    out = R.similar_to_targets(df, "id", "x", F.col("id") <= 1, 0.06, 3, block=1)
    assert sorted(map(tuple, out.collect())) == [(1, 2, 6, 1), (1, 3, 0, 3), (1, 4, 1, 2)]
    assert "FlatMapCoGroupsInArrow" in plan_of(out)


def test_component_labels_take_no_wide_copies_of_the_matrix():
    n, rng = 1200, np.random.default_rng(3)
    linked = rng.random((n, n)) < 0.0006
    linked |= linked.T
    label = np.arange(n)  # by repeated smallest neighbours
    while True:
        new = np.array([min(label[i], label[linked[i]].min(initial=n)) for i in range(n)])
        if (new == label).all():
            break
        label = new
    tracemalloc.start()
    got = S.component_labels(linked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == label).all() and peak < n * n * 2


def test_words_are_chosen_without_moving_them(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v".split())], "id LONG, w ARRAY<STRING>")
    seed = G.copy_seed(F.col("id"), F.lit(1), 42)
    for made, k in ((G.synonym_replace(F.col("w"), seed, {x: [x.upper()] for x in "abcdefghijklmnopqrstuv"}), 22), (G.random_delete(F.col("w"), seed), 20)):
        out = df.select(made.alias("m"))
        words = out.first().m
        assert len(words) == k and [x.lower() for x in words] == sorted(x.lower() for x in words)
        assert plan_of(out).count("sort_array(") <= 1


def test_features_are_computed_once_for_split_fit_and_prediction(spark):
    class t:
        documents = spark.createDataFrame([(i, f"Some text {i}.") for i in range(20)], "doc_id LONG, text STRING")
        labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id LONG, quality INT, toxic INT")

    rows = labeled_features(t)
    assert rows.count() == 20 and "regexp" not in plan_of(rows)


def test_page_elements_leave_a_task_in_small_batches(spark, monkeypatch):
    html = [(i, "<p>one</p><p>two</p>" * (i % 3)) for i in range(50)]
    df = spark.createDataFrame(html, "id LONG, html STRING").repartition(2)
    find = lambda: sorted((r.id, r.ordinal, r.text) for r in P.select_elements(df, "html", [("x", "p", [], None)], ["id"]).collect())
    whole = find()
    monkeypatch.setattr(P, "CHUNK_CHARS", 30)
    assert find() == whole and len(whole) == sum(4 if i % 3 == 2 else 2 * (i % 3) for i in range(50))
