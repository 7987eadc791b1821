import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from modsift.operators import ml as M
from modsift.operators import word_vectors as WV


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = []
    for i in range(240):
        y = i % 2
        data.append((i, rng.gauss(2.0 * y, 0.6), rng.gauss(-1.0 * y, 0.6), y))
    return spark.createDataFrame(data, "id INT, a DOUBLE, b DOUBLE, y INT").repartition(2, "id").cache()


@pytest.mark.parametrize("algorithm,parameters", [
    ("random_forest", {"trees": 5, "depth": 5}), ("svm", {"iterations": 20}), ("logistic_regression", {"iterations": 30}), ("naive_bayes", {}),
    ("decision_tree", {"depth": 5}), ("xgboost", {"rounds": 3, "depth": 3}), ("bert", {"layers": [2, 4, 2], "iterations": 40}),
])
def test_classifiers_learn(rows, algorithm, parameters):
    data = M.assemble(rows, ["a", "b"], "y")
    out = M.predict(data, M.train(algorithm, data, **parameters), ["id", "label"])
    hit = out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("h"), F.min("confidence").alias("c")).first()
    assert hit.h > 0.9 and hit.c > 0.4


def test_train_job_saves_and_scores(rows, tmp_path):
    split = rows.withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    path = str(tmp_path / "model")
    _, metrics = M.train_job(split, ["a", "b"], "y", "split", "NAIVE_BAYES", "j1", path)
    m = metrics.first()
    assert m.job_id == "j1" and m.samples == 48 and m.accuracy > 0.85
    assert PipelineModel.load(path).stages
    with pytest.raises(ValueError):
        M.train("nothing", rows)


def test_clusterers_and_reconstruction(rows):
    data = M.assemble(rows, ["a", "b"])
    for name in ("KMEANS", "HIERARCHICAL"):
        assert M.predict(data, M.train(name, data, k=2), ["id"]).select("prediction").distinct().count() == 2
    full = M.reconstruction_error(data, ["id"], 2).agg(F.max("reconstruction_error")).first()[0]
    one = M.reconstruction_error(data, ["id"], 1).agg(F.avg("reconstruction_error")).first()[0]
    assert full < 1e-9 < one


def test_selection(rows):
    data = M.assemble(rows, ["a", "b"], "y")
    folds = M.cross_validate(data, "id", "NAIVE_BAYES", 3).collect()
    assert len(folds) == 3 and sum(r.samples for r in folds) == 240 and min(r.accuracy for r in folds) > 0.8
    _, scores = M.hyperparameter_grid(data, "id", LogisticRegression(maxIter=10), {"regParam": [0.01, 1.0]})
    assert scores.count() == 2


def test_grid_in_parallel_gives_the_same(rows):
    data = M.assemble(rows, ["a", "b"], "y")
    grid = {"regParam": [0.01, 0.3, 1.0], "elasticNetParam": [0.0, 0.5]}
    (one, a), (many, b) = (M.hyperparameter_grid(data, "id", LogisticRegression(maxIter=10), grid, parallelism=n) for n in (1, 4))
    assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()] and a.count() == 6
    assert one.coefficients == many.coefficients


def test_rows_that_cannot_be_scored_are_dead_letters(rows):
    data = M.assemble(rows, ["a", "b"], "y")
    model = M.train("LOGISTIC_REGRESSION", data, iterations=5)
    nan, inf = float("nan"), float("inf")
    odd = rows.sparkSession.createDataFrame([(900, None, 1.0, 0), (901, nan, None, 0), (902, 1.0, -inf, 1), (903, 1.0, 2.0, None)], rows.schema)
    good, failed = M.predict_or_error(rows.union(odd), ["a", "b"], model, "id")
    assert good.count() == 241 and {"prediction", "confidence", "scores"} <= set(good.columns)
    assert sorted((r.raw_text_id, r.error) for r in failed.collect()) == [(900, "feature a is missing"), (901, "feature a is not a number"), (902, "feature b is not a number")]


def test_cooccurrence_counts_and_ppmi_against_plain_python(spark):
    import math
    from collections import Counter

    rng = random.Random(8)
    texts = [(i, [f"w{int(rng.paretovariate(1))}" for _ in range(rng.randrange(0, 60))]) for i in range(40)] + [(90, None), (91, [])]
    df = spark.createDataFrame(texts, "id INT, tk ARRAY<STRING>").repartition(3)
    words = WV.vocabulary(df, "tk", 3)
    counts = Counter(w for _, tk in texts for w in tk or [])
    kept = {w for w, n in counts.items() if n >= 3}
    ids = {r.word: r.word_id for r in words.collect()}
    assert ids == {w: i for i, w in enumerate(sorted(kept))}
    placed = WV.token_ids(df, "id", "tk", words)
    want = Counter()
    for _, tk in texts:
        for i, a in enumerate(tk or []):
            for b in (tk or [])[i + 1 : i + 6]:
                if a in kept and b in kept:
                    want[tuple(sorted((ids[a], ids[b])))] += 1
    got = {(r.a, r.b): r.n for r in WV.cooccurrences(placed, 5).collect()}
    assert got == want
    both = Counter()
    for (a, b), n in want.items():
        both[a, b] = both[b, a] = n
    margin, total = Counter(), sum(both.values())
    for (a, _), n in both.items():
        margin[a] += n
    ppmi = {k: math.log(n * total / (margin[k[0]] * margin[k[1]])) for k, n in both.items()}
    found = {(r.a, r.b): r.ppmi for r in WV.positive_pmi(WV.cooccurrences(placed, 5)).collect()}
    assert found.keys() == {k for k, v in ppmi.items() if v > 0} and all(abs(v - ppmi[k]) < 1e-9 for k, v in found.items())


def test_packed_blocks_give_the_counts_and_factors_of_the_tables(spark, monkeypatch):
    import numpy as np

    from modsift.operators import word_blocks as B

    rng = random.Random(9)
    texts = [(i, [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(0, 80))]) for i in range(60)] + [(90, None), (91, []), (92, ["w1", None, "w2"])]
    df = spark.createDataFrame(texts, "id INT, tk ARRAY<STRING>").repartition(6)
    words = WV.vocabulary(df, "tk", 2)
    blocks = B.row_blocks(df, "id", "tk", 300)
    assert blocks.count() > 3
    assert {tuple(r) for r in B.word_counts(blocks).where("n >= 2").collect()} == {(r.word, r.n) for r in words.where("word IS NOT NULL").collect()}
    blocks = B.numbered_blocks(blocks, words.select("word", "word_id"))
    monkeypatch.setattr(B, "PART_WORDS", 3)
    parts = B.matrix(blocks, 5, 100, words.count(), chunk=8).collect()
    got = {}
    for r in parts:
        first, size, second, n = B._entries(r.asDict())
        got |= {(a, b): x for a, b, x in zip(np.repeat(first, size).tolist(), second.tolist(), n.tolist())}
    want = {(r.a, r.b): r.n for r in WV.cooccurrences(WV.token_ids(df, "id", "tk", words), 5).collect()}
    assert got == want | {(b, a): n for (a, b), n in want.items()} and len({r.chunk for r in parts}) > 2
    ppmi = np.zeros((words.count(),) * 2)
    for r in WV.positive_pmi(WV.cooccurrences(WV.token_ids(df, "id", "tk", words), 5)).collect():
        ppmi[r.a, r.b] = r.ppmi
    seen = (ppmi > 0).any(axis=1)
    x = np.where(seen[:, None], B._start(np.arange(len(ppmi)), 4, 42), 0).astype(float)
    for _ in range(4):  # two iterations
        gram, y = x.T @ x, np.zeros_like(x)
        for i in np.flatnonzero(seen):
            w, of = ppmi[i][ppmi[i] > 0], x[ppmi[i] > 0]
            y[i] = np.linalg.solve(gram + (of.T * w) @ of + 0.05 * len(w) * np.eye(4), (1 + w) @ of)
        x = y
    found = B.factorised(spark.createDataFrame(parts, "part int, chunk int, sums binary, " + B.PACKED).coalesce(1), 4, 2, 42, chunk=8).collect()
    dense = np.concatenate([np.frombuffer(r.x, "<f4").reshape(8, 4) for r in sorted(found)])[: len(x)]
    assert np.abs(dense - x).max() < 1e-3


def test_document_vectors_of_packed_blocks_are_those_of_the_table(spark):
    import numpy as np

    from modsift.operators import word_blocks as B

    rng, r = random.Random(10), np.random.default_rng(1)
    texts = [(f"d{i}", [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(0, 50))]) for i in range(50)] + [("none", None)]
    df = spark.createDataFrame(texts, "id STRING, tk ARRAY<STRING>").repartition(3)
    words = WV.vocabulary(df, "tk", 2)
    x = r.normal(size=(-(-words.count() // 8) * 8, 3)).astype(np.float32)
    x[3] = 0
    table = spark.createDataFrame([(i, x[i].tolist()) for i in range(words.count()) if i != 3], "word_id int, vector array<float>")
    chunks = spark.createDataFrame([(c, x[c * 8 : c * 8 + 8].tobytes()) for c in range(len(x) // 8)], "chunk int, x binary")
    rows = WV.row_places(WV.token_ids(df, "id", "tk", words))
    want = {r["__row"]: r.embedding for r in WV.document_vectors(rows, table, words, 3).collect()}
    sums = {}
    for row in B.row_vectors(B.numbered_blocks(B.row_blocks(df, "id", "tk", 200), words), chunks, words, 3, chunk=8).collect():
        sums[row["__row"]] = sums.get(row["__row"], 0) + np.array(row.sums)
    assert sums.keys() == want.keys()
    assert all(np.abs(v / np.linalg.norm(v) - want[k]).max() < 1e-9 for k, v in sums.items())


def test_doc_embedding_moves_no_row_per_token(spark, monkeypatch):
    from modsift.operators import word_blocks as B

    plans = []

    def stored(frame, keep=B.stored):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return keep(frame)

    for module in (WV, B):
        monkeypatch.setattr(module, "stored", stored)
    df = spark.createDataFrame([(i, ["a", "b", "c", f"w{i % 5}"] * 5) for i in range(40)], "id INT, tk ARRAY<STRING>")
    assert all(r.embedding for r in WV.doc_embedding(df, "id", "tk", dim=4, iterations=2).collect())
    assert not any("Generate explode" in p or "Generate posexplode" in p for p in plans)
    assert sum("CartesianProduct" in p for p in plans) == 5, "five half steps, no entry is shuffled for them"


def test_doc_embedding_groups_topics(spark):
    rng = random.Random(5)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(3)]
    texts = [(i, rng.choices(topics[i % 3], k=60) + rng.choices(["and", "the", "of"], k=20)) for i in range(60)]
    for _, tk in texts:
        rng.shuffle(tk)
    texts += [(100, texts[4][1]), (101, ["unseen"]), (102, None)]
    df = spark.createDataFrame(texts, "id INT, tk ARRAY<STRING>").repartition(3)
    got = {r.id: r.embedding for r in WV.doc_embedding(df, "id", "tk", dim=8, min_count=2, iterations=4).collect()}
    assert got[101] is None and got[102] is None and len(got[0]) == 8 and abs(sum(x * x for x in got[0]) - 1) < 1e-9
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b]))
    assert abs(dot(4, 100) - 1) < 1e-9
    same = [dot(a, b) for a in range(60) for b in range(a) if a % 3 == b % 3]
    other = [dot(a, b) for a in range(60) for b in range(a) if a % 3 != b % 3]
    assert min(same) > max(other)
    lonely = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "id INT, tk ARRAY<STRING>")
    assert [r.embedding for r in WV.doc_embedding(lonely, "id", "tk", dim=4).collect()] == [None, None]
