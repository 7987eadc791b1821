import numpy as np

from modsift.llm import langid, quality, queries_models

from .conftest import FOLDER


def test_ranking_orders_pairs_and_cuts_at_the_quantile():
    rng = np.random.default_rng(3)
    width = len(quality.FEATURES)
    good, bad = rng.normal(1, 1, (300, width)), rng.normal(-1, 1, (100, width))
    model = quality.fit_ranking(good, bad, 0.25)
    raw = np.concatenate([model.raw(good), model.raw(bad)])
    assert abs((raw < model.threshold).mean() - 0.25) < 0.01
    assert (model.score(good) >= quality.CUT).mean() > 0.97 and (model.score(bad) < quality.CUT).mean() > 0.9
    assert abs(model.score(np.array([model.mean + model.weights * model.threshold / (model.weights @ model.weights)]))[0] - quality.CUT) < 1e-9


def judged_texts(rng, n_good, n_bad):
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    good = [" ".join(word() for _ in range(rng.integers(5, 30))) + "." for _ in range(n_good)]
    bad = [" ".join(word() + rng.choice(["", "", "!", "|", " 77 "]) for _ in range(rng.integers(3, 25))) for _ in range(n_bad)]
    return [*enumerate(good), *enumerate(bad, n_good)]


def test_training_equals_the_fit_of_arrays(spark, docs_of):
    """All pairs of few labels; a label without a document counts in the share, a repeated document twice, one without an id not at all."""
    texts = judged_texts(np.random.default_rng(7), 40, 15)
    for flip in (False, True):  # which class is the larger one
        labels = [(i, int((i < 40) != flip)) for i, _ in texts] + [(900, 0), (3, 1), (None, 0), (5, None)]
        model = quality.train_ranking(docs_of([*texts, texts[4], (None, "no id"), (77, "no label")]), spark.createDataFrame(labels, "doc_id LONG, label INT"))
        label = {i: min(v for k, v in labels if k == i and v is not None) for i, _ in texts}
        x = {k: np.array([quality.features(t.encode()) for i, t in [*texts, texts[4]] if label[i] == k]) for k in (0, 1)}
        known = [*label.values(), 0]
        plain = quality.fit_ranking(x[1], x[0], known.count(0) / len(known))
        for name in ("mean", "weights", "threshold", "slope"):
            assert np.allclose(getattr(model, name), getattr(plain, name), rtol=1e-6, atol=1e-7), name


def test_training_uses_every_labelled_document(spark, docs_of):
    texts = judged_texts(np.random.default_rng(8), 3300, 60)
    labels = spark.createDataFrame([(i, int(i < 3300)) for i, _ in texts], "doc_id LONG, label INT")
    model = quality.train_ranking(docs_of(texts), labels)
    x = np.array([quality.features(t.encode()) for _, t in texts])
    assert np.allclose(model.mean, x.mean(axis=0), rtol=0, atol=1e-9)
    assert (model.raw(x) < model.threshold).sum() == 60
    again = quality.train_ranking(docs_of(texts[::-1]), labels)
    assert (model.weights == again.weights).all() and model.threshold == again.threshold


def test_quality_on_held_out_labels(spark):
    folder = FOLDER.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries_models.op2_quality(spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.96


def test_quality_of_odd_rows_and_without_labels(spark, odd):
    df, texts = odd
    labels = spark.createDataFrame([(4, 1), (8, 0), (77, 0), (None, 1)], "doc_id LONG, quality INT")
    for given in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality.train_ranking(df, quality.training_labels(given))
        out = quality.with_quality(df, model)
        assert out.columns == [*[c for c in df.columns if c != "score"], "score"]
        scores = [r.score for r in out.collect()]
        assert len(scores) == len(texts) and all(0 <= s <= 1 for s in scores)
    assert quality.with_quality(df.limit(0), model).count() == 0


def test_language_on_held_out_documents(spark):
    folder = FOLDER.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in queries_models.op5_language(spark, folder).collect() if r.held_out]
    assert len(rows) > 150 and np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.97
    sure = [truth[r.doc_id] == r.lang_pred for r in rows if not r.rejected]
    assert len(sure) > 0.8 * len(rows) and np.mean(sure) > 0.98


def test_language_of_odd_rows(spark, odd, docs_of):
    df, texts = odd
    train = docs_of([(100 + i, t) for i, t in enumerate(["the cat and the dog " * 5, "of the house and"] * 5)])
    model = langid.train_languages(langid.training_documents(train))
    out = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.with_language(df, model).collect()}
    assert len(out) == len(set(texts))
    for (_, t), (lang, score) in out.items():
        assert (lang == "und" and score == 0) if t is None or not any(c.isalpha() for c in t) else (lang == "en" and score == 1)
    assert langid.train_languages(df.limit(0)) is None
    assert {r.lang_pred for r in langid.with_language(df, None).collect()} == {"und"}
    assert langid.with_language(df.limit(0), model).count() == 0


def test_subwords_by_block(monkeypatch):
    text = "Größe und Straße " * 40
    counts = langid.bucket_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 50)
    assert all(np.allclose(a, b) for a, b in zip(counts, langid.bucket_counts(text)))
