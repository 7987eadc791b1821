"""Queries: augmentation, model training, prediction, clustering."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from modsift.functions import text as T
from modsift.operators import augment as G
from modsift.operators import datasets as D
from modsift.operators import evaluation as E
from modsift.operators import features as X
from modsift.operators import ml as M
from modsift.operators import word_vectors as WV
from modsift.operators.density import dbscan
from modsift.operators.density_vectors import dbscan_vectors
from modsift.operators.scale import stored
from modsift.plans import augment_sql as A
from modsift.plans.registry import query
from modsift.session import ensure_checkpoint_dir

COLUMNS = ["text_length", "word_count", "sentence_count", "avg_word_length", "punctuation_count", "digit_count", "lexical_density", "type_token_ratio"]
SYNONYMS = {"the": ["that", "this"], "of": ["from"], "la": ["une", "cette"], "der": ["dieser"]}


FLOOR = 0.65  # share of right predictions on held-out documents that a classifier has to reach


def labeled_features(t):
    d = t.documents.select("doc_id", "text", T.tokenize("text", lower=True).alias("tk"))
    d = X.statistical_features(d, "text", "tk").select("doc_id", "statistical.*")
    # Stored: the split, the fit and the prediction each read them, and a feature costs several passes over the text.
    return D.split_dataset(stored(d.join(t.labels, "doc_id")), "doc_id", 0.1, 0.2, exact=True)


# The exact split of the labelled documents; models are judged on the test part.
SPLIT_SQL = """ranked AS (SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY sha256('42|' || doc_id)) - 1 AS rank, count(*) OVER () AS n FROM labels JOIN documents USING (doc_id)),
      tested AS (SELECT * FROM ranked WHERE rank < floor(n * 0.2::DOUBLE))"""


def _trained(t, algorithm, **parameters):
    """Test documents with their label; whether the prediction is a class with a confidence, and whether enough of all are right."""
    rows = M.assemble(labeled_features(t), COLUMNS, "quality")
    model = M.train(algorithm, rows.where("split = 'train'"), **parameters)
    out = stored(M.predict(rows.where("split = 'test'"), model, ["doc_id", "label"]))
    right = out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).scalar()
    sound = F.col("prediction").isin(0, 1) & F.col("confidence").between(0.5, 1)
    return out.select("doc_id", F.col("label").cast("int").alias("label"), sound.alias("sound"), (right >= FLOOR).alias("learns"))


for _name, _algorithm, _parameters in [
    ("m1_random_forest", "RANDOM_FOREST", {}),
    ("m2_svm", "SVM", {}),
    ("m3_logistic_regression", "LOGISTIC_REGRESSION", {}),
    ("m5_decision_tree", "DECISION_TREE", {}),
    ("m6_gradient_boosting", "GRADIENT_BOOSTING", {}),
    ("m10_dense_network", "DENSE_NETWORK", {"layers": [len(COLUMNS), 8, 2]}),
]:
    query(_name, f"WITH {SPLIT_SQL} SELECT doc_id, quality::INT AS label, true AS sound, true AS learns FROM tested")(
        lambda t, a=_algorithm, p=_parameters: _trained(t, a, **p)
    )


@query(
    "m4_naive_bayes",
    """WITH x AS (SELECT vec_id, label, ('0x' || substr(md5('42|' || vec_id), 1, 7))::BIGINT % 5 <> 0 AS train, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
      c AS (SELECT label, i, avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM x WHERE train GROUP BY 1, 2),
      e AS (SELECT 1e-9::DOUBLE * max(s) AS floor_var FROM (SELECT i, var_pop(v) AS s FROM x WHERE train GROUP BY 1)),
      k AS (SELECT label, ln(any_value(n) / (SELECT count(DISTINCT vec_id) FROM x WHERE train)) AS prior FROM c GROUP BY 1),
      l AS (SELECT x.vec_id, c.label, any_value(prior) - 0.5 * sum(ln(2 * pi() * (s + floor_var)) + (v - m) * (v - m) / (s + floor_var)) AS score
        FROM x JOIN c USING (i) JOIN k ON k.label = c.label CROSS JOIN e WHERE NOT train GROUP BY 1, 2)
      SELECT vec_id, arg_max(label, score)::DOUBLE AS prediction FROM l GROUP BY 1""",
)
def _(t):
    """Ten classes of embeddings, by the log likelihood of normal distributions per class and dimension."""
    part = F.conv(F.substring(F.md5(F.concat(F.lit("42|"), "vec_id")), 1, 7), 16, 10).cast("long") % 5 != 0
    rows = M.assemble_array(t.embeddings, "embedding").withColumn("label", F.col("label").cast("double")).withColumn("train", part)
    return M.predict(rows.where("NOT train"), M.train("NAIVE_BAYES", rows.where("train")), ["vec_id"]).select("vec_id", "prediction")


@query("m7_kmeans", "SELECT vec_id, label, true AS nearest, 10::BIGINT AS clusters FROM embeddings")
def _(t):
    """Every row is in the cluster of its nearest centre, and none of the ten clusters is empty."""
    rows = M.assemble_array(t.embeddings, "embedding")
    model = M.train("KMEANS", rows, k=10)
    centres = F.array(*[F.array(*map(F.lit, c.tolist())) for c in model.stages[0].clusterCenters()])
    found = M.predict(rows, model, ["vec_id", "label", "embedding"])
    away = F.transform(centres, lambda c: F.aggregate(F.zip_with("embedding", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    found = found.withColumn("away", away).withColumn("nearest", F.get("away", F.col("prediction")) <= F.array_min("away") + 1e-9)
    return found.select("vec_id", "label", "nearest", found.agg(F.count_distinct("prediction")).scalar().alias("clusters"))


_EPS = 0.01


@query(
    "m8_dbscan",
    f"""WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
      n AS (SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_EPS}::DOUBLE * {_EPS}::DOUBLE),
      core AS (SELECT i AS id FROM n GROUP BY 1 HAVING count(*) >= 5),
      e AS (SELECT n.i, n.j FROM n JOIN core a ON a.id = n.i JOIN core b ON b.id = n.j),
      r(id, root) AS (SELECT id, id FROM core UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.id),
      c AS (SELECT id, min(root) AS cluster FROM r GROUP BY 1)
      SELECT p.id AS vec_id, c.id IS NOT NULL AS is_core, c.id IS NULL AND NOT EXISTS (SELECT 1 FROM n JOIN core ON core.id = n.j WHERE n.i = p.id) AS is_noise,
      coalesce(c.cluster, -1) AS core_cluster FROM p LEFT JOIN c ON c.id = p.id""",
)
def _(t):
    p = t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    c = dbscan(p, "vec_id", ["x", "y"], _EPS, 5)
    names = c.where("is_core").groupBy("cluster").agg(F.min("vec_id").alias("first"))
    return c.join(names, "cluster", "left").select(
        "vec_id", "is_core", (F.col("cluster") == "-1").alias("is_noise"),
        F.when(F.col("is_core"), F.col("first")).otherwise(-1).cast("long").alias("core_cluster"),
    )


@query(
    "m8_dbscan_vectors",
    """WITH RECURSIVE p AS (SELECT vec_id AS id, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings),
      n AS (SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON list_distance(a.v, b.v) <= 1.15::DOUBLE),
      core AS (SELECT i AS id FROM n GROUP BY 1 HAVING count(*) >= 5),
      e AS (SELECT n.i, n.j FROM n JOIN core a ON a.id = n.i JOIN core b ON b.id = n.j),
      r(id, root) AS (SELECT id, id FROM core UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.id),
      c AS (SELECT id, min(root) AS cluster FROM r GROUP BY 1),
      border AS (SELECT n.i AS id, min(c.cluster) AS cluster FROM n JOIN c ON c.id = n.j WHERE n.i NOT IN (SELECT id FROM core) GROUP BY 1)
      SELECT p.id AS vec_id, c.id IS NOT NULL AS is_core, coalesce(c.cluster, border.cluster) AS cluster FROM p LEFT JOIN c ON c.id = p.id LEFT JOIN border ON border.id = p.id""",
)
def _(t):
    """All 64 dimensions."""
    return dbscan_vectors(t.embeddings, "vec_id", "embedding", 1.15, 5)


@query("m9_hierarchical", "SELECT vec_id, label, true AS known, 10::BIGINT AS clusters, true AS tighter FROM embeddings")
def _(t):
    """Ten clusters, each row in one of them, which explain some of the spread."""
    rows = M.assemble_array(t.embeddings, "embedding")
    found = stored(M.predict(rows, M.train("HIERARCHICAL", rows, k=10), ["vec_id", "label", "embedding"]))
    indices = E.cluster_indices(found, "embedding", "prediction")
    spread = E.cluster_indices(found.withColumn("one", F.lit(0)), "embedding", "one")
    tighter = indices.agg(F.max("wcss")).scalar() < spread.agg(F.max("wcss")).scalar()
    clusters = found.agg(F.count_distinct("prediction")).scalar()
    return found.select("vec_id", "label", F.col("prediction").between(0, 9).alias("known"), clusters.alias("clusters"), tighter.alias("tighter"))


@query(
    "m11_reconstruction_error",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(v) AS m FROM x GROUP BY 1)
      SELECT vec_id, round(sum((v - m) * (v - m)), 6) AS spread, true AS bounded, true AS best_directions FROM x JOIN m USING (i) GROUP BY 1""",
)
def _(t):
    """A row's error lies between nothing and its spread around the mean, and 16 of 64 directions of largest variance explain over 16 / 64 of all."""
    rows = M.assemble_array(t.embeddings, "embedding")
    some = M.reconstruction_error(rows, ["vec_id"], 16)
    none = M.spread_around_mean(rows, ["vec_id"])
    both = stored(some.join(none, "vec_id"))
    share = both.agg(F.sum("reconstruction_error") / F.sum("spread")).scalar()
    bounded = F.col("reconstruction_error").between(0, F.col("spread") + 1e-9)
    return both.select("vec_id", F.round("spread", 6).alias("spread"), bounded.alias("bounded"), (share < 1 - 16 / 64).alias("best_directions"))


@query("m12_train_job", f"WITH {SPLIT_SQL} SELECT doc_id, 'job-1' AS job_id, 'DECISION_TREE' AS algorithm, (SELECT count(*) FROM tested) AS samples, true AS same_after_reload, true AS learns FROM tested")
def _(t):
    """A saved and reloaded model predicts as the one that was trained, on the documents that its metrics are of."""
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    rows = labeled_features(t)
    model, metrics = M.train_job(rows, COLUMNS, "quality", "split", "DECISION_TREE", "job-1", path)
    test = M.assemble(rows.where("split = 'test'"), COLUMNS, "quality")
    first = M.predict(test, model, ["doc_id"]).select("doc_id", F.col("prediction").alias("a"), F.col("confidence").alias("ca"))
    again = M.predict(test, M.load_model(path), ["doc_id"]).select("doc_id", F.col("prediction").alias("b"), F.col("confidence").alias("cb"))
    m = stored(metrics).first()
    same = (F.col("a") == F.col("b")) & (F.col("ca") == F.col("cb"))
    return first.join(again, "doc_id").select(
        "doc_id", F.lit(m.job_id).alias("job_id"), F.lit(m.algorithm).alias("algorithm"), F.lit(m.samples).cast("long").alias("samples"),
        same.alias("same_after_reload"), F.lit(m.accuracy >= FLOOR).alias("learns"),
    )


@query("i1_predict", "SELECT doc_id, 2 AS n_scores, true AS sums_to_one, true AS is_largest FROM labels JOIN documents USING (doc_id)")
def _(t):
    """All labelled documents scored by a model of the training part: a score per class, the confidence is the predicted one's."""
    rows = M.assemble(labeled_features(t), COLUMNS, "toxic")
    out = M.predict(rows, M.train("LOGISTIC_REGRESSION", rows.where("split = 'train'")), ["doc_id"])
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + x)
    largest = (F.get("scores", F.col("prediction").cast("int")) == F.col("confidence")) & (F.col("confidence") == F.array_max("scores"))
    return out.select("doc_id", F.size("scores").alias("n_scores"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"), largest.alias("is_largest"))


@query(
    "i1_error_rows",
    """SELECT l.doc_id, CASE WHEN d.doc_id IS NULL OR l.doc_id % 5 = 0 THEN 'feature text_length is missing' WHEN l.doc_id % 7 = 0 THEN 'feature digit_count is not a number' ELSE 'scored' END AS outcome
      FROM labels l LEFT JOIN documents d USING (doc_id)""",
)
def _(t):
    """Labelled documents with some features spoilt: every one is either scored or a dead letter that names the feature."""
    rows = labeled_features(t)
    model = M.train("NAIVE_BAYES", M.assemble(rows, COLUMNS, "toxic").where("split = 'train'"))
    spoilt = t.labels.select("doc_id").join(rows, "doc_id", "left").withColumns({
        "text_length": F.when(F.col("doc_id") % 5 != 0, F.col("text_length")),
        "digit_count": F.when((F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 5 != 0), F.lit(float("nan"))).otherwise(F.col("digit_count").cast("double")),
    })
    good, failed = M.predict_or_error(spoilt, COLUMNS, model, "doc_id")
    return good.select("doc_id", F.lit("scored").alias("outcome")).union(failed.select("raw_text_id", "error"))


@query(
    "e6_cross_validate",
    """SELECT CAST(('0x' || substr(md5('42|' || doc_id), 1, 7))::BIGINT % 5 AS INTEGER) AS fold, count(*) AS samples, true AS learns FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
)
def _(t):
    rows = M.assemble(labeled_features(t), COLUMNS, "quality").select("doc_id", "features", "label")
    return M.cross_validate(rows, "doc_id", "NAIVE_BAYES").select("fold", F.col("samples").cast("long").alias("samples"), (F.col("accuracy") >= FLOOR).alias("learns"))


@query(
    "e11_hyperparameter_grid",
    """SELECT '{"regParam":"' || r || '","elasticNetParam":"' || e || '"}' AS parameters, true AS learns FROM (SELECT unnest(['0.01', '0.1']) AS r) CROSS JOIN (SELECT unnest(['0.0', '0.5']) AS e)""",
)
def _(t):
    rows = M.assemble(labeled_features(t), COLUMNS, "quality").select("doc_id", "features", "label")
    _, scores = M.hyperparameter_grid(rows, "doc_id", LogisticRegression(), {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5]}, parallelism=4)
    p = F.col("parameters")
    return scores.select(F.to_json(F.struct(p["regParam"].alias("regParam"), p["elasticNetParam"].alias("elasticNetParam"))).alias("parameters"), F.col("score").between(FLOOR, 1).alias("learns"))


@query(
    "x12_doc_embedding",
    """SELECT a.doc_id, a.text = b.text AS copy, true AS unit_length, true AS bounded, true AS copies_agree FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""",
)
def _(t):
    """Every document's vector against that of the next id: 32 numbers of unit length (or none, without frequent words); copies have the same."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"), T.tokenize("text", lower=True).alias("tk"))
    e = stored(WV.doc_embedding(d, "doc_id", "tk", dim=32, iterations=5).select("doc_id", "h", "embedding"))
    after = e.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("other_h"), F.col("embedding").alias("other"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    cosine = WV.cosine(F.col("embedding"), F.col("other"))
    none = F.col("embedding").isNull()
    copy = F.col("h") == F.col("other_h")
    return e.join(after, "doc_id").select(
        "doc_id", copy.alias("copy"), (none | ((F.size("embedding") == 32) & (F.abs(norm - 1) < 1e-9))).alias("unit_length"),
        F.coalesce(cosine.between(-1 - 1e-9, 1 + 1e-9), F.lit(True)).alias("bounded"), (~copy | none | (cosine > 1 - 1e-9)).alias("copies_agree"),
    )


# --- augmentation ------------------------------------------------------------------------
@query("g1_augment", f"WITH {A.augmented(SYNONYMS, 3)} SELECT doc_id, copy::INT AS copy, strategy, md5(augmented) AS digest FROM made WHERE {A.CHANGED}")
def _(t):
    return G.augment(t.documents, "doc_id", "text", 3, synonyms=SYNONYMS).select("doc_id", "copy", "strategy", F.md5("augmented").alias("digest"))


_ONE = {
    "g2_synonym_replace": ("synonym_replace", A.single(A.synonym(SYNONYMS))),
    "g3_random_insert": ("random_insert", A.single(A.insert())),
    "g4_random_swap": ("random_swap", A.single(A.swap(), A.swap_columns())),
    "g5_random_delete": ("random_delete", A.single(A.delete())),
}


def _one(t, strategy):
    out = G.augment(t.documents, "doc_id", "text", 1, (strategy,), synonyms=SYNONYMS)
    return out.select("doc_id", F.size(F.split("augmented", " ")).alias("n_words"), F.md5("augmented").alias("digest"))


for _name, (_strategy, _made) in _ONE.items():
    query(_name, f"WITH {_made} SELECT doc_id, len(string_split(augmented, ' '))::INT AS n_words, md5(augmented) AS digest FROM made WHERE {A.CHANGED}")(
        lambda t, strategy=_strategy: _one(t, strategy)
    )


@query("g6_back_translation", f"WITH {A.back_translation(SYNONYMS, 2)} SELECT doc_id, copy::INT AS copy, md5(augmented) AS digest FROM made WHERE {A.CHANGED}")
def _(t):
    return G.back_translation_augment(t.documents, "doc_id", "text", 2, synonyms=SYNONYMS).select("doc_id", "copy", F.md5("augmented").alias("digest"))


@query("g7_noise_injection", f"WITH {A.noise(2)} SELECT doc_id, copy::INT AS copy, md5(augmented) AS digest FROM made WHERE {A.CHANGED}")
def _(t):
    return G.noise_augment(t.documents, "doc_id", "text", 2).select("doc_id", "copy", F.md5("augmented").alias("digest"))


@query(
    "g8_batch_augment",
    f"""WITH {A.augmented(SYNONYMS, 2)}, l AS (SELECT doc_id, count(*) AS n, string_agg(augmented, chr(10) ORDER BY copy) AS a FROM made WHERE {A.CHANGED} GROUP BY 1)
      SELECT 'text_' || doc_id AS key, coalesce(n, 0)::INT AS n_copies, md5(coalesce(a, '')) AS digest FROM documents LEFT JOIN l USING (doc_id)""",
)
def _(t):
    out = G.batch_augment(t.documents, "doc_id", "text", 2, synonyms=SYNONYMS)
    return out.select("key", F.size("augmented").alias("n_copies"), F.md5(F.array_join("augmented", "\n")).alias("digest"))
