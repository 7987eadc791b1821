"""Training, prediction and model selection on tables with Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.storagelevel import StorageLevel
from pyspark.sql import functions as F

from modsift.operators.evaluation import classification_metrics
from modsift.operators.relational import union_sources
from modsift.operators.scale import stored
from modsift.sources.sinks import error_rows

SEED = 42
FEATURES, LABEL = "features", "label"
ROWS_PER_TASK = 50_000  # of a training set


# --- estimators ------------------------------------------------------------------
def random_forest(trees: int = 100, depth: int = 20, min_leaf: int = 1) -> Estimator:
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, maxDepth=min(depth, 30), minInstancesPerNode=min_leaf, seed=SEED)


def svm(c: float = 1.0, rows: int = 1, iterations: int = 100, classes: int = 2) -> Estimator:
    """Linear SVM; the regularisation matches penalty c on a table of ``rows`` rows (``train`` counts them)."""
    base = LinearSVC(featuresCol=FEATURES, labelCol=LABEL, regParam=1.0 / (c * rows), maxIter=iterations)
    return base if classes == 2 else OneVsRest(classifier=base, featuresCol=FEATURES, labelCol=LABEL)


def logistic_regression(penalty: float = 0.01, tol: float = 1e-6, iterations: int = 1000) -> Estimator:
    return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=penalty, tol=tol, maxIter=iterations)


def naive_bayes() -> Estimator:
    return NaiveBayes(featuresCol=FEATURES, labelCol=LABEL, modelType="gaussian")


def decision_tree(depth: int = 20) -> Estimator:
    return DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, maxDepth=min(depth, 30), seed=SEED)


def gradient_boosting(rounds: int = 100, rate: float = 0.1, depth: int = 6, subsample: float = 1.0, classes: int = 2) -> Estimator:
    base = GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=subsample, seed=SEED)
    return base if classes == 2 else OneVsRest(classifier=base, featuresCol=FEATURES, labelCol=LABEL)


def dense_network(layers: list[int], iterations: int = 100) -> Estimator:
    """Dense layers with softmax output: what the transformer and BERT entries come down to."""
    return MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol=LABEL, layers=layers, maxIter=iterations, seed=SEED)


def kmeans(k: int = 3, iterations: int = 100) -> Estimator:
    return KMeans(featuresCol=FEATURES, predictionCol="prediction", k=k, maxIter=iterations, seed=SEED)


def hierarchical(k: int = 3) -> Estimator:
    """Bisecting k-means: a top-down hierarchy cut at k, where Ward linkage needs all pairs."""
    return BisectingKMeans(featuresCol=FEATURES, predictionCol="prediction", k=k, seed=SEED)


CLASSIFIERS: dict[str, Callable[..., Estimator]] = {
    "RANDOM_FOREST": random_forest,
    "SVM": svm,
    "LOGISTIC_REGRESSION": logistic_regression,
    "NAIVE_BAYES": naive_bayes,
    "DECISION_TREE": decision_tree,
    "GRADIENT_BOOSTING": gradient_boosting,
    "XGBOOST": gradient_boosting,
    "LIGHTGBM": gradient_boosting,
    "DENSE_NETWORK": dense_network,
    "TRANSFORMER": dense_network,
    "BERT": dense_network,
}
CLUSTERERS: dict[str, Callable[..., Estimator]] = {"KMEANS": kmeans, "HIERARCHICAL": hierarchical}


def assemble(df: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    out = VectorAssembler(inputCols=columns, outputCol=FEATURES, handleInvalid="skip").transform(df)
    return out.withColumn(LABEL, F.col(label).cast("double")) if label else out


def assemble_array(df: DataFrame, array: str) -> DataFrame:
    return df.withColumn(FEATURES, array_to_vector(F.transform(array, lambda x: x.cast("double"))))


# --- training ---------------------------------------------------------------------------
def by_size(rows: DataFrame) -> DataFrame:
    """Rows stored in as few partitions as their number needs: iterative fits run a job per pass, small ones wait for tasks."""
    rows = stored(rows)
    return rows.coalesce(max(1, -(-rows.count() // ROWS_PER_TASK)))


def train(algorithm: str, train_rows: DataFrame, **parameters) -> PipelineModel:
    makers = CLASSIFIERS | CLUSTERERS
    name = algorithm.upper()
    if name not in makers:
        raise ValueError(f"unknown algorithm {algorithm}; known: {sorted(makers)}")
    # Fitting passes over its input many times; keep just the two columns it reads, spilling to disk.
    data = by_size(train_rows.select(*[c for c in (FEATURES, LABEL) if c in train_rows.columns])).persist(StorageLevel.MEMORY_AND_DISK)
    if name == "SVM":
        parameters.setdefault("rows", max(1, data.count()))
    try:
        return Pipeline(stages=[makers[name](**parameters)]).fit(data)
    finally:
        data.unpersist()


def train_job(df: DataFrame, columns: list[str], label: str, split: str, algorithm: str, job: str, model_path: str | None = None, **parameters) -> tuple[PipelineModel, DataFrame]:
    """Fit on the training split, save, and return the model with its metric row on the test split."""
    rows = assemble(df, columns, label)
    model = train(algorithm, rows.where(F.col(split) == "train"), **parameters)
    if model_path:
        model.write().overwrite().save(model_path)
    scored = model.transform(rows.where(F.col(split) == "test"))
    metrics = classification_metrics(scored, LABEL, "prediction", positive=1.0)
    return model, metrics.select(F.lit(job).alias("job_id"), F.lit(algorithm.upper()).alias("algorithm"), "*")


def predict(df: DataFrame, model: PipelineModel, keep: list[str]) -> DataFrame:
    """Prediction, confidence and scores per class; rows without features are left out."""
    scored = model.transform(df.where(F.col(FEATURES).isNotNull()))
    if "probability" in scored.columns:
        scores = vector_to_array("probability")
        return scored.select(*keep, "prediction", F.array_max(scores).alias("confidence"), scores.alias("scores"))
    if "rawPrediction" in scored.columns:
        margin = vector_to_array("rawPrediction")
        squashed = F.transform(margin, lambda m: 1 / (1 + F.exp(-m)))
        return scored.select(*keep, "prediction", F.array_max(squashed).alias("confidence"), squashed.alias("scores"))
    return scored.select(*keep, "prediction", F.lit(None).cast("double").alias("confidence"))


def predict_or_error(df: DataFrame, columns: list[str], model: PipelineModel, row_id: str, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions of the rows that can be scored, and a dead-letter row for every other one.

    A row cannot be scored if a feature is null, NaN or infinite; its error names the first such column.  Error rows have
    raw_text_id, source, error and ts, as the processing chain's have.  Every row is in just one of the two tables.
    """
    value = lambda c: F.col(f"`{c}`").cast("double")
    bad = [
        F.when(value(c).isNull(), F.lit(f"feature {c} is missing")).when(F.isnan(value(c)) | (F.abs(value(c)) == float("inf")), F.lit(f"feature {c} is not a number"))
        for c in columns
    ]
    judged = df.withColumn("__error", F.coalesce(*bad))
    good = assemble(judged.where(F.col("__error").isNull()).drop("__error"), columns)
    failed = error_rows(judged.withColumn("__source", F.lit("inference")), row_id, "__source", "__error")
    return predict(good, model, [row_id, *(keep or [])]), failed


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _centred(df: DataFrame) -> DataFrame:
    """``df`` with __c, the features less their mean."""
    values = df.select(F.posexplode(vector_to_array(FEATURES)).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    mean = values.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("mean")).scalar()
    return df.withColumn("__mean", mean).withColumn("__c", F.zip_with(vector_to_array(FEATURES), "__mean", lambda x, m: x - m))


def _squared_norm(v: Column | str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def spread_around_mean(df: DataFrame, keep: list[str]) -> DataFrame:
    """Squared distance of each row to the mean: its reconstruction error without any component."""
    return _centred(df).select(*keep, _squared_norm("__c").alias("spread"))


def reconstruction_error(df: DataFrame, keep: list[str], k: int = 64) -> DataFrame:
    """Linear bottleneck of size k: squared distance of each centred row to its k-component projection.

    PCA components are orthonormal, so the error is the row's squared norm minus that of
    its projection, both around the mean.
    """
    model = PCA(k=k, inputCol=FEATURES, outputCol="__pc").fit(df)
    projected = model.transform(_centred(df).withColumn(FEATURES, array_to_vector("__c")))
    error = _squared_norm("__c") - _squared_norm(vector_to_array("__pc"))
    return projected.select(*keep, F.greatest(F.lit(0.0), error).alias("reconstruction_error"))


# --- selection ------------------------------------------------------------------------------
def cross_validate(rows: DataFrame, row_id: str, algorithm: str, folds: int = 5, seed: int = SEED, **parameters) -> DataFrame:
    """One metric row per fold; folds come from a hash of the id, so they never change with partitioning."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string"))), 1, 7), 16, 10).cast("long")
    cut = rows.withColumn("fold", (drawn % folds).cast("int"))
    cut = stored(cut.select(FEATURES, LABEL, "fold"))  # read by every fold
    results = []
    for fold in range(folds):
        model = train(algorithm, cut.where(F.col("fold") != fold), **parameters)
        scored = model.transform(cut.where(F.col("fold") == fold))
        results.append(classification_metrics(scored, LABEL, "prediction", positive=1.0).withColumn("fold", F.lit(fold)))
    return union_sources(*results)


def hyperparameter_grid(
    rows: DataFrame, row_id: str, estimator: Estimator, grid: dict[str, list], train_ratio: float = 0.8, metric: str = "f1", parallelism: int = 1
) -> tuple[object, DataFrame]:
    """Try every combination on one train/validation split; returns the best model and the scores in the grid's order.

    The split follows a hash of the id, so it never changes with partitioning; the first of equal scores wins.
    ``parallelism`` fits run at a time, on one stored split; scores and order do not depend on it.
    """
    builder = ParamGridBuilder()
    for name, options in grid.items():
        builder = builder.addGrid(estimator.getParam(name), options)
    maps = builder.build()
    evaluator = (
        BinaryClassificationEvaluator(labelCol=LABEL) if metric == "auc"
        else MulticlassClassificationEvaluator(labelCol=LABEL, metricName=metric)
    )
    part = F.pmod(F.xxhash64(F.col(row_id), F.lit(SEED)), F.lit(1_000_000)) < int(train_ratio * 1_000_000)
    data = by_size(rows.select(FEATURES, LABEL, part.alias("__train"))).persist(StorageLevel.MEMORY_AND_DISK)
    train_rows, held = data.where("__train"), data.where("NOT __train")

    def tried(chosen) -> tuple[float, object]:
        model = estimator.fit(train_rows, chosen)
        return float(evaluator.evaluate(model.transform(held))), model

    try:
        data.count()
        with ThreadPool(max(1, min(parallelism, len(maps)))) as pool:  # threads only wait for Spark's jobs
            results = pool.map(inheritable_thread_target(rows.sparkSession)(tried), maps, chunksize=1)
    finally:
        data.unpersist()
    best = max(results, key=lambda r: r[0])[1]
    scores = [({p.name: str(v) for p, v in chosen.items()}, score) for chosen, (score, _) in zip(maps, results)]
    return best, rows.sparkSession.createDataFrame(scores, "parameters MAP<STRING,STRING>, score DOUBLE")
