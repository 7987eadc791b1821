"""Training data as tables: splits, statistics, scaling, sampling, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modsift.operators.relational import union_sources
from modsift.operators.scale import counted_order_statistics, hash_rank, stored, top_n_per_key


def _check_ratios(val: float, test: float) -> None:
    if val < 0 or test < 0 or val + test > 1.001:
        raise ValueError("split ratios must lie in [0, 1] and sum to at most 1")


def split_dataset(df: DataFrame, row_id: str, val: float = 0.1, test: float = 0.1, seed: int = 42, exact: bool = False) -> DataFrame:
    """Add ``split``: train, validation or test.

    Default: the hash of the id against fixed thresholds, no shuffle, sizes near the
    ratios.  ``exact``: floor(n * ratio) rows each, by the global hash rank.
    """
    _check_ratios(val, test)
    if exact:
        ranked = hash_rank(df, F.col(row_id), f"{seed}|")
        n_test = F.floor(F.col("total") * test)
        n_val = F.floor(F.col("total") * val)
        split = F.when(F.col("rank") < n_test, "test").when(F.col("rank") < n_test + n_val, "validation").otherwise("train")
        return ranked.withColumn("split", split).drop("rank", "total")
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")), 256)
    point = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(point < test, "test").when(point < test + val, "validation").otherwise("train"))


def unpivot_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows, one per numeric cell."""
    return df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    )


def feature_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: moments, exact quartiles, distinct and missing counts, 1.5 IQR outliers.

    Cells are counted by (column, value) first; every later step works on distinct
    values, and quantiles come from value ranges, so a column is never one task's work.
    """
    cells = unpivot_numeric(df, columns)
    plain = cells.groupBy("column").agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.var_samp("value").alias("variance"),
        F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("kurtosis"),
    )
    counted = stored(cells.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("c")))
    quartiles = counted_order_statistics(counted, ["column"], "value", "c", {"q25": 0.25, "median": 0.5, "q75": 0.75}, "linear")
    iqr = F.col("q75") - F.col("q25")
    outside = (F.col("value") < F.col("q25") - 1.5 * iqr) | (F.col("value") > F.col("q75") + 1.5 * iqr)
    spread = (
        counted.join(F.broadcast(quartiles), "column")  # one row per named column
        .groupBy("column")
        .agg(F.count("*").alias("unique_values"), F.sum(F.when(outside, F.col("c")).otherwise(0)).alias("outliers"))
    )
    return plain.join(F.broadcast(quartiles), "column").join(F.broadcast(spread), "column")


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def missing_values(df: DataFrame) -> DataFrame:
    """(column, data_type, missing) for every column, in one pass."""
    totals = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return totals.select(
        F.inline(
            F.array(*[
                F.struct(F.lit(c).alias("column"), F.lit(t).alias("data_type"), F.col(f"`{c}`").alias("missing"))
                for c, t in df.dtypes
            ])
        )
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair in long form, one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*cells)))


def scaling_parameters(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of per-column mean, std, min and max, fitted on the training split only."""
    aggs: list[Column] = []
    for c in columns:
        aggs += [
            F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
            F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"),
        ]
    return train.agg(*aggs)


def preprocess_dataset(df: DataFrame, columns: list[str], scaling: str = "standard", missing: str = "mean", train: Column | None = None) -> DataFrame:
    """Fill and scale numeric columns with parameters of the training rows.

    ``scaling``: standard, minmax or none.  ``missing``: mean, zero or drop.
    """
    if missing == "drop":
        df = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    fitted = scaling_parameters(df if train is None else df.where(train), columns)
    out = df.withColumn("__p", fitted.select(F.struct("*")).scalar())
    for c in columns:
        p = F.col("__p")
        v = F.col(c).cast("double")
        v = F.coalesce(v, p[f"{c}__mean"] if missing == "mean" else F.lit(0.0)) if missing != "drop" else v
        if scaling == "standard":
            v = F.when(p[f"{c}__std"] > 0, (v - p[f"{c}__mean"]) / p[f"{c}__std"]).otherwise(0.0)
        elif scaling == "minmax":
            width = p[f"{c}__max"] - p[f"{c}__min"]
            v = F.when(width > 0, (v - p[f"{c}__min"]) / width).otherwise(0.0)
        out = out.withColumn(c, v)
    return out.drop("__p")


def select_by_variance(df: DataFrame, columns: list[str], threshold: float = 0.0) -> DataFrame:
    """(column, variance) of the columns whose variance exceeds the threshold."""
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("variance")) for c in columns])
    return row.select(F.inline(cells)).where(F.col("variance") > threshold)


def univariate_scores(df: DataFrame, label: str, numeric: list[str] = (), categorical: list[str] = ()) -> DataFrame:
    """(column, test, score, freedom): how much each column tells of the classes of ``label``.

    Numeric columns: ANOVA F of the class means, from count, mean and variance per column and class.  Categorical ones:
    chi-squared of independence, from counts per value and class.  Each kind takes one pass; what is shuffled is a row
    per column and class (and value).  Null values and labels take no part.  With fewer than two classes, or nothing
    left to vary inside them, the score is null.
    """
    known = df.where(F.col(label).isNotNull()).withColumn("__y", F.col(label))
    parts = []
    if numeric:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in numeric])
        each = known.select("__y", F.inline(cells)).where(F.col("x").isNotNull() & ~F.isnan("x"))
        groups = each.groupBy("column", "__y").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
        whole = groups.groupBy("column").agg(
            F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("v")).alias("within"),
            F.collect_list(F.struct("n", "m")).alias("g"),  # one entry per class
        )
        mean = F.col("s") / F.col("n")
        between = F.aggregate("g", F.lit(0.0), lambda acc, e: acc + e["n"] * (e["m"] - mean) * (e["m"] - mean))
        f = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
        parts.append(whole.select("column", F.lit("anova_f").alias("test"), f.alias("score"), (F.col("k") - 1).alias("freedom")))
    if categorical:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("x")) for c in categorical])
        counts = known.select("__y", F.inline(cells)).where(F.col("x").isNotNull()).groupBy("column", "x", "__y").agg(F.count("*").alias("o"))
        rows = counts.groupBy("column", "x").agg(F.sum("o").alias("r"))
        classes = counts.groupBy("column", "__y").agg(F.sum("o").alias("c"))
        shares = counts.join(rows, ["column", "x"]).join(classes, ["column", "__y"])
        share = shares.groupBy("column").agg(F.sum(F.col("o") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("q"), F.sum("o").alias("n"))
        freedom = rows.groupBy("column").agg((F.count("*") - 1).alias("a")).join(classes.groupBy("column").agg((F.count("*") - 1).alias("b")), "column")
        found = share.join(freedom, "column").withColumn("freedom", F.col("a") * F.col("b"))
        score = F.when(F.col("freedom") > 0, F.col("n") * (F.col("q") - 1))
        parts.append(found.select("column", F.lit("chi_squared").alias("test"), score.alias("score"), "freedom"))
    return union_sources(*parts)


def select_univariate(df: DataFrame, label: str, k: int, numeric: list[str] = (), categorical: list[str] = ()) -> DataFrame:
    """The label and the ``k`` columns of each kind that tell most of it; ties by name, columns without a score last."""
    scores = univariate_scores(df, label, numeric, categorical)
    best = top_n_per_key(scores, ["test"], [F.desc_nulls_last("score"), F.asc("column")], k)
    chosen = {r["column"] for r in best.collect()}  # 2 * k names at most
    return df.select(label, *[c for c in df.columns if c in chosen and c != label])


def reduce_dimensions(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """First k principal components of the given columns, as an array column."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(df)
    model = PCA(k=k, inputCol="__v", outputCol="__pc").fit(vectors)
    return model.transform(vectors).withColumn("components", vector_to_array("__pc")).drop("__v", "__pc")


def sample_dataset(df: DataFrame, row_id: str, size: int, seed: int = 42) -> DataFrame:
    """A reproducible sample of exactly ``size`` rows: smallest hashes win (partial top-k per task)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")), 256)
    return df.withColumn("__h", digest).orderBy("__h").limit(size).drop("__h")


def validate_dataset(df: DataFrame, target: str | None, task: str, max_missing: float = 0.5) -> DataFrame:
    """(check, ok) rows: non-empty, target present, numeric features, enough classes, missing share."""
    types = dict(df.dtypes)
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    features = [c for c in df.columns if c != target]
    all_numeric = all(types[c] in numeric or types[c].startswith("decimal") for c in features)
    has_target = target in types
    needs_target = task in ("classification", "regression")
    classes = F.count_distinct(F.col(target)) if has_target and task == "classification" else F.lit(2)
    worst = F.greatest(*[F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns], F.lit(0))
    row = df.agg(F.count("*").alias("n"), classes.alias("classes"), worst.alias("worst"))
    checks = [
        ("non_empty", F.col("n") > 0),
        ("target_present", F.lit(has_target or not needs_target)),
        ("numeric_features", F.lit(all_numeric)),
        ("enough_classes", F.col("classes") >= 2),
        ("missing_share", F.col("worst") <= F.col("n") * max_missing),
    ]
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), ok.alias("ok")) for k, ok in checks])))


def balance_classes(df: DataFrame, row_id: str, target: str, size: int, seed: int = 42) -> DataFrame:
    """An evenly distributed sample: floor(size / classes) rows of each class by hash rank."""
    each = size // max(1, df.agg(F.count_distinct(target)).first()[0])
    if each == 0:
        return df.where(F.lit(False))
    hashed = df.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")), 256))
    return top_n_per_key(hashed, [target], [F.asc("__h"), F.asc(row_id)], each).select(*df.columns)


def dataset_summary(df: DataFrame, split: str, target: str, n_features: int) -> DataFrame:
    return df.groupBy(split).agg(
        F.count("*").alias("rows"), F.count_distinct(target).alias("classes"), F.lit(n_features).alias("features")
    )
