"""Batch inference and audit decisions on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsift import values as V
from modsift.functions import text as T
from modsift.operators.scale import join_few, order_statistics


def rule_score(tokens: Column | str, words: list[str], weight: float = 10.0) -> Column:
    """Share of lexicon hits among tokens, scaled and clipped to [0, 1]."""
    tokens = T.as_col(tokens)
    n = F.size(tokens)
    return F.when(n > 0, F.least(F.lit(1.0), T.count_words(tokens, words) / n * weight)).otherwise(0.0)


def audit_texts(df: DataFrame, scores: dict[str, tuple[Column, str]], threshold: float = 0.5, combine: str = "max") -> DataFrame:
    """Combine model scores into one decision per text.

    ``scores`` maps model name -> (score column, violation type).  The decision
    carries every model's result, the combined confidence as DECIMAL(5,4), the type
    of the strongest violating model and a short explanation.
    """
    results = F.array(*[
        F.struct(
            F.lit(name).alias("model_name"),
            score.cast("double").alias("score"),
            (score >= threshold).alias("is_violation"),
            F.when(score >= threshold, F.lit(kind)).otherwise(F.lit("NORMAL")).alias("violation_type"),
        )
        for name, (score, kind) in scores.items()
    ])
    out = df.withColumn("model_results", results)
    values = F.transform("model_results", lambda r: r["score"])
    combined = F.array_max(values) if combine == "max" else F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    # Highest score first, model name breaks ties.
    ranked = F.sort_array(
        F.transform("model_results", lambda r: F.struct((-r["score"]).alias("s"), r["model_name"].alias("m"), r["violation_type"].alias("v")))
    )
    out = out.withColumn("confidence", F.round(combined, 4).cast("decimal(5,4)")).withColumn("is_violation", combined >= threshold)
    top = ranked[0]
    return out.withColumn(
        "violation_type",
        F.when(~F.col("is_violation"), "NORMAL").when(top["v"] == "NORMAL", "OTHER").otherwise(top["v"]),
    ).withColumn(
        "explanation",
        F.when(F.col("is_violation"), F.concat(F.lit("flagged by "), top["m"])).otherwise(F.lit("no violation found")),
    )


def moderation_class(score: Column | str, suspect: float = 0.3, violation: float = 0.7) -> Column:
    """normal / suspected / violation from one score and two thresholds."""
    normal, suspected, violating = V.MODERATION_CLASSES
    score = T.as_col(score)
    return F.when(score >= violation, violating).when(score >= suspect, suspected).otherwise(normal)


def classify_text(df: DataFrame, score: str, suspect: float = 0.3, violation: float = 0.7) -> DataFrame:
    s = F.col(score)
    normal, suspected, violating = V.MODERATION_CLASSES
    label = moderation_class(s, suspect, violation)
    confidence = F.when(label == normal, 1 - s).when(label == violating, s).otherwise(1 - F.abs(s - 0.5))
    return df.withColumn("moderation_class", label).withColumn("confidence", confidence)


def rule_labels(tokens: Column | str, rules: list[tuple[str, list[str]]]) -> Column:
    """Label code of the first rule whose lexicon hits; 0 (normal) when none does."""
    out = F.lit(None).cast("int")
    for name, words in reversed(rules):
        out = F.when(T.count_words(tokens, words) > 0, F.lit(V.RULE_LABELS[name])).otherwise(out)
    return F.coalesce(out, F.lit(V.RULE_LABELS["normal"]))


def detect_anomaly(df: DataFrame, by: list[str], value: str, factor: float = 1.5) -> DataFrame:
    """Flag values outside the IQR fences of their group; score is the distance in IQRs."""
    q = order_statistics(df, by, value, {"q25": 0.25, "q75": 0.75}, "linear")
    if by:
        joined = join_few(df, q, by)
    else:
        joined = df.withColumn("__q", q.select(F.struct("*")).scalar()).select("*", "__q.*").drop("__q")
    iqr = F.col("q75") - F.col("q25")
    low, high = F.col("q25") - factor * iqr, F.col("q75") + factor * iqr
    v = F.col(value)
    distance = F.greatest(F.lit(0.0), low - v, v - high)
    score = F.when(iqr > 0, distance / iqr).when(distance > 0, F.lit(float("inf"))).otherwise(0.0)
    return (
        joined.withColumn("anomaly_score", score)
        .withColumn("is_anomaly", distance > 0)
        .withColumn("confidence", F.when(F.col("is_anomaly"), 1 - F.exp(-score)).otherwise(F.lit(1.0)))
        .drop("q25", "q75")
    )


def requests_by(df: DataFrame, limit: int, offset: int = 0, **equals) -> DataFrame:
    """Newest-first page of requests matching the given columns."""
    for k, v in equals.items():
        df = df.where(F.col(k) == v)
    return df.orderBy(F.desc("created_at"), F.asc("request_id")).offset(offset).limit(limit)
