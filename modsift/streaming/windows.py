"""Event-time windows: rates, quantiles, sustained breaches. Same code for tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATENESS = "10 minutes"


def _timed(df: DataFrame, ts: str) -> DataFrame:
    return df.withWatermark(ts, LATENESS) if df.isStreaming else df


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _seconds(text: str) -> int:
    amount, unit = text.split()
    return int(amount) * _UNITS[unit.rstrip("s")]


def _window_counts(df: DataFrame, ts: str, by: list[str], counts: dict[str, Column], size: str, step: str) -> DataFrame:
    """Named counts per window and group, with window_start and window_end.

    On a table with sliding windows, events are counted per step first: each event is
    aggregated once and only step counts are copied into the windows that cover them.
    """
    aggs = [c.alias(n) for n, c in counts.items()]
    if size == step:
        out = _timed(df, ts).groupBy(F.window(ts, size).alias("w"), *by).agg(*aggs)
    elif df.isStreaming or _seconds(size) % _seconds(step):
        out = _timed(df, ts).groupBy(F.window(ts, size, step).alias("w"), *by).agg(*aggs)
    else:
        steps = df.groupBy(F.window(ts, step).alias("__s"), *by).agg(*aggs)
        flat = steps.select(F.col("__s.start").alias("__t"), *by, *counts)
        out = flat.groupBy(F.window("__t", size, step).alias("w"), *by).agg(*[F.sum(n).alias(n) for n in counts])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *counts)


def windowed_count(df: DataFrame, ts: str, by: list[str], size: str, step: str) -> DataFrame:
    return _window_counts(df, ts, by, {"n": F.count("*")}, size, step)


def windowed_rate(
    df: DataFrame, ts: str, hit: Column, size: str = "5 minutes", step: str = "1 minute",
    seconds: float = 300.0, limit: float = 0.1, by: list[str] | None = None,
) -> DataFrame:
    """Hits per second in sliding windows and whether the rate breaches the limit."""
    counted = _window_counts(df, ts, by or [], {"errors": F.count_if(hit)}, size, step)
    rate = F.col("errors") / F.lit(float(seconds))
    return counted.withColumn("rate", rate).withColumn("breach", rate > limit)


def bucket_of(value: str, edges: list[float]) -> Column:
    """Upper bound of the histogram bucket a value falls in; the last edge takes the rest."""
    out = F.lit(float(edges[-1]))
    for edge in reversed(edges[:-1]):
        out = F.when(F.col(value) <= edge, F.lit(float(edge))).otherwise(out)
    return out


def windowed_quantile(
    df: DataFrame, ts: str, value: str, edges: list[float], q: float = 0.95, size: str = "5 minutes",
    step: str = "1 minute", limit: float = 0.5, by: list[str] | None = None,
) -> DataFrame:
    """Histogram quantile per window: linear interpolation inside the bucket that holds the rank.

    One conditional count per bucket, so a window is one aggregated row; works on streams too.
    """
    by = by or []
    b = bucket_of(value, edges)
    counts = {f"b{i}": F.count_if(b == float(e)) for i, e in enumerate(edges)} | {"n": F.count("*")}
    rows = _window_counts(df, ts, by, counts, size, step)
    rank = F.lit(q) * F.col("n")
    below = F.lit(0)
    result = F.lit(None).cast("double")
    pieces = []
    lower = 0.0
    for i, e in enumerate(edges):
        here = F.col(f"b{i}")
        pieces.append((below + here >= rank, F.lit(lower) + (F.lit(float(e)) - lower) * (rank - below) / here, here > 0))
        below, lower = below + here, float(e)
    for reached, estimate, filled in reversed(pieces):
        result = F.when(reached & filled, estimate).otherwise(result)
    return rows.select("window_start", "window_end", *by, result.alias("quantile")).withColumn(
        "breach", F.col("quantile") > limit
    )


def sustained_breach(windows: DataFrame, by: list[str], step_seconds: int, min_seconds: int) -> DataFrame:
    """Runs of consecutive breaching windows that last at least ``min_seconds``.

    Input is one row per window and group, so its length is bounded by time, not events.
    """
    hits = windows.where("breach")
    number = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("window_start"))
    # Seconds since an early fixed instant, for timestamps with or without zone.
    seconds = F.unix_seconds(F.col("window_start").cast("timestamp"))
    islands = hits.withColumn("island", seconds - number * step_seconds)
    return (
        islands.groupBy(*by, "island")
        .agg(
            F.min("window_start").alias("breach_start"),
            (F.max("window_start") + F.expr(f"INTERVAL {step_seconds} SECONDS")).alias("breach_end"),
            F.count("*").alias("windows"),
        )
        .where(F.col("windows") * step_seconds >= min_seconds)
        .drop("island")
    )
