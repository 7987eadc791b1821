"""Evaluation of predictions, clusters, latencies and training histories on tables."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modsift.operators.scale import cumulative, join_few, join_salted, null_safe_join, order_statistics, stored


# --- latency ---------------------------------------------------------------------
def latency_profile(df: DataFrame, by: list[str], latency: str, failed: Column, seconds: float | None = None) -> DataFrame:
    """Count, mean, extremes, exact p95/p99 (element floor(n*p/100)), error rate per group.

    All rows count, also those without a latency (failed requests often have none); mean, extremes and
    percentiles are over the known latencies.  Null groups are a group.
    """
    aggs = [
        F.count("*").alias("n"),
        F.avg(latency).alias("avg_ms"),
        F.min(latency).alias("min_ms"),
        F.max(latency).alias("max_ms"),
        (F.count_if(failed) / F.count("*")).alias("error_rate"),
    ]
    if seconds:
        aggs.append((F.count("*") / F.lit(seconds)).alias("throughput"))
    plain = df.groupBy(*by).agg(*aggs)
    tails = order_statistics(df, by, latency, {"p95_ms": 0.95, "p99_ms": 0.99})
    if by:
        return null_safe_join(plain, tails, by, "left")
    return plain.withColumn("__t", tails.select(F.struct("*")).scalar()).select("*", "__t.*").drop("__t")


# --- classification ------------------------------------------------------------------
def confusion_counts(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def classification_metrics(df: DataFrame, actual: str, predicted: str, positive=1, by: list[str] | None = None) -> DataFrame:
    """Accuracy, binary precision/recall/F1, FPR/FNR and class-weighted averages, from the confusion counts.

    Only the confusion table (classes squared) goes past the first aggregate.
    """
    by = by or []
    cells = confusion_counts(df, actual, predicted, by)
    hit = F.col("actual") == F.col("predicted")
    # Per class: support, predicted count and hits, by unrolling each cell to its two classes.
    sides = F.array(
        F.struct(F.col("actual").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("picked"), F.when(hit, F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("picked"), F.lit(0).cast("long").alias("tp")),
    )
    per_class = cells.select(*by, F.inline(sides)).groupBy(*by, "c").agg(
        F.sum("support").alias("support"), F.sum("picked").alias("picked"), F.sum("tp").alias("tp")
    )
    p = F.when(F.col("picked") > 0, F.col("tp") / F.col("picked")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    is_pos = F.col("c") == positive
    total = F.sum("support")
    tp = F.sum(F.when(is_pos, F.col("tp")).otherwise(0))
    pos = F.sum(F.when(is_pos, F.col("support")).otherwise(0))
    picked = F.sum(F.when(is_pos, F.col("picked")).otherwise(0))
    neg = total - pos
    return per_class.groupBy(*by).agg(
        total.alias("samples"),
        (F.sum("tp") / total).alias("accuracy"),
        F.sum(F.when(is_pos, p).otherwise(0.0)).alias("precision"),
        F.sum(F.when(is_pos, r).otherwise(0.0)).alias("recall"),
        F.sum(F.when(is_pos, f).otherwise(0.0)).alias("f1"),
        (F.sum(p * F.col("support")) / total).alias("weighted_precision"),
        (F.sum(r * F.col("support")) / total).alias("weighted_recall"),
        (F.sum(f * F.col("support")) / total).alias("weighted_f1"),
        F.when(neg > 0, (picked - tp) / neg).otherwise(0.0).alias("fpr"),
        F.when(pos > 0, (pos - tp) / pos).otherwise(0.0).alias("fnr"),
    )


def auc_roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve with ties counted half.

    Scores are reduced to one row per distinct value; positives above and negatives
    below are running totals accumulated by value ranges.
    """
    per_score = df.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    ran = cumulative(per_score, [], "s", {"neg_below": "neg", "pos_below": "pos"})
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return ran.agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    err = F.col(actual) - F.col(predicted)
    mse = F.avg(err * err)
    return df.groupBy(*(by or [])).agg(
        mse.alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(mse).alias("rmse"),
        (1 - F.try_divide(F.sum(err * err), F.var_pop(actual) * F.count(actual))).alias("r2"),
        F.pow(F.corr(actual, predicted), 2).alias("squared_correlation"),
    )


# --- clusters ------------------------------------------------------------------------------
def _cluster_parts(df: DataFrame, features: str, label: str) -> DataFrame:
    """Per cluster: size, centroid, sum of squared norms. Bounded by clusters x dimensions."""
    dims = df.select(
        F.col(label).alias("cluster"), F.posexplode(features).alias("i", "x")
    ).groupBy("cluster", "i").agg(
        F.avg(F.col("x").cast("double")).alias("mean"),
        F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("sq"),
        F.count("*").alias("n"),
    )
    return dims.groupBy("cluster").agg(
        F.max("n").alias("size"),
        F.transform(F.sort_array(F.collect_list(F.struct("i", "mean"))), lambda e: e["mean"]).alias("centroid"),
        F.sum("sq").alias("sq_norms"),
    )


def _sq_norm(v) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def _sq_distance(a, b) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda acc, d: acc + d
    )


CLUSTERS = 256  # of a block of cluster summaries that a row is compared with at once


def _blocks(parts: DataFrame, clusters: int) -> tuple[DataFrame, int]:
    """Cluster summaries in blocks of about ``clusters`` of them: (block, others), and the number of blocks."""
    blocks = max(1, -(-parts.count() // clusters))
    packed = F.collect_list(F.struct(*parts.columns)).alias("others")
    return parts.groupBy(F.pmod(F.xxhash64("cluster"), F.lit(blocks)).cast("int").alias("block")).agg(packed), blocks


def _against_blocks(rows: DataFrame, parts: DataFrame, clusters: int) -> DataFrame:
    """``rows`` once per block of summaries, with ``others``: no task holds more than some blocks, however many clusters."""
    packed, blocks = _blocks(parts, clusters)
    each = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    joined = each.join(F.broadcast(packed), "block") if blocks == 1 else join_salted(each, packed, ["block"])
    return joined.withColumn("others", F.coalesce("others", F.array().cast(dict(packed.dtypes)["others"]))).drop("block")


def silhouette(df: DataFrame, row_id: str, features: str, label: str, clusters: int = CLUSTERS) -> DataFrame:
    """Silhouette of each row with squared Euclidean distance, without forming pairs.

    The mean squared distance from x to a cluster is |x - centroid|^2 plus the
    cluster's variance, so one row per cluster is all each point needs; a point meets the clusters block by block.
    A row alone in its cluster scores 0; with a single cluster the score is null.  Row ids are unique.
    """
    parts = _cluster_parts(df, features, label).withColumn(
        "spread", F.col("sq_norms") / F.col("size") - _sq_norm(F.col("centroid"))
    )
    parts = stored(parts.select("cluster", "size", "centroid", "spread"))
    points = df.select(F.col(row_id).alias("__row"), F.col(features).alias("__x"), F.col(label).alias("cluster"))
    d = lambda c: _sq_distance(F.col("__x"), c["centroid"]) + c["spread"]
    met = _against_blocks(points, parts, clusters)
    own = F.filter("others", lambda c: c["cluster"].eqNullSafe(F.col("cluster")))
    away = F.array_min(F.transform(F.filter("others", lambda c: ~c["cluster"].eqNullSafe(F.col("cluster"))), d))
    judged = met.select("__row", "cluster", F.get(F.transform(own, lambda c: F.struct(c["size"].alias("size"), d(c).alias("d"))), F.lit(0)).alias("own"), away.alias("b"))
    if parts.count() > clusters:
        judged = judged.groupBy("__row", "cluster").agg(F.max("own").alias("own"), F.min("b").alias("b"))
    a = F.when(F.col("own.size") > 1, F.col("own.d") * F.col("own.size") / (F.col("own.size") - 1))
    judged = judged.withColumn("a", a)
    score = F.when(F.col("b").isNull(), F.lit(None).cast("double")).when(F.col("own.size") == 1, 0.0).otherwise(
        F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    )
    return judged.select(F.col("__row").alias(row_id), "cluster", score.alias("silhouette"))


def cluster_indices(df: DataFrame, features: str, label: str, clusters: int = CLUSTERS) -> DataFrame:
    """Within-cluster sum of squares, Calinski-Harabasz and Davies-Bouldin from cluster summaries.

    Davies-Bouldin needs the mean distance to the own centroid: one more narrow pass over the points.  Every cluster then
    meets the summaries block by block, and keeps its worst ratio.
    """
    parts = stored(_cluster_parts(df, features, label))
    points = df.select(F.col(label).alias("cluster"), F.col(features).alias("__x"))
    centred = join_few(points, parts.select("cluster", "centroid"), ["cluster"], most=10 * clusters)
    spread = centred.groupBy("cluster").agg(F.avg(F.sqrt(_sq_distance(F.col("__x"), F.col("centroid")))).alias("scatter"))
    whole = stored(null_safe_join(parts, spread, ["cluster"]))
    means = whole.select("size", F.posexplode("centroid").alias("i", "m")).groupBy("i").agg((F.sum(F.col("size") * F.col("m")) / F.sum("size")).alias("m"))
    grand = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"])).scalar()  # one number per dimension
    totals = whole.withColumn("grand", grand).agg(
        F.sum("size").alias("n"), F.count("*").cast("int").alias("k"),
        F.sum(F.col("sq_norms") - F.col("size") * _sq_norm(F.col("centroid"))).alias("wcss"),
        F.sum(F.col("size") * _sq_distance(F.col("centroid"), F.col("grand"))).alias("between"),
    )
    mine = whole.select(F.col("cluster").alias("of"), F.col("centroid").alias("at"), F.col("scatter").alias("own"))
    ratio = lambda c: F.try_divide(F.col("own") + c["scatter"], F.sqrt(_sq_distance(F.col("at"), c["centroid"])))
    worst = F.array_max(F.transform(F.filter("others", lambda c: ~c["cluster"].eqNullSafe(F.col("of"))), ratio))
    met = _against_blocks(mine, whole.select("cluster", "centroid", "scatter"), clusters).select("of", worst.alias("worst"))
    bouldin = met.groupBy("of").agg(F.max("worst").alias("worst")).agg(F.sum("worst").alias("worst"))
    n, k = F.col("n"), F.col("k")
    return totals.withColumn("worst", bouldin.scalar()).select(
        "n",
        "k",
        "wcss",
        F.try_divide(F.col("between") * (n - k), F.col("wcss") * (k - 1)).alias("calinski_harabasz"),
        (F.coalesce("worst", F.lit(0.0)) / k).alias("davies_bouldin"),
    )


# --- comparison, resampling, history ------------------------------------------------------------
def ab_compare(df: DataFrame, variant: str, actual: str, predicted: str, latency: str, failed: Column) -> DataFrame:
    quality = classification_metrics(df, actual, predicted, by=[variant])
    speed = latency_profile(df, [variant], latency, failed)
    return null_safe_join(quality, speed, [variant])


PRIME = (1 << 31) - 1  # draws are whole numbers below it


def poisson_bounds() -> list[int]:
    """Where a draw below PRIME passes 0, 1, 2, ...: the distribution of Poisson(1) weights, as far as draws can tell."""
    bounds, term, total, k = [], math.exp(-1), 0.0, 0
    while int((total + term) * PRIME) < PRIME - 1 and k < 20:
        total += term
        bounds.append(int(total * PRIME))
        k += 1
        term /= k
    return bounds


def replicate_constants(replicates: int, seed: int) -> list[tuple[int, int]]:
    """(a, b) per replicate from md5, so that other engines can repeat the draws."""
    digest = lambda r: hashlib.md5(f"{seed}:{r}".encode()).hexdigest()
    return [(int(digest(r)[:7], 16) * 2 + 1, int(digest(r)[7:14], 16)) for r in range(1, replicates + 1)]


def _resampled(constants: list[tuple[int, int]], bounds: list[int]):
    """h, v -> per replicate the weighted sum and the sum of weights over a task."""
    a, b = (np.array(c, np.int64) for c in zip(*constants))
    edges = np.array(bounds, np.int64)

    def run(batches):
        sums, weights = np.zeros(len(a)), np.zeros(len(a), np.int64)
        for batch in batches:
            h, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            step = max(1, 2_000_000 // max(len(h), 1))
            for at in range(0, len(a), step):
                u = (a[at : at + step, None] * h[None, :] + b[at : at + step, None]) % PRIME
                u = (u * u + h[None, :]) % PRIME
                w = np.searchsorted(edges, u, side="right")
                sums[at : at + step] += w @ v
                weights[at : at + step] += w.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(a) + 1)), pa.array(sums), pa.array(weights)], names=["r", "s", "n"])

    return run


def bootstrap_ci(df: DataFrame, row_id: str, value: str, replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Bootstrap interval of a mean: mean, low, high, replicates.

    Every row gets a Poisson(1) weight in every replicate, drawn from the md5 of its id, so reruns and retries agree.
    A task sums its rows into two numbers per replicate; only those are shuffled.  Null values take no part; rows
    that repeat an id are weighted alike; an empty table gives nulls.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string"))), 1, 7), 16, 10).cast("long")
    rows = df.where(F.col(value).isNotNull() & F.col(row_id).isNotNull()).select(h.alias("h"), F.col(value).cast("double").alias("v"))
    drawn = rows.mapInArrow(_resampled(replicate_constants(replicates, seed), poisson_bounds()), "r long, s double, n long")
    means = drawn.groupBy("r").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    tail = (1 - level) / 2
    return means.agg(
        F.avg("m").alias("mean"), F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"),
        F.count("m").alias("replicates"),
    )


def best_epoch(history: DataFrame, job: str, epoch: str, score: str, patience: int = 10, chunk: int = 1000) -> DataFrame:
    """Early-stopping outcome per job: best epoch and score, stop epoch, early-stopped flag.

    Epochs are dense integers, so a job's history is cut into chunks of epochs: chunk
    maxima are accumulated first and every chunk scans its own rows.
    """
    cut = history.withColumn("__chunk", F.floor(F.col(epoch) / chunk))
    tops = cut.groupBy(job, "__chunk").agg(F.max(score).alias("__top"))
    earlier = Window.partitionBy(job).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(job, "__chunk", F.max("__top").over(earlier).alias("__before"))
    inside = Window.partitionBy(job, "__chunk").orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    marked = cut.join(before, [job, "__chunk"]).withColumn(
        "__best", F.greatest(F.col("__before"), F.max(score).over(inside))
    )
    improved = marked.where(F.col("__best").isNull() | (F.col(score) > F.col("__best"))).select(job, "__chunk", epoch, score)
    # The next improvement (or the end of the log) tells whether patience ran out after this one.
    firsts = improved.groupBy(job, "__chunk").agg(F.min(epoch).alias("__first"))
    later = firsts.select(
        job, "__chunk", F.lead("__first").over(Window.partitionBy(job).orderBy("__chunk")).alias("__later")
    )
    in_chunk = Window.partitionBy(job, "__chunk").orderBy(epoch)
    ends = history.groupBy(job).agg(F.max(epoch).alias("__last"))
    steps = (
        improved.join(later, [job, "__chunk"])
        .withColumn("__next", F.coalesce(F.lead(epoch).over(in_chunk), F.col("__later")))
        .join(ends, job)
    )
    idle_until = F.coalesce(F.col("__next") - 1, F.col("__last"))
    stopped = idle_until - F.col(epoch) >= patience
    first_stop = F.min(F.when(stopped, F.struct(F.col(epoch).alias("e"), F.col(score).alias("s"))))
    last = F.max(F.struct(F.col(epoch).alias("e"), F.col(score).alias("s")))
    out = steps.groupBy(job).agg(first_stop.alias("f"), last.alias("l"), F.max("__last").alias("__last"))
    best = F.coalesce("f", "l")
    return out.select(
        job,
        best["e"].alias("best_epoch"),
        best["s"].alias("best_score"),
        F.col("f").isNotNull().alias("early_stopped"),
        F.coalesce(F.col("f.e") + patience, F.col("__last")).alias("stop_epoch"),
    )
