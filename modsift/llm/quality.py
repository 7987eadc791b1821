"""Document quality by Bradley-Terry pairwise ranking.

Every labelled document gives preference pairs (good over bad).  Scores are linear in features of the whole
text and are learnt by the logistic loss on the feature differences of the pairs.  The threshold is the
quantile of the scores at the share of bad labels, and a calibrated slope around it gives numbers
between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from modsift.llm.common import bounded_batches, checkpointed, crc_mod5, whole_text, with_ordinal
from modsift.operators.scale import FEW_ROWS, RANGES, cumulative

PAIRS = 40_000  # of fewer labelled documents as many pairs as there are
TURNS = 4  # pairs of each document of the larger class, at least
PIECE = 50_000  # labelled documents of a task of the fit
CUT = 0.3  # the score at the threshold
FEATURES = ["upper", "digits", "symbols", "bars", "exclamations", "stops", "spaces", "words", "distinct", "distinct_share", "repeats", "word_length", "line_share"]

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]=+/\\_`", b"|", b"!", b".,;:?'\"()-", b" \t\r\n\x0b\x0c"], 1):
    _CLASS[list(_chars)] = _i


def features(text: bytes) -> list[float]:
    """Shares (square roots, so that a part of a text counts) and logarithms of counts; all 0 for an empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    counts = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    shares = np.sqrt(counts[1:] / len(text)).tolist()
    words = text.split()
    n = max(1, len(words))
    distinct = len(set(words))
    repeats = sum(map(eq, words[1:], words))
    lines = text.split(b"\n")
    return [
        *shares,
        np.log1p(len(words)) / 5,
        np.log1p(distinct) / 5,
        distinct / n,
        (repeats / n) ** 0.5,
        min(2.0, len(text) / n / 10),
        len(set(lines)) / len(lines),
    ]


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _turns(n_large: int, n_small: int, pairs: int = PAIRS) -> int:
    """Partners of each document of the larger class; the i-th one meets the numbers i, i + 1, ... modulo n_small."""
    return min(n_small, max(TURNS, -(-pairs // n_large)))


def _constant(any_good: bool) -> Ranking:
    width = len(FEATURES)
    return Ranking(np.zeros(width), np.zeros(width), 0.0 if any_good else 1.0, 4.0)


def _newton_sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the loss of feature differences, in one vector."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
    return np.concatenate([d.T @ (1 - p), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], l2: float) -> np.ndarray:
    """Weights by Newton's method; ``sums`` adds up ``_newton_sums`` over all pairs.  Rounded, so that its order does not show."""
    width = len(FEATURES)
    w = np.zeros(width)
    for _ in range(30):
        s = sums(w)
        step = np.linalg.solve(s[width:].reshape(width, width) + l2 * np.eye(width), s[:width] - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return np.round(w, 9)


_SLOPES = np.geomspace(0.05, 20, 25)


def _slope_sums(raw: np.ndarray, is_good: np.ndarray, weight: np.ndarray, threshold: float) -> np.ndarray:
    """Weighted log likelihood of the labels at each slope."""
    z = _SLOPES[:, None] * (raw - threshold) + np.log(CUT / (1 - CUT))
    return -np.logaddexp(0, np.where(is_good, -1, 1) * z) @ weight


def fit_ranking(good: np.ndarray, bad: np.ndarray, bad_share: float, pairs: int = PAIRS, l2: float = 1.0) -> Ranking:
    """The fit of ``train_ranking`` on arrays; constant score without both classes."""
    if not len(good) or not len(bad):
        return _constant(len(good) > 0)
    x = np.concatenate([good, bad])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    small, large = sorted([good, bad], key=len)
    turns = _turns(len(large), len(small), pairs)
    at = (np.arange(len(large))[:, None] + np.arange(turns)).ravel() % len(small)
    d = np.repeat(large, turns, axis=0) - small[at]
    d = (d if large is good else -d) / spread
    weights = _newton(lambda w: _newton_sums(d, w), l2) / spread
    raw = (x - mean) @ weights
    is_good = np.arange(len(x)) < len(good)
    weight = np.where(is_good, (1 - bad_share) / len(good), bad_share / len(bad))
    order = np.argsort(raw)
    below = int(np.searchsorted(np.cumsum(weight[order]), bad_share - 1e-9)) + 1
    below = min(below, len(x) - 1)
    threshold = (raw[order[below - 1]] + raw[order[below]]) / 2
    return Ranking(mean, weights, float(threshold), float(_SLOPES[_slope_sums(raw, is_good, weight, threshold).argmax()]))


def _with_features(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with the feature vector of the text in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(bytes(t.as_buffer())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("x", ArrayType(DoubleType())))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _summed(rows: DataFrame, part: Callable[..., np.ndarray]) -> np.ndarray:
    """``part`` of the columns of each batch, added up over the table; a task sends one vector of a few hundred numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            sums = part(*batch.columns)
            total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    return np.sum([r.v for r in rows.mapInArrow(run, "v array<double>").collect()], axis=0)


def _differences(placed: DataFrame, counts: dict[int, int]) -> DataFrame:
    """x: features of a good document less those of a bad one, for all pairs; bad ones are numbered from 0, good ones follow."""
    large, small = (1, 0) if counts[1] >= counts[0] else (0, 1)
    number = F.col("ordinal") - F.when(F.col("label") == 1, counts[0]).otherwise(0)
    partner = F.transform(F.sequence(F.lit(0), F.lit(_turns(counts[large], counts[small]) - 1)), lambda j: (number + j) % counts[small])
    rows = placed.where(F.col("label") == large).select("x", F.explode(partner).alias("partner"))
    others = placed.where(F.col("label") == small).select(number.alias("partner"), F.col("x").alias("y"))
    sign = 1 if large == 1 else -1
    pairs = rows.join(F.broadcast(others) if counts[small] <= FEW_ROWS else others, "partner")
    return pairs.select(F.zip_with("x", "y", lambda a, b: (a - b) * sign).alias("x"))


def _quantile_cut(scored: DataFrame, n: int, weights: dict[int, float], share: float) -> float:
    """Between the neighbouring values of ``raw`` where the rows from below reach the share by weight."""
    weight = F.count_if(F.col("label") == 0) * weights[0] + F.count_if(F.col("label") == 1) * weights[1]
    ran = cumulative(scored.groupBy("raw").agg(weight.alias("weight")), [], "raw", {"below": "weight"}, min(RANGES, 1 + n // 10_000))
    before, after = F.col("below") >= share - 1e-9, F.col("below") + F.col("weight") >= share - 1e-9
    low, high, second, top = ran.agg(
        F.min(F.when(after, F.col("raw"))), F.min(F.when(before & (F.col("below") > 0), F.col("raw"))), F.max(F.when(~after, F.col("raw"))), F.max("raw")
    ).first()
    low = top if low is None else low
    return (low + (high if high is not None else low if second is None else second)) / 2


def train_ranking(docs: DataFrame, labels: DataFrame, l2: float = 1.0) -> Ranking:
    """Fit on all labelled documents.

    ``labels`` has doc_id and label (1 good, 0 bad); rows without either are left out, and of repeated ids the
    smallest label counts.  Documents of a class are numbered in the order of a hash; each of the larger class
    makes ``_turns`` pairs, with consecutive ones of the smaller class, so every document is in a pair.  The
    share of bad labels is counted over all labels.  Only narrow rows (id, features) are moved.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").cast("long").alias("label"))
    told = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not told:
        return _constant(False)
    bad_share = told.get(0, 0) / sum(told.values())
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", whole_text().alias("text"))
    rows = checkpointed(_with_features(texts).join(known, "doc_id").select("doc_id", "label", "x"))
    order = [F.col("label"), F.xxhash64("doc_id"), F.col("doc_id"), F.col("x")]
    placed = checkpointed(with_ordinal(rows, order, rows_per_piece=PIECE).select("label", "x", "ordinal"))
    counts = {r[0]: r[1] for r in placed.groupBy("label").count().collect()}
    if len(counts) < 2:
        return _constant(1 in counts)
    n, width = sum(counts.values()), len(FEATURES)
    mean = _summed(placed.select("x"), lambda x: _matrix(x).sum(axis=0)) / n
    spread = np.sqrt(_summed(placed.select("x"), lambda x: ((_matrix(x) - mean) ** 2).sum(axis=0)) / n) + 1e-3
    mean, spread = np.round(mean, 12), np.round(spread, 12)
    pairs = checkpointed(_differences(placed, counts))
    weights = _newton(lambda w: _summed(pairs, lambda d: _newton_sums(_matrix(d) / spread, w)), l2) / spread

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.round((_matrix(batch.column(1)) - mean) @ weights, 12)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["label", "raw"])

    scored = checkpointed(placed.select("label", "x").mapInArrow(raw, "label long, raw double"))
    each = {0: bad_share / counts[0], 1: (1 - bad_share) / counts[1]}
    threshold = _quantile_cut(scored, n, each, bad_share)

    def likelihood(label: pa.Array, found: pa.Array) -> np.ndarray:
        is_good = label.to_numpy() == 1
        return _slope_sums(found.to_numpy(), is_good, np.where(is_good, each[1], each[0]), threshold)

    return Ranking(mean, weights, threshold, float(_SLOPES[_summed(scored, likelihood).argmax()]))


def with_quality(docs: DataFrame, model: Ranking, score: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 of the whole text (null counts as empty); a column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    kept = docs.drop(*[c for c in docs.columns if c.lower() in (score.lower(), "__text")])
    given = kept.withColumn("__text", whole_text())
    names = [*kept.columns, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            x = np.array([features(bytes(t.as_buffer())) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(model.score(x), pa.float64())], names=names)

    schema = kept.schema.add(score, "double")
    return given.mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows that may be learnt from: remainder of crc32 of the id modulo 5 not 0."""
    return labels.where(crc_mod5() != 0).select("doc_id", F.col("quality").alias("label"))
