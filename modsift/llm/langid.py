"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's lower-cased letters give byte n-grams, which are hashed to rows of an embedding table; their
average goes through a linear softmax.  Table and weights are trained by stochastic gradient descent in
numpy on a bounded sample.  A temperature and a rejection level are set on held-back examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsift.llm.common import bounded_batches, crc_mod5

SAMPLE = 600  # documents per language in the training sample
LINES = 8  # single lines of a sampled document that are examples of their own, besides the whole text
BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
BLOCK = 1 << 19
UNDETERMINED = "und"

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of each order, a block of text at a time."""
    data = _KEEP[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    longest = max(ORDERS)
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK + longest - 1].astype(np.uint32)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] * np.uint32(0x01000193)) ^ (part[n - 1 :] + np.uint32(n << 8))
            last = at + BLOCK >= len(data)
            own = h if last else h[:BLOCK]
            mixed = (own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield (mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(BUCKETS, np.int64)
    for part in subwords(text):
        counts += np.bincount(part, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at] / counts[at].sum()


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logits: np.ndarray  # per bucket and language: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for part in subwords(text):
            total += np.bincount(part, minlength=BUCKETS) @ self.logits
            n += len(part)
        z = (total / max(n, 1) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def fit_languages(texts: list[str], langs: list[str], dim: int = 16, epochs: int = 6, rate: float = 8.0) -> LanguageModel:
    """Train on whole texts and some of their lines; every fifth document is held back for calibration."""
    names = sorted(set(langs))
    number = {k: i for i, k in enumerate(names)}
    train, held = [], []
    for i, (text, lang) in enumerate(zip(texts, langs)):
        lines = [x for x in text.split("\n") if len(x) > 20]
        pieces = [text, *lines[:: max(1, len(lines) // LINES)][:LINES]] if len(lines) > 1 else [text]
        (held if i % 5 == 4 else train).extend((p, number[lang]) for p in pieces)
    rng = np.random.default_rng(2)
    table = rng.normal(0, 0.1, (BUCKETS, dim))
    weights, bias = rng.normal(0, 0.3, (dim, len(names))), np.zeros(len(names))
    examples = [(*bucket_counts(t), y) for t, y in train]
    total = max(1, epochs * len(examples))
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at, share, y = examples[i]
            hidden = share @ table[at]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = rate * (1 - done / total)
            back = weights @ p
            weights -= 0.1 * step * np.outer(hidden, p)
            bias -= 0.01 * step * p
            table[at] -= step * share[:, None] * back
            done += 1
    model = LanguageModel(tuple(names), table @ weights, bias, 1.0, 0.0)
    if not held:
        return model
    z = np.log(np.array([model.probabilities(t) for t, _ in held]) + 1e-300)
    y = np.array([c for _, c in held])

    def loss(t: float) -> float:
        s = z / t
        return float((np.logaddexp.reduce(s, axis=1) - s[np.arange(len(y)), y]).mean())

    temperature = float(min(np.geomspace(0.2, 5, 40), key=loss))
    p = np.exp(z / temperature)
    p /= p.sum(axis=1, keepdims=True)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
    accepted = np.flatnonzero(wrong <= 0.01)  # the longest run of surest answers with at most 1 % errors
    reject = float(top[order[accepted[-1]]]) if len(accepted) else 1.0
    return LanguageModel(tuple(names), table @ weights, bias, temperature, reject)


def train_languages(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """Fit on at most ``sample`` documents per language, those of the smallest hash; None without any.

    ``docs`` has doc_id, text and lang; rows without text, letters or lang are left out.  Number of
    languages is bounded by what is learnt, not by rows.
    """
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    level = F.lit(0)
    for lang, n in counts.items():
        level = F.when(F.col("lang") == lang, F.lit(min(1 << 20, (1 << 21) * sample // n + 64))).otherwise(level)
    near = known.where(h <= level).select("lang", h.alias("h"), "doc_id", F.xxhash64("text").alias("t"))
    few = near.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "doc_id", "t"))), 1, sample).alias("x")).select("lang", F.inline("x"))
    rows = known.select("lang", "doc_id", F.xxhash64("text").alias("t"), "text").join(F.broadcast(few.drop("h").distinct()), ["lang", "doc_id", "t"]).orderBy("doc_id", "t").select("text", "lang").collect()
    rows = [r for r in rows if has_letter(r.text)]
    return fit_languages([r.text for r in rows], [r.lang for r in rows]) if rows else None


def with_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, text and further columns of ``docs`` plus lang_pred, score, rejected.

    Texts that are null or hold no letter get ``und`` with score 0; so do all texts without a model.
    ``rejected`` marks answers below the calibrated level.  Columns of those names are replaced.
    """
    bounded_batches(docs.sparkSession)
    new = ("lang_pred", "score", "rejected")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in (*new, "__text")])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers
    names = [*kept.columns, *new]

    def judge(text: str | None) -> tuple[str, float, bool]:
        found = shared.value
        if found is None or text is None or not has_letter(text):
            return UNDETERMINED, 0.0, True
        p = found.probabilities(text)
        best = int(p.argmax())
        return found.languages[best], float(p[best]), bool(p[best] < found.reject_below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            out = [judge(t.as_py()) for t in batch.column(at)]
            lang, score, rejected = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=names
            )

    schema = kept.schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return kept.withColumn("__text", F.col("text")).mapInArrow(run, schema)


def training_documents(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod5() != 0).select("doc_id", "text", "lang")
