"""Mixing sources to target weights: repetition rates, whole copies and one seeded Bernoulli copy.

A document is taken floor(rate) times, and once more if its draw, a hash of the seed and its id, falls below the
fraction.  Few long documents can carry a source far from its target, so every source turns all its draws by
one of OFFSETS equal steps (each draw stays uniform): the one whose extra words come nearest to what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsift.llm.common import checkpointed, free_name, join_small_or_hot, with_ordinal

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
BITS = 52
OFFSETS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A whole number below 2**52: the first bits of md5(seed || key); the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def extra_copy(drawn: Column, offset: Column | int, fraction: Column) -> Column:
    """Whether the draw, turned by the offset, falls below the fraction."""
    turned = (drawn + (F.lit(offset) if isinstance(offset, int) else offset) * ((1 << BITS) // OFFSETS)) % (1 << BITS)
    return turned.cast("double") < fraction * float(1 << BITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size, source_docs).

    Sources in code point order, null last, weigh ``weights`` in turn and share the whole size; none
    takes more than ``cap`` times its own, and what is cut off is shared again by weight.  A source is
    at its cap once the common level (remaining size / remaining weight) reaches it; each round settles
    the sources at or below the level, which only rises, so the rounds end.  A round is one sum over
    the source table.
    """
    ranked = with_ordinal(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = checkpointed(ranked.withColumn("weight", weight.cast("long")))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    first = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level = first[0] or 0, (first[0] or 0, first[1] or 1)
    while True:
        capped = big("source_size") * F.lit(cap * level[1]).cast("decimal(19,0)") <= big("weight") * F.lit(level[0]).cast("decimal(19,0)")
        taken, free = ranked.agg(
            F.sum(F.when(capped, F.col("source_size") * cap).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))
        ).first()
        new = (total - (taken or 0), free or 1)
        if new == level or not free:
            break
        level = new
    target = F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(
        F.col("weight") * (F.lit(float(level[0])) / F.lit(float(level[1])))
    )
    return ranked.select("source", "source_size", "source_docs", target.alias("target"))


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies (columns of those names are replaced).

    rate = target / source_size.  Null texts have size 0; an empty source has rate 0; null sources are one
    source.  Rows that repeat an id draw alike.
    """
    new = ["size", "source_size", "target", "rate", "copies", "offset"]
    facts = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    key = free_name("__key", facts.columns)
    keyed = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    facts = facts.withColumn("size", word_count(F.col("text"))).withColumn(key, keyed)
    sizes = docs.select("source", word_count(F.col("text")).alias("__size")).groupBy("source").agg(
        F.sum("__size").alias("source_size"), F.count("*").alias("source_docs")
    )
    targets = checkpointed(source_targets(sizes, weights, cap).select(keyed.alias(key), "source_size", "source_docs", "target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    fraction = F.col("rate") - F.floor("rate")
    drawn = draw(F.col("doc_id"), seed)

    # One pass over (source, size, draw): the extra words of each source under every offset.
    narrow = docs.select(keyed.alias(key), word_count(F.col("text")).alias("size"), drawn.alias("drawn"))
    trial = join_small_or_hot(narrow, targets, key, "source_docs").withColumn("rate", rate)
    sums = [F.sum(F.when(extra_copy(F.col("drawn"), k, fraction), F.col("size")).otherwise(0)) for k in range(OFFSETS)]
    extras = trial.groupBy(key).agg(F.array(*sums).alias("extras"))
    missing = F.col("target") - F.floor("rate") * F.col("source_size")
    nearest = F.array_min(F.transform("extras", lambda words, k: F.struct(F.abs(words - F.col("missing")), k.alias("offset"))))
    turned = targets.withColumn("rate", rate).withColumn("missing", missing).join(extras, key).withColumn("offset", nearest["offset"])
    targets = checkpointed(turned.select(key, "source_size", "source_docs", "target", "rate", "offset"))

    joined = join_small_or_hot(facts, targets, key, "source_docs").drop(key, "source_docs")
    copies = F.floor("rate") + extra_copy(drawn, F.col("offset"), fraction).cast("int")
    return joined.withColumn("copies", copies.cast("int")).drop("offset")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as many times as it is taken, in the columns of ``docs``."""
    kept = {c: free_name(f"__in_{i}", docs.columns) for i, c in enumerate(docs.columns) if c.lower() in ("size", "source_size", "target", "rate", "copies", "offset")}
    renamed = docs.withColumnsRenamed(kept)
    plan = mixing_plan(renamed, weights, cap, seed).where(F.col("copies") > 0)
    many = plan.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return many.select(*[F.col(f"`{kept.get(c, c)}`").alias(c) for c in docs.columns])
