"""Column functions that score or judge a record from its numbers and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modsift import values as V
from modsift.functions import text as T
from modsift.functions.text import as_col


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def stepped(value: Column | str, steps: list[tuple[float, float]]) -> Column:
    """Score of the first threshold reached, thresholds given from high to low."""
    value = as_col(value)
    first, *rest = steps
    out = F.when(value >= first[0], F.lit(first[1]))
    for bound, score in rest:
        out = out.when(value >= bound, F.lit(score))
    return out.otherwise(F.lit(0.0))


# --- lengths and ratios -----------------------------------------------------------
def reduction_ratio(original: Column | str, cleaned: Column | str) -> Column:
    original, cleaned = as_col(original), as_col(cleaned)
    before = T.utf16_length(original)
    return F.when(
        original.isNull() | cleaned.isNull() | (before == 0), F.lit(0.0)
    ).otherwise((before - T.utf16_length(cleaned)) / before)


def stop_word_ratio(tokens: Column | str, kept: Column | str) -> Column:
    total = F.size(as_col(tokens))
    return F.when(total > 0, 1.0 - F.size(as_col(kept)) / total).otherwise(F.lit(0.0))


# --- validity ------------------------------------------------------------------------
def forum_content_valid(content: Column | str, votes: Column | str) -> Column:
    content, votes = as_col(content), as_col(votes)
    lowered = F.lower(content)
    keep = T.utf16_length(content).between(50, 20000) & (votes.isNull() | (votes >= 5))
    for word in V.FORUM_EXCLUDES:
        keep = keep & ~lowered.contains(word)
    return F.coalesce(keep, F.lit(False))


def forum_record_valid(*fields: Column | str) -> Column:
    keep = F.lit(True)
    for field in fields:
        keep = keep & F.coalesce(T.trim_control(field) != "", F.lit(False))
    return keep


def processed_length_ok(cleaned: Column | str, low: int = 10, high: int = 10000) -> Column:
    return T.utf16_length(cleaned).between(low, high)


def training_sample_valid(q: Column | str, a: Column | str, quality: Column | str, upvotes: Column | str) -> Column:
    """Strict sample check: lengths, quality and votes all required."""
    keep = (
        T.utf16_length(q).between(10, 512)
        & T.utf16_length(a).between(50, 2000)
        & (as_col(quality) >= 0.7)
        & (as_col(upvotes) >= 5)
    )
    return F.coalesce(keep, F.lit(False))


def training_record_valid(q: Column | str, a: Column | str, quality: Column | str) -> Column:
    """Loose record check: a missing quality passes."""
    quality = as_col(quality)
    keep = (
        (T.trim_control(q) != "")
        & (T.trim_control(a) != "")
        & T.utf16_length(q).between(5, 1000)
        & T.utf16_length(a).between(20, 5000)
        & (quality.isNull() | quality.between(0, 1))
    )
    return F.coalesce(keep, F.lit(False))


# --- quality ----------------------------------------------------------------------------
def assess_readability(content: Column | str) -> Column:
    content = as_col(content)
    sentences = T.count_pieces(content, V.FULL_WIDTH_SENTENCE_CHARS, runs=False)
    marks = content.rlike(f"[{V.READABLE_PUNCTUATION}]")
    return F.when(sentences.between(3, 20), 0.1).otherwise(0.0) + F.when(marks, 0.1).otherwise(0.0)


def assess_quality(content: Column | str, votes: Column | str, comments: Column | str) -> Column:
    size = T.utf16_length(content)
    length_part = F.when(size.between(100, 2000), 0.3).when(size > 50, 0.15).otherwise(0.0)
    vote_part = stepped(votes, [(100, 0.3), (10, 0.2), (1, 0.1)])
    comment_part = stepped(comments, [(50, 0.2), (5, 0.1)])
    return F.least(F.lit(1.0), length_part + vote_part + comment_part + assess_readability(content))


def quality_label(score: Column | str, high: float = 0.8) -> Column:
    return F.when(as_col(score) >= high, 1).otherwise(0)


def label_from_tags(tags: Column | str) -> Column:
    return F.when(F.size(as_col(tags)) > 0, 1).otherwise(0)


def total_of(*counts: Column | str) -> Column:
    out = F.lit(0)
    for c in counts:
        out = out + F.coalesce(as_col(c), F.lit(0))
    return out


def raw_high_quality(content: Column | str, interactions: Column | str, votes: Column | str) -> Column:
    keep = (T.utf16_length(content) >= 100) & (
        (as_col(interactions) >= 10) | F.coalesce(as_col(votes) >= 5, F.lit(False))
    )
    return F.coalesce(keep, F.lit(False))


def training_high_quality(quality: Column | str, upvotes: Column | str, interactions: Column | str) -> Column:
    return (
        F.coalesce(as_col(quality) > 0.8, F.lit(False))
        | F.coalesce(as_col(upvotes) > 50, F.lit(False))
        | F.coalesce(as_col(interactions) > 100, F.lit(False))
    )


def training_complexity(
    length: Column | str, n_topics: Column | str, interactions: Column | str, quality: Column | str
) -> Column:
    length, interactions = as_col(length), as_col(interactions)
    size_part = F.when(length > 1000, 0.3).when(length > 500, 0.2).when(length > 200, 0.1).otherwise(0.0)
    topic_part = F.least(F.coalesce(as_col(n_topics), F.lit(0)) * F.lit(0.1), F.lit(0.3))
    talk_part = F.when(interactions > 100, 0.2).when(interactions > 50, 0.1).otherwise(0.0)
    quality_part = F.coalesce(as_col(quality) * 0.2, F.lit(0.0))
    return F.least(size_part + topic_part + talk_part + quality_part, F.lit(1.0))


# --- forum engagement ------------------------------------------------------------------------
def rate(count: Column | str, views: Column | str) -> Column:
    views = as_col(views)
    return F.when(views > 0, as_col(count) / views)


def high_engagement(interactions: Column | str, interaction_rate: Column | str) -> Column:
    return (as_col(interactions) >= 100) | F.coalesce(as_col(interaction_rate) >= 0.1, F.lit(False))


def has_multimedia(*counts: Column | str) -> Column:
    out = F.lit(False)
    for c in counts:
        out = out | F.coalesce(as_col(c) > 0, F.lit(False))
    return out


def forum_complexity(
    length: Column | str,
    paragraphs: Column | str,
    list_items: Column | str,
    quotes: Column | str,
    multimedia: Column | str,
    engaged: Column | str,
) -> Column:
    return F.least(
        F.lit(1.0),
        stepped(length, [(1000, 0.3), (500, 0.2), (200, 0.1)])
        + F.when(as_col(paragraphs) >= 3, 0.2).otherwise(0.0)
        + F.when(as_col(list_items) > 0, 0.1).otherwise(0.0)
        + F.when(as_col(quotes) > 0, 0.1).otherwise(0.0)
        + F.when(as_col(multimedia), 0.2).otherwise(0.0)
        + F.when(as_col(engaged), 0.1).otherwise(0.0),
    )


# --- progress -----------------------------------------------------------------------------------
def progress_percent(collected: Column | str, target: Column | str) -> Column:
    target = as_col(target)
    return F.when(target > 0, F.floor(as_col(collected) * 100 / target)).otherwise(F.lit(0)).cast("int")


def training_progress(
    epoch: Column | str, epochs: Column | str, batch: Column | str, batches: Column | str
) -> Column:
    epoch, epochs, batch, batches = map(as_col, (epoch, epochs, batch, batches))
    whole = epoch / epochs
    part = F.when(batches > 0, batch / batches / epochs).otherwise(F.lit(0.0))
    return F.coalesce(
        F.when(epochs > 0, F.least(F.lit(100.0), (whole + F.coalesce(part, F.lit(0.0))) * 100)), F.lit(0.0)
    )


def primary_metric(*candidates: Column | str) -> Column:
    """First metric present, in the order given; 0 when none is."""
    return F.coalesce(*[as_col(c) for c in candidates], F.lit(0.0))
