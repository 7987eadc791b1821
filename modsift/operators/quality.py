"""Rule tables that decide which collected records are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsift import values as V
from modsift.operators.scale import top_n_per_key


def source_target_rules(
    df: DataFrame, kind: str, content: str, votes: str, order: str, targets: dict[str, tuple[int, int]] | None = None
) -> DataFrame:
    """Keep records that meet the target of their kind: length, votes, exclude words, count per kind."""
    targets = V.FORUM_TARGETS if targets is None else targets
    low, high = V.FORUM_TARGET_LENGTH
    clean = F.lit(True)
    for word in V.FORUM_TARGET_EXCLUDES:
        clean = clean & ~F.lower(content).contains(word)
    valid = df.where(F.length(content).between(low, high) & clean)
    if not targets:
        return top_n_per_key(valid.where(F.lit(False)), [kind], [F.asc(order)], 1)
    # One scan for all kinds: the largest count bounds the ranking, each kind's own count cuts it.
    enough, limit = F.lit(False), F.lit(0)
    for name, (max_count, min_votes) in targets.items():
        mine = F.col(kind) == name
        enough = enough | (mine & (F.coalesce(F.col(votes), F.lit(0)) >= min_votes if min_votes > 0 else F.lit(True)))
        limit = F.when(mine, max_count).otherwise(limit)
    ranked = top_n_per_key(valid.where(enough), [kind], [F.asc(order)], max(n for n, _ in targets.values()))
    return ranked.where(F.col("rank") <= limit)
