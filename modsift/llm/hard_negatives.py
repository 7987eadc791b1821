"""Hard negatives of anchors by a vertical (dimension by dimension) scan of vectors.

Entries become whole numbers and a score is an exact inner product.  A block keeps its rows by column.  An anchor
reads the columns in descending order of its own magnitudes, a few at a time: the partial score of a row plus the
least and the most that the columns not yet read can add (from each column's minimum and maximum in the block)
bounds its score, and rows whose bounds miss what is sought leave the candidate bitmap.  What is left after the last
column has its exact score.

* Positives first: anchors meet only the rows of their own label, and the k-th best lower bound cuts the rest.
* Negatives: each positive score p opens the window [low * p, p]; rows that can reach no window leave.

Anchors and rows are dealt into blocks by a hash, and every block of anchors meets every block of rows in a group of
its own (for positives: of the same label).  A block gives at most k rows per anchor and window, so a label that
most rows share is only more blocks.  Every join is an equality on block numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modsift.llm.common import bounded_batches, checkpointed, written
from modsift.llm.vectors import common_length, finite_vectors, floored

SCALE = 256
ROWS_PER_BLOCK = 4096
ANCHORS_PER_BLOCK = 4096
STEP = 8  # columns read between two looks at the bitmap
FOUND_COLUMNS = "a long, p long, other long, other_id long, score long"
FOUND = pa.schema([(c, pa.int64()) for c in ("a", "p", "other", "other_id", "score")])


def most_entry(length: int) -> int:
    """Entries are held inside +- this, so that no inner product of two vectors leaves 2**62."""
    return int(((1 << 62) // max(length, 1)) ** 0.5) - 1


def _whole(length: int):
    """vec_id, label, is_anchor, vector -> the same with whole numbers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, matrix = finite_vectors(batch.column(3), length)
            packed = [r.tobytes() for r in floored(matrix, SCALE, most_entry(length)).astype("<i8")]
            kept = [batch.column(i).take(pa.array(places)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(packed, pa.binary())], names=["vec_id", "label", "is_anchor", "v"])

    return run


class Block:
    """Rows of a block by column, with the least and the greatest entry of every column."""

    def __init__(self, matrix: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray | None):
        order = np.lexsort((rows, ids))  # places then order like the ids that break ties
        self.rows, self.ids = rows[order], ids[order]
        self.labels = None if labels is None else labels[order]
        self.columns = np.ascontiguousarray(matrix[order].T)
        self.least, self.greatest = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, misses, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the rows of ``alive`` that ``misses(lower, upper)`` never rules out."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.least, anchor * self.greatest])[:, order]
        below = np.concatenate([np.cumsum(ends.min(axis=0)[::-1])[::-1], [0]])  # what columns from here on add at least
        above = np.concatenate([np.cumsum(ends.max(axis=0)[::-1])[::-1], [0]])
        partial = np.zeros(len(alive), np.int64)
        for at in range(0, len(order), step):
            read = order[at : at + step]
            whole = len(alive) == self.columns.shape[1]
            for d in read:
                partial += anchor[d] * (self.columns[d] if whole else self.columns[d][alive])
            end = at + len(read)
            out = misses(partial + below[end], partial + above[end])
            if out.any():
                alive, partial = alive[~out], partial[~out]
            if not len(alive):
                break
        return alive, partial


def _best(places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties by place."""
    return np.lexsort((places, -scores))[:k]


def best_positives(block: Block, anchors: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple]:
    for anchor, row in zip(anchors, rows.tolist()):
        alive = np.flatnonzero(block.rows != row)

        def misses(lower, upper):
            if len(lower) <= k:
                return np.zeros(len(lower), bool)
            return upper < np.partition(lower, len(lower) - k)[len(lower) - k]

        alive, scores = block.scan(anchor, alive, misses)
        for i in _best(alive, scores, k):
            yield row, 0, int(block.rows[alive[i]]), int(block.ids[alive[i]]), int(scores[i])


def window_of(positive: int, low: int, base: int) -> int:
    """The least whole score s with low * positive <= base * s."""
    return -((-low * positive) // base)


def best_negatives(block: Block, anchors: np.ndarray, rows: np.ndarray, labels: np.ndarray, positives: list[list[int]], k: int, low: int, base: int) -> Iterator[tuple]:
    for anchor, row, label, scores_of in zip(anchors, rows.tolist(), labels.tolist(), positives):
        windows = [(window_of(p, low, base), p) for p in sorted(set(scores_of)) if p >= 0]  # below zero no score fits
        if not windows:
            continue
        floor, top = min(a for a, _ in windows), max(p for _, p in windows)
        alive, scores = block.scan(anchor, np.flatnonzero(block.labels != label), lambda lower, upper: (upper < floor) | (lower > top))
        for least, p in windows:
            inside = np.flatnonzero((scores >= least) & (scores <= p))
            for i in inside[_best(alive[inside], scores[inside], k)]:
                yield row, p, int(block.rows[alive[i]]), int(block.ids[alive[i]]), int(scores[i])


def _matrix(table: pa.Table, name: str, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), "<i8").reshape(-1, length).astype(np.int64)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _found(rows: Iterator[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(FOUND)
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)


def _parts(count: Column, per_block: int) -> Column:
    return F.ceil(count / per_block).cast("long")


def _dealt(name: str, parts: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(name), F.lit(seed)), parts)


def _each(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, base: int = 100,
    rows_per_block: int = ROWS_PER_BLOCK, anchors_per_block: int = ANCHORS_PER_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (see the module).

    ``rows`` has vec_id (whole number), label (whole number) and embedding.  An anchor's positives are its best
    ``positives`` other rows of the same label, higher scores first, ties by smaller vec_id; for each of them the
    best ``negatives`` rows of other labels with low * positive_score <= base * negative_score <= base *
    positive_score are returned (all, if fewer).  Rows with a null id, label or vector, with null or non-finite entries
    or with another length than most vectors take no part; entries beyond +-2**20 or so are held there
    (``most_entry``).  Rows that repeat an id are rows of their own, so a copy of an anchor is one of its other rows.
    An empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    length = common_length(rows, "embedding")
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    narrow = known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), "embedding")
    packed = narrow.mapInArrow(_whole(length), "vec_id long, label long, is_anchor boolean, v binary")
    # Writing fixes the row numbers.
    data = written(packed.withColumn("row", F.monotonically_increasing_id()), "whole-vectors")

    counts = checkpointed(data.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("is_anchor").cast("long")).alias("n_anchors")))
    wanted = counts.where("n_anchors > 0").select("label", _parts(F.col("n"), rows_per_block).alias("row_parts"), _parts(F.col("n_anchors"), anchors_per_block).alias("anchor_parts"))
    sized = data.join(wanted, "label")
    cell = ["label", "row_part", "anchor_part"]
    row_side = sized.select("label", "row", "vec_id", "v", _dealt("row", F.col("row_parts"), 1).alias("row_part"), _each(F.col("anchor_parts")).alias("anchor_part"))
    renamed = [F.col("row").alias("anchor"), F.col("label").alias("anchor_label"), F.col("v").alias("anchor_v")]
    anchor_side = sized.where("is_anchor").select(*renamed, _each(F.col("row_parts")).alias("to_row_part"), _dealt("row", F.col("anchor_parts"), 2).alias("own_part"))
    anchor_cell = ["anchor_label", "to_row_part", "own_part"]

    def meet_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return FOUND.empty_table()
        block = Block(_matrix(right, "v", length), _numbers(right, "row"), _numbers(right, "vec_id"), None)
        return _found(best_positives(block, _matrix(left, "anchor_v", length), _numbers(left, "anchor"), positives))

    near = anchor_side.groupBy(*anchor_cell).cogroup(row_side.groupBy(*cell)).applyInArrow(meet_positives, FOUND_COLUMNS)
    order = Window.partitionBy("a").orderBy(F.desc("score"), "other_id", "other")
    chosen = checkpointed(near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives).select("a", "other_id", "score", "r"))

    sought = chosen.where("score >= 0").groupBy("a").agg(F.collect_set("score").alias("scores"))  # at most ``positives`` numbers
    anchors = checkpointed(data.where("is_anchor").select(*renamed).join(sought.withColumnRenamed("a", "anchor"), "anchor"))
    n, n_anchors = counts.agg(F.sum("n")).first()[0] or 0, anchors.count()
    row_parts, anchor_parts = F.lit(max(1, -(-n // rows_per_block))), F.lit(max(1, -(-n_anchors // anchors_per_block)))
    cell = ["row_part", "anchor_part"]
    row_side = data.select("row", "vec_id", "label", "v", _dealt("row", row_parts, 3).alias("row_part"), _each(anchor_parts).alias("anchor_part"))
    anchor_side = anchors.select(*anchors.columns, _each(row_parts).alias("to_row_part"), _dealt("anchor", anchor_parts, 4).alias("own_part"))

    def meet_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return FOUND.empty_table()
        block = Block(_matrix(right, "v", length), _numbers(right, "row"), _numbers(right, "vec_id"), _numbers(right, "label"))
        anchors_of = _matrix(left, "anchor_v", length), _numbers(left, "anchor"), _numbers(left, "anchor_label"), left.column("scores").to_pylist()
        return _found(best_negatives(block, *anchors_of, negatives, low, base))

    hard = anchor_side.groupBy("to_row_part", "own_part").cogroup(row_side.groupBy(*cell)).applyInArrow(meet_negatives, FOUND_COLUMNS)
    order = Window.partitionBy("a", "p").orderBy(F.desc("score"), "other_id", "other")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = data.where("is_anchor").select(F.col("row").alias("a"), F.col("vec_id").alias("anchor_id"))
    listed = chosen.select("a", F.col("score").alias("p"), F.col("other_id").alias("positive_id")).join(names, "a")
    return listed.join(hard, ["a", "p"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
        F.col("p").alias("positive_score"), F.col("score").alias("negative_score"),
    )
