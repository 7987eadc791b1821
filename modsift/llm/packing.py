"""Packing documents into fixed windows by minimum bin slack.

A document longer than a window gives whole windows and one remainder.  Remainders enter the packing
only through the number of pieces of each length, at most ``capacity`` numbers.  Each window takes the
longest length left and then, by a bitset subset-sum over the lengths left, the multiset that fills
the rest closest to capacity; backtracking gives how often each length is used, and the window is
repeated while the counts last.  Every round uses up a length, so the plan has at most one pattern per
length.  A length of which no multiset fills a window goes, with all its pieces left, into one run: the pieces of
all runs lie end to end and are cut freely at the windows' borders, the last part into powers of two, so that nothing is
padded.  Plan and runs have a row per length or pattern, however many pieces there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modsift.llm.common import bounded_batches, checkpointed, whole_text, written
from modsift.llm.tokens import tokenizer

CAPACITY = 2048
PIECE_COLUMNS = "doc_id long, start long, length long, doc_tokens long, ids binary"
PLAN_COLUMNS = "length long, rank_from long, rank_to long, run boolean, sequence long, per_window long, base long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pieces of every document: ids as little-endian uint16, at most ``capacity`` of them, the end id last."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(path).ids, end_id.to_bytes(2, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                n = len(ids) // 2
                rows += [(doc_id, s, min(capacity, n - s), n, ids[2 * s : 2 * (s + capacity)]) for s in range(0, n, capacity)]
                if len(rows) >= 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(run, PIECE_COLUMNS)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``room``: subset sums as bits, longest length first.

    ``reach[k]`` holds the sums that the first k items can make; a length that may be used up to c times is
    cut into items of 1, 2, 4, ... copies, so that all multiplicities are covered.
    """
    items, reach, full = [], [1], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, copies = min(counts[length], room // length), 1
        while left:
            take = min(copies, left)
            items.append((length, take))
            reach.append((reach[-1] | reach[-1] << (length * take)) & full)
            left, copies = left - take, copies * 2
        if reach[-1] >> room & 1:
            break
    at, used = reach[-1].bit_length() - 1, {}
    for (length, take), before in zip(reversed(items), reversed(reach[:-1])):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int, int]:
    """Rows of PLAN_COLUMNS, the number of windows filled by patterns, and the length of all runs together.

    Pattern: the pieces rank_from <= rank < rank_to of a length go to window sequence + (rank - rank_from) // per_window,
    at base + length * ((rank - rank_from) % per_window).  Run: they lie end to end from ``base`` on.
    """
    counts = {k: n for k, n in counts.items() if n}
    used: dict[int, int] = dict.fromkeys(counts, 0)
    plan, sequence, laid = [], 0, 0
    while counts:
        longest = max(counts)
        window = {longest: 1}
        counts[longest] -= 1
        for length, n in best_fill({k: n for k, n in counts.items() if n}, capacity - longest).items():
            window[length] = window.get(length, 0) + n
        counts[longest] += 1
        if sum(k * n for k, n in window.items()) == capacity:
            times, base = min(counts[k] // n for k, n in window.items()), 0
            for length, n in sorted(window.items(), reverse=True):
                plan.append((length, used[length], used[length] + n * times, False, sequence, n, base))
                base += n * length
            sequence += times
        else:  # fewer pieces will not fill it later either: all of this length go into a run
            times, window = counts[longest], {longest: 1}
            plan.append((longest, used[longest], used[longest] + times, True, 0, 1, laid))
            laid += longest * times
        for length, n in window.items():
            used[length] += n * times
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
    return plan, sequence, laid


def run_borders(laid: int, capacity: int = CAPACITY) -> list[int]:
    """Where the last windows of the runs begin: what is left after whole windows, in powers of two."""
    at, borders = laid - laid % capacity, []
    while at < laid:
        borders.append(at)
        at += 1 << (laid - at).bit_length() - 1
    return borders


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_task: int = 20_000) -> DataFrame:
    """Placed pieces: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``pieces`` is a stored table (it is read twice).  Ranks inside a length are counted by hash bucket
    first, so a length that most pieces share is not one task.  An empty table gives no rows.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    # Every length has as many buckets as its pieces need.
    buckets = spark.createDataFrame([(k, max(1, n // rows_per_task)) for k, n in histogram.items()], "length long, buckets long")
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.col("buckets"))
    pieces = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", bucket)
    sizes = checkpointed(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    rows, filled, laid = plan_windows(histogram, capacity)
    plan = spark.createDataFrame(rows, PLAN_COLUMNS)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", F.xxhash64("ids"))  # ids may repeat with other texts
    rows = pieces.select("doc_id", "start", "length", "doc_tokens", "ids", "bucket")
    ranked = rows.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("r"))
    # The plan has a row per length of a pattern: bounded by the capacity, whatever the data.
    p, q = ranked.alias("p"), F.broadcast(plan).alias("q")
    met = p.join(q, (F.col("p.length") == F.col("q.length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    step = F.col("rank") - F.col("rank_from")
    length = F.col("p.length")
    at = F.when(F.col("run"), F.col("base") + step * length)  # place in the runs
    first, tail = laid // capacity, run_borders(laid, capacity)
    # Where a piece of a run is cut: at a border of whole windows (one at most) and at those of the last ones.
    borders = F.array((F.floor(at / capacity) + 1) * capacity, *[F.lit(x).cast("long") for x in tail])
    cuts = F.array_sort(F.array_distinct(F.filter(borders, lambda x: (x > at) & (x < at + length))))
    ends = F.concat(cuts, F.array(at + length))
    parts = F.transform(ends, lambda end, i: F.struct(F.coalesce(F.get(cuts, i - 1), at).alias("a"), end.alias("b")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), length.alias("b")))
    part = F.explode(F.when(F.col("run"), parts).otherwise(whole)).alias("part")
    met = met.select("doc_id", "start", length.alias("piece"), "ids", "doc_tokens", "run", step.alias("step"), "sequence", "per_window", "base", at.alias("at"), part)
    a = F.col("part.a")
    begun = F.lit(0)  # last windows that begin at or before the part
    begin = F.floor(a / capacity) * capacity
    for x in tail:
        begun = begun + (a >= x).cast("int")
        begin = F.when(a >= x, F.lit(x).cast("long")).otherwise(begin)
    window = F.when(begun > 0, first + begun - 1).otherwise(F.floor(a / capacity))
    from_piece = F.when(F.col("run"), a - F.col("at")).otherwise(a)
    size = F.col("part.b") - a
    return met.select(
        "doc_id",
        (F.col("start") + from_piece).alias("start"),
        size.alias("length"),
        F.substring("ids", (2 * from_piece + 1).cast("int"), (2 * size).cast("int")).alias("ids"),
        "doc_tokens",
        F.when(F.col("run"), filled + window).otherwise(F.col("sequence") + F.floor(F.col("step") / F.col("per_window"))).cast("long").alias("sequence_id"),
        F.when(F.col("run"), a - begin).otherwise(F.col("base") + F.col("piece") * (F.col("step") % F.col("per_window"))).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """All documents in windows of ``capacity`` tokens; a null text is empty (its only id is the end id)."""
    return pack(written(token_pieces(docs, path, capacity, end_id), "pieces"), capacity)


def with_ids_crc32(placed: DataFrame) -> DataFrame:
    """Replace ids by ids_crc32, over the ids as little-endian unsigned 32-bit numbers."""
    names = [f"{c} {t}" for c, t in placed.dtypes if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), "<u2").astype("<u4")) for x in batch.column(at)]
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(crc, pa.int64())], names=[*[batch.schema.names[i] for i in kept], "ids_crc32"]
            )

    return placed.mapInArrow(run, ", ".join([*names, "ids_crc32 long"]))
