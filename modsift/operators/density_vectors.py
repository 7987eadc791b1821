"""Density clustering (DBSCAN rules) of vectors with any number of dimensions, exact.

A projection onto orthonormal directions never makes two points farther apart.  Points are projected onto the few directions
in which they spread most and put into cells as wide as eps, so neighbours lie in equal or adjacent cells.  Blocks of
points in the order of their cells are stored once, a row each, in some partitions.  Every two partitions meet in a task, which
reads both where they are stored, so that no vector is moved for the pairs; the distances of the points of two blocks
are taken in full dimension, as a matrix.  Tasks give counts of neighbours, then spanning links between core points,
never a list of pairs.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsift.operators.density import connected_components
from modsift.operators.scale import bounded_batches, stored

BLOCK = 2048
DIRECTIONS = 3
PARTITION_BYTES = 64 << 20  # of blocks that a task holds of its second partition
FAR = 2.0**62  # cells beyond it are one


def _matrix(column, kind: str) -> np.ndarray:
    return np.array([np.frombuffer(v, kind) for v in column.to_pylist()], float)


def _packed(kind: str):
    def run(batches):
        for batch in batches:
            rows = []
            for v in batch.column(1).to_pylist():
                x = np.array(v or (), float)  # null entries become NaN
                rows.append(x.astype(kind).tobytes() if len(x) and np.isfinite(x).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "v"])

    return run


def _moments(dims: int, kind: str):
    """Count, sums and products of all rows of a task."""

    def run(batches):
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.hstack([_matrix(batch.column(0), kind), np.ones((batch.num_rows, 1))])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["k", "v"])

    return run


def widest_directions(points: DataFrame, dims: int, k: int, kind: str = "<f8") -> np.ndarray:
    """Orthonormal directions (dims x k) of the largest variance; dims**2 numbers reach the driver."""
    found = points.select("v").mapInArrow(_moments(dims, kind), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    total = np.array([r.v for r in found]).reshape(dims + 1, dims + 1)
    n, mean = total[-1, -1], total[-1, :-1] / max(total[-1, -1], 1)
    covariance = total[:-1, :-1] / max(n, 1) - np.outer(mean, mean)
    return np.linalg.eigh(covariance)[1][:, ::-1][:, :k]


def close_pairs(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Matrix of whether the Euclidean distance is at most eps; distances near eps are taken again term by term."""
    limit = eps * eps
    of_a, of_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    squares = (-2 * a) @ b.T
    squares += of_a[:, None]
    squares += of_b[None, :]
    scale = 1e-9 * (limit + float(of_a.max(initial=0)) + float(of_b.max(initial=0)))
    out = squares <= limit
    for i, j in zip(*np.nonzero((squares <= limit + scale) & (squares >= limit - scale))):
        out[i, j] = ((a[i] - b[j]) ** 2).sum() <= limit
    return out


def _blocks(k: int, block: int):
    """point, v and k coordinates of a cell, ordered -> a row per ``block`` points: the bounds of its cells, ids and vectors.

    Rows with the same id stay together.
    """

    def made(rows):
        ids, vectors, *at = zip(*rows)
        bounds = {f"{name}{d}": pa.array([pick(x)], pa.int64()) for d, x in enumerate(at) for name, pick in (("lo", min), ("hi", max))}
        return pa.RecordBatch.from_pydict({"ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "v": pa.array([b"".join(vectors)], pa.binary())} | bounds)

    def run(batches):
        rows = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if len(rows) >= block and row[0] != rows[-1][0]:
                    yield made(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield made(rows)

    return run


def _pairs(batches, kind: str, dims: int):
    """The rows of pairs of blocks, with the blocks' vectors as matrices."""
    for batch in batches:
        for row in batch.to_pylist():
            row["v_a"], row["v_b"] = (np.frombuffer(row[c], kind).astype(float).reshape(-1, dims) for c in ("v_a", "v_b"))
            yield row


def _counts(eps: float, kind: str, dims: int):
    """Pairs of blocks -> per block the number of neighbours of its points in the blocks that it met here."""

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for r in _pairs(batches, kind, dims):
            near = close_pairs(r["v_a"], r["v_b"], eps)
            for block, n in ((r["block_a"], near.sum(axis=1)), (r["block_b"], near.sum(axis=0)))[: 1 if r["block_a"] == r["block_b"] else 2]:
                found[block] = found.get(block, 0) + n
        for block, n in found.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "n": pa.array([zstandard.compress(n.astype(np.int64).tobytes(), 1)], pa.binary())})

    return run


def _core(min_points: int):
    """A block's counts and ids -> a bit per point: whether it is a core point.  Rows with the same id count together."""

    def run(key, counts: pa.Table, block: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in counts.column("n").to_pylist())
        _, at = np.unique(np.frombuffer(block.column("ids")[0].as_py(), np.int64), return_inverse=True)
        core = np.bincount(at, n)[at] >= min_points
        return pa.table({"block": block.column("block"), "core": pa.array([np.packbits(core).tobytes()], pa.binary())})

    return run


def joined(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component of every row and of every column of a matrix of links between them, -1 for those without links."""
    turned = np.ascontiguousarray(linked.T)
    rows, cols = np.full(len(linked), -1), np.full(len(turned), -1)
    for i in np.flatnonzero(linked.any(axis=1)):
        if rows[i] < 0:
            front = np.array([i])
            while len(front):
                rows[front] = i
                met = np.flatnonzero(linked[front].any(axis=0) & (cols < 0))
                cols[met] = i
                front = np.flatnonzero(turned[met].any(axis=0) & (rows < 0)) if len(met) else met
    return rows, cols


def _of_labels(near: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a matrix put together by their labels; the labels."""
    names, first = np.unique(labels, return_index=True)
    if len(names) == len(labels):
        return near[first], names
    order = np.argsort(labels, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(labels[order]) != 0]))
    return np.logical_or.reduceat(near[order], starts, axis=0), names


def _links(eps: float, kind: str, dims: int):
    """Pairs of blocks -> packed pairs of ids: each core point with the smallest of its component here (weak is false),
    each other point with the core points that it touches, which are fewer than it takes to be one (weak is true)."""

    def rows(weak: bool, points: np.ndarray, cores: np.ndarray):
        for i in range(0, len(points), 1 << 18):
            data = np.concatenate([points[i : i + (1 << 18)], cores[i : i + (1 << 18)]]).astype(np.int64)
            planes = np.ascontiguousarray(data.view(np.uint8).reshape(-1, 8).T)
            yield pa.RecordBatch.from_pydict({"weak": pa.array([weak]), "pairs": pa.array([zstandard.compress(planes.tobytes(), 1)], pa.binary())})

    def run(batches):
        ids, label, start = np.empty(0, np.int64), np.empty(0, np.int64), {}  # of all points met here; a label is a place in them
        for r in _pairs(batches, kind, dims):
            sides = []
            for s in "ab":
                own = np.frombuffer(r[f"ids_{s}"], np.int64)
                if (block := r[f"block_{s}"]) not in start:
                    start[block] = len(ids)
                    label = np.concatenate([label, np.arange(len(ids), len(ids) + len(own))])
                    ids = np.concatenate([ids, own])
                core = np.unpackbits(np.frombuffer(r[f"core_{s}"], np.uint8), count=len(own)).astype(bool)
                sides.append((own, core, start[block] + np.flatnonzero(core)))
            (a, ca, at_a), (b, cb, at_b) = sides
            near = close_pairs(r["v_a"], r["v_b"], eps)
            few, of_a = _of_labels(near[np.ix_(ca, cb)], label[at_a])
            few, of_b = _of_labels(few.T, label[at_b])
            of_rows, of_cols = joined(few.T)
            # Labels of a component become one; a label may stand on both sides.
            links = {}
            for name, component in (*zip(of_a.tolist(), of_rows.tolist()), *zip(of_b.tolist(), of_cols.tolist())):
                if component >= 0:
                    links.setdefault(component, []).append(name)
            changed = merged(links.values())
            if changed:
                turn = np.arange(len(ids))
                turn[list(changed)] = list(changed.values())
                label = turn[label]
            for cores, others, names, those, among in ((cb, ~ca, a, b, near), (ca, ~cb, b, a, near.T))[: 1 if r["block_a"] == r["block_b"] else 2]:
                i, j = np.nonzero(among[np.ix_(others, cores)])
                if len(i):
                    yield from rows(True, names[others][i], those[cores][j])
        order = np.lexsort((ids, label))
        first = np.flatnonzero(np.diff(label[order], prepend=-1))
        least = np.repeat(ids[order][first], np.diff(np.append(first, len(order))))
        moved = least != ids[order]
        yield from rows(False, ids[order][moved], least[moved])

    return run


def merged(groups) -> dict[int, int]:
    """Member -> smallest of its chain of groups, for those that are not that themselves."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for group in groups:
        least = min(tops := {root(x) for x in group})
        parent.update(dict.fromkeys(tops, least))
    return {x: top for x in parent if (top := root(x)) != x}


def _unpacked(batches):
    for batch in batches:
        for data in batch.column(0).to_pylist():
            planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
            point, core = np.ascontiguousarray(planes.T).view(np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(core)], names=["point", "core"])


def _core_ids(batches):
    for batch in batches:
        for ids, core in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[np.unpackbits(np.frombuffer(core, np.uint8), count=len(ids)).astype(bool)])], names=["point"])


def dbscan_vectors(df: DataFrame, row_id: str, vector: str, eps: float, min_points: int, block: int = BLOCK, directions: int = DIRECTIONS, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(row id, is_core, cluster): cluster is the smallest id of the cluster's core rows, null for noise.

    Core rows have at least ``min_points`` rows (themselves too) within eps; core rows within eps of each other
    share a cluster; other rows within eps of a core row get the smallest cluster they touch.  Ids are whole numbers,
    unique and not null.  Vectors that are null or empty, with null or non-finite entries, or of another length than
    most, are noise.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    kind = "<f4" if df.schema[vector].dataType.elementType.typeName() == "float" else "<f8"  # floats are stored as floats
    raw = df.select(F.col(row_id).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    packed = raw.mapInArrow(_packed(kind), "id long, v binary")
    sizes = packed.where("v IS NOT NULL").groupBy(F.octet_length("v").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).first()
    out = df.select(row_id)
    if sizes is None:
        return out.select(row_id, F.lit(False).alias("is_core"), F.lit(None).cast("long").alias("cluster"))
    dims = sizes["bytes"] // int(kind[-1])
    points = packed.where(F.octet_length("v") == sizes["bytes"])
    k = min(directions, dims)
    axes = widest_directions(points, dims, k, kind)
    side = eps * (1 + 1e-9)
    cell = [f"c{d}" for d in range(k)]

    def placed(batches):
        for batch in batches:
            x = _matrix(batch.column(1), kind) if batch.num_rows else np.empty((0, dims))
            cells = np.clip(np.floor(x @ axes / side), -FAR, FAR).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in cells.T]], names=["point", "v", *cell])

    points = points.mapInArrow(placed, "point long, v binary, " + ", ".join(f"{c} long" for c in cell))
    # Every two partitions are a task: some for every core, and no more than their bytes ask for.
    parts = max(math.isqrt(8 * spark.sparkContext.defaultParallelism) + 1, -(-sizes["count"] * sizes["bytes"] // partition_bytes))
    order = [*cell, F.xxhash64("point"), "point"]  # a crowded cell is cut anywhere
    dealt = points.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = dealt.mapInArrow(_blocks(k, block), "ids binary, v binary, " + ", ".join(f"lo{d} long, hi{d} long" for d in range(k)))
    blocks = stored(blocks.withColumn("block", F.monotonically_increasing_id()))

    def met(rows: DataFrame, fn, schema: str) -> DataFrame:
        """``fn`` on the pairs of blocks that may hold equal or adjacent cells, each pair once."""
        a, b = (rows.select(*[F.col(c).alias(f"{c}_{s}") for c in rows.columns]) for s in "ab")
        near = [F.col(f"lo{d}_{x}") <= F.col(f"hi{d}_{y}") + 1 for d in range(k) for x, y in ("ab", "ba")]
        pairs = a.hint("shuffle_replicate_nl").join(b, reduce(and_, near, F.col("block_a") <= F.col("block_b")))
        return pairs.select(*[f"{c}_{s}" for c in rows.columns if c[:2] not in ("lo", "hi") for s in "ab"]).mapInArrow(fn, schema)

    counts = met(blocks.drop("ids"), _counts(eps, kind, dims), "block long, n binary")
    flags = counts.groupBy("block").cogroup(blocks.select("block", "ids").groupBy("block"))
    flags = stored(flags.applyInArrow(_core(min_points), "block long, core binary"))  # a bit per point
    judged = blocks.join(F.broadcast(flags), "block")
    links = stored(met(judged, _links(eps, kind, dims), "weak boolean, pairs binary"))
    cores = judged.select("ids", "core").mapInArrow(_core_ids, "point long")
    strong, weak = (links.where(F.col("weak") == w).select("pairs").mapInArrow(_unpacked, "point long, core long") for w in (False, True))
    # Every core point goes with the smallest that any task gave it; only those smallest ones are put together.
    least = stored(strong.groupBy("point").agg(F.min("core").alias("least")))
    edges = strong.join(least, "point").where("core <> least").select(F.col("least").alias("a"), F.col("core").alias("b"))
    edges = edges.union(least.join(strong.select(F.col("core").alias("point")).distinct(), "point", "left_semi").select("point", "least")).distinct()
    edges = stored(edges)
    groups = connected_components(edges, edges.select(F.col("a").alias("least")).union(edges.select("b")), "least")
    clusters = cores.join(least, "point", "left").withColumn("least", F.coalesce("least", "point")).join(groups, "least", "left")
    clusters = stored(clusters.select("point", F.coalesce("component", "least").alias("component")).distinct())
    border = weak.join(clusters.withColumnRenamed("point", "core"), "core").groupBy("point").agg(F.min("component").alias("component"))
    named = clusters.select("point", F.lit(True).alias("is_core"), "component").union(border.select("point", F.lit(False), "component"))
    return out.join(named, F.col(row_id) == F.col("point"), "left").select(row_id, F.coalesce("is_core", F.lit(False)).alias("is_core"), F.col("component").alias("cluster"))
