"""Density clustering (DBSCAN rules) on a grid, without forming all pairs.

Space is cut into cells whose diagonal is eps, so points sharing a cell are
neighbours by construction: a cell with min_points members needs no distance check
to make all of them core.  Distances are only computed for points of sparse cells
(fewer than min_points members each) against neighbouring cells, which is linear in
the number of points.  Two crowded cells are linked by comparing sub-cell boxes that
are refined until they decide, or until they are smaller than ``tolerance * eps``.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsift.operators.scale import HOT_KEYS
from modsift.session import ensure_checkpoint_dir


def _cell(columns: list[str], side: float) -> Column:
    return F.array(*[F.floor(F.col(c) / side).cast("long") for c in columns])


def _offsets(dims: int, side: float, eps: float) -> list[tuple[int, ...]]:
    """Cell offsets that can hold a point within eps."""
    reach = math.ceil(eps / side)
    out = []
    for off in itertools.product(range(-reach, reach + 1), repeat=dims):
        gap = sum((max(abs(o) - 1, 0) * side) ** 2 for o in off)
        if gap <= eps * eps * (1 + 1e-12) and any(off):
            out.append(off)
    return out


def _shifted(cell: Column, offsets: list[tuple[int, ...]]) -> Column:
    return F.array(*[F.array(*[(F.get(cell, F.lit(d)) + o) for d, o in enumerate(off)]) for off in offsets])


def connected_components(edges: DataFrame, nodes: DataFrame, node: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node of each component.

    Labels spread along edges and jump to their label's label, so rounds grow with the
    logarithm of path length.  Lineage is cut by a reliable checkpoint every round.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    both = edges.select(F.col("a").alias("s"), F.col("b").alias("d")).union(edges.select("b", "a")).distinct().checkpoint()
    labels = nodes.select(F.col(node).alias("n"), F.col(node).alias("c")).distinct().checkpoint()
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("n").alias("d"), "c"), "d").groupBy(F.col("s").alias("n")).agg(F.min("c").alias("m"))
        # Every label also tells its current owner about the smaller label found.
        found = labels.join(near, "n").select(F.col("c").alias("n"), F.col("m")).groupBy("n").agg(F.min("m").alias("m2"))
        spread = (
            labels.join(near, "n", "left").join(found, "n", "left")
            .select("n", "c", F.least("c", F.coalesce("m", "c"), F.coalesce("m2", "c")).alias("l"))
        )
        jump = spread.select(F.col("n").alias("l"), F.col("l").alias("ll"))
        after = spread.join(jump, "l", "left").select("n", F.col("c").alias("old"), F.least("l", F.coalesce("ll", "l")).alias("c")).checkpoint()
        changed = after.where(F.col("old") != F.col("c")).limit(1).count()
        labels = after.select("n", "c")
        if not changed:
            return labels.select(F.col("n").alias(node), F.col("c").alias("component"))
    raise RuntimeError("components did not settle; raise max_rounds")


def _crowded_links(points: DataFrame, columns: list[str], side: float, eps: float, offsets, tolerance: float) -> DataFrame:
    """Linked pairs among cells given by their core points, by refining bounding boxes."""
    half = [o for o in offsets if o > tuple([0] * len(columns))]
    depth = max(0, math.ceil(math.log2(max(side / (tolerance * eps), 1.0))))
    cells = points.select("cell").distinct()
    pairs = (
        cells.select(F.col("cell").alias("a"), F.explode(_shifted(F.col("cell"), half)).alias("b"))
        .join(cells.select(F.col("cell").alias("b")), "b")
        .select("a", "b")
    )
    open_pairs = pairs.select("a", "b", F.col("a").alias("sa"), F.col("b").alias("sb"))
    linked = None
    for level in range(depth + 1):
        scale = side / (1 << level)
        boxes = points.groupBy("cell", _cell(columns, scale).alias("sub")).agg(
            *[F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)],
            *[F.max(c).alias(f"hi{i}") for i, c in enumerate(columns)],
        )
        if level > 0:
            # Children of the boxes still undecided.
            parent = F.transform("sub", lambda x: F.floor(x / 2))
            kids = boxes.withColumn("parent", parent)
            open_pairs = (
                open_pairs.join(kids.select(F.col("cell").alias("a"), F.col("parent").alias("sa"), F.col("sub").alias("na")), ["a", "sa"])
                .join(kids.select(F.col("cell").alias("b"), F.col("parent").alias("sb"), F.col("sub").alias("nb")), ["b", "sb"])
                .select("a", "b", F.col("na").alias("sa"), F.col("nb").alias("sb"))
            )
        left = boxes.select(F.col("cell").alias("a"), F.col("sub").alias("sa"), *[F.col(f"{p}{i}").alias(f"a{p}{i}") for p in ("lo", "hi") for i in range(len(columns))])
        right = boxes.select(F.col("cell").alias("b"), F.col("sub").alias("sb"), *[F.col(f"{p}{i}").alias(f"b{p}{i}") for p in ("lo", "hi") for i in range(len(columns))])
        nearest, farthest = F.lit(0.0), F.lit(0.0)
        for i in range(len(columns)):
            gap = F.greatest(F.lit(0.0), F.col(f"alo{i}") - F.col(f"bhi{i}"), F.col(f"blo{i}") - F.col(f"ahi{i}"))
            span = F.greatest(F.col(f"ahi{i}") - F.col(f"blo{i}"), F.col(f"bhi{i}") - F.col(f"alo{i}"))
            nearest, farthest = nearest + gap * gap, farthest + span * span
        judged = open_pairs.join(left, ["a", "sa"]).join(right, ["b", "sb"]).select(
            "a", "b", "sa", "sb", (nearest <= eps * eps).alias("may"), (farthest <= eps * eps).alias("must")
        ).where("may").checkpoint()
        sure = judged.where("must") if level < depth else judged
        sure = sure.select("a", "b").distinct()
        linked = sure if linked is None else linked.union(sure)
        if level < depth:
            open_pairs = judged.join(sure, ["a", "b"], "left_anti").select("a", "b", "sa", "sb")
            if not open_pairs.limit(1).count():
                break
    return linked.distinct()


def dbscan(df: DataFrame, row_id: str, columns: list[str], eps: float = 0.5, min_points: int = 5, tolerance: float = 1e-3) -> DataFrame:
    """(row id, cluster): cluster is the smallest cell number of the cluster, -1 for noise; ``is_core`` flags core rows.

    For few dimensions (the neighbour cells grow as a power of them).  Exact, except
    that two crowded cells closer than (1 + tolerance) * eps may be linked.
    """
    ensure_checkpoint_dir(df.sparkSession)
    dims = len(columns)
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    offsets = _offsets(dims, side, eps)
    points = df.select(F.col(row_id).alias("id"), *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("cell", _cell(columns, side))
    sizes = points.groupBy("cell").agg(F.count("*").alias("n"))
    crowded_cells = sizes.where(F.col("n") >= min_points).select("cell")
    sparse_cells = sizes.where(F.col("n") < min_points)
    crowded = points.join(crowded_cells, "cell", "left_semi")
    sparse = points.join(sparse_cells, "cell")  # carries n, the neighbours inside its own cell

    # Sparse points against neighbouring cells.  Cells with more than total/HOT_KEYS points
    # are at most HOT_KEYS in number, so their list is safe to broadcast; their points are
    # cut into pieces of that size and the few sparse points near them are copied per piece.
    total = sizes.agg(F.sum("n").alias("t")).scalar()
    big = F.broadcast(
        sizes.where(F.col("n") * HOT_KEYS > total).select("cell", F.ceil(F.col("n") * HOT_KEYS / total).cast("int").alias("pieces"))
    )
    near = sparse.select(
        F.col("id").alias("p"), *[F.col(c).alias(f"p_{c}") for c in columns], F.explode(_shifted(F.col("cell"), offsets)).alias("cell"),
    ).join(big, "cell", "left")
    near = near.withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    others = points.join(big, "cell", "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"), F.lit(0))
    )
    distance = F.lit(0.0)
    for c in columns:
        distance = distance + (F.col(c) - F.col(f"p_{c}")) * (F.col(c) - F.col(f"p_{c}"))
    close = near.join(others, ["cell", "piece"]).where(distance <= eps * eps).select("p", F.col("id").alias("q"), F.col("cell").alias("q_cell"))
    close = close.checkpoint()
    counted = close.groupBy("p").agg(F.count("*").alias("k"))
    sparse_core = (
        sparse.join(counted, F.col("id") == F.col("p"), "left")
        .withColumn("core", F.col("n") + F.coalesce("k", F.lit(0)) >= min_points)
        .select("id", *columns, "cell", "core").checkpoint()
    )
    core_sparse = sparse_core.where("core")
    core_points = crowded.select("id", *columns, "cell").union(core_sparse.select("id", *columns, "cell"))
    core_cells = core_points.select("cell").distinct()

    # Cell links: through close pairs where a sparse core point takes part, by boxes among crowded cells.
    by_pairs = (
        close.join(core_sparse.select(F.col("id").alias("p"), F.col("cell").alias("a")), "p")
        .join(sparse_core.select(F.col("id").alias("q"), "core"), "q", "left")
        .where(F.coalesce("core", F.lit(True)))
        .select("a", F.col("q_cell").alias("b")).distinct()
    )
    edges = by_pairs.union(_crowded_links(crowded, columns, side, eps, offsets, tolerance))
    name = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    components = connected_components(
        edges.select(name("a").alias("a"), name("b").alias("b")), core_cells.select(name("cell").alias("cell")), "cell"
    )
    core_labels = core_points.select("id", name("cell").alias("cell")).join(components, "cell").select("id", F.col("component").alias("cluster"), F.lit(True).alias("is_core"))

    # Border points: the smallest cluster among core neighbours, own cell included.
    weak = sparse_core.where("NOT core").select("id", name("cell").alias("cell"))
    same_cell = weak.join(core_sparse.select(name("cell").alias("cell")).distinct(), "cell").join(components, "cell").select("id", "component")
    touching = (
        close.join(weak.select(F.col("id").alias("p")), "p", "left_semi")
        .join(sparse_core.select(F.col("id").alias("q"), "core"), "q", "left")
        .where(F.coalesce("core", F.lit(True)))
        .select(F.col("p").alias("id"), name("q_cell").alias("cell")).join(components, "cell").select("id", "component")
    )
    border = same_cell.union(touching).groupBy("id").agg(F.min("component").alias("cluster"))
    weak_labels = weak.select("id").join(border, "id", "left").select("id", F.coalesce("cluster", F.lit("-1")).alias("cluster"), F.lit(False).alias("is_core"))
    return core_labels.union(weak_labels).withColumnRenamed("id", row_id)
