"""Near-duplicate documents by ProbMinHash.

The shingles of a document arrive in Poisson processes whose rates are the weights; each arrival picks one
of m registers, which keeps its earliest arrival.  A shingle stops as soon as its next arrival is later than
every register's.  Two documents agree in a register with the probability Jaccard similarity of their
weighted shingles.  The link is the plain Jaccard similarity of shingle sets, so every distinct shingle has
weight 1 here, however often it occurs: then both similarities are nearly the same.  Bands of registers
find candidates, families of candidates are verified exactly, and links become classes.

* Equal shingle sets are one representative first, so copies never meet pairwise.  A representative is a set, not an
  id: ids that stand on several texts are as many members.
* Members of a bucket meet through its smallest id; families are the components of these links.  A member is linked
  to the smallest of its buckets' ids only, and that one to the others, which members alike share.
* A family is verified in one task if it has at most ``block`` members; larger ones are cut into blocks
  that also hold the family's most central members, and what these leave apart is compared in blocks.
  Pairs already joined through others are skipped; no pair list is ever emitted, only links that join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modsift.llm.common import bounded_batches, checkpointed, free_name, whole_text, written
from modsift.llm.shingles import WORDS, mix, shingle_hashes
from modsift.operators.density import connected_components

BANDS, ROWS = 40, 8  # at a similarity of 0.8 a pair meets in some band with probability 0.9993
SIMILARITY = 0.8
BLOCK = 4096  # members of a family that are verified at once, if they have at most SHINGLES each on average
SHINGLES = 1000
PIVOTS = 32


def distinct_shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def prob_minhash(values: np.ndarray, weights: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Signatures (documents x m) of documents whose shingles are values[offsets[i]:offsets[i + 1]].

    Each entry is the scrambled hash of the shingle that arrived first in that register.
    """
    n_docs = len(offsets) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    earliest = np.full(n_docs * m, np.inf)
    winner = np.zeros(n_docs * m, np.uint64)
    time, values, rate = np.zeros(len(values)), values.astype(np.uint64), weights.astype(float)
    latest = np.full(n_docs, np.inf)
    step = 0
    while len(values):
        draw = mix(values, 2 * step + 1)
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / rate
        live = time < latest[doc]
        time, values, rate, doc = time[live], values[live], rate[live], doc[live]
        slot = doc * m + (mix(values, 2 * step + 2) % np.uint64(m)).astype(np.int64)
        order = np.argsort(time)
        slots, first = np.unique(slot[order], return_index=True)  # the earliest of each register
        when, what = time[order][first], values[order][first]
        better = when < earliest[slots]
        earliest[slots[better]], winner[slots[better]] = when[better], what[better]
        docs = np.unique(doc)
        latest[docs] = earliest.reshape(n_docs, m)[docs].max(axis=1)
        live = time < latest[doc]
        time, values, rate, doc = time[live], values[live], rate[live], doc[live]
        step += 1
    return mix(winner, 3).reshape(n_docs, m)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    h = np.zeros(parts.shape[:2], np.uint64)
    for i in range(rows):
        h = mix(h ^ parts[:, :, i], i)
    return h.astype(np.int64)


def _sketch(words: int, bands: int, rows: int):
    names = ["doc_id", "h", "key_a", "key_b", "n_shingles", "bands"]

    def flush(ids, marks, sets):
        filled = [i for i, v in enumerate(sets) if len(v)]
        hashes = [None] * len(ids)
        if filled:
            values = np.concatenate([sets[i] for i in filled])
            offsets = np.concatenate([[0], np.cumsum([len(sets[i]) for i in filled])])
            for i, row in zip(filled, band_hashes(prob_minhash(values, np.ones(len(values)), offsets, bands * rows), bands, rows)):
                hashes[i] = row
        keys = [[int(mix(mix(v, k), k).sum(dtype=np.uint64).astype(np.int64)) if len(v) else None for v in sets] for k in (5, 6)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), *[pa.array(k, pa.int64()) for k in keys], pa.array([len(v) for v in sets], pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, sets, size = [], [], [], 0
        for batch in batches:
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids.append(doc_id)
                marks.append(mark)
                sets.append(distinct_shingles(bytes(text.as_buffer()), words))
                size += len(sets[-1]) + 200
                if size > 400_000:
                    yield flush(ids, marks, sets)
                    ids, marks, sets, size = [], [], [], 0
        if ids:
            yield flush(ids, marks, sets)

    return run


class _Sets:
    """Shingle sets of one task: dense numbers in one array, members by offset."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(self.flat.max() + 1, bool)
        popular = np.bincount(self.flat)
        self.central = np.add.reduceat(popular[self.flat], self.starts) / self.sizes

    def similar(self, i: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Those of ``others`` whose Jaccard similarity to member i reaches the threshold."""
        small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
        others = others[small >= threshold * large - 1e-9]
        if not len(others):
            return others
        own = self.flat[self.starts[i] : self.starts[i] + self.sizes[i]]
        self.mark[own] = True
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[others] - (ends - sizes), sizes)
        common = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), ends - sizes)
        self.mark[own] = False
        return others[common >= threshold * (sizes + self.sizes[i] - common) - 1e-9]


def joining_links(sets: list[np.ndarray], threshold: float, label: np.ndarray | None = None, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join everything similar, found without a list of pairs.

    ``label``: members that are joined already share a number.  ``left``: if given, only pairs of one
    member in it and one outside are looked at.  Central members go first, since they join the most at
    once; a member is compared only with those that are not yet joined to it.
    """
    data, links = _Sets(sets), []
    label = np.arange(len(sets)) if label is None else label.copy()
    order = np.argsort(-data.central, kind="stable")
    todo = np.ones(len(sets), bool)
    for i in order if left is None else order[left[order]]:
        todo[i] = False
        others = np.flatnonzero((label != label[i]) & (todo if left is None else ~left))
        for j in data.similar(i, others, threshold) if len(others) else ():
            if label[j] != label[i]:
                links.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return links


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[int, ...]):
    """Rows of a sorted partition, one group (equal values in the columns ``by``) after another."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            new = tuple(row[i] for i in by)
            if new != key and rows:
                yield key, rows
                rows = []
            key = new
            rows.append(row)
    if rows:
        yield key, rows


def _unpack(rows: list[tuple], at: int) -> list[np.ndarray]:
    return [np.frombuffer(r[at], np.uint64) for r in rows]


def _link_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verify(threshold: float):
    """Input: fam, part, rep, shingles, sorted by (fam, part); a central member may be in many parts."""

    def run(batches):
        for _, rows in _groups(batches, (0, 1)):
            rows = list({r[2]: r for r in rows}.values())
            pairs = joining_links(_unpack(rows, 3), threshold)
            if pairs:
                yield _link_batch([(rows[i][2], rows[j][2]) for i, j in pairs])

    return run


def _verify_across(threshold: float):
    """Input: fam, part, chunk, away, rep, label, shingles, sorted by (fam, part, chunk)."""

    def run(batches):
        for _, rows in _groups(batches, (0, 1, 2)):
            left = np.array([r[3] for r in rows], bool)
            if left.any() and not left.all():
                label = np.unique([r[5] for r in rows], return_inverse=True)[1]
                pairs = joining_links(_unpack(rows, 6), threshold, label, left)
                if pairs:
                    yield _link_batch([(rows[i][4], rows[j][4]) for i, j in pairs])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, text: the first two tell rows apart, but for those that repeat both."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("h"), whole_text().alias("text"))


def _shingles_of(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """members (doc_id, h, rep, ...) with the sorted distinct shingles of their texts in place of doc_id and h."""
    kept = [c for c in members.columns if c not in ("doc_id", "h")]
    joined = members.join(_texts(docs), ["doc_id", "h"]).select(*kept, "text")
    names = [*kept, "shingles"]
    at = len(names) - 1

    def run(batches):
        for batch in batches:
            sets = [distinct_shingles(bytes(x.as_buffer()), words).tobytes() for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sets, pa.binary())], names=names)

    return joined.mapInArrow(run, ", ".join([*[f"{c} {t}" for c, t in members.select(*kept).dtypes], "shingles binary"]))


def _sorted_groups(df: DataFrame, *keys: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def _candidate_edges(met: DataFrame) -> DataFrame:
    """Distinct edges (a, b), a < b, with the components of the stars of all buckets; ``met`` has a row (rep, low) per member and bucket."""
    own = met.groupBy("rep").agg(F.min("low").alias("a"), F.collect_set("low").alias("lows"))  # one low a band at most
    ends = own.select("a", F.explode(F.array_union("lows", F.array("rep"))).alias("b"))
    return ends.where(F.col("a") != F.col("b")).distinct()


def _links(docs: DataFrame, reps: DataFrame, edges: DataFrame, degrees: DataFrame, threshold: float, words: int, block: int) -> DataFrame:
    """Verified links (a, b) that join what is similar inside the families of candidate edges."""
    ends = edges.select(F.col("a").alias("rep")).union(edges.select("b"))
    families = checkpointed(connected_components(edges, ends, "rep").withColumnRenamed("component", "fam"))
    known = checkpointed(families.join(reps, "rep"))
    # Long texts count for as many members as their shingles fill, so a block is bounded by both.
    weight = F.greatest(F.count("*"), F.ceil(F.sum("n_shingles") / SHINGLES))
    sizes = known.groupBy("fam").agg(weight.cast("long").alias("size"))
    members = known.join(sizes, "fam").select("doc_id", "h", "rep", "fam", "size")
    parts = F.ceil(F.col("size") / block)
    place = F.pmod(F.xxhash64("rep"), parts).cast("long")
    sets = _shingles_of(docs, members.withColumn("part", place), words)
    if members.where(F.col("size") > block).isEmpty():
        first = sets.select("fam", "part", "rep", "shingles")
        return _sorted_groups(first, "fam", "part").mapInArrow(_verify(threshold), "a long, b long")
    sets = written(sets, "family-shingles")
    large = F.col("size") > block
    central = (
        families.join(sizes.where(large), "fam").join(degrees, "rep")
        .withColumn("r", F.row_number().over(Window.partitionBy("fam").orderBy(F.desc("degree"), "rep")))
        .where(F.col("r") <= PIVOTS).select("rep")
    )
    copies = sets.where(large).join(central, "rep", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    first = sets.select("fam", "part", "rep", "shingles").union(copies.select("fam", "part", "rep", "shingles"))
    inside = checkpointed(_sorted_groups(first, "fam", "part").mapInArrow(_verify(threshold), "a long, b long"))
    # Large families once more: what is outside the largest class, against the other blocks.
    nodes = sets.where(large).select("rep")
    label = connected_components(inside.join(nodes.withColumnRenamed("rep", "a"), "a", "left_semi"), nodes, "rep").withColumnRenamed("component", "label")
    whole = sets.where(large).join(label, "rep")
    counts = whole.groupBy("fam", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("fam").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    outside = whole.join(main, "fam").where(F.col("label") != F.col("main"))
    chunks = outside.groupBy("fam").agg(F.ceil(F.count("*") / block).alias("chunks"))
    chunk = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")).cast("long")
    away = outside.join(chunks, "fam").withColumn("chunk", chunk).withColumn("at", F.explode(F.sequence(F.lit(0), parts - 1)))
    away = away.where(F.col("at") != F.col("part")).select("fam", F.col("at").cast("long").alias("part"), "chunk", F.lit(True).alias("away"), "rep", "label", "shingles")
    home = whole.join(chunks, "fam").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    home = home.select("fam", "part", "chunk", F.lit(False).alias("away"), "rep", "label", "shingles")
    across = _sorted_groups(home.union(away), "fam", "part", "chunk").mapInArrow(_verify_across(threshold), "a long, b long")
    return inside.union(across)


def _classified(docs: DataFrame, threshold: float, words: int, bands: int, rows: int, block: int) -> DataFrame:
    """Per row: doc_id, h, class_id, class_size, n_shingles, stays (whether it is the first of its class by doc_id and h)."""
    bounded_batches(docs.sparkSession)
    types = "doc_id long, h long, key_a long, key_b long, n_shingles long, bands array<long>"
    sketch = written(_texts(docs).mapInArrow(_sketch(words, bands, rows), types), "sketches")
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    same = sketch.where(known).groupBy("key_a", "key_b").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"))
    same = checkpointed(same.select("key_a", "key_b", "first.doc_id", "first.h", "copies", "n_shingles", F.monotonically_increasing_id().alias("rep")))
    # A representative's own row has its bands; rows that repeat id and text give equal ones.
    first = same.select(*[F.col(c).alias(f"{c}_") for c in ("key_a", "key_b", "doc_id", "h")], "rep")
    own = sketch.where(known).join(first, [F.col(c) == F.col(f"{c}_") for c in ("key_a", "key_b", "doc_id", "h")])
    banded = own.select("rep", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n"))
    met = checkpointed(banded.join(buckets.where(F.col("low") < F.col("high")), ["band", "hash"]).select("rep", "low", "n"))
    edges, degrees = _candidate_edges(met), met.groupBy("rep").agg(F.sum("n").alias("degree"))
    reps = same.select("rep", "doc_id", "h", "n_shingles")
    links = checkpointed(_links(docs, reps, checkpointed(edges), degrees, threshold, words, block))
    nodes = links.select(F.col("a").alias("rep")).union(links.select("b"))
    classes = connected_components(links, nodes, "rep").withColumnRenamed("component", "class")
    per_set = same.join(classes, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    sizes = per_set.groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.sum("copies").alias("class_size"))
    per_set = per_set.select("key_a", "key_b", "class").join(sizes, "class").drop("class")
    named = sketch.where(known).select("doc_id", "h", "key_a", "key_b", "n_shingles").join(per_set, ["key_a", "key_b"])
    stays = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    found = named.select("doc_id", "h", F.col("first.doc_id").alias("class_id"), "class_size", "n_shingles", stays.alias("stays"))
    alone = sketch.where(~known).select("doc_id", "h", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "n_shingles", F.lit(True).alias("stays"))
    return found.union(alone)


def near_classes(
    docs: DataFrame, threshold: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, class_id, class_size, n_shingles.

    class_id is the smallest doc_id of the class: rows joined by chains of links, a link being a
    Jaccard similarity of at least ``threshold`` between sets of five-word shingles.  Texts without words
    (and null texts) have no shingles and are classes of their own, as are rows without an id
    (class_id null).  Repeated rows count as copies; an id that stands on several texts is a row for each.  An empty
    table gives no rows.
    """
    return _classified(docs, threshold, words, bands, rows, block).drop("h", "stays")


def keep_one(
    docs: DataFrame, threshold: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """One text of each class of ``near_classes``, in the columns of ``docs``: that of the smallest id, then of the smallest hash.

    Rows are dropped by id and text, so a text whose id also stands on a copy of another stays.  Rows that repeat
    both id and text of the one that stays all stay (exact deduplication drops them).
    """
    judged = _classified(docs, threshold, words, bands, rows, block)
    id_, mark = free_name("dropped_id", docs.columns), free_name("dropped_text", docs.columns)
    dropped = judged.where(~F.col("stays")).select(F.col("doc_id").alias(id_), F.col("h").alias(mark)).distinct()
    same = (docs["doc_id"].cast("long") == dropped[id_]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == dropped[mark])
    return docs.join(dropped, same, "left_anti")
