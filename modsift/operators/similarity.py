"""Exact similarity join of token sets: a prefix index finds families, blocks verify them.

Two sets of Jaccard similarity t or more share one of their rarest tokens: those of the prefix that is left when
ceil(t * size) - 1 tokens are taken off the end, tokens being in ascending order of their documents' number.  Prefix
tokens are an inverted index.  Entries of one token meet if their sizes, the places of the token and a parity bitmap
(each an exact bound) allow the similarity; entries that may be similar are joined into families by a spanning
forest, never by a list of pairs.  Inside a family all overlaps are counted, in blocks.

* Equal sets are one representative first, with a count of copies.
* A token or family with more entries than a block is cut into parts by a hash, and pairs of parts meet in cells.
* Tokens that one document has can join nothing and are not indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsift.operators.density import connected_components
from modsift.operators.scale import bounded_batches, stored

THRESHOLD = 0.85
BUCKETS = 1 << 20  # of token hashes, for the order by document frequency: one byte each goes to every task
BLOCK = 2048
SLACK = 1e-9


# --- sets ---------------------------------------------------------------------------------------
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, hashes -> row, size, two keys and the sorted set."""
    for batch in batches:
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_pylist()])
        hashes = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        sets = [np.unique(hashes[a:b]).astype(np.int64, copy=False) for a, b in zip(ends[:-1], ends[1:])]
        keys = [[int((_mixed(s.view(np.uint64), k)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for k in (1, 2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), *[pa.array(k, pa.int64()) for k in keys], pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["row", "size", "key_a", "key_b", "tokens"],
        )


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    values = (values ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def _tokens(value) -> np.ndarray:
    return np.frombuffer(value, np.int64)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return tokens & (BUCKETS - 1)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for value in batch.column(0).to_pylist():
            np.add.at(counts, _bucket(_tokens(value)), 1)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["bucket", "n"])


def frequency_codes(sets: DataFrame) -> np.ndarray:
    """Per bucket of token hashes a byte that grows with the number of sets in it: exact to 127, then in eighths of a power of two."""
    found = sets.mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    codes = np.zeros(BUCKETS, np.uint8)
    n = found.column("n").to_numpy().astype(float)
    coded = np.where(n < 128, n, np.minimum(128 + 8 * np.log2(np.maximum(n, 128) / 128), 255))
    codes[found.column("bucket").to_numpy()] = coded.astype(np.uint8)
    return codes


def _at_most(code: int) -> int:
    """The largest number of sets that a code stands for, as long as 2**22 sets or fewer share a token."""
    return code if code < 128 else int(128 * 2 ** ((code - 127) / 8)) + 1


# --- prefix index -----------------------------------------------------------------------------
def required_overlap(a: int, b: int, threshold: float) -> int:
    return math.ceil(threshold / (1 + threshold) * (a + b) - SLACK)


def prefix_length(size: int, threshold: float) -> int:
    return size - math.ceil(threshold * size - SLACK) + 1


def parity_bitmap(tokens: np.ndarray) -> bytes:
    """Bit i is set if an odd number of tokens fall on it: two bitmaps differ in no more bits than the sets in tokens."""
    width = max(64, 1 << (len(tokens) - 1).bit_length())
    places = (tokens >> 20) & (width - 1)
    return np.packbits(np.bincount(places, minlength=width) & 1, bitorder="little").tobytes()


def _postings(codes, threshold: float, block: int):
    """rep, size, tokens -> an entry per indexed prefix token and cell."""
    names = ["token", "cell", "rep", "size", "place", "bitmap"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows, held = codes.value, [], 0
        for batch in batches:
            for rep, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = _tokens(value)
                code = table[_bucket(tokens)]
                order = np.lexsort((tokens, code))[: prefix_length(len(tokens), threshold)]
                bitmap = parity_bitmap(tokens)
                for place, (token, c) in enumerate(zip(tokens[order].tolist(), code[order].tolist())):
                    if c < 2:  # no other set has it
                        continue
                    parts = -(-_at_most(c) // block)
                    own = rep % parts
                    for other in range(parts):
                        cell = min(own, other) * parts + max(own, other)
                        rows.append((token, cell, rep, len(tokens), place, bitmap))
                        held += len(bitmap) + 40
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _folded(bitmap: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bitmap = (bitmap >> width) ^ (bitmap & ((1 << width) - 1))
    return bitmap


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Rows with equal values in the first ``by`` columns, of a sorted partition."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:by] != key:
                if rows:
                    yield rows
                key, rows = row[:by], []
            rows.append(row)
    if rows:
        yield rows


def may_join(entries: list[tuple[int, int, int, bytes]], threshold: float) -> list[tuple[int, int]]:
    """Spanning forest of the entries (rep, size, place, bitmap; by ascending size) of a token that may be similar."""
    bits = [(int.from_bytes(e[3], "little"), 8 * len(e[3])) for e in entries]
    root = list(range(len(entries)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges, left = [], len(entries)
    for i, (rep, size, place, _) in enumerate(entries):
        if left == 1:
            break
        bitmap, width = bits[i]
        for j in range(i + 1, len(entries)):
            other, larger, at, _ = entries[j]
            if size < threshold * larger - SLACK:
                break
            if other == rep or find(i) == find(j):
                continue
            need = required_overlap(size, larger, threshold)
            if 1 + min(place, at) + min(size - place - 1, larger - at - 1) < need:
                continue
            if (bitmap ^ _folded(*bits[j], width)).bit_count() > size + larger - 2 * need:
                continue
            edges.append((rep, other))
            root[find(j)] = find(i)
            left -= 1
    return edges


def _families(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # pairs often meet again under their next token
        for rows in _groups(batches, 2):
            if len(rows) > 1:
                seen.update(may_join([r[2:] for r in rows], threshold))
            if len(seen) > 100_000:
                yield _edge_batch(seen)
                seen = set()
        if seen:
            yield _edge_batch(seen)

    return run


def _edge_batch(edges) -> pa.RecordBatch:
    a, b = zip(*edges)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


# --- verification -----------------------------------------------------------------------------
def overlaps(sets: list[np.ndarray], chunk: int = 2048) -> np.ndarray:
    """Common tokens of all pairs: frequent tokens by products of 0/1 matrices, others pair by pair."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    dense = count * 8 > m
    number = np.cumsum(dense) - 1
    at = dense[token] & (count[token] > 1)
    columns, rows = number[token[at]], owner[at]
    for start in range(0, int(dense.sum()), chunk):
        part = (columns >= start) & (columns < start + chunk)
        x = np.zeros((m, min(chunk, int(dense.sum()) - start)), np.float32)
        x[rows[part], columns[part] - start] = 1
        out += x @ x.T
    rest = ~dense[token] & (count[token] > 1)
    if rest.any():
        order = np.argsort(token[rest], kind="stable")
        who, size = owner[rest][order], count[token[rest][order]]
        flat = out.reshape(-1)
        for c in np.unique(size).tolist():
            shared = who[size == c].reshape(-1, c)
            step = max(1, (1 << 20) // (c * c))
            for s in range(0, len(shared), step):
                part = shared[s : s + step]
                np.add.at(flat, (part[:, :, None] * m + part[:, None, :]).ravel(), 1)
    return out


def component_labels(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each component of a symmetric matrix of links; every row of the matrix is read once."""
    label, left = np.arange(len(linked)), linked.any(axis=1)
    for i in range(len(linked)):
        front = np.array([i]) if left[i] else ()
        left[i] = False
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & left)
            left[front], label[front] = False, i
    return label


def _verified(threshold: float):
    """family, cell, whether one part alone, part, rep, copies, tokens -> per member: its links to copies of others, its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            if len(rows) < 2:
                continue
            part, rep, copies = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5))
            sets = [_tokens(r[6]) for r in rows]
            size = np.array([len(s) for s in sets])
            common = overlaps(sets)
            linked, links = np.empty(common.shape, bool), np.empty(len(rows), np.int64)
            for start in range(0, len(rows), 256):  # few rows at a time: the matrices in between are of eight bytes
                at = slice(start, start + 256)
                near = common[at] >= threshold * (size[at, None] + size[None, :] - common[at]) - SLACK
                near &= np.arange(len(rows))[at, None] != np.arange(len(rows)) if rows[0][2] else part[at, None] != part[None, :]
                linked[at], links[at] = near, near @ copies
            del common
            some = np.flatnonzero(linked.any(axis=1))
            label = component_labels(linked)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[some]), pa.array(links[some]), pa.array(rep[label[some]])], names=["rep", "links", "label"]
            )

    return run


def _by(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def similar_sets(df: DataFrame, row_id: str, tokens: str, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(row id, cluster, n_links): for every row the rows whose token set is similar, and the cluster they form.

    Similar: Jaccard similarity of at least ``threshold``; n_links counts all such other rows, copies too.
    ``cluster`` is the smallest row id among those that chains of links join.  Empty and null sets have no links
    and are clusters of their own.  Rows that repeat an id are rows of their own.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    hashed = df.select(F.col(row_id).alias("row"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("hashes"))
    kind = dict(hashed.dtypes)["row"]
    sets = stored(hashed.mapInArrow(_keyed, f"row {kind}, size int, key_a long, key_b long, tokens binary"))
    same = sets.where("size > 0").groupBy("key_a", "key_b").agg(F.min("row").alias("first_row"), F.count("*").alias("copies"), F.first("tokens").alias("tokens"))
    reps = stored(same.withColumn("rep", F.monotonically_increasing_id()))

    codes = spark.sparkContext.broadcast(frequency_codes(reps.select("tokens")))  # BUCKETS bytes
    entries = reps.select("rep", "tokens").mapInArrow(_postings(codes, threshold, block), "token long, cell long, rep long, size int, place int, bitmap binary")
    dealt = entries.repartition("token", "cell").sortWithinPartitions("token", "cell", "size")
    edges = stored(dealt.mapInArrow(_families(threshold), "a long, b long").distinct())
    ends = edges.select(F.col("a").alias("rep")).union(edges.select("b"))
    families = stored(connected_components(edges, ends, "rep"))

    parts = families.groupBy("component").agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
    members = families.join(parts, "component").join(reps.select("rep", "copies", "tokens"), "rep")
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    members = members.withColumn("part", part).withColumn("other", other)
    cell = (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).alias("cell")
    # A cell on the diagonal holds one part, any other cell two.
    verified = _by(members.select("component", cell, (F.col("part") == F.col("other")).alias("alone"), "part", "rep", "copies", "tokens"), "component", "cell")
    found = stored(verified.mapInArrow(_verified(threshold), "rep long, links long, label long"))

    if parts.where("parts > 1").isEmpty():
        labels = found.select("rep", "label")  # every family was judged in one piece
    else:
        joined = found.where("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b"))
        labels = connected_components(joined, found.select("rep"), "rep").withColumnRenamed("component", "label")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.drop("tokens").join(links.join(labels, "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    least = named.groupBy("label").agg(F.min("first_row").alias("cluster"))
    per_set = named.join(least, "label").select("key_a", "key_b", "cluster", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    empty = sets.where("size = 0").select(F.col("row").alias(row_id), F.col("row").alias("cluster"), F.lit(0).cast("long").alias("n_links"))
    full = sets.where("size > 0").select("row", "key_a", "key_b").join(per_set, ["key_a", "key_b"])
    return full.select(F.col("row").alias(row_id), "cluster", "n_links").union(empty)


def near_duplicate_clusters(df: DataFrame, row_id: str, tokens: str, threshold: float = THRESHOLD) -> DataFrame:
    """(row id, cluster) of ``similar_sets``."""
    return similar_sets(df, row_id, tokens, threshold).select(row_id, "cluster")
