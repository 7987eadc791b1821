"""The steps of ``word_vectors`` over packed blocks: no token, pair or matrix entry is a row.

Rows are cut into blocks that hold their words once and their tokens as places in these.  Only the words of a block are
joined to the vocabulary.  A block counts its pairs and sends them, packed, to parts of the symmetric matrix, which is stored
once; rows and columns are alike, so one copy serves both half steps of alternating least squares.  A part meets the
factors, dense chunks of words, where both are stored (cartesian product), so no entry and no factor is shuffled for it.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modsift.operators.scale import bounded_batches, stored

BLOCK_TOKENS = 600_000
PART_ENTRIES = 8_000_000  # that a part may get
PART_WORDS = 8_000
CHUNK = 1 << 16  # words
SLICE = 1 << 16  # entries whose factors are looked up at once
PACKED = "first binary, size binary, second binary, n binary"


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers byte by byte, compressed: high bytes are mostly alike."""
    values = np.ascontiguousarray(values.astype(kind))
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _opened(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def release(spark: SparkSession) -> None:
    """Files of shuffles and checkpoints that nothing refers to any more go now, not when the driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()


# --- blocks of rows ------------------------------------------------------------------------
def _encoded(block_tokens: int):
    """row id, tokens -> a row per block: row ids, distinct words with counts, lengths of the rows, tokens as places in the words."""

    def made(ids, sizes, tokens):
        ids, sizes, tokens = pa.concat_arrays(ids), np.concatenate(sizes), pa.concat_arrays(tokens).dictionary_encode()
        at = tokens.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        sink = pa.BufferOutputStream()
        words = pa.RecordBatch.from_arrays([tokens.dictionary, pa.array(np.bincount(at[at >= 0], minlength=len(tokens.dictionary)).astype(np.int64))], names=["word", "n"])
        with pa.ipc.new_stream(sink, words.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(words)
        rows = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([rows, *[pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), _planes(sizes, "<u4"), _planes(at, "<i4"))]], names=["rows", "words", "sizes", "ids"])

    def run(batches):
        ids, sizes, tokens, held = [], [], [], 0
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(1)
                ids.append(batch.column(0))
                sizes.append(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                tokens.append(lists.flatten())
                held += len(tokens[-1])
                if held >= block_tokens:
                    yield made(ids, sizes, tokens)
                    ids, sizes, tokens, held = [], [], [], 0
        if ids:
            yield made(ids, sizes, tokens)

    return run


def _read_words(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _word_counts(batches):
    for batch in batches:
        for data in batch.column(0).to_pylist():
            yield from _read_words(data).to_batches()


def _word_places(batches):
    for batch in batches:
        for block, data in zip(*[c.to_pylist() for c in batch.columns]):
            words = _read_words(data).column("word").combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(np.arange(len(words), dtype=np.int32)), words], names=["block", "at", "word"])


def _numbered(key, found: pa.Table, block: pa.Table) -> pa.Table:
    """A block's tokens as word ids, -1 for words outside the vocabulary."""
    if not len(block):
        return block
    at = _opened(block.column("ids")[0].as_py(), "<i4")
    ids = np.full(at.max(initial=-1) + 2, -1, np.int32)  # the last is for -1
    ids[found.column("at").to_numpy()] = found.column("word_id").to_numpy()
    return block.set_column(block.schema.get_field_index("ids"), "ids", pa.array([_planes(ids[at], "<i4")], pa.binary()))


def row_blocks(df: DataFrame, row_id: str, tokens: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    bounded_batches(df.sparkSession)
    of = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("row"), F.col(tokens).cast("array<string>").alias("tokens"))
    return stored(rows.mapInArrow(_encoded(block_tokens), f"rows array<{of}>, words binary, sizes binary, ids binary").withColumn("block", F.monotonically_increasing_id()))


def word_counts(blocks: DataFrame) -> DataFrame:
    return blocks.select("words").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def numbered_blocks(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """(block, rows, sizes, ids) with the ids of ``words``; only the words of each block are shuffled, and the packed tokens."""
    places = blocks.select("block", "words").mapInArrow(_word_places, "block long, at int, word string")
    found = places.join(words.select("word", "word_id"), "word").select("block", "at", "word_id")
    tokens = blocks.select("block", "rows", "sizes", "ids")
    of = blocks.schema["rows"].dataType.simpleString()
    return stored(found.groupBy("block").cogroup(tokens.groupBy("block")).applyInArrow(_numbered, f"block long, rows {of}, sizes binary, ids binary"))


# --- matrix ------------------------------------------------------------------------------------
def _packed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> dict[str, bytes]:
    """Entries in the order of (a, b): rows, their sizes, steps of the columns, numbers."""
    start = np.flatnonzero(np.diff(a, prepend=-1))
    step = np.diff(b, prepend=0)
    step[start] = b[start]
    return {"first": _planes(np.diff(a[start], prepend=0), "<u4"), "size": _planes(np.diff(np.append(start, len(a))), "<u4"), "second": _planes(step, "<u4"), "n": _planes(n, "<i8")}


def _entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their sizes, columns and numbers of ``_packed``."""
    size = _opened(row["size"], "<u4").astype(np.int64)
    step = _opened(row["second"], "<u4").astype(np.int64)
    start, ran = np.cumsum(size) - size, np.cumsum(step)
    return np.cumsum(_opened(row["first"], "<u4").astype(np.int64)), size, ran - np.repeat(ran[start] - step[start], size), _opened(row["n"], "<i8")


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, ascending, and how often (or with which sum) they occur; ``keys`` is sorted in place if there is no ``n``."""
    if n is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.diff(np.append(start, len(keys))) if n is None else np.add.reduceat(n, start) if len(start) else n


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], kinds[k]) for c, k in (x.split() for x in schema.split(", "))})


def _block_pairs(window: int, parts: int):
    """A block's pairs of words, counted, to the parts of the matrix that have them; a pair goes to the parts of both words."""

    def run(batches):
        for batch in batches:
            for sizes, data in zip(*[c.to_pylist() for c in batch.columns]):
                ids, sizes = _opened(data, "<i4").astype(np.int64), _opened(sizes, "<u4").astype(np.int64)
                row, keys = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), []
                for d in range(1, window + 1):
                    x, y = ids[:-d], ids[d:]
                    keep = (row[:-d] == row[d:]) & (x >= 0) & (y >= 0)
                    x, y = x[keep], y[keep]
                    keys.append(np.minimum(x, y) << 32 | np.maximum(x, y))
                keys, n = _counted(np.concatenate(keys))
                a, b = keys >> 32, keys & 0xFFFFFFFF
                two = a != b
                a, b, n = np.concatenate([a, b[two]]), np.concatenate([b, a[two]]), np.concatenate([n, n[two]])
                order = np.argsort(a << 32 | b, kind="stable")
                part = (a[order] % parts).astype(np.uint16)
                order = order[np.argsort(part, kind="stable")]
                edges = np.searchsorted(np.sort(part), np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    at = order[edges[p] : edges[p + 1]]
                    yield _batch([{"part": int(p)} | _packed(a[at], b[at], n[at])], "part int, " + PACKED)

    return run


def _part(chunk: int):
    """A part of the matrix from what the blocks have of it: a row per chunk of columns; ``sums`` are its rows' sums."""

    def run(key, rows):
        keys, n = [], []
        for row in rows.to_pylist():
            first, size, second, times = _entries(row)
            keys.append(np.repeat(first, size) << 32 | second)
            n.append(times.astype(np.int32))  # of a block
        keys, n = np.concatenate(keys), np.concatenate(n)
        keys, n = _counted(keys, n.astype(np.int64))
        a, b = keys >> 32, keys & 0xFFFFFFFF
        start = np.flatnonzero(np.diff(a, prepend=-1))
        sums = np.repeat(np.add.reduceat(n, start), np.diff(np.append(start, len(a))))
        out = []
        for c in np.unique(b // chunk).tolist():
            at = np.flatnonzero(b // chunk == c)
            first = np.flatnonzero(np.diff(a[at], prepend=-1))
            out.append({"part": key[0].as_py(), "chunk": c, "sums": _planes(sums[at][first], "<i8")} | _packed(a[at], b[at], n[at]))
        return pa.Table.from_batches([_batch(out, "part int, chunk int, sums binary, " + PACKED)])

    return run


def matrix(blocks: DataFrame, window: int, tokens: int, words: int, chunk: int = CHUNK) -> DataFrame:
    """The symmetric co-occurrences of ``numbered_blocks`` as (part, chunk, sums, packed entries); word w is a row of part w % parts."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    parts = min(max(2 * cores, -(-2 * window * tokens // PART_ENTRIES), -(-words // PART_WORDS)), (1 << 16) - 1)
    pairs = blocks.select("sizes", "ids").mapInArrow(_block_pairs(window, parts), "part int, " + PACKED)
    return stored(pairs.groupBy("part").applyInArrow(_part(chunk), "part int, chunk int, sums binary, " + PACKED))


# --- factors -------------------------------------------------------------------------------------
def _start(ids: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Random unit vectors that depend on nothing but the word id and the seed."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64)[:, None] * np.uint64(2 * dim) + np.arange(2 * dim, dtype=np.uint64) + np.uint64(seed) * np.uint64(0xD1342543DE82EF95)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(float) / 2.0**53
    normal = np.sqrt(-2 * np.log(1 - u[:, :dim])) * np.cos(2 * np.pi * u[:, dim:])
    return (normal / np.linalg.norm(normal, axis=1, keepdims=True)).astype(np.float32)


def _by_chunk(ids: np.ndarray, values: np.ndarray, chunk: int, kind: str):
    for c in np.unique(ids // chunk).tolist():
        at = np.flatnonzero(ids // chunk == c)
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([ids[at].astype(np.int64).tobytes()], pa.binary()), pa.array([values[at].astype(kind).tobytes()], pa.binary())], names=["chunk", "ids", "x"])


def _sums(chunk: int):
    """The sums of the matrix's rows, to their chunks."""

    def run(batches):
        for batch in batches:
            for first, sums in zip(*[c.to_pylist() for c in batch.columns]):
                yield from _by_chunk(np.cumsum(_opened(first, "<u4").astype(np.int64)), _opened(sums, "<i8"), chunk, "<f8")

    return run


def _filled(c: int, rows: pa.Table, chunk: int, kind: str, width: int) -> bytes:
    """What several tasks have of a chunk as one array; words without a value are zero."""
    out = np.zeros((chunk, width), kind)
    for ids, x in zip(rows.column("ids").to_pylist(), rows.column("x").to_pylist()):
        out[np.frombuffer(ids, np.int64) - c * chunk] = np.frombuffer(x, kind).reshape(-1, width)
    return out.tobytes()


def _dense_sums(chunk: int):
    def run(key, rows):
        c = key[0].as_py()
        return pa.table({"of": pa.array([c], pa.int32()), "m": pa.array([_filled(c, rows, chunk, "<f8", 1)], pa.binary())})

    return run


def _dense_factors(chunk: int, dim: int):
    """The factors of a chunk, beside the sums of its words; none where no word has any."""

    def run(key, rows, sums):
        c, some = key[0].as_py(), len(rows) > 0
        values = ([c], [_filled(c, rows, chunk, "<f4", dim)], [sums.column("m")[0].as_py()]) if some else ([], [], [])
        return pa.table({name: pa.array(v, kind) for name, v, kind in zip(("of", "x", "m"), values, (pa.int32(), pa.binary(), pa.binary()))})

    return run


def _meet(left: DataFrame, chunks: DataFrame, where: Column | None = None) -> DataFrame:
    """Every row of ``left`` with the chunks it needs, read where they are stored."""
    return left.hint("shuffle_replicate_nl").join(chunks.coalesce(1), F.lit(True) if where is None else where)


def _solved(dim: int, total: float, regularisation: float, gram: np.ndarray | None, seed: int, chunk: int):
    """Parts with the factors and sums of their columns -> factors of their rows; without ``gram`` those to start with.

    The normal equations of implicit alternating least squares with weight 1 + ppmi of the positive entries.
    """

    def run(batches):
        part, left, right, n = None, {}, {}, {}

        def done():
            ids = np.array(sorted(left), np.int64)
            if not len(ids):
                return
            if gram is None:
                x = _start(ids, dim, seed)
            else:
                eye = np.eye(dim)
                x = np.concatenate([np.linalg.solve(np.stack([left[i] + gram + regularisation * n[i] * eye for i in some]), np.stack([right[i] for i in some])[..., None])[..., 0] for some in (ids[j : j + 4096].tolist() for j in range(0, len(ids), 4096))])
            yield from _by_chunk(ids, x, chunk, "<f4")

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    yield from done()
                    part, left, right, n = row["part"], {}, {}, {}
                first, size, second, times = _entries(row)
                second = second - row["chunk"] * chunk
                of, column = _opened(row["sums"], "<i8").astype(float), np.frombuffer(row["m"], "<f8")
                weight = np.log(times * (total / np.repeat(of, size)) / column[second])
                keep = weight > 0
                size = np.add.reduceat(keep, np.cumsum(size) - size, dtype=np.int64)
                second, weight = second[keep], weight[keep].astype(np.float32)
                some = np.flatnonzero(size)
                words, end = first[some].tolist(), np.cumsum(size[some])
                if gram is None:
                    left.update(dict.fromkeys(words))
                    continue
                for word, of in zip(words, size[some].tolist()):
                    n[word] = n.get(word, 0) + of
                factors, begin, done_to = np.frombuffer(row["x"], "<f4").reshape(-1, dim), 0, 0
                while begin < len(words):  # whole rows, of about SLICE entries together
                    stop = max(begin + 1, int(np.searchsorted(end, done_to + SLICE, "right")))
                    w, y = weight[done_to : end[stop - 1], None], factors[second[done_to : end[stop - 1]]]
                    edges = [0, *(end[begin:stop] - done_to).tolist()]
                    sums, y = np.add.reduceat((1 + w) * y, edges[:-1], axis=0), np.sqrt(w) * y
                    for i, word in enumerate(words[begin:stop]):
                        z = y[edges[i] : edges[i + 1]]
                        if word in left:
                            left[word] += z.T @ z
                            right[word] += sums[i]
                        else:
                            left[word], right[word] = z.T @ z, sums[i]
                    begin, done_to = stop, int(end[stop - 1])
        yield from done()

    return run


def _gram(dim: int):
    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            for x in batch.column(0).to_pylist():
                x = np.frombuffer(x, "<f4").reshape(-1, dim).astype(float)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim), pa.int32()), pa.array(total.ravel())], names=["k", "v"])

    return run


def factorised(parts: DataFrame, dim: int, iterations: int, seed: int, regularisation: float = 0.05, chunk: int = CHUNK) -> DataFrame | None:
    """(chunk, x): the words' factors of the positive pointwise mutual information, zeros for words without any; None if no word has any."""
    spark = parts.sparkSession
    found = "chunk int, ids binary, x binary"
    once = parts.groupBy("part", "chunk").agg(F.first("first").alias("first"), F.first("sums").alias("sums"))
    sums = once.select("first", "sums").mapInArrow(_sums(chunk), found)
    sums = stored(sums.groupBy("chunk").applyInArrow(_dense_sums(chunk), "of int, m binary"))
    total = sums.mapInArrow(_added, "v double").agg(F.sum("v")).first()[0] or 0.0
    x = None
    for step in range(2 * iterations + 1):
        gram = None
        if x is not None:
            rows = x.select("x").mapInArrow(_gram(dim), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()  # dim * dim numbers
            gram = np.array([r.v for r in rows]).reshape(dim, dim)
        met = _meet(parts, sums if x is None else x, (F.col("chunk") <= F.col("of")) & (F.col("chunk") >= F.col("of")))
        solved = met.mapInArrow(_solved(dim, total, regularisation, gram, seed, chunk), found)
        x = stored(solved.groupBy("chunk").cogroup(sums.withColumnRenamed("of", "chunk").groupBy("chunk")).applyInArrow(_dense_factors(chunk, dim), "of int, x binary, m binary"))
        if step == 0 and x.isEmpty():
            return None
        release(spark)
    return x.select(F.col("of").alias("chunk"), "x")


def _added(batches):
    for batch in batches:
        for m in batch.column(1).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array([float(np.frombuffer(m, "<f8").sum())])], names=["v"])


# --- rows --------------------------------------------------------------------------------------------
def _weighted(dim: int, total: float, chunk: int):
    """A chunk's factors and counts -> unit vectors, rarer words weighing more."""

    def run(key, words: pa.Table, factors: pa.Table) -> pa.Table:
        if not len(words) or not len(factors):
            return pa.table({"chunk": pa.array([], pa.int32()), "x": pa.array([], pa.binary())})
        x = np.frombuffer(factors.column("x")[0].as_py(), "<f4").reshape(-1, dim).astype(float)
        norm = np.linalg.norm(x, axis=1)
        n = np.zeros(chunk)
        n[words.column("word_id").to_numpy() - key[0].as_py() * chunk] = words.column("n").to_numpy()
        x = x * (np.divide(1, norm, out=np.zeros(chunk), where=norm > 0) * 0.001 / (0.001 + n / total))[:, None]
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})

    return run


def _row_sums(dim: int, chunk: int, of: pa.DataType):
    """Blocks with chunks of vectors -> sums of the vectors of each row's words in the chunk; rows without any have none."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for k in range(batch.num_rows):
                value = lambda c: batch.column(names.index(c))[k]  # noqa: B023, E731
                ids, sizes = _opened(value("ids").as_py(), "<i4"), _opened(value("sizes").as_py(), "<u4").astype(np.int64)
                x = np.frombuffer(value("x").as_py(), "<f8").reshape(-1, dim)
                at = np.flatnonzero(ids // chunk == value("chunk").as_py())  # -1 is of no chunk
                at = at[x[ids[at] % chunk].any(axis=1)] if len(at) < SLICE else np.concatenate([s[x[ids[s] % chunk].any(axis=1)] for s in (at[i : i + SLICE] for i in range(0, len(at), SLICE))])
                row = np.repeat(np.arange(len(sizes)), sizes)[at]
                start = np.flatnonzero(np.diff(row, prepend=-1))
                end, begin = np.append(start[1:], len(at)), 0
                while begin < len(start):  # whole rows, of about SLICE words together
                    stop = max(begin + 1, int(np.searchsorted(end, start[begin] + SLICE, "right")))
                    some = at[start[begin] : end[stop - 1]]
                    sums = np.add.reduceat(x[ids[some] % chunk], start[begin:stop] - start[begin], axis=0)
                    rows = value("rows").values.take(pa.array(row[start[begin:stop]]))
                    values = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, dim), pa.int32()), pa.array(sums.ravel()))
                    yield pa.RecordBatch.from_arrays([rows.cast(of), values], names=["__row", "sums"])
                    begin = stop

    return run


def row_vectors(blocks: DataFrame, factors: DataFrame, words: DataFrame, dim: int, chunk: int = CHUNK) -> DataFrame:
    """(__row, sums): what ``word_vectors.document_vectors`` adds up, a row per block row and chunk of words."""
    from pyspark.sql.pandas.types import to_arrow_type

    total = words.agg(F.sum("n")).first()[0]
    known = words.select(F.floor(F.col("word_id") / chunk).cast("int").alias("chunk"), "word_id", "n")
    vectors = known.groupBy("chunk").cogroup(factors.groupBy("chunk")).applyInArrow(_weighted(dim, float(total), chunk), "chunk int, x binary")
    of = blocks.schema["rows"].dataType.elementType
    met = _meet(blocks.select("rows", "sizes", "ids"), stored(vectors))
    return met.mapInArrow(_row_sums(dim, chunk, to_arrow_type(of)), f"__row {of.simpleString()}, sums array<double>")
