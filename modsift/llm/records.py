"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A record file is frame after frame:
    length of the data (unsigned 64 bit), masked checksum of these 8 bytes (unsigned 32 bit),
    the data, masked checksum of the data (unsigned 32 bit); all little-endian.
The checksum is CRC-32C; masking turns it by 15 bits and adds a constant, so that data which hold checksums themselves
do not check by accident.  The data are a header (doc_id, whether there is one, bytes per id) and the ids.

Documents are dealt by ranges of doc_id; a task sorts its range, encodes it and writes one file.  What a task wrote counts
only through its index rows, which Spark commits: a repeated attempt writes a file of another name, and a file
that no index row names is never read.  The index is a Parquet table beside the files, so readers
deal records among tasks in any order and read each at its offset.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modsift.llm.common import bounded_batches, shared_folder, whole_text
from modsift.llm.tokens import tokenizer

FILE_BYTES = 128 << 20  # of text per record file
READ_BYTES = 8 << 20
WIDTH = 2  # bytes per id: the tokenizer has fewer than 65 536 ids
HEADER, HEADER_BYTES = "<qBB", 10
INDEX_COLUMNS = "file_no int, file string, row long, doc_id long, offset long, n_bytes long, n_tokens long, first long"
INDEX = pa.schema([("file_no", pa.int32()), ("file", pa.string()), *[(c, pa.int64()) for c in ("row", "doc_id", "offset", "n_bytes", "n_tokens", "first")]])
# Fixed values of the frame format: reversed polynomial of CRC-32C and the masking constant.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
FRAME = 8 + 4 + 4


# --- checksums ------------------------------------------------------------------------------
class Crc32c:
    """CRC-32C of byte strings, whole blocks of many strings at a time.

    The checksum is linear: row i of the table holds what a byte at place i of a block adds to the state after the
    block, so a block is one table look-up per byte and an exclusive or over them.
    """

    def __init__(self, block: int = 512, at_once: int = 1 << 18):
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
        tables = [one]
        for _ in range(block - 1):
            tables.append((tables[-1] >> np.uint32(8)) ^ one[tables[-1] & np.uint32(255)])
        self.block, self.rows = block, at_once // block
        self.flat = np.concatenate(tables[::-1])
        self.places = np.arange(block, dtype=np.intp) * 256
        # The state passes a block as if its bytes were added to the block's first four.
        self.passing = [tables[block - 1 - i].tolist() for i in range(4)]
        self.one = one.tolist()

    def _blocks(self, data: np.ndarray) -> list[int]:
        out = []
        for at in range(0, len(data), self.rows):
            looked_up = np.take(self.flat, data[at : at + self.rows] + self.places, mode="clip")
            out += np.bitwise_xor.reduce(looked_up, axis=1).tolist()
        return out

    def of(self, data: bytes) -> int:
        return self.of_many([data])[0]

    def short(self, data: bytes) -> int:
        state = 0xFFFFFFFF
        for b in data:
            state = (state >> 8) ^ self.one[(state ^ b) & 255]
        return state ^ 0xFFFFFFFF

    def of_many(self, strings: list[bytes]) -> list[int]:
        block = self.block
        counts = [-(-len(s) // block) if len(s) >= 4 else 0 for s in strings]
        padded = np.zeros(sum(counts) * block, np.uint8)
        end = 0
        for s, n in zip(strings, counts):
            if n:  # leading zeros change nothing once the start state is folded into the first four bytes
                end += n * block
                start = end - len(s)
                padded[start:end] = np.frombuffer(s, np.uint8)
                padded[start : start + 4] ^= 255
        added, at, out = self._blocks(padded.reshape(-1, block)), 0, []
        a, b, c, d = self.passing
        for s, n in zip(strings, counts):
            if not n:
                out.append(self.short(s))
                continue
            state = 0
            for x in added[at : at + n]:
                state = a[state & 255] ^ b[state >> 8 & 255] ^ c[state >> 16 & 255] ^ d[state >> 24] ^ x
            out.append(state ^ 0xFFFFFFFF)
            at += n
        return out


_crc = Crc32c()


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def masked_checksum(data: bytes) -> int:
    return masked(_crc.short(data) if len(data) < 16 else _crc.of(data))


# --- frames ---------------------------------------------------------------------------------
def framed(records: list[bytes]) -> bytes:
    """Frames of records, one after another."""
    parts = []
    for data, crc in zip(records, _crc.of_many(records)):
        length = struct.pack("<Q", len(data))
        parts += [length, struct.pack("<I", masked_checksum(length)), data, struct.pack("<I", masked(crc))]
    return b"".join(parts)


def unframed(frames: list[bytes], where: list[str]) -> list[bytes]:
    """The data of frames; an error if a length or checksum does not agree."""
    out, sums = [], []
    for raw, at in zip(frames, where):
        if len(raw) < FRAME or struct.unpack_from("<I", raw, 8)[0] != masked_checksum(raw[:8]):
            raise ValueError(f"damaged record length at {at}")
        (n,) = struct.unpack_from("<Q", raw)
        if n != len(raw) - FRAME:
            raise ValueError(f"record length differs from the index at {at}")
        out.append(raw[12 : 12 + n])
        sums.append(struct.unpack_from("<I", raw, 12 + n)[0])
    for crc, stored, at in zip(_crc.of_many(out), sums, where):
        if masked(crc) != stored:
            raise ValueError(f"damaged record at {at}")
    return out


def file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder that all machines share; local paths come with or without ``file:``."""
    local = re.fullmatch(r"(?:file:)?/{1,3}([^/].*)", folder)
    return (pa.fs.LocalFileSystem(), f"/{local[1]}") if local else pa.fs.FileSystem.from_uri(folder)


# --- writing --------------------------------------------------------------------------------
def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(path).ids, end_id.to_bytes(WIDTH, "little")
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}.records"
        out, row, offset, first = None, 0, 0, 0
        try:
            for batch in batches:
                rows, data_of = [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py()) + end
                    data = struct.pack(HEADER, doc_id or 0, doc_id is not None, WIDTH) + ids
                    data_of.append(data)
                    n = len(ids) // WIDTH
                    rows.append((number, name, row, doc_id, offset, len(data), n, first))
                    row, offset, first = row + 1, offset + len(data) + FRAME, first + n
                if out is None:
                    system, root = file_system(folder)
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}")
                out.write(framed(data_of))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX)], schema=INDEX)
        finally:
            if out is not None:
                out.close()

    return run


def write_records(docs: DataFrame, path: str, folder: str, end_id: int = 2, file_bytes: int = FILE_BYTES) -> None:
    """Write all documents (doc_id, text) in ascending doc_id order below ``folder``: data/, index/ and files/.

    A null text is empty (its only id is the end id).  Rows without an id come first, equal ids in the order of
    their texts' hashes; rows that repeat id and text are records of their own.  An empty table writes no file.
    ``files`` has a row per record file with the ids before it.  ``folder`` is one that all executors share.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    order = ["doc_id", "h", "copy"]  # the last one cuts rows that are all alike
    keyed = texts.withColumn("h", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(_write(f"{folder}/data", path, end_id), INDEX_COLUMNS).write.parquet(f"{folder}/index")
    index = spark.read.schema(INDEX_COLUMNS).parquet(f"{folder}/index")
    totals = index.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.parquet(f"{folder}/files")


# --- reading --------------------------------------------------------------------------------
def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: INDEX_COLUMNS and ``start``, the ids of all records before it."""
    index = spark.read.schema(INDEX_COLUMNS).parquet(f"{folder}/index")
    files = spark.read.schema("file_no int, before long").parquet(f"{folder}/files")
    return index.join(files, "file_no").withColumn("start", F.col("before") + F.col("first")).drop("before")


RECORD_COLUMNS = "doc_id long, start long, n_tokens long, ids binary"


def _read(folder: str, ahead: int):
    names, types = ["doc_id", "start", "n_tokens", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def decoded(found: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
        rows = []
        where = [at for at, _, _, _ in found]
        for data, (at, n_tokens, start, _) in zip(unframed([raw for _, _, _, raw in found], where), found):
            doc_id, has_id, width = struct.unpack_from(HEADER, data)
            ids = np.frombuffer(data, f"<u{width}", offset=HEADER_BYTES)
            if len(ids) != n_tokens:
                raise ValueError(f"number of ids differs from the index at {at}")
            rows.append((doc_id if has_id else None, start, n_tokens, ids.astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        opened, name_open, held, at = None, None, b"", 0
        found, size = [], 0
        for batch in batches:
            for name, offset, n_bytes, n_tokens, start in zip(*(c.to_pylist() for c in batch.columns)):
                need = n_bytes + FRAME
                if name != name_open:
                    if opened is not None:
                        opened.close()
                    opened, name_open, held = system.open_input_file(f"{root}/{name}"), name, b""
                if not at <= offset <= offset + need <= at + len(held):
                    held, at = opened.read_at(max(need, ahead), offset), offset
                found.append((f"{name}:{offset}", n_tokens, start, held[offset - at : offset - at + need]))
                size += need
                if size > READ_BYTES or len(found) >= 4096:
                    yield decoded(found)
                    found, size = [], 0
        if found:
            yield decoded(found)
        if opened is not None:
            opened.close()

    return run


def read_records(spark: SparkSession, folder: str, seed: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of all records, every checksum verified.

    Without a seed tasks read stretches of files one after another.  With a seed the index rows are dealt and
    ordered by a hash, and each record is read at its offset: a shuffled epoch that moves only the index.
    """
    index = read_index(spark, folder)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.read.parquet(f"{folder}/files").count())
    columns = ["file", "offset", "n_bytes", "n_tokens", "start"]
    if seed is None:
        dealt = index.repartitionByRange(parts, "file_no", "row").sortWithinPartitions("file_no", "row").select(*columns)
    else:
        h = F.xxhash64("file_no", "row", F.lit(seed))
        dealt = index.withColumn("h", h).repartitionByRange(parts, "h", "file_no", "row").sortWithinPartitions("h", "file_no", "row").select(*columns)
    return dealt.mapInArrow(_read(f"{folder}/data", READ_BYTES if seed is None else 0), RECORD_COLUMNS)


def round_trip(docs: DataFrame, path: str, end_id: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` to a new folder of the cluster's shared one and read the records back."""
    folder = shared_folder(docs.sparkSession, "records")
    write_records(docs, path, folder, end_id, file_bytes)
    return read_records(docs.sparkSession, folder)
