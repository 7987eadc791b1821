"""Exact deduplication by Patricia tries of owners.

Full byte strings are inserted into compressed radix tries; a terminal node keeps the number of rows
and their owner (the smallest or the largest id).  Every task first builds tries over the rows it
reads, so a text held by a third of all rows leaves each task once.  The distinct strings are then
shuffled by length and content hash, and the tries of those partitions decide equality byte by byte.
A trie over its memory budget spills whole subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsift.llm.common import bounded_batches, free_name, whole_text
from modsift.llm.patricia import PatriciaTrie

TRIE_BYTES = 48 << 20


def _better(keep: str):
    """Missing ids lose against any id; the rest of an owner breaks ties between repeated ids."""
    if keep == "largest":
        return lambda a, b: (a[0] is not None, a[0] or 0, a[1]) > (b[0] is not None, b[0] or 0, b[1])
    return lambda a, b: (a[0] is None, a[0] or 0, a[1]) < (b[0] is None, b[0] or 0, b[1])


def _combine(schema: pa.Schema, keep: str, budget: int, final: bool):
    better = _better(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(better, budget)

        def out() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for text, owner, count in trie.items():
                rows.append((len(text), hashlib.sha256(text).digest(), text, owner[0], owner[1], count))
                size += len(text)
                if size > 8 << 20 or len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            texts, ids, rest, counts = (batch.column(i).to_pylist() for i in range(4))
            for text, doc_id, other, n in zip(texts, ids, rest, counts):
                trie.insert(text, (doc_id, other), n)
            if not final and trie.size > budget // 2:  # partial owners: hand over early instead of spilling
                yield from out()
        yield from out()

    return run


PART_BYTES = 128 << 20  # of strings per partition, before equal ones become one


def owner_table(texts: DataFrame, keep: str = "smallest", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct string of ``texts`` (text binary, id long, rest binary).

    Returns n_bytes, sha256 (binary), text, id (the owner's, null only where all ids are null), rest
    (the owner's) and n rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = texts.sparkSession
    bounded_batches(spark)
    names = [("n_bytes", "long"), ("sha256", "binary"), ("text", "binary"), ("id", "long"), ("rest", "binary"), ("n", "long")]
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in names])
    arrow = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}[t]) for n, t in names])
    first = texts.select("text", "id", "rest", F.lit(1).cast("long").alias("n")).mapInArrow(_combine(arrow, keep, budget, False), schema)
    size = texts.agg(F.sum(F.octet_length("text") + F.octet_length("rest"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    dealt = first.repartition(parts, "n_bytes", "sha256")
    return dealt.select("text", "id", "rest", "n").mapInArrow(_combine(arrow, keep, budget, True), schema)


def exact_groups(docs: DataFrame, keep: str = "smallest", budget: int = TRIE_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all bytes are; null counts as empty.  Missing ids never win unless all ids of
    a group are missing (keep_id is then null and all its rows are kept).  Rows that repeat both id and
    text are the same document and share the flag.  An empty table gives no rows.
    """
    texts = docs.select(whole_text().cast("binary").alias("text"), F.col("doc_id").cast("long").alias("id"), F.lit(b"").alias("rest"))
    groups = owner_table(texts, keep, budget).select("sha256", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    rows = docs.select("doc_id", F.unhex(F.sha2(whole_text().cast("binary"), 256)).alias("sha256"))
    # Copies of one text may be a third of all rows; adaptive execution splits that side of the join.
    return rows.join(groups, "sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


# Timestamps travel with all their six fraction digits; the default JSON format keeps three.
JSON_TIMES = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def drop_exact(docs: DataFrame, keep: str = "smallest", budget: int = TRIE_BYTES) -> DataFrame:
    """The documents that stay: one whole row per distinct text, in the columns of ``docs``.

    The other columns travel with the owner through the tries (as JSON), so only distinct texts are
    shuffled, once.  A null text equals an empty one; the row that stays keeps its own.
    """
    others = [c for c in docs.columns if c.lower() != "text"]
    flag = free_name("__no_text", docs.columns)
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in others], F.col("text").isNull().alias(flag)), {"ignoreNullFields": "false", **JSON_TIMES})
    texts = docs.select(whole_text().cast("binary").alias("text"), F.col("doc_id").cast("long").alias("id"), rest.cast("binary").alias("rest"))
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField(flag, T.BooleanType())])
    kept = owner_table(texts, keep, budget).select(F.from_json(F.col("rest").cast("string"), schema, JSON_TIMES).alias("__row"), F.col("text").cast("string").alias("text"))
    return kept.select(*[
        F.when(~F.col(f"__row.`{flag}`"), F.col("text")).alias(c) if c.lower() == "text" else F.col(f"__row.`{c}`").alias(c)
        for c in docs.columns
    ])
