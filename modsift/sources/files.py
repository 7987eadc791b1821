"""Text, CSV, JSON and JSON-lines files as raw text rows: id, content, source, metadata.

Reading and shaping are split, so the shaping also runs on rows that come from a
table or a stream.  ``max_count`` is the collection job's own limit; by default
everything is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modsift import values as V
from modsift.functions import text as T
from modsift.operators.relational import union_sources
from modsift.operators.scale import compute_once, stored

ITEM_SCHEMA = "content STRING, source STRING, meta MAP<STRING,STRING>"
FEW_BLOCKS = 50_000  # rows of a block table that is broadcast, some hundred bytes each


def _file_name(path: Column) -> Column:
    return F.url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))


def _raw(df: DataFrame, content: Column, source: Column, metadata: Column, keep: list[str]) -> DataFrame:
    """Ids hash file and content: a replay gives the same ids, so appends can be made idempotent."""
    shaped = df.select(*keep, content.alias("content"), source.alias("source"), metadata.alias("metadata"))
    return shaped.withColumn("id", F.sha2(F.concat_ws("|", F.col("source"), F.to_json("metadata"), F.col("content")), 256))


def _filtered(df: DataFrame, rules: list[str] | None, max_count: int | None) -> DataFrame:
    out = df.where(T.collection_filter("content", "file", rules))
    return out.limit(max_count) if max_count else out


# --- shaping -------------------------------------------------------------------------
def _place(path: str, number: str | None) -> Column:
    """Metadata that say where a text stands: file_path and, if known, line_num."""
    entries = [F.lit("file_path"), F.col(path)]
    return F.create_map(*entries, F.lit("line_num"), F.col(number).cast("string")) if number else F.create_map(*entries)


def lines_to_texts(
    lines: DataFrame, line: str, path: str, rules: list[str] | None = None, max_count: int | None = None, keep: list[str] | None = None, number: str | None = None
) -> DataFrame:
    rows = _raw(lines, T.trim_wide(line), F.concat(F.lit("file:"), _file_name(F.col(path))), _place(path, number), keep or [])
    return _filtered(rows, rules, max_count)


def pick_text_column(columns: list[str], wanted: str | None = None) -> str:
    """The named column, else the first of the known names in their order, else the first column."""
    if wanted in columns:
        return wanted
    for name in V.TEXT_COLUMN_NAMES:
        for column in columns:
            if column.lower() == name:
                return column
    return columns[0]


def table_to_texts(rows: DataFrame, path: str, text_column: str | None = None, rules: list[str] | None = None, max_count: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows of a parsed CSV: one column is the text, all others become metadata."""
    columns = [c for c in rows.columns if c != path and c not in (keep or [])]
    text = pick_text_column(columns, text_column)
    entries = [F.struct(F.lit("file_path").alias("k"), F.col(path).alias("v"))] + [
        F.struct(F.lit(c).alias("k"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("v"))
        for c in columns if c != text
    ]
    shaped = _raw(
        rows.where(F.col(f"`{text}`").isNotNull()), T.trim_wide(F.col(f"`{text}`")),
        F.concat(F.lit("csv:"), _file_name(F.col(path))), F.map_from_entries(F.array(*entries)), keep or [],
    )
    return _filtered(shaped, rules, max_count)


def items_to_texts(
    items: DataFrame, path: str, kind: str, rules: list[str] | None = None, max_count: int | None = None, keep: list[str] | None = None, number: str | None = None
) -> DataFrame:
    """Rows of {content, source, meta}; item metadata wins over file metadata."""
    meta = F.coalesce(F.col("meta"), F.create_map().cast("map<string,string>"))
    base = F.map_filter(_place(path, number), lambda k, v: ~F.map_contains_key(meta, k))
    source = F.when(F.coalesce(F.col("source"), F.lit("")) != "", F.col("source")).otherwise(
        F.concat(F.lit(f"{kind}:"), _file_name(F.col(path)))
    )
    shaped = _raw(
        items.withColumn("content", F.coalesce("content", F.lit(""))), F.col("content"), source,
        F.map_concat(base, meta), keep or [],
    )
    return _filtered(shaped, rules, max_count)


def parse_json_lines(lines: DataFrame, line: str) -> DataFrame:
    """Parse one object per line; ``bad_line`` keeps what could not be parsed, blank lines vanish."""
    body = T.trim_wide(line)
    schema = ITEM_SCHEMA + ", bad_line STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"}
    parsed = compute_once(lines.where(body != ""), "__item", F.from_json(body, schema, options))
    return parsed.select(*lines.columns, "__item.*")


def split_good_bad(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.where(F.col("bad_line").isNull()).drop("bad_line"), parsed.where(F.col("bad_line").isNotNull())


def explode_json_array(files: DataFrame, body: str) -> DataFrame:
    """A JSON array of items in one column to one row per item."""
    parsed = compute_once(files, "__items", F.from_json(body, f"ARRAY<STRUCT<{ITEM_SCHEMA}>>"))
    keep = [c for c in files.columns if c != body]
    return parsed.select(*keep, F.explode("__items").alias("__item")).select(*keep, "__item.*")


# --- reading ----------------------------------------------------------------------------
def _path() -> Column:
    return F.col("_metadata.file_path").alias("__path")


def _block() -> Column:
    return F.col("_metadata.file_block_start").alias("__at")


def _numbered(columns: list[str]):
    """Rows of a scan with their number inside their block, in the order of the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = None, 0
        for batch in batches:
            path, at = batch.column(columns.index("__path")).dictionary_encode(), batch.column(columns.index("__at")).to_numpy()
            names, codes = path.dictionary.to_pylist(), path.indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (at[1:] != at[:-1])])) if len(at) else []
            number = np.empty(len(at), np.int64)
            for a, b in zip(first, [*first[1:], len(at)]):
                now = (names[codes[a]], int(at[a]))
                seen = seen if now == block else 0
                number[a:b] = np.arange(seen + 1, seen + 1 + b - a)
                block, seen = now, seen + b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=[*columns, "__in_block"])

    return run


def with_line_numbers(lines: DataFrame, name: str = "line_num") -> DataFrame:
    """Rows of splittable files with their number in the file, from 1.

    ``lines`` are rows as a scan gives them, with __path and __at (where the scanned block begins); filters may
    have gone before, then the number counts what they left.  Rows are counted per block first; the sums of
    the blocks before a block and the place inside it give the number, so no file is one task's work and
    no row is moved.
    """
    counts = stored(lines.groupBy("__path", "__at").agg(F.count("*").alias("__n")))
    before = Window.partitionBy("__path").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__path", "__at", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    few = counts.count() <= FEW_BLOCKS
    types = ", ".join([f"`{c}` {t}" for c, t in lines.dtypes])
    numbered = lines.mapInArrow(_numbered(lines.columns), f"{types}, __in_block long")
    joined = numbered.join(F.broadcast(offsets) if few else offsets, ["__path", "__at"])
    return joined.withColumn(name, F.col("__before") + F.col("__in_block")).drop("__before", "__in_block")


def read_text_lines(spark: SparkSession, paths, rules=None, max_count=None) -> DataFrame:
    """Lines of text files; ``line_num`` counts the collected lines of a file, as the collector does."""
    lines = spark.read.text(paths).select("value", _path(), _block())
    kept = lines.where(T.collection_filter(T.trim_wide("value"), "file", rules))
    return lines_to_texts(with_line_numbers(kept), "value", "__path", rules, max_count, number="line_num")


def _csv_by_header(spark: SparkSession, paths, delimiter: str, **options: str) -> list[DataFrame]:
    """One table per distinct header line: files with other columns are other tables.

    The first line of every file is found with its place in the file, so the files are listed, not read by the driver.
    """
    lines = spark.read.options(**options).text(paths, wholetext=False).select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("at"))
    heads = lines.where(F.col("at") == 0).withColumn("n", F.monotonically_increasing_id()).groupBy("p").agg(F.min_by("value", "n").alias("head"))
    groups = heads.groupBy("head").agg(F.collect_list("p").alias("files")).collect()  # file names
    return [
        spark.read.csv(g.files, header=True, sep=delimiter, mode="DROPMALFORMED", multiLine=True, escape='"').select("*", _path())
        for g in sorted(groups, key=lambda g: g["head"])
    ]


def read_csv_texts(spark: SparkSession, paths, delimiter: str = ",", text_column: str | None = None, rules=None, max_count=None) -> DataFrame:
    """CSV files, each with its own header and perhaps line breaks inside quotes; records of the wrong width are dropped."""
    parts = [table_to_texts(rows, "__path", text_column, rules, max_count) for rows in _csv_by_header(spark, paths, delimiter)]
    return union_sources(*parts)


def read_json_array_texts(spark: SparkSession, paths, rules=None, max_count=None) -> DataFrame:
    """Files that hold one JSON array each; a file is one task's work, so keep them small."""
    items = spark.read.schema(ITEM_SCHEMA).json(paths, multiLine=True).select("*", _path())
    return items_to_texts(items, "__path", "json", rules, max_count)


def read_jsonl_texts(spark: SparkSession, paths, rules=None, max_count=None) -> DataFrame:
    """One JSON object per line; ``line_num`` is the line of the file."""
    lines = with_line_numbers(spark.read.text(paths).select("value", _path(), _block()))
    good, _ = split_good_bad(parse_json_lines(lines, "value"))
    return items_to_texts(good, "__path", "jsonl", rules, max_count, number="line_num")


def count_bad_json_lines(spark: SparkSession, paths) -> DataFrame:
    _, bad = split_good_bad(parse_json_lines(spark.read.text(paths).select("value", _path()), "value"))
    return bad.groupBy(F.col("__path").alias("file_path")).agg(F.count("*").alias("bad_lines"))


def read_texts_by_extension(spark: SparkSession, folder: str, rules=None) -> DataFrame:
    """Every file of a folder by its extension; unknown extensions are read as text."""
    known = ["csv", "json", "jsonl"]
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    listed = spark.read.format("binaryFile").load(folder).select(F.when(ext.isin(known), ext).otherwise("txt").alias("kind"))
    kinds = {r.kind for r in listed.distinct().collect()}  # at most four names
    frames = []
    if "csv" in kinds:
        frames += [table_to_texts(rows, "__path", None, rules) for rows in _csv_by_header(spark, folder, ",", pathGlobFilter="*.[cC][sS][vV]")]
    if "json" in kinds:
        items = spark.read.option("pathGlobFilter", "*.[jJ][sS][oO][nN]").schema(ITEM_SCHEMA).json(folder, multiLine=True)
        frames.append(items_to_texts(items.select("*", _path()), "__path", "json", rules))
    if "jsonl" in kinds:
        lines = with_line_numbers(spark.read.option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").text(folder).select("value", _path(), _block()))
        good, _ = split_good_bad(parse_json_lines(lines, "value"))
        frames.append(items_to_texts(good, "__path", "jsonl", rules, number="line_num"))
    if "txt" in kinds:
        lines = spark.read.text(folder).select("value", _path(), _block())
        lines = lines.where(~F.lower("__path").rlike(r"\.(csv|json|jsonl)$") & T.collection_filter(T.trim_wide("value"), "file", rules))
        frames.append(lines_to_texts(with_line_numbers(lines), "value", "__path", rules, number="line_num"))
    return union_sources(*frames)


def load_labeled_csv(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, str]:
    """A feature table and its target (the last column); give a schema to avoid the inference pass."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df, df.columns[-1]


def class_count(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.count_distinct(target).alias("class_count"), F.count("*").alias("rows"))


def scan_table(spark: SparkSession, fmt: str, **options: str) -> DataFrame:
    """A stored table (parquet, jdbc, ...); filters on it are pushed to the source by Spark."""
    path = options.pop("path", None)
    reader = spark.read.format(fmt).options(**options)
    return reader.load(path) if path else reader.load()
