"""Registry of runnable queries and, where SQL can say the same, their SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# Tables whose rows are whole texts.  A session may set this to the number of partitions they are dealt to, for
# files with fewer row groups than the machine has cores; by default the scan's splits stay.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}
SPREAD = "spark.modsift.text.partitions"


class Tables:
    """The parquet tables of one data folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        spread = self.spark.conf.get(SPREAD, None) if name in TEXT_TABLES else None
        return df.repartition(int(spread), TEXT_TABLES[name]) if spread else df


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
