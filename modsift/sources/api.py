"""JSON payloads of text APIs to raw text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsift.operators.scale import compute_once

ITEM = "STRUCT<id: STRING, content: STRING, source: STRING, meta: MAP<STRING,STRING>>"
PAYLOAD = f"data ARRAY<{ITEM}>, has_more BOOLEAN, next_url STRING"


def _items(body: Column) -> Column:
    """Items of a payload: the object form, an array of strings, or a single string."""
    kind = F.substring(F.ltrim(body), 1, 1)
    payload = F.from_json(body, PAYLOAD, {"mode": "PERMISSIVE"})
    texts = F.from_json(body, "ARRAY<STRING>")
    single = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "ARRAY<STRING>")
    plain = F.when(kind == "[", texts).when(kind == '"', single)
    numbered = F.transform(
        plain,
        lambda x, i: F.struct(
            F.concat(F.lit("api_"), i).alias("id"), x.alias("content"), F.lit("api").alias("source"),
            F.create_map().cast("map<string,string>").alias("meta"),
        ),
    )
    return F.when(kind == "{", payload["data"]).otherwise(numbered)


def flatten_api_payloads(df: DataFrame, body: str, keep: list[str] | None = None) -> DataFrame:
    """One row per text: item_id, content, source ('api:' + item source), metadata."""
    keep = keep or []
    return (
        compute_once(df.select(*keep, body), "__items", _items(F.col(body)))
        .select(*keep, F.explode("__items").alias("__i"))
        .select(
            *keep,
            F.col("__i.id").alias("item_id"),
            F.coalesce("__i.content", F.lit("")).alias("content"),
            F.concat(F.lit("api:"), F.coalesce("__i.source", F.lit(""))).alias("source"),
            F.col("__i.meta").alias("metadata"),
        )
    )


def unreadable_payloads(df: DataFrame, body: str) -> DataFrame:
    """Payloads in none of the accepted forms."""
    return df.where(_items(F.col(body)).isNull())


def next_pages(df: DataFrame, body: str) -> DataFrame:
    payload = F.from_json(body, PAYLOAD)
    return df.select(payload["next_url"].alias("next_url"), payload["has_more"].alias("has_more")).where(
        F.coalesce("next_url", F.lit("")) != ""
    )
