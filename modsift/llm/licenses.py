"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies.

Words are runs of letters and digits, without case; five in a row make a shingle.  A window is as long as
the template it may hold; windows of the search begin at every tenth of that length.  A place where four fifths of a
template stand lies at most half a stride beside such a window, which then has a Jaccard similarity of at least
0.6 to the template and shares one of 12 bands of one hash with a probability above 0.99998.  After a hit every
start less than a stride away is verified, so what is found does not depend on where the windows begin.
Windows with too few template shingles to hold a template get no signature, which loses nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsift.llm.common import checkpointed, whole_text
from modsift.operators.scale import compute_once

WORDS = 5
BANDS = 12
CONTAINMENT = 0.8
MOST_SHINGLES = 50_000


def license_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_shingles(df: DataFrame, text: str, name: str) -> DataFrame:
    df = compute_once(df, "__w", F.transform(license_words(F.col(text)), lambda w: F.xxhash64(w)))
    last = F.size("__w") - WORDS
    shingles = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WORDS)])))
    return compute_once(df, name, F.coalesce(shingles, F.array().cast("array<bigint>"))).drop("__w")


def band_values(shingles: Column) -> list[Column]:
    def band(j: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(j))))

    return [band(j) for j in range(BANDS)]


def stride_of(length: int) -> int:
    return max(1, length // 10)


def windows_of(length: int, least: int) -> Column:
    """Windows of ``length`` shingles with at least ``least`` hits, among those that begin at a multiple of the stride.

    ``part`` begins a stride before the window (``base``) and ends a stride behind it, for the verification.
    """
    stride = stride_of(length)
    first = lambda p: F.greatest(F.lit(0), F.ceil((p - (length - 1)) / stride).cast("int"))
    last = lambda p: F.floor(p / stride).cast("int")
    none = F.array().cast("array<int>")
    near = F.flatten(F.transform("hits", lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p))).otherwise(none)))
    held = lambda k: F.size(F.filter("hits", lambda p: (p >= k * stride) & (p < k * stride + length)))
    base = lambda k: F.greatest(F.lit(0), k * stride - (stride - 1))
    wide = F.filter(F.array_distinct(near), lambda k: held(k) >= least)
    return F.transform(
        wide,
        lambda k: F.struct(
            F.lit(length).alias("length"), (k * stride).alias("at"), base(k).alias("base"),
            F.slice("shingles", base(k) + 1, length + 2 * (stride - 1)).alias("part"),
        ),
    )


def prepared_templates(templates: DataFrame) -> DataFrame:
    """license_id, shingles, length (in shingles).  Templates need five words; all together at most 50 000 shingles."""
    ready = with_shingles(templates.select("license_id", whole_text().alias("text")), "text", "shingles")
    ready = checkpointed(ready.select("license_id", "shingles", F.size("shingles").alias("length")))
    short, total = ready.agg(F.sum((F.col("length") == 0).cast("int")), F.sum("length")).first()
    if short:
        raise ValueError("a template needs at least five words")
    if (total or 0) > MOST_SHINGLES:
        raise ValueError(f"more than {MOST_SHINGLES} template shingles; scan with parts of the templates")
    return ready


def scan_licenses(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Per doc_id, text and license found: containment (best window), first_word, n_windows (starts of windows that match).

    The windows of a match begin at any word.  Null and empty texts match nothing; rows that repeat id and text are one
    document, rows without an id or with another text under the same id are documents of their own.  Texts of
    any length are searched whole; other columns are ignored.  An empty table of documents or templates gives no rows.
    """
    ready = prepared_templates(templates)
    known = sorted({s for r in ready.select("shingles").collect() for s in r.shingles})  # at most MOST_SHINGLES
    sizes = ready.groupBy("length").agg(F.min(F.size(F.array_distinct("shingles"))).alias("least")).collect()
    needed = {r.length: math.ceil(containment * r.least - 1e-9) - -(-stride_of(r.length) // 2) for r in sizes}
    text = whole_text()
    rows = with_shingles(docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text")), "text", "shingles")
    rows = compute_once(rows.drop("text"), "hits", F.filter(F.sequence(F.lit(0), F.size("shingles") - 1), lambda i: F.get("shingles", i).isin(known) if known else F.lit(False)))
    rows = rows.where(F.size("hits") > 0)
    windows = [windows_of(n, max(1, least)) for n, least in sorted(needed.items())]
    empty = "array<struct<length:int,at:int,base:int,part:array<bigint>>>"
    cut = rows.select("doc_id", "h", F.inline(F.concat(*windows).cast(empty) if windows else F.array().cast(empty)))
    window = F.slice("part", F.col("at") - F.col("base") + 1, F.col("length"))
    banded = compute_once(cut, "window", window).select("*", F.posexplode(F.array(*band_values(F.col("window")))).alias("band", "value")).drop("window")
    keys = F.broadcast(ready.select("license_id", "length", "shingles", F.posexplode(F.array(*band_values(F.col("shingles")))).alias("band", "value")))
    met = banded.join(keys, ["length", "band", "value"])
    # A window may meet a template in many bands; its rows are in one task, so they become one before they move.
    place = ["doc_id", "h", "license_id", "length", "at"]
    once = met.groupBy(*place).agg(F.first("base").alias("base"), F.first("part").alias("part"), F.first("shingles").alias("shingles"))
    beside = F.greatest(F.lit(1), F.floor(F.col("length") / 10).cast("int")) - 1
    held = F.col("base") + F.size("part")
    starts = F.sequence(F.col("base"), F.least(F.col("at") + beside, held - 1))
    tried = once.select(*place, "base", "part", "shingles", F.explode(starts).alias("start"))
    share = F.size(F.array_intersect(F.slice("part", F.col("start") - F.col("base") + 1, F.col("length")), "shingles")) / F.size(F.array_distinct("shingles"))
    found = tried.select("doc_id", "h", "license_id", "start", share.alias("share")).where(F.col("share") >= containment).distinct()
    return found.groupBy("doc_id", "h", "license_id").agg(
        F.max("share").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count("*").alias("n_windows")
    ).drop("h")
