"""Building blocks that stay distributed when one key holds a large share of all rows.

Every helper here is exact.  None of them moves an unbounded group into one
task: groups are cut by a hash or by value ranges, the pieces are reduced
first, and only per-piece summaries (bounded by a parameter) meet again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modsift.session import ensure_checkpoint_dir

PIECES = 64
RANGES = 1024
PIECE_ROWS = 1_000_000
HOT_KEYS = 2000
BATCH_BYTES = 8 << 20
FEW_ROWS = 100_000  # of a table that is broadcast after counting it


def bounded_batches(spark) -> None:
    """Arrow batches by bytes, so that a Python task holds little however long the rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def row_hash_pieces(columns: list[str], pieces: int = PIECES) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(pieces)).cast("int")


# --- single evaluation ------------------------------------------------------------------
def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and explodes reuse instead of recomputing.

    Catalyst moves a filter on a computed column below the projection and repeats the
    expression there; a one-element generator is a boundary it does not cross.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.explode_outer(F.array(value)).alias(name))


def stored(df: DataFrame) -> DataFrame:
    """Materialize a summary table that several later steps read (reliable checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


# --- one row per key ---------------------------------------------------------------
def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key.

    An aggregate instead of a window: every task reduces its rows to one per
    key before the shuffle, so a key held by a third of all rows costs nothing extra.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    out = df.groupBy(*keys).agg(picked.alias("__row"))
    return out.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return out.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


# --- top n rows per key ----------------------------------------------------------------
def top_n_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank_name: str = "rank", piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Rows 1..n of every key under a total order.

    Small n: Spark trims each task to n rows per key before the shuffle
    (window group limit).  Larger n: rows are counted per key, and a first ranking runs inside as many hash pieces
    of each key as its rows need, so no window sees more than ``piece_rows`` rows or n rows of each piece.
    """
    final = Window.partitionBy(*keys).orderBy(*order)
    if n <= 1000:
        return df.withColumn(rank_name, F.row_number().over(final)).where(F.col(rank_name) <= n)
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    pieces = max(1, -(-largest // max(piece_rows, 4 * n)))
    if pieces == 1:
        return df.withColumn(rank_name, F.row_number().over(final)).where(F.col(rank_name) <= n)
    others = [c for c, t in df.dtypes if c not in keys and not t.startswith("map")]
    cut = df.withColumn("__piece", row_hash_pieces(others, pieces))
    inner = Window.partitionBy(*keys, "__piece").orderBy(*order)
    cut = cut.withColumn("__r", F.row_number().over(inner)).where(F.col("__r") <= n)
    return (
        cut.withColumn(rank_name, F.row_number().over(final))
        .where(F.col(rank_name) <= n)
        .drop("__piece", "__r")
    )


# --- global rank by a uniform hash --------------------------------------------------------
def hash_rank(df: DataFrame, key: Column, seed: str, by: list[str] | None = None, hex_digits: int = 4) -> DataFrame:
    """Add ``rank`` (0-based) and ``total`` under the order of sha2(seed || key), per ``by`` group.

    The hash is uniform, so its leading hex digits cut every group into even
    buckets.  Bucket counts are a table bounded by 16**hex_digits rows per
    group; ranking runs inside buckets only.
    """
    by = by or []
    hashed = df.withColumn("__h", F.sha2(F.concat(F.lit(seed), key.cast("string")), 256)).withColumn(
        "__b", F.substring("__h", 1, hex_digits)
    )
    counts = hashed.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = counts.select(
        *by,
        "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("total"),
    )
    inside = Window.partitionBy(*by, "__b").orderBy("__h", *by)
    ranked = hashed.withColumn("__r", F.row_number().over(inside))
    joined = ranked.join(offsets, [*by, "__b"]) if not by else null_safe_join(ranked, offsets, [*by, "__b"])
    return joined.withColumn("rank", (F.col("__before") + F.col("__r") - 1).cast("long")).drop(
        "__h", "__b", "__r", "__before"
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"__k_{k}"])
    return left.join(renamed, condition, how).drop(*[f"__k_{k}" for k in keys])


# --- global position in any order ------------------------------------------------------------
def with_position(df: DataFrame, order: list[Column], name: str, rows_per_piece: int = PIECE_ROWS) -> DataFrame:
    """Number the rows of a narrow table from 0 in a total order of any type.

    The rows are cut into value ranges, sorted inside them and stored, which fixes each row's place; the ranges'
    row counts (one row per ``rows_per_piece`` rows) then give the offsets.
    """
    pieces = max(1, -(-df.count() // rows_per_piece))
    placed = df.repartitionByRange(pieces, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("__piece", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__piece").agg(F.count("*").alias("__n")).select("__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(offsets, "__piece").withColumn(name, F.col("__before") + F.col("__at")).drop("__piece", "__at", "__before")


# --- ordered cuts of a numeric column --------------------------------------------------------
def range_pieces(df: DataFrame, by: list[str], value: str, pieces: int = RANGES) -> DataFrame:
    """Add ``__piece``: the value range a row falls in, cut by quantiles of the column itself.

    ``df`` should hold one row per (by, value); ties then cannot pile up in one piece.
    Only groups with more than total/HOT_KEYS rows are cut.  By counting there are at
    most HOT_KEYS of them, so their cut points (``pieces`` numbers each) are safe to
    broadcast; every other group is small enough to stay whole, as piece 0.
    """
    if pieces <= 1:
        return df.withColumn("__piece", F.lit(0))
    v = F.col(value).cast("double")
    cut_points = F.percentile_approx(v, [i / pieces for i in range(1, pieces)], F.lit(10000)).alias("__cuts")
    if by:
        total = df.agg(F.count("*").alias("t")).scalar()
        hot = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") * HOT_KEYS > total).drop("__n")
        big_groups = null_safe_join(df, F.broadcast(hot), by, "left_semi")
        cuts = big_groups.groupBy(*by).agg(cut_points)
        with_cuts = null_safe_join(df, F.broadcast(cuts), by, "left")
    else:
        with_cuts = df.withColumn("__cuts", df.agg(cut_points).scalar())
    # Number of cut points below the value, by binary search.
    steps = [1 << i for i in range((pieces - 1).bit_length() - 1, -1, -1)]
    below = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: at + F.when(F.get("__cuts", at + step - 1) < v, step).otherwise(0),
    )
    return with_cuts.withColumn("__piece", below).drop("__cuts")


def cumulative(df: DataFrame, by: list[str], order: str, sums: dict[str, str], pieces: int | None = None) -> DataFrame:
    """Running totals *before* each row in ascending ``order``, one row per (by, order).

    ``sums`` maps new column -> summed column; ``<new>_all`` carries the group total.
    The table is stored, since it is read several times.  Its rows are cut into value ranges, one per
    PIECE_ROWS rows (at most RANGES per group); range totals are accumulated first and each range runs
    its own window.
    """
    df = stored(df)
    if pieces is None:
        pieces = min(RANGES, 1 + df.count() // PIECE_ROWS)
    cut = range_pieces(df, by, order, pieces)
    totals = cut.groupBy(*by, "__piece").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    groups = by or [F.lit(0)]  # without groups: one row per range
    w = Window.partitionBy(*groups).orderBy("__piece")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "__piece",
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(Window.partitionBy(*groups)).alias(f"{n}_all") for n in sums],
    )
    inner = Window.partitionBy(*by, "__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = null_safe_join(cut, offsets, [*by, "__piece"])
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"__o_{n}") + F.coalesce(F.sum(c).over(inner), F.lit(0)))
    return out.drop("__piece", *[f"__o_{n}" for n in sums])


def order_statistics(
    df: DataFrame, by: list[str], value: str, fractions: dict[str, float], method: str = "floor"
) -> DataFrame:
    """Exact order statistics per group, one column per named fraction.

    ``floor``: element floor(n*p) of the sorted values.  ``linear``: interpolation
    at (n-1)*p.  Equal values are counted first, so each distinct value is one row.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(
        F.count("*").alias("__n")
    )
    return counted_order_statistics(counted, by, "__v", "__n", fractions, method)


def counted_order_statistics(
    counted: DataFrame, by: list[str], value: str, times: str, fractions: dict[str, float], method: str = "floor"
) -> DataFrame:
    """``order_statistics`` of a table that has one row per group and distinct value, with its number."""
    counted = counted.select(*by, F.col(value).alias("__v"), F.col(times).alias("__n"))
    ran = cumulative(counted, by, "__v", {"__below": "__n"})
    n = F.col("__below_all")
    low, high = F.col("__below"), F.col("__below") + F.col("__n")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= low) & (rank < high), F.col("__v")))

    aggs = []
    for name, p in fractions.items():
        if method == "floor":
            percent = round(p * 100, 6)
            whole = int(percent) if percent == int(percent) else percent
            rank = F.least(F.floor(n * F.lit(whole) / F.lit(100)), n - 1)
            aggs.append(at(rank).alias(name))
        else:
            position = (n - 1) * F.lit(float(p))
            aggs += [
                at(F.floor(position)).alias(f"__lo_{name}"),
                at(F.ceil(position)).alias(f"__hi_{name}"),
                F.max(position - F.floor(position)).alias(f"__w_{name}"),
            ]
    out = ran.groupBy(*by).agg(*aggs)
    if method == "floor":
        return out
    return out.select(
        *by,
        *[
            (
                F.col(f"__lo_{k}") + (F.col(f"__hi_{k}") - F.col(f"__lo_{k}")) * F.col(f"__w_{k}")
            ).alias(k)
            for k in fractions
        ],
    )


# --- joins ---------------------------------------------------------------------------------------
def join_counted_keys(
    facts: DataFrame, keyed: DataFrame, key: str, frequency: str, how: str = "inner", hot_keys: int = HOT_KEYS, few: int = FEW_ROWS
) -> DataFrame:
    """Join many facts to one row per key when a few keys carry most facts.

    ``frequency`` in ``keyed`` says how many facts each key has.  Keys above
    total/hot_keys are at most ``hot_keys`` in number by counting, so that part is
    safe to broadcast whatever the data size.  The facts are read once: those that
    found their key in the broadcast get a salt instead of the key and spread evenly
    over the shuffle that serves all other, light keys.  At most ``few`` keys are all
    broadcast, and no fact is moved.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    keyed = stored(keyed)
    payload = [c for c in keyed.columns if c != key]
    if keyed.count() <= few:
        everything = keyed.select(key, F.struct(*payload).alias("__found"))
        return facts.join(F.broadcast(everything), key, how).select(*facts.columns, "__found.*")
    total = keyed.agg(F.sum(frequency).alias("t")).scalar()
    is_hot = F.col(frequency) * hot_keys > total
    hot = keyed.where(is_hot).select(key, F.struct(*payload).alias("__hot"))
    cold = keyed.where(~is_hot).select(F.col(key).alias("__key"), F.lit(0).alias("__salt"), F.struct(*payload).alias("__cold"))
    found = facts.join(F.broadcast(hot), key, "left")
    spread = F.hash(*[c for c, t in facts.dtypes if not t.startswith("map")])
    routed = found.withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key))).withColumn(
        "__salt", F.when(F.col("__hot").isNull(), 0).otherwise(spread)
    )
    joined = routed.join(cold, ["__key", "__salt"], "left")
    result = joined.withColumn("__found", F.coalesce("__hot", "__cold"))
    if how == "inner":
        result = result.where(F.col("__found").isNotNull())
    return result.select(*facts.columns, "__found.*")


def join_salted(facts: DataFrame, keyed: DataFrame, keys: list[str], salts: int = 32) -> DataFrame:
    """Left join to one row per key group, nulls matching; every group of facts is cut into ``salts`` parts.

    The keyed side is copied once per salt, which is cheap: it has one row per group.
    """
    spread = F.pmod(F.xxhash64(*[c for c, t in facts.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int")
    copies = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return null_safe_join(facts.withColumn("__salt", spread), copies, [*keys, "__salt"], "left").drop("__salt")


def join_few(facts: DataFrame, few: DataFrame, keys: list[str], most: int = FEW_ROWS) -> DataFrame:
    """Left join, nulls matching, to a table of one narrow row per key: broadcast if it has at most ``most`` rows, else salted."""
    few = stored(few)
    if few.count() <= most:
        return null_safe_join(facts, F.broadcast(few), keys, "left")
    return join_salted(facts, few, keys)
