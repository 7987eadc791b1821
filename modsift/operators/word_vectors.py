"""Word vectors by factorising word co-occurrence, and document vectors from them.

Co-occurrences in a window are counted as an aggregate, weighed by positive pointwise mutual information, and the
sparse matrix is factorised by implicit alternating least squares.  Counts, matrix and both factors stay distributed
tables, so the vocabulary may be of any size that has integer ids.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsift.operators import word_blocks as B
from modsift.operators.scale import join_counted_keys, join_few, stored, with_position

SEED = 42
HOT_WORDS = 20_000


def vocabulary(df: DataFrame, tokens: str, min_count: int = 5) -> DataFrame:
    """(word, n, word_id) of the words with at least ``min_count`` occurrences, ids from 0 in the words' order."""
    return _numbered(df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n")), min_count)


def _numbered(words: DataFrame, min_count: int) -> DataFrame:
    numbered = with_position(words.where(F.col("word").isNotNull() & (F.col("n") >= min_count)), [F.col("word")], "word_id")
    return stored(numbered.withColumn("word_id", F.col("word_id").cast("int")))


def token_ids(df: DataFrame, row_id: str, tokens: str, words: DataFrame) -> DataFrame:
    """(row id, position, word_id) of the tokens that are in the vocabulary; frequent words are not shuffled by word."""
    placed = df.select(F.col(row_id).alias("__row"), F.posexplode(tokens).alias("position", "word"))
    return join_counted_keys(placed, words, "word", "n").select("__row", "position", "word_id")


def row_places(ids: DataFrame) -> DataFrame:
    """(row id, places): a row's positions and word ids as whole numbers, ascending."""
    place = F.shiftleft(F.col("position").cast("long"), 32).bitwiseOR(F.col("word_id").cast("long"))
    return ids.groupBy("__row").agg(F.sort_array(F.collect_list(place)).alias("places"))


def _word(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 32) - 1))


def cooccurrences(ids: DataFrame, window: int = 5) -> DataFrame:
    """(a, b, n) with a <= b: how often two words stand at most ``window`` places apart in a row."""
    return places_cooccurrences(row_places(ids), window)


def places_cooccurrences(rows: DataFrame, window: int = 5) -> DataFrame:
    """``cooccurrences`` of ``row_places``.

    The pairs of a row are made inside it, as whole numbers, and counted in its task before any is moved.
    """
    def pair(x: Column, y: Column) -> Column:
        near = F.shiftright(y, 32) - F.shiftright(x, 32) <= window
        return F.when(near, F.shiftleft(F.least(_word(x), _word(y)), 32).bitwiseOR(F.greatest(_word(x), _word(y))))

    ahead = lambda x, i: F.array(*[pair(x, F.get("places", i + d)) for d in range(1, window + 1)])
    pairs = rows.select(F.explode(F.flatten(F.transform("places", ahead))).alias("pair")).where("pair IS NOT NULL")
    counts = pairs.groupBy("pair").agg(F.count("*").alias("n"))
    return counts.select(F.shiftright("pair", 32).cast("int").alias("a"), _word(F.col("pair")).cast("int").alias("b"), "n")


def positive_pmi(counts: DataFrame) -> DataFrame:
    """(a, b, ppmi) of all ordered pairs whose pointwise mutual information is positive."""
    counts = stored(counts)
    ends = F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b")))
    margins = stored(counts.select(ends.alias("a"), "n").groupBy("a").agg(F.sum("n").alias("m")))
    total = margins.agg(F.sum("m")).scalar()
    left, right = margins.withColumnRenamed("m", "ma"), margins.select(F.col("a").alias("b"), F.col("m").alias("mb"))
    joined = join_few(join_few(counts, left, ["a"]), right, ["b"]).withColumn("total", total)
    ppmi = F.log(F.col("n") * F.col("total") / (F.col("ma").cast("double") * F.col("mb")))
    found = joined.select("a", "b", ppmi.alias("ppmi")).where("ppmi > 0")
    one, other = F.struct("a", "b", "ppmi"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "ppmi")
    return found.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, other))))


def factorised(ppmi: DataFrame, dim: int, iterations: int, blocks: int | None = None) -> DataFrame:
    """(word_id, vector): one factor of the matrix."""
    als = ALS(rank=dim, maxIter=iterations, implicitPrefs=True, alpha=1.0, regParam=0.05, seed=SEED, userCol="a", itemCol="b", ratingCol="ppmi", checkpointInterval=2)
    if blocks:
        als = als.setNumBlocks(blocks)
    return als.fit(ppmi).userFactors.select(F.col("id").alias("word_id"), F.col("features").alias("vector"))


def _normed(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def document_vectors(rows: DataFrame, vectors: DataFrame, words: DataFrame, dim: int, hot_words: int = HOT_WORDS) -> DataFrame:
    """(row, embedding): mean of the unit vectors of a row's words, rarer words weighing more, at unit length.

    A word of relative frequency f weighs 0.001 / (0.001 + f).  Words above total / ``hot_words`` are at most
    ``hot_words`` in number by counting; their vectors are broadcast and added up where the row lies.  Only the
    rows of rarer words are moved to them.
    """
    total = words.agg(F.sum("n")).scalar()
    unit = F.transform("vector", lambda x: x.cast("double"))
    known = words.join(vectors, "word_id").withColumn("total", total)
    weight = F.lit(0.001) / (0.001 + F.col("n") / F.col("total"))
    known = stored(known.select("word_id", "n", F.transform(_normed(unit), lambda x: x * weight).alias("unit")))
    often = F.col("n") * hot_words > total
    each = rows.select("__row", F.explode("places").alias("place")).select("__row", _word(F.col("place")).cast("int").alias("word_id"))
    added = lambda df, value: df.groupBy("__row").agg(*[F.sum(value(i)).alias(f"s{i}") for i in range(dim)])
    near = added(each.join(F.broadcast(known.where(often)), "word_id"), lambda i: F.get("unit", F.lit(i)))
    rare = known.where(~often)
    if not rare.isEmpty():
        counted = each.join(F.broadcast(known.where(often).select("word_id")), "word_id", "left_anti").groupBy("word_id", "__row").agg(F.count("*").alias("times"))
        far = added(counted.join(rare, "word_id"), lambda i: F.col("times") * F.get("unit", F.lit(i)))
        near = added(near.union(far), lambda i: F.col(f"s{i}"))
    return near.select("__row", _normed(F.array(*[f"s{i}" for i in range(dim)])).alias("embedding"))


def doc_embedding(df: DataFrame, row_id: str, tokens: str, dim: int = 100, window: int = 5, min_count: int = 5, iterations: int = 10) -> DataFrame:
    """``df`` with ``embedding``, an array of ``dim`` numbers of unit length.

    Rows without a word that occurs ``min_count`` times (null and empty token lists too) have a null embedding.  Rows
    with equal tokens get equal vectors.  Row ids are unique.
    """
    spark = df.sparkSession
    blocks = B.row_blocks(df, row_id, tokens)
    words = _numbered(B.word_counts(blocks), min_count)
    size, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    nothing = df.withColumn("embedding", F.lit(None).cast("array<double>"))
    if not size:
        return nothing
    blocks = B.numbered_blocks(blocks, words)
    B.release(spark)
    parts = B.matrix(blocks, window, total, size)
    B.release(spark)
    factors = B.factorised(parts, dim, iterations, SEED)
    if factors is None:
        return nothing
    found = B.row_vectors(blocks, factors, words, dim).groupBy("__row").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dim)])
    found = found.select("__row", _normed(F.array(*[f"s{i}" for i in range(dim)])).alias("embedding"))
    return df.join(found, F.col(row_id) == F.col("__row"), "left").drop("__row")


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norms = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norms > 0, dot / norms)
