"""Corpus-level vocabulary work: document frequency, TF-IDF, vocabulary tables, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modsift.functions import text as T
from modsift.operators.scale import compute_once, join_counted_keys, join_few, top_n_per_key, with_position


def term_counts(docs: DataFrame, row_id: str, tokens: str, *keep: str) -> DataFrame:
    """(row, term, tf): counted inside the row, so nothing is shuffled yet."""
    counted = compute_once(docs.select(row_id, *keep, F.size(tokens).alias("n_tokens"), tokens), "__tf", T.run_lengths(tokens))
    return counted.select(row_id, *keep, "n_tokens", F.explode("__tf").alias("__t")).select(
        row_id, *keep, "n_tokens", F.col("__t.term").alias("term"), F.col("__t.n").cast("long").alias("tf")
    )


def idf_table(docs: DataFrame, tokens: str) -> DataFrame:
    """(term, df, idf) with idf = ln(N / df) over all documents."""
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    distinct = compute_once(docs.select(tokens), "__d", F.array_distinct(tokens))
    return (
        distinct.select(F.explode("__d").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
        .withColumn("idf", F.log(n_docs / F.col("df")))
    )


def tfidf(docs: DataFrame, row_id: str, tokens: str, idf: DataFrame, max_features: int = 1000) -> DataFrame:
    """Top terms per row by tf-idf, long form (row, term, tfidf, rank); ties by term.

    The term join is skewed by nature (common words are in most rows); see
    ``join_counted_keys``.  The texts are read twice in all: for the idf table and here.
    """
    scored = join_counted_keys(term_counts(docs, row_id, tokens), idf, "term", "df").select(
        row_id, "term", (F.col("tf") / F.col("n_tokens") * F.col("idf")).alias("tfidf")
    )
    by_score = [F.desc(F.round("tfidf", 12)), F.asc("term")]
    return top_n_per_key(scored, [row_id], by_score, max_features)


def tfidf_vectors(long: DataFrame, row_id: str) -> DataFrame:
    """Long form to one map per row; a row holds at most max_features entries."""
    return long.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("term", "tfidf"))).alias("tfidf"))


def tfidf_vector_report(long: DataFrame, row_id: str) -> DataFrame:
    """Per row: dimension, non-zero entries and largest value."""
    return long.groupBy(row_id).agg(
        F.count("*").alias("dimension"),
        F.count_if(F.col("tfidf") != 0).alias("non_zero"),
        F.max("tfidf").alias("max_value"),
    )


def prune_vocabulary(
    idf: DataFrame, n_docs_col, min_df: int = 2, max_df: float = 0.8, max_features: int = 1000
) -> DataFrame:
    """Terms with df >= min_df and df/N <= max_df, the most frequent ``max_features`` of them."""
    return (
        idf.where((F.col("df") >= min_df) & (F.col("df") / n_docs_col <= max_df))
        .orderBy(F.desc("df"), F.asc("term"))
        .limit(max_features)
    )


def vocabulary_build(docs: DataFrame, row_id: str, tokens: str, language: str) -> DataFrame:
    """(word, language, frequency, doc_count, idf_score) in one pass over the tokens.

    Words are counted per document first, so one word costs one row per document.
    """
    n_docs = docs.groupBy(F.col(language).alias("language")).agg(F.count("*").alias("__n"))
    per_doc = term_counts(docs.withColumn("language", F.col(language)), row_id, tokens, "language")
    words = per_doc.groupBy(F.col("term").alias("word"), "language").agg(
        F.sum("tf").alias("frequency"), F.count("*").alias("doc_count")
    )
    return join_few(words, n_docs, ["language"]).select(
        "word",
        "language",
        "frequency",
        "doc_count",
        F.log(F.col("__n") / F.col("doc_count")).cast("decimal(10,6)").alias("idf_score"),
    )


def word_frequency_lookup(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Frequency of each asked word, 0 when the vocabulary lacks it."""
    known = vocabulary.groupBy("word").agg(F.sum("frequency").alias("frequency"))
    return words.join(known, "word", "left").select(
        "word", F.coalesce("frequency", F.lit(0)).alias("frequency")
    )


def vocabulary_index(
    docs: DataFrame, text: str, lower: bool = True, strip_punctuation: bool = True,
    stop_words: list[str] | None = None, min_word_freq: int = 1, max_vocab_size: int = 10000, ngram_max: int = 1,
) -> DataFrame:
    """(term, frequency, index): most frequent first, ties by term, index from 0.

    The vocabulary is capped by its size parameter, so numbering it is bounded work.
    """
    body = F.lower(text) if lower else F.col(text)
    if strip_punctuation:
        body = F.regexp_replace(body, "\\p{Punct}+", " ")
    tokens = F.filter(F.split(body, "\\s+"), lambda t: t != "")
    if stop_words:
        tokens = T.drop_words(tokens, stop_words)
    if ngram_max > 1:
        tokens = T.ngrams(tokens, ngram_max)
    top = (
        compute_once(docs.select(text), "__t", tokens).select(F.explode("__t").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("frequency"))
        .where(F.col("frequency") >= min_word_freq)
        .orderBy(F.desc("frequency"), F.asc("term"))
        .limit(max_vocab_size)
    )
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.desc("frequency"), F.asc("term"))
    return top.select("term", "frequency", (F.row_number().over(ordered) - 1).alias("index"))


def first_seen_words(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """(word, first_row, first_pos, index): where each lower-case blank-separated word appears first, numbered in that order."""
    split = compute_once(docs.select(row_id, text), "__w", F.split(F.lower(T.trim_control(text)), "\\s+"))
    words = split.select(row_id, F.posexplode("__w").alias("pos", "word"))
    firsts = (
        words.where(F.col("word") != "")
        .groupBy("word")
        .agg(F.min(F.struct(F.col(row_id).alias("r"), F.col("pos").alias("p"))).alias("__first"))
        .select("word", F.col("__first.r").alias("first_row"), F.col("__first.p").alias("first_pos"))
    )
    return with_position(firsts, [F.col("first_row"), F.col("first_pos")], "index")


def extract_tags(tagged: DataFrame, row_id: str, tag: str, max_tags: int = 10, min_freq: int = 3) -> DataFrame:
    """Tags seen at least ``min_freq`` times overall, the ``max_tags`` most frequent per row."""
    pairs = tagged.select(row_id, F.col(tag).alias("tag")).distinct()
    frequent = tagged.groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("freq")).where(F.col("freq") >= min_freq)
    return top_n_per_key(
        join_counted_keys(pairs, frequent, "tag", "freq"), [row_id], [F.desc("freq"), F.asc("tag")], max_tags
    )
