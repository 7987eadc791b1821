"""Per-document operators: cleaning reports, tokens, features and the full text processing chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsift import values as V
from modsift.functions import scores as S
from modsift.functions import text as T
from modsift.functions.text import as_col
from modsift.operators.scale import FEW_ROWS, compute_once, join_counted_keys, stored


# --- cleaning ----------------------------------------------------------------------
def cleaning_report(df: DataFrame, text: str, cleaned: str) -> DataFrame:
    """Per row: what cleaning removed, lengths before and after, success flag."""
    removed_specials = F.regexp_count(F.col(text), F.lit(V.SPECIAL_CHARS))
    return (
        df.withColumn("tags_removed", F.regexp_count(text, F.lit(V.HTML_TAG)))
        .withColumn("urls_removed", F.regexp_count(text, F.lit(V.URL)))
        .withColumn("specials_removed", removed_specials)
        .withColumn("length_before", T.utf16_length(text))
        .withColumn("length_after", T.utf16_length(cleaned))
        .withColumn("clean_ok", F.col("length_after") > 0)
    )


def pii_counts(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("email_count", F.regexp_count(text, F.lit(V.EMAIL))).withColumn(
        "phone_count", F.regexp_count(text, F.lit(V.PHONE))
    )


def processed_length_gate(df: DataFrame, cleaned: str, low: int = 10, high: int = 10000) -> DataFrame:
    """Mark rows outside the length range; rejects stay, to be routed to the error sink."""
    ok = S.processed_length_ok(cleaned, low, high)
    return df.withColumn("success", ok).withColumn(
        "error", F.when(~ok, F.lit("Text length out of range"))
    )


# --- tokens ----------------------------------------------------------------------------
def _lexicon_hits(df: DataFrame, row_id: str, tokens: str, lexicon: DataFrame) -> DataFrame:
    """(row id, word, columns of the lexicon) for the distinct lower-case tokens of each row that are in the lexicon.

    See ``_join_lexicon``.
    """
    words = df.select(F.col(row_id).alias("__row"), F.explode(F.array_distinct(F.transform(tokens, F.lower))).alias("__w"))
    return _join_lexicon(words, lexicon, "inner")


def _join_lexicon(words: DataFrame, lexicon: DataFrame, how: str) -> DataFrame:
    """Words (column ``__w``) with the columns of the lexicon, which has one narrow row per word.

    A lexicon of at most FEW_ROWS words is broadcast.  Else the words' numbers tell which of them most rows have;
    those are joined without a shuffle of their rows to one task.
    """
    lexicon = stored(lexicon)
    if lexicon.count() <= FEW_ROWS:
        return words.join(F.broadcast(lexicon), "__w", how)
    counted = words.groupBy("__w").agg(F.count("*").alias("__rows")).join(lexicon, "__w")
    return join_counted_keys(words, counted, "__w", "__rows", how).drop("__rows")


def remove_stop_words(
    df: DataFrame, tokens: str, stop_words: list[str] | DataFrame, row_id: str | None = None, out: str = "filtered_tokens"
) -> DataFrame:
    """Drop stop words, repeats and order kept.

    A list is a literal set inside the expression.  A DataFrame (column ``word``) of any size is joined to the
    distinct tokens of each row; ``row_id`` then names a unique column without nulls.
    """
    if not isinstance(stop_words, DataFrame):
        return df.withColumn(out, T.drop_words(tokens, stop_words))
    if row_id is None:
        raise ValueError("a stop word table needs row_id")
    lexicon = stop_words.select(F.lower("word").alias("__w")).distinct()
    hits = _lexicon_hits(df, row_id, tokens, lexicon).groupBy("__row").agg(F.collect_set("__w").alias("__gone"))
    gone = F.coalesce("__gone", F.array().cast("array<string>"))
    joined = df.join(hits, df[row_id] == F.col("__row"), "left").withColumn("__gone", gone)
    return joined.withColumn(out, F.filter(tokens, lambda t: ~F.array_contains("__gone", F.lower(t)))).drop("__row", "__gone")


def load_stop_word_file(spark, path: str) -> DataFrame:
    """Stop words from a text file, one per line, '#' starts a comment line."""
    line = T.trim_wide(F.col("value"))
    return (
        spark.read.text(path)
        .select(F.lower(line).alias("word"))
        .where((F.col("word") != "") & ~F.col("word").startswith("#"))
        .distinct()
    )


def token_counts(df: DataFrame, tokens: str, filtered: str) -> DataFrame:
    return (
        df.withColumn("total_tokens", F.size(tokens))
        .withColumn("filtered_token_count", F.size(filtered))
        .withColumn("unique_tokens", F.size(F.array_distinct(tokens)))
        .withColumn("unique_filtered_tokens", F.size(F.array_distinct(filtered)))
        .withColumn("removed_tokens", F.array_except(tokens, filtered))
    )


def token_quality(df: DataFrame, tokens: str) -> DataFrame:
    han = F.size(F.filter(as_col(tokens), lambda t: t.rlike(f"[{V.HAN_WIDE}]")))
    return df.withColumn("avg_token_length", T.mean_length(tokens)).withColumn(
        "han_token_share", S.ratio(han, F.size(tokens))
    )


# --- feature groups ------------------------------------------------------------------------
def text_counts(text: Column | str) -> Column:
    """Character and piece counts every feature group starts from.

    Lower-case ASCII letters are taken out first; all other classes are counted on the
    much shorter rest.  Cased letters outside the basic plane do not count as cased.
    """
    text = as_col(text)
    basic = "&&[^\\x{10000}-\\x{10FFFF}]"

    def counts(rest: Column) -> Column:
        removed = F.length(text) - F.length(rest)
        return F.struct(
            T.utf16_length(text).alias("chars"),
            T.sentence_count(text).alias("sentences"),
            T.paragraph_count(text).alias("paragraphs"),
            T.count_class(rest, "\\p{Punct}").alias("punctuation"),
            T.count_class(rest, "\\d").alias("digits"),
            T.count_class(rest, "\\p{IsUppercase}" + basic).alias("upper"),
            (removed + T.count_class(rest, "\\p{IsLowercase}" + basic)).alias("lower"),
            T.count_class(rest, "\\s").alias("blanks"),
            T.count_class(rest, V.HAN_NARROW).alias("han"),
            (removed + T.count_class(rest, "A-Z")).alias("latin"),
        )

    return T.let(F.regexp_replace(text, "[a-z]+", ""), counts)


def statistical_from(counts: Column, tokens: Column | str) -> Column:
    tokens = as_col(tokens)
    n, words = counts["chars"], F.size(tokens)
    return F.struct(
        n.alias("text_length"),
        words.alias("word_count"),
        counts["sentences"].alias("sentence_count"),
        counts["paragraphs"].alias("paragraph_count"),
        T.mean_length(tokens).alias("avg_word_length"),
        S.ratio(n, counts["sentences"]).alias("avg_sentence_length"),
        counts["punctuation"].alias("punctuation_count"),
        counts["digits"].alias("digit_count"),
        counts["upper"].alias("uppercase_count"),
        counts["lower"].alias("lowercase_count"),
        counts["blanks"].alias("whitespace_count"),
        (n - counts["upper"] - counts["lower"] - counts["digits"] - counts["blanks"]).alias("special_char_count"),
        S.ratio(words, n).alias("lexical_density"),
        S.ratio(F.size(F.array_distinct(tokens)), words).alias("type_token_ratio"),
    )


def statistical_features(df: DataFrame, text: str, tokens: str) -> DataFrame:
    counted = df.withColumn("__counts", text_counts(text))
    return counted.withColumn("statistical", statistical_from(F.col("__counts"), tokens)).drop("__counts")


def _sentiment_from_counts(positive: Column, negative: Column, total_tokens: Column) -> Column:
    hits = positive + negative
    polarity = S.ratio(positive - negative, hits)
    return F.struct(
        polarity.alias("polarity"),
        S.ratio(hits, total_tokens).alias("intensity"),
        F.when(polarity > 0.1, "positive").when(polarity < -0.1, "negative").otherwise("neutral").alias(
            "sentiment_class"
        ),
        F.abs(polarity).alias("confidence"),
        positive.alias("positive_words"),
        negative.alias("negative_words"),
        hits.alias("sentiment_words"),
    )


def sentiment_struct(
    tokens: Column | str, positive: list[str] | None = None, negative: list[str] | None = None
) -> Column:
    positive = V.POSITIVE_WORDS if positive is None else positive
    negative = V.NEGATIVE_WORDS if negative is None else negative
    only_negative = [w for w in negative if w.lower() not in {p.lower() for p in positive}]
    return _sentiment_from_counts(
        T.count_words(tokens, positive), T.count_words(tokens, only_negative), F.size(as_col(tokens))
    )


def sentiment_features(
    df: DataFrame, tokens: str, lexicon: list[tuple[str, int]] | DataFrame | None = None, row_id: str | None = None
) -> DataFrame:
    """Sentiment struct from filtered tokens.

    ``lexicon``: a list of (word, +1 or -1) becomes literals; a DataFrame (word, polarity) is joined by ``row_id``.
    """
    if lexicon is None:
        return df.withColumn("sentiment", sentiment_struct(tokens))
    if isinstance(lexicon, DataFrame):
        if row_id is None:
            raise ValueError("a lexicon table needs row_id")
        return sentiment_by_join(df, row_id, tokens, lexicon)
    positive, negative = ([w for w, p in lexicon if (p > 0) == up and p] for up in (True, False))
    return df.withColumn("sentiment", sentiment_struct(tokens, positive, negative))


def sentiment_by_join(df: DataFrame, row_id: str, tokens: str, lexicon: DataFrame) -> DataFrame:
    """Sentiment with a lexicon of any size, joined to the tokens of each row.

    The hits are counted per id and hash of the tokens and divided by the rows that have both, so ids may repeat.  The
    tokens themselves are not moved unless the result is asked for them.
    """
    keyed = lexicon.groupBy(F.lower("word").alias("__w")).agg(F.max("polarity").alias("__pol"))
    mark = F.xxhash64(F.col(tokens))
    marked = compute_once(df.select(F.col(row_id).alias("__row"), tokens), "__mark", mark)  # before the explode, that rows are not copied
    words = marked.select("__row", "__mark", F.posexplode(tokens).alias("__at", "__w"))
    hits = _join_lexicon(words.withColumn("__w", F.lower("__w")), keyed, "left").groupBy("__row", "__mark").agg(
        *[(F.count_if(c) / F.count_if(F.col("__at") == 0)).cast("int").alias(n) for n, c in (("__up", F.col("__pol") > 0), ("__down", F.col("__pol") < 0))]
    )
    own = df.withColumns({"__n": F.size(tokens), "__own": mark})
    joined = own.join(hits, (own[row_id] == hits["__row"]) & (own["__own"] == hits["__mark"]), "left")
    up, down = (F.when(F.col("__n").isNotNull(), F.coalesce(c, F.lit(0))) for c in ("__up", "__down"))
    return joined.withColumn("sentiment", _sentiment_from_counts(up, down, F.col("__n"))).drop("__row", "__mark", "__own", "__up", "__down", "__n")


def complexity_score(filtered: Column | str) -> Column:
    filtered = as_col(filtered)
    n = F.size(filtered)
    variety = F.size(F.array_distinct(filtered)) / n
    return F.when(
        n > 0, variety * 0.6 + F.least(T.mean_length(filtered) / 10.0, F.lit(1.0)) * 0.4
    ).otherwise(F.lit(0.0))


def readability_from(sentences: Column, filtered: Column | str) -> Column:
    filtered = as_col(filtered)
    n = F.size(filtered)
    raw = 1.0 / (1.0 + 0.1 * (n / sentences) + 0.05 * T.mean_length(filtered))
    return F.when((sentences > 0) & (n > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(
        F.lit(0.0)
    )


def readability_score(text: Column | str, filtered: Column | str) -> Column:
    return T.let(T.sentence_count(text), lambda sentences: readability_from(sentences, filtered))


def language_from(counts: Column, filtered: Column | str, sensitive: list[str] | None = None) -> Column:
    filtered = as_col(filtered)
    sensitive = V.SENSITIVE_WORDS if sensitive is None else sensitive
    n = counts["chars"]
    zh, en = S.ratio(counts["han"], n), S.ratio(counts["latin"], n)
    hits = T.count_words(filtered, sensitive)
    return F.struct(
        zh.alias("chinese_ratio"),
        en.alias("english_ratio"),
        S.ratio(counts["digits"], n).alias("digit_ratio"),
        S.ratio(counts["punctuation"], n).alias("punctuation_ratio"),
        F.when(zh > en, "zh").otherwise("en").alias("language"),
        F.greatest(zh, en).alias("language_confidence"),
        complexity_score(filtered).alias("complexity"),
        readability_from(counts["sentences"], filtered).alias("readability"),
        (hits > 0).alias("has_sensitive_words"),
        hits.alias("sensitive_words"),
    )


def language_features(df: DataFrame, text: str, filtered: str, sensitive: list[str] | None = None) -> DataFrame:
    counted = df.withColumn("__counts", text_counts(text))
    return counted.withColumn("language", language_from(F.col("__counts"), filtered, sensitive)).drop("__counts")


def ngram_features(df: DataFrame, row_id: str, tokens: str, n: int = 2, max_features: int = 1000) -> DataFrame:
    """Top n-gram counts per row in long form (row, ngram, count, rank); ties by ngram.

    Counting and ranking stay inside the row: no shuffle.
    """
    top = T.top_counts(T.run_lengths(T.ngrams(tokens, n)), max_features)
    rows = compute_once(df.select(row_id, tokens), "__top", top).select(row_id, F.posexplode("__top").alias("__p", "__g"))
    return rows.select(
        row_id, F.col("__g.term").alias("ngram"), (-F.col("__g.neg")).cast("long").alias("ngram_count"), (F.col("__p") + 1).alias("rank")
    )


def feature_dimension(tfidf: Column | str, embedding: Column | str, grams: Column | str) -> Column:
    """Size of the joined feature vector: sparse parts plus 14 + 6 + 8 fixed fields."""
    return (
        F.coalesce(F.size(as_col(tfidf)), F.lit(0))
        + F.coalesce(F.size(as_col(embedding)), F.lit(0))
        + F.coalesce(F.size(as_col(grams)), F.lit(0))
        + F.lit(14 + 6 + 8)
    )


def ngram_map(tokens: Column | str, n: int = 2, max_features: int = 1000) -> Column:
    """The most frequent n-grams of a row with their counts, as a map; ties by n-gram.  Needs no shuffle."""
    top = T.top_counts(T.run_lengths(T.ngrams(tokens, n)), max_features)
    return F.map_from_entries(F.transform(top, lambda g: F.struct(g["term"], (-g["neg"]).cast("int"))))


def extract_features(
    df: DataFrame, row_id: str, tokens: str = "filtered_tokens", tfidf: DataFrame | None = None, embeddings: DataFrame | None = None,
    ngrams: int | None = 2, max_features: int = 1000,
) -> DataFrame:
    """Composite features of processed texts: tfidf_vector, word_vector and ngram_features beside the groups that ``df`` has.

    ``tfidf``: long form (row id, term, tfidf) of the terms to keep; ``embeddings``: (row id, embedding); ``ngrams``: the
    n of the n-grams.  A group that is not given is absent (null), as is one of a row without tokens; a row that failed
    has none.  ``feature_summary`` holds the dimensions.  Row ids are unique.
    """
    some = F.coalesce(F.size(tokens) > 0, F.lit(False))
    out = df
    if tfidf is not None:
        vectors = tfidf.groupBy(F.col(row_id).alias("__row")).agg(F.map_from_entries(F.collect_list(F.struct("term", "tfidf"))).alias("tfidf_vector"))
        out = out.join(vectors, F.col(row_id) == F.col("__row"), "left").drop("__row")
    else:
        out = out.withColumn("tfidf_vector", F.lit(None).cast("map<string,double>"))
    if embeddings is not None:
        vectors = embeddings.select(F.col(row_id).alias("__row"), F.col("embedding").alias("word_vector"))
        out = out.join(vectors, F.col(row_id) == F.col("__row"), "left").drop("__row")
    else:
        out = out.withColumn("word_vector", F.lit(None).cast("array<double>"))
    grams = F.when(some, ngram_map(tokens, ngrams, max_features)) if ngrams else F.lit(None).cast("map<string,int>")
    out = compute_once(out, "ngram_features", grams)
    return out.withColumn("feature_summary", feature_summary("tfidf_vector", "word_vector", "ngram_features", *[c if c in df.columns else None for c in ("statistical", "sentiment", "language")]))


def feature_summary(tfidf: str, embedding: str, grams: str, statistical: str | None, sentiment: str | None, language: str | None) -> Column:
    """Which feature groups a row has, and their dimensions; the fixed groups count 14, 6 and 8 fields."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    has = lambda c: F.col(c).isNotNull() if c else F.lit(False)
    fixed = sum((F.when(has(c), n).otherwise(0) for c, n in ((statistical, 14), (sentiment, 6), (language, 8))), F.lit(0))
    return F.struct(
        (size(tfidf) + size(embedding) + size(grams) + fixed).alias("total_dimension"),
        (size(tfidf) > 0).alias("has_tfidf"), (size(embedding) > 0).alias("has_word_vector"), (size(grams) > 0).alias("has_ngram"),
        has(sentiment).alias("has_sentiment"), has(language).alias("has_language"),
        size(tfidf).alias("tfidf_dimension"), size(embedding).alias("word_vector_dimension"), size(grams).alias("ngram_dimension"),
    )


# --- the whole chain --------------------------------------------------------------------------
def process_texts(
    df: DataFrame,
    text: str = "content",
    stop_words: list[str] | None = None,
    positive: list[str] | None = None,
    negative: list[str] | None = None,
    sensitive: list[str] | None = None,
    steps: tuple[str, ...] = T.DEFAULT_CLEANING,
    lower: bool = False,
) -> DataFrame:
    """Clean, gate by length, tokenize, drop stop words, extract features.

    Narrow work only (no shuffle), so the same function serves batch and streams.
    Rows that fail the gate keep success=false and null features.
    """
    stop_words = V.STOP_WORDS if stop_words is None else stop_words
    out = compute_once(df, "cleaned", T.clean_text(text, steps))
    out = processed_length_gate(out, "cleaned")
    ok = F.col("success")
    out = compute_once(out, "tokens", F.when(ok, T.tokenize("cleaned", lower=lower)))
    out = compute_once(out, "filtered_tokens", F.when(ok, T.drop_words("tokens", stop_words)))
    # Counted once; the feature groups below only combine numbers.
    out = compute_once(out, "__counts", F.when(ok, text_counts("cleaned")))
    counts = F.col("__counts")
    return (
        out.withColumn("statistical", F.when(ok, statistical_from(counts, "tokens")))
        .withColumn("sentiment", F.when(ok, sentiment_struct("filtered_tokens", positive, negative)))
        .withColumn("language", F.when(ok, language_from(counts, "filtered_tokens", sensitive)))
        .withColumn(
            "processing_metadata",
            F.struct(
                T.utf16_length(text).alias("original_length"),
                T.utf16_length("cleaned").alias("cleaned_length"),
                F.size("tokens").alias("token_count"),
                F.array_except("tokens", "filtered_tokens").alias("removed_tokens"),
                S.reduction_ratio(text, "cleaned").alias("reduction_ratio"),
            ),
        )
        .drop("__counts")
    )


# --- forum records -------------------------------------------------------------------------------
def forum_features(df: DataFrame, content: str = "content") -> DataFrame:
    zero = F.lit(0)
    kind = F.col("type")
    return (
        df.withColumn("mentions", T.extract_mentions(content))
        .withColumn("topics", T.extract_topics(content))
        .withColumn("site_urls", T.extract_site_urls(content))
        .withColumn("vote_count0", F.coalesce("vote_count", zero))
        .withColumn("comment_count0", F.coalesce("comment_count", zero))
        .withColumn("is_answer", F.coalesce(kind == "answer", F.lit(False)))
        .withColumn("is_question", F.coalesce(kind == "question", F.lit(False)))
    )


def engagement_rates(
    df: DataFrame, votes="vote_count", comments="comment_count", favorites="favorite_count",
    shares="share_count", views="view_count",
) -> DataFrame:
    total = S.total_of(votes, comments, favorites, shares)
    out = (
        df.withColumn("total_interactions", total)
        .withColumn("interaction_rate", S.rate(total, views))
        .withColumn("like_rate", S.rate(votes, views))
        .withColumn("comment_rate", S.rate(comments, views))
        .withColumn("favorite_rate", S.rate(favorites, views))
    )
    return out.withColumn("high_engagement", S.high_engagement("total_interactions", "interaction_rate"))


def build_metadata(source: str, fields: dict[str, str]) -> Column:
    """String map of record fields; absent values stay out of the map."""
    entries = F.array(
        F.struct(F.lit("source").alias("k"), F.lit(source).alias("v")),
        *[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in fields.items()],
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
