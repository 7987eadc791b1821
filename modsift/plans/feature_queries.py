"""Queries: document features, corpus statistics, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsift.functions import scores as S
from modsift.functions import text as T
from modsift.operators import corpus as C
from modsift.operators import features as X
from modsift.operators import relational as R
from modsift.operators.scale import compute_once, stored, top_n_per_key
from modsift.plans import fixtures as fx
from modsift.plans.registry import query
from modsift.plans.text_queries import NEG, POS, SENSITIVE, STOP, STOP_SQL

MIXED_TOKENS = f"""{fx.MIXED_SQL}, tokens AS (SELECT doc_id, lang, source, text, {fx.tok('text')} AS tk FROM mixed),
kept AS (SELECT *, list_filter(tk, lambda x: x NOT IN {STOP_SQL}) AS k FROM tokens)"""
DOC_TOKENS = f"""tokens AS (SELECT doc_id, lang, source, {fx.tok('text')} AS tk FROM documents),
kept AS (SELECT doc_id, lang, source, list_filter(tk, lambda x: x NOT IN {STOP_SQL}) AS k FROM tokens),
words AS (SELECT doc_id, lang, unnest(k) AS term FROM kept)"""


def mixed_tokens(t):
    d = compute_once(fx.mixed_docs(t), "tk", T.tokenize("text", lower=True))
    return compute_once(d, "k", T.drop_words("tk", STOP))


def kept_tokens(t):
    kept = T.drop_words(T.tokenize("text", lower=True), STOP)
    return compute_once(t.documents.select("doc_id", "lang", "source", "text"), "k", kept).drop("text")


def _words(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _share(a, b):
    return f"round(CASE WHEN ({b}) > 0 THEN ({a}) / ({b})::DOUBLE ELSE 0.0 END, 6)"


def _cls(cls):
    return f"len(regexp_extract_all(text, '[{cls}]'))"


_AVG = "length(array_to_string({0}, ''))"
_N = fx.u16("text")
_STAT_SQL = f"""WITH {MIXED_TOKENS}, c AS (SELECT doc_id, tk, {_N} AS n, {fx.sentences_sql('text')} AS s,
  CASE WHEN text = '' THEN 1 WHEN regexp_replace(text, '(\\n\\n+)+$', '') = '' THEN 0
    ELSE 1 + len(regexp_extract_all(regexp_replace(text, '(\\n\\n+)+$', ''), '\\n\\n+')) END AS paras,
  {_cls('[:punct:]')} AS punct, {_cls(chr(92) + 'd')} AS digits, {_cls(chr(92) + 'p{Lu}')} AS upper,
  {_cls(chr(92) + 'p{Ll}ªº')} AS lower, {_cls(chr(92) + 's')} AS blanks FROM kept)
SELECT doc_id, n AS text_length, len(tk) AS word_count, s AS sentence_count, paras AS paragraph_count,
  {_share(_AVG.format('tk'), 'len(tk)')} AS avg_word_length, {_share('n', 's')} AS avg_sentence_length,
  punct AS punctuation_count, digits AS digit_count, upper AS uppercase_count, lower AS lowercase_count,
  blanks AS whitespace_count, n - upper - lower - digits - blanks AS special_char_count,
  {_share('len(tk)', 'n')} AS lexical_density, {_share('len(list_distinct(tk))', 'len(tk)')} AS type_token_ratio FROM c"""


@query("x1_statistical_features", _STAT_SQL)
def _(t):
    d = X.statistical_features(mixed_tokens(t), "text", "tk")
    doubles = ["avg_word_length", "avg_sentence_length", "lexical_density", "type_token_ratio"]
    out = d.select("doc_id", "statistical.*")
    return out.select(*[F.round(c, 6).alias(c) if c in doubles else c for c in out.columns])


@query(
    "x2_sentences_and_paragraphs",
    f"""SELECT doc_id, {fx.sentences_sql('text')} AS sentences, 1 + len(regexp_extract_all(regexp_replace(text, '(\\n\\n+)+$', ''), '\\n\\n+')) AS paragraphs
     FROM documents""",
)
def _(t):
    return t.documents.select(
        "doc_id",
        T.sentence_count("text").alias("sentences"),
        T.paragraph_count("text").alias("paragraphs"),
    )


_SENT = f"""c AS (SELECT *, len(list_filter(k, lambda x: x IN {_words(POS)})) AS p, len(list_filter(k, lambda x: x IN {_words(NEG)})) AS q FROM (SELECT doc_id, lang, tk AS k FROM tokens)),
s AS (SELECT *, CASE WHEN p + q > 0 THEN (p - q) / (p + q)::DOUBLE ELSE 0.0 END AS pol FROM c)"""


@query(
    "x3_sentiment_features",
    f"""WITH {MIXED_TOKENS}, {_SENT} SELECT doc_id, round(pol, 6) AS polarity, {_share('p + q', 'len(k)')} AS intensity,
    CASE WHEN pol > 0.1 THEN 'positive' WHEN pol < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_class,
    round(abs(pol), 6) AS confidence, p AS positive_words, q AS negative_words, p + q AS sentiment_words FROM s""",
)
def _(t):
    d = mixed_tokens(t).select("doc_id", X.sentiment_struct("tk", POS, NEG).alias("s")).select("doc_id", "s.*")
    return d.select(*[F.round(c, 6).alias(c) if c in ("polarity", "intensity", "confidence") else c for c in d.columns])


@query(
    "x3_sentiment_by_join",
    f"""WITH {MIXED_TOKENS}, {_SENT} SELECT doc_id, round(pol, 6) AS polarity, p AS positive_words, q AS negative_words FROM s""",
)
def _(t):
    tokens = compute_once(fx.mixed_docs(t).select("doc_id", "text"), "tk", T.tokenize("text", lower=True)).drop("text")
    known = F.array(*map(F.lit, POS + NEG))
    lexicon = tokens.select(F.explode(F.array_intersect("tk", known)).alias("word")).distinct()
    lexicon = lexicon.withColumn("polarity", F.when(F.col("word").isin(POS), 1).otherwise(-1))
    d = X.sentiment_by_join(tokens, "doc_id", "tk", lexicon).select("doc_id", "sentiment.*")
    return d.select("doc_id", F.round("polarity", 6).alias("polarity"), "positive_words", "negative_words")


@query(
    "x4_language_features",
    f"""WITH {MIXED_TOKENS}, c AS (SELECT *, {_N} AS n, {_cls(chr(92) + 'x{4e00}-' + chr(92) + 'x{9fa5}')} AS zh, {_cls('a-zA-Z')} AS en,
      {_cls(chr(92) + 'd')} AS dg, {_cls('[:punct:]')} AS pu FROM kept)
    SELECT doc_id, {_share('zh', 'n')} AS chinese_ratio, {_share('en', 'n')} AS english_ratio, {_share('dg', 'n')} AS digit_ratio,
      {_share('pu', 'n')} AS punctuation_ratio, CASE WHEN zh > en THEN 'zh' ELSE 'en' END AS language,
      {_share('greatest(zh, en)', 'n')} AS language_confidence FROM c""",
)
def _(t):
    d = X.language_features(mixed_tokens(t), "text", "k").select("doc_id", "language.*")
    names = ["chinese_ratio", "english_ratio", "digit_ratio", "punctuation_ratio", "language_confidence"]
    return d.select("doc_id", "language", *[F.round(c, 6).alias(c) for c in names])


@query(
    "x5_sensitive_words",
    f"""WITH {MIXED_TOKENS} SELECT doc_id, len(list_filter(k, lambda x: x IN {_words(SENSITIVE)})) AS sensitive_words,
      len(list_filter(k, lambda x: x IN {_words(SENSITIVE)})) > 0 AS has_sensitive_words FROM kept""",
)
def _(t):
    d = X.language_features(mixed_tokens(t), "text", "k", SENSITIVE).select("doc_id", "language.*")
    return d.select("doc_id", "sensitive_words", "has_sensitive_words")


_MEAN_K = "length(array_to_string(k, '')) / len(k)::DOUBLE"


@query(
    "x6_complexity_score",
    f"""WITH {MIXED_TOKENS} SELECT doc_id, round(CASE WHEN len(k) = 0 THEN 0.0 ELSE
      len(list_distinct(k)) / len(k)::DOUBLE * 0.6::DOUBLE + least({_MEAN_K} / 10.0::DOUBLE, 1.0) * 0.4::DOUBLE END, 6) AS complexity FROM kept""",
)
def _(t):
    return mixed_tokens(t).select("doc_id", F.round(X.complexity_score("k"), 6).alias("complexity"))


@query(
    "x7_readability_score",
    f"""WITH {MIXED_TOKENS}, c AS (SELECT *, {fx.sentences_sql('text')} AS s FROM kept) SELECT doc_id,
      round(CASE WHEN s = 0 OR len(k) = 0 THEN 0.0 ELSE 1.0::DOUBLE / (1.0::DOUBLE + 0.1::DOUBLE * (len(k) / s::DOUBLE) + 0.05::DOUBLE * {_MEAN_K}) END, 6) AS readability FROM c""",
)
def _(t):
    return mixed_tokens(t).select("doc_id", F.round(X.readability_score("text", "k"), 6).alias("readability"))


# --- corpus ----------------------------------------------------------------------------
IDF_SQL = f"""{DOC_TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
idf AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) / count(*)::DOUBLE) AS idf FROM tf GROUP BY 1),
scored AS (SELECT doc_id, term, tf / n::DOUBLE * idf AS tfidf FROM tf JOIN idf USING (term) JOIN sizes USING (doc_id))"""


@query(
    "x8_tfidf",
    f"""WITH {IDF_SQL} SELECT doc_id, term, round(tfidf, 6) AS tfidf, rank FROM (SELECT *,
      row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 12) DESC, term) AS rank FROM scored) WHERE rank <= 20""",
)
def _(t):
    d = stored(kept_tokens(t).select("doc_id", "k"))
    return C.tfidf(d, "doc_id", "k", C.idf_table(d, "k"), 20).select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"), "rank")


@query("x9_idf_table", f"WITH {IDF_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(t):
    return C.idf_table(kept_tokens(t), "k").select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "x10_pruned_vocabulary",
    f"""WITH {IDF_SQL} SELECT term, df FROM idf WHERE df >= 2 AND df / (SELECT count(*) FROM documents)::DOUBLE <= 0.8::DOUBLE
      ORDER BY df DESC, term LIMIT 1000""",
)
def _(t):
    d = kept_tokens(t)
    n_docs = d.agg(F.count("*").alias("n")).scalar()
    return C.prune_vocabulary(C.idf_table(d, "k"), n_docs, 2, 0.8, 1000).select("term", "df")


@query(
    "x11_ngrams",
    f"""WITH {DOC_TOKENS}, grams AS (SELECT doc_id, unnest(k) AS ngram FROM kept UNION ALL
      SELECT doc_id, unnest(list_transform(range(1, len(k)), lambda i: k[i] || '_' || k[i + 1])) FROM kept WHERE len(k) >= 2)
    SELECT doc_id, ngram, n AS ngram_count FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ngram) AS rn
      FROM (SELECT doc_id, ngram, count(*) AS n FROM grams GROUP BY 1, 2)) WHERE rn <= 10""",
)
def _(t):
    return X.ngram_features(kept_tokens(t), "doc_id", "k", 2, 10).select("doc_id", "ngram", "ngram_count")


@query(
    "x13_feature_dimension",
    f"""WITH {IDF_SQL}, d AS (SELECT doc_id, count(*) AS n FROM tf GROUP BY 1) SELECT b.doc_id,
      coalesce(least(n, 20), 0) + coalesce(least(n, 50), 0) + 28 AS dimension, coalesce(n, 0) > 0 AS has_tfidf FROM documents b LEFT JOIN d USING (doc_id)""",
)
def _(t):
    d = kept_tokens(t)
    tfidf = C.tfidf_vectors(C.tfidf(d, "doc_id", "k", C.idf_table(d, "k"), 20), "doc_id")
    grams = X.ngram_features(d, "doc_id", "k", 1, 50).groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("ngram", "ngram_count"))).alias("grams")
    )
    joined = t.documents.select("doc_id").join(tfidf, "doc_id", "left").join(grams, "doc_id", "left")
    empty = F.lit(None).cast("array<double>")
    return joined.select(
        "doc_id",
        X.feature_dimension("tfidf", empty, "grams").cast("long").alias("dimension"),
        F.coalesce(F.size("tfidf") > 0, F.lit(False)).alias("has_tfidf"),
    )


@query(
    "x14_process_texts",
    f"""WITH cleaned AS (SELECT doc_id, text AS raw, {fx.clean_sql('text')} AS text FROM documents),
      g AS (SELECT *, {fx.u16('text')} AS n, {fx.tok('text')} AS tk FROM cleaned),
      c AS (SELECT *, list_filter(tk, lambda x: x NOT IN {STOP_SQL}) AS k, n BETWEEN 10 AND 10000 AS ok, {fx.sentences_sql('text')} AS s FROM g)
    SELECT doc_id, ok AS success, CASE WHEN ok THEN len(tk) END AS word_count, CASE WHEN ok THEN s END AS sentence_count,
      CASE WHEN ok THEN CASE WHEN s = 0 OR len(k) = 0 THEN 0.0 ELSE round(1.0::DOUBLE / (1.0::DOUBLE + 0.1::DOUBLE * (len(k) / s::DOUBLE) + 0.05::DOUBLE * {_MEAN_K}), 6) END END AS readability,
      CASE WHEN ok THEN {_share('len(regexp_extract_all(text, ' + chr(39) + '[a-zA-Z]' + chr(39) + '))', 'n')} END AS english_ratio FROM c""",
)
def _(t):
    d = X.process_texts(t.documents, "text", STOP, POS, NEG, SENSITIVE, lower=True)
    return d.select(
        "doc_id", "success", "statistical.word_count", "statistical.sentence_count",
        F.round("language.readability", 6).alias("readability"), F.round("language.english_ratio", 6).alias("english_ratio"),
    )


_GRAMS = "list_transform(range(1, len(k)), lambda i: k[i] || '_' || k[i + 1])"


@query(
    "x14_extract_features",
    f"""WITH cleaned AS (SELECT doc_id, {fx.clean_sql('text')} AS text FROM documents),
      g AS (SELECT doc_id, {fx.u16('text')} BETWEEN 10 AND 10000 AS ok, list_filter({fx.tok('text')}, lambda x: x NOT IN {STOP_SQL}) AS k0 FROM cleaned),
      p AS (SELECT doc_id, ok, CASE WHEN ok THEN k0 ELSE [] END AS k FROM g),
      w AS (SELECT doc_id, len(k) AS n, unnest(k) AS term FROM p), tf AS (SELECT doc_id, term, n, count(*) AS c FROM w GROUP BY ALL),
      idf AS (SELECT term, ln((SELECT count(*) FROM p WHERE ok) / count(*)) AS idf FROM tf GROUP BY 1),
      s AS (SELECT doc_id, term, c / n * idf AS v, row_number() OVER (PARTITION BY doc_id ORDER BY round(c / n * idf, 12) DESC, term) AS r FROM tf JOIN idf USING (term)),
      v AS (SELECT doc_id, count(*) AS tfidf_dimension, max(v) AS top_tfidf FROM s WHERE r <= 20 GROUP BY 1),
      q AS (SELECT doc_id, unnest(k) AS gram FROM p UNION ALL SELECT doc_id, unnest({_GRAMS}) FROM p WHERE len(k) > 1), b AS (SELECT doc_id, gram, count(*) AS c FROM q GROUP BY ALL),
      m AS (SELECT doc_id, least(count(*), 50) AS ngram_dimension, max(c) AS top_ngram FROM b GROUP BY 1)
      SELECT p.doc_id, coalesce(tfidf_dimension, 0)::INT AS tfidf_dimension, round(top_tfidf, 6) AS top_tfidf, coalesce(ngram_dimension, 0)::INT AS ngram_dimension,
        top_ngram::INT AS top_ngram, (coalesce(tfidf_dimension, 0) + coalesce(ngram_dimension, 0) + CASE WHEN ok THEN 28 ELSE 0 END)::INT AS total_dimension, ok AS has_language
      FROM p LEFT JOIN v USING (doc_id) LEFT JOIN m USING (doc_id)""",
)
def _(t):
    d = X.process_texts(t.documents, "text", STOP, POS, NEG, SENSITIVE, lower=True)
    # Stored: the corpus counts, the weights and the features each read it, and the chain is most of the work.
    d = stored(d.select("doc_id", "success", "filtered_tokens", "statistical", "sentiment", "language"))
    done = d.where("success")
    tfidf = C.tfidf(done, "doc_id", "filtered_tokens", C.idf_table(done, "filtered_tokens"), 20)
    f = X.extract_features(d, "doc_id", tfidf=tfidf, max_features=50)
    s = F.col("feature_summary")
    return f.select(
        "doc_id", s["tfidf_dimension"].alias("tfidf_dimension"), F.round(F.array_max(F.map_values("tfidf_vector")), 6).alias("top_tfidf"),
        s["ngram_dimension"].alias("ngram_dimension"), F.array_max(F.map_values("ngram_features")).alias("top_ngram"),
        s["total_dimension"].alias("total_dimension"), s["has_language"].alias("has_language"),
    )


@query(
    "x15_forum_features",
    f"""WITH {fx.FORUM_SQL} SELECT id, len(regexp_extract_all(content, '@[\\x{{4e00}}-\\x{{9fa5}}\\w]+')) AS n_mentions,
      coalesce(vote_count, 0) AS votes, comment_count AS comments, type = 'answer' AS is_answer, type = 'question' AS is_question FROM forum""",
)
def _(t):
    return X.forum_features(fx.forum(t)).select(
        "id", F.size("mentions").alias("n_mentions"), F.col("vote_count0").alias("votes"),
        F.col("comment_count0").alias("comments"), "is_answer", "is_question",
    )


@query(
    "x16_engagement_rates",
    f"""WITH {fx.FORUM_SQL}, c AS (SELECT *, coalesce(vote_count, 0) + comment_count + favorite_count + share_count AS total FROM forum)
    SELECT id, total, round(total / view_count::DOUBLE, 6) AS interaction_rate, round(vote_count / view_count::DOUBLE, 6) AS like_rate,
      round(comment_count / view_count::DOUBLE, 6) AS comment_rate, total >= 100 OR total / view_count::DOUBLE >= 0.1::DOUBLE AS engaged FROM c""",
)
def _(t):
    return X.engagement_rates(fx.forum(t)).select(
        "id", F.col("total_interactions").alias("total"), F.round("interaction_rate", 6).alias("interaction_rate"),
        F.round("like_rate", 6).alias("like_rate"), F.round("comment_rate", 6).alias("comment_rate"),
        F.col("high_engagement").alias("engaged"),
    )


@query(
    "x17_forum_complexity",
    f"""WITH {fx.FORUM_SQL}, c AS (SELECT *, length(content) AS n, coalesce(vote_count, 0) + comment_count + favorite_count + share_count AS total FROM forum)
    SELECT id, round(least(1.0, CASE WHEN n >= 1000 THEN 0.3 WHEN n >= 500 THEN 0.2 WHEN n >= 200 THEN 0.1 ELSE 0 END
      + CASE WHEN id % 6 >= 3 THEN 0.2 ELSE 0 END + CASE WHEN id % 4 > 0 THEN 0.1 ELSE 0 END + CASE WHEN id % 5 > 0 THEN 0.1 ELSE 0 END
      + CASE WHEN id % 2 > 0 OR id % 9 > 0 THEN 0.2 ELSE 0 END
      + CASE WHEN total >= 100 OR total / view_count::DOUBLE >= 0.1::DOUBLE THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS complexity FROM c""",
)
def _(t):
    f = X.engagement_rates(fx.forum(t))
    i = F.col("id")
    score = S.forum_complexity(
        F.length("content"), i % 6, i % 4, i % 5, S.has_multimedia(i % 2, i % 9), "high_engagement"
    )
    return f.select("id", F.round(score, 6).alias("complexity"))


@query(
    "x18_inference_text_features",
    f"""WITH {IDF_SQL}, top AS (SELECT doc_id, string_agg(term, ' ' ORDER BY rn) AS keywords FROM (SELECT *,
      row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 12) DESC, term) AS rn FROM scored) WHERE rn <= 5 GROUP BY 1)
    SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN top USING (doc_id)""",
)
def _(t):
    d = kept_tokens(t)
    top = C.tfidf(d, "doc_id", "k", C.idf_table(d, "k"), 5).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("ranked")
    )
    keywords = F.array_join(F.transform("ranked", lambda x: x["term"]), " ")
    return t.documents.join(top, "doc_id", "left").select(
        "doc_id", F.octet_length("text").alias("bytes"), F.length("text").alias("chars"),
        F.coalesce(keywords, F.lit("")).alias("keywords"),
    )


@query(
    "x19_tag_extraction",
    f"""WITH {DOC_TOKENS}, long AS (SELECT doc_id, term FROM words),
      freq AS (SELECT term, count(*) AS freq FROM long GROUP BY 1 HAVING count(*) >= 3)
    SELECT doc_id, tag, freq, rank FROM (SELECT doc_id, term AS tag, freq, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, term) AS rank
      FROM (SELECT DISTINCT doc_id, term FROM long) JOIN freq USING (term)) WHERE rank <= 10""",
)
def _(t):
    tags = kept_tokens(t).select("doc_id", F.explode("k").alias("tag"))
    return C.extract_tags(tags, "doc_id", "tag", 10, 3).select("doc_id", "tag", "freq", "rank")


@query(
    "n6_vocabulary_index",
    """WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[[:punct:]]+', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS term FROM documents)
    SELECT term, frequency, row_number() OVER (ORDER BY frequency DESC, term) - 1 AS index FROM
      (SELECT term, count(*) AS frequency FROM w GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 500)""",
)
def _(t):
    return C.vocabulary_index(t.documents, "text", min_word_freq=5, max_vocab_size=500)


@query(
    "s11_first_seen_words",
    """WITH w AS (SELECT doc_id, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS pos FROM
      (SELECT doc_id, regexp_split_to_array(lower(text), '\\s+') AS toks FROM documents))
    SELECT word, m.d AS first_row, m.p AS first_pos, row_number() OVER (ORDER BY m.d, m.p) - 1 AS index FROM (SELECT word, min({'d': doc_id, 'p': pos}) AS m FROM w WHERE word <> '' GROUP BY 1)""",
)
def _(t):
    return C.first_seen_words(t.documents, "doc_id", "text")


@query(
    "a15_vocabulary_build",
    f"""WITH {DOC_TOKENS}, n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT term AS word, w.lang AS language,
      count(*) AS frequency, round(ln(any_value(n.n) / count(DISTINCT doc_id)::DOUBLE), 6) AS idf_score
      FROM words w JOIN n ON n.lang = w.lang GROUP BY 1, 2""",
)
def _(t):
    v = C.vocabulary_build(kept_tokens(t), "doc_id", "k", "lang")
    return v.select("word", "language", "frequency", F.col("idf_score").cast("double").alias("idf_score"))


@query(
    "a16_word_frequency_lookup",
    f"""WITH {DOC_TOKENS}, f AS (SELECT term, count(*) AS n FROM words GROUP BY 1)
    SELECT p AS word, coalesce(n, 0) AS frequency FROM (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS p FROM part
      UNION SELECT DISTINCT split_part(lower(text), ' ', 1) FROM documents) LEFT JOIN f ON term = p""",
)
def _(t):
    asked = t.part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("word")).union(
        t.documents.select(F.split_part(F.lower("text"), F.lit(" "), F.lit(1)))
    ).distinct()
    return C.word_frequency_lookup(asked, C.vocabulary_build(kept_tokens(t), "doc_id", "k", "lang"))


@query(
    "a17_tfidf_vector_report",
    f"""WITH {IDF_SQL}, r AS (SELECT doc_id, count(*) AS d, count(*) FILTER (tfidf <> 0) AS nz, max(tfidf) AS m FROM
      (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 12) DESC, term) AS rn FROM scored) WHERE rn <= 100 GROUP BY 1)
    SELECT count(*) AS n_docs, round(avg(d), 6) AS avg_dimension, round(avg(nz), 6) AS avg_non_zero, round(avg(m), 6) AS avg_max FROM r""",
)
def _(t):
    d = stored(kept_tokens(t).select("doc_id", "k"))
    report = C.tfidf_vector_report(C.tfidf(d, "doc_id", "k", C.idf_table(d, "k"), 100), "doc_id")
    return report.agg(
        F.count("*").alias("n_docs"), F.round(F.avg("dimension"), 6).alias("avg_dimension"),
        F.round(F.avg("non_zero"), 6).alias("avg_non_zero"), F.round(F.avg("max_value"), 6).alias("avg_max"),
    )


# --- quality -----------------------------------------------------------------------------
_PUNCT = "[，。！？；：\"''（）【】]"
_READ = f"""CASE WHEN {fx.sentences_sql('content', '。！？', '')} BETWEEN 3 AND 20 THEN 0.1 ELSE 0 END
  + CASE WHEN regexp_matches(content, '{_PUNCT}') THEN 0.1 ELSE 0 END"""
_Q1 = f"""least(1.0, CASE WHEN n BETWEEN 100 AND 2000 THEN 0.3 WHEN n > 50 THEN 0.15 ELSE 0 END
  + CASE WHEN vote_count >= 100 THEN 0.3 WHEN vote_count >= 10 THEN 0.2 WHEN vote_count >= 1 THEN 0.1 ELSE 0 END
  + CASE WHEN comment_count >= 50 THEN 0.2 WHEN comment_count >= 5 THEN 0.1 ELSE 0 END + {_READ})"""
_FORUM_Q = f"{fx.FORUM_SQL}, q AS (SELECT *, round({_Q1}::DOUBLE, 6) AS quality FROM (SELECT *, {fx.u16('content')} AS n FROM forum))"


@query("q1_assess_quality", f"WITH {_FORUM_Q} SELECT id, quality FROM q")
def _(t):
    return fx.forum(t).select("id", F.round(S.assess_quality("content", "vote_count", "comment_count"), 6).alias("quality"))


@query("q2_assess_readability", f"WITH {fx.FORUM_SQL} SELECT id, round(({_READ})::DOUBLE, 6) AS readability FROM forum")
def _(t):
    return fx.forum(t).select("id", F.round(S.assess_readability("content"), 6).alias("readability"))


@query(
    "q3_quality_gate_and_label",
    f"WITH {_FORUM_Q} SELECT id, quality, CASE WHEN quality >= 0.8 THEN 1 ELSE 0 END AS quality_label FROM q WHERE quality >= 0.6",
)
def _(t):
    scored = fx.forum(t).select("id", F.round(S.assess_quality("content", "vote_count", "comment_count"), 6).alias("quality"))
    return scored.where("quality >= 0.6D").withColumn("quality_label", S.quality_label("quality"))


@query(
    "q4_label_from_tags",
    "SELECT page_id, CASE WHEN len(regexp_extract_all(html, 'href=\"([^\"]*)\"')) > 6 THEN 1 ELSE 0 END AS tag_label FROM pages",
)
def _(t):
    tags = F.filter(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), lambda x, i: i >= 6)
    return t.pages.select("page_id", S.label_from_tags(tags).alias("tag_label"))


@query(
    "q5_high_quality_flags",
    f"""WITH {fx.FORUM_SQL}, c AS (SELECT *, coalesce(vote_count, 0) + comment_count + favorite_count + share_count AS total FROM forum)
    SELECT id, length(content) >= 100 AND (total >= 10 OR coalesce(vote_count >= 5, false)) AS raw_high,
      (id % 10) / 10.0 > 0.8 OR coalesce(vote_count > 50, false) OR total > 100 AS training_high FROM c""",
)
def _(t):
    f = X.engagement_rates(fx.forum(t))
    return f.select(
        "id",
        S.raw_high_quality("content", "total_interactions", "vote_count").alias("raw_high"),
        S.training_high_quality((F.col("id") % 10) / 10, "vote_count", "total_interactions").alias("training_high"),
    )


@query(
    "q6_training_complexity",
    f"""WITH {fx.FORUM_SQL}, c AS (SELECT *, length(content) AS n, coalesce(vote_count, 0) + comment_count + favorite_count AS total FROM forum)
    SELECT id, round(least(1.0::DOUBLE, (CASE WHEN n > 1000 THEN 0.3 WHEN n > 500 THEN 0.2 WHEN n > 200 THEN 0.1 ELSE 0 END
      + least((id % 6) * 0.1, 0.3) + CASE WHEN total > 100 THEN 0.2 WHEN total > 50 THEN 0.1 ELSE 0 END + (id % 10) / 10.0 * 0.2)::DOUBLE), 6) AS complexity FROM c""",
)
def _(t):
    f = fx.forum(t)
    total = S.total_of("vote_count", "comment_count", "favorite_count")
    score = S.training_complexity(F.length("content"), F.col("id") % 6, total, (F.col("id") % 10) / 10)
    return f.select("id", F.round(score, 6).alias("complexity"))


@query(
    "q7_corpus_quality_report",
    f"""WITH {fx.MIXED_SQL} SELECT count(*) AS total, count(*) FILTER (strlen(text) BETWEEN 10 AND 1000) AS valid, count(DISTINCT text) AS unique_texts,
      count(*) FILTER (regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]')) AS chinese, round(avg(strlen(text)), 6) AS avg_length,
      round(count(*) FILTER (strlen(text) BETWEEN 10 AND 1000) * 100.0::DOUBLE / count(*), 6) AS quality_score FROM mixed""",
)
def _(t):
    r = R.corpus_quality_report(fx.mixed_docs(t), "text")
    return r.select("total", "valid", "unique_texts", "chinese", F.round("avg_length", 6).alias("avg_length"), F.round("quality_score", 6).alias("quality_score"))


@query(
    "q8_content_validation",
    f"""WITH {MIXED_TOKENS} SELECT doc_id, len(tk) AS n_words, CASE WHEN {_cls(chr(92) + 'x{4e00}-' + chr(92) + 'x{9fa5}')} > {_cls('a-zA-Z')} THEN 'zh' ELSE 'en' END AS language
      FROM tokens WHERE len(tk) BETWEEN 10 AND 5000""",
)
def _(t):
    d = mixed_tokens(t).where(F.size("tk").between(10, 5000))
    return X.language_features(d, "text", "tk").select("doc_id", F.size("tk").alias("n_words"), "language.language")


@query(
    "q9_collection_rules",
    f"""WITH {fx.FORUM_SQL} SELECT topic, id, rank FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY id) AS rank
      FROM forum WHERE length(content) BETWEEN 10 AND 500 AND id % 13 <> 0) WHERE rank <= 10000""",
)
def _(t):
    f = fx.forum(t).withColumn("is_deleted", F.col("id") % 13 == 0)
    keep = F.length("content").between(10, 500) & ~F.col("is_deleted")
    return top_n_per_key(f.where(keep).select("topic", "id"), ["topic"], [F.asc("id")], 10000)


@query(
    "q10_source_target_rules",
    f"""WITH {fx.FORUM_SQL} SELECT type, id, rank FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY id) AS rank FROM forum
      WHERE type IN ('question', 'answer') AND length(content) BETWEEN 50 AND 10000 AND NOT regexp_matches(lower(content), '广告|推广|spam')
      AND (type <> 'answer' OR coalesce(vote_count, 0) >= 10)) WHERE rank <= CASE type WHEN 'question' THEN 1000 ELSE 2000 END""",
)
def _(t):
    from modsift.operators.quality import source_target_rules

    return source_target_rules(fx.forum(t), "type", "content", "vote_count", "id").select("type", "id", "rank")


FLAGSHIP_SQL = f"""WITH cleaned AS (SELECT doc_id, source, {fx.clean_sql('text')} AS text FROM documents),
  valid AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM cleaned WHERE {fx.u16('text')} BETWEEN 10 AND 10000),
  c AS (SELECT *, {fx.sentences_sql('text')} AS s, list_filter({fx.tok('text')}, lambda x: x NOT IN {STOP_SQL}) AS k FROM valid WHERE rn = 1),
  r AS (SELECT source, CASE WHEN s = 0 OR len(k) = 0 THEN 0.0 ELSE 1.0::DOUBLE / (1.0::DOUBLE + 0.1::DOUBLE * (len(k) / s::DOUBLE) + 0.05::DOUBLE * {_MEAN_K}) END AS readability FROM c)
SELECT source, count(*) AS distinct_docs, count(*) FILTER (readability >= 0.4) AS readable_docs, round(avg(readability), 6) AS mean_readability FROM r GROUP BY 1"""


@query("flagship_source_quality", FLAGSHIP_SQL)
def _(t):
    from modsift.plans.flagship import source_quality

    return source_quality(t.documents, "doc_id", "text", "source", STOP)
