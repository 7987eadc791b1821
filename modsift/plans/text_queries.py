"""Queries: filters, cleaning, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsift.functions import scores as S
from modsift.functions import text as T
from modsift.operators import features as X
from modsift.operators import relational as R
from modsift.plans import fixtures as fx
from modsift.plans.registry import query

STOP = ["the", "and", "of", "to", "de", "la", "le", "und", "der", "die", "el", "que"]
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
POS, NEG, SENSITIVE = ["the", "and", "la", "的"], ["of", "to", "de", "好"], ["for", "that"]
TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def _filter_sql(low, high, short, long_, extra="", body=TRIM):
    return f"""SELECT doc_id FROM (SELECT doc_id, {body} AS t FROM documents)
    WHERE strlen(t) BETWEEN {low} AND {high} AND t <> '' AND strlen(t) >= {short} AND strlen(t) <= {long_}
      AND NOT (contains(t, 'http://') OR contains(t, 'https://')) AND NOT (contains(t, '@') AND contains(t, '.')) {extra}"""


RULES = ["no_empty", "no_short", "no_long", "no_url", "no_email"]


@query("f1_collection_filter_file", _filter_sql(5, 2000, 10, 500))
def _(t):
    return t.documents.where(T.collection_filter("text", "file", RULES)).select("doc_id")


@query("f2_collection_filter_web", _filter_sql(5, 1000, 20, 500, "AND regexp_matches(t, '[a-zA-Z\\x{4e00}-\\x{9fff}]')"))
def _(t):
    return t.documents.where(T.collection_filter("text", "web", RULES)).select("doc_id")


@query("f3_collection_filter_api", _filter_sql(5, 500, 10, 200, body=f"lower({TRIM})"))
def _(t):
    return t.documents.where(T.collection_filter("text", "api", RULES)).select("doc_id")


@query("f4_only_numbers_or_symbols", "SELECT doc_id, NOT regexp_matches(text, '[a-zA-Z\\x{4e00}-\\x{9fff}]') AS symbols_only FROM documents")
def _(t):
    return t.documents.select("doc_id", T.is_only_numbers_or_symbols("text").alias("symbols_only"))


@query("f5_contains_chinese", f"WITH {fx.MIXED_SQL} SELECT doc_id FROM mixed WHERE regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]')")
def _(t):
    return fx.mixed_docs(t).where(T.contains_chinese("text")).select("doc_id")


@query(
    "f6_valid_url_email_length",
    """SELECT page_id, starts_with(url, 'http://') OR starts_with(url, 'https://') AS url_ok,
       regexp_matches(replace(url, '/', '') || '@x.org', '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') AS email_ok,
       length(html) BETWEEN 500 AND 20000 AS length_ok,
       NOT regexp_matches(html, '\\S') AS blank FROM pages""",
)
def _(t):
    return t.pages.select(
        "page_id",
        T.is_valid_url("url").alias("url_ok"),
        T.is_valid_email(F.concat(F.replace("url", F.lit("/"), F.lit("")), F.lit("@x.org"))).alias("email_ok"),
        T.is_valid_text_length("html", 500, 20000).alias("length_ok"),
        T.only_whitespace("html").alias("blank"),
    )


@query(
    "f7_forum_content_valid",
    f"""WITH {fx.FORUM_SQL} SELECT id FROM forum WHERE {fx.u16('content')} BETWEEN 50 AND 20000
      AND (vote_count IS NULL OR vote_count >= 5) AND NOT regexp_matches(lower(content), '广告|推广|spam|删除')""",
)
def _(t):
    return fx.forum(t).where(S.forum_content_valid("content", "vote_count")).select("id")


@query(
    "f8_processed_length_gate",
    f"""SELECT doc_id, n BETWEEN 10 AND 10000 AS success,
      CASE WHEN NOT n BETWEEN 10 AND 10000 THEN 'Text length out of range' END AS error
      FROM (SELECT doc_id, {fx.u16('c')} AS n FROM (SELECT doc_id, {fx.clean_sql('text')} AS c FROM documents))""",
)
def _(t):
    cleaned = t.documents.select("doc_id", T.clean_text("text").alias("cleaned"))
    return X.processed_length_gate(cleaned, "cleaned").select("doc_id", "success", "error")


@query(
    "f9_training_sample_valid",
    f"""WITH {fx.QA_SQL} SELECT conv_id, turn FROM qa WHERE {fx.u16('question')} BETWEEN 10 AND 512
      AND {fx.u16('answer')} BETWEEN 50 AND 2000 AND (conv_id % 10) / 10.0 >= 0.7 AND turn * 3 >= 5""",
)
def _(t):
    qa = fx.qa_pairs(t)
    return qa.where(
        S.training_sample_valid("question", "answer", (F.col("conv_id") % 10) / 10, F.col("turn") * 3)
    ).select("conv_id", "turn")


@query(
    "f10_training_record_valid",
    f"""WITH {fx.QA_SQL} SELECT conv_id, turn FROM qa WHERE trim(question) <> '' AND trim(answer) <> ''
      AND {fx.u16('question')} BETWEEN 5 AND 1000 AND {fx.u16('answer')} BETWEEN 20 AND 5000 AND conv_id % 12 <= 10""",
)
def _(t):
    qa = fx.qa_pairs(t)
    return qa.where(S.training_record_valid("question", "answer", (F.col("conv_id") % 12) / 10)).select("conv_id", "turn")


@query(
    "f11_forum_record_valid",
    f"WITH {fx.FORUM_SQL} SELECT id FROM forum WHERE trim(id::VARCHAR) <> '' AND trim(content) <> '' AND trim(type) <> ''",
)
def _(t):
    return fx.forum(t).where(S.forum_record_valid(F.col("id").cast("string"), "content", "type")).select("id")


# --- cleaning ----------------------------------------------------------------------------
@query("c1_clean_text", f"SELECT doc_id, {fx.clean_sql('text')} AS cleaned FROM documents")
def _(t):
    return t.documents.select("doc_id", T.clean_text("text").alias("cleaned"))


@query("c2_strip_html", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS stripped FROM pages")
def _(t):
    return t.pages.select("page_id", T.strip_html("html").alias("stripped"))


@query(
    "c3_unescape_html4",
    """SELECT page_id, replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&')
       AS decoded FROM pages""",
)
def _(t):
    return t.pages.select("page_id", T.unescape_html4("html").alias("decoded"))


@query(
    "c4_remove_personal_data",
    f"""SELECT doc_id, md5(regexp_replace(text, {fx.URL_SQL}, '', 'g')) AS no_urls,
      md5(regexp_replace(text, {fx.EMAIL_SQL}, '', 'g')) AS no_emails,
      md5(regexp_replace(text, {fx.PHONE_SQL}, '', 'g')) AS no_phones,
      md5(regexp_replace(text, {fx.SPECIAL_SQL}, ' ', 'g')) AS no_specials,
      len(regexp_extract_all(text, {fx.EMAIL_SQL})) AS email_count,
      len(regexp_extract_all(text, {fx.PHONE_SQL})) AS phone_count FROM documents""",
)
def _(t):
    return X.pii_counts(t.documents, "text").select(
        "doc_id",
        F.md5(T.remove_urls("text")).alias("no_urls"),
        F.md5(T.remove_emails("text")).alias("no_emails"),
        F.md5(T.remove_phones("text")).alias("no_phones"),
        F.md5(T.remove_special_chars("text")).alias("no_specials"),
        "email_count",
        "phone_count",
    )


@query("c5_normalize_whitespace", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM documents")
def _(t):
    return t.documents.select("doc_id", T.normalize_whitespace("text").alias("body"))


@query(
    "c6_cleaning_report",
    f"""SELECT count(*) AS n, avg(CASE WHEN after > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS success_rate,
      sum(tags)::BIGINT AS tags, sum(urls)::BIGINT AS urls, sum(specials)::BIGINT AS specials,
      sum(before)::BIGINT AS before, sum(after)::BIGINT AS after
      FROM (SELECT len(regexp_extract_all(html, '<[^>]+>')) AS tags, len(regexp_extract_all(html, {fx.URL_SQL})) AS urls,
        len(regexp_extract_all(html, {fx.SPECIAL_SQL})) AS specials, {fx.u16('html')} AS before,
        {fx.u16('c')} AS after FROM (SELECT html, {fx.clean_sql("replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34)), '&amp;', '&')")} AS c FROM pages))""",
)
def _(t):
    cleaned = t.pages.withColumn("cleaned", T.clean_text("html"))
    return X.cleaning_report(cleaned, "html", "cleaned").agg(
        F.count("*").alias("n"),
        F.avg(F.col("clean_ok").cast("double")).alias("success_rate"),
        F.sum("tags_removed").alias("tags"),
        F.sum("urls_removed").alias("urls"),
        F.sum("specials_removed").alias("specials"),
        F.sum("length_before").alias("before"),
        F.sum("length_after").alias("after"),
    )


@query(
    "c7_reduction_and_stop_word_ratio",
    f"""SELECT doc_id, round(CASE WHEN b = 0 THEN 0.0 ELSE (b - a) / b::DOUBLE END, 6) AS reduction,
      round(CASE WHEN len(tk) = 0 THEN 0.0 ELSE 1 - len(list_filter(tk, lambda x: x NOT IN {STOP_SQL})) / len(tk)::DOUBLE END, 6) AS stop_ratio
      FROM (SELECT doc_id, {fx.u16('text')} AS b, {fx.u16('c')} AS a, {fx.tok('c')} AS tk
        FROM (SELECT doc_id, text, {fx.clean_sql('text')} AS c FROM documents))""",
)
def _(t):
    d = t.documents.withColumn("c", T.clean_text("text")).withColumn("tk", T.tokenize("c", lower=True))
    return d.select(
        "doc_id",
        F.round(S.reduction_ratio("text", "c"), 6).alias("reduction"),
        F.round(S.stop_word_ratio("tk", T.drop_words("tk", STOP)), 6).alias("stop_ratio"),
    )


@query(
    "c8_detect_language_ratio",
    f"""WITH {fx.MIXED_SQL} SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'unknown'
      WHEN length(regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) / {fx.u16('text')}::DOUBLE > 0.3 THEN 'zh'
      ELSE 'en' END AS language FROM (SELECT doc_id, text || repeat('的', (length(text) * (doc_id % 3) // 4)::INT) AS text FROM mixed)""",
)
def _(t):
    more = F.repeat(F.lit("的"), F.floor(F.length("text") * (F.col("doc_id") % 3) / 4).cast("int"))
    d = fx.mixed_docs(t).select("doc_id", F.concat("text", more).alias("text"))
    return d.select("doc_id", T.detect_language_ratio("text").alias("language"))


@query(
    "c9_mentions_topics_urls",
    f"""SELECT page_id, array_to_string(regexp_extract_all(x, '@[\\x{{4e00}}-\\x{{9fa5}}\\w]+'), '|') AS mentions,
      array_to_string(regexp_extract_all(x, '#[^#\\s]+#'), '|') AS topics,
      array_to_string(regexp_extract_all(x, 'https?://[\\w\\.-]*example\\.com[^\\s]*'), '|') AS site_urls
      FROM (SELECT page_id, replace(replace(html, '&amp;', ' @user好 '), '###', '#tag#') || ' ' || url AS x FROM pages)""",
)
def _(t):
    marked = F.concat(
        F.replace(F.replace("html", F.lit("&amp;"), F.lit(" @user好 ")), F.lit("###"), F.lit("#tag#")), F.lit(" "), F.col("url")
    )
    d = t.pages.select("page_id", marked.alias("x"))
    return d.select(
        "page_id",
        F.array_join(T.extract_mentions("x"), "|").alias("mentions"),
        F.array_join(T.extract_topics("x"), "|").alias("topics"),
        F.array_join(T.extract_site_urls("x", r"https?://[\w\.-]*example\.com[^\s]*"), "|").alias("site_urls"),
    )


@query(
    "c10_display_fields",
    f"""WITH {fx.FORUM_SQL} SELECT id,
      CASE WHEN id % 4 = 0 THEN lang WHEN id % 4 = 1 THEN topic ELSE '无标题' END AS title,
      CASE WHEN length(s) > 100 THEN s[1:100] || '...' ELSE s END AS summary,
      CASE WHEN length(content) > 100 THEN content[1:100] || '...' ELSE content END AS answer_summary,
      CASE WHEN length(content) > 50 THEN content[1:50] || '...' ELSE content END AS question_title,
      CASE type WHEN 'question' THEN '问题' WHEN 'answer' THEN '回答' ELSE '文章' END AS type_label
      FROM (SELECT *, trim(regexp_replace(content, '<[^>]+>', '', 'g'), ' ' || chr(10) || chr(13) || chr(9)) AS s FROM forum)""",
)
def _(t):
    f = fx.forum(t).withColumn("t1", F.when(F.col("id") % 4 == 0, F.col("lang")).otherwise("  ")).withColumn(
        "t2", F.when(F.col("id") % 4 == 1, F.col("topic"))
    )
    return f.select(
        "id",
        T.display_title("t1", "t2").alias("title"),
        T.content_summary("content").alias("summary"),
        T.ellipsis("content", 100).alias("answer_summary"),
        T.ellipsis("content", 50).alias("question_title"),
        T.type_description("type").alias("type_label"),
    )


@query(
    "c11_build_metadata",
    f"""WITH {fx.FORUM_SQL} SELECT id, 'source=forum|type=' || type ||
      CASE WHEN vote_count IS NOT NULL THEN '|vote_count=' || vote_count ELSE '' END || '|comment_count=' || comment_count AS metadata
      FROM forum""",
)
def _(t):
    meta = X.build_metadata("forum", {"type": "type", "vote_count": "vote_count", "comment_count": "comment_count"})
    flat = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return fx.forum(t).withColumn("m", meta).select("id", flat.alias("metadata"))


@query(
    "c12_extract_domain",
    """SELECT page_id, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS domain,
      regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages""",
)
def _(t):
    return t.pages.select("page_id", T.extract_domain("url").alias("domain"), T.url_host("url").alias("host"))


# --- tokens ---------------------------------------------------------------------------------
@query("n1_tokenize", f"WITH {fx.MIXED_SQL} SELECT doc_id, len(tk) AS n, md5(array_to_string(tk, ' ')) AS digest FROM (SELECT doc_id, {fx.tok('text')} AS tk FROM mixed)")
def _(t):
    d = fx.mixed_docs(t).select("doc_id", T.tokenize("text", lower=True).alias("tk"))
    return d.select("doc_id", F.size("tk").alias("n"), F.md5(F.array_join("tk", " ")).alias("digest"))


@query(
    "n2_simple_tokenize",
    """SELECT doc_id, len(tk) AS n, md5(array_to_string(tk, ' ')) AS digest FROM (SELECT doc_id,
      list_filter(regexp_split_to_array(text, '[\\s[:punct:]]+'), lambda x: x <> '') AS tk FROM documents)""",
)
def _(t):
    d = t.documents.select("doc_id", T.simple_tokenize("text").alias("tk"))
    return d.select("doc_id", F.size("tk").alias("n"), F.md5(F.array_join("tk", " ")).alias("digest"))


@query(
    "n3_remove_stop_words",
    f"""SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id,
      list_filter({fx.tok('text', False)}, lambda x: lower(x) NOT IN ('en', 'fr', 'de', 'es')) AS k FROM documents)""",
)
def _(t):
    d = t.documents.select("doc_id", T.tokenize("text").alias("tk"))
    stop = t.documents.select(F.col("lang").alias("word")).distinct()
    return X.remove_stop_words(d, "tk", stop, "doc_id").select(
        "doc_id", F.size("filtered_tokens").alias("n"), F.md5(F.array_join("filtered_tokens", " ")).alias("digest")
    )


@query(
    "n4_token_counts",
    f"""SELECT doc_id, len(tk) AS total_tokens, len(k) AS filtered_token_count, len(list_distinct(tk)) AS unique_tokens,
      len(list_distinct(k)) AS unique_filtered_tokens,
      array_to_string(list_sort(list_distinct(list_filter(tk, lambda x: x IN {STOP_SQL}))), ' ') AS removed
      FROM (SELECT doc_id, tk, list_filter(tk, lambda x: x NOT IN {STOP_SQL}) AS k FROM (SELECT doc_id, {fx.tok('text')} AS tk FROM documents))""",
)
def _(t):
    d = t.documents.select("doc_id", T.tokenize("text", lower=True).alias("tk"))
    d = d.withColumn("k", T.drop_words("tk", STOP))
    return X.token_counts(d, "tk", "k").select(
        "doc_id", "total_tokens", "filtered_token_count", "unique_tokens", "unique_filtered_tokens",
        F.array_join(F.sort_array("removed_tokens"), " ").alias("removed"),
    )


@query(
    "n5_token_quality",
    f"""WITH {fx.MIXED_SQL} SELECT doc_id,
      round(CASE WHEN len(tk) = 0 THEN 0.0 ELSE length(array_to_string(tk, '')) / len(tk)::DOUBLE END, 6) AS avg_len,
      round(CASE WHEN len(tk) = 0 THEN 0.0 ELSE len(list_filter(tk, lambda x: regexp_matches(x, '[\\x{{4e00}}-\\x{{9fff}}]'))) / len(tk)::DOUBLE END, 6) AS han_share
      FROM (SELECT doc_id, {fx.tok('text')} AS tk FROM mixed)""",
)
def _(t):
    d = fx.mixed_docs(t).select("doc_id", T.tokenize("text", lower=True).alias("tk"))
    return X.token_quality(d, "tk").select(
        "doc_id", F.round("avg_token_length", 6).alias("avg_len"), F.round("han_token_share", 6).alias("han_share")
    )
