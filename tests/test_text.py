import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modsift import values as V
from modsift.functions import scores as S
from modsift.functions import text as T
from modsift.operators import features as X

FORUM_TEXTS = [
    "<p>这是一个关于人工智能的讨论。</p><br/>详情见 https://www.example.com/q/1?a=2",
    "今天天气真好😀😀！我们去公园玩吧。",
    "<p>联系我：someone@example.org</p>",
    "电话是010-12345678，或者13912345678，欢迎来电咨询。",
    "这是一段非常长的句子" * 20,
    "   \n\n  \t ",
    "重复 重复 重复 重复",
    "中英文 mixed content 测试 test",
    "★★★ 特殊符号 ※※※ §§§",
    "这个句子会重复。" * 10,
]


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "t STRING")
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def many(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, t STRING")
    return [r.c for r in df.select("i", column.alias("c")).orderBy("i").collect()]


def test_clean_text_forum_rows(spark):
    cleaned = many(spark, FORUM_TEXTS, T.clean_text("t"))
    assert cleaned[0] == "这是一个关于人工智能的讨论 详情见"
    assert "@" not in cleaned[2] and "example" not in cleaned[2]
    assert "12345678" not in cleaned[3]
    assert cleaned[5] == ""
    assert "★" not in cleaned[8] and "§" not in cleaned[8]
    ok = [c for c, raw in zip(cleaned, FORUM_TEXTS) if c]
    assert len(ok) == 9


def test_clean_text_null_empty_and_steps(spark):
    assert many(spark, [None, ""], T.clean_text("t")) == ["", ""]
    assert one(spark, "A <b>B</b>  é", T.clean_text("t", ("html", "whitespace", "lower"))).c0 == "a b é"
    with pytest.raises(ValueError):
        T.clean_text("t", ("nothing",))


def test_special_class_equals_its_short_form(spark):
    chars = "".join(map(chr, range(1, 0x250))) + "一龥龦，。😀"
    expected = re.sub(V.SPECIAL_CHARS, " ", chars, flags=re.ASCII)
    assert one(spark, chars, T.remove_special_chars("t")).c0 == expected


@pytest.mark.parametrize("text", [
    "a &amp;lt; b", "&copy;&middot;&eacute;", "&#65;&#x4e2d;&#128512;", "&bogus; &amp &;", "no refs", "&#55296; &#99999999;", "&amp;&amp;",
])
def test_unescape_html4(spark, text):
    expected = {"&bogus; &amp &;": "&bogus; &amp &;", "&#55296; &#99999999;": "&#55296; &#99999999;"}.get(text, html.unescape(text))
    assert one(spark, text, T.unescape_html4("t")).c0 == expected


def java_pieces(text, pattern):
    if text == "":
        return 1
    parts = re.split(pattern, text)
    while parts and parts[-1] == "":
        parts.pop()
    return len(parts)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab.!?。！？\n ", max_size=14), min_size=1, max_size=30))
def test_piece_counts_match_split_rules(spark, texts):
    assert many(spark, texts, T.sentence_count("t")) == [java_pieces(x, "[.!?。！？]+") for x in texts]
    assert many(spark, texts, T.count_pieces("t", "。！？", runs=False)) == [java_pieces(x, "[。！？]") for x in texts]
    assert many(spark, texts, T.paragraph_count("t")) == [java_pieces(x, "\n\n+") for x in texts]


def test_lengths(spark):
    r = one(spark, "中😀a", T.byte_length("t"), T.char_length("t"), T.utf16_length("t"))
    assert (r.c0, r.c1, r.c2) == (8, 3, 4)


@pytest.mark.parametrize("mode,rules,text,keep", [
    ("file", [], "x", True),
    ("file", ["no_short"], "123456789", False),
    ("file", ["no_empty"], "  中文  ", True),
    ("file", ["no_url"], "see http://a.b for more", False),
    ("file", ["no_email"], "a@b and a dot.", False),
    ("file", ["chinese_only"], "latin only text", False),
    ("web", ["no_empty"], "12345 67890 !!", False),
    ("web", ["no_short"], "nineteen characters", False),
    ("api", ["chinese_only"], "latin only text", True),
    ("api", ["no_long"], "x" * 201, False),
    ("api", ["no_empty"], "x" * 501, False),
])
def test_collection_filter(spark, mode, rules, text, keep):
    assert one(spark, text, T.collection_filter("t", mode, rules)).c0 is keep


def test_language_and_extraction(spark):
    assert many(spark, ["中文内容 ab", "hello", "", None], T.detect_language_ratio("t")) == ["zh", "en", "unknown", "unknown"]
    r = one(spark, "@张三 #话题# hi @bob https://www.zhihu.com/q/1 end", T.extract_mentions("t"), T.extract_topics("t"), T.extract_site_urls("t"))
    assert r.c0 == ["@张三", "@bob"] and r.c1 == ["#话题#"] and r.c2 == ["https://www.zhihu.com/q/1"]


def test_tokens_ngrams_and_counts(spark):
    r = one(spark, "我爱NLP nlp NLP", T.tokenize("t"), T.tokenize("t", han="bigram"), T.ngrams(T.tokenize("t", lower=True), 2), T.run_lengths(T.tokenize("t")))
    assert r.c0 == ["我", "爱", "NLP", "nlp", "NLP"]
    assert r.c1 == ["我爱", "NLP", "nlp", "NLP"]
    assert r.c2 == ["我", "爱", "nlp", "nlp", "nlp", "我_爱", "爱_nlp", "nlp_nlp", "nlp_nlp"]
    assert [(x.term, x.n) for x in r.c3] == [("NLP", 2), ("nlp", 1), ("我", 1), ("爱", 1)]
    assert one(spark, "", T.run_lengths(T.tokenize("t"))).c0 == []
    assert one(spark, "x" * 21 + " ok", T.tokenize("t")).c0 == ["ok"]


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["b", "c"]), ([], [])], "a ARRAY<STRING>, b ARRAY<STRING>")
    assert [round(r.j, 6) for r in df.select(T.jaccard("a", "b").alias("j")).collect()] == [round(1 / 3, 6), 0.0]


def test_forum_scores(spark):
    rows = [("好" * 120 + "。" * 1 + "一。二。三。", 100, 50), ("short", None, None), ("x" * 60, 10, 5)]
    df = spark.createDataFrame(rows, "content STRING, v INT, c INT")
    got = [round(r.q, 6) for r in df.select(S.assess_quality("content", "v", "c").alias("q")).collect()]
    assert got == [1.0, 0.0, 0.45]
    valid = df.select(S.forum_content_valid("content", "v").alias("k")).collect()
    assert [r.k for r in valid] == [True, False, True]
    bad = spark.createDataFrame([("这是广告" * 20, 9)], "content STRING, v INT")
    assert bad.select(S.forum_content_valid("content", "v").alias("k")).first().k is False


def test_process_texts_separates_failures(spark):
    df = spark.createDataFrame(list(enumerate(FORUM_TEXTS)), "id INT, content STRING")
    out = {r.id: r for r in X.process_texts(df).collect()}
    assert not out[5].success and out[5].error == "Text length out of range" and out[5].statistical is None
    assert out[7].success and out[7].statistical.word_count == len(out[7].tokens)
    assert out[1].language.language == "zh"
    # Left with fewer than ten characters: the bare e-mail line, the blank line, the symbol line.
    assert {i for i, r in out.items() if not r.success} == {2, 5, 8}


def test_sentiment_forms_agree(spark):
    df = spark.createDataFrame([(1, ["good", "BAD", "good", "x"]), (2, []), (3, ["bad"])], "id INT, tk ARRAY<STRING>")
    words = [("good", 1), ("bad", -1)]
    lexicon = spark.createDataFrame(words, "word STRING, polarity INT")
    a = {r.id: r.sentiment for r in X.sentiment_features(df, "tk", words).collect()}
    b = {r.id: r.sentiment for r in X.sentiment_features(df.repartition(3), "tk", lexicon, "id").collect()}
    assert a == b
    assert a[1].sentiment_class == "positive" and round(a[1].polarity, 6) == round(1 / 3, 6)
    assert a[2].sentiment_class == "neutral" and a[3].polarity == -1.0


def test_stop_words_table_matches_list(spark):
    df = spark.createDataFrame([(1, ["The", "cat", "the", "dog"]), (2, ["the"]), (3, []), (4, None)], "id INT, tk ARRAY<STRING>")
    stop = spark.createDataFrame([("the",)], "word STRING")
    by_list = {r.id: r.filtered_tokens for r in X.remove_stop_words(df, "tk", ["the"]).collect()}
    by_table = {r.id: r.filtered_tokens for r in X.remove_stop_words(df.repartition(3), "tk", stop, "id").collect()}
    assert by_list == by_table and by_table[1] == ["cat", "dog"] and by_table[2] == by_table[3] == []
    with pytest.raises(ValueError):
        X.remove_stop_words(df, "tk", stop)


def test_composite_features_skip_absent_groups(spark):
    from modsift.operators import corpus as C
    from modsift.operators import features as X

    df = spark.createDataFrame([(1, "the cat sat on the mat with another cat"), (2, "short"), (3, None)], "id INT, content STRING")
    done = X.process_texts(df, "content", stop_words=["the", "on"], lower=True)
    plain = {r.id: r for r in X.extract_features(done, "id", ngrams=None).collect()}
    assert plain[1].tfidf_vector is None and plain[1].ngram_features is None and plain[1].feature_summary.total_dimension == 28
    assert plain[2].feature_summary.total_dimension == 0 and not plain[3].feature_summary.has_language
    good = done.where("success")
    vectors = spark.createDataFrame([(1, [0.5, 0.25])], "id INT, embedding ARRAY<DOUBLE>")
    tfidf = C.tfidf(good, "id", "filtered_tokens", C.idf_table(good, "filtered_tokens"), 3)
    full = {r.id: r for r in X.extract_features(done, "id", tfidf=tfidf, embeddings=vectors, max_features=4).collect()}
    s = full[1].feature_summary
    assert (s.tfidf_dimension, s.word_vector_dimension, s.ngram_dimension, s.total_dimension) == (3, 2, 4, 37)
    assert full[1].ngram_features["cat"] == 2 and s.has_tfidf and s.has_word_vector and s.has_ngram and s.has_sentiment
    assert full[2].ngram_features is None and full[2].feature_summary.total_dimension == 0


def test_cuts_by_utf16_units(spark):
    from modsift.functions import text as T

    texts = ["", "plain text", "a" * 12, "😀" * 4, "😀" * 5, "😀" * 6, "ab😀cd😀ef😀gh", "a😀😀😀😀😀", "line\nbreak\n😀 12345", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    for n in (1, 9, 10):
        got = {r.i: r.x for r in df.select("i", T.ellipsis("t", n).alias("x")).collect()}
        for i, t in enumerate(texts):
            if t is None:
                assert got[i] is None
                continue
            units = t.encode("utf-16-le")
            want = t if len(units) <= 2 * n else units[: 2 * n].decode("utf-16-le", "ignore") + "..."
            assert got[i] == want, (t, n)


def test_sentiment_by_join_of_few_words_counts_no_words(spark, monkeypatch):
    """A small lexicon is broadcast at once; repeated ids, repeated rows and rows without tokens keep their own counts."""
    from modsift.operators import features

    monkeypatch.setattr(features, "join_counted_keys", None)
    rows = [(1, ["Good", "bad", "good", "x"]), (1, ["Good", "bad", "good", "x"]), (1, ["bad"]), (2, ["x", "y"]), (3, []), (4, None)]
    lexicon = spark.createDataFrame([("good", 1), ("GOOD", 1), ("bad", -1), ("x", 0)], "word STRING, polarity INT")
    d = spark.createDataFrame(rows, "id INT, tk ARRAY<STRING>")
    out = features.sentiment_by_join(d, "id", "tk", lexicon)
    assert out.columns == ["id", "tk", "sentiment"]
    got = sorted((r.id, r.positive_words, r.negative_words) for r in out.where("tk IS NOT NULL").select("id", "sentiment.*").collect())
    assert got == [(1, 0, 1), (1, 2, 1), (1, 2, 1), (2, 0, 0), (3, 0, 0)] and out.count() == len(rows)
