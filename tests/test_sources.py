import json

import pytest
from pyspark.sql import functions as F

from modsift.operators.instruct import assign_training_batches, parse_training_log, to_instruction_format
from modsift.sources import api, files, pages, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_text_lines(spark, tmp_path):
    p = write(tmp_path / "in.txt", "这是第一条文本\n  short\n\nEnglish line here\n最后一行没有换行")
    got = {r.content: r for r in files.read_text_lines(spark, p, ["no_empty"]).collect()}
    assert set(got) == {"这是第一条文本", "short", "English line here", "最后一行没有换行"}
    row = got["short"]
    assert row.source == "file:in.txt" and row.metadata["file_path"].endswith("/in.txt")
    assert files.read_text_lines(spark, p, None, 2).count() == 2
    ids = {r.id for r in files.read_text_lines(spark, p).collect()}
    assert ids == {r.id for r in files.read_text_lines(spark, p).collect()}


def test_line_numbers_over_splits(spark, tmp_path):
    import random

    rng = random.Random(3)
    folder = tmp_path / "lines"
    folder.mkdir()
    want, items = {}, set()
    for name in ("a.txt", "b.txt", "c d.txt"):
        lines = [rng.choice(["", "  ", "x", f"line {i} " + "y" * rng.randrange(200)]) for i in range(rng.choice([1, 400, 700]))]
        (folder / name).write_text("\n".join(lines) + rng.choice(["", "\n"]))
        kept = [x.strip() for x in lines if 5 <= len(x.strip()) <= 2000]
        want |= {(name, str(i)): t for i, t in enumerate(kept, 1)}
        rows = [json.dumps({"content": f"item {i}", "meta": {"k": "v"} if i % 2 else {"line_num": "own"}}) if i % 5 else "{bad" for i in range(300)]
        (folder / name.replace(".txt", ".jsonl")).write_text("\n\n".join(rows))
        items |= {(name.replace(".txt", ".jsonl"), str(2 * i + 1) if i % 2 else "own", f"item {i}") for i in range(300) if i % 5}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = files.read_text_lines(spark, f"{folder}/*.txt", ["no_empty"])
        splits = spark.read.text(f"{folder}/*.txt").select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        assert splits > 6, "files are cut"
        got = {(r.source.removeprefix("file:"), r.metadata["line_num"]): r.content for r in lines.collect()}
        assert got == want
        found = {(r.source.removeprefix("jsonl:"), r.metadata["line_num"], r.content) for r in files.read_jsonl_texts(spark, f"{folder}/*.jsonl").collect()}
        assert found == items
        both = {(r.source.partition(":")[2], r.metadata["line_num"]) for r in files.read_texts_by_extension(spark, str(folder), ["no_empty"]).collect()}
        assert both == set(want) | {(a, b) for a, b, _ in items}
        files.FEW_BLOCKS, few = 0, files.FEW_BLOCKS
        try:
            assert len(files.read_text_lines(spark, f"{folder}/*.txt", ["no_empty"]).collect()) == len(want)
        finally:
            files.FEW_BLOCKS = few
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_texts(spark, tmp_path):
    p = write(tmp_path / "in.csv", 'id,Message,Text\n1,"hello, world",a\n2,only two\n3,third one,b\n')
    rows = {r.metadata["id"]: r for r in files.read_csv_texts(spark, p).collect()}
    assert set(rows) == {"1", "3"}, "short records are skipped"
    assert rows["1"].content == "a" and rows["1"].metadata["Message"] == "hello, world"
    named = files.read_csv_texts(spark, p, text_column="Message").collect()
    assert {r.content for r in named} == {"hello, world", "third one"} and named[0].source == "csv:in.csv"
    assert files.pick_text_column(["x", "Body", "comment"]) == "comment"
    assert files.pick_text_column(["x", "y"]) == "x"
    q = write(tmp_path / "semi.csv", "a;b\nfirst;2\n")
    assert files.read_csv_texts(spark, q, delimiter=";").first().content == "first"


def test_json_array_and_lines(spark, tmp_path):
    items = [{"content": "one text", "source": "s", "meta": {"k": "v"}}, {"content": "two text"}]
    p = write(tmp_path / "in.json", json.dumps(items))
    got = {r.content: r for r in files.read_json_array_texts(spark, p).collect()}
    assert got["one text"].source == "s" and got["one text"].metadata["k"] == "v"
    assert got["two text"].source == "json:in.json"
    q = write(tmp_path / "in.jsonl", json.dumps(items[0]) + "\n\n{bad\n" + json.dumps(items[1]) + "\n")
    assert {r.content for r in files.read_jsonl_texts(spark, q).collect()} == {"one text", "two text"}
    assert files.count_bad_json_lines(spark, q).first().bad_lines == 1


def test_texts_by_extension(spark, tmp_path):
    write(tmp_path / "a.txt", "text line one")
    write(tmp_path / "b.CSV", "content,x\ncsv line one,1\n")
    write(tmp_path / "c.json", '[{"content": "json item one"}]')
    write(tmp_path / "d.jsonl", '{"content": "jsonl item one"}\n')
    write(tmp_path / "e.log", "log line one")
    got = {r.content: r.source for r in files.read_texts_by_extension(spark, str(tmp_path)).collect()}
    assert got == {
        "text line one": "file:a.txt", "csv line one": "csv:b.CSV", "json item one": "json:c.json",
        "jsonl item one": "jsonl:d.jsonl", "log line one": "file:e.log",
    }


def test_labeled_csv(spark, tmp_path):
    p = write(tmp_path / "l.csv", "x,y,label\n1,2.5,a\n2,3.5,b\n3,1.0,a\n")
    df, target = files.load_labeled_csv(spark, p)
    assert target == "label" and dict(df.dtypes)["x"] == "int"
    assert files.class_count(df, target).first().class_count == 2


def test_api_payload_forms(spark):
    bodies = [
        json.dumps({"data": [{"id": "1", "content": "a", "source": "s", "meta": {"k": "v"}}, {"id": "2", "content": "b"}], "has_more": True, "next_url": "http://n"}),
        json.dumps(["x", "y"]), json.dumps("single"), "<html>", '{"data": []}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "i INT, body STRING")
    got = [(r.i, r.item_id, r.content, r.source) for r in api.flatten_api_payloads(df, "body", ["i"]).orderBy("i", "content").collect()]
    assert got == [(0, "1", "a", "api:s"), (0, "2", "b", "api:"), (1, "api_0", "x", "api:api"), (1, "api_1", "y", "api:api"), (2, "api_0", "single", "api:api")]
    assert [r.i for r in api.unreadable_payloads(df, "body").collect()] == [3]
    assert api.next_pages(df, "body").first().next_url == "http://n"


PAGE = """<html><head><title>t</title></head><body>
<div class="content main"><p>First <b>bold</b> text<p>Second &amp; last</p></div>
<ul><li class="comment-item">item one<li>item two</ul>
<a href="/a">a</a> <a href="#">b</a> <a href="http://other.org/x">c</a> <a href="http://site.org/y">d</a> <a href="/f.PDF">e</a> <a href="mailto:x@y.z">m</a>
</body></html>"""


def test_page_texts_and_links(spark):
    df = spark.createDataFrame([(1, "http://u@site.org:80/q", PAGE)], "page_id INT, url STRING, html STRING")
    rows = pages.extract_page_texts(df, "url", "html", keep=["page_id"]).orderBy("ordinal").collect()
    by = {}
    for r in rows:
        by.setdefault(r.metadata["selector"], []).append(r.content)
    assert by["p"] == ["First bold text", "Second & last"]
    assert by[".content"] == by["[class*='content']"] and by[".content"][0].endswith("Second & last")
    assert by["[class*='comment']"] == ["item one"]
    assert rows[0].source == "web:site.org:80" and rows[0].metadata["tag"] == "p"
    site = df.withColumn("url", F.lit("http://site.org/q"))
    assert [r.link for r in pages.extract_links(site, "url", "html", ["page_id"]).collect()] == ["/a", "http://site.org/y"]
    assert [r.content for r in pages.extract_paragraphs(df, "html", ["page_id"]).collect()][-1].endswith("Second & last")


def test_forum_records(spark):
    long = "回答内容" * 12
    page = f"""<div><h1 class="QuestionHeader-title"> 标题 </h1><div class="QuestionRichText">细节</div>
      <div class="ans"><span class="AuthorInfo-name">作者</span><div class="RichContent-inner"><p>{long}</p></div>
      <button class="VoteButton--up"><i class="Button-label">12</i></button><button class="VoteButton--up"><i class="Button-label">1万</i></button></div>
      <div class="SearchResult-Card"><b class="SearchResult-title">题</b><i class="SearchResult-excerpt"> 摘要 </i></div>
      <div class="ContentItem"><h2 class="ContentItem-title">话题题</h2><div class="RichContent-inner">话题内容</div></div></div>"""
    df = spark.createDataFrame([("http://f/q", page)], "url STRING, html STRING")

    def rows(kind, **kw):
        return pages.extract_forum_records(df, "url", "html", kind, **kw).orderBy("ordinal").collect()

    q = rows("questions")
    assert q[0].content == "问题: 标题\n详情: 细节" and q[0].source == "zhihu:question" and q[0].metadata["detail"] == "细节"
    assert q[1].content == long and q[1].metadata["author"] == "作者" and len(q) == 2
    a = rows("answers")
    assert len(a) == 1 and a[0].metadata["vote_count"] == "12" and a[0].source == "zhihu:answer"
    s = rows("search", keyword="k")
    assert s[0].content == "题 摘要" and s[0].metadata["keyword"] == "k" and s[0].metadata["type"] == "search_result"
    t = rows("topic")
    assert t[0].content == "话题内容" and t[0].metadata["title"] == "话题题" and t[0].metadata["type"] == "topic_content"
    assert {r.metadata["selector"] for r in rows("general")} == {".RichContent-inner"}


def test_sinks(spark, tmp_path):
    raw = spark.createDataFrame([("1", "a", "s1", {"k": "v"}), ("2", "b", "s2", {})], "id STRING, content STRING, source STRING, metadata MAP<STRING,STRING>")
    sinks.write_raw_texts(raw, str(tmp_path / "raw"))
    back = spark.read.parquet(str(tmp_path / "raw"))
    assert back.count() == 2 and set(back.columns) == {"id", "content", "metadata", "source"}
    done = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "y")], "raw_text_id STRING, content STRING")
    target = str(tmp_path / "done")
    sinks.write_processed(done, target)
    sinks.write_processed(done.union(spark.createDataFrame([("3", "z")], done.schema)), target)
    assert sorted(r.raw_text_id for r in spark.read.parquet(target).collect()) == ["1", "2", "3"]
    parts = str(tmp_path / "parts")
    spark.createDataFrame([(1, "a"), (2, "b")], "v INT, p STRING").write.partitionBy("p").parquet(parts)
    sinks.rewrite_keeping(spark.createDataFrame([(9, "a")], "v INT, p STRING"), parts, "p")
    assert sorted((r.v, r.p) for r in spark.read.parquet(parts).collect()) == [(9, "a")], "partitions that the rows no longer have go"


def test_training_jsonl_and_batches(spark, tmp_path):
    qa = spark.createDataFrame([("什么是AI？", "答案", None), ("q2", "a2", "REASONING")], "question STRING, answer STRING, data_type STRING")
    records = to_instruction_format(qa, meta={"quality_score": F.lit(0.7)})
    out = str(tmp_path / "train")
    sinks.write_training_jsonl(records, out)
    lines = [json.loads(r.value) for r in spark.read.text(out).collect()]
    first = next(x for x in lines if x["input"] == "问题：什么是AI？")
    assert first == {"instruction": "请回答以下问题：", "input": "问题：什么是AI？", "output": "回答：答案", "metadata": {"quality_score": 0.7, "data_type": "QUESTION_ANSWER"}}
    sizes = assign_training_batches(spark.range(2500), F.col("id"), 1000).groupBy("batch_id", "batch_complete").count().collect()
    assert {(r.batch_id, r.batch_complete, r["count"]) for r in sizes} == {(0, True, 1000), (1, True, 1000), (2, False, 500)}


@pytest.mark.parametrize("line,epoch,loss,rate", [
    ("Epoch 3/10 loss 0.25 learning_rate 1e-4", 3, 0.25, 1e-4),
    ("Epoch 3 loss abc", None, None, None),
    ("val_loss 0.5", None, None, None),
])
def test_training_log(spark, line, epoch, loss, rate):
    r = parse_training_log(spark.createDataFrame([(line,)], "line STRING")).first()
    assert (r.epoch, r.loss, r.learning_rate) == (epoch, loss, rate)


def test_csv_files_with_own_headers_and_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,first text here\n2,"two\nlines, quoted"\n')
    (tmp_path / "b.csv").write_text("comment,id,lang\nother text here,3,en\n")
    got = {r.content for r in files.read_csv_texts(spark, str(tmp_path)).collect()}
    assert got == {"first text here", "two\nlines, quoted", "other text here"}
    assert {r.content for r in files.read_texts_by_extension(spark, str(tmp_path)).collect()} == got


def test_rewrite_removes_emptied_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b b"), (3, None)], "v INT, p STRING").write.partitionBy("p").parquet(path)
    kept = spark.read.parquet(path).where("v = 1")
    sinks.rewrite_keeping(kept, path, "p")
    assert [r.v for r in spark.read.parquet(path).collect()] == [1]


def test_append_reads_only_touched_buckets(spark, tmp_path):
    target = str(tmp_path / "done")
    rows = spark.range(500).select(F.col("id").cast("string").alias("raw_text_id"), F.lit("x").alias("content"))
    sinks.write_processed(rows, target, buckets=16)
    few = spark.createDataFrame([("3", "x"), ("900", "y"), (None, "n"), (None, "n")], "raw_text_id STRING, content STRING")
    for _ in range(2):
        sinks.write_processed(few, target, buckets=16)
    back = spark.read.parquet(target)
    assert back.count() == 502 and back.where("raw_text_id = '3'").count() == 1 and back.where("raw_text_id IS NULL").count() == 1
    plan = sinks.processed_keys(spark, target, "raw_text_id", [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "key_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "content" not in plan
    assert len(sinks.processed_keys(spark, target, "raw_text_id", [1, 2]).inputFiles()) >= 1
    assert sinks.processed_keys(spark, target, "raw_text_id", [1, 2]).count() == back.where("key_bucket IN (1, 2)").count()


def test_selected_elements_are_those_that_match():
    from modsift.sources import htmltext as H

    page = H.Page(PAGE + '<DIV id="x" class="a b">one<span class="b" data-k="v">two</span></DIV><p class="">three<p id="y">four')
    selectors = ["p", "P", "div", ".b", "#x", "#y", "div .b", ".a span", "[data-k]", "[class*='b']", "span[data-k='v']", "ul li", ".none", "li.comment-item", "[class='']", "#none", "div[id]"]
    for selector in selectors:
        steps = [list(H._PART.finditer(step)) for step in selector.split()]
        assert page.select(selector) == [n for n in page.nodes if H._matches(n, steps)], selector
    assert page.select("") == [] and len(page.select("p")) >= 4
