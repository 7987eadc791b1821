"""Web pages to raw texts and links.

Element selection is not expressible with built-in functions; it runs Arrow-batched
per page, and everything after it (trimming, filters, composition) is column work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsift import values as V
from modsift.functions import text as T
from modsift.operators.scale import bounded_batches, compute_once

ELEMENT = "STRUCT<spec: INT, kind: STRING, selector: STRING, tag: STRING, text: STRING, children: ARRAY<STRING>>"
CHUNK_CHARS = 1 << 20  # of pages whose elements are held at once
FOUND_SCHEMA = f"STRUCT<elements: ARRAY<{ELEMENT}>, page: ARRAY<ARRAY<STRING>>>"


def select_elements(pages: DataFrame, html: str, specs: list[tuple[str, str, list[str], str | None]], keep: list[str], of_page=None) -> DataFrame:
    """One row per matching element.

    A spec is (kind, selector, child selectors, page selector): children are looked up inside the element, the page
    selector in the whole page.  Its texts stay one list per page and spec; ``of_page`` reduces it to column ``page``
    before elements become rows.
    """

    bounded_batches(pages.sparkSession)

    @F.pandas_udf(FOUND_SCHEMA)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from modsift.sources.htmltext import Page, inside

        for batch in batches:
            elements, wide_texts, held = [], [], 0
            for html_text in batch:
                if held > CHUNK_CHARS:
                    yield pd.DataFrame({"elements": elements, "page": wide_texts})
                    elements, wide_texts, held = [], [], 0
                held += len(html_text or "")
                page = Page(html_text or "")
                found, wide_of = [], []
                for n, (kind, selector, children, wide) in enumerate(specs):
                    nodes = page.select(selector)
                    wide_of.append([page.text_of(x) for x in page.select(wide)] if nodes and wide else [])
                    inner = [page.select(s) for s in children] if nodes else []
                    for node in nodes:
                        texts = ["".join(page.text_of(x) for x in group if inside(x, node)) for group in inner]
                        found.append({"spec": n, "kind": kind, "selector": selector, "tag": node.tag, "text": page.text_of(node), "children": texts})
                elements.append(found)
                wide_texts.append(wide_of)
            yield pd.DataFrame({"elements": elements, "page": wide_texts})

    found = compute_once(pages.select(*keep, html), "__found", find(F.col(html))).drop(html) if html not in keep else compute_once(pages.select(*keep), "__found", find(F.col(html)))
    reduced = F.transform("__found.page", of_page) if of_page else F.array().cast("array<string>")
    found = compute_once(found.withColumn("__page", reduced), "__elements", F.col("__found.elements")).drop("__found")
    rows = found.select(*keep, "__page", F.posexplode("__elements").alias("ordinal", "e"))
    return rows.select(*keep, "ordinal", "e.kind", "e.selector", "e.tag", "e.text", "e.children", F.get("__page", F.col("e.spec")).alias("page"))


def extract_page_texts(pages: DataFrame, url: str, html: str, selectors: list[str] | None = None, rules: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Text of every element per selector; an element matching two selectors gives two rows."""
    selectors = V.DEFAULT_SELECTORS if selectors is None else selectors
    keep = keep or []
    found = select_elements(pages, html, [("web", s, [], None) for s in selectors], [*keep, url])
    rows = found.select(
        *keep,
        "ordinal",
        T.trim_wide("text").alias("content"),
        F.concat(F.lit("web:"), T.url_host(url)).alias("source"),
        F.create_map(F.lit("url"), F.col(url), F.lit("selector"), F.col("selector"), F.lit("tag"), F.col("tag")).alias("metadata"),
    )
    return rows.where(T.collection_filter("content", "web", rules))


def extract_paragraphs(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Built-in-only variant for closed <p> elements: no Python worker involved."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    raw = F.regexp_extract_all(body, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1)
    found = compute_once(pages.select(*keep, html), "__p", raw)
    return found.select(*keep, F.posexplode("__p").alias("ordinal", "p")).select(
        *keep, "ordinal", T.clean_fragment(T.unescape_html4("p")).alias("content")
    )


def extract_links(pages: DataFrame, url: str, html: str, keep: list[str]) -> DataFrame:
    """Followable href values of <a> elements."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""<a\b[^>]*?\bhref=["']([^"']*)["']"""), 1)
    found = compute_once(pages.select(*keep, url, html), "__l", hrefs)
    links = found.select(*keep, url, F.explode("__l").alias("link"))
    return links.where(T.is_followable_link("link", url)).select(*keep, "link")


# --- forum pages ----------------------------------------------------------------------
def _spec(kind: str, s: dict[str, str]) -> list[tuple[str, str, list[str], str | None]]:
    return {
        "questions": [
            ("question", s["question_title"], [], s["question_detail"]),
            ("answer", s["answer"], [], s["author"]),
        ],
        "answers": [("answers", s["answer"], [], s["votes"])],
        "search": [("search", s["search_card"], [s["search_title"], s["search_excerpt"]], None)],
        "topic": [("topic", s["topic_item"], [s["topic_title"], s["answer"]], None)],
        "general": [("general", x, [], None) for x in (s["answer"], s["question_title"], s["search_excerpt"], s["topic_title"])],
    }[kind]


def _of_page(texts: Column) -> Column:
    """The last text, and the last one that is a number."""
    trimmed = F.transform(texts, lambda x: T.trim_wide(x))
    numbers = F.filter(trimmed, lambda x: x.rlike(r"^[+-]?\d+\z"))
    return F.struct(
        F.coalesce(F.try_element_at(trimmed, F.lit(-1)), F.lit("")).alias("last"),
        F.coalesce(F.try_element_at(numbers, F.lit(-1)).try_cast("int"), F.lit(0)).alias("number"),
    )


def extract_forum_records(
    pages: DataFrame, url: str, html: str, kind: str = "general", keyword: str = "", keep: list[str] | None = None, selectors: dict[str, str] | None = None
) -> DataFrame:
    """Forum records of one page kind: questions, answers, search, topic or general.

    ``selectors`` replaces the forum's own ones for pages of another make (same keys).
    """
    keep = keep or []
    found = select_elements(pages, html, _spec(kind, V.FORUM_SELECTORS | (selectors or {})), [*keep, url], _of_page)
    k = F.col("kind")
    trimmed = T.trim_wide("text")
    fragment = T.clean_fragment("text")
    child = lambda i: T.trim_wide(F.coalesce(F.get("children", F.lit(i)), F.lit("")))
    last_text, vote_count = F.coalesce(F.col("page.last"), F.lit("")), F.coalesce(F.col("page.number"), F.lit(0))
    content = (
        F.when(k == "question", F.concat(F.lit("问题: "), trimmed, F.lit("\n详情: "), last_text))
        .when(k == "answer", trimmed)
        .when(k == "search", T.clean_fragment(F.concat(child(0), F.lit("\n"), child(1))))
        .when(k == "topic", T.clean_fragment(child(1)))
        .otherwise(fragment)
    )
    size = F.octet_length("content")
    keep_row = (
        F.when(k == "question", T.trim_wide("text") != "")
        .when(k == "answer", size >= V.FORUM_MIN_BYTES["answer"])
        .when(k == "answers", size >= V.FORUM_MIN_BYTES["answers"])
        .when(k == "general", size >= V.FORUM_MIN_BYTES["general"])
        .otherwise(size > 0)
    )
    label = F.when(k.isin("answer", "answers"), "answer").otherwise(k)
    type_name = F.when(k == "search", "search_result").when(k == "topic", "topic_content").otherwise(label)

    def entry(name, value, when):
        return F.when(when, F.struct(F.lit(name).alias("k"), value.cast("string").alias("v")))

    entries = F.array(
        entry("url", F.col(url), F.lit(True)),
        entry("type", type_name, F.lit(True)),
        entry("platform", F.lit(V.FORUM_SOURCE), F.lit(True)),
        entry("title", F.when(k == "question", trimmed).otherwise(child(0)), k.isin("question", "search", "topic")),
        entry("detail", last_text, k == "question"),
        entry("author", last_text, k == "answer"),
        entry("vote_count", vote_count, k == "answers"),
        entry("keyword", F.lit(keyword), k == "search"),
        entry("selector", F.col("selector"), k == "general"),
    )
    rows = found.withColumn("content", content).where(keep_row)
    return rows.select(
        *keep,
        "ordinal",
        "content",
        F.concat(F.lit(f"{V.FORUM_SOURCE}:"), label).alias("source"),
        F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("metadata"),
    )
