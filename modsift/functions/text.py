"""Column functions over one text: lengths, cleaning, predicates, extraction."""

from __future__ import annotations

import string
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from modsift import values as V

# Unicode blanks as Java's Character.isWhitespace sees them (no-break spaces excluded).
_JAVA_BLANK = "\\s\\x1c-\\x1f\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000"
# Blanks as Unicode White_Space, which trimming in the collectors uses.
_WIDE_BLANK = "\\s\u0085\\p{Z}"
_WIDE_BLANK_CHARS = (
    "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
)
_CONTROL_CHARS = "".join(map(chr, range(0x21)))


# The special-character class with \\w and \\s written out as single ASCII characters: the
# regex engine then tests one bit set per character instead of a chain of classes.
_WORD = string.digits + string.ascii_uppercase + "_" + string.ascii_lowercase
_SPECIAL = V.SPECIAL_CHARS.replace("\\w", _WORD).replace("\\s", " \\t\\n\\x0B\\f\\r")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- lengths -------------------------------------------------------------------
def byte_length(c: Column | str) -> Column:
    return F.octet_length(as_col(c))


def char_length(c: Column | str) -> Column:
    return F.length(as_col(c))


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units: astral characters count twice."""
    return (F.octet_length(F.encode(as_col(c), "UTF-16BE")) / 2).cast("int")


def count_class(c: Column | str, char_class: str) -> Column:
    """Occurrences of a character class, without building an array of matches."""
    c = as_col(c)
    return F.length(c) - F.length(F.regexp_replace(c, f"[{char_class}]+", ""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    For expressions that mention a costly value several times, above all inside
    lambdas and CASE branches, where Spark does not share it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_pieces(c: Column | str, delimiters: str, runs: bool) -> Column:
    """Pieces left by splitting at delimiter characters (or runs of them).

    Leading and inner empty pieces count, trailing ones do not; the empty text is one piece.
    All delimiters are mapped to one character, so counting is plain string search.
    """
    mark = delimiters[0]

    def count(text: Column) -> Column:
        for other in delimiters[1:]:
            text = F.replace(text, F.lit(other), F.lit(mark))
        text = F.rtrim(text, F.lit(mark))
        if runs:
            text = F.regexp_replace(text, f"[{mark}]{{2,}}", mark)
        return let(
            text, lambda t: F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit(""))) + 1)
        )

    c = as_col(c)
    return F.when(c == "", 1).otherwise(count(c))


def sentence_count(c: Column | str) -> Column:
    return count_pieces(c, V.SENTENCE_END_CHARS, runs=True)


def paragraph_count(c: Column | str) -> Column:
    """Pieces between runs of two or more newlines, trailing empty pieces dropped."""
    pair = F.lit("\n\n")

    def count(t: Column) -> Column:
        runs = ((F.length(t) - F.length(F.replace(t, pair, F.lit("")))) / 2).cast("int")
        return F.when(t == pair, 0).otherwise(runs + 1 - F.endswith(t, pair).cast("int"))

    return let(F.regexp_replace(as_col(c), V.PARAGRAPH_BREAK, "\n\n"), count)


# --- blanks ----------------------------------------------------------------------
def is_blank(c: Column | str) -> Column:
    c = as_col(c)
    return F.coalesce(~c.rlike(f"[^{_JAVA_BLANK}]"), F.lit(True))


def only_whitespace(c: Column | str) -> Column:
    return ~as_col(c).rlike(f"[^{_WIDE_BLANK}]")


def trim_wide(c: Column | str) -> Column:
    return F.btrim(as_col(c), F.lit(_WIDE_BLANK_CHARS))


def trim_control(c: Column | str) -> Column:
    """Trim every character up to U+0020 on both ends."""
    return F.btrim(as_col(c), F.lit(_CONTROL_CHARS))


# --- cleaning steps ------------------------------------------------------------------
def strip_html(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), V.HTML_TAG, "")


def remove_urls(c: Column | str) -> Column:
    return let(as_col(c), lambda t: F.when(t.contains("://"), F.regexp_replace(t, V.URL, "")).otherwise(t))


def remove_emails(c: Column | str) -> Column:
    return let(as_col(c), lambda t: F.when(t.contains("@"), F.regexp_replace(t, V.EMAIL, "")).otherwise(t))


def remove_phones(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), V.PHONE, "")


def remove_special_chars(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), _SPECIAL, " ")


def normalize_whitespace(c: Column | str) -> Column:
    return trim_control(F.regexp_replace(as_col(c), V.WHITESPACE, " "))


def unescape_html4(c: Column | str) -> Column:
    """Decode HTML 4 named and numeric references in one pass, JVM-side.

    The text is cut at every reference, the references are decoded apart and
    both lists are zipped back, so a decoded ``&`` never starts a new reference.
    """
    c = as_col(c)
    reference = "&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);"
    named = F.create_map(
        *[F.lit(x) for name, point in name2codepoint.items() for x in (f"&{name};", chr(point))]
    )

    def code_point(ref: Column) -> Column:
        is_hex = F.lower(F.substring(ref, 3, 1)) == "x"
        digits = F.regexp_replace(ref, "^&#[xX]?|;$", "")
        point = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        decoded = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        valid = (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(valid, decoded).otherwise(ref)

    def decode_one(ref: Column) -> Column:
        numeric = F.substring(ref, 2, 1) == "#"
        return F.when(numeric, code_point(ref)).otherwise(
            F.coalesce(F.try_element_at(named, ref), ref)
        )

    def decode(text: Column) -> Column:
        refs = F.regexp_extract_all(text, F.lit(f"({reference})"), 1)
        joined = F.zip_with(
            F.split(text, reference, -1), F.transform(refs, decode_one),
            lambda piece, ref: F.concat(piece, F.coalesce(ref, F.lit(""))),
        )
        return F.when(text.contains("&"), F.array_join(joined, "")).otherwise(text)

    return let(c, decode)


CLEANING_STEPS = ("html", "urls", "emails", "phones", "special", "whitespace", "lower")
DEFAULT_CLEANING = ("html", "urls", "emails", "phones", "special", "whitespace")


def clean_text(c: Column | str, steps: tuple[str, ...] = DEFAULT_CLEANING) -> Column:
    """The cleaning chain; each step can be left out, order is fixed, blanks become ''."""
    unknown = set(steps) - set(CLEANING_STEPS)
    if unknown:
        raise ValueError(f"unknown cleaning steps: {sorted(unknown)}")
    apply = {
        "html": lambda x: unescape_html4(strip_html(x)),
        "urls": remove_urls,
        "emails": remove_emails,
        "phones": remove_phones,
        "special": remove_special_chars,
        "whitespace": normalize_whitespace,
        "lower": F.lower,
    }
    c = as_col(c)
    out = c
    for step in CLEANING_STEPS:
        if step in steps:
            out = apply[step](out)
    return F.when(is_blank(c), F.lit("")).otherwise(out)


def clean_fragment(c: Column | str) -> Column:
    """Tags out, blanks collapsed, ends trimmed: the light cleaning used on page fragments."""
    return trim_wide(F.regexp_replace(F.regexp_replace(as_col(c), V.HTML_TAG_OR_EMPTY, ""), V.WHITESPACE, " "))


# --- predicates -------------------------------------------------------------------------
def contains_chinese(c: Column | str) -> Column:
    return as_col(c).rlike(f"[{V.HAN_WIDE}]")


def is_only_numbers_or_symbols(c: Column | str) -> Column:
    return ~as_col(c).rlike(f"[a-zA-Z{V.HAN_WIDE}]")


def is_valid_url(c: Column | str) -> Column:
    c = as_col(c)
    return c.startswith("http://") | c.startswith("https://")


def is_valid_email(c: Column | str) -> Column:
    return as_col(c).rlike(V.ANCHORED_EMAIL.replace("$", "\\z"))


def is_valid_text_length(c: Column | str, low: int, high: int) -> Column:
    return char_length(c).between(low, high)


def collection_filter(c: Column | str, mode: str = "file", rules: list[str] | None = None) -> Column:
    """Keep-predicate of a collector; an empty rule list keeps everything."""
    if not rules:
        return F.lit(True)
    low, high, short, long_ = V.COLLECTION_LIMITS[mode]
    trimmed = F.lower(trim_wide(c)) if mode == "api" else trim_wide(c)

    def keep(text: Column) -> Column:
        size = byte_length(text)
        checks = {
            "no_empty": text != "",
            "no_short": size >= short,
            "no_long": size <= long_,
            "no_url": ~(text.contains("http://") | text.contains("https://")),
            "no_email": ~(text.contains("@") & text.contains(".")),
            "chinese_only": F.lit(True) if mode == "api" else contains_chinese(text),
        }
        out = (size >= low) & (size <= high)
        if mode == "web":
            out = out & ~is_only_numbers_or_symbols(text)
        for rule in rules:
            out = out & checks.get(rule, F.lit(True))
        return F.coalesce(out, F.lit(False))

    return let(trimmed, keep)


# --- language, domains, extraction -----------------------------------------------------------
def detect_language_ratio(c: Column | str) -> Column:
    c = as_col(c)
    share = count_class(c, V.HAN_WIDE) / utf16_length(c)
    return F.when(is_blank(c), "unknown").when(share > 0.3, "zh").otherwise("en")


def extract_domain(url: Column | str) -> Column:
    bare = F.regexp_replace(as_col(url), "^https?://", "")
    return F.substring_index(bare, "/", 1)


def url_host(url: Column | str) -> Column:
    """Host of an absolute URL, port kept, user info and everything after it dropped."""
    return F.regexp_extract(as_col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


def is_followable_link(link: Column | str, page_url: Column | str) -> Column:
    link = as_col(link)
    lowered = F.lower(link)
    off_site = link.startswith("http") & ~F.contains(link, extract_domain(page_url))
    excluded = F.lit(False)
    for pattern in V.LINK_EXCLUDES:
        excluded = excluded | lowered.contains(pattern)
    return ~link.isin("", "#") & ~off_site & ~excluded


def extract_all(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit(f"({pattern})"), 1)


def extract_mentions(c: Column | str) -> Column:
    return extract_all(c, V.MENTION)


def extract_topics(c: Column | str) -> Column:
    return extract_all(c, V.TOPIC_TAG)


def extract_site_urls(c: Column | str, pattern: str = V.SITE_URL) -> Column:
    return extract_all(c, pattern)


ASTRAL = r"[\x{10000}-\x{10FFFF}]"  # characters of two UTF-16 units


def utf16_prefix(c: Column | str, n: int) -> Column:
    """The longest prefix of at most ``n`` UTF-16 units; a character of two units is not cut in half."""
    c = as_col(c)
    start = F.struct(F.lit(0).alias("units"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def add(state: Column, ch: Column) -> Column:
        units = state["units"] + F.when(ch.rlike(ASTRAL), 2).otherwise(1)
        fits = state["open"] & (units <= n)
        return F.struct(units.alias("units"), (state["kept"] + F.when(fits, 1).otherwise(0)).alias("kept"), fits.alias("open"))

    wide = F.substring(c, F.lit(1), F.aggregate(F.regexp_extract_all(F.substring(c, 1, n), F.lit("(?s)."), F.lit(0)), start, add)["kept"])
    return F.when(c.rlike(ASTRAL), wide).otherwise(F.substring(c, 1, n))


def ellipsis(c: Column | str, n: int) -> Column:
    """Texts of more than ``n`` UTF-16 units are cut there."""
    c = as_col(c)
    return F.when(utf16_length(c) > n, F.concat(utf16_prefix(c, n), F.lit("..."))).otherwise(c)


def display_title(title: Column | str, question_title: Column | str) -> Column:
    title, question_title = as_col(title), as_col(question_title)
    return (
        F.when(trim_control(title) != "", title)
        .when(trim_control(question_title) != "", question_title)
        .otherwise(F.lit(V.NO_TITLE))
    )


def content_summary(c: Column | str) -> Column:
    c = as_col(c)
    body = trim_control(strip_html(c))
    return F.when(c.isNull() | (trim_control(c) == ""), "").otherwise(ellipsis(body, 100))


def type_description(kind: Column | str) -> Column:
    kind = as_col(kind)
    out = F.when(kind.isNull(), F.lit(V.UNKNOWN_TYPE))
    for name, label in V.TYPE_DESCRIPTIONS.items():
        out = out.when(F.lower(kind) == name, F.lit(label))
    return out.otherwise(kind)


# --- tokens -----------------------------------------------------------------------------------
def tokenize(
    c: Column | str, min_len: int = 1, max_len: int = 20, lower: bool = False, han: str = "unigram"
) -> Column:
    """Word runs of letters, digits and underscore; Han runs become characters or bigrams."""
    c = as_col(c)
    if lower:
        c = F.lower(c)
    word = f"[\\p{{L}}\\p{{N}}_&&[^{V.HAN_WIDE}]]+"
    if han == "unigram":
        tokens = extract_all(c, f"[{V.HAN_WIDE}]|{word}")
    elif han == "bigram":
        runs = extract_all(c, f"[{V.HAN_WIDE}]+|{word}")

        def split_run(run: Column) -> Column:
            n = F.length(run)
            pairs = F.transform(
                F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))
            )
            return F.when(run.rlike(f"^[{V.HAN_WIDE}]"), pairs).otherwise(F.array(run))

        tokens = F.flatten(F.transform(runs, split_run))
    else:
        raise ValueError("han is 'unigram' or 'bigram'")
    # The pattern never yields an empty token, so a lower bound of one needs no check.
    too_long = F.filter(tokens, lambda t: F.length(t).between(min_len, max_len))
    return F.coalesce(too_long, F.array().cast("array<string>"))


def simple_tokenize(c: Column | str) -> Column:
    return F.filter(F.split(as_col(c), V.SIMPLE_TOKEN_BREAK), lambda t: t != "")


def drop_words(tokens: Column | str, words: list[str]) -> Column:
    """Remove stop words by lower-case membership; keeps repeats and order."""
    return F.filter(as_col(tokens), lambda t: ~F.lower(t).isin([w.lower() for w in words]))


def count_words(tokens: Column | str, words: list[str]) -> Column:
    return F.size(F.filter(as_col(tokens), lambda t: F.lower(t).isin([w.lower() for w in words])))


def total_length(tokens: Column | str) -> Column:
    return F.length(F.array_join(as_col(tokens), ""))


def mean_length(tokens: Column | str) -> Column:
    tokens = as_col(tokens)
    return F.when(F.size(tokens) > 0, total_length(tokens) / F.size(tokens)).otherwise(F.lit(0.0))


def run_lengths(tokens: Column | str) -> Column:
    """Distinct tokens of one row with their counts: array of (term, n), terms ascending.

    Sorting inside the row replaces a shuffle by (row, term).
    """

    def runs(t: Column) -> Column:
        n = F.size(t)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return let(
            F.struct(t.alias("t"), starts.alias("s")),
            lambda b: F.zip_with(
                b["s"],
                F.concat(F.slice(b["s"], F.lit(2), F.size(b["s"])), F.array(F.size(b["t"]))),
                lambda x, y: F.struct(F.get(b["t"], x).alias("term"), (y - x).alias("n")),
            ),
        )

    tokens = as_col(tokens)
    empty = F.array().cast("array<struct<term:string,n:int>>")
    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs)).otherwise(empty)


def top_counts(counts: Column, n: int) -> Column:
    """The n most frequent of ``run_lengths``, ties by term: array of (neg, term), neg the negated count."""
    return F.slice(F.sort_array(F.transform(counts, lambda c: F.struct((-c["n"]).alias("neg"), c["term"].alias("term")))), 1, n)


def ngrams(tokens: Column | str, n: int, sep: str = "_") -> Column:
    """All 1..n-grams of a token array as joined keys, in order of length then place."""
    tokens = as_col(tokens)

    # F.slice copies the whole array on each call; single elements keep the work in proportion to the row.
    def of_length(t: Column, k: int) -> Column:
        starts = F.when(F.size(t) >= k, F.sequence(F.lit(0), F.size(t) - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(sep, *[F.get(t, i + j) for j in range(k)]))

    return let(tokens, lambda t: F.concat(*[of_length(t, k) for k in range(1, n + 1)]))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two token sets; 0 when both are empty."""
    a, b = F.array_distinct(as_col(a)), F.array_distinct(as_col(b))
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))
