"""Seeded text augmentation: one row in, up to n copies out, all in built-in expressions.

Every random choice comes from (row id, copy, seed, draw) by whole-number arithmetic that any engine
can repeat, so results do not depend on partitioning, retries or the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsift import values as V
from modsift.functions import text as T
from modsift.operators.scale import compute_once

STRATEGIES = ("synonym_replace", "random_insert", "random_swap", "random_delete")
MOST_COPIES = 5


# --- draws -----------------------------------------------------------------------
PRIME = (1 << 31) - 1


def draw_constants(tag: str) -> tuple[int, int, int]:
    digest = hashlib.md5(tag.encode()).hexdigest()
    a, b, c = (int(digest[k : k + 7], 16) for k in (0, 7, 14))
    return a * 2 + 1, b * 2 + 1, c


def copy_seed(row_id: Column, copy: Column, seed: int) -> Column:
    key = F.concat(row_id.cast("string"), F.lit("|"), copy.cast("string"), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % PRIME


def _draw(seed: Column, tag: str, i: Column | None = None) -> Column:
    """A whole number below PRIME for a seed, a tag and a place; no step leaves a long."""
    a, b, c = draw_constants(tag)
    at = (F.lit(0) if i is None else i).cast("long") + 1
    u = (seed * a + at * b + c) % PRIME
    return ((u * u + seed + at) % PRIME * a + c) % PRIME


def _below(n, seed: Column, tag: str, i: Column | None = None) -> Column:
    """A draw from 0..n-1."""
    return (_draw(seed, tag, i) % (n.cast("long") if isinstance(n, Column) else F.lit(n))).cast("int")


def _chance(p: float, seed: Column, tag: str) -> Column:
    return _draw(seed, tag) % 1_000_000 < int(p * 1_000_000)


def _picks(tokens: Column, rate: float) -> Column:
    return F.greatest(F.lit(1), F.floor(F.size(tokens) * rate)).cast("int")


def _shuffled(tokens: Column, seed: Column, tag: str) -> Column:
    """Structs (h, i, w) of the tokens in a random order; i is the 0-based place."""
    keyed = F.transform(tokens, lambda w, i: F.struct(_draw(seed, tag, i).alias("h"), i.alias("i"), w.alias("w")))
    return F.sort_array(keyed)


def _ordered(tokens: Column, seed: Column, tag: str) -> Column:
    """Per token a whole number, its draw and then its place: the order of ``_shuffled`` without moving words."""
    return F.transform(tokens, lambda w, i: F.shiftleft(_draw(seed, tag, i), 32).bitwiseOR(i.cast("long")))


def _words_in_place(structs: Column) -> Column:
    return F.transform(F.sort_array(structs), lambda s: s["w"])


# --- strategies over token arrays ---------------------------------------------------
def synonym_replace(tokens: Column, seed: Column, synonyms: dict[str, list[str]] | None = None, rate: float = 0.1) -> Column:
    """Pick max(1, n * rate) words; those with an entry become one of their synonyms."""
    synonyms = V.SYNONYMS if synonyms is None else synonyms
    table = F.create_map(*[x for w, s in synonyms.items() for x in (F.lit(w.lower()), F.array(*map(F.lit, s)))])

    def replace(word: Column, i: Column) -> Column:
        options = F.try_element_at(table, F.lower(word))
        pick = F.element_at(options, _below(F.size(options), seed, "which", i) + 1)
        return F.when(options.isNotNull(), pick).otherwise(word)

    def body(bound: Column) -> Column:
        return F.transform(tokens, lambda w, i: F.when(F.get(bound["at"], i) <= bound["last"], replace(w, i)).otherwise(w))

    # The picked words are those up to the k-th in the random order.
    def picked(at: Column) -> Column:
        return F.struct(at.alias("at"), F.element_at(F.sort_array(at), F.least(_picks(tokens, rate), F.size(tokens))).alias("last"))

    some = T.let(T.let(_ordered(tokens, seed, "syn"), picked), body)
    return F.when(F.size(tokens) == 0, tokens).otherwise(some)


def random_insert(tokens: Column, seed: Column, words: list[str] | None = None, rate: float = 0.1) -> Column:
    """Insert max(1, n * rate) common words at random gaps."""
    pool = F.array(*map(F.lit, V.COMMON_WORDS if words is None else words))
    n_words = len(V.COMMON_WORDS if words is None else words)
    new = F.transform(
        F.sequence(F.lit(1), _picks(tokens, rate)),
        lambda j: F.struct(
            (_below(F.size(tokens) + 1, seed, "gap", j) * 2).alias("at"), j.alias("j"),
            F.element_at(pool, _below(n_words, seed, "word", j) + 1).alias("w"),
        ),
    )
    old = F.transform(tokens, lambda w, i: F.struct((i * 2 + 1).alias("at"), F.lit(0).alias("j"), w.alias("w")))
    return _words_in_place(F.concat(new, old))


def random_swap(tokens: Column, seed: Column, rate: float = 0.1) -> Column:
    """Exchange max(1, n * rate) disjoint random pairs; fewer than two tokens stay as they are.

    In the shuffled order, the first k words trade places with the next k.
    """
    half = F.floor(F.size(tokens) / 2).cast("int")
    bound = F.struct(_shuffled(tokens, seed, "swap").alias("s"), F.least(_picks(tokens, rate), half).alias("k"))

    def body(b: Column) -> Column:
        first, second = F.slice(b["s"], F.lit(1), b["k"]), F.slice(b["s"], b["k"] + 1, b["k"])
        rest = F.slice(b["s"], b["k"] * 2 + 1, F.size(b["s"]))
        placed = lambda at, w: F.struct(at["i"].alias("i"), w["w"].alias("w"))
        return _words_in_place(
            F.concat(
                F.zip_with(first, second, placed),
                F.zip_with(second, first, placed),
                F.transform(rest, lambda s: placed(s, s)),
            )
        )

    return F.when(F.size(tokens) < 2, tokens).otherwise(T.let(bound, body))


def random_delete(tokens: Column, seed: Column, rate: float = 0.1) -> Column:
    """Drop max(1, n * rate) random words, always keeping at least one."""
    n = F.size(tokens)

    def kept(at: Column) -> Column:
        last = F.element_at(F.sort_array(at), F.greatest(F.lit(1), n - _picks(tokens, rate)))
        return T.let(
            F.struct(at.alias("at"), last.alias("last")), lambda b: F.filter(tokens, lambda w, i: F.get(b["at"], i) <= b["last"])
        )

    return F.when(n <= 1, tokens).otherwise(T.let(_ordered(tokens, seed, "del"), kept))


def pseudo_back_translation(tokens: Column, seed: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """A simulation, no translation: sometimes swap two neighbours, sometimes replace synonyms."""
    n = F.size(tokens)
    at = _below(F.greatest(n - 1, F.lit(1)), seed, "bt-at")
    swapped = F.transform(
        tokens,
        lambda w, i: F.when(i == at, F.get(tokens, at + 1)).when(i == at + 1, F.get(tokens, at)).otherwise(w),
    )
    first = F.when((n >= 2) & _chance(0.3, seed, "bt-swap"), swapped).otherwise(tokens)
    replaced = T.let(first, lambda words: synonym_replace(words, seed, synonyms))
    return F.when((n >= 2) & _chance(0.2, seed, "bt-syn"), replaced).otherwise(first)


def noise_injection(text: Column, seed: Column) -> Column:
    """At most one replaced, one inserted and one deleted character; empty text stays empty."""
    letter = lambda tag: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _below(26, seed, tag) + 1, F.lit(1))

    def cut(s: Column, at: Column, middle: Column, skip: int) -> Column:
        return F.concat(F.substring(s, F.lit(1), at), middle, F.substring(s, at + 1 + skip, F.length(s)))

    n = F.length(text)
    one = F.when((n > 0) & _chance(0.1, seed, "n-rep"), cut(text, _below(F.greatest(n, F.lit(1)), seed, "n-rep-at"), letter("n-rep-c"), 1)).otherwise(text)
    two = F.when((n > 0) & _chance(0.05, seed, "n-ins"), cut(one, _below(n + 1, seed, "n-ins-at"), letter("n-ins-c"), 0)).otherwise(one)
    m = F.length(two)
    gone = cut(two, _below(F.greatest(m, F.lit(1)), seed, "n-del-at"), F.lit(""), 1)
    return F.when((m > 1) & _chance(0.05, seed, "n-del"), gone).otherwise(two)


# --- operators -----------------------------------------------------------------------------
def _copied(df: DataFrame, row_id: str, text: str, n: int, seed: int, make: Callable[[Column], Column]) -> DataFrame:
    """Row id, copy and the fields of the struct that ``make`` gives for a seed, for copies 1..n whose ``augmented`` differs from the text.

    The copies of a row are made inside it, so its text and tokens are not repeated.
    """
    def one(copy: Column) -> Column:
        return F.struct(copy.alias("copy"), T.let(copy_seed(F.col(row_id), copy, seed), make).alias("made"))

    rows = compute_once(df, "__copies", F.transform(F.sequence(F.lit(1), F.lit(n)), one))
    each = rows.select(row_id, text, F.inline("__copies"))
    return each.where(F.col("made.augmented") != F.col(text)).select(row_id, "copy", "made.*")


def augment(
    df: DataFrame, row_id: str, text: str, n: int = 3, strategies: tuple[str, ...] = STRATEGIES, seed: int = 42,
    synonyms: dict[str, list[str]] | None = None, rate: float = 0.1, most: int = MOST_COPIES,
) -> DataFrame:
    """Up to n augmented copies per text: row id, copy, strategy, augmented; n beyond ``most`` is an error.

    One enabled strategy per copy; copies equal to the original are dropped.
    """
    unknown = set(strategies) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    if n > most:
        raise ValueError(f"{n} copies asked for, at most {most} are configured")
    tokens = compute_once(df.select(row_id, text), "__tokens", T.simple_tokenize(text)).where(F.size("__tokens") > 0)
    names = F.array(*map(F.lit, strategies)) if strategies else F.array(F.lit("none"))
    w = F.col("__tokens")

    def make(s: Column) -> Column:
        made = {
            "synonym_replace": lambda: synonym_replace(w, s, synonyms, rate),
            "random_insert": lambda: random_insert(w, s, None, rate),
            "random_swap": lambda: random_swap(w, s, rate),
            "random_delete": lambda: random_delete(w, s, rate),
        }

        def chosen(strategy: Column) -> Column:
            out = w
            for name in strategies:
                out = F.when(strategy == name, made[name]()).otherwise(out)
            return F.struct(strategy.alias("strategy"), F.array_join(out, " ").alias("augmented"))

        return T.let(F.element_at(names, _below(max(len(strategies), 1), s, "strategy") + 1), chosen)

    return _copied(tokens, row_id, text, n, seed, make)


def back_translation_augment(df: DataFrame, row_id: str, text: str, n: int = 1, seed: int = 42, synonyms=None) -> DataFrame:
    rows = compute_once(df.select(row_id, text), "__tokens", T.simple_tokenize(text))

    def make(s: Column) -> Column:
        made = F.array_join(pseudo_back_translation(F.col("__tokens"), s, synonyms), " ")
        return F.struct(F.when(F.size("__tokens") < 2, F.col(text)).otherwise(made).alias("augmented"))

    return _copied(rows, row_id, text, n, seed, make)


def noise_augment(df: DataFrame, row_id: str, text: str, n: int = 1, seed: int = 42) -> DataFrame:
    return _copied(df.select(row_id, text), row_id, text, n, seed, lambda s: F.struct(noise_injection(F.col(text), s).alias("augmented")))


def batch_augment(df: DataFrame, row_id: str, text: str, n: int = 3, seed: int = 42, **options) -> DataFrame:
    """(key 'text_<id>', list of copies); texts that gave no copy have an empty list."""
    made = augment(df, row_id, text, n, seed=seed, **options)
    lists = made.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("copy", "augmented"))).alias("__l"))
    texts = F.transform("__l", lambda x: x["augmented"])
    return df.select(row_id).join(lists, row_id, "left").select(
        F.concat(F.lit("text_"), row_id).alias("key"), F.coalesce(texts, F.array().cast("array<string>")).alias("augmented")
    )
