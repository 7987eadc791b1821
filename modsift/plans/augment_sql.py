"""SQL forms of the augmentation strategies, on columns text, w (its words), s (the copy's seed) and copy."""

from __future__ import annotations

from modsift import values as V
from modsift.operators import augment as G

WORDS = "list_filter(regexp_split_to_array(text, '[\\s[:punct:]]+'), lambda x: x <> '')"


def draw(tag: str, i: str = "0") -> str:
    a, b, c = G.draw_constants(tag)
    u = f"((s * {a}::BIGINT + (({i})::BIGINT + 1) * {b}::BIGINT + {c}::BIGINT) % {G.PRIME}::BIGINT)"
    return f"(((({u} * {u} + s + ({i})::BIGINT + 1) % {G.PRIME}::BIGINT) * {a}::BIGINT + {c}::BIGINT) % {G.PRIME}::BIGINT)"


def below(n: str, tag: str, i: str = "0") -> str:
    return f"({draw(tag, i)} % ({n})::BIGINT)"


def chance(p: float, tag: str) -> str:
    return f"({draw(tag)} % 1000000 < {int(p * 1_000_000)})"


def picks(w: str) -> str:
    return f"greatest(1, floor(len({w}) * 0.1::DOUBLE))::BIGINT"


def shuffled(tag: str, w: str) -> str:
    return f"list_sort(list_transform({w}, lambda x, i: {{'h': {draw(tag, 'i - 1')}, 'i': i - 1, 'w': x}}))"


def in_place(structs: str) -> str:
    return f"list_transform(list_sort({structs}), lambda x: x.w)"


def copies(n: int, where: str = "len(w) > 0") -> str:
    seed = "(('0x' || substr(md5(doc_id || '|' || copy || '|42'), 1, 8))::BIGINT"
    return f"""words AS (SELECT doc_id, text, {WORDS} AS w FROM documents),
      copied AS (SELECT doc_id, text, w, copy, {seed} % {G.PRIME}::BIGINT) AS s FROM words, (SELECT unnest(range(1, {n + 1})) AS copy) WHERE {where})"""


def synonym(synonyms: dict[str, list[str]], w: str = "w") -> str:
    """``w`` with max(1, n * rate) words looked up; the list is a column of the query."""
    def option(options: list[str]) -> str:
        listed = ", ".join(f"'{x}'" for x in options)
        return f"[{listed}][{below(str(len(options)), 'which', 'm.i')} + 1]"

    cases = " ".join(f"WHEN '{k.lower()}' THEN {option(v)}" for k, v in synonyms.items())
    replaced = f"CASE lower(m.w) {cases} ELSE m.w END"
    return in_place(f"list_transform({shuffled('syn', w)}, lambda m, r: {{'i': m.i, 'w': CASE WHEN r <= {picks(w)} THEN {replaced} ELSE m.w END}})")


def insert(w: str = "w") -> str:
    pool = "[" + ", ".join(f"'{x}'" for x in V.COMMON_WORDS) + "]"
    new = (
        f"list_transform(range(1, {picks(w)} + 1), lambda j: {{'at': {below(f'len({w}) + 1', 'gap', 'j')} * 2, 'j': j, "
        f"'w': {pool}[{below(str(len(V.COMMON_WORDS)), 'word', 'j')} + 1]}})"
    )
    old = f"list_transform({w}, lambda x, i: {{'at': (i - 1) * 2 + 1, 'j': 0::BIGINT, 'w': x}})"
    return in_place(f"list_concat({new}, {old})")


def swap(w: str = "w") -> str:
    """Needs the shuffled list as column ``z`` and the number of pairs as ``k``."""
    first = "list_transform(range(1, k + 1), lambda j: {'i': z[j].i, 'w': z[k + j].w})"
    second = "list_transform(range(1, k + 1), lambda j: {'i': z[k + j].i, 'w': z[j].w})"
    rest = "list_transform(z[2 * k + 1:], lambda x: {'i': x.i, 'w': x.w})"
    moved = in_place(f"list_concat(list_concat({first}, {second}), {rest})")
    return f"CASE WHEN len({w}) < 2 THEN {w} ELSE {moved} END"


def swap_columns(w: str = "w") -> str:
    return f"{shuffled('swap', w)} AS z, least({picks(w)}, len({w}) // 2) AS k"


def delete(w: str = "w") -> str:
    kept = f"list_transform({shuffled('del', w)}[1:greatest(1, len({w}) - {picks(w)})], lambda x: {{'i': x.i, 'w': x.w}})"
    return f"CASE WHEN len({w}) <= 1 THEN {w} ELSE {in_place(kept)} END"


def joined(words: str) -> str:
    return f"array_to_string({words}, ' ')"


def back_translation(synonyms: dict[str, list[str]], n: int) -> str:
    """CTEs up to ``made`` (doc_id, text, copy, augmented)."""
    at = below("greatest(len(w) - 1, 1)", "bt-at")
    moved = "list_transform(w, lambda x, i: CASE WHEN i - 1 = spot THEN w[spot + 2] WHEN i - 1 = spot + 1 THEN w[spot + 1] ELSE x END)"
    return f"""{copies(n, 'w IS NOT NULL')},
      placed AS (SELECT *, {at} AS spot FROM copied),
      once AS (SELECT doc_id, text, copy, s, len(w) AS n, CASE WHEN len(w) >= 2 AND {chance(0.3, 'bt-swap')} THEN {moved} ELSE w END AS w FROM placed),
      made AS (SELECT doc_id, text, copy, CASE WHEN n < 2 THEN text WHEN {chance(0.2, 'bt-syn')} THEN {joined(synonym(synonyms))} ELSE {joined('w')} END AS augmented FROM once)"""


def noise(n: int) -> str:
    def letter(tag: str) -> str:
        return f"substr('abcdefghijklmnopqrstuvwxyz', {below('26', tag)} + 1, 1)"

    def cut(t: str, at: str, middle: str, skip: int) -> str:
        return f"substr({t}, 1, {at}) || {middle} || substr({t}, {at} + {1 + skip})"

    return f"""{copies(n, 'text IS NOT NULL')},
      one AS (SELECT doc_id, text, copy, s, CASE WHEN length(text) > 0 AND {chance(0.1, 'n-rep')}
        THEN {cut('text', below('greatest(length(text), 1)', 'n-rep-at'), letter('n-rep-c'), 1)} ELSE text END AS a FROM copied),
      two AS (SELECT doc_id, text, copy, s, CASE WHEN length(text) > 0 AND {chance(0.05, 'n-ins')}
        THEN {cut('a', below('length(text) + 1', 'n-ins-at'), letter('n-ins-c'), 0)} ELSE a END AS b FROM one),
      made AS (SELECT doc_id, text, copy, CASE WHEN length(b) > 1 AND {chance(0.05, 'n-del')}
        THEN {cut('b', below('greatest(length(b), 1)', 'n-del-at'), "''", 1)} ELSE b END AS augmented FROM two)"""


def augmented(synonyms: dict[str, list[str]], n: int) -> str:
    """CTEs up to ``made`` (doc_id, text, copy, strategy, augmented) with all strategies."""
    names = "[" + ", ".join(f"'{x}'" for x in G.STRATEGIES) + "]"
    return f"""{copies(n)},
      chosen AS (SELECT *, {names}[{below(str(len(G.STRATEGIES)), 'strategy')} + 1] AS strategy, {swap_columns()} FROM copied),
      made AS (SELECT doc_id, text, copy, strategy, {joined(f'''CASE strategy WHEN 'synonym_replace' THEN {synonym(synonyms)}
        WHEN 'random_insert' THEN {insert()} WHEN 'random_swap' THEN {swap()} ELSE {delete()} END''')} AS augmented FROM chosen)"""


def single(words: str, extra: str = "") -> str:
    """CTEs up to ``made`` for one strategy and one copy."""
    more = f", {extra}" if extra else ""
    return f"""{copies(1)}, chosen AS (SELECT *{more} FROM copied),
      made AS (SELECT doc_id, text, copy, {joined(words)} AS augmented FROM chosen)"""


CHANGED = "augmented <> text"
