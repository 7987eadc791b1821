import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modsift.llm import exact_dedup, mixing, packing, queries_exact
from modsift.llm.patricia import PatriciaTrie
from modsift.llm.tokens import WordTokenizer

PATH = queries_exact.tokenizer_path()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b) * 3), max_size=60), st.sampled_from([300, 2000, 10**9]))
def test_trie_counts_and_owners(keys, budget):
    trie = PatriciaTrie(lambda a, b: a < b, budget)
    want = {}
    for i, k in enumerate(keys):
        owner = (i * 7) % 11
        trie.insert(k, owner)
        a, n = want.get(k, (owner, 0))
        want[k] = (min(a, owner), n + 1)
    got = list(trie.items())
    assert len(got) == len(want) and {k: (o, n) for k, o, n in got} == want


@pytest.mark.parametrize("budget", [2000, exact_dedup.TRIE_BYTES])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups_match_dictionary(odd, keep, budget):
    df, texts = odd
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    pick = max if keep == "largest" else min
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(df, keep, budget).collect())
    want = Counter()
    for i, t in texts:
        ids = groups[t or ""]
        best = pick([x for x in ids if x is not None], default=None)
        want[(i, best, len(ids), i == best, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want


def test_drop_exact_keeps_whole_rows(odd):
    df, texts = odd
    out = exact_dedup.drop_exact(df, keep="largest")
    assert out.schema.names == df.schema.names
    kept = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
    best = {}
    for i, t in texts:
        best[t or ""] = max(best.get(t or "", -1), i or -1)
    assert kept == sorted((i, t) for t, i in best.items())
    assert exact_dedup.drop_exact(df.limit(0)).count() == exact_dedup.exact_groups(df.limit(0)).count() == 0


def water_fill(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in done]
        level = (total - sum(done.values())) / max(1, sum(weight[s] for s in free))
        new = {s: cap * sizes[s] for s in free if cap * sizes[s] <= level * weight[s]}
        if not new:
            return {s: done.get(s, level * weight[s]) for s in names}
        done |= new


def test_targets_match_water_filling(spark):
    sizes = {"a": 5, "b": 1000, "c": 40, "d": 3, "é": 200, None: 60, "": 10}
    rows = [(s, n, 1) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source STRING, source_size LONG, source_docs LONG"), cap=3).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_mixing_plan_and_copies(spark, documents):
    docs = documents.withColumn("source", F.when(F.col("doc_id") % 10 != 9, F.col("source")))
    plan = mixing.mixing_plan(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in plan:
        assert r.size == len([w for w in __import__("re").split(r"[\x20\x09-\x0d]+", r.text) if w]) and r.copies in (int(r.rate), int(r.rate) + 1) and r.copies <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    want = water_fill(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] for s in want)
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.15 * sum(sizes.values())
    mixed = Counter(r.doc_id for r in mixing.mix_sources(docs).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in plan if r.copies})
    again = {(r.doc_id, r.copies) for r in mixing.mixing_plan(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.copies) for r in plan}


def test_mixing_of_odd_tables(odd):
    df, texts = odd
    plan = mixing.mixing_plan(df).collect()
    assert len(plan) == len(texts) and all(r.copies == 1 for r in plan if r.size)  # one source takes itself
    assert mixing.mix_sources(df).schema.names == df.schema.names
    assert mixing.mixing_plan(df.limit(0)).count() == mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.mixing_plan(df.where("text IS NULL")).first().copies == 0


def test_mixing_beside_rare_sources(spark):
    source = F.when(F.col("id") == 7, F.lit("b")).when(F.col("id") > 7, F.when(F.col("id") % 3 > 0, F.lit("a")))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), source.alias("source"), F.expr("repeat('word ', int(id % 5))").alias("text"))
    plan = mixing.mixing_plan(docs).collect()
    sizes = Counter()
    for r in plan:
        sizes[r.source] += r.doc_id % 5
    want = water_fill(sizes)
    assert len(plan) == 6000 and sizes.keys() == {"a", "b", None}
    assert all(r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) for r in plan)


def test_word_cache_gives_the_tokenizers_ids(documents, odd):
    words = WordTokenizer(PATH, entries=50)
    texts = [r.text for r in documents.limit(60).collect()] + [t or "" for _, t in odd[1]] + ["it's 12½ ⅓ _a_b á İ don'T", "x y z"]
    for t in texts:
        assert np.frombuffer(words.ids(t), "<u2").tolist() == words.whole.encode(t, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece_without_padding(counts):
    capacity, spans, parts = 64, {}, {}
    plan, filled, laid = packing.plan_windows(dict(counts), capacity)
    borders = sorted({*range(0, laid - laid % capacity, capacity), *packing.run_borders(laid, capacity), laid})
    assert len(plan) <= 31 * len(counts)
    for length, a, b, run, sequence, per, base in plan:
        for rank in range(a, b):
            if not run:
                spans.setdefault(sequence + (rank - a) // per, []).append((base + length * ((rank - a) % per), length))
                parts.setdefault((length, rank), []).append((0, length))
                continue
            begin = base + (rank - a) * length
            inside = [begin, *[x for x in borders if begin < x < begin + length], begin + length]
            for x, y in zip(inside, inside[1:]):
                window = max(i for i, at in enumerate(borders) if at <= x)
                spans.setdefault(filled + window, []).append((x - borders[window], y - x))
                parts.setdefault((length, rank), []).append((x - begin, y - x))
    assert set(parts) == {(k, r) for k, n in counts.items() for r in range(n)}
    for (length, _), pieces in parts.items():
        pieces.sort()
        assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) == length
    for placed in spans.values():
        placed.sort()
        ends = [a + n for a, n in placed]
        assert [a for a, _ in placed] == [0, *ends[:-1]] and (ends[-1] == capacity or ends[-1] & (ends[-1] - 1) == 0)


def test_best_fill_matches_all_multisets():
    counts = {7: 2, 5: 3, 3: 1}
    for room in range(0, 35):
        sums = {a * 7 + b * 5 + c * 3 for a in range(3) for b in range(4) for c in range(2)}
        used = packing.best_fill(counts, room)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room) and all(n <= counts[k] for k, n in used.items())


def test_packing_round_trip(spark, documents, odd):
    alike = spark.createDataFrame([(i, "one two three " * (230 + i % 2)) for i in range(61)], "doc_id LONG, text STRING")
    for df in (documents.limit(80), odd[0], alike):
        texts = Counter((r.doc_id, r.text or "") for r in df.collect())
        whole = WordTokenizer(PATH).whole
        rows = packing.with_ids_crc32(packing.pack_documents(df, PATH)).collect()
        want, seen = Counter(), {}
        for (i, t), n in texts.items():
            seen.setdefault(i, []).append((np.array(whole.encode(t, add_special_tokens=False).ids + [1], "<u4"), n))
        for r in rows:
            assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids, _ in seen[r.doc_id])
            want[r.doc_id] += r.length
        assert want == Counter({i: sum(len(ids) * n for ids, n in x) for i, x in seen.items()})
        used = {}
        for r in rows:
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for spans in used.values():
            spans.sort()
            assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]]
            total = sum(n for _, n in spans)
            assert total == 2048 or total & (total - 1) == 0
    assert packing.pack_documents(documents.limit(0), PATH).count() == 0


def test_other_columns_come_back_unchanged(spark):
    df = spark.sql("""SELECT 1L AS doc_id, 'some text' AS text, TIMESTAMP '2024-05-06 03:04:05.123456' AS t, TIMESTAMP_NTZ '2024-05-06 03:04:05.654321' AS n,
        TIMESTAMP '1850-01-01 00:00:00.000001' AS old, DATE '1999-12-31' AS d, 1.25BD AS dec, X'00FF10' AS b, double('NaN') AS nan, 0.1D AS x, array(1, NULL) AS a, map('k', 2) AS m,
        named_struct('t', TIMESTAMP '2024-05-06 03:04:05.000007') AS s""")
    assert repr(exact_dedup.drop_exact(df).collect()) == repr(df.collect())
