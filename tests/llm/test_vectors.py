from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from modsift.llm import hard_negatives, queries_vectors, whitening
from modsift.llm.vectors import common_length, summed_limbs, limb_batch, floored

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, whitened STRING, deviation INT, row LONG, v STRING"


def table_of(spark, rows):
    """Rows with columns whose names clash with names used inside the operators."""
    return spark.createDataFrame([(i, v, lab, "w", 5, 9, "v") for i, v, lab in rows], SCHEMA).repartition(3)


def odd_rows():
    """Null and non-finite entries, null vectors, other lengths, repeated rows and ids, null ids and labels, ties."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6).astype("float32")], int(i % 4)) for i in range(240)]
    rows += [rows[3], rows[3], rows[100], rows[0], (100, rows[5][1], 2), (7, rows[9][1], 1)]
    rows += [(900, None, 1), (901, [0.1, None, 0.2, 0.3, 0.1, 0.1], 1), (902, [float("nan")] * 6, 0), (903, [float("inf")] + [0.0] * 5, 0)]
    rows += [(904, [0.1, 0.2], 1), (905, [], 1), (None, rows[8][1], 1), (907, rows[8][1], None), (908, [0.0] * 6, 0), (909, rows[8][1], 2)]
    return rows


def fits(v, n=6):
    return v is not None and len(v) == n and all(x is not None and np.isfinite(x) for x in v)


def whole(v, scale):
    return [int(np.floor(scale * float(np.float32(x)))) for x in v]


def test_limbs_carry_any_number(spark):
    numbers = [0, 1, -1, 2**40, -(2**40) - 7, 10**35, -(10**30) + 3]
    batch = limb_batch(numbers)
    df = spark.createDataFrame(batch.to_pylist() * 3, "k int, limb int, v long")
    assert summed_limbs(df, len(numbers)) == [3 * n for n in numbers]


def test_whitening_against_exact_fractions(spark):
    rows = odd_rows()
    df = table_of(spark, rows)
    assert common_length(df, "embedding") == 6
    model = whitening.fit_whitening(df)
    taken = [(i, [x + 1_000_000 for x in whole(v, 64)]) for i, v, _ in rows if fits(v)]
    fit = sorted({tuple(x) for _, x in taken})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    assert (model.n, list(model.sums)) == (n, sums)
    centred = [[Fraction(n * x - s, n) for x, s in zip(row, sums)] for row in fit]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(6)] for i in range(6)])
    values, vectors = np.linalg.eigh(v)
    assert np.allclose(model.values, values[::-1], rtol=1e-12)
    assert np.allclose(np.abs((model.vectors * vectors[:, ::-1]).sum(axis=0)), 1, atol=1e-9)
    assert model.identity_error < 1e-9 and np.isclose(sum(model.explained), 1)
    out = whitening.whiten(df, model).collect()
    assert set(out[0].asDict()) == {"vec_id", "label", "row", "v", "whitened", "deviation"}
    got = Counter((r.vec_id, int(r.deviation), tuple(round(x, 6) + 0.0 for x in r.whitened)) for r in out)
    want = Counter()
    for i, x in taken:
        z = (np.array([n * a - s for a, s in zip(x, sums)]) / n) @ model.vectors / np.sqrt(model.values)
        want[(i, sum((n * a - s) ** 2 for a, s in zip(x, sums)), tuple(round(a, 6) + 0.0 for a in z.tolist()))] += 1
    assert got == want


def test_whitening_of_few_rows_and_huge_entries(spark):
    assert whitening.fit_whitening(table_of(spark, [(1, None, 0)])) is None
    empty = whitening.whiten(table_of(spark, [(1, None, 0)]), None)
    assert empty.count() == 0 and dict(empty.dtypes)["whitened"] == "array<double>"
    flat = [(1, [1.0, 2.0, 3.0], 0), (2, [2.0, 4.0, 3.0], 0), (3, [2.0, 4.0, 3.0], 0)]
    model = whitening.fit_whitening(table_of(spark, flat))  # rank one: other components cannot be whitened
    out = {r.vec_id: r for r in whitening.whiten(table_of(spark, flat), model).collect()}
    assert model.n == 2 and out[2].whitened[1:] == [None, None] and abs(abs(out[2].whitened[0]) - 1) < 1e-12
    assert out[2].deviation == out[3].deviation == 64**2 + 128**2
    one = whitening.fit_whitening(table_of(spark, flat[:1]))
    assert one.n == 1 and one.identity_error is None and one.explained == [None] * 3
    huge = [(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [5e12, 3.0], 0)]
    df = table_of(spark, huge)
    model = whitening.fit_whitening(df)
    x = [[min(max(a, -whitening.MOST), whitening.MOST) + 1_000_000 for a in whole(v, 64)] for _, v, _ in huge]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    got = {r.vec_id: r.deviation for r in whitening.whiten(df, model).collect()}
    assert list(model.sums) == sums and [got[i] for i in (1, 2, 3)] == [w if w < 10**38 else None for w in want]


def mined(rows, length, k_pos=5, k_neg=5, low=80, base=100):
    """Brute force; rows are (vec_id, vector, label, is_anchor)."""
    rows = [(i, whole(v, 256), lab, a) for i, v, lab, a in rows if i is not None and lab is not None and fits(v, length)]
    out = Counter()
    for n, (a, q, label, is_anchor) in enumerate(rows):
        if not is_anchor:
            continue
        scored = [(sum(x * y for x, y in zip(q, v)), i, lab) for m, (i, v, lab, _) in enumerate(rows) if m != n]
        same = sorted((-s, i) for s, i, lab in scored if lab == label)[:k_pos]
        for p, pid in same:
            inside = sorted((-s, i) for s, i, lab in scored if lab != label and low * -p <= base * s <= base * -p)[:k_neg]
            for r, (s, i) in enumerate(inside, 1):
                out[(a, pid, r, i, -p, -s)] += 1
    return out


@pytest.mark.parametrize("blocks", [(16, 3), (4096, 4096)])
def test_hard_negatives_against_all_pairs(spark, blocks):
    rows = odd_rows()
    df = table_of(spark, rows)
    found = hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, rows_per_block=blocks[0], anchors_per_block=blocks[1])
    got = Counter(tuple(r) for r in found.collect())
    assert got == mined([(i, v, lab, i is not None and i % 20 == 0) for i, v, lab in rows], 6)
    assert sum(got.values()) > 50
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_scan_keeps_all_that_its_bounds_cannot_miss():
    rng = np.random.default_rng(5)
    matrix = rng.integers(-60, 60, (500, 24))
    block = hard_negatives.Block(matrix, np.arange(500), np.arange(500)[::-1], np.zeros(500, int))
    for q in rng.integers(-60, 60, (20, 24)):
        scores = block.columns.T @ q
        floor = int(np.sort(scores)[-30])
        sizes = []

        def misses(lower, upper):
            sizes.append(len(lower))
            return upper < floor

        alive, exact = block.scan(q, np.arange(500), misses)
        assert alive.tolist() == np.flatnonzero(scores >= floor).tolist() and (exact == scores[alive]).all()
    assert sizes[-1] < 500  # columns read last see a shorter list
    assert floored(np.array([[1e300, -1e300, 0.5]]), 256, 1000).tolist() == [[1000, -1000, 128]]
    assert [hard_negatives.window_of(p, 80, 100) for p in (0, 1, 5, 7, 10)] == [0, 1, 4, 6, 8]


def test_whitening_query(spark):
    folder = "/root/testdata/sf0.001"
    out = queries_vectors.op11_whitening(spark, folder)
    rows = out.collect()
    source = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r.vec_id: np.floor(64 * np.array(r.embedding, float)) for r in source}
    fit = np.unique(np.array(list(x.values())), axis=0)
    mean = fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    assert len(rows) == 16 * len(source) and {r.component for r in rows} == set(range(1, 17))
    for r in rows[::97]:
        z = (x[r.vec_id] - mean) @ vectors[:, -r.component] / np.sqrt(values[-r.component])
        assert abs(abs(z) - abs(r.whitened)) < 1e-7 and abs(r.explained - values[-r.component] / values.sum()) < 1e-9
        assert r.n == len(fit) and r.identity_error < 1e-4
