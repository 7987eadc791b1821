import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from modsift.operators import scale as Z
from modsift.operators.density import connected_components, dbscan
from modsift.operators.evaluation import auc_roc, best_epoch
from modsift.operators.similarity import component_labels


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows, values repeat a lot."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", float(rng.randrange(50)), None if i % 11 == 0 else rng.random()) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id INT, k STRING, v DOUBLE, w DOUBLE")


@pytest.mark.parametrize("piece_rows", [100, Z.PIECE_ROWS])
def test_order_statistics_match_sorted_lists(skewed, piece_rows, monkeypatch):
    monkeypatch.setattr(Z, "PIECE_ROWS", piece_rows)
    rows, df = skewed
    groups = {}
    for _, k, v, w in rows:
        if w is not None:
            groups.setdefault(k, []).append(w)
    floor = {r.k: (r.a, r.b) for r in Z.order_statistics(df, ["k"], "w", {"a": 0.95, "b": 0.5}).collect()}
    linear = {r.k: r.a for r in Z.order_statistics(df, ["k"], "w", {"a": 0.25}, "linear").collect()}
    for k, values in groups.items():
        values.sort()
        n = len(values)
        assert floor[k] == (values[min(n * 95 // 100, n - 1)], values[min(n * 50 // 100, n - 1)])
        assert abs(linear[k] - np.quantile(values, 0.25)) < 1e-12


def test_order_statistics_one_value(spark):
    df = spark.createDataFrame([(1, 5.0)] * 100, "k INT, v DOUBLE")
    assert Z.order_statistics(df, ["k"], "v", {"p": 0.95}).first().p == 5.0


@pytest.mark.parametrize("piece_rows", [100, Z.PIECE_ROWS])
def test_cumulative_matches_running_sum(skewed, piece_rows, monkeypatch):
    monkeypatch.setattr(Z, "PIECE_ROWS", piece_rows)
    rows, df = skewed
    counted = df.groupBy("v").agg(F.count("*").alias("n"))
    got = {r.v: (r.before, r.before_all) for r in Z.cumulative(counted, [], "v", {"before": "n"}, pieces=7).collect()}
    total, run = len(rows), 0
    for v in sorted({r[2] for r in rows}):
        assert got[v] == (run, total)
        run += sum(1 for r in rows if r[2] == v)


def test_top_n_small_and_large_agree(skewed):
    rows, df = skewed
    want = {(k, i) for k in {r[1] for r in rows} for i in sorted(r[0] for r in rows if r[1] == k)[:1200][:5]}
    small = {(r.k, r.id) for r in Z.top_n_per_key(df, ["k"], [F.asc("id")], 5).collect()}
    assert small == want
    large = Z.top_n_per_key(df.select("k", "id"), ["k"], [F.asc("id")], 1001).where("rank <= 5")
    assert {(r.k, r.id) for r in large.collect()} == want


def test_hash_rank_is_a_permutation_whatever_the_partitioning(skewed):
    _, df = skewed
    a = {r.id: r["rank"] for r in Z.hash_rank(df, F.col("id"), "s").collect()}
    b = {r.id: r["rank"] for r in Z.hash_rank(df.repartition(3, "v"), F.col("id"), "s").collect()}
    assert a == b and sorted(a.values()) == list(range(3000))


@pytest.mark.parametrize("hot_keys", [1, 4, 2000])
def test_join_counted_keys_equals_plain_join(skewed, hot_keys):
    _, df = skewed
    keyed = df.groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("m")).where("k <> 'k3'")
    plain = df.join(keyed, "k").select("id", "n", "m")
    split = Z.join_counted_keys(df, keyed, "k", "n", hot_keys=hot_keys).select("id", "n", "m")
    assert sorted(plain.collect()) == sorted(split.collect())
    left = Z.join_counted_keys(df, keyed, "k", "n", how="left", hot_keys=hot_keys)
    assert left.count() == 3000 and left.where("n IS NULL").count() == df.where("k = 'k3'").count()


def test_join_salted_keeps_every_row_and_matches_nulls(spark):
    facts = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(50)], "id INT, k STRING")
    keyed = spark.createDataFrame([("a", 1), (None, 2)], "k STRING, p INT")
    got = Z.join_salted(facts, keyed, ["k"]).collect()
    assert len(got) == 50 and all(r.p == (2 if r.k is None else 1) for r in got)


def test_first_and_last_per_key(skewed):
    rows, df = skewed
    first = {r.k: r.id for r in Z.first_per_key(df, ["k"], [F.col("id")]).collect()}
    last = {r.k: r.id for r in Z.last_per_key(df, ["k"], [F.col("id")]).collect()}
    for k in {r[1] for r in rows}:
        ids = [r[0] for r in rows if r[1] == k]
        assert first[k] == min(ids) and last[k] == max(ids)


def test_compute_once_is_not_repeated_below(spark):
    df = spark.range(10).withColumn("t", F.col("id").cast("string"))
    plan = Z.compute_once(df, "h", F.sha2("t", 256)).where("h <> ''")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2") == 1


@pytest.mark.parametrize("piece_rows", [100, Z.PIECE_ROWS])
def test_auc_matches_pair_count(spark, piece_rows, monkeypatch):
    monkeypatch.setattr(Z, "PIECE_ROWS", piece_rows)
    rng = random.Random(3)
    rows = [(rng.randrange(20), int(rng.random() < 0.4)) for _ in range(400)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auc_roc(spark.createDataFrame(rows, "s INT, y INT"), "s", "y").first().auc - want) < 1e-12


def test_best_epoch_matches_loop(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for job in range(6):
        best, best_at, stop, early = float("-inf"), 0, 0, False
        for epoch in range(200):
            score = rng.random() + epoch * (0.01 if job % 2 else 0.0)
            rows.append((job, epoch, score))
            if early:
                continue
            stop = epoch
            if score > best:
                best, best_at = score, epoch
            elif epoch - best_at >= 10:
                early = True
        want[job] = (best_at, best, early, stop)
    got = best_epoch(spark.createDataFrame(rows, "job INT, epoch INT, score DOUBLE"), "job", "epoch", "score", 10, chunk=16)
    assert {r.job: (r.best_epoch, r.best_score, r.early_stopped, r.stop_epoch) for r in got.collect()} == want


def test_connected_components_on_a_long_chain(spark):
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(60)], "cell STRING")
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(59) if i != 29], "a STRING, b STRING")
    got = {r.cell: r.component for r in connected_components(edges, nodes, "cell").collect()}
    assert set(got.values()) == {"n000", "n030"} and got["n029"] == "n000" and got["n059"] == "n030"


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.4, (120, 2)), rng.normal(3, 0.5, (100, 2)), rng.uniform(-3, 6, (60, 2)), np.repeat([[5.0, -2.0]], 40, 0)])
    eps, need = 0.4, 6
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= need
    label, groups = -np.ones(len(x), int), 0
    for i in np.where(core)[0]:
        if label[i] >= 0:
            continue
        stack, label[i] = [i], groups
        while stack:
            j = stack.pop()
            for k in np.where(near[j] & core)[0]:
                if label[k] < 0:
                    label[k] = groups
                    stack.append(k)
        groups += 1
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id LONG, x DOUBLE, y DOUBLE")
    got = {r.id: (r.cluster, r.is_core) for r in dbscan(df, "id", ["x", "y"], eps, need).collect()}
    names = {}
    for i in range(len(x)):
        assert got[i][1] == core[i]
        if core[i]:
            assert names.setdefault(label[i], got[i][0]) == got[i][0]
    assert len(set(names.values())) == groups
    for i in np.where(~core)[0]:
        touching = {names[label[k]] for k in np.where(near[i] & core)[0]}
        assert got[i][0] in touching if touching else got[i][0] == "-1"


@pytest.mark.parametrize("dims,block", [(1, 2048), (2, 7), (5, 2048), (12, 20)])
def test_dbscan_of_vectors_matches_brute_force(spark, dims, block):
    from modsift.operators.density_vectors import dbscan_vectors

    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0, 0.4, (90, dims)), rng.normal(3, 0.5, (80, dims)), rng.uniform(-3, 6, (40, dims)), np.repeat(rng.uniform(-4, -3, (1, dims)), 30, 0)])
    eps, need = 0.45 * dims**0.5, 6
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= need
    label = np.arange(len(x))
    while True:
        new = np.where(near & core[None] & core[:, None], label[None], len(x)).min(1, initial=len(x))
        new = np.where(core, np.minimum(label, new), label)
        if (new == label).all():
            break
        label = new
    want = {}
    for i in range(len(x)):
        touched = label[near[i] & core]
        want[i] = (bool(core[i]), int(label[i]) if core[i] else int(touched.min()) if len(touched) else None)
    odd = [(900, None), (901, []), (902, [0.1] * (dims + 1)), (903, [float("nan")] * dims), (904, [None] * dims)]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + odd
    df = spark.createDataFrame(rows, "id LONG, x ARRAY<DOUBLE>").repartition(5)
    got = {r.id: (r.is_core, r.cluster) for r in dbscan_vectors(df, "id", "x", eps, need, block).collect()}
    assert got == want | {i: (False, None) for i, _ in odd} and len(set(want.values())) > 3
    assert dbscan_vectors(df.limit(0), "id", "x", eps, need).count() == 0


def test_vectors_are_not_moved_for_the_pairs_of_blocks(spark, monkeypatch):
    from modsift.operators import density_vectors as V

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.02, (150, 4)) + rng.normal(0, 1, 4) for _ in range(3)] + [rng.normal(0, 1, (60, 4))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<float>").repartition(5)
    plans = []

    def stored(frame, keep=V.stored):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return keep(frame)

    monkeypatch.setattr(V, "stored", stored)
    got = {r.id: (r.is_core, r.cluster) for r in V.dbscan_vectors(df, "id", "x", 0.1, 5, block=16, partition_bytes=1024).collect()}
    links = [p for p in plans if "CartesianProduct" in p and "weak" in p]
    assert links and not any(f"Exchange {kind}partitioning" in p for p in links for kind in ("hash", "range"))
    near = ((x[:, None, :].astype(float) - x[None].astype(float)) ** 2).sum(axis=2) <= 0.1 * 0.1
    core = near.sum(axis=1) >= 5
    label = component_labels(near & core[:, None] & core[None])
    touched = [[int(label[j]) for j in np.flatnonzero(near[i] & core)] for i in range(len(x))]
    assert got == {i: (bool(core[i]), int(label[i]) if core[i] else min(touched[i], default=None)) for i in range(len(x))}


def test_rows_with_one_id_count_together(spark):
    from modsift.operators.density_vectors import dbscan_vectors

    df = spark.createDataFrame([(i, [float(i)]) for i in (1, 1, 2, 2, 9, 9)] + [(20, [20.0])], "id long, x array<double>")
    got = sorted((r.id, r.is_core, r.cluster) for r in dbscan_vectors(df, "id", "x", 1.5, 5).collect())
    assert got == [(1, True, 1)] * 2 + [(2, True, 1)] * 2 + [(9, False, None)] * 2 + [(20, False, None)]


def test_joined_rows_and_columns(spark):
    from modsift.operators.density_vectors import joined, merged

    linked = np.zeros((4, 3), bool)
    linked[0, 1] = linked[2, 1] = linked[2, 2] = linked[3, 0] = True
    rows, cols = joined(linked)
    assert (rows.tolist(), cols.tolist()) == ([0, -1, 0, 3], [3, 0, 0])
    assert merged([[5, 3], [9], [3, 8, 5], [8, 1], [7, 9]]) == {3: 1, 5: 1, 8: 1, 9: 7}
