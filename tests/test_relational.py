import random

import pytest
from pyspark.sql import functions as F

from modsift.operators import augment as G
from modsift.operators import datasets as D
from modsift.operators import relational as R
from modsift.operators import audit as A
from modsift.operators.evaluation import bootstrap_ci, classification_metrics, latency_profile, silhouette
from modsift.operators.quality import source_target_rules


def test_corpus_quality_report_counts_bytes(spark):
    sentence = "这是一个用于测试的中文句子内容"
    rows = [(sentence + "，正常长度的文本内容用于测试。",), ("短文本四",), (sentence * 50,)]
    r = R.corpus_quality_report(spark.createDataFrame(rows, "t STRING"), "t").first()
    assert (r.total, r.valid, r.unique_texts, r.chinese) == (3, 2, 3, 3) and round(r.quality_score, 2) == 66.67


def test_dedup_of_doubled_input(spark):
    rows = [(i, f"text {i % 10}") for i in range(20)]
    df = spark.createDataFrame(rows, "id INT, t STRING")
    assert sorted(r.id for r in R.dedup_exact(df, "t", ["id"]).collect()) == list(range(10))
    r = R.dedup_report(df, "t").first()
    assert (r.total, r.unique_texts, r.duplicates, r.duplicate_rate) == (20, 10, 10, 0.5)


def test_status_events_fold(spark):
    rows = [("a", 1, "pending", ""), ("a", 2, "running", ""), ("a", 3, "running", ""), ("a", 4, "failed", "boom"), ("a", 5, "completed", ""), ("b", 1, "pending", "")]
    df = spark.createDataFrame(rows, "job STRING, ts INT, status STRING, error STRING").withColumn("tie", F.col("ts"))
    got = {r.job: r for r in R.apply_status_events(df, "job", "ts", "tie", "status", "error").collect()}
    assert (got["a"].status, got["a"].started_at, got["a"].ended_at, got["a"].error) == ("completed", 3, 5, "boom")
    assert (got["b"].status, got["b"].started_at, got["b"].ended_at, got["b"].error) == ("pending", None, None, None)


def test_upserts_and_deletes(spark):
    a = spark.createDataFrame([("x", "en", 2), ("y", "en", 1)], "word STRING, language STRING, frequency LONG")
    b = spark.createDataFrame([("x", "en", 1), ("x", "en", 1), ("z", "zh", 1)], a.schema)
    assert {(r.word, r.frequency) for r in R.upsert_vocabulary(a, b).collect()} == {("x", 4), ("y", 1), ("z", 1)}
    cur = spark.createDataFrame([(1, "old", 1), (2, "keep", 1)], "id INT, v STRING, ver INT")
    new = spark.createDataFrame([(1, "new", 2), (3, "add", 1)], cur.schema)
    assert {(r.id, r.v) for r in R.upsert_latest(cur, new, ["id"], ["ver"]).collect()} == {(1, "new"), (2, "keep"), (3, "add")}
    nullable = spark.createDataFrame([(1, None), (2, 5)], "id INT, n INT")
    assert [r.id for r in R.keep_after_delete(nullable, F.col("n") < 9).collect()] == [1]
    jobs = spark.createDataFrame([(1, 0.5, None), (2, 0.1, 3.0)], "job INT, loss DOUBLE, acc DOUBLE")
    ups = spark.createDataFrame([(1, 1, 0.4, 0.9), (1, 2, None, 0.8)], "job INT, ts INT, loss DOUBLE, acc DOUBLE")
    got = {r.job: (r.loss, r.acc) for r in R.apply_metric_updates(jobs, ups, "job", ["loss", "acc"], "ts", "loss").collect()}
    assert got == {1: (0.4, 0.8), 2: (0.1, 3.0)}


def test_search_with_optional_filters(spark):
    df = spark.createDataFrame([(1, "Train A", None, "RUN"), (2, "other", "about train", "DONE"), (3, None, None, "RUN")], "id INT, job_name STRING, description STRING, status STRING")
    assert [r.id for r in R.search_jobs(df, "TRAIN").orderBy("id").collect()] == [1, 2]
    assert [r.id for r in R.search_jobs(df, None, equals={"status": "RUN", "id": None}).orderBy("id").collect()] == [1, 3]
    assert R.search_keyword(df, "100%", "job_name").count() == 0


def test_paging_covers_everything_once(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(20)], "id INT, ts INT")
    order = [F.desc("ts"), F.asc("id")]
    offset_pages = [r.id for p in range(4) for r in R.page(df, order, 6, p * 6).collect()]
    keyset, last = [], None
    while True:
        rows = (R.page(df, order, 6) if last is None else R.page_after(df, "ts", "id", F.lit(last.ts), F.lit(last.id), 6)).collect()
        if not rows:
            break
        keyset += [r.id for r in rows]
        last = rows[-1]
    assert offset_pages == keyset and sorted(keyset) == list(range(20))


def test_source_targets(spark):
    rows = [(i, "answer", "x" * 60, i) for i in range(20)] + [(100, "topic", "y" * 60, None), (101, "topic", "广告" + "y" * 60, None), (102, "other", "y" * 60, None)]
    df = spark.createDataFrame(rows, "id INT, kind STRING, content STRING, votes INT")
    got = source_target_rules(df, "kind", "content", "votes", "id", {"answer": (5, 10), "topic": (1000, 0)})
    assert sorted(r.id for r in got.collect()) == [10, 11, 12, 13, 14, 100]


def test_error_pattern_lines(spark):
    df = spark.createDataFrame([(i, "svc | Connection refused error") for i in range(9)], "n INT, line STRING")
    got = R.error_pattern_matches(df, "n")
    assert {r.pattern for r in got.collect()} == {"ERROR", "Error", "Connection refused"} and got.count() == 15


def test_latency_profile_and_metrics(spark):
    df = spark.createDataFrame([(float(i), i % 10 == 0) for i in range(1, 101)], "ms DOUBLE, bad BOOLEAN")
    r = latency_profile(df, [], "ms", F.col("bad"), seconds=50).first()
    assert (r.p95_ms, r.p99_ms, r.min_ms, r.max_ms, r.error_rate, r.throughput) == (96.0, 100.0, 1.0, 100.0, 0.1, 2.0)
    p = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4, "y INT, p INT")
    m = classification_metrics(p, "y", "p").first()
    assert (m.samples, m.accuracy, m.precision, m.recall) == (10, 0.7, 0.6, 0.75)
    assert m.fpr == pytest.approx(2 / 6) and m.fnr == 0.25


def test_silhouette_edge_cases(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [9.0], 1)], "id INT, f ARRAY<DOUBLE>, c INT")
    got = {r.id: r.silhouette for r in silhouette(df, "id", "f", "c").collect()}
    assert got[3] == 0.0 and got[1] == pytest.approx((81 - 1) / 81)
    assert silhouette(df.withColumn("c", F.lit(0)), "id", "f", "c").first().silhouette is None


def test_cluster_scores_by_blocks(spark):
    from modsift.operators.evaluation import cluster_indices

    rng = random.Random(9)
    rows = [(i, [rng.gauss(i % 12, 0.4), rng.gauss(-(i % 5), 0.4)], i % 12) for i in range(300)]
    df = spark.createDataFrame(rows, "id INT, f ARRAY<DOUBLE>, c INT").repartition(3)
    one, many = ({r.id: r.silhouette for r in silhouette(df, "id", "f", "c", n).collect()} for n in (256, 3))
    assert len(one) == 300 and all(abs(v - many[k]) < 1e-9 for k, v in one.items())
    a, b = (cluster_indices(df, "f", "c", n).first() for n in (256, 3))
    assert a.n == b.n == 300 and a.k == b.k == 12
    assert all(a[c] == pytest.approx(b[c]) for c in ("wcss", "calinski_harabasz", "davies_bouldin"))


def test_bootstrap_covers_mean(spark):
    df = spark.range(20000).withColumn("v", (F.col("id") % 100).cast("double"))
    r = bootstrap_ci(df, "id", "v", replicates=100).first()
    assert r.low < 49.5 < r.high and r.high - r.low < 3 and r.replicates == 100
    again = bootstrap_ci(df.repartition(3), "id", "v", replicates=100).first()
    assert abs(again.low - r.low) < 1e-9 and abs(again.high - r.high) < 1e-9
    empty = bootstrap_ci(df.limit(0), "id", "v", replicates=5).first()
    assert empty.mean is None and empty.replicates == 0


def test_poisson_weights_follow_their_distribution():
    import math

    from modsift.operators import evaluation as E

    bounds = E.poisson_bounds()
    shares = [b / E.PRIME for b in bounds]
    total = 0.0
    for k, share in enumerate(shares):
        total += math.exp(-1) / math.factorial(k)
        assert abs(share - total) < 1e-8
    assert len(bounds) > 9 and bounds == sorted(bounds)


def test_univariate_selection_against_formulas(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        y = rng.choice(["a", "b", "c"])
        rows.append((y, {"a": 0.0, "b": 1.0, "c": 3.0}[y] + rng.gauss(0, 1), rng.gauss(5, 2) if i % 9 else None, rng.choice("xy") if y != "c" else "z", rng.choice("xyz"), 1.0))
    rows += [(None, 1.0, 1.0, "x", "x", 1.0)]
    df = spark.createDataFrame(rows, "y STRING, good DOUBLE, noise DOUBLE, tied STRING, loose STRING, flat DOUBLE").repartition(3)
    got = {r["column"]: (r.test, r.score, r.freedom) for r in D.univariate_scores(df, "y", ["good", "noise", "flat"], ["tied", "loose"]).collect()}

    def anova(at):
        groups = {}
        for r in rows:
            if r[0] is not None and r[at] is not None:
                groups.setdefault(r[0], []).append(r[at])
        n, k = sum(map(len, groups.values())), len(groups)
        mean = sum(map(sum, groups.values())) / n
        between = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups.values())
        within = sum((v - sum(g) / len(g)) ** 2 for g in groups.values() for v in g)
        return (between / (k - 1)) / (within / (n - k))

    def chi(at):
        pairs = [(r[at], r[0]) for r in rows if r[0] is not None]
        xs, ys, n = {x for x, _ in pairs}, {y for _, y in pairs}, len(pairs)
        total = 0.0
        for x in xs:
            for y in ys:
                e = sum(a == x for a, _ in pairs) * sum(b == y for _, b in pairs) / n
                total += (pairs.count((x, y)) - e) ** 2 / e
        return total, (len(xs) - 1) * (len(ys) - 1)

    assert got["good"] == ("anova_f", pytest.approx(anova(1)), 2) and got["noise"][1] == pytest.approx(anova(2)) and got["flat"][1] is None
    for c, at in (("tied", 3), ("loose", 4)):
        score, freedom = chi(at)
        assert got[c] == ("chi_squared", pytest.approx(score), freedom)
    assert D.select_univariate(df, "y", 1, ["good", "noise", "flat"], ["tied", "loose"]).columns == ["y", "good", "tied"]


def test_splits(spark):
    df = spark.range(1000)
    exact = {r.split: r["count"] for r in D.split_dataset(df, "id", 0.1, 0.2, exact=True).groupBy("split").count().collect()}
    assert exact == {"train": 700, "validation": 100, "test": 200}
    a = D.split_dataset(df, "id", 0.1, 0.2).orderBy("id").collect()
    assert a == D.split_dataset(df.repartition(7), "id", 0.1, 0.2).orderBy("id").collect()
    with pytest.raises(ValueError):
        D.split_dataset(df, "id", 0.7, 0.4)


def test_audit_decision(spark):
    df = spark.createDataFrame([(0.2, 0.1), (0.6, 0.9), (0.5, 0.5)], "a DOUBLE, b DOUBLE")
    got = A.audit_texts(df, {"m1": (F.col("a"), "SPAM"), "m2": (F.col("b"), "VIOLENCE")}).collect()
    assert [(r.is_violation, r.violation_type, float(r.confidence)) for r in got] == [(False, "NORMAL", 0.2), (True, "VIOLENCE", 0.9), (True, "SPAM", 0.5)]
    assert got[1].explanation == "flagged by m2" and len(got[0].model_results) == 2


# --- augmentation ------------------------------------------------------------------
@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    words = ["good", "bad", "big", "small", "cat", "dog", "run", "好"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(60)] + [(90, ""), (91, "  "), (92, "one")]
    return spark.createDataFrame(rows, "id INT, t STRING")


def test_augmentation_is_stable_and_keeps_invariants(spark, texts):
    original = {r.id: r.t for r in texts.collect()}
    made = G.augment(texts, "id", "t", 9, most=9)
    rows = made.orderBy("id", "copy").collect()
    assert rows == G.augment(texts.repartition(5, "t"), "id", "t", 9, most=9).orderBy("id", "copy").collect()
    assert rows != G.augment(texts, "id", "t", 9, seed=43, most=9).orderBy("id", "copy").collect()
    assert max(r.copy for r in rows) <= 9 and {r.id for r in rows}.isdisjoint({90, 91})
    for r in rows:
        old, new = original[r.id].split(), r.augmented.split()
        k = max(1, int(len(old) * 0.1))
        assert r.augmented != original[r.id]
        if r.strategy == "random_insert":
            assert len(new) == len(old) + k
        elif r.strategy == "random_delete":
            assert len(new) == max(1, len(old) - k)
        elif r.strategy == "random_swap":
            assert sorted(new) == sorted(old)
        else:
            assert len(new) == len(old) and sum(a != b for a, b in zip(old, new)) <= k
    assert {r.strategy for r in rows} == set(G.STRATEGIES)


def test_other_augmentations(spark, texts):
    original = {r.id: r.t for r in texts.collect()}
    noisy = G.noise_augment(texts, "id", "t", 20).collect()
    assert noisy and all(abs(len(r.augmented) - len(original[r.id])) <= 1 for r in noisy) and 90 not in {r.id for r in noisy}
    back = G.back_translation_augment(texts, "id", "t", 10).collect()
    assert back and all(len(r.augmented.split()) == len(original[r.id].split()) for r in back)
    lists = {r.key: r.augmented for r in G.batch_augment(texts, "id", "t", 3).collect()}
    assert len(lists) == 63 and lists["text_90"] == []


def all_links(rows, threshold):
    """Links of every row and clusters, over all pairs."""
    sets = [set(tokens or ()) for _, tokens in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for i, (row, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    return sorted((row, min(groups[find(i)]), links[i]) for i, (row, _) in enumerate(rows))


def family_with_loose_low_ids(rng, rows):
    """Many lower ids at 0.72 to a base, and two higher ones at 0.89 to each other."""
    for _ in range(6):
        base = [f"b{rng.randrange(10**9)}" for _ in range(60)]
        for _ in range(30):
            kept = rng.sample(base, 50)
            rows.append((len(rows), kept + [f"y{rng.randrange(10**9)}" for _ in range(10)]))
        rows += [(len(rows), base), (len(rows) + 1, base[:-3] + ["p1", "p2", "p3"])]


def test_similarity_join_against_all_pairs(spark):
    import random

    from modsift.operators.similarity import near_duplicate_clusters, similar_sets

    rng = random.Random(4)
    rows = []
    for group in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(60)]
        for copy in range(4):
            rows.append((len(rows), [w if rng.random() > 0.03 * copy else "x" + w for w in base]))
    family_with_loose_low_ids(rng, rows)
    common = [f"c{i}" for i in range(12)]
    for _ in range(150):  # short sets of few common words
        rows.append((len(rows), rng.sample(common, rng.randrange(1, 9))))
    n = len(rows)
    rows += [(n, []), (n + 1, rows[5][1]), (n + 2, None), (n + 3, rows[5][1] * 2), (5, ["other", "words"])]
    df = spark.createDataFrame(rows, "id INT, tk ARRAY<STRING>").repartition(5)
    for threshold, block in ((0.85, 2048), (0.85, 7), (0.6, 2048), (0.6, 16)):
        got = sorted(tuple(r) for r in similar_sets(df, "id", "tk", threshold, block).collect())
        want = all_links(rows, threshold)
        assert got == want, (threshold, block)
    assert sum(w[2] for w in want) > 1000
    assert similar_sets(df.limit(0), "id", "tk").count() == 0
    named = df.selectExpr("concat('id', lpad(id, 4, '0')) AS id", "tk")
    assert {r.id: r.cluster for r in near_duplicate_clusters(named, "id", "tk").collect()}["id0001"] == "id0000"


def test_bounds_of_the_prefix_index():
    import numpy as np

    from modsift.operators import similarity as S

    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.choice(10**9, rng.integers(1, 200), replace=False).astype(np.int64) << 18
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.choice(10**9, rng.integers(1, 60)).astype(np.int64) << 18]))
        x, y = S.parity_bitmap(a), S.parity_bitmap(b)
        width = 8 * min(len(x), len(y))
        folded = [S._folded(int.from_bytes(m, "little"), 8 * len(m), width) for m in (x, y)]
        assert (folded[0] ^ folded[1]).bit_count() <= len(np.setxor1d(a, b))
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))) for _ in range(50)]
    sets += [np.unique(rng.integers(0, 4000, 30)) for _ in range(50)]
    common = S.overlaps(sets, chunk=8)
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(100) for j in range(100) if i != j)
    assert [S.prefix_length(n, 0.85) for n in (1, 7, 20, 100)] == [1, 2, 4, 16]
    assert S.required_overlap(7, 8, 0.85) == 7


def test_similar_to_targets_against_all_pairs(spark):
    import random

    from modsift.operators import relational as R

    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(120)]
    rows += [(200, [50.0, 60.0]), (201, []), (202, None), (203, [float("nan"), float("inf"), None, 0.1]), (204, [0.5, 0.25, 0.75])]
    df = spark.createDataFrame(rows, "id LONG, x ARRAY<DOUBLE>").repartition(4)
    targets = F.col("id").isin(0, 40, 200, 201, 202, 204)
    for threshold in (0.05, 0.25):
        got = sorted(tuple(r) for r in R.similar_to_targets(df, "id", "x", targets, threshold, 7).collect())
        want = []
        for t, b in rows:
            if t in (0, 40, 200, 201, 202, 204):
                scored = [(-sum(abs(v - w) < threshold for v in a or [] if v is not None for w in b or []), i) for i, a in rows if i != t]
                want += [(t, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:7], 1)]
        assert got == sorted(want)
    assert R.similar_to_targets(df.limit(0), "id", "x", targets, 0.1, 3).count() == 0


def test_pairs_over_gaps_and_chunks(spark):
    from modsift.operators.instruct import conversation_pairs

    turns = {
        1: [(0, "user"), (1, "assistant"), (2, "user"), (5, "assistant"), (6, "assistant"), (7, "user")],
        2: [(3, "user"), (4, "user"), (9, "assistant"), (2500, "user"), (7000, "assistant")],
        3: [(999, "user"), (1000, "assistant"), (1999, "user"), (2000, "user"), (4001, "assistant")],
    }
    rows = [(c, t, r, f"{r}{c}-{t}") for c, said in turns.items() for t, r in said] + [(4, 1, "user", "q"), (4, 1, "user", "q"), (4, 2, "assistant", "b"), (4, 2, "assistant", "a"), (4, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv INT, turn INT, role STRING, text STRING").repartition(4)
    want = [(4, 1, "q", "a")]
    for c, said in turns.items():
        for (t, r), (u, q) in zip(said, said[1:]):
            if (r, q) == ("user", "assistant"):
                want.append((c, t, f"user{c}-{t}", f"assistant{c}-{u}"))
    for chunk in (1, 1000, 10**6):
        assert sorted(tuple(r) for r in conversation_pairs(df, "conv", "turn", "role", "text", chunk).collect()) == sorted(want)


def test_large_top_n_is_cut_by_counted_rows(spark):
    from modsift.operators.scale import top_n_per_key

    df = spark.range(30_000).select((F.col("id") % 3 * F.col("id") % 2).alias("k"), F.xxhash64("id").alias("v"), "id")
    for n in (1500, 5000):
        got = top_n_per_key(df, ["k"], [F.asc("v"), F.asc("id")], n, piece_rows=1000)
        rows = df.collect()
        for k in {r.k for r in rows}:
            best = sorted((r.v, r.id) for r in rows if r.k == k)[:n]
            assert [(r.v, r.id) for r in got.where(F.col("k") == k).orderBy("rank").collect()] == best
