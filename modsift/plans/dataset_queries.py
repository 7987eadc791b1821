"""Queries: datasets, evaluation, audit, instruction records, windowed rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from modsift.functions import scores as S
from modsift.functions import text as T
from modsift.operators import audit as A
from modsift.operators import datasets as D
from modsift.operators import evaluation as E
from modsift.operators import features as X
from modsift.operators import instruct as I
from modsift.plans import fixtures as fx
from modsift.plans.registry import query
from modsift.plans.text_queries import NEG, POS, STOP_SQL
from modsift.sources import sinks as K
from modsift.streaming import windows as W


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


# --- datasets -----------------------------------------------------------------------
@query(
    "d1_split_dataset_exact",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42|' || doc_id)) - 1 AS rank, count(*) OVER () AS n FROM documents)
      SELECT doc_id, CASE WHEN rank < floor(n * 0.15::DOUBLE) THEN 'test' WHEN rank < floor(n * 0.15::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def _(t):
    return D.split_dataset(t.documents.select("doc_id"), "doc_id", 0.1, 0.15, exact=True)


@query(
    "d1_split_dataset_by_hash",
    """WITH r AS (SELECT doc_id, ('0x' || sha256('42|' || doc_id)[1:8])::BIGINT / 4294967296.0::DOUBLE AS p FROM documents)
      SELECT doc_id, CASE WHEN p < 0.1::DOUBLE THEN 'test' WHEN p < 0.2::DOUBLE THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def _(t):
    return D.split_dataset(t.documents.select("doc_id"), "doc_id", 0.1, 0.1)


_NUM = ["c_acctbal", "c_nationkey"]


@query(
    "d2_feature_statistics",
    """WITH c AS (SELECT 'c_acctbal' AS "column", c_acctbal AS value FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::DOUBLE FROM customer),
      q AS (SELECT "column", quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75 FROM c GROUP BY 1)
    SELECT c."column", count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
      round(any_value(q25), 4) AS q25, round(any_value(median), 4) AS median, round(any_value(q75), 4) AS q75, round(kurtosis_pop(value), 6) AS kurtosis,
      count(DISTINCT value) AS unique_values, count(*) FILTER (value < q25 - 1.5::DOUBLE * (q75 - q25) OR value > q75 + 1.5::DOUBLE * (q75 - q25)) AS outliers
    FROM c JOIN q ON c."column" = q."column" GROUP BY 1""",
)
def _(t):
    s = D.feature_statistics(t.customer, _NUM)
    return s.select(
        "column", "n", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "std", "q25", "median", "q75")],
        r6("kurtosis"), "unique_values", "outliers",
    )


@query("d3_class_distribution", "SELECT toxic AS class, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 6) AS share FROM labels GROUP BY 1")
def _(t):
    return D.class_distribution(t.labels, "toxic").withColumn("share", F.round("share", 6))


@query(
    "d3_missing_values",
    f"""WITH {fx.LABELED_SQL} SELECT 'doc_id' AS "column", 'bigint' AS data_type, count(*) FILTER (doc_id IS NULL) AS missing FROM labeled
      UNION ALL SELECT 'label', 'int', count(*) FILTER (label IS NULL) FROM labeled UNION ALL SELECT 'source', 'string', count(*) FILTER (source IS NULL) FROM labeled""",
)
def _(t):
    return D.missing_values(fx.labeled_texts(t).select("doc_id", "label", "source"))


@query(
    "d4_correlation_matrix",
    """SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem UNION ALL
      SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL
      SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem""",
)
def _(t):
    m = D.correlation_matrix(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return m.where("a <> b").withColumn("correlation", F.round("correlation", 6))


@query(
    "d5_standard_and_minmax_scaling",
    """WITH p AS (SELECT avg(p_size) AS m, stddev_samp(p_size) AS s, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part WHERE p_partkey % 5 <> 0)
      SELECT p_partkey, round((p_size - m) / s, 6) AS p_size, round((p_retailprice - lo) / (hi - lo), 6) AS p_retailprice FROM part, p""",
)
def _(t):
    d = t.part.select("p_partkey", "p_size", "p_retailprice")
    train = F.col("p_partkey") % 5 != 0
    d = D.preprocess_dataset(d, ["p_retailprice"], "minmax", train=train)
    return D.preprocess_dataset(d, ["p_size"], "standard", train=train).select("p_partkey", r6("p_size"), r6("p_retailprice"))


@query(
    "d5_impute_mean",
    """WITH v AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size END AS x FROM part) SELECT p_partkey, round(coalesce(x, (SELECT avg(x) FROM v)), 6) AS x FROM v""",
)
def _(t):
    d = t.part.select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("x"))
    return D.preprocess_dataset(d, ["x"], "none").select("p_partkey", r6("x"))


@query(
    "d5_select_by_variance",
    """SELECT 'l_extendedprice' AS "column", round(var_samp(l_extendedprice), 2) AS variance FROM lineitem UNION ALL SELECT 'l_quantity', round(var_samp(l_quantity), 2) FROM lineitem""",
)
def _(t):
    v = D.select_by_variance(t.lineitem, ["l_extendedprice", "l_quantity", "l_tax"], 1.0)
    return v.withColumn("variance", F.round("variance", 2))


@query(
    "d5_univariate_scores",
    """WITH c AS (SELECT c_acctbal::DOUBLE AS x, c_mktsegment AS y, 'c_acctbal' AS col FROM customer UNION ALL SELECT c_custkey::DOUBLE, c_mktsegment, 'c_custkey' FROM customer),
      g AS (SELECT col, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM c GROUP BY 1, 2), a AS (SELECT col, sum(n) AS n, sum(n * m) / sum(n) AS m, count(*) AS k FROM g GROUP BY 1),
      f AS (SELECT g.col, any_value(a.n) AS n, any_value(a.k) AS k, sum(g.n * (g.m - a.m) * (g.m - a.m)) AS b, sum(g.n * g.v) AS w FROM g JOIN a USING (col) GROUP BY 1),
      o AS (SELECT c_nationkey AS x, c_mktsegment AS y, count(*) AS o FROM customer GROUP BY 1, 2),
      e AS (SELECT o, sum(o) OVER (PARTITION BY x) AS r, sum(o) OVER (PARTITION BY y) AS c, sum(o) OVER () AS n, x, y FROM o)
      SELECT col AS "column", 'anova_f' AS test, round((b / (k - 1)) / (w / (n - k)), 4) AS score, CAST(k - 1 AS BIGINT) AS freedom FROM f
      UNION ALL SELECT 'c_nationkey', 'chi_squared', round(any_value(n) * (sum(o * o / (r * c)::DOUBLE) - 1), 4), CAST((count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS BIGINT) FROM e""",
)
def _(t):
    s = D.univariate_scores(t.customer, "c_mktsegment", numeric=["c_acctbal", "c_custkey"], categorical=["c_nationkey"])
    return s.select("column", "test", F.round("score", 4).alias("score"), "freedom")


@query(
    "d5_reduce_dimensions",
    "SELECT l_orderkey, l_linenumber, 2 AS n_components, true AS ordered, true AS explains FROM lineitem",
)
def _(t):
    """Two components of three columns: the first spreads more than the second, together they hold most of the spread."""
    names = ["l_quantity", "l_discount", "l_tax"]
    d = D.reduce_dimensions(t.lineitem.select("l_orderkey", "l_linenumber", *names), names, 2)
    c = lambda i: F.get("components", F.lit(i))
    whole = d.agg(F.var_pop(c(0)).alias("a"), F.var_pop(c(1)).alias("b"), sum((F.var_pop(n) for n in names), F.lit(0.0)).alias("all"))
    ordered = whole.select((F.col("a") >= F.col("b")) & (F.col("b") > 0)).scalar()
    explains = whole.select((F.col("a") + F.col("b")).between(F.col("all") * 2 / 3, F.col("all") * (1 + 1e-9))).scalar()
    return d.select("l_orderkey", "l_linenumber", F.size("components").alias("n_components"), ordered.alias("ordered"), explains.alias("explains"))


@query("d6_sample_dataset", "SELECT c_custkey FROM customer ORDER BY sha256('42|' || c_custkey) LIMIT 100")
def _(t):
    return D.sample_dataset(t.customer, "c_custkey", 100).select("c_custkey")


@query(
    "d7_validate_dataset",
    """SELECT 'non_empty' AS "check", count(*) > 0 AS ok FROM customer UNION ALL SELECT 'target_present', true UNION ALL SELECT 'numeric_features', true
      UNION ALL SELECT 'enough_classes', count(DISTINCT c_mktsegment) >= 2 FROM customer UNION ALL SELECT 'missing_share', count(*) FILTER (c_acctbal IS NULL) <= count(*) * 0.5 FROM customer""",
)
def _(t):
    return D.validate_dataset(t.customer.select("c_acctbal", "c_nationkey", "c_mktsegment"), "c_mktsegment", "classification")


@query(
    "d8_balance_classes",
    """SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY sha256('42|' || doc_id)) AS rn FROM labels)
      WHERE rn <= floor(60 / (SELECT count(DISTINCT toxic) FROM labels))""",
)
def _(t):
    return D.balance_classes(t.labels.select("doc_id", "toxic"), "doc_id", "toxic", 60)


@query(
    "d9_dataset_summary",
    """WITH r AS (SELECT doc_id, toxic, ('0x' || sha256('42|' || doc_id)[1:8])::BIGINT / 4294967296.0::DOUBLE AS p FROM labels)
      SELECT CASE WHEN p < 0.1::DOUBLE THEN 'test' WHEN p < 0.2::DOUBLE THEN 'validation' ELSE 'train' END AS split, count(*) AS rows, count(DISTINCT toxic) AS classes, 14 AS features FROM r GROUP BY 1""",
)
def _(t):
    return D.dataset_summary(D.split_dataset(t.labels, "doc_id", 0.1, 0.1), "split", "toxic", 14)


# --- evaluation -----------------------------------------------------------------------
PREDICTED_SQL = "predicted AS (SELECT l.doc_id, l.quality AS actual, CASE WHEN d.n_chars > 800 THEN 1 ELSE 0 END AS predicted, d.n_chars AS score, d.lang AS variant FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def predicted(t):
    d = t.documents.select("doc_id", "n_chars", "lang").join(t.labels, "doc_id")
    return d.select("doc_id", F.col("quality").alias("actual"), F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("predicted"),
                    F.col("n_chars").alias("score"), F.col("lang").alias("variant"))


_CM = """SELECT {v} count(*) AS samples, count(*) FILTER (actual = predicted) AS hit, count(*) FILTER (actual = 1 AND predicted = 1) AS tp,
  count(*) FILTER (actual = 0 AND predicted = 1) AS fp, count(*) FILTER (actual = 1 AND predicted = 0) AS fn, count(*) FILTER (actual = 0 AND predicted = 0) AS tn FROM predicted {g}"""


@query("e1_confusion_matrix", f"WITH {PREDICTED_SQL} SELECT actual, predicted, count(*) AS n FROM predicted GROUP BY 1, 2")
def _(t):
    return E.confusion_counts(predicted(t), "actual", "predicted")


@query(
    "e1_classification_metrics",
    f"""WITH {PREDICTED_SQL}, c AS ({_CM.format(v='', g='')}), m AS (SELECT *, tp / (tp + fp)::DOUBLE AS p1, tp / (tp + fn)::DOUBLE AS r1, tn / (tn + fn)::DOUBLE AS p0, tn / (tn + fp)::DOUBLE AS r0 FROM c)
      SELECT samples, round(hit / samples::DOUBLE, 6) AS accuracy, round(p1, 6) AS precision, round(r1, 6) AS recall, round(2 * p1 * r1 / (p1 + r1), 6) AS f1,
      round((p1 * (tp + fn) + p0 * (tn + fp)) / samples, 6) AS weighted_precision, round((2 * p1 * r1 / (p1 + r1) * (tp + fn) + CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END * (tn + fp)) / samples, 6) AS weighted_f1 FROM m""",
)
def _(t):
    m = E.classification_metrics(predicted(t), "actual", "predicted")
    return m.select("samples", *[r6(c) for c in ("accuracy", "precision", "recall", "f1", "weighted_precision", "weighted_f1")])


@query(
    "e2_auc_roc",
    f"""WITH {PREDICTED_SQL}, p AS (SELECT score FROM predicted WHERE actual = 1), n AS (SELECT score FROM predicted WHERE actual = 0)
      SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auc FROM p, n""",
)
def _(t):
    return E.auc_roc(predicted(t), "score", "actual").select(r6("auc"))


@query(
    "e3_regression_metrics",
    """WITH p AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500.0::DOUBLE AS f FROM lineitem)
      SELECT l_returnflag, round(avg((y - f) * (y - f)), 2) AS mse, round(avg(abs(y - f)), 4) AS mae, round(sqrt(avg((y - f) * (y - f))), 4) AS rmse,
      round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2, round(corr(y, f) * corr(y, f), 6) AS squared_correlation FROM p GROUP BY 1""",
)
def _(t):
    p = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("f"))
    m = E.regression_metrics(p, "y", "f", ["l_returnflag"])
    return m.select("l_returnflag", F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), r6("r2"), r6("squared_correlation"))


@query(
    "e4_silhouette",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
      c AS (SELECT label, i, avg(v) AS m, sum(v * v) AS sq, count(*) AS n FROM x GROUP BY 1, 2),
      s AS (SELECT label, any_value(n) AS n, sum(sq) / any_value(n) - sum(m * m) AS spread FROM c GROUP BY 1),
      d AS (SELECT vec_id, x.label AS own, c.label, sum((v - m) * (v - m)) AS dist FROM x JOIN c USING (i) GROUP BY 1, 2, 3),
      e AS (SELECT vec_id, own, max(CASE WHEN own = d.label THEN (dist + spread) * n / (n - 1) END) AS a, min(CASE WHEN own <> d.label THEN dist + spread END) AS b FROM d JOIN s ON s.label = d.label GROUP BY 1, 2)
      SELECT vec_id, own AS cluster, round((b - a) / greatest(a, b), 6) AS silhouette FROM e""",
)
def _(t):
    return E.silhouette(t.embeddings, "vec_id", "embedding", "label").select("vec_id", "cluster", r6("silhouette"))


@query(
    "e5_cluster_indices",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
      c AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM x GROUP BY 1, 2), g AS (SELECT i, avg(v) AS m FROM x GROUP BY 1),
      d AS (SELECT vec_id, x.label, sum((v - m) * (v - m)) AS dist FROM x JOIN c ON c.label = x.label AND c.i = x.i GROUP BY 1, 2),
      b AS (SELECT sum(n * (c.m - g.m) * (c.m - g.m)) AS between_ss FROM c JOIN g USING (i)),
      t AS (SELECT label, avg(sqrt(dist)) AS scatter FROM d GROUP BY 1),
      p AS (SELECT c1.label AS l1, c2.label AS l2, sqrt(sum((c1.m - c2.m) * (c1.m - c2.m))) AS sep FROM c c1 JOIN c c2 ON c1.i = c2.i AND c1.label <> c2.label GROUP BY 1, 2),
      w AS (SELECT l1, max((t1.scatter + t2.scatter) / sep) AS worst FROM p JOIN t t1 ON t1.label = l1 JOIN t t2 ON t2.label = l2 GROUP BY 1)
      SELECT (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM t) AS k, round((SELECT sum(dist) FROM d), 4) AS wcss,
      round(((SELECT between_ss FROM b) / ((SELECT count(*) FROM t) - 1)) / ((SELECT sum(dist) FROM d) / ((SELECT count(*) FROM d) - (SELECT count(*) FROM t))), 4) AS calinski_harabasz,
      round((SELECT avg(worst) FROM w), 6) AS davies_bouldin""",
)
def _(t):
    m = E.cluster_indices(t.embeddings, "embedding", "label")
    return m.select("n", F.col("k").cast("long").alias("k"), F.round("wcss", 4).alias("wcss"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"), r6("davies_bouldin"))


_BOUNDS = ", ".join(f"{x}::BIGINT" for x in E.poisson_bounds())


@query(
    "e7_bootstrap_ci",
    f"""WITH c AS (SELECT r, ('0x' || substr(md5('42:' || r), 1, 7))::BIGINT * 2 + 1 AS a, ('0x' || substr(md5('42:' || r), 8, 7))::BIGINT AS b FROM (SELECT unnest(range(1, 1001)) AS r)),
      h AS (SELECT ('0x' || substr(md5('42|' || event_id), 1, 7))::BIGINT AS h, value AS v FROM events WHERE value IS NOT NULL),
      u AS (SELECT r, v, h, (a * h + b) % {E.PRIME}::BIGINT AS u FROM h CROSS JOIN c),
      w AS (SELECT r, v, len(list_filter([{_BOUNDS}], lambda x: x <= (u * u + h) % {E.PRIME}::BIGINT)) AS w FROM u),
      m AS (SELECT r, sum(w * v) / sum(w) AS m FROM w GROUP BY 1)
      SELECT count(*) AS replicates, round(avg(m), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m""",
)
def _(t):
    r = E.bootstrap_ci(t.events, "event_id", "value")
    return r.select("replicates", F.round("mean", 4).alias("mean"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(
    "e8_ab_compare",
    f"""WITH {PREDICTED_SQL}, c AS ({_CM.format(v='variant,', g='GROUP BY 1')}), m AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS p1, tp / nullif(tp + fn, 0)::DOUBLE AS r1 FROM c),
      l AS (SELECT variant, avg(score) AS avg_ms, list_sort(list(score))[(count(*) * 95 // 100) + 1] AS p95_ms, count(*) FILTER (doc_id % 10 = 0) / count(*)::DOUBLE AS error_rate FROM predicted GROUP BY 1)
      SELECT m.variant, samples, round(hit / samples::DOUBLE, 6) AS accuracy, round(coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0), 6) AS f1, round(avg_ms, 4) AS avg_ms, p95_ms, round(error_rate, 6) AS error_rate FROM m JOIN l USING (variant)""",
)
def _(t):
    r = E.ab_compare(predicted(t), "variant", "actual", "predicted", "score", F.col("doc_id") % 10 == 0)
    return r.select("variant", "samples", r6("accuracy"), r6("f1"), F.round("avg_ms", 4).alias("avg_ms"), "p95_ms", r6("error_rate"))


@query(
    "e9_error_rates_and_primary_metric",
    f"""WITH {PREDICTED_SQL}, c AS ({_CM.format(v='', g='')}) SELECT round(fp / (fp + tn)::DOUBLE, 6) AS fpr, round(fn / (fn + tp)::DOUBLE, 6) AS fnr, round(hit / samples::DOUBLE, 6) AS primary_metric FROM c""",
)
def _(t):
    m = E.classification_metrics(predicted(t), "actual", "predicted")
    none = F.lit(None).cast("double")
    return m.select(r6("fpr"), r6("fnr"), r6(S.primary_metric(none, F.col("accuracy"), F.col("f1")), "primary_metric"))


HISTORY_SQL = "history AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch, value AS score FROM events)"


@query(
    "e10_best_epoch",
    """WITH h AS (SELECT user_id AS job, event_id // 150 AS epoch, max(value) AS score FROM events GROUP BY 1, 2),
      i AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY job ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM h),
      n AS (SELECT *, coalesce(lead(epoch) OVER (PARTITION BY job ORDER BY epoch) - 1, (SELECT max(epoch) FROM h h2 WHERE h2.job = i.job)) AS idle FROM i WHERE up),
      f AS (SELECT job, min(epoch) FILTER (idle - epoch >= 10) AS fe, max(epoch) AS le, any_value((SELECT max(epoch) FROM h WHERE h.job = n.job)) AS last FROM n GROUP BY 1)
      SELECT f.job, coalesce(fe, le) AS best_epoch, h.score AS best_score, fe IS NOT NULL AS early_stopped, coalesce(fe + 10, last) AS stop_epoch FROM f JOIN h ON h.job = f.job AND h.epoch = coalesce(fe, le)""",
)
def _(t):
    h = t.events.groupBy(F.col("user_id").alias("job"), F.floor(F.col("event_id") / 150).alias("epoch")).agg(F.max("value").alias("score"))
    return E.best_epoch(h, "job", "epoch", "score", 10)


# --- audit ----------------------------------------------------------------------------
@query(
    "i3_analyze_sentiment",
    f"""WITH c AS (SELECT doc_id, len(list_filter(k, lambda x: x IN ('the', 'and', 'la', '的'))) AS p, len(list_filter(k, lambda x: x IN ('of', 'to', 'de', '好'))) AS q FROM (SELECT doc_id, {fx.tok('text')} AS k FROM documents)),
      s AS (SELECT *, CASE WHEN p + q > 0 THEN (p - q) / (p + q)::DOUBLE ELSE 0.0 END AS pol FROM c)
      SELECT doc_id, CASE WHEN pol > 0.1 THEN 'positive' WHEN pol < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment, round(abs(pol), 6) AS confidence FROM s""",
)
def _(t):
    s = t.documents.select("doc_id", X.sentiment_struct(T.tokenize("text", lower=True), POS, NEG).alias("s"))
    return s.select("doc_id", F.col("s.sentiment_class").alias("sentiment"), r6("s.confidence", "confidence"))


@query(
    "i4_detect_anomaly",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
      SELECT event_id, value < a - 1.5::DOUBLE * (b - a) OR value > b + 1.5::DOUBLE * (b - a) AS is_anomaly,
      round(greatest(0.0, a - 1.5::DOUBLE * (b - a) - value, value - (b + 1.5::DOUBLE * (b - a))) / (b - a), 6) AS anomaly_score FROM events JOIN q USING (event_type)""",
)
def _(t):
    return A.detect_anomaly(t.events, ["event_type"], "value").select("event_id", "is_anomaly", r6("anomaly_score"))


def _score_sql(words):
    return f"CASE WHEN len(tk) > 0 THEN least(1.0::DOUBLE, len(list_filter(tk, lambda x: x IN ({', '.join(repr(w) for w in words)}))) / len(tk)::DOUBLE * 10.0::DOUBLE) ELSE 0.0 END"


_ADS, _HATE = ["the", "la", "und"], ["of", "de"]


@query(
    "i5_audit_texts",
    f"""WITH s AS (SELECT doc_id, {_score_sql(_ADS)} AS a, {_score_sql(_HATE)} AS h FROM (SELECT doc_id, {fx.tok('text')} AS tk FROM documents))
      SELECT doc_id, greatest(a, h) >= 0.5::DOUBLE AS is_violation, round(greatest(a, h), 4) AS confidence,
      CASE WHEN greatest(a, h) < 0.5::DOUBLE THEN 'NORMAL' WHEN a >= h THEN 'ADVERTISEMENT' ELSE 'HATE_SPEECH' END AS violation_type FROM s""",
)
def _(t):
    d = t.documents.select("doc_id", T.tokenize("text", lower=True).alias("tk"))
    scores = {"ads": (A.rule_score("tk", _ADS), "ADVERTISEMENT"), "hate": (A.rule_score("tk", _HATE), "HATE_SPEECH")}
    return A.audit_texts(d, scores).select("doc_id", "is_violation", F.col("confidence").cast("double").alias("confidence"), "violation_type")


@query(
    "i2_classify_text",
    f"""WITH s AS (SELECT doc_id, {_score_sql(_ADS)} AS s FROM (SELECT doc_id, {fx.tok('text')} AS tk FROM documents))
      SELECT doc_id, CASE WHEN s >= 0.7::DOUBLE THEN '违规' WHEN s >= 0.3::DOUBLE THEN '疑似违规' ELSE '正常' END AS moderation_class,
      round(CASE WHEN s >= 0.7::DOUBLE THEN s WHEN s >= 0.3::DOUBLE THEN 1 - abs(s - 0.5::DOUBLE) ELSE 1 - s END, 6) AS confidence FROM s""",
)
def _(t):
    d = t.documents.select("doc_id", A.rule_score(T.tokenize("text", lower=True), _ADS).alias("score"))
    return A.classify_text(d, "score").select("doc_id", "moderation_class", r6("confidence"))


@query(
    "i6_rule_labels",
    f"""SELECT doc_id, CASE WHEN list_has_any(tk, ['thanedble', 'reaulion', 'thththe']) THEN 1 WHEN list_has_any(tk, ['und', 'der']) THEN 4 WHEN list_has_any(tk, ['la']) THEN 2 ELSE 0 END AS rule_label
      FROM (SELECT doc_id, {fx.tok('text')} AS tk FROM documents)""",
)
def _(t):
    d = t.documents.select("doc_id", T.tokenize("text", lower=True).alias("tk"))
    rules = [("spam", ["thanedble", "reaulion", "thththe"]), ("advertising", ["und", "der"]), ("offensive", ["la"])]
    return d.select("doc_id", A.rule_labels("tk", rules).alias("rule_label"))


@query(
    "i7_requests_by",
    f"""WITH {fx.REQUESTS_SQL} SELECT request_id, status FROM requests WHERE model_name = 'model_1' AND status = 'failed' ORDER BY created_at DESC, request_id LIMIT 20 OFFSET 5""",
)
def _(t):
    return A.requests_by(fx.requests(t), 20, 5, model_name="model_1", status="failed").select("request_id", "status")


# --- instruction records ---------------------------------------------------------------
@query(
    "t1_instruction_format",
    f"""WITH {fx.QA_SQL} SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '请根据以下问题提供准确、详细的回答：' WHEN 1 THEN '请参与以下对话并提供合适的回复：' WHEN 2 THEN '请分析以下问题并提供逻辑推理：' ELSE '请回答以下问题：' END AS instruction,
      '问题：' || question || chr(10) || '话题：t' || (turn % 3) || ', forum' || CASE WHEN turn > 2 THEN chr(10) || '背景：turn ' || turn ELSE '' END AS input, '回答：' || answer AS output FROM qa""",
)
def _(t):
    kinds = F.array(F.lit("QUESTION_ANSWER"), F.lit("CONVERSATION"), F.lit("REASONING"), F.lit(None).cast("string"))
    qa = fx.qa_pairs(t).withColumn("data_type", F.element_at(kinds, (F.col("conv_id") % 4 + 1).cast("int")))
    qa = qa.withColumn("topics", F.array(F.concat(F.lit("t"), F.col("turn") % 3), F.lit("forum")))
    qa = qa.withColumn("context", F.when(F.col("turn") > 2, F.concat(F.lit("turn "), "turn")))
    return I.to_instruction_format(qa, topics="topics", context="context").select("conv_id", "turn", "record.instruction", "record.input", "record.output")


@query(
    "t2_simple_format",
    f"""WITH {fx.QA_SQL} SELECT conv_id, turn, '请根据以下问题生成高质量的回答：' AS instruction, '问题：' || question AS input, '回答：' || answer AS output FROM qa""",
)
def _(t):
    return I.to_simple_format(fx.qa_pairs(t)).select("conv_id", "turn", "record.*")


@query(
    "t3_conversation_pairs",
    f"WITH {fx.QA_SQL} SELECT conv_id, turn, question, answer, 'CONVERSATION' AS data_type, 0.7::DOUBLE AS quality_score FROM qa",
)
def _(t):
    return I.conversation_records(fx.qa_pairs(t))


@query(
    "t4_training_batches",
    f"""WITH {fx.QA_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY sha256('batch|' || conv_id || ':' || turn)) - 1 AS rank, count(*) OVER () AS n FROM qa)
      SELECT conv_id, turn, rank // 50 AS batch_id, (rank // 50 + 1) * 50 <= n AS batch_complete FROM r""",
)
def _(t):
    qa = fx.qa_pairs(t).select("conv_id", "turn")
    return I.assign_training_batches(qa, F.concat("conv_id", F.lit(":"), "turn"), 50).select("conv_id", "turn", "batch_id", "batch_complete")


@query(
    "t5_parse_training_log",
    """SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN (event_id % 30)::INT END AS epoch, CASE WHEN event_id % 3 <> 1 THEN value END AS loss,
      CASE WHEN event_id % 3 = 0 THEN 0.0005::DOUBLE END AS learning_rate FROM events""",
)
def _(t):
    e = F.col("event_id")
    line = F.concat_ws(
        " ", F.lit("step"), e, F.when(e % 3 != 2, F.concat(F.lit("Epoch "), e % 30, F.lit("/30"))),
        F.when(e % 3 != 1, F.concat(F.lit("loss "), F.col("value"))), F.when(e % 3 == 0, F.lit("learning_rate 5e-4")),
    )
    return I.parse_training_log(t.events.select("event_id", line.alias("line"))).select("event_id", "epoch", "loss", "learning_rate")


@query(
    "k5_training_json",
    f"""WITH {fx.QA_SQL} SELECT conv_id, turn, sha256('{{"instruction":"请根据以下问题生成高质量的回答：","input":' || to_json('问题：' || question) || ',"output":' || to_json('回答：' || answer) || '}}') AS json_hash FROM qa""",
)
def _(t):
    rec = I.to_simple_format(fx.qa_pairs(t))
    return rec.select("conv_id", "turn", F.sha2(F.to_json("record"), 256).alias("json_hash"))


@query(
    "k6_envelope",
    """SELECT sha256('raw_text|' || doc_id) AS message_id, 'raw_text' AS type, source, 1704067200 + doc_id AS timestamp, n_chars AS payload_chars FROM documents""",
)
def _(t):
    d = t.documents.select("doc_id", "source", F.struct("doc_id", "n_chars").alias("data"), (F.col("doc_id") + 1704067200).alias("seconds"))
    wrapped = K.wrap_envelope(d, "raw_text", "doc_id", "source", "data", "seconds")
    out = K.unwrap_envelope(wrapped, "doc_id LONG, n_chars LONG")
    return out.select("message_id", "type", "source", "timestamp", F.col("data.n_chars").alias("payload_chars"))


# --- windowed rates (the batch form of the streaming operators) --------------------------
@query(
    "w5_windowed_error_rate",
    """WITH m AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS minute, ts, event_type FROM events), w AS (SELECT minute - k.i * INTERVAL 1 HOUR AS start, event_type FROM m, (SELECT unnest(range(0, 6)) AS i) k)
      SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / 21600.0::DOUBLE, 8) AS rate,
      count(*) FILTER (event_type = 'error') / 21600.0::DOUBLE > 0.0008::DOUBLE AS breach FROM w GROUP BY 1""",
)
def _(t):
    r = W.windowed_rate(t.events, "ts", F.col("event_type") == "error", "6 hours", "1 hour", 21600, 0.0008)
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "errors", F.round("rate", 8).alias("rate"), "breach")


_EDGES = [5, 10, 25, 50, 100, 250, 500]


@query(
    "w6_windowed_p95",
    """WITH b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, CASE WHEN value <= 5 THEN 5 WHEN value <= 10 THEN 10 WHEN value <= 25 THEN 25 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 WHEN value <= 250 THEN 250 ELSE 500 END AS le FROM events),
      c AS (SELECT start, le, count(*) AS n FROM b GROUP BY 1, 2),
      r AS (SELECT *, sum(n) OVER (PARTITION BY start ORDER BY le) AS cum, sum(n) OVER (PARTITION BY start) AS total, sum(n) OVER (PARTITION BY start ORDER BY le) - n AS below FROM c),
      f AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY le) AS rn FROM r WHERE cum >= 0.95::DOUBLE * total),
      lo AS (SELECT *, CASE le WHEN 5 THEN 0 WHEN 10 THEN 5 WHEN 25 THEN 10 WHEN 50 THEN 25 WHEN 100 THEN 50 WHEN 250 THEN 100 ELSE 250 END AS lower FROM f WHERE rn = 1)
      SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, round(lower + (le - lower) * (0.95::DOUBLE * total - below) / n, 6) AS p95 FROM lo""",
)
def _(t):
    r = W.windowed_quantile(t.events, "ts", "value", _EDGES, 0.95, "6 hours", "6 hours", 150.0)
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), r6("quantile", "p95"))


@query(
    "w7_sustained_breach",
    """WITH r AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1),
      b AS (SELECT start, start - row_number() OVER (ORDER BY start) * INTERVAL 1 HOUR AS island FROM r WHERE errors >= 3)
      SELECT strftime(min(start), '%Y-%m-%d %H:%M:%S') AS breach_start, strftime(max(start) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS breach_end, count(*) AS windows FROM b GROUP BY island HAVING count(*) >= 3""",
)
def _(t):
    r = W.windowed_rate(t.events, "ts", F.col("event_type") == "error", "1 hour", "1 hour", 3600, 2.5 / 3600)
    s = W.sustained_breach(r, [], 3600, 3 * 3600)
    return s.select(F.date_format("breach_start", "yyyy-MM-dd HH:mm:ss").alias("breach_start"), F.date_format("breach_end", "yyyy-MM-dd HH:mm:ss").alias("breach_end"), "windows")


@query(
    "w8_requests_last_hour",
    """WITH m AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS m FROM events), w AS (SELECT m - k.i * INTERVAL 5 MINUTE AS start FROM m, (SELECT unnest(range(0, 12)) AS i) k)
      SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM w GROUP BY 1""",
)
def _(t):
    r = W.windowed_count(t.events, "ts", [], "1 hour", "5 minutes")
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query(
    "w9_daily_counts",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def _(t):
    r = W.windowed_count(t.events, "ts", ["event_type"], "1 day", "1 day")
    return r.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")
