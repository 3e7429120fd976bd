"""Model evaluation, scoring, explanation and drift on deterministic scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, explain, metrics, scoring, splits
from ..operators.training import class_weights, dummy_prior, fit_medians_table, standardise
from .bindings import source, with_sources
from .profiling import _MESSY_SQL, _messy
from .registry import query, table, tidy

# Scores with many ties, better than chance, for every order; two models, five folds.
_SCORED = """
SELECT o_orderkey AS id, o_custkey AS client_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
  CAST(o_orderkey % 5 AS INT) AS fold,
  round(1 / (1 + exp(-((o_orderkey * 7919 % 997) / 250e0 - 25e-1
    + CASE WHEN o_orderstatus = 'F' THEN 6e-1 ELSE 0e0 END))), 4) AS score,
  round(1 / (1 + exp(-((o_orderkey * 104729 % 991) / 400e0 - 2e0
    + CASE WHEN o_orderstatus = 'F' THEN 9e-1 ELSE 0e0 END))), 4) AS score_b
FROM {orders}
"""
_WITH = "WITH scored AS (" + _SCORED.format(orders="orders") + ")"


def scored(spark, sf):
    return spark.sql(_SCORED, orders=table(spark, sf, "orders"))


_MODELS = (
    _WITH
    + """, models AS (SELECT 'a' AS model, id, label, fold, score FROM scored
  UNION ALL SELECT 'b', id, label, fold, score_b FROM scored)
"""
)


def models(spark, sf):
    s = scored(spark, sf)
    a = s.select(F.lit("a").alias("model"), "id", "label", "fold", "score")
    return a.unionByName(s.select(F.lit("b").alias("model"), "id", "label", "fold", F.col("score_b").alias("score")))


# ---- metrics ----------------------------------------------------------------------------

_CONFUSION = """SELECT count(CASE WHEN label = 0 AND NOT p THEN 1 END) AS tn, count(CASE WHEN label = 0 AND p THEN 1 END) AS fp,
  count(CASE WHEN label = 1 AND NOT p THEN 1 END) AS fn, count(CASE WHEN label = 1 AND p THEN 1 END) AS tp
FROM (SELECT label, score >= 0.46::DOUBLE AS p FROM scored)"""


@query("confusion", _WITH + _CONFUSION)
def confusion(spark, sf):
    return metrics.confusion(scored(spark, sf), "label", "score", 0.46)


@query("business_cost", _WITH + f"SELECT 10 * fn + fp AS cost, fn, fp FROM ({_CONFUSION}) c")
def business_cost(spark, sf):
    return metrics.business_cost(scored(spark, sf), "label", "score", 0.46)


@query(
    "precision_recall_f1",
    _WITH
    + f"""SELECT round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM ({_CONFUSION}) c""",
)
def precision_recall_f1(spark, sf):
    return tidy(metrics.precision_recall_f1(metrics.confusion(scored(spark, sf), "label", "score", 0.46)), digits=6)


_SWEEP = """, grid AS (SELECT CAST(0.01 AS DOUBLE) + i.range * CAST(0.01 AS DOUBLE) AS threshold FROM range(98) i),
sweep AS (SELECT threshold, count(CASE WHEN label = 1 AND score < threshold THEN 1 END) AS fn,
  count(CASE WHEN label = 0 AND score >= threshold THEN 1 END) AS fp FROM grid, scored GROUP BY threshold)
"""


@query("threshold_sweep", _WITH + _SWEEP + "SELECT round(threshold, 6) AS threshold, fn, fp, 10 * fn + fp AS cost FROM sweep")
def threshold_sweep(spark, sf):
    return tidy(metrics.threshold_sweep(scored(spark, sf), "label", "score"), digits=6)


@query(
    "best_threshold",
    _WITH + _SWEEP + "SELECT round(threshold, 2) AS threshold, 10 * fn + fp AS cost FROM sweep ORDER BY cost, threshold LIMIT 1",
)
def best_threshold(spark, sf):
    return metrics.best_threshold(metrics.threshold_sweep(scored(spark, sf), "label", "score"))


_RANKED = """, cells AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY score),
ranked AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM cells)
"""


@query("roc_points", _WITH + _RANKED + "SELECT score, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr FROM ranked")
def roc_points(spark, sf):
    return tidy(metrics.roc_points(metrics.ranked_cells(scored(spark, sf), "label", "score")), ["score"], 6)


def _auc_sql(relation: str, by: str) -> str:
    """Rank formula: mean rank of the positives, ties sharing their mean rank."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}(sum(CASE WHEN label = 1 THEN mid END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
    / nullif(CAST(sum(label) AS DOUBLE) * (count(*) - sum(label)), 0) AS auc
FROM (SELECT {keys}label, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}score) - 1) / 2.0::DOUBLE AS mid
  FROM {relation}) {group}"""


@query("roc_auc", _WITH + f"SELECT round(auc, 6) AS auc FROM ({_auc_sql('scored', '')}) q")
def roc_auc(spark, sf):
    return tidy(metrics.roc_auc(metrics.ranked_cells(scored(spark, sf), "label", "score")), digits=6)


@query(
    "average_precision",
    _WITH + _RANKED + "SELECT round(sum((pos / n_pos) * (tp / (tp + fp))), 6) AS average_precision FROM ranked",
)
def average_precision(spark, sf):
    return tidy(metrics.average_precision(metrics.ranked_cells(scored(spark, sf), "label", "score")), digits=6)


_FOLD_AUC = f", fold_auc AS ({_auc_sql('models', 'model, fold')})"


def _fold_aucs(spark, sf):
    by = ["model", "fold"]
    return metrics.roc_auc(metrics.ranked_cells(models(spark, sf), "label", "score", by), by)


@query(
    "fold_auc_stats",
    _MODELS + _FOLD_AUC + "SELECT model, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std FROM fold_auc GROUP BY model",
)
def fold_auc_stats(spark, sf):
    return tidy(metrics.fold_auc_stats(_fold_aucs(spark, sf), ["model"]), digits=6)


@query(
    "metrics_table",
    _MODELS
    + _FOLD_AUC
    + """, grid AS (SELECT CAST(0.01 AS DOUBLE) + i.range * CAST(0.01 AS DOUBLE) AS threshold FROM range(98) i),
sweep AS (SELECT model, threshold, 10 * count(CASE WHEN label = 1 AND score < threshold THEN 1 END)
  + count(CASE WHEN label = 0 AND score >= threshold THEN 1 END) AS cost FROM grid, models GROUP BY model, threshold),
best AS (SELECT model, round(arg_min(threshold, cost * 1000 + round(threshold * 100)), 2) AS threshold FROM sweep GROUP BY model),
counts AS (SELECT b.model, b.threshold, count(CASE WHEN label = 1 AND score >= b.threshold THEN 1 END) AS tp,
  count(CASE WHEN label = 1 AND score < b.threshold THEN 1 END) AS fn,
  count(CASE WHEN label = 0 AND score >= b.threshold THEN 1 END) AS fp FROM models m JOIN best b ON m.model = b.model GROUP BY 1, 2),
cells AS (SELECT model, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM models GROUP BY 1, 2),
ranked AS (SELECT model, pos, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp,
  sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY model) AS n_pos FROM cells),
ap AS (SELECT model, sum((pos / n_pos) * (tp / (tp + fp))) AS average_precision FROM ranked GROUP BY model),
f AS (SELECT model, avg(auc) AS auc_mean, stddev_pop(auc) AS auc_std FROM fold_auc GROUP BY model),
t AS (SELECT model, round(auc_mean, 4) AS auc_mean, round(auc_std, 4) AS auc_std, round(average_precision, 4) AS average_precision,
  round(tp / (tp + fn), 4) AS recall, round(tp / (tp + fp), 4) AS precision, round(2 * tp / (2 * tp + fp + fn), 4) AS f1,
  threshold, 10 * fn + fp AS cost, fn, fp FROM f JOIN ap USING (model) JOIN counts USING (model))
SELECT *, auc_mean = max(auc_mean) OVER () AS auc_mean_best, average_precision = max(average_precision) OVER () AS average_precision_best,
  recall = max(recall) OVER () AS recall_best, f1 = max(f1) OVER () AS f1_best, cost = min(cost) OVER () AS cost_best,
  fn = min(fn) OVER () AS fn_best, fp = min(fp) OVER () AS fp_best FROM t""",
)
def metrics_table(spark, sf):
    return metrics.metrics_table(models(spark, sf), "label", "score", "model", "fold")


@query(
    "oof_test_gap",
    _MODELS
    + _FOLD_AUC
    + f""", whole AS ({_auc_sql("models", "model")}), f AS (SELECT model, avg(auc) AS auc_mean FROM fold_auc GROUP BY model)
SELECT model, round(auc_mean, 4) AS auc_mean, round(auc, 4) AS auc_test, round(round(auc_mean, 4) - auc, 4) AS gap
FROM f JOIN whole USING (model)""",
)
def oof_test_gap(spark, sf):
    oof = metrics.fold_auc_stats(_fold_aucs(spark, sf), ["model"])
    whole = metrics.roc_auc(metrics.ranked_cells(models(spark, sf), "label", "score", ["model"]), ["model"])
    return metrics.oof_test_gap(oof, whole, ["model"])


# ---- preparation for training -----------------------------------------------------------


@query(
    "class_weights",
    with_sources("application")
    + """, c AS (SELECT TARGET, count(*) AS n FROM application GROUP BY 1)
SELECT SK_ID_CURR, a.TARGET, round((SELECT sum(n) FROM c) / (2.0::DOUBLE * c.n), 6) AS weight FROM application a JOIN c ON a.TARGET = c.TARGET""",
)
def class_weights_query(spark, sf):
    app = source(spark, sf, "application").select("SK_ID_CURR", "TARGET")
    return tidy(class_weights(app, "TARGET"), digits=6)


_MEDIAN_COLUMNS = ["l_quantity", "tax", "rare"]


@query(
    "impute_median",
    _MESSY_SQL
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(median(CAST({c} AS DOUBLE)), 6) AS median FROM messy" for c in _MEDIAN_COLUMNS
    ),
)
def impute_median(spark, sf):
    return tidy(fit_medians_table(_messy(spark, sf), _MEDIAN_COLUMNS), digits=6)


@query(
    "standardise",
    """WITH m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_extendedprice - mp) / sp, 6) AS l_extendedprice FROM lineitem, m""",
)
def standardise_query(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return tidy(standardise(li, ["l_quantity", "l_extendedprice"]), digits=6)


@query(
    "dummy_prior",
    with_sources("application")
    + " SELECT SK_ID_CURR, round((SELECT avg(TARGET) FROM application), 6) AS score FROM application",
)
def dummy_prior_query(spark, sf):
    app = source(spark, sf, "application").select("SK_ID_CURR", "TARGET")
    return tidy(dummy_prior(app, app, "TARGET").select("SK_ID_CURR", "score"), digits=6)


# ---- lookup, scoring, decision ----------------------------------------------------------

# Every part supplied is asked for as a client id: some exist among the customers, some do not.
_IDS = "WITH ids AS (SELECT DISTINCT l_partkey AS c_custkey FROM lineitem) "


def _ids(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("c_custkey")).distinct()


@query("lookup_batch", _IDS + "SELECT * FROM customer WHERE c_custkey IN (SELECT c_custkey FROM ids)")
def lookup_batch(spark, sf):
    return scoring.lookup_batch(_ids(spark, sf), table(spark, sf, "customer"), "c_custkey")


@query("lookup_not_found", _IDS + "SELECT c_custkey FROM ids WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def lookup_not_found(spark, sf):
    return scoring.lookup_not_found(_ids(spark, sf), table(spark, sf, "customer"), "c_custkey")


@query("lookup_found", _IDS + "SELECT c_custkey FROM ids WHERE c_custkey IN (SELECT c_custkey FROM customer)")
def lookup_found(spark, sf):
    return scoring.lookup_found(_ids(spark, sf), table(spark, sf, "customer"), "c_custkey")


@query(
    "decide",
    _WITH + "SELECT id, score, CASE WHEN score >= 0.46::DOUBLE THEN 'refusé' ELSE 'accordé' END AS decision FROM scored",
)
def decide(spark, sf):
    return scored(spark, sf).select("id", "score", scoring.decide("score").alias("decision"))


# A fixed linear model over the application columns.
WEIGHTS = {
    "EXT_SOURCE_1": -1.5,
    "EXT_SOURCE_2": -2.0,
    "EXT_SOURCE_3": -1.0,
    "CNT_FAM_MEMBERS": 0.1,
    "AMT_ANNUITY": 0.001,
    "AMT_INCOME_TOTAL": -0.0001,
}
MEANS = {
    "EXT_SOURCE_1": 0.5,
    "EXT_SOURCE_2": 0.5,
    "EXT_SOURCE_3": 0.5,
    "CNT_FAM_MEMBERS": 2.0,
    "AMT_ANNUITY": 450.0,
    "AMT_INCOME_TOTAL": 4500.0,
}
INTERCEPT = 1.25

_LINEAR = (
    with_sources("application")
    + ", raw AS (SELECT SK_ID_CURR, TARGET, 1.25::DOUBLE + "
    + " + ".join(f"coalesce(({w})::DOUBLE * {c}, 0)" for c, w in WEIGHTS.items())
    + " AS x FROM application), p AS (SELECT SK_ID_CURR, TARGET, 1 / (1 + exp(-x)) AS p FROM raw) "
)


@query(
    "linear_score",
    _LINEAR
    + """SELECT SK_ID_CURR, round(p, 4) AS score, CASE WHEN p >= 0.46::DOUBLE THEN 'refusé' ELSE 'accordé' END AS decision,
  0.46::DOUBLE AS threshold FROM p""",
)
def linear_score(spark, sf):
    return scoring.answer(source(spark, sf, "application"), scoring.linear_score(WEIGHTS, INTERCEPT), ["SK_ID_CURR"])


@query(
    "group_stats_report",
    _LINEAR
    + """, s AS (SELECT round(p, 4) AS score, p >= 0.46::DOUBLE AS refused FROM p),
n AS (SELECT count(*) AS missing FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT c_custkey FROM customer))
SELECT count(*) AS total_clients_scored, count(CASE WHEN refused THEN 1 END) AS total_refused,
  count(CASE WHEN NOT refused THEN 1 END) AS total_approved, max(missing) AS total_not_found, round(avg(score), 4) AS avg_score,
  round(count(CASE WHEN refused THEN 1 END) / count(*), 4) AS refusal_rate FROM s, n""",
)
def group_stats_report(spark, sf):
    predictions = linear_score(spark, sf)
    absent = scoring.lookup_not_found(_ids(spark, sf), table(spark, sf, "customer"), "c_custkey")
    return scoring.group_stats_report(predictions, absent)


@query(
    "pick_extreme_case",
    _WITH
    + """, g AS (SELECT id, score FROM scored WHERE label = 0 AND score < (CASE WHEN (SELECT count(*) FROM scored WHERE label = 0 AND score < 0.2::DOUBLE) > 0
    THEN 0.2 ELSE 0.4 END)::DOUBLE ORDER BY score, id LIMIT 1),
b AS (SELECT id, score FROM scored WHERE label = 1 AND score > (CASE WHEN (SELECT count(*) FROM scored WHERE label = 1 AND score > 0.53::DOUBLE) > 0
    THEN 0.53 ELSE 0.3 END)::DOUBLE ORDER BY score DESC, id LIMIT 1)
SELECT 0 AS label, id, score FROM g UNION ALL SELECT 1, id, score FROM b""",
)
def pick_extreme_case(spark, sf):
    return scoring.pick_extreme_case(scored(spark, sf), "id", "label", "score")


# ---- explanation ------------------------------------------------------------------------

_PHI = (
    with_sources("application")
    + ", phi AS ("
    + " UNION ALL ".join(
        f"SELECT SK_ID_CURR, '{c}' AS feature, coalesce(({w})::DOUBLE * ({c} - ({MEANS[c]})::DOUBLE), 0) AS contribution FROM application"
        for c, w in WEIGHTS.items()
    )
    + ")"
)
_TOP = _PHI + """, top AS (SELECT *, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY abs(contribution) DESC, feature) AS rank FROM phi)
"""


def phi(spark, sf):
    return explain.explain_linear(source(spark, sf, "application"), ["SK_ID_CURR"], WEIGHTS, MEANS)


@query("explain_linear", _PHI + "SELECT SK_ID_CURR, feature, round(contribution, 6) + 0.0 AS contribution FROM phi")
def explain_linear(spark, sf):
    return tidy(phi(spark, sf), digits=6)


@query("topk_abs", _TOP + "SELECT SK_ID_CURR, feature, round(contribution, 6) AS contribution, rank FROM top WHERE rank <= 3")
def topk_abs(spark, sf):
    return tidy(explain.topk_abs(phi(spark, sf), ["SK_ID_CURR"], 3), digits=6)


@query(
    "factor_direction",
    _TOP
    + """SELECT SK_ID_CURR, rank, feature, round(contribution, 4) AS contribution,
  CASE WHEN contribution > 0 THEN 'défavorable' ELSE 'favorable' END AS direction FROM top WHERE rank <= 5""",
)
def factor_direction(spark, sf):
    return explain.named_factors(explain.topk_abs(phi(spark, sf), ["SK_ID_CURR"], 5), ["SK_ID_CURR"])


@query("global_importance", _PHI + "SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM phi GROUP BY feature")
def global_importance(spark, sf):
    return tidy(explain.global_importance(phi(spark, sf)), digits=6)


_GROUPS = {"EXT_SOURCE_1": "EXT_SOURCE", "EXT_SOURCE_2": "EXT_SOURCE", "EXT_SOURCE_3": "EXT_SOURCE"}


@query(
    "grouped_importance",
    _PHI
    + """, r AS (SELECT SK_ID_CURR, CASE WHEN feature LIKE 'EXT_SOURCE%' THEN 'EXT_SOURCE' ELSE feature END AS variable,
  sum(abs(contribution)) AS s FROM phi GROUP BY 1, 2)
SELECT variable, round(avg(s), 6) AS importance FROM r GROUP BY variable""",
)
def grouped_importance(spark, sf):
    return tidy(explain.grouped_importance(phi(spark, sf), ["SK_ID_CURR"], _GROUPS), digits=6)


@query(
    "topk_global",
    _PHI + "SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM phi GROUP BY feature ORDER BY avg(abs(contribution)) DESC, feature LIMIT 3",
)
def topk_global(spark, sf):
    ranked = explain.topk_global(explain.global_importance(phi(spark, sf)), "importance", "feature", 3)
    return tidy(ranked, digits=6)


# ---- drift ------------------------------------------------------------------------------

# The newest fifth of the events, as the current slice, against all before it.
_DRIFT_FEATURES = ["value", "hour", "day", "k", "seldom"]
_DRIFT = """WITH n AS (SELECT *, row_number() OVER (ORDER BY event_id) AS rank, count(*) OVER () AS total FROM events),
d AS (SELECT CASE WHEN rank <= CAST(floor(total * 0.8) AS BIGINT) THEN 'reference' ELSE 'current' END AS slice, event_id, event_type,
  value, CAST(hour(ts) AS DOUBLE) AS hour, CAST(day(ts) AS DOUBLE) AS day, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
  CASE WHEN event_type = 'click' THEN value + event_id END AS seldom, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM n)
"""
_LONG = "l AS (" + " UNION ALL ".join(
    f"SELECT slice, '{c}' AS feature, {c} AS value FROM d WHERE {c} IS NOT NULL" for c in _DRIFT_FEATURES
) + """),
c AS (SELECT feature, value, count(CASE WHEN slice = 'reference' THEN 1 END) AS r, count(CASE WHEN slice = 'current' THEN 1 END) AS q FROM l GROUP BY 1, 2),
s AS (SELECT feature, value, sum(r) OVER (PARTITION BY feature) AS n_ref, sum(q) OVER (PARTITION BY feature) AS n_cur,
  sum(r) OVER (PARTITION BY feature ORDER BY value) AS cr, sum(q) OVER (PARTITION BY feature ORDER BY value) AS cq,
  lead(value) OVER (PARTITION BY feature ORDER BY value) - value AS width FROM c),
ks AS (SELECT feature, CAST(max(n_ref) AS BIGINT) AS n_ref, CAST(max(n_cur) AS BIGINT) AS n_cur, max(abs(cr / n_ref - cq / n_cur)) AS ks
  FROM s WHERE n_ref > 10 AND n_cur > 10 GROUP BY feature)
"""


def sliced_events(spark, sf):
    events = splits.split_by_key_order(table(spark, sf, "events"), "event_id")
    return events.select(
        "slice",
        "event_id",
        "event_type",
        "value",
        F.hour("ts").alias("hour"),
        F.dayofmonth("ts").alias("day"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.when(F.col("event_type") == "click", F.col("value") + F.col("event_id")).alias("seldom"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def _ks(spark, sf):
    return drift.ks_two_sample(sliced_events(spark, sf), _DRIFT_FEATURES)


@query("ks_two_sample", _DRIFT + "," + _LONG + "SELECT feature, n_ref, n_cur, round(ks, 6) AS ks FROM ks")
def ks_two_sample(spark, sf):
    return tidy(_ks(spark, sf), digits=6)


@query(
    "ks_embeddings",
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS rank, count(*) OVER () AS total FROM embeddings),
l AS (SELECT rank <= CAST(floor(total * 0.8) AS BIGINT) AS ref, 'e' || (generate_subscripts(embedding, 1) - 1) AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM n),
c AS (SELECT feature, value, count(CASE WHEN ref THEN 1 END) AS r, count(CASE WHEN NOT ref THEN 1 END) AS q FROM l GROUP BY 1, 2),
s AS (SELECT feature, sum(r) OVER (PARTITION BY feature) AS n_ref, sum(q) OVER (PARTITION BY feature) AS n_cur,
  sum(r) OVER (PARTITION BY feature ORDER BY value) AS cr, sum(q) OVER (PARTITION BY feature ORDER BY value) AS cq FROM c)
SELECT feature, CAST(max(n_ref) AS BIGINT) AS n_ref, CAST(max(n_cur) AS BIGINT) AS n_cur, round(max(abs(cr / n_ref - cq / n_cur)), 6) AS ks
FROM s WHERE n_ref > 10 AND n_cur > 10 GROUP BY feature""",
)
def ks_embeddings(spark, sf):
    e = splits.split_by_key_order(table(spark, sf, "embeddings"), "vec_id")
    wide = e.select("slice", *[F.col("embedding")[k].alias(f"e{k}") for k in range(64)])
    return tidy(drift.ks_two_sample(wide, [f"e{k}" for k in range(64)]), digits=6)


@query(
    "wasserstein",
    _DRIFT + "," + _LONG + """SELECT feature, round(sum(abs(cr / n_ref - cq / n_cur) * coalesce(width, 0)), 8) AS distance
FROM s WHERE n_ref > 10 AND n_cur > 10 GROUP BY feature""",
)
def wasserstein(spark, sf):
    # at eight digits no distance of these tables lies half-way between two
    return tidy(drift.wasserstein(sliced_events(spark, sf), _DRIFT_FEATURES), digits=8)


@query(
    "chi_square_drift",
    _DRIFT
    + """, o AS (SELECT event_type, count(CASE WHEN slice = 'reference' THEN 1 END) AS r, count(CASE WHEN slice = 'current' THEN 1 END) AS q FROM d WHERE event_type IS NOT NULL GROUP BY 1),
e AS (SELECT *, (r + q) * (sum(r) OVER ()) / CAST(sum(r + q) OVER () AS DOUBLE) AS er, (r + q) * (sum(q) OVER ()) / CAST(sum(r + q) OVER () AS DOUBLE) AS eq FROM o)
SELECT 'event_type' AS feature, round(sum((r - er) * (r - er) / er + (q - eq) * (q - eq) / eq), 4) AS chi2, count(*) - 1 AS dof FROM e""",
)
def chi_square_drift(spark, sf):
    return tidy(drift.chi_square_drift(sliced_events(spark, sf), "event_type"))


_CATEGORIES = ["event_type", "hour", "day", "k"]


@query(
    "chi_square_report",
    _DRIFT
    + ", l AS ("
    + " UNION ALL ".join(f"SELECT slice, '{c}' AS feature, CAST({c} AS VARCHAR) AS category FROM d WHERE {c} IS NOT NULL" for c in _CATEGORIES)
    + """), o AS (SELECT feature, category, count(CASE WHEN slice = 'reference' THEN 1 END) AS r, count(CASE WHEN slice = 'current' THEN 1 END) AS q FROM l GROUP BY 1, 2),
w AS (SELECT *, (r + q) * sum(r) OVER (PARTITION BY feature) / CAST(sum(r + q) OVER (PARTITION BY feature) AS DOUBLE) AS er,
  (r + q) * sum(q) OVER (PARTITION BY feature) / CAST(sum(r + q) OVER (PARTITION BY feature) AS DOUBLE) AS eq FROM o),
t AS (SELECT feature, sum((r - er) * (r - er) / er + (q - eq) * (q - eq) / eq) AS chi2, count(*) - 1 AS dof FROM w GROUP BY 1),
-- the tail of an even number of degrees is a finite sum, of an odd one the same with the error function
g AS (SELECT *, CASE WHEN dof % 2 = 0 THEN list_sum(list_transform(range(0, dof // 2), lambda k: exp(-chi2 / 2 + k * ln(chi2 / 2) - lgamma(k + 1))))
  ELSE erfc + coalesce(list_sum(list_transform(range(0, dof // 2), lambda k: exp(-chi2 / 2 + (k + 0.5) * ln(chi2 / 2) - lgamma(k + 1.5)))), 0) END AS p
  FROM (SELECT *, CASE WHEN dof % 2 = 1 THEN 2 / sqrt(pi()) * list_sum(list_transform(range(0, 20000),
    lambda i: exp(-pow(sqrt(chi2 / 2) + (i + 0.5) / 2000, 2)) / 2000)) END AS erfc FROM t))
SELECT feature, round(chi2, 4) AS chi2, dof, round(p, 5) AS p_value, CASE WHEN p < 0.05 THEN 1 ELSE 0 END AS drifted FROM g""",
)
def chi_square_report(spark, sf):
    report = drift.chi_square_report(sliced_events(spark, sf), _CATEGORIES)
    return tidy(report, digits=lambda c: 5 if c == "p_value" else 4)


@query(
    "drift_flag",
    _DRIFT
    + ","
    + _LONG
    + """SELECT feature, round(ks, 6) AS ks, CASE WHEN ks >= 0.1 THEN 1 ELSE 0 END AS drifted,
  CASE WHEN ks >= 0.2 THEN 'strong' WHEN ks >= 0.1 THEN 'moderate' ELSE 'none' END AS band FROM ks""",
)
def drift_flag(spark, sf):
    return tidy(drift.drift_report(_ks(spark, sf)).select("feature", "ks", "drifted", "band"), digits=6)


@query(
    "drift_summary",
    _DRIFT
    + ","
    + _LONG
    + """, t AS (SELECT CAST(sum(CASE WHEN ks >= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n_drifted, count(*) AS n_features FROM ks)
SELECT *, round(n_drifted / n_features, 6) AS share, CASE WHEN n_drifted / n_features < 0.2 THEN 'stable'
  WHEN n_drifted / n_features > 0.3 THEN 'retrain' ELSE 'watch' END AS verdict FROM t""",
)
def drift_summary(spark, sf):
    return tidy(drift.drift_summary(drift.drift_report(_ks(spark, sf))), digits=6)


@query(
    "label_drift",
    _DRIFT
    + """SELECT round(avg(CASE WHEN slice = 'reference' THEN label END), 6) AS rate_reference,
  round(avg(CASE WHEN slice = 'current' THEN label END), 6) AS rate_current,
  round(avg(CASE WHEN slice = 'current' THEN label END) - avg(CASE WHEN slice = 'reference' THEN label END), 6) AS rate_change FROM d""",
)
def label_drift(spark, sf):
    return tidy(drift.label_drift(sliced_events(spark, sf), "label"), digits=6)


@query(
    "auc_by_slice",
    _WITH
    + """, n AS (SELECT *, row_number() OVER (ORDER BY id) AS rank, count(*) OVER () AS total FROM scored),
sl AS (SELECT CASE WHEN rank <= CAST(floor(total * 0.8) AS BIGINT) THEN 'reference' ELSE 'current' END AS slice, label, score FROM n),
a AS ("""
    + _auc_sql("sl", "slice")
    + """)
SELECT round(max(CASE WHEN slice = 'reference' THEN auc END), 6) AS auc_reference, round(max(CASE WHEN slice = 'current' THEN auc END), 6) AS auc_current,
  round(max(CASE WHEN slice = 'reference' THEN auc END) - max(CASE WHEN slice = 'current' THEN auc END), 6) AS auc_loss FROM a""",
)
def auc_by_slice(spark, sf):
    return tidy(metrics.auc_by_slice(splits.split_by_key_order(scored(spark, sf), "id"), "label", "score"), digits=6)
