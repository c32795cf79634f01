"""Scored sets: threshold metrics, curves, money, learning curve, readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.profile_checks import _corr_sql
from checks.tables import (
    SCORED_EVENTS, SCORED_TIES, div, r, rounded, scored_events, scored_ties, table, union,
)
from tabassay.operators import business as biz
from tabassay.operators import curves, metrics
from tabassay.operators import readiness as ready
from tabassay.plans.evaluation import evaluate_model

FEATURES = ["value", "user_id", "noise"]


# A ninth of the scores is no number; such rows are left out.
NAN_ROWS = f"SELECT * FROM ({SCORED_EVENTS}) WHERE event_id % 9 <> 0"


def _scored_nan(spark, d):
    score = F.when(F.col("event_id") % 9 == 0, float("nan")).otherwise(F.col("p"))
    return scored_events(spark, d).withColumn("p", score)


def _with(sql: str, source: str = SCORED_EVENTS, extra: str = "") -> str:
    return f"WITH s AS ({source}){extra} {sql}"


HIST = """, h AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos,
  count(*) FILTER (WHERE y <> 1) AS neg FROM s GROUP BY p),
c AS (SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
  sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM h
  WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""

AREAS = f"""SELECT {div("sum(CAST(neg AS DOUBLE) * (tp - pos / 2.0))",
                       "max(np) * CAST(max(nn) AS DOUBLE)")} AS auc_roc,
  {div("sum(CAST(pos AS DOUBLE) * tp / (tp + fp))", "max(np)")} AS average_precision FROM c"""

CONFUSION = """SELECT {by} count(*) FILTER (WHERE y <> 1 AND p < {t}) AS tn,
  count(*) FILTER (WHERE y <> 1 AND p >= {t}) AS fp,
  count(*) FILTER (WHERE y = 1 AND p < {t}) AS fn,
  count(*) FILTER (WHERE y = 1 AND p >= {t}) AS tp, count(*) AS total FROM {source} {group}"""


def _confusion(t: float = 0.5, source: str = "s", by: str = "") -> str:
    return CONFUSION.format(
        t=t, source=source, by=f"{by}," if by else "", group=f"GROUP BY {by}" if by else ""
    )


METRICS = {
    "accuracy": div("tp + tn", "total"),
    "precision": f"coalesce({div('tp', 'tp + fp')}, 0)",
    "recall": f"coalesce({div('tp', 'tp + fn')}, 0)",
    "f1_score": f"coalesce({div('2 * tp', '2 * tp + fp + fn')}, 0)",
    "false_positive_rate": f"coalesce({div('fp', 'fp + tn')}, 0)",
    "false_negative_rate": f"coalesce({div('fn', 'fn + tp')}, 0)",
    "true_positive_rate": f"coalesce({div('tp', 'fn + tp')}, 0)",
    "true_negative_rate": f"coalesce({div('tn', 'fp + tn')}, 0)",
    "imbalance_ratio": div("greatest(tn + fp, fn + tp)", "least(tn + fp, fn + tp)"),
}
_NAMED = ", ".join(f"{e} AS {n}" for n, e in METRICS.items())
_BALANCE = """CASE WHEN imbalance_ratio <= 1.5 THEN 'balanced'
  WHEN imbalance_ratio <= 3 THEN 'slightly_imbalanced' ELSE 'imbalanced' END
  AS class_distribution"""

EVALUATION = f"""SELECT *, tn + fp AS class_0_count, fn + tp AS class_1_count, {_BALANCE}
  FROM (SELECT *, {_NAMED} FROM conf)"""

IMPACT = f"""SELECT CAST(500 AS DOUBLE) AS cost_per_false_positive,
  CAST(2000 AS DOUBLE) AS cost_per_false_negative,
  fp * 500 * s AS total_false_positive_cost, fn * 2000 * s AS total_false_negative_cost,
  fp * 500 * s + fn * 2000 * s AS total_cost,
  CAST(1000 AS DOUBLE) AS revenue_per_true_positive, tp * 1000 * s AS total_revenue_from_tp,
  tp * 1000 * s - (fp * 500 * s + fn * 2000 * s) AS net_profit,
  {div("tp + fp", "total")} AS approval_rate,
  100 * {div("tp * 1000 * s - (fp * 500 * s + fn * 2000 * s)", "fp * 500 * s + fn * 2000 * s")}
    AS roi_improvement_percent
  FROM (SELECT *, {div("10000", "total")} AS s FROM conf)"""
IMPACT_COLUMNS = [
    "cost_per_false_positive", "cost_per_false_negative", "total_false_positive_cost",
    "total_false_negative_cost", "total_cost", "revenue_per_true_positive",
    "total_revenue_from_tp", "net_profit", "approval_rate", "roi_improvement_percent",
]

SWEEP = """SELECT t AS threshold, count(*) FILTER (WHERE y = 1 AND p >= t) AS tp,
  count(*) FILTER (WHERE y <> 1 AND p >= t) AS fp,
  count(*) FILTER (WHERE y = 1 AND p < t) AS fn,
  CAST(count(*) FILTER (WHERE y = 1 AND p >= t) * 1000
    - count(*) FILTER (WHERE y <> 1 AND p >= t) * 500
    - count(*) FILTER (WHERE y = 1 AND p < t) * 2000 AS DOUBLE) AS profit
  FROM {source}, (SELECT i / CAST(20 AS DOUBLE) AS t FROM range(1, 20) x(i)) GROUP BY t"""

BEST = """SELECT CAST(0.5 AS DOUBLE) AS current_threshold, optimal_threshold, current_profit,
  optimal_profit, optimal_profit - current_profit AS improvement,
  CASE WHEN optimal_threshold = 0.5 THEN 'Keep threshold at 0.50'
    ELSE 'Adjust threshold from 0.50 to ' || printf('%.2f', optimal_threshold) || ' for $' ||
    format('{:,}', CAST(optimal_profit - current_profit AS BIGINT)) || ' profit improvement'
    END AS recommendation
  FROM (SELECT (SELECT threshold FROM sweep ORDER BY profit DESC, threshold LIMIT 1)
      AS optimal_threshold,
    (SELECT max(profit) FROM sweep) AS optimal_profit,
    (SELECT profit FROM sweep WHERE threshold = 0.5) AS current_profit)"""

_CLIP = "least(1 - 1e-15, greatest(1e-15, p))"
_LOSS = f"-(y * ln({_CLIP}) + (1 - y) * ln(1 - {_CLIP}))"
_RIGHT = "CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END"
CURVE = f"""SELECT *, CASE WHEN gap <= 0.02 THEN 'none' WHEN gap <= 0.05 THEN 'mild'
    WHEN gap <= 0.10 THEN 'moderate' ELSE 'severe' END AS overfitting_status
  FROM (SELECT *, coalesce(train_accuracy - test_accuracy, 0) AS gap FROM (SELECT
  avg({_LOSS}) FILTER (WHERE split = 'test') AS test_loss,
  avg({_RIGHT}) FILTER (WHERE split = 'test') AS test_accuracy,
  avg({_LOSS}) FILTER (WHERE split = 'train') AS train_loss,
  avg({_RIGHT}) FILTER (WHERE split = 'train') AS train_accuracy FROM {{source}}))"""


def _importance(source: str) -> str:
    parts = union(
        [
            f"SELECT '{f}' AS name, coalesce({_corr_sql(source, f, 'y')}, 0) AS c FROM {source}"
            for f in FEATURES
        ]
    )
    return f"""SELECT CAST(row_number() OVER (ORDER BY abs(c) DESC, name) AS INTEGER) AS rank,
      name, abs(c) AS importance_score, 100 * abs(c) / sum(abs(c)) OVER () AS importance_percent,
      c AS correlation_with_target, CASE WHEN abs(c) >= 0.7 THEN 'strong'
        WHEN abs(c) >= 0.4 THEN 'moderate' ELSE 'weak' END AS correlation_strength
      FROM ({parts})"""


TOP = """SELECT sum(importance_percent) FILTER (WHERE rank <= 3) AS top_3_importance_percent,
  count(*) AS total_features,
  count(*) FILTER (WHERE correlation_strength = 'strong') AS strong_correlations FROM imp"""

_RULES = ", ".join(
    f"('{c}', '{n}', '{m}', '{d}', {limit}::DOUBLE)" for c, n, m, d, limit in ready.RULES
)
CRITERIA = f"""SELECT category, name, metric,
  CASE WHEN value IS NULL THEN 'pending'
    WHEN (direction = '>=' AND value >= lim) OR (direction = '<=' AND value <= lim)
      OR (direction = '>' AND value > lim) THEN 'pass' ELSE 'fail' END AS status,
  metric || ': ' || coalesce(printf('%.3f', value), 'not available') || ' (target: ' ||
    direction || ' ' || printf('%.2f', lim) || ')' AS details
  FROM (VALUES {_RULES}) r(category, name, metric, direction, lim) LEFT JOIN judged USING (metric)"""
SUMMARY = """SELECT total_criteria, passed, failed, pending, pass_rate,
  CASE WHEN passed = total_criteria THEN 'ready' WHEN 100.0 * passed / total_criteria < 60
    THEN 'not_ready' ELSE 'pending' END AS overall_status,
  CASE WHEN failed = 0 THEN 'Ready for deployment' ELSE 'Fix ' || failed ||
    ' failing criteria before deployment' END AS deployment_recommendation,
  CASE WHEN failed = 0 THEN 'Immediate' WHEN failed <= 3 THEN '1-2 days' ELSE '1-2 weeks' END
    AS estimated_time_to_production
  FROM (SELECT count(*) AS total_criteria, count(*) FILTER (WHERE status = 'pass') AS passed,
    count(*) FILTER (WHERE status = 'fail') AS failed,
    count(*) FILTER (WHERE status = 'pending') AS pending,
    round(CAST(100.0 * count(*) FILTER (WHERE status = 'pass') AS DOUBLE) / count(*), 1)
      AS pass_rate FROM crit)"""


def _complete_ctes() -> str:
    all_rows = SCORED_EVENTS
    judged = union(
        [
            f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {src}"
            for src, ms in {
                "ev": ["accuracy", "precision", "recall", "f1_score", "false_positive_rate",
                       "false_negative_rate", "true_negative_rate", "total", "imbalance_ratio"],
                "areas": ["auc_roc"],
                "impact": ["net_profit", "roi_improvement_percent", "approval_rate"],
                "curve": ["gap", "test_loss"],
                "top": ["top_3_importance_percent", "strong_correlations"],
            }.items()
            for m in ms
        ]
        + [
            """SELECT 'overfitting_severity', CASE overfitting_status WHEN 'none' THEN 0.0
            WHEN 'mild' THEN 1.0 WHEN 'moderate' THEN 2.0 ELSE 3.0 END FROM curve"""
        ]
    )
    return f"""WITH everything AS ({all_rows}),
    s AS (SELECT * FROM everything WHERE split = 'test'){HIST},
    areas AS ({AREAS}), conf AS ({_confusion()}), ev AS ({EVALUATION}), impact AS ({IMPACT}),
    sweep AS ({SWEEP.format(source="s")}), best AS ({BEST}),
    curve AS ({CURVE.format(source="everything")}), imp AS ({_importance("s")}), top AS ({TOP}),
    judged AS ({judged}), crit AS ({CRITERIA}), summ AS ({SUMMARY})"""


def _complete_long() -> str:
    def rows(section, item, source, numbers, texts=()):
        return [
            f"SELECT '{section}' AS section, {item} AS item, '{m}' AS metric, "
            f"{r(f'CAST({m} AS DOUBLE)')} AS value, CAST(NULL AS VARCHAR) AS text FROM {source}"
            for m in numbers
        ] + [
            f"SELECT '{section}', {item}, '{m}', CAST(NULL AS DOUBLE), {m} FROM {source}"
            for m in texts
        ]

    parts = []
    parts += rows(
        "evaluation", "''", "ev, areas, (SELECT 0.5 AS threshold)",
        ["threshold", "tn", "fp", "fn", "tp", "total", "accuracy", "precision", "recall",
         "f1_score", "auc_roc", "false_positive_rate", "false_negative_rate",
         "true_positive_rate", "true_negative_rate", "class_0_count", "class_1_count",
         "imbalance_ratio"], ["class_distribution"],
    )
    parts += rows("business_impact", "''", "impact", IMPACT_COLUMNS)
    parts += rows("areas", "''", "areas", ["auc_roc", "average_precision"])
    parts += rows(
        "learning_curve", "''", "curve",
        ["test_loss", "test_accuracy", "train_loss", "train_accuracy", "gap"],
        ["overfitting_status"],
    )
    parts += rows(
        "feature_importance", "name", "imp",
        ["rank", "importance_score", "importance_percent", "correlation_with_target"],
        ["correlation_strength"],
    )
    parts += rows(
        "importance_summary", "''", "top",
        ["top_3_importance_percent", "total_features", "strong_correlations"],
    )
    parts += rows(
        "optimal_threshold", "''", "best",
        ["current_threshold", "optimal_threshold", "current_profit", "optimal_profit",
         "improvement"], ["recommendation"],
    )
    parts += [
        f"SELECT 'criteria', metric, '{m}', CAST(NULL AS DOUBLE), {m} FROM crit"
        for m in ("category", "name", "status", "details")
    ]
    parts += rows(
        "production_readiness", "''", "summ",
        ["total_criteria", "passed", "failed", "pending", "pass_rate"],
        ["overall_status", "deployment_recommendation", "estimated_time_to_production"],
    )
    return union(parts)


def _predicted(spark, d):
    return scored_events(spark, d).select(
        F.col("event_type").alias("label"),
        F.when(F.col("p") > 0.4, F.col("event_type"))
        .when(F.col("noise") < 30, F.lit("view"))
        .otherwise(F.lit("click"))
        .alias("prediction"),
    )


PREDICTED = f"""SELECT event_type AS label, CASE WHEN p > 0.4 THEN event_type
  WHEN noise < 30 THEN 'view' ELSE 'click' END AS prediction FROM ({SCORED_EVENTS})"""

PER_CLASS = f"""SELECT k.class, coalesce({div("hits", "called")}, 0) AS precision,
  coalesce({div("hits", "support")}, 0) AS recall,
  coalesce({div("2 * hits", "called + support")}, 0) AS f1_score, support
  FROM (SELECT class, count(*) FILTER (WHERE label = class) AS support,
    count(*) FILTER (WHERE prediction = class) AS called,
    count(*) FILTER (WHERE label = class AND prediction = class) AS hits
    FROM pr, (SELECT label AS class FROM pr UNION SELECT prediction FROM pr) GROUP BY class) k"""


def _estimates(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("label"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_quantity")).alias(
            "prediction"
        ),
    )


ESTIMATES = """SELECT l_extendedprice AS label,
  l_extendedprice * (1 - l_discount) + l_quantity AS prediction FROM lineitem"""


def _round_list(names, digits=4):
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


_AREAS_BY = f"""SELECT model_id, {div("sum(CAST(neg AS DOUBLE) * (tp - pos / 2.0))",
    "max(np) * CAST(max(nn) AS DOUBLE)")} AS auc_roc FROM (SELECT *,
    sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY model_id) AS np,
    sum(neg) OVER (PARTITION BY model_id) AS nn FROM (SELECT model_id, p,
      count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
      FROM s GROUP BY model_id, p)
    WINDOW w AS (PARTITION BY model_id ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
    GROUP BY model_id"""

CHECKS = {
    "threshold_eval": (
        lambda s, d: rounded(metrics.threshold_evaluation(scored_events(s, d), 0.3)),
        _with(
            f"""SELECT CAST(0.3 AS DOUBLE) AS threshold, tn, fp, fn, tp, total,
            {_round_list(METRICS)}, class_0_count, class_1_count, class_distribution,
            {r("auc_roc")} AS auc_roc FROM ev, areas""",
            extra=f"{HIST}, areas AS ({AREAS}), conf AS ({_confusion(0.3)}), ev AS ({EVALUATION})",
        ),
    ),
    "threshold_eval_by_model": (
        lambda s, d: rounded(metrics.threshold_evaluation(scored_ties(s, d), 0.5, ["model_id"])),
        _with(
            f"""SELECT model_id, CAST(0.5 AS DOUBLE) AS threshold, tn, fp, fn, tp, total,
            {_round_list(METRICS)}, class_0_count, class_1_count, class_distribution,
            {r("auc_roc")} AS auc_roc FROM ev JOIN areas USING (model_id)""",
            SCORED_TIES,
            f", areas AS ({_AREAS_BY}), conf AS ({_confusion(0.5, by='model_id')}), "
            f"ev AS ({EVALUATION})",
        ),
    ),
    "class_imbalance": (
        lambda s, d: rounded(
            metrics.confusion(scored_ties(s, d)).select(
                *[c.alias(n) for n, c in metrics.imbalance_columns().items()]
            )
        ),
        _with(
            f"""SELECT class_0_count, class_1_count, {r("imbalance_ratio")} AS imbalance_ratio,
            class_distribution FROM ev""",
            SCORED_TIES,
            f", conf AS ({_confusion()}), ev AS ({EVALUATION})",
        ),
    ),
    "business_impact": (
        lambda s, d: rounded(biz.business_impact(metrics.confusion(scored_events(s, d)))),
        _with(
            f"SELECT {_round_list(IMPACT_COLUMNS)} FROM ({IMPACT})",
            extra=f", conf AS ({_confusion()})",
        ),
    ),
    "threshold_sweep": (
        lambda s, d: rounded(biz.threshold_sweep(scored_ties(s, d))),
        _with(
            f"""SELECT {r("threshold")} AS threshold, tp, fp, fn, {r("profit")} AS profit
            FROM ({SWEEP.format(source="s")})""",
            SCORED_TIES,
        ),
    ),
    "optimal_threshold": (
        lambda s, d: rounded(biz.optimal_threshold(biz.threshold_sweep(scored_events(s, d)))),
        _with(
            f"""SELECT {_round_list(["current_threshold", "optimal_threshold", "current_profit",
                                    "optimal_profit", "improvement"])}, recommendation
            FROM ({BEST})""",
            extra=f", sweep AS ({SWEEP.format(source='s')})",
        ),
    ),
    "roc_curve": (
        lambda s, d: rounded(curves.roc_curve(scored_events(s, d)), 6),
        _with(
            f"""SELECT {r("p", 6)} AS threshold, {r(div("fp", "nn"), 6)} AS fpr,
            {r(div("tp", "np"), 6)} AS tpr FROM c""",
            extra=HIST,
        ),
    ),
    "pr_curve": (
        lambda s, d: rounded(curves.pr_curve(scored_events(s, d)), 6),
        _with(
            f"""SELECT {r("p", 6)} AS threshold, {r(div("tp", "tp + fp"), 6)} AS "precision",
            {r(div("tp", "np"), 6)} AS recall FROM c""",
            extra=HIST,
        ),
    ),
    "auc_ap": (
        lambda s, d: rounded(curves.auc_ap(scored_events(s, d)), 6),
        _with(f"SELECT {_round_list(['auc_roc', 'average_precision'], 6)} FROM ({AREAS})", extra=HIST),
    ),
    "auc_ap_nan": (
        lambda s, d: rounded(curves.auc_ap(_scored_nan(s, d), rows_per_chunk=500), 6),
        _with(
            f"SELECT {_round_list(['auc_roc', 'average_precision'], 6)} FROM ({AREAS})",
            NAN_ROWS, HIST,
        ),
    ),
    "threshold_eval_nan": (
        lambda s, d: rounded(metrics.threshold_evaluation(_scored_nan(s, d), 0.3)),
        _with(
            f"""SELECT CAST(0.3 AS DOUBLE) AS threshold, tn, fp, fn, tp, total,
            {_round_list(METRICS)}, class_0_count, class_1_count, class_distribution,
            {r("auc_roc")} AS auc_roc FROM ev, areas""",
            NAN_ROWS,
            f"{HIST}, areas AS ({AREAS}), conf AS ({_confusion(0.3)}), ev AS ({EVALUATION})",
        ),
    ),
    "threshold_sweep_nan": (
        lambda s, d: rounded(biz.threshold_sweep(_scored_nan(s, d))),
        _with(f"SELECT * FROM ({SWEEP.format(source='s')})", NAN_ROWS),
    ),
    "auc_ap_ties": (
        lambda s, d: rounded(curves.auc_ap(scored_ties(s, d)), 6),
        _with(
            f"SELECT {_round_list(['auc_roc', 'average_precision'], 6)} FROM ({AREAS})",
            SCORED_TIES, HIST,
        ),
    ),
    "learning_curve": (
        lambda s, d: rounded(metrics.learning_curve(scored_events(s, d))),
        _with(
            f"""SELECT {_round_list(["test_loss", "test_accuracy", "train_loss", "train_accuracy",
                                    "gap"])}, overfitting_status
            FROM ({CURVE.format(source="s")})"""
        ),
    ),
    "importance_with_correlation": (
        lambda s, d: rounded(ready.importance_with_correlation(scored_events(s, d), FEATURES)),
        _with(
            f"""SELECT rank, name, {_round_list(["importance_score", "importance_percent",
                                                "correlation_with_target"])},
            correlation_strength FROM ({_importance("s")})"""
        ),
    ),
    "importance_summary": (
        lambda s, d: rounded(
            ready.importance_summary(
                ready.importance_with_correlation(scored_events(s, d), FEATURES)
            )
        ),
        _with(
            f"""SELECT {r("top_3_importance_percent")} AS top_3_importance_percent, total_features,
            strong_correlations FROM ({TOP})""",
            extra=f", imp AS ({_importance('s')})",
        ),
    ),
    "readiness": (
        lambda s, d: evaluate_model(scored_events(s, d), FEATURES).criteria,
        f"{_complete_ctes()} SELECT * FROM crit",
    ),
    "readiness_summary": (
        lambda s, d: evaluate_model(scored_events(s, d), FEATURES).production_readiness,
        f"{_complete_ctes()} SELECT * FROM summ",
    ),
    "complete_evaluation": (
        lambda s, d: rounded(evaluate_model(scored_events(s, d), FEATURES).long()),
        f"{_complete_ctes()} {_complete_long()}",
    ),
    "confusion_grid": (
        lambda s, d: metrics.confusion_grid(_predicted(s, d)),
        f"""SELECT label AS actual, prediction AS predicted, count(*) AS cnt
        FROM ({PREDICTED}) GROUP BY 1, 2""",
    ),
    "per_class_report": (
        lambda s, d: rounded(metrics.per_class_report(_predicted(s, d))),
        f"""WITH pr AS ({PREDICTED}) SELECT class,
        {_round_list(["precision", "recall", "f1_score"])}, support FROM ({PER_CLASS})""",
    ),
    "classification_metrics": (
        lambda s, d: rounded(metrics.classification_metrics(_predicted(s, d))),
        f"""WITH pr AS ({PREDICTED}) SELECT
        {r("sum(support * recall) / sum(support)")} AS accuracy,
        {r("sum(support * precision) / sum(support)")} AS "precision",
        {r("sum(support * recall) / sum(support)")} AS recall,
        {r("sum(support * f1_score) / sum(support)")} AS f1_score FROM ({PER_CLASS})""",
    ),
    "regression_metrics": (
        lambda s, d: rounded(metrics.regression_metrics(_estimates(s, d))),
        f"""SELECT {r("1 - avg((label - prediction) ** 2) / var_pop(label)")} AS r2,
        {r("avg(abs(label - prediction))")} AS mae, {r("avg((label - prediction) ** 2)")} AS mse,
        {r("sqrt(avg((label - prediction) ** 2))")} AS rmse,
        {r("avg(abs((label - prediction) / label))")} AS mape FROM ({ESTIMATES})""",
    ),
}
