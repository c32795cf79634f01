"""Everything known about one scored model, from a fixed number of scans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.functions.scores import settled
from tabassay.operators import business as biz
from tabassay.operators import curves, metrics, readiness
from tabassay.operators.cleaning import require_rows
from tabassay.operators.frames import settle
from tabassay.plans.eda import _long


@dataclass
class Evaluation:
    """One small DataFrame per section; the two curves have a row per distinct score."""

    evaluation: DataFrame
    business_impact: DataFrame
    roc_curve: DataFrame
    pr_curve: DataFrame
    areas: DataFrame
    learning_curve: DataFrame
    feature_importance: DataFrame
    importance_summary: DataFrame
    optimal_threshold: DataFrame
    criteria: DataFrame
    production_readiness: DataFrame

    def sections(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def long(self) -> DataFrame:
        """All sections but the curves as rows ``(section, item, metric, value, text)``."""
        items = {"feature_importance": "name", "criteria": "metric"}
        skipped = {"roc_curve", "pr_curve"}
        parts = [
            _long(df, name, items.get(name))
            for name, df in self.sections().items()
            if name not in skipped
        ]
        return reduce(DataFrame.unionByName, parts)


def metric_rows(row: DataFrame) -> DataFrame:
    """A one-row result as rows ``(metric, value)``, numbers only."""
    numbers = [n for n, t in row.dtypes if t != "string"]
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in numbers)
    return row.selectExpr(f"stack({len(numbers)}, {pairs}) AS (metric, value)")


def evaluate_model(
    scored: DataFrame,
    features: Sequence[str],
    threshold: float = 0.5,
    prices: biz.Prices = biz.Prices(),
    split: str = "split",
) -> Evaluation:
    """Judge a scored set ``(y, p, split, features..)``; only test rows are judged.

    Train rows, when there are any, serve the learning curve. One scan counts outcomes,
    all thresholds and losses; the score histogram and the feature correlations follow.
    """
    require_rows(scored)
    scored = settled(scored)
    is_test = F.col(split) == "test"
    test = scored.filter(is_test)
    row = scored.agg(
        *metrics.confusion_aggregates(threshold, is_test),
        *biz.sweep_aggregates(is_test),
        *metrics.learning_aggregates(threshold, split),
    )
    points = curves.cumulative(test)
    facts = settle(row.crossJoin(curves.areas_of(points)))
    if facts.first()["total"] == 0:
        raise ValueError("the input holds no test rows")
    columns = metrics.evaluation_columns(threshold)
    impact = biz.impact_columns(prices)
    curve = settle(metrics.learning_curve_of(facts))
    importance = settle(readiness.importance_with_correlation(test, features))
    top = readiness.importance_summary(importance)
    judged = metric_rows(
        facts.select(*[c.alias(n) for n, c in (columns | impact).items()])
        .crossJoin(curve.withColumn("overfitting_severity", readiness.overfitting_severity()))
        .crossJoin(top)
    )
    criteria = settle(readiness.readiness(judged))
    return Evaluation(
        evaluation=facts.select(*[c.alias(n) for n, c in columns.items()]),
        business_impact=biz.business_impact(facts, prices),
        roc_curve=curves.roc_of(points),
        pr_curve=curves.pr_of(points),
        areas=facts.select("auc_roc", "average_precision"),
        learning_curve=curve,
        feature_importance=importance,
        importance_summary=top,
        optimal_threshold=biz.optimal_threshold(biz.sweep_of(facts, prices)),
        criteria=criteria,
        production_readiness=readiness.readiness_summary(criteria),
    )
