"""Money: costs and profit at a threshold, and the threshold that earns most."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabassay.functions.scores import settled
from tabassay.functions.stats import percent, ratio

# The 19 candidate thresholds 0.05, 0.10, ... 0.95.
THRESHOLDS = tuple(i / 20 for i in range(1, 20))
CURRENT_THRESHOLD = 0.5


@dataclass(frozen=True)
class Prices:
    """Money per outcome and the number of predictions per period."""

    cost_false_positive: float = 500.0
    cost_false_negative: float = 2000.0
    revenue_true_positive: float = 1000.0
    volume: float = 10000.0


def impact_columns(prices: Prices = Prices()) -> dict[str, Column]:
    """Costs, revenue and profit of confusion counts scaled up to the volume.

    The return is profit over cost in percent, null when nothing is spent.
    """
    scale = ratio(F.lit(float(prices.volume)), F.col("total"))
    fp_cost = F.col("fp") * prices.cost_false_positive * scale
    fn_cost = F.col("fn") * prices.cost_false_negative * scale
    revenue = F.col("tp") * prices.revenue_true_positive * scale
    profit = revenue - fp_cost - fn_cost
    return {
        "cost_per_false_positive": F.lit(float(prices.cost_false_positive)),
        "cost_per_false_negative": F.lit(float(prices.cost_false_negative)),
        "total_false_positive_cost": fp_cost,
        "total_false_negative_cost": fn_cost,
        "total_cost": fp_cost + fn_cost,
        "revenue_per_true_positive": F.lit(float(prices.revenue_true_positive)),
        "total_revenue_from_tp": revenue,
        "net_profit": profit,
        "approval_rate": ratio(F.col("tp") + F.col("fp"), F.col("total")),
        "roi_improvement_percent": percent(profit, fp_cost + fn_cost),
    }


def business_impact(
    counts: DataFrame, prices: Prices = Prices(), by: Sequence[str] = ()
) -> DataFrame:
    """The money behind confusion counts, one row per row of counts."""
    return counts.select(*by, *[c.alias(n) for n, c in impact_columns(prices).items()])


def sweep_aggregates(inside: Column | None = None) -> list[Column]:
    """Positives, and hits at every candidate threshold: no join, no extra rows."""
    y = F.col("y") if inside is None else F.when(inside, F.col("y"))
    scored = F.col("p").isNotNull()
    positive, negative = (y == 1) & scored, (y != 1) & scored
    exprs = [F.count_if(positive).alias("positives")]
    for i, t in enumerate(THRESHOLDS):
        hit = F.col("p") >= t
        exprs.append(F.count_if(positive & hit).alias(f"tp_{i}"))
        exprs.append(F.count_if(negative & hit).alias(f"fp_{i}"))
    return exprs


def threshold_sweep(
    scored: DataFrame, prices: Prices = Prices(), by: Sequence[str] = ()
) -> DataFrame:
    """Outcome counts and profit at every candidate threshold, from one aggregate."""
    return sweep_of(settled(scored).groupBy(*by).agg(*sweep_aggregates()), prices, by)


def sweep_of(
    row: DataFrame, prices: Prices = Prices(), by: Sequence[str] = ()
) -> DataFrame:
    rows = ", ".join(
        f"{t!r}D, tp_{i}, fp_{i}, positives - tp_{i}" for i, t in enumerate(THRESHOLDS)
    )
    profit = (
        F.col("tp") * prices.revenue_true_positive
        - F.col("fp") * prices.cost_false_positive
        - F.col("fn") * prices.cost_false_negative
    )
    return row.selectExpr(
        *[f"`{b}`" for b in by], f"stack({len(THRESHOLDS)}, {rows}) AS (threshold, tp, fp, fn)"
    ).withColumn("profit", profit.cast("double"))


def optimal_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The most profitable threshold, the lowest on ties, against the current one."""
    best = sweep.groupBy(*by).agg(
        F.max_by("threshold", F.struct(F.col("profit"), -F.col("threshold"))).alias(
            "optimal_threshold"
        ),
        F.max("profit").alias("optimal_profit"),
        F.max(F.when(F.col("threshold") == CURRENT_THRESHOLD, F.col("profit"))).alias(
            "current_profit"
        ),
    )
    improvement = F.col("optimal_profit") - F.col("current_profit")
    text = F.when(
        F.col("optimal_threshold") == CURRENT_THRESHOLD,
        F.lit(f"Keep threshold at {CURRENT_THRESHOLD:.2f}"),
    ).otherwise(
        F.concat(
            F.lit(f"Adjust threshold from {CURRENT_THRESHOLD:.2f} to "),
            F.format_string("%.2f", F.col("optimal_threshold")),
            F.lit(" for $"),
            F.format_number(improvement, 0),
            F.lit(" profit improvement"),
        )
    )
    return best.select(
        *by,
        F.lit(CURRENT_THRESHOLD).alias("current_threshold"),
        "optimal_threshold",
        "current_profit",
        "optimal_profit",
        improvement.alias("improvement"),
        text.alias("recommendation"),
    )


def running_share(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Each value of a small table as a share of the total, when the total is positive."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    total = F.sum(value).over(w)
    return df.withColumn(
        "share", F.when(total > 0, ratio(F.col(value), total)).otherwise(F.col(value))
    )
