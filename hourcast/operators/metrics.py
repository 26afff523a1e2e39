"""Forecast-quality aggregates.

Metrics are ordinary grouped aggregates, so a single ``groupBy`` computes
every (model, horizon) bundle with map-side partial aggregation; nothing
leaves the executors except one row per group.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourcast.functions.scalars import aqi_category


def metric_columns(y: str = "y", yhat: str = "yhat", mape: str = "zero_excluding") -> list[Column]:
    """N, rmse, mae, r2 (1 - SSE/SST, may be negative), mape (%)."""
    e = F.col(y) - F.col(yhat)
    if mape == "epsilon":
        mp = F.avg(F.abs(e / (F.col(y) + F.lit(1e-8)))) * F.lit(100.0)
    else:
        mp = F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))) * F.lit(100.0)
    return [
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
        mp.alias("mape"),
    ]


def evaluate(df: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat",
             mape: str = "zero_excluding") -> DataFrame:
    """Metric bundle per group (NULL labels/predictions dropped first)."""
    clean = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    return clean.groupBy(*by).agg(*metric_columns(y, yhat, mape))


def long_predictions(df: DataFrame, y_cols: dict, models: dict, keep: Sequence[str] = ()) -> DataFrame:
    """Wide (one truth per horizon, one prediction column per model) ->
    long ``(horizon, model, y, yhat)`` via one explode."""
    items = [F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("model"),
                      F.col(yc).cast("double").alias("y"), F.col(pc).cast("double").alias("yhat"))
             for h, yc in y_cols.items() for m, pc in models.items()]
    return df.select(*keep, F.explode(F.array(*items)).alias("_p")).select(*keep, "_p.*")


def best_by(metrics: DataFrame, metric: str, by: Sequence[str] = (), model: str = "model",
            higher_is_better: bool | None = None) -> DataFrame:
    """Best model per group (min rmse/mae/mape, max r2); ties broken
    by model name. Runs on the small metrics table."""
    hib = metric == "r2" if higher_is_better is None else higher_is_better
    o = F.col(metric).desc_nulls_last() if hib else F.col(metric).asc_nulls_last()
    w = Window.partitionBy(*by).orderBy(o, F.col(model)) if by else Window.orderBy(o, F.col(model))
    return metrics.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pivot_metric(metrics: DataFrame, metric: str, index: str, columns: str, values: Sequence,
                 prefix: str = "h", digits: int = 2) -> DataFrame:
    """Index x columns table of one metric (first value), rounded."""
    p = metrics.groupBy(index).pivot(columns, list(values)).agg(F.first(F.round(metric, digits)))
    return p.select(index, *[F.col(str(v)).alias(f"{prefix}{v}") for v in values])


def rank_models(metrics: DataFrame, metric: str = "rmse", by: Sequence[str] = ()) -> DataFrame:
    """rank() of models by a metric."""
    w = Window.partitionBy(*by).orderBy(F.col(metric)) if by else Window.orderBy(F.col(metric))
    return metrics.withColumn("rank", F.rank().over(w))


# A1-A3, J4 -------------------------------------------------------------------
def exact_mean(c: str) -> Column:
    """Mean of a two-decimal column through a decimal sum (order-independent)."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(c)


def next_day_log(obs: DataFrame, models: dict) -> DataFrame:
    """Prediction log of next-day models: at hour t, model ``name`` predicts
    column ``models[name]`` for the following day (target date = date(t) + 1)."""
    td = F.date_add(F.to_date("timestamp"), 1).alias("target_date")
    out = None
    for name, col in models.items():
        f = obs.select("city", td, F.col(col).alias("predicted_aqi"), F.lit(name).alias("model_used"))
        out = f if out is None else out.unionByName(f)
    return out


def daily_predictions(log: DataFrame, exact: bool = True) -> DataFrame:
    """A1: mean predicted value per (city, model, target date)."""
    m = exact_mean("predicted_aqi") if exact else F.avg("predicted_aqi")
    return (log.where(F.col("predicted_aqi").isNotNull())
            .groupBy("city", "model_used", "target_date").agg(m.alias("predicted")))


def daily_actuals(obs: DataFrame, value: str = "aqi", exact: bool = True) -> DataFrame:
    """A2: mean actual value per (city, day)."""
    m = exact_mean(value) if exact else F.avg(value)
    return (obs.where(F.col(value).isNotNull())
            .groupBy("city", F.to_date("timestamp").alias("target_date")).agg(m.alias("actual")))


def accuracy_history(pred_daily: DataFrame, actual_daily: DataFrame) -> DataFrame:
    """Daily predictions left-joined to daily actuals (unmatched -> NULL).
    Both sides are per-day aggregates, so the join is between small tables."""
    return pred_daily.join(actual_daily, on=["city", "target_date"], how="left")


def accuracy_score(history: DataFrame, by: Sequence[str] = ("city", "model_used")) -> DataFrame:
    """A3: max(0, 100 - 100 * mean(|p - a| / a)) over days with actual > 0;
    NULL when there is no such day."""
    rel = F.when(F.col("actual") > 0, F.abs(F.col("predicted") - F.col("actual")) / F.col("actual"))
    mre = F.avg(rel)
    return history.groupBy(*by).agg(
        F.count(rel).alias("days"),
        F.when(mre.isNotNull(), F.greatest(F.lit(0.0), F.lit(100.0) - F.lit(100.0) * mre)).alias("accuracy"))


def category_accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Share of rows whose predicted category equals the true one, per
    true category."""
    t, p = aqi_category(F.col(actual)), aqi_category(F.col(predicted))
    return (df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
            .groupBy(t.alias("category"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg((t == p).cast("int")).alias("accuracy")))
