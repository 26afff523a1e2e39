"""Scalers fitted on the training split.

``fit`` is one aggregate (one metric row to the driver); ``transform`` is a
projection with the fitted numbers as literals, so applying a scaler never
joins or shuffles.

Standard scaling uses the *population* std and maps a zero-variance column
to scale 1 (output ``x - mean``), unlike Spark ML's ``StandardScaler``
(sample std, zero output). With ``decimals`` set, mean and std are computed
from exact integer sums of the fixed-point values.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourcast.operators.quality import quantiles


def fit_standard(df: DataFrame, cols: Sequence[str], decimals: int | None = None) -> dict:
    aggs = []
    for c in cols:
        if decimals is None:
            aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s")]
        else:
            scale = float(10 ** decimals)
            v = F.round(F.col(c) * F.lit(scale)).cast("long")
            d = v.cast("decimal(18,0)")  # n * sum of squares outgrows bigint
            n, s, ss = F.count(v), F.sum(d).cast("decimal(38,0)"), F.sum(d * d).cast("decimal(38,0)")
            aggs += [(s.cast("double") / (F.lit(scale) * n)).alias(f"{c}__m"),
                     (F.sqrt((n.cast("decimal(38,0)") * ss - s * s).cast("double")) / (F.lit(scale) * n)).alias(f"{c}__s")]
    row = df.agg(*aggs).first()
    return {c: (row[f"{c}__m"], (row[f"{c}__s"] or 1.0) if row[f"{c}__s"] != 0 else 1.0) for c in cols}


def fit_complete(df: DataFrame, cols: Sequence[str]) -> dict:
    """Mean and population std of columns without NULLs, in one vector
    aggregate instead of two per column. Constant columns get scale 0, so
    callers can leave them out."""
    vec = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(df.select(*[F.col(c).cast("double") for c in cols]))
    r = vec.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).first()["s"]
    n = max(int(r["count"]), 1)
    # rounding may leave a trace of variance in a constant column
    return {c: (float(m), 0.0 if v <= 1e-18 * max(1.0, m * m) else (float(v) * (n - 1) / n) ** 0.5)
            for c, m, v in zip(cols, r["mean"], r["variance"])}


def fit_robust(df: DataFrame, cols: Sequence[str]) -> dict:
    """Median and IQR with linearly interpolated quartiles (A22); IQR 0 -> 1."""
    out = {}
    for c, (q1, med, q3) in quantiles(df, cols).items():
        iqr = (q3 or 0.0) - (q1 or 0.0)
        out[c] = (med or 0.0, iqr if iqr != 0 else 1.0)
    return out


def transform(df: DataFrame, params: dict, suffix: str = "") -> DataFrame:
    """(x - center) / scale for every fitted column, other columns kept."""
    cols = []
    for c in df.columns:
        if c in params:
            center, scale = params[c]
            cols.append(((F.col(c) - F.lit(float(center))) / F.lit(float(scale))).alias(c + suffix))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def split_stats(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Target mean and population std per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"),
                                 F.stddev_pop(target).alias("std"))
