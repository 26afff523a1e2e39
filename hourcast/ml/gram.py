"""Linear models from moments.

A linear fit needs of its rows only n, the sums and the products of features
and label: one matrix of (p + 2)^2 numbers per group, added up over the rows
in one pass. Sums over folds are sums of their matrices, so the training rows
of a fold are the total less the fold (or the folds before it), and every
penalty is solved on the driver from the same matrix: ridge by a factorisation,
lasso and elastic net by a search over signs. Nothing there grows with the rows.

Objectives, with features divided by their population std and a free
intercept: ridge |y - Xw|^2 + alpha |w|^2; lasso and elastic net
|y - Xw|^2 / 2n + alpha l1 |w|_1 + alpha (1 - l1) |w|^2 / 2 (lasso: l1 = 1).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: a feature whose variance is below this share of its mean square is constant
FLAT = 1e-18


@dataclass
class Moments:
    """Products of z = (1, x - shift, y - shift), summed over rows."""
    m: np.ndarray
    shift: np.ndarray

    def __add__(self, o: "Moments") -> "Moments":
        return Moments(self.m + o.m, self.shift)

    def __sub__(self, o: "Moments") -> "Moments":
        return Moments(self.m - o.m, self.shift)

    @property
    def n(self) -> float:
        return float(self.m[0, 0])

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """(means, centred products / n) of features and label."""
        mean = self.m[0, 1:] / self.n
        return mean + self.shift, self.m[1:, 1:] / self.n - np.outer(mean, mean)


def moments(df: DataFrame, features: str, label: str, by: str) -> dict[object, Moments]:
    """The moments of every value of ``by``: one pass over the rows, and one
    row per group and pair of columns of it, however many rows there are.
    Rows without a label are left out. Shifting by any one row keeps large
    offsets from eating the digits; results do not depend on which."""
    from pyspark.ml.functions import vector_to_array
    src = df.where(F.col(label).isNotNull()).select(
        F.col(by).alias("g"), vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    one = src.first()
    if one is None:
        return {}
    shift = np.append(np.array(one["x"], float), float(one["y"]))
    kind = src.schema["g"].dataType.simpleString()

    def run(batches):
        import pandas as pd
        held: dict = {}
        for b in batches:
            x = np.stack(b["x"].to_numpy())
            z = np.column_stack([np.ones(len(b)), np.column_stack([x, b["y"].to_numpy()]) - shift])
            codes, groups = pd.factorize(b["g"])
            for c, g in enumerate(groups):
                part = z[codes == c]
                held[g] = held.get(g, 0) + part.T @ part
        for g, m in held.items():
            i, j = np.triu_indices(len(m))
            yield pd.DataFrame({"g": [g] * len(i), "i": i, "j": j, "v": m[i, j]})

    got = src.mapInPandas(run, f"g {kind}, i int, j int, v double").groupBy("g", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for g, rows in got.groupby("g"):
        m = np.zeros((len(shift) + 1,) * 2)
        i, j, v = rows["i"].to_numpy(), rows["j"].to_numpy(), rows["v"].to_numpy()
        m[i, j] = m[j, i] = v
        out[g] = Moments(m, shift)
    return out


@dataclass
class Weights:
    """Per unit of the unscaled features; ``scaled`` per std."""
    intercept: float
    w: np.ndarray
    scaled: np.ndarray

    @property
    def nonzero(self) -> int:
        return int(np.count_nonzero(self.scaled))


def solve(m: Moments, alpha: float, l1_ratio: float | None = None) -> Weights:
    """Ridge (``l1_ratio`` None) or elastic net of the moments. Constant
    features get weight zero."""
    mean, cov = m.centred()
    var = np.diag(cov)[:-1]
    use = np.flatnonzero(var > FLAT * np.maximum(1.0, mean[:-1] ** 2))
    sd = np.sqrt(var[use])
    a = cov[np.ix_(use, use)] / np.outer(sd, sd)
    b = cov[use, -1] / sd
    if l1_ratio is None:
        s = np.linalg.solve(a + np.eye(len(use)) * (alpha / m.n), b) if len(use) else b
    else:
        s = _sparse(a + np.eye(len(use)) * (alpha * (1 - l1_ratio)), b, alpha * l1_ratio)
    scaled = np.zeros(len(var))
    scaled[use] = s
    w = np.zeros(len(var))
    w[use] = s / sd
    return Weights(float(mean[-1] - w @ mean[:-1]), w, scaled)


def _sparse(a: np.ndarray, b: np.ndarray, l1: float) -> np.ndarray:
    """The w that minimises w'aw / 2 - b'w + l1 |w|_1, by signs: with the signs
    of the active weights fixed it is a linear system; on the way to its
    solution the best point among the sign changes is taken, and when the
    active ones are settled the weight that pulls most joins. Each step lowers
    the value, so it ends; no step size or number of sweeps to choose."""
    p = len(b)
    w, sign = np.zeros(p), np.zeros(p)
    jitter = 1e-12 * max(1.0, float(np.diag(a).max(initial=0)))
    slack = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    settled, value = True, 0.0
    for _ in range(50 * p + 50):
        if settled:
            pull = np.where(sign == 0, np.abs(b - a @ w), 0.0)
            i = int(np.argmax(pull)) if p else 0
            if not p or pull[i] <= l1 + slack:
                break
            sign[i] = np.sign(b[i] - a[i] @ w)
        s = np.flatnonzero(sign)
        part = a[np.ix_(s, s)]
        aim = np.linalg.solve(part + jitter * np.eye(len(s)), b[s] - l1 * sign[s])
        step = aim - w[s]
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = -w[s] / step
        at = np.append(np.sort(cross[(w[s] != 0) & (cross > 0) & (cross < 1)]), 1.0)
        points = w[s] + at[:, None] * step
        points[:-1][np.isclose(cross, at[:-1, None], rtol=1e-12, atol=0)] = 0.0
        worth = 0.5 * np.einsum("ij,jk,ik->i", points, part, points) - points @ b[s] + l1 * np.abs(points).sum(1)
        best = int(np.argmin(worth))
        if worth[best] >= value:
            if settled:
                break  # the joining weight gains nothing that numbers show
            settled = True
            continue
        value = float(worth[best])
        settled = best == len(at) - 1 and bool((np.sign(points[best]) == sign[s]).all())
        w[s] = points[best]
        sign[s] = np.sign(w[s])
    return w


#: (alpha, l1_ratio) of a linear model's parameters, by name
PENALTY = {
    "ridge": lambda p: (p.get("alpha", 1.0), None),
    "lasso": lambda p: (p.get("alpha", 0.1), 1.0),
    "elastic_net": lambda p: (p.get("alpha", 1.0), p.get("l1_ratio", 0.5)),
}


def fit(name: str, m: Moments, params: dict | None = None) -> Weights:
    return solve(m, *PENALTY[name](params or {}))


def as_model(weights: Sequence[float], intercept: float, features_col: str, prediction_col: str = "prediction"):
    """A Spark ``LinearRegressionModel`` of solved weights, so that it can stand
    in pipelines, be saved and be read like a fitted one."""
    import uuid

    from pyspark import SparkContext
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegressionModel
    sc = SparkContext._active_spark_context
    java = sc._jvm.org.apache.spark.ml.regression.LinearRegressionModel(
        f"LinearRegression_{uuid.uuid4().hex[:12]}", _py2java(sc, Vectors.dense([float(x) for x in weights])), float(intercept), 1.0)
    return LinearRegressionModel(java).setFeaturesCol(features_col).setPredictionCol(prediction_col)


def predictions(df: DataFrame, features: str, label: str, by: str, models: dict[object, list[tuple[object, Weights]]]) -> DataFrame:
    """(by, tag, y, yhat): every row under the models of its group, in one
    pass; models: {group: [(tag, weights)]}, as long as there are models."""
    from pyspark.ml.functions import vector_to_array
    src = df.where(F.col(label).isNotNull()).select(
        F.col(by).alias("g"), vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    kind = src.schema["g"].dataType.simpleString()

    def run(batches):
        import pandas as pd
        for b in batches:
            for g, rows in b.groupby("g", sort=False):
                if not models.get(g):
                    continue
                x = np.stack(rows["x"].to_numpy())
                for tag, w in models[g]:
                    yield pd.DataFrame({"g": g, "tag": str(tag), "y": rows["y"].to_numpy(), "yhat": x @ w.w + w.intercept})

    return src.mapInPandas(run, f"g {kind}, tag string, y double, yhat double").withColumnRenamed("g", by)
