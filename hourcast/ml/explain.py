"""Explanations (M22-M26): importances, top drivers per city, linear SHAP,
permutation importance, local surrogates (LIME) and background samples.

The model-level importance vector has one entry per feature, so it is a
small bounded frame; everything that touches data rows is a Spark job.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourcast.functions.scalars import explainable
from hourcast.ml.models import RAW
from hourcast.operators.split import dense_ids
from hourcast.session import cut_lineage


def importance_frame(spark: SparkSession, pairs: Sequence[tuple[str, float]]) -> DataFrame:
    """(feature, importance, rank) sorted by importance."""
    df = spark.createDataFrame(list(pairs), "feature string, importance double")
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    return df.withColumn("rank", F.row_number().over(w))


def unpivot(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    items = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols]
    return df.select(*keys, F.explode(F.array(*items)).alias("_u")).select(*keys, f"_u.{name}", f"_u.{value}")


def top_drivers(latest: DataFrame, imp: DataFrame, keys: Sequence[str] = ("city",), k: int = 8) -> DataFrame:
    """Drop cyclical encodings, normalise by the largest importance,
    keep the top k features with each key's current value."""
    e = imp.where(explainable("feature"))
    mx_imp = F.max("importance").over(Window.partitionBy())
    top = e.select("feature", F.try_divide(F.col("importance"), mx_imp).alias("importance")) \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))) \
        .where(F.col("rank") <= k)
    feats = [r[0] for r in top.select("feature").collect()]                      # <= k names
    vals = unpivot(latest, keys, feats)
    return vals.join(F.broadcast(top), "feature").select(*keys, "rank", "feature", "importance", "value")


def linear_shap(df: DataFrame, features: Sequence[str], coefficients: Sequence[float]) -> DataFrame:
    """M23 (linear models, independent features): mean |w_j (x_j - mean_j)|."""
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    row = df.agg(*[F.avg(F.abs(F.lit(float(w)) * (F.col(c) - F.lit(float(means[c] or 0.0))))).alias(c)
                   for c, w in zip(features, coefficients)])
    return unpivot(row, [], features, "feature", "mean_abs_shap") \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_abs_shap").desc(), "feature")))


def background_sample(df: DataFrame, key: Sequence[str], n: int = 100, seed: int = 42) -> DataFrame:
    """N rows without replacement, reproducible (order of the key's md5;
    the limit is the sampling operator itself)."""
    return df.orderBy(F.md5(_key_text(key, seed)), *key).limit(n)


def _key_text(key: Sequence[str], *more) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in key], *[F.lit(str(m)) for m in more])


def permutation_importance(vec: DataFrame, model, features: Sequence[str], label: str, key: Sequence[str],
                           seed: int = 42) -> DataFrame:
    """M23 for any pipeline over ``RAW``: the RMSE increase of every feature
    when its values are permuted over all rows.

    Rows are put in a random order drawn from their keys (md5, so retries and
    other engines draw the same); each takes the feature's value from the row
    before it, the first from the last. One join on the dense position serves
    every feature; the (row, feature) variants are made and scored on the fly
    and only their metric sums are shuffled."""
    d = vec.where(F.col(label).isNotNull()).select(
        *key, vector_to_array(RAW).alias("_x"), F.col(label).cast("double").alias("y"), F.md5(_key_text(key, seed)).alias("_h"))
    placed = cut_lineage(dense_ids(d, ["_h", *key], "_i"))
    n = placed.count()
    donor = placed.select(((F.col("_i") + 1) % F.lit(max(n, 1))).alias("_i"), F.col("_x").alias("_z"))
    # variant -1 leaves the row as it is
    each = placed.join(donor, "_i").select("y", "_x", "_z", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))).alias("_j"))
    swapped = F.transform("_x", lambda v, i: F.when(i == F.col("_j"), F.element_at("_z", i + 1)).otherwise(v))
    scored = model.transform(each.select("_j", "y", array_to_vector(swapped).alias(RAW)))
    e = F.col("y") - F.col("prediction")
    rmse = scored.groupBy("_j").agg(F.sqrt(F.avg(e * e)).alias("rmse"))        # one row per feature
    base = rmse.where(F.col("_j") < 0).select(F.col("rmse").alias("_base"))
    names = F.array(*[F.lit(f) for f in features])
    return rmse.where(F.col("_j") >= 0).join(F.broadcast(base)).select(
        F.element_at(names, F.col("_j") + 1).alias("feature"), (F.col("rmse") - F.col("_base")).alias("rmse_increase"))


def _normal(key: Sequence[str], sample: Column, i: Column, seed: int) -> Column:
    """A standard normal draw from (key, sample, feature, seed)."""
    def uniform(salt: int) -> Column:
        h = F.xxhash64(*[F.col(k) for k in key], sample, i, F.lit(seed), F.lit(salt))
        return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(2 ** 53))
    return F.sqrt(F.lit(-2.0) * F.log(uniform(1))) * F.cos(F.lit(2 * np.pi) * uniform(2))


def lime(instances: DataFrame, model, features: Sequence[str], key: Sequence[str], stds: Sequence[float],
         n_samples: int = 500, top: int = 10, seed: int = 42) -> DataFrame:
    """Per instance (a row with the ``RAW`` vector of all features) a
    local linear surrogate of the pipeline on Gaussian perturbations, weighted
    by an exponential kernel on the scaled distance. The ``top`` strongest
    features of each instance are reported; the result is their mean |weight|
    (per std of the feature) over the instances that report them. Each
    surrogate sees only its instance's ``n_samples`` rows (bounded); draws come
    from the key, so a retry makes the same ones."""
    pert = instances.select(*key, vector_to_array(RAW).alias("_x"), F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("_s")) \
        .repartition(*key, "_s")
    z = F.transform("_x", lambda v, i: _normal(key, F.col("_s"), i, seed))
    pert = pert.withColumn("_z", z)
    sd = F.array(*[F.lit(float(v)) for v in stds])
    moved = F.transform("_x", lambda v, i: v + F.element_at("_z", i + 1) * F.element_at(sd, i + 1))
    scored = model.transform(pert.withColumn(RAW, array_to_vector(moved))).select(*key, "_z", F.col("prediction").alias("_y"))
    use = [i for i, v in enumerate(stds) if v > 0]
    names = [features[i] for i in use]
    width = 0.75 * np.sqrt(len(use))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["_z"].to_numpy())[:, use]
        y = pdf["_y"].to_numpy(dtype=float)
        w = np.sqrt(np.exp(-(x ** 2).sum(axis=1) / width ** 2))
        x = x - np.average(x, axis=0, weights=w)
        y = y - np.average(y, weights=w)
        coef = np.linalg.solve((x * w[:, None]).T @ x + np.eye(x.shape[1]), (x * w[:, None]).T @ y)
        best = np.argsort(-np.abs(coef), kind="stable")[:top]
        return pd.DataFrame({"feature": [names[i] for i in best], "weight": coef[best]})

    local = scored.groupBy(*key).applyInPandas(fit, "feature string, weight double")
    return local.groupBy("feature").agg(F.avg(F.abs("weight")).alias("mean_abs_weight"), F.count(F.lit(1)).alias("n"))
