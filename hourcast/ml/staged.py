"""Ensembles read by their prefixes.

A boosted model of 300 rounds holds the ones of 100 and 200, and the first
trees of a forest are a smaller forest, so one fit answers for every size below
its own. Early stopping with patience is a prefix too: the rounds are scored
on a held-back slice in one pass, and the model is cut at the round from which
``patience`` further ones brought nothing better.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark import SparkContext
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel
from pyspark.sql import DataFrame, functions as F

PATIENCE = 20
#: rounds of the first fit under early stopping
FIRST_ROUNDS = 100


def prefix(model, size: int):
    """The model of the first ``size`` trees."""
    java = model._java_obj
    total = model.getNumTrees
    if not 0 < size <= total:
        raise ValueError(f"{size} of {total} trees")
    if size == total:
        return model
    sc = SparkContext._active_spark_context
    jvm, gateway = sc._jvm, sc._gateway
    trees = java.trees()
    part = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, size)
    for i in range(size):
        part[i] = trees[i]
    uid = f"{model.uid.split('_')[0]}_{uuid.uuid4().hex[:12]}"
    if isinstance(model, GBTRegressionModel):
        weights = gateway.new_array(jvm.double, size)
        for i, w in enumerate(model.treeWeights[:size]):
            weights[i] = float(w)
        out = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, part, weights, model.numFeatures))
    else:
        made = jvm.org.apache.spark.ml.regression.RandomForestRegressionModel(uid, part, model.numFeatures)
        made.set(made.getParam("numTrees"), size)  # a forest divides by it
        out = RandomForestRegressionModel(made)
    return out.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def stop_after(errors: Sequence[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """(rounds to keep, whether training would have stopped): the best round
    so far when ``patience`` rounds in a row did not beat it (ties keep the
    earlier one); the best of all if that never happens."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def boost_with_patience(est: GBTRegressor, train: DataFrame, held_back: str, patience: int = PATIENCE,
                        first_rounds: int = FIRST_ROUNDS) -> GBTRegressionModel:
    """The estimator on the rows that ``held_back`` does not mark, cut by
    the squared error on those that it does. Boosting is repeatable, so a
    short fit comes first and the whole one only if that was too short to
    tell. Without marked rows nothing is cut."""
    own = train.where(~F.col(held_back)).persist()
    judge = train.where(F.col(held_back)).persist()
    rounds = est.getMaxIter()
    try:
        if judge.isEmpty():
            return est.fit(own)
        for n in sorted({min(first_rounds, rounds), rounds}):
            model = est.copy({est.maxIter: n}).fit(own)
            keep, stopped = stop_after(model.evaluateEachIteration(judge, "squared"), patience)
            if stopped:
                break
        return prefix(model, keep)
    finally:
        own.unpersist()
        judge.unpersist()
