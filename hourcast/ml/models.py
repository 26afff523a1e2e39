"""Regressors on Spark ML.

Training data stays distributed: the complete rows become one checkpointed
frame of feature vectors, shared by every horizon, fold, parameter set and
model. Scaling is a pair of Spark ML stages, so a fitted model is one
``PipelineModel`` that can be written and read again. The driver only holds
the (small) list of fits, a few of which run at the same time, and one metric
row of each.

Linear models are solved from moments (``gram``): one pass over the rows
for every penalty, and for every fold of a cross-validation. Tree models of
one shape and several sizes are one fit, read by its prefixes (``staged``).

Parameter mapping of the single estimators to the scikit-learn objectives
(Spark's ``LinearRegression`` scales the label by its std internally):

* ridge(alpha):        regParam = alpha * sd(y) / n, elasticNetParam = 0; the
                       direct solver (up to 4,096 features) divides by the
                       population sd, so that one is used
* lasso(alpha):        regParam = alpha, elasticNetParam = 1
* elastic(alpha, l1):  A = alpha*l1, B = alpha*(1-l1); regParam = A + B*sd(y),
                       elasticNetParam = A / regParam
with ``standardization=False`` (the features are scaled beforehand) and
``sd`` the sample std of the training label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Callable, Sequence

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler, VectorSlicer
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourcast.ml import gram, staged
from hourcast.operators import metrics as mx
from hourcast.operators import scale as scl
from hourcast.operators import split as sp
from hourcast.session import cut_lineage

LABEL, FEATURES, PRED = "label", "features", "prediction"
RAW, HELD_BACK = "raw_features", "held_back"


def assemble(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """M1: feature vector + label; rows with a NULL label or feature are
    skipped (the reference drops incomplete rows)."""
    d = df.where(F.col(label).isNotNull()).select(*keep, *[F.col(c).cast("double").alias(c) for c in features],
                                                  F.col(label).cast("double").alias(LABEL))
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="skip").transform(d) \
        .select(*keep, FEATURES, LABEL)


@dataclass
class LabelStats:
    n: int
    sd: float
    sd_pop: float = 1.0


def label_stats(train: DataFrame, label: str = LABEL) -> LabelStats:
    r = train.agg(F.count(label).alias("n"), F.stddev_samp(label).alias("sd"), F.stddev_pop(label).alias("pop")).first()
    return LabelStats(int(r["n"]), float(r["sd"] or 1.0), float(r["pop"] or 1.0))


# M5-M12, M14 --------------------------------------------------------------------
def ridge(alpha: float = 1.0, stats: LabelStats | None = None, **_) -> Estimator:
    reg = alpha * stats.sd_pop / stats.n if stats else alpha
    return LinearRegression(regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10)


def lasso(alpha: float = 0.1, stats: LabelStats | None = None, **_) -> Estimator:
    return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=200)


def elastic_net(alpha: float = 1.0, l1_ratio: float = 0.5, stats: LabelStats | None = None, **_) -> Estimator:
    a, b = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    reg = a + b * (stats.sd if stats else 1.0)
    return LinearRegression(regParam=reg, elasticNetParam=(a / reg) if reg else 0.0, standardization=False, maxIter=200)


def random_forest(n_estimators: int = 100, max_depth: int = 10, min_samples_leaf: int = 2, seed: int = 42,
                  memory_mb: int = 256, **_) -> Estimator:
    """``memory_mb`` (all tree models): what a task may use for split
    statistics; less means more passes over the rows and the same trees."""
    return RandomForestRegressor(numTrees=n_estimators, maxDepth=max_depth, minInstancesPerNode=min_samples_leaf,
                                 featureSubsetStrategy="all", seed=seed, maxMemoryInMB=memory_mb)


def gradient_boosting(n_estimators: int = 100, max_depth: int = 5, learning_rate: float = 0.1, seed: int = 42,
                      memory_mb: int = 256, **_) -> Estimator:
    return GBTRegressor(maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, seed=seed,
                        maxMemoryInMB=memory_mb)


def xgboost_style(n_estimators: int = 500, max_depth: int = 6, learning_rate: float = 0.05, subsample: float = 0.8,
                  colsample: float = 0.8, seed: int = 42, memory_mb: int = 256, **_) -> Estimator:
    """Row and column subsampling (Spark samples columns per node)."""
    return GBTRegressor(maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, subsamplingRate=subsample,
                        featureSubsetStrategy=str(colsample), seed=seed, maxMemoryInMB=memory_mb)


def lightgbm_style(n_estimators: int = 500, max_depth: int = 6, learning_rate: float = 0.05, seed: int = 42,
                   memory_mb: int = 256, **_) -> Estimator:
    """``fit`` stops it early on a held-back slice (``staged``)."""
    return GBTRegressor(maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, seed=seed, maxMemoryInMB=memory_mb)


FACTORY: dict[str, Callable[..., Estimator]] = {
    "ridge": ridge, "lasso": lasso, "elastic_net": elastic_net, "random_forest": random_forest,
    "gradient_boosting": gradient_boosting, "xgboost": xgboost_style, "lightgbm": lightgbm_style,
}
LINEAR = {"ridge", "lasso", "elastic_net"}


def get_estimator(name: str, stats: LabelStats | None = None, **params) -> Estimator:
    """Estimator by name; unknown names raise."""
    if name not in FACTORY:
        raise ValueError(f"unknown model {name!r}; available: {sorted(FACTORY)}")
    return FACTORY[name](stats=stats, **params)


# M3 / M4 ---------------------------------------------------------------------
def persistence_prediction(df: DataFrame, candidates=("pm2_5", "aqi")) -> DataFrame:
    """M3: predict the current value (first candidate column present, else 0)."""
    c = next((x for x in candidates if x in df.columns), None)
    return df.withColumn(PRED, F.col(c).cast("double") if c else F.lit(0.0))


def moving_average_prediction(df: DataFrame, window: int = 24, base: str = "pm2_5") -> DataFrame:
    """M4: predict the trailing mean (``{base}_rolling_mean_{window}h``), else
    the current value, else 0."""
    c = f"{base}_rolling_mean_{window}h"
    src = c if c in df.columns else (base if base in df.columns else None)
    return df.withColumn(PRED, F.col(src).cast("double") if src else F.lit(0.0))


# M13, M15 -----------------------------------------------------------------------
class InsufficientData(ValueError):
    """P25: too few usable rows to train; the caller skips the run."""


MIN_ROWS, MIN_VALID = 100, 10


def guard(df: DataFrame, features: Sequence[str], label: str, min_rows: int = MIN_ROWS,
          min_valid: int = MIN_VALID) -> None:
    """P25: fewer than ``min_rows`` rows with a label, or fewer than
    ``min_valid`` complete rows, raise ``InsufficientData`` (one aggregate,
    before anything is fitted)."""
    if label not in df.columns:
        raise InsufficientData(f"label {label} missing")
    complete = F.col(label).isNotNull()
    for c in features:
        complete = complete & F.col(c).isNotNull()
    n_lab, n_ok = df.agg(F.count(F.col(label)), F.count(F.when(complete, 1))).first()
    if n_lab < min_rows or n_ok < min_valid:
        raise InsufficientData(f"{n_lab} labelled / {n_ok} complete rows")


def vectors(df: DataFrame, features: Sequence[str], labels: Sequence[str],
            keep: Sequence[str] = ("city", "timestamp")) -> DataFrame:
    """P11 + M1: the rows with every feature, as one vector column beside the
    labels, checkpointed once for all fits."""
    d = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features if c not in keep],
                  *[F.col(c).cast("double").alias(f"_y_{c}") for c in labels]).dropna(subset=list(features))
    return cut_lineage(VectorAssembler(inputCols=list(features), outputCol=RAW).transform(d)
                       .select(*keep, RAW, *[F.col(f"_y_{c}").alias(c) for c in labels]))


def scaler(train: DataFrame, features: Sequence[str]) -> tuple[list[Transformer], list[str]]:
    """A21 as stages from ``RAW`` to ``FEATURES``: features that vary in
    ``train``, divided by their population std. Constant ones carry nothing
    and make the linear solvers singular; centring only moves the intercept,
    which no model here penalises."""
    s = train.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(RAW)).alias("s")).first()["s"]
    n = max(int(s["count"]), 1)
    use = [i for i, (m, v) in enumerate(zip(s["mean"], s["variance"])) if v > 1e-18 * max(1.0, m * m)]
    sd = [(float(s["variance"][i]) * (n - 1) / n) ** 0.5 for i in use]
    return [VectorSlicer(inputCol=RAW, outputCol="_varying", indices=use),
            ElementwiseProduct(inputCol="_varying", outputCol=FEATURES, scalingVec=Vectors.dense([1.0 / x for x in sd]))], \
        [features[i] for i in use]


#: fits that run side by side: a fit is a long row of small jobs, which leave
#: most cores idle while the driver prepares the next one
FITS_AT_ONCE = 16


def cost(name: str, params: dict | None = None) -> int:
    """About how many small jobs a fit runs one after the other: levels of
    trees; 0 for linear models."""
    est = get_estimator(name, **{k: v for k, v in (params or {}).items() if k != "patience"})
    trees = est.getMaxIter() if isinstance(est, GBTRegressor) else est.getNumTrees() if isinstance(est, RandomForestRegressor) else 0
    return trees * est.getMaxDepth() if trees else 0


def at_once(tasks: Sequence[Callable], parallelism: int, costs: Sequence[int] | None = None) -> list:
    """Run independent fits, a few at a time and the costly ones first, so that
    none of those starts when the others are done; results in order."""
    own = inheritable_thread_target(SparkSession.getActiveSession())
    first = sorted(range(len(tasks)), key=lambda i: -(costs[i] if costs else 0))
    with ThreadPool(max(1, min(parallelism, len(tasks) or 1))) as pool:
        got = dict(zip(first, pool.map(lambda t: t(), [own(tasks[i]) for i in first], chunksize=1)))
    return [got[i] for i in range(len(tasks))]


#: bytes of features that a partition of a training frame holds; a fit runs
#: several small jobs a tree, which cost per task, not per row
PARTITION_BYTES = 32 << 20


def packed(df: DataFrame, rows: int, width: int) -> DataFrame:
    """The frame in no more partitions than its size asks for, written once for
    its fits: a cached one would draw every task of every fit to the executors
    that hold its few partitions, and each job would carry its whole lineage."""
    return cut_lineage(df.coalesce(max(1, math.ceil(rows * width * 8 / PARTITION_BYTES))))


def fit(name: str, train: DataFrame, stages: Sequence[Transformer], stats: LabelStats, params: dict | None = None,
        scaled: bool = True, moments: gram.Moments | None = None) -> PipelineModel:
    """Scaler stages and the fitted model as one pipeline. A
    ``held_back`` column marks the slice for early stopping (M12). Linear
    models are solved from ``moments`` of ``FEATURES`` and the label, found
    here if not given."""
    params = dict(params or {})
    if name in LINEAR and scaled:
        m = moments or label_moments(train)
        got = gram.fit(name, m, params)
        return PipelineModel([*stages, gram.as_model(got.w, got.intercept, FEATURES, PRED)])
    patience = params.pop("patience", staged.PATIENCE)
    est = get_estimator(name, stats, **params)
    col = FEATURES if scaled else RAW
    est = est.setFeaturesCol(col)
    if name == "lightgbm" and HELD_BACK in train.columns:
        model = staged.boost_with_patience(est, train, HELD_BACK, patience)
    else:
        model = est.fit(train)
    return PipelineModel([*stages, model] if scaled else [model])


def label_moments(train: DataFrame, features: str = FEATURES) -> gram.Moments:
    """Moments of all rows of a frame."""
    return gram.moments(train.withColumn("_all", F.lit(0)), features, LABEL, "_all")[0]


def tree_count(model) -> int | None:
    """Trees of an ensemble; None for other models."""
    return int(model.getNumTrees) if hasattr(model, "getNumTrees") else None


def vector_split(vec: DataFrame, label: str, test_size: float = 0.2, held_back: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """M2 on a vector frame: (train, test); the last ``held_back`` of the
    train rows are marked for early stopping, never the test rows (Q15)."""
    d = vec.where(F.col(label).isNotNull()).withColumn(LABEL, F.col(label))

    def cuts(n: int) -> list[int]:
        cut = int(n * (1 - test_size))
        return [int(cut * (1 - held_back)), cut]
    s = sp.segment_by_position(d, cuts, col="_seg")
    return s.where(F.col("_seg") < 2).withColumn(HELD_BACK, F.col("_seg") == 1).drop("_seg"), \
        s.where(F.col("_seg") == 2).drop("_seg")


def train_grid(df: DataFrame, features: Sequence[str], labels: dict, names: Sequence[str], params: dict | None = None,
               parallelism: int = FITS_AT_ONCE) -> tuple[dict, DataFrame]:
    """Every model for every label ({tag: label column}): the
    fitted pipelines by (tag, model) and one metric row of each."""
    for label in labels.values():
        if label not in df.columns:
            raise InsufficientData(f"label {label} missing")
    vec = vectors(df, features, list(dict.fromkeys(labels.values())))
    names_, tasks, frames = [], [], []

    def prepared(tag, label):
        tr, te = vector_split(vec, label)
        stats = label_stats(tr)
        if stats.n < MIN_VALID:
            raise InsufficientData(f"{stats.n} complete rows for {label}")
        stages, _ = scaler(tr, features)
        tr = packed(PipelineModel(stages).transform(tr).select(FEATURES, LABEL, HELD_BACK), stats.n, len(features))
        return tag, tr, te, stages, stats, label_moments(tr) if LINEAR & set(names) else None

    def run(tag, name, tr, te, stages, stats, moments):
        m = fit(name, tr, stages, stats, (params or {}).get(name), moments=moments)
        ev = mx.evaluate(m.transform(te).select(F.col(LABEL).alias("y"), F.col(PRED).alias("yhat")), []) \
            .select(F.lit(tag).alias("horizon"), F.lit(name).alias("model"), "*",
                    F.lit(nonzero_count(m.stages[-1])).alias("n_nonzero"),
                    F.lit(tree_count(m.stages[-1])).cast("int").alias("n_trees"))
        return m, ev.first(), ev.schema

    frames = at_once([lambda t=t, l=l: prepared(t, l) for t, l in labels.items()], parallelism)
    for tag, *frame in frames:
        for n in names:
            names_.append((tag, n))
            tasks.append(lambda a=(tag, n, *frame): run(*a))
    got = at_once(tasks, parallelism, [cost(n, (params or {}).get(n)) for _, n in names_])
    return {k: m for k, (m, _, _) in zip(names_, got)}, \
        df.sparkSession.createDataFrame([r for _, r, _ in got], got[0][2])


def whole(features: Sequence[str], pipeline: PipelineModel) -> PipelineModel:
    """The pipeline with its assembler in front: from feature columns to
    predictions (invalid rows raise)."""
    return PipelineModel([VectorAssembler(inputCols=list(features), outputCol=RAW), *pipeline.stages])


def raw_weights(pipeline: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, coefficient per unit of the unscaled feature) of a linear pipeline."""
    cut, scale, model = pipeline.stages[-3:]
    return [(features[i], float(w) * float(s)) for i, w, s in
            zip(cut.getIndices(), model.coefficients.toArray(), scale.getScalingVec())]


def save_models(fitted: dict, path: str) -> None:
    """Every pipeline under ``path``/<model>."""
    for name, m in fitted.items():
        m.write().overwrite().save(f"{path}/{name}")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def prepare(df: DataFrame, features: Sequence[str], label: str, test_size: float = 0.2,
            scale: bool = True, keep: Sequence[str] = (), min_rows: int = MIN_ROWS,
            min_valid: int = MIN_VALID) -> tuple[DataFrame, DataFrame]:
    """P11 + M2 + A21 + M1: chronological split, population-std scaling
    fitted on train, assembled train/test frames (train persisted) behind the
    P25 guards."""
    guard(df, features, label, min_rows, min_valid)
    base = cut_lineage(df.where(F.col(label).isNotNull()).dropna(subset=list(features)))
    s = sp.chrono_split(base, test_size)
    if scale:
        s, features = scale_varying(s, s.where(F.col("split") == "train"), features)
    tr = assemble(s.where(F.col("split") == "train"), features, label, keep).persist()  # the one cache
    te = assemble(s.where(F.col("split") == "test"), features, label, keep)
    return tr, te


def scale_varying(df: DataFrame, train: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` scaled by the training rows, and the features that vary there:
    constant ones carry nothing and make the linear solvers singular."""
    params = {c: (m, s) for c, (m, s) in scl.fit_complete(train, features).items() if s > 0}
    return scl.transform(df, params), [c for c in features if c in params]


def train_and_evaluate(train: DataFrame, test: DataFrame, names: Sequence[str], params: dict | None = None,
                       keep: Sequence[str] = ()) -> tuple[dict, DataFrame]:
    """M15 on prepared frames: metrics of all models in one aggregate."""
    stats = label_stats(train)
    fitted, preds = {}, None
    for n in names:
        m = get_estimator(n, stats, **(params or {}).get(n, {})).fit(train)
        fitted[n] = m
        p = m.transform(test).select(*keep, F.lit(n).alias("model"), F.col(LABEL).alias("y"),
                                     F.col(PRED).alias("yhat"))
        preds = p if preds is None else preds.unionByName(p)
    nz = F.create_map(*[x for n, m in fitted.items() for x in (F.lit(n), F.lit(nonzero_count(m)))])
    return fitted, mx.evaluate(preds, ["model"]).withColumn("n_nonzero", nz[F.col("model")])


def nonzero_count(model) -> int:
    """Features a model uses (non-zero coefficients, or non-zero
    importances for trees)."""
    if hasattr(model, "coefficients"):
        return int(model.coefficients.numNonzeros())
    return int(model.featureImportances.numNonzeros())


def cv_runs(df: DataFrame, features: Sequence[str], label: str, runs: Sequence[tuple[str, str, dict]],
            n_splits: int = 3, scale_linear: bool = True, contiguous: bool = False,
            parallelism: int = FITS_AT_ONCE) -> DataFrame:
    """Cross-validation of runs (tag, model name, parameters); one row per tag
    with the mean and population std of its fold metrics. Folds expand over
    time, or are ``contiguous`` (train on all the others). Linear runs share
    one pass for their moments and one for their predictions, whatever the
    folds and penalties; tree runs that differ in size alone share one fit a
    fold."""
    vec = vectors(df, features, [label])
    d = vec.where(F.col(label).isNotNull()).withColumn(LABEL, F.col(label))
    folded = cut_lineage(sp.contiguous_folds(d, n_splits) if contiguous else sp.ts_folds(d, n_splits))
    fold = F.col("test_fold")
    linear = [r for r in runs if r[1] in LINEAR and scale_linear]
    shapes: dict = {}
    for tag, name, params in runs:
        if not (name in LINEAR and scale_linear):
            shape = (name, tuple(sorted((k, v) for k, v in params.items() if k != "n_estimators")))
            shapes.setdefault(shape, []).append((params.get("n_estimators"), tag))

    def prepared(k):
        tr = folded.where(fold != k if contiguous else fold < k)
        stats = label_stats(tr)
        return k, packed(tr.select(RAW, LABEL), stats.n, len(features)), folded.where(fold == k), stats

    def run(shape, sizes, k, tr, te, stats):
        name, params = shape[0], dict(shape[1])
        largest = max((n for n, _ in sizes if n), default=None)
        if any(n is None for n, _ in sizes) and largest:
            raise ValueError(f"{name}: sizes with and without a number of trees")
        m = fit(name, tr, [], stats, params | ({"n_estimators": largest} if largest else {}), scaled=False).stages[-1]
        out = None
        for n, tag in sizes:
            p = (m if n in (None, largest) else staged.prefix(m, n)).transform(te) \
                .select(F.lit(tag).alias("model"), F.lit(k).alias("test_fold"), F.col(LABEL).alias("y"), F.col(PRED).alias("yhat"))
            out = p if out is None else out.unionByName(p)
        return mx.evaluate(out, ["model", "test_fold"]).collect()  # one row per size

    rows = []
    if linear:
        per_fold = gram.moments(folded, RAW, LABEL, "test_fold")

        def trained(k):
            held = [m for f, m in per_fold.items() if (f != k if contiguous else f < k)]
            return sum(held[1:], held[0])
        models = {k: [(tag, gram.fit(name, trained(k), params)) for tag, name, params in linear] for k in range(n_splits)}
        ev = mx.evaluate(gram.predictions(folded, RAW, LABEL, "test_fold", models).withColumnRenamed("tag", "model"),
                         ["model", "test_fold"])
        rows = ev.collect()  # one row per run and fold
    if shapes:
        frames = at_once([lambda k=k: prepared(k) for k in range(n_splits)], parallelism)
        got = at_once([lambda a=(s, n, *f): run(*a) for f in frames for s, n in shapes.items()], parallelism,
                      [cost(s[0], dict(s[1]) | ({"n_estimators": max(sizes)} if (sizes := [x for x, _ in n if x]) else {}))
                       for _ in frames for s, n in shapes.items()])
        rows += [r for g in got for r in g]
    schema = "model string, test_fold int, n long, rmse double, mae double, r2 double, mape double"
    return df.sparkSession.createDataFrame(rows, schema).groupBy("model").agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"),
        F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"),
        F.avg("r2").alias("r2_mean"))


def cv_folds(df: DataFrame, features: Sequence[str], label: str, names: Sequence[str], n_splits: int = 3,
             scale_linear: bool = True, params: dict | None = None) -> DataFrame:
    """M17 + A23: expanding-window CV of the named models."""
    return cv_runs(df, features, label, [(n, n, (params or {}).get(n, {})) for n in names], n_splits, scale_linear)


def tune(df: DataFrame, features: Sequence[str], label: str, grids: dict[str, Sequence[dict]], n_splits: int = 3,
         contiguous: bool = False) -> DataFrame:
    """M18 ({model: parameter sets}); with ``contiguous`` folds M6 / M7: one row
    per model and set with its mean fold metrics, ranked within the model by
    mean R2."""
    combos = [(n, g) for n, grid in grids.items() for g in grid]
    got = cv_runs(df, features, label, [(str(i), n, g) for i, (n, g) in enumerate(combos)], n_splits,
                  contiguous=contiguous)
    names = df.sparkSession.createDataFrame([(str(i), n, str(sorted(g.items()))) for i, (n, g) in enumerate(combos)],
                                            "combo string, name string, params string")
    w = Window.partitionBy("name").orderBy(F.col("r2_mean").desc(), "combo")
    return got.withColumnRenamed("model", "combo").join(names, "combo") \
        .select(F.col("name").alias("model"), "params", "rmse_mean", "mae_mean", "r2_mean",
                F.row_number().over(w).alias("rank"))


def stack(df: DataFrame, features: Sequence[str], label: str, base_models: Sequence[str], key: Sequence[str],
          n_splits: int = 3, meta_alpha: float = 1.0, params: dict | None = None, parallelism: int = FITS_AT_ONCE) -> DataFrame:
    """Out-of-fold predictions of the base models (each fold predicted by
    models trained on earlier rows), then a ridge meta-model trained on all
    but the last fold and evaluated on it."""
    vec = vectors(df, features, [label], keep=key)
    folded = cut_lineage(sp.ts_folds(vec.where(F.col(label).isNotNull()).withColumn(LABEL, F.col(label)), n_splits))

    def prepared(k):
        tr, te = sp.fold_frame(folded, k)
        stages, _ = scaler(tr, features)
        stats = label_stats(tr)
        return packed(PipelineModel(stages).transform(tr).select(RAW, FEATURES, LABEL), stats.n, len(features)), te, stages, stats

    frames = at_once([lambda k=k: prepared(k) for k in range(n_splits)], parallelism)
    fitted = at_once([lambda a=(n, f[0], f[2], f[3]): fit(*a, (params or {}).get(a[0]), scaled=a[0] in LINEAR)
                      for f in frames for n in base_models], parallelism,
                     [cost(n, (params or {}).get(n)) for _ in frames for n in base_models])
    oof = None
    for k, (_, te, _, _) in enumerate(frames):
        out = te.withColumn("_fold", F.lit(k))
        for n, m in zip(base_models, fitted[k * len(base_models):]):
            out = m.transform(out).withColumnRenamed(PRED, f"p_{n}").select(*te.columns, "_fold", *[
                c for c in out.columns if c.startswith("p_")], f"p_{n}")
        oof = out if oof is None else oof.unionByName(out)
    oof = cut_lineage(oof.select(*key, "_fold", LABEL, *[f"p_{n}" for n in base_models]))
    meta_feats = [f"p_{n}" for n in base_models]
    mtr = assemble(oof.where(F.col("_fold") < n_splits - 1), meta_feats, LABEL)
    mte = assemble(oof.where(F.col("_fold") == n_splits - 1), meta_feats, LABEL)
    meta = ridge(meta_alpha, label_stats(mtr)).fit(mtr)
    pred = meta.transform(mte).select(F.lit("stacking").alias("model"), F.col(LABEL).alias("y"),
                                      F.col(PRED).alias("yhat"))
    return mx.evaluate(pred, ["model"])


def horizon_grid(df: DataFrame, features: Sequence[str], horizons: Sequence[int], names: Sequence[str],
                 target_fmt: str = "target_{h}h", params: dict | None = None, parallelism: int = FITS_AT_ONCE) -> DataFrame:
    """Every model for every horizon, long-form results."""
    return train_grid(df, features, {h: target_fmt.format(h=h) for h in horizons}, names, params, parallelism)[1]


def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Feature importances (trees) or absolute coefficients (linear, per std)
    of a model or pipeline: one small list, bounded by the feature count."""
    if isinstance(model, PipelineModel):
        cut = [s for s in model.stages if isinstance(s, VectorSlicer)]
        features = [features[i] for i in cut[0].getIndices()] if cut else features
        model = model.stages[-1]
    if hasattr(model, "featureImportances"):
        v = model.featureImportances.toArray()
    else:
        v = [abs(x) for x in model.coefficients.toArray()]
    return list(zip(features, [float(x) for x in v]))
