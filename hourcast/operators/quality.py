"""Single-pass data-quality profile.

Every per-column statistic is an aggregate expression, so one ``agg`` over
the frame yields all of them (partial aggregation on the executors, one row
to the driver); ``stack`` then turns the wide result into long form.

Exact quantiles come from radix selection over histograms of fixed size
(:func:`order_statistics`): no task holds a column's values and none are
shuffled. ``exact=False`` uses the ``percentile_approx`` sketch instead.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourcast.operators.features import NUMERIC, Series
from hourcast.operators.halo import skew_safe
from hourcast.session import cut_lineage

# Validated ranges (min, max, unit)
VALID_RANGES = {
    "temp": (-50, 60, "°C"),
    "humidity": (0, 100, "%"),
    "pressure": (900, 1100, "hPa"),
    "wind_speed": (0, 100, "m/s"),
    "aqi": (1, 5, "index"),
    "pm2_5": (0, 1000, "µg/m³"),
    "pm10": (0, 1000, "µg/m³"),
    "visibility": (0, 50000, "m"),
}
DESCRIBE_COLS = ["temp", "humidity", "pressure", "wind_speed", "pm2_5", "pm10", "aqi", "co", "no2", "visibility"]
CORR_FEATURES = ["temp", "humidity", "pressure", "wind_speed", "visibility", "pm10", "no2", "co", "o3"]


def _stack(df: DataFrame, names: Sequence[str], fields: Sequence[str], name_col: str = "column") -> DataFrame:
    """Wide one-row result with ``{name}__{field}`` columns -> long rows."""
    items = [F.struct(F.lit(n).alias(name_col), *[F.col(f"{n}__{f}").alias(f) for f in fields]) for n in names]
    return df.select(F.explode(F.array(*items)).alias("_s")).select("_s.*")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count and percentage per column, one pass."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs.append((F.count(F.lit(1)) - F.count(F.col(c))).alias(f"{c}__nulls"))
    wide = df.agg(*aggs)
    for c in cols:
        wide = wide.withColumn(f"{c}__pct", F.col(f"{c}__nulls") * F.lit(100.0) / F.col("_n"))
    return _stack(wide, cols, ["nulls", "pct"])


#: bits that a selection pass fixes
DIGIT = 16


def _image(v: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order."""
    u = v.view(np.uint64)
    return np.where(u >> np.uint64(63) == 1, ~u, u | np.uint64(1 << 63))


def _double(image: int) -> float:
    u = image ^ (1 << 63) if image >> 63 else ~image & (1 << 64) - 1
    return float(np.array([u], np.uint64).view(np.float64)[0])


def _digit_counts(known: dict[int, list[int]], shift: int):
    """Counts of the next digit of the values under each known prefix, per
    column: at most 2^DIGIT rows of a task per prefix, however many values."""
    def run(batches):
        import pyarrow as pa
        held = {(c, p): np.zeros(1 << DIGIT, np.int64) for c, ps in known.items() for p in ps}
        for b in batches:
            for c, ps in known.items():
                image = _image(b.column(c).drop_null().to_numpy(zero_copy_only=False))
                top = image >> np.uint64(shift + DIGIT) if shift + DIGIT < 64 else np.zeros(len(image), np.uint64)
                for p in ps:
                    digit = image[top == np.uint64(p)] >> np.uint64(shift) & np.uint64((1 << DIGIT) - 1)
                    held[c, p] += np.bincount(digit.astype(np.int64), minlength=1 << DIGIT)
        for (c, p), n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c), pa.int32()), pa.array(np.full(len(at), p), pa.int64()),
                                              pa.array(at, pa.int32()), pa.array(n[at])], names=["c", "p", "d", "n"])
    return run


def order_statistics(df: DataFrame, ranks: dict[int, Sequence[int]]) -> dict[tuple[int, int], float]:
    """Exact values by (column number, 0-based rank) of a frame of doubles,
    NULLs left out, by radix selection: doubles as integers of the same order
    are narrowed down 16 bits a pass, for all columns and ranks at once. Four
    passes over the rows, whatever the values; what is shuffled is counts of
    digits, and the driver gets one row per rank and pass."""
    state = {(c, r): (0, r) for c, rs in ranks.items() for r in rs}  # -> (prefix, rank under it)
    for shift in range(64 - DIGIT, -1, -DIGIT):
        known = {c: sorted({p for (k, _), (p, _) in state.items() if k == c}) for c in ranks if ranks[c]}
        counts = df.mapInArrow(_digit_counts(known, shift), "c int, p long, d int, n long") \
            .groupBy("c", "p", "d").agg(F.sum("n").alias("n"))
        hits = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(p).cast("long").alias("p"), F.lit(k).cast("long").alias("k"))
                         for c, p, k in sorted({(c, p, k) for (c, _), (p, k) in state.items()})])
        end = F.sum("n").over(Window.partitionBy("c", "p").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("e", end).select("d", (F.col("e") - F.col("n")).alias("s"), F.explode(F.filter(
            hits, lambda h: (h["c"] == F.col("c")) & (h["p"] == F.col("p")) & (h["k"] >= F.col("e") - F.col("n"))
            & (h["k"] < F.col("e")))).alias("h")).select("d", "s", "h.*").collect()     # one per rank
        step = {(r["c"], r["p"], r["k"]): (r["p"] << DIGIT | r["d"], r["k"] - r["s"]) for r in found}
        state = {(c, r): step[c, p, k] for (c, r), (p, k) in state.items()}
        if shift:  # the next pass's prefixes travel as signed numbers of under 64 bits
            assert all(p < 1 << 63 for p, _ in state.values())
    return {key: _double(image) for key, (image, _) in state.items()}


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> dict[str, list]:
    """Exact, linearly interpolated quantiles of the non-NULL values of each
    column (doubles; None where there are none), by ``order_statistics``."""
    cols = list(cols)
    u = cut_lineage(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]))
    size = dict(enumerate(u.agg(*[F.count(f"c{i}") for i in range(len(cols))]).first()))
    ranks = {c: sorted({r for q in probs for r in (math.floor((n - 1) * q), math.ceil((n - 1) * q))}) for c, n in size.items() if n}
    value = order_statistics(u, ranks) if ranks else {}
    out = {}
    for i, c in enumerate(cols):
        out[c] = [None] * len(probs)
        for j, q in enumerate(probs if size[i] else ()):
            at_ = (size[i] - 1) * q
            lo, hi = math.floor(at_), math.ceil(at_)
            a, b = value[i, lo], value[i, hi]
            out[c][j] = a if lo == hi or a == b else (hi - at_) * a + (at_ - lo) * b
    return out


def describe(df: DataFrame, cols: Sequence[str] | None = None, digits: int | None = 2, exact: bool = True,
             decimals: int | None = None) -> DataFrame:
    """Count, mean, std (sample), min, 25/50/75 % (linear), max.

    ``decimals``: fixed-point inputs; mean, std and quartiles are computed on
    exact integers (independent of summation order)."""
    cols = [c for c in (cols or DESCRIBE_COLS) if c in df.columns]
    aggs, probs = [], [0.25, 0.5, 0.75]
    if exact:
        whole = df if decimals is None else df.select(*[F.round(F.col(c).cast("double") * F.lit(float(10 ** decimals)))
                                                        .alias(c) for c in cols])
        exact_q = quantiles(whole, cols, probs)
    for c in cols:
        x = F.col(c).cast("double")
        if decimals is None:
            v, scale = x, None
            mean, std = F.avg(x), F.stddev_samp(x)
        else:
            scale = float(10 ** decimals)
            v = F.round(x * F.lit(scale)).cast("long")
            # n * sum of squares outgrows bigint near 40,000 rows of pressures
            d = v.cast("decimal(18,0)")
            n, s1, s2 = F.count(v), F.sum(d).cast("decimal(38,0)"), F.sum(d * d).cast("decimal(38,0)")
            mean = s1.cast("double") / (F.lit(scale) * n)
            std = F.when(n > 1, F.sqrt((n.cast("decimal(38,0)") * s2 - s1 * s1).cast("double")
                                       / (F.lit(scale * scale) * n * (n - F.lit(1)))))
        q = F.array(*[F.lit(e).cast("double") for e in exact_q[c]]) if exact else F.percentile_approx(v, probs, 100000)
        aggs += [F.count(x).alias(f"{c}__count"), mean.alias(f"{c}__mean"), std.alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"),
                 (F.transform(q, lambda e: e.cast("double") / F.lit(scale)) if scale else q).alias(f"{c}__q"),
                 F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    rnd = (lambda e: F.round(e, digits)) if digits is not None else (lambda e: e)
    sel = []
    for c in cols:
        sel += [F.col(f"{c}__count"), *[rnd(F.col(f"{c}__{s}")).alias(f"{c}__{s}") for s in ("mean", "std", "min")],
                *[rnd(F.col(f"{c}__q")[i]).alias(f"{c}__{n}") for i, n in enumerate(("p25", "p50", "p75"))],
                rnd(F.col(f"{c}__max")).alias(f"{c}__max")]
    return _stack(wide.select(*sel), cols, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"])


def range_check(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    """Per validated column: rows below/above range, min, max."""
    ranges = {c: r for c, r in (ranges or VALID_RANGES).items() if c in df.columns}
    aggs = []
    for c, (lo, hi, _) in ranges.items():
        x = F.col(c)
        aggs += [F.count(F.when(x < F.lit(lo), 1)).alias(f"{c}__below"),
                 F.count(F.when(x > F.lit(hi), 1)).alias(f"{c}__above"),
                 F.min(x).cast("double").alias(f"{c}__min"), F.max(x).cast("double").alias(f"{c}__max")]
    return _stack(df.agg(*aggs), list(ranges), ["below", "above", "min", "max"])


def duplicate_keys(df: DataFrame, key: str = "unix_time", by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first per key (a NULL key counts as one value)."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("\u0000null"))
    return df.groupBy(*by).agg((F.count(F.lit(1)) - F.countDistinct(k)).alias("duplicates"))


def coverage(df: DataFrame, ts: str = "timestamp", by: Sequence[str] = ("city",)) -> DataFrame:
    """Time range, days covered (+1), expected hourly rows, coverage %."""
    g = df.groupBy(*by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                            F.count(F.lit(1)).alias("records"))
    days = (F.floor((F.unix_seconds(F.col("last_ts").cast("timestamp"))
                     - F.unix_seconds(F.col("first_ts").cast("timestamp"))) / F.lit(86400)) + F.lit(1)).cast("long")
    return g.select(*by, "first_ts", "last_ts", "records", days.alias("days"),
                    (days * 24).alias("expected"),
                    (F.col("records") / (days * 24) * F.lit(100.0)).alias("coverage_pct"))


def gaps(df: DataFrame, unix: str = "unix_time", keys: Sequence[str] = ("city",), step: int = 3600) -> DataFrame:
    """W10 + A17: consecutive-row gaps: =, > and < the step; max and mean of
    the large ones in hours."""
    d = skew_safe(df.select(*keys, unix), lambda f, s: f.select(
        *keys, "_core", (F.col(unix) - F.lag(unix, 1).over(s.window())).alias("_gap")),
        Series(tuple(keys), (unix,)), 1, 0, [F.floor(F.col(unix) / F.lit(86400))]).where(F.col("_gap").isNotNull())
    big = F.when(F.col("_gap") > step, F.col("_gap"))
    return d.groupBy(*keys).agg(
        F.count(F.when(F.col("_gap") == step, 1)).alias("normal"),
        F.count(big).alias("larger"),
        F.count(F.when(F.col("_gap") < step, 1)).alias("smaller"),
        (F.max(big) / F.lit(3600.0)).alias("max_gap_h"),
        (F.avg(big) / F.lit(3600.0)).alias("mean_gap_h"))


def pearson(a: str, b: str) -> Column:
    """Correlation aggregate over the rows with both values; NaN where one does
    not vary over them (there ``F.corr`` divides by zero, an error under ANSI)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(flat, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def corr_with(df: DataFrame, target: str, features: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Pearson correlation of each feature with the target
    (pairwise-complete), long form; NaN where one of the two does not vary
    over the pairs, NULL without any pair."""
    feats = [c for c in (features or CORR_FEATURES) if c in df.columns and c != target]
    wide = df.agg(*[F.round(pearson(c, target), digits).alias(f"{c}__corr") for c in feats])
    return _stack(wide, feats, ["corr"], "feature")


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, s, q, xy): for every ordered pair of columns the rows where
    both are present, and over those the sum of column i, of its squares, and
    of the products. One pass: a task turns its rows into matrix products,
    and one row per pair of it is shuffled. Columns are shifted by a value of
    their own, which keeps large offsets from eating the digits."""
    src = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    one = src.agg(*[F.any_value(f"c{i}", F.lit(True)) for i in range(len(cols))]).first()
    shift = np.array([0.0 if v is None else v for v in one])

    def run(batches):
        import pyarrow as pa
        total = np.zeros((4, len(shift), len(shift)))
        for b in batches:
            ok = np.column_stack([np.asarray(x.is_valid()) for x in b.columns]).astype(np.float64)
            v = (np.column_stack([x.fill_null(0.0).to_numpy(zero_copy_only=False) for x in b.columns]) - shift) * ok
            total += [ok.T @ ok, v.T @ ok, (v * v).T @ ok, v.T @ v]
        i, j = (x.ravel() for x in np.indices(total.shape[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t.ravel()) for t in total]],
                                         names=["i", "j", "n", "s", "q", "xy"])

    return src.mapInArrow(run, "i int, j int, n double, s double, q double, xy double") \
        .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "xy")])


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Every pair (a, b) of the numeric columns (all by default),
    pairwise-complete, from one pass of moments; NULL where a column does not
    vary over the pair's rows, or no row has both."""
    cols = list(cols or [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")])
    m = cut_lineage(pair_moments(df, cols))  # a row per pair
    t = m.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    name = F.array(*[F.lit(c) for c in cols])
    vx, vy = F.col("n") * F.col("q") - F.col("s") * F.col("s"), F.col("n") * F.col("q2") - F.col("s2") * F.col("s2")
    flat = (vx <= F.lit(1e-12) * F.col("n") * F.col("q")) | (vy <= F.lit(1e-12) * F.col("n") * F.col("q2"))
    corr = F.when(flat, None).otherwise((F.col("n") * F.col("xy") - F.col("s") * F.col("s2")) / (F.sqrt(vx) * F.sqrt(vy)))
    return m.join(t, ["i", "j"]).select(name[F.col("i")].alias("a"), name[F.col("j")].alias("b"), F.round(corr, digits).alias("corr"))


def boxplot(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Quartiles, IQR, whiskers (most extreme values within 1.5 IQR) and
    outlier count per column. Two aggregate passes: the quartiles come back
    to the driver as one metric row and become literals of the second."""
    q = quantiles(df, cols)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        q1, med, q3 = q[c]
        if q1 is None:
            lo = hi = F.lit(None).cast("double")
        else:
            iqr = q3 - q1
            lo, hi = F.lit(q1 - 1.5 * iqr), F.lit(q3 + 1.5 * iqr)
        aggs += [F.lit(q1).cast("double").alias(f"{c}__q1"), F.lit(med).cast("double").alias(f"{c}__median"),
                 F.lit(q3).cast("double").alias(f"{c}__q3"),
                 F.min(F.when(x >= lo, x)).alias(f"{c}__whisker_lo"), F.max(F.when(x <= hi, x)).alias(f"{c}__whisker_hi"),
                 F.count(F.when((x < lo) | (x > hi), 1)).alias(f"{c}__outliers")]
    wide = df.agg(*aggs)
    out = _stack(wide, cols, ["q1", "median", "q3", "whisker_lo", "whisker_hi", "outliers"])
    return out.select("column", *[F.round(c, digits).alias(c) for c in ("q1", "median", "q3", "whisker_lo",
                                                                       "whisker_hi")], "outliers")


def shape_stats(df: DataFrame, col: str, keys: Sequence[str] = ("city",), order: str = "timestamp",
                digits: int = 6) -> DataFrame:
    """Lag-1 autocorrelation and (bias-adjusted) skewness per key."""
    x = skew_safe(df.select(*keys, order, col), lambda f, s: f.select(
        *keys, "_core", F.col(col).alias("_x"), F.lag(col, 1).over(s.window()).alias("_l")),
        Series(tuple(keys), (order,)), 1, 0, [F.date_trunc("day", F.col(order))])
    n = F.count("_x")
    g1 = F.skewness("_x")
    adj = g1 * F.sqrt(n * (n - F.lit(1))) / (n - F.lit(2))
    return x.groupBy(*keys).agg(F.round(pearson("_x", "_l"), digits).alias("autocorr_lag1"),
                                F.round(F.when(n > 2, adj), digits).alias("skew"))


def status_by_city(data: DataFrame, cities: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Per configured city: has data?, records, first/last timestamp.
    ``cities`` is the (small) city dimension, so it drives a right join."""
    g = data.groupBy("city").agg(F.count(F.lit(1)).alias("records"), F.min(ts).alias("first_ts"),
                                 F.max(ts).alias("last_ts"))
    j = g.join(cities.select("city"), on="city", how="right")
    return j.select("city", (F.coalesce(F.col("records"), F.lit(0)) > 0).alias("exists"),
                    F.coalesce(F.col("records"), F.lit(0)).alias("records"), "first_ts", "last_ts")


def top_by_corr(df: DataFrame, target: str, features: Sequence[str], k: int = 50, digits: int = 6) -> DataFrame:
    """T5 + W16: the ``k`` features with the largest absolute correlation to
    ``target`` (ties by name); constant features (NULL/NaN correlation) are
    left out. One aggregate over the frame, then a rank over the feature list."""
    feats = [f for f in features if f in df.columns and f != target]
    # long form (feature, x, y): a compact plan of three aggregates grouped by
    # feature name, combined map-side to one row per feature and partition
    long = df.select(F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in feats]) \
        .unpivot("_y", feats, "feature", "_x")
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    x, y = F.when(both, F.col("_x")), F.when(both, F.col("_y"))
    corr = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    c = long.groupBy("feature").agg(F.round(corr, digits).alias("corr")) \
        .where(F.col("corr").isNotNull() & ~F.isnan("corr"))
    w = Window.orderBy(F.abs("corr").desc(), F.col("feature"))       # one row per feature
    return c.select("feature", "corr", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
