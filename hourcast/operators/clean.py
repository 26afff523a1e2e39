"""Cleaning, imputation and gap filling.

All fills are column expressions in one projection; gap filling uses
windows over the key's series (forward fill) or a generated hourly grid.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourcast.functions.scalars import visibility_repair_estimate

# Fixed defaults of the scoring-row preparation
CORE = ("temp", "humidity", "pressure", "wind_speed", "wind_deg", "feels_like", "clouds",
        "visibility", "dew_point", "uvi")
ABSENT_DEFAULT = {"visibility": 10000.0, "clouds": 0.0, "uvi": 5.0}
FROM_TEMPERATURE = {"dew_point": 15.0, "feels_like": 25.0}  # copy temperature, else this
FILL_DEFAULT = {"temp": 25.0, "humidity": 50.0, "pressure": 1013.0, "wind_speed": 2.0, "wind_deg": 0.0}


def _to_double(x: Column, dtype: str | None) -> Column:
    if dtype is None or dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") \
            or dtype.startswith("decimal"):
        return x.cast("double")
    return F.try_cast(x.cast("string"), "double")  # text -> number, bad text -> NULL


def prepare_scoring_columns(df: DataFrame, core: Sequence[str] = CORE) -> DataFrame:
    """Fallbacks for absent columns (visibility 10000, clouds 0, uvi 5,
    dew_point/feels_like copied from ``temperature`` else 15/25), rename
    ``temperature`` -> ``temp``, other absent core columns 0, coerce to
    double, fill NULLs (temp 25, humidity 50, pressure 1013, wind_speed 2,
    wind_deg 0, others 0)."""
    types = dict(df.dtypes)
    src = {c: (F.col(c), types[c]) for c in df.columns}
    for c, v in ABSENT_DEFAULT.items():
        if c not in types:
            src[c] = (F.lit(v), None)
    for c, v in FROM_TEMPERATURE.items():
        if c not in types:
            src[c] = src["temperature"] if "temperature" in types else (F.lit(v), None)
    if "temperature" in types and "temp" not in types:
        src["temp"] = src.pop("temperature")
    out = []
    for c in core:
        x, t = src.get(c, (F.lit(0.0), None))
        out.append(F.coalesce(_to_double(x, t), F.lit(FILL_DEFAULT.get(c, 0.0))).alias(c))
    keep = [F.col(c) for c in df.columns if c not in core and not (c == "temperature" and "temp" in src
                                                                   and "temperature" not in src)]
    return df.select(*keep, *out)


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL -> 0 over the numeric columns."""
    return df.fillna(0, subset=list(cols) if cols else None)


def align_features(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Expected features in order; missing ones as 0.0, extras dropped."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(c).cast("double").alias(c) if c in have else F.lit(0.0).alias(c)
                              for c in expected])


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in ``subset`` (all columns if None)."""
    return df.dropna(subset=list(subset) if subset else None)


def finite(c: str) -> Column:
    """NaN and +-inf -> NULL."""
    x = F.col(c)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x).alias(c)


def bools_to_int(df: DataFrame) -> DataFrame:
    """P20: every boolean column as 0/1."""
    return df.select(*[F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])


def repair_visibility(df: DataFrame) -> DataFrame:
    """P21 + F10: fill NULL visibility from humidity, clouds and PM2.5."""
    have = set(df.columns)
    est = visibility_repair_estimate(
        F.col("humidity") if "humidity" in have else F.lit(None),
        F.col("clouds") if "clouds" in have else F.lit(None),
        F.col("pm2_5") if "pm2_5" in have else F.lit(None))
    return df.withColumn("visibility", F.coalesce(F.col("visibility"), est.cast("double")))


# P23 on blocks: a series is cut by time (``bucket``), a row per block says
# what the blocks before it end with and those behind it begin with, and each
# block is filled from its own rows and these two. Only the block table has a
# window over a whole key.
_BUCKET, _PAIR, _BEFORE, _AFTER = "_bucket", "_pair_{col}", "_before_{col}", "_after_{col}"


def _carried(df: DataFrame, cols: Sequence[str], keys: Sequence[str], order: Column) -> DataFrame:
    """Rows of a frame with ``_bucket`` and the pairs of ``cols``, joined with
    the last pair before their block and the first one behind it."""
    pairs = [_PAIR.format(col=c) for c in cols]
    ends = df.groupBy(*keys, _BUCKET).agg(
        *[F.max_by(p, F.when(F.col(p).isNotNull(), order)).alias(f"_last{p}") for p in pairs],
        *[F.min_by(p, F.when(F.col(p).isNotNull(), order)).alias(f"_first{p}") for p in pairs])
    past = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy(*keys).orderBy(F.col(_BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_k{i}" for i in range(len(keys) + 1)]
    edges = ends.select(*[F.col(k).alias(n) for k, n in zip([*keys, _BUCKET], names)],
                        *[F.last(f"_last{p}", ignorenulls=True).over(past).alias(_BEFORE.format(col=c)) for p, c in zip(pairs, cols)],
                        *[F.last(f"_first{p}", ignorenulls=True).over(rest).alias(_AFTER.format(col=c)) for p, c in zip(pairs, cols)])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip([*keys, _BUCKET], names)])
    return df.join(edges, same).drop(*names)


def _with_pairs(df: DataFrame, cols: Sequence[str], pos: Column, bucket: Column) -> DataFrame:
    return df.select("*", bucket.alias(_BUCKET), *[
        F.when(F.col(c).isNotNull(), F.struct(pos.alias("p"), F.col(c).alias("v"))).alias(_PAIR.format(col=c)) for c in cols])


def _is_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: bool | None) -> bool:
    if blocks is None:
        from hourcast.operators.features import Series
        from hourcast.operators.halo import is_hot
        blocks = is_hot(df, Series(tuple(keys), tuple(order)), 0)[0]
    return blocks


def forward_fill(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("city",), order: Sequence[str] = ("timestamp",),
                 bucket: Column | None = None, blocks: bool | None = None) -> DataFrame:
    """Last non-NULL value so far within the key's series. A key larger
    than a task's fair share is filled in blocks (``blocks`` says so instead of
    the counts); ``bucket`` orders like the first order column and is a day of
    it by default."""
    cols = [c for c in df.columns if c in cols]
    split = _is_split(df, keys, order, blocks)
    src, by = df, list(keys)
    if split:
        bucket = F.date_trunc("day", F.col(order[0])) if bucket is None else bucket
        src = _carried(_with_pairs(df, cols, F.lit(0), bucket), cols, keys, F.struct(*[F.col(o) for o in order]))
        by = [*keys, _BUCKET]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def filled(c):
        v = F.last(c, ignorenulls=True).over(w)
        return (F.coalesce(v, F.col(_BEFORE.format(col=c))["v"]) if split else v).alias(c)
    return src.select(*[filled(c) if c in cols else F.col(c) for c in df.columns])


def linear_fill(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("city",), order: str = "timestamp",
                pos: str = "unix_time", bucket: Column | None = None, blocks: bool | None = None) -> DataFrame:
    """P23 linear: interpolate between the previous and next non-NULL values,
    weighted by ``pos`` (e.g. epoch seconds); ends stay NULL. Blocks as in
    ``forward_fill``, with what lies on both sides of them."""
    cols = [c for c in df.columns if c in cols]
    split = _is_split(df, keys, [order], blocks)
    bucket = F.date_trunc("day", F.col(order)) if bucket is None else bucket
    src, by = _with_pairs(df, cols, F.col(pos), bucket), list(keys)
    if split:
        src, by = _carried(src, cols, keys, F.col(order)), [*keys, _BUCKET]
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # "next non-NULL" as a running frame over the reversed order: Spark
    # evaluates running frames incrementally, while a frame ending at
    # UNBOUNDED FOLLOWING is recomputed for every row (quadratic per key).
    after = Window.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(F.col(c))
            continue
        pair = _PAIR.format(col=c)
        pv, nx = F.last(pair, ignorenulls=True).over(before), F.last(pair, ignorenulls=True).over(after)
        if split:
            pv, nx = F.coalesce(pv, F.col(_BEFORE.format(col=c))), F.coalesce(nx, F.col(_AFTER.format(col=c)))
        span = (nx["p"] - pv["p"]).cast("double")
        interp = pv["v"] + (nx["v"] - pv["v"]) * F.try_divide((F.col(pos) - pv["p"]).cast("double"), span)
        out.append(F.coalesce(F.col(c), interp).alias(c))
    return src.select(*out)


def hourly_grid(df: DataFrame, keys: Sequence[str] = ("city",), ts: str = "timestamp") -> DataFrame:
    """Every hour between each key's first and last timestamp, left
    joined with the data (missing hours -> NULL values)."""
    bounds = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    grid = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 HOUR"))).alias(ts))
    return grid.join(df, on=[*keys, ts], how="left")


# P16 / P17 ---------------------------------------------------------------------
def fold_map(df: DataFrame, fixed: Sequence[str], col: str = "features") -> DataFrame:
    """Non-fixed numeric columns folded into a map<string,double>;
    NaN -> NULL."""
    rest = [c for c, t in df.dtypes if c not in fixed and t in ("double", "float", "int", "bigint")]
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in rest]),
                          F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in rest]))
    return df.select(*fixed, m.alias(col))


def unfold_map(df: DataFrame, keys: Sequence[str], col: str = "features",
               drop: Sequence[str] = ("id", "created_at")) -> DataFrame:
    """Map entries ``keys`` back to columns; on a name clash with a
    fixed column the map entry wins when present."""
    std = [c for c in df.columns if c != col and c not in drop]
    m = F.col(col)
    out = [F.coalesce(F.try_element_at(m, F.lit(c)), F.col(c)).alias(c) if c in keys else F.col(c) for c in std]
    out += [F.try_element_at(m, F.lit(k)).alias(k) for k in keys if k not in std]
    return df.select(*out)
