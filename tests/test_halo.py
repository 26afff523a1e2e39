"""Halo-blocked windows (§4.3.2): per-(key, block) results equal the plain
per-key window results, including forward fill across long NULL runs that
cover a block boundary and its halo, and leads that cross blocks."""

import datetime as dt

from pyspark.sql import functions as F

from hourcast.operators import features as fx
from hourcast.operators import halo


def skewed_frame(spark):
    """One hot key (400 rows) and two small ones; aqi NULL on rows 60..170 of
    the hot key (spans the blocks 80/160 and both halos) and on every 7th row."""
    sizes = {"hot": 400, "mid": 30, "tiny": 3}
    parts = [spark.range(n).withColumn("city", F.lit(c)) for c, n in sizes.items()]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    nul = ((F.col("city") == "hot") & F.col("id").between(60, 170)) | (F.col("id") % 7 == 3)
    return df.select(
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id"))).alias("timestamp"),
        "city", "id",
        F.when(nul, F.lit(None)).otherwise(F.lit(20) + (F.rand(3) * 200).cast("int")).cast("int").alias("aqi"))


def _rows(df):
    return sorted((tuple(repr(v) for v in r) for r in df.select(sorted(df.columns)).collect()))


def test_blocked_equals_plain_preset_b(spark):
    df = skewed_frame(spark).cache()
    p = fx.PresetB()
    back, fwd = max(max(p.lags), max(p.windows) - 1, max(p.periods)), max(p.horizons)
    plain = fx.features_b(df, decimals=0)

    def build(frame, s):
        return fx.features_b(frame, series=s, decimals=0)

    buckets = [F.date_trunc("day", F.col("timestamp"))]
    blocked = halo.blocked(df, build, fx.Series(), back, fwd, buckets, pad_cols=["aqi"], block_rows=80)
    assert blocked.columns == plain.columns
    assert _rows(blocked) == _rows(plain)
    df.unpersist()


def test_positions_dense_per_key(spark):
    df = skewed_frame(spark)
    s = fx.Series()
    lay = halo.layout(df, s, [F.date_trunc("day", F.col("timestamp"))])
    assert (lay.keys, lay.rows, lay.max_key_rows) == (3, 433, 400)
    pos = halo.positions(df, s, [F.date_trunc("day", F.col("timestamp"))], lay)
    got = {(r["city"], r["id"]): r["_pos"] for r in pos.collect()}
    assert all(got[k] == k[1] for k in got)            # ids are 0..n-1 in time order


def test_carry_crosses_empty_blocks(spark):
    """A whole block of NULLs: the carried value comes from two blocks back."""
    df = spark.range(60).select(
        F.lit("x").alias("city"), "id",
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id"))).alias("timestamp"),
        F.when(F.col("id").between(5, 45), F.lit(None)).otherwise(F.col("id") + 1).cast("double").alias("v"))
    s = fx.Series()
    plain = fx.with_pct_change(df, s, ["v"], [1, 3])

    def build(frame, s2):
        return fx.with_pct_change(frame, s2, ["v"], [1, 3])

    out = halo.blocked(df, build, s, 3, 0, [F.col("timestamp")], pad_cols=["v"], block_rows=10)
    assert _rows(out) == _rows(plain)


def test_skew_safe_small_keys_plain(spark):
    df = skewed_frame(spark)

    def build(frame, s):
        return fx.features_b(frame, series=s, decimals=0)

    out = halo.skew_safe(df, build, fx.Series(), 24, 72, [F.date_trunc("day", F.col("timestamp"))],
                         pad_cols=["aqi"], block_rows=1000)
    assert "_core" not in out.columns
    assert _rows(out) == _rows(fx.features_b(df, decimals=0))


def test_skew_safe_auto_hot_key_equals_plain(spark):
    """Automatic choice (no block size given): the hot key exceeds a fair task
    share, so the blocked plan runs; results equal the plain windows."""
    df = skewed_frame(spark)

    def build(frame, s):
        return fx.features_b(frame, series=s, decimals=0)

    out = halo.skew_safe(df, build, fx.Series(), 24, 72, [F.date_trunc("day", F.col("timestamp"))],
                         pad_cols=["aqi"], floor=1)
    assert _rows(out) == _rows(fx.features_b(df, decimals=0))
