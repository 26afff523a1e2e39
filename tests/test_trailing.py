"""Per-city state gives the features of the sorted series, in bounded space."""

import datetime as dt
import os
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from hourcast.operators import features as fx
from hourcast.streaming import jobs, trailing

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "city string, timestamp timestamp_ntz, v double"


def _land(spark, rows, folder, files):
    """Rows in order of arrival, cut into files that arrive one after another."""
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(folder)
        for n in os.listdir(folder):
            p = os.path.join(folder, n)
            if n.endswith(".parquet") and os.path.getmtime(p) > 1_800_000_000 - 1:
                os.utime(p, (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))


def _run(spark, rows, where, delay, files=4, spec=None):
    _land(spark, rows, f"{where}/in", files)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    jobs.run_to_table(trailing.trailing_features(stream, "v", spec, delay), f"{where}/out")
    return spark.read.parquet(f"{where}/out")


def _want(spark, rows, spec, until):
    df = spark.createDataFrame(rows, SCHEMA)
    w = Window.partitionBy("city").orderBy("timestamp")
    s = fx.Series()
    cols = [*fx.lag_columns(s.window(), ["v"], spec.lags), *fx.rolling_columns(w, ["v"], spec.windows, ("mean", "min", "max"), None)]
    return df.select("city", "timestamp", "v", *cols).where(F.col("timestamp") <= F.lit(until))


def _rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_out_of_order_rows_give_the_features_of_the_sorted_series(spark, tmpdir_path):
    r = random.Random(3)
    rows = [("a", T0 + dt.timedelta(hours=i), None if i % 11 == 4 else float(i * 7 % 13)) for i in range(120)]
    rows += [("b", T0 + dt.timedelta(hours=i), float(i % 5)) for i in range(0, 120, 2)]
    rows.sort(key=lambda x: (x[1] - T0).total_seconds() / 3600 + r.uniform(0, 9))  # up to 9 hours late
    spec = trailing.Trailing(lags=(1, 3, 24), windows=(3, 12))
    got = _run(spark, rows, tmpdir_path, "10 hours", spec=spec)
    until = max(t for _, t, _ in rows) - dt.timedelta(hours=10)
    want = _want(spark, rows, spec, until)
    assert _rows(got.select(*want.columns)) == _rows(want)
    assert got.agg(F.max("buffered")).first()[0] == spec.back == 24  # the state does not grow with the series


def test_a_repeated_hour_counts_once_and_a_late_one_is_dropped(spark, tmpdir_path):
    rows = [("a", T0 + dt.timedelta(hours=i), float(i)) for i in range(30)]
    late = ("a", T0 + dt.timedelta(hours=2), 99.0)
    stream = rows[:15] + [rows[14]] + rows[15:] + [late, ("a", T0 + dt.timedelta(hours=30), 30.0)]
    spec = trailing.Trailing(lags=(1,), windows=(2,))
    got = _run(spark, stream, tmpdir_path, "1 hour", files=3, spec=spec).orderBy("timestamp").collect()
    assert [r.v for r in got] == [float(i) for i in range(len(got))] and len(got) >= 28
    assert [r.v_lag_1h for r in got] == [None] + [float(i) for i in range(len(got) - 1)]
