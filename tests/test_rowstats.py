"""Lags and rolling statistics by Arrow batches equal the window plan."""

import pytest
from pyspark.sql import functions as F

from hourcast.operators import features as fx
from hourcast.operators import halo
from hourcast.operators import rowstats as rs

LAGS, WINDOWS = (1, 3, 40), (1, 2, 6, 25)


def _frame(spark):
    """Keys of 1 to 300 rows, a NULL one among them, equal order values told
    apart by ``id``, and NULL values on runs longer than a window."""
    return spark.range(700).select(
        F.expr("CASE WHEN id < 300 THEN 'a' WHEN id < 420 THEN NULL WHEN id < 421 THEN 'one' ELSE concat('k', id % 9) END").alias("key"),
        F.expr("id div 3").alias("t"), "id",
        F.expr("CASE WHEN id BETWEEN 50 AND 90 OR id % 7 = 3 THEN NULL ELSE round((id * 7919 % 10007) / 100.0D, 2) END").alias("x"),
        F.expr("round(((id * 104729) % 1000003) * 12345.67D, 2) - 5e9D").alias("big")).repartition(5)


def _rows(df):
    return sorted(tuple(repr(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("min_periods", [1, None])
def test_equals_the_window_plan(spark, min_periods):
    df, s, cols = _frame(spark), fx.Series(("key",), ("t", "id")), ["x", "big"]
    plain = fx.with_rolling(df, s, cols, WINDOWS, fx.STATS, min_periods, 2, keep=["key", "id"],
                            extra=fx.lag_columns(s.window(), cols, LAGS))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # fewer than a lag looks back
    try:
        got = rs.lags_and_rolling(df, s, cols, LAGS, WINDOWS, fx.STATS, min_periods, 2, keep=["key", "id"])
        assert got.columns == plain.columns and [f.dataType for f in got.schema] == [f.dataType for f in plain.schema]
        assert _rows(got) == _rows(plain)
        some = rs.lags_and_rolling(df.withColumn("own", F.col("id") % 5 == 0), s, cols, LAGS, WINDOWS, fx.STATS, min_periods, 2,
                                   keep=["key", "id"], only="own")
        assert _rows(some) == _rows(plain.where("id % 5 = 0"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_long_series_return_no_helper_columns(spark, tmp_path):
    """The queries' own build: blocked equals plain, and no projection of all columns follows the batches."""
    from hourcast.plans import q_features as qf
    spark.range(900).selectExpr(
        "id AS l_orderkey", "id % 50 AS l_partkey", "id % 4 AS l_suppkey", "CAST(id % 7 AS int) AS l_linenumber", "id % 50 + 0.0d AS l_quantity",
        "round(id * 1.37d, 2) AS l_extendedprice", "(id % 11) / 100d AS l_discount", "(id % 9) / 100d AS l_tax",
        "timestamp_ntz'1995-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id div 2 AS int)) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    plain, blocked = (qf.QUERIES[f"long_series_{n}"](spark, str(tmp_path)) for n in ("features", "blocked"))
    assert plain.columns == blocked.columns and plain.count() == 900 and _rows(plain) == _rows(blocked)
    for df in (plain, blocked):
        assert df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "MapInArrow"


def test_positions_by_key_and_by_bucket(spark):
    """Also with NULL keys and NULL buckets, whose rows have no position."""
    df, s = _frame(spark).withColumn("t", F.expr("CASE WHEN id % 97 > 1 THEN t END")), fx.Series(("key",), ("t", "id"))
    lay = halo.layout(df, s, [F.col("t")])
    by_key = halo.positions(df, s, [F.col("t")], lay)
    by_bucket = halo.positions(df, s, [F.col("t")], lay, floor=1)
    text = [d._jdf.queryExecution().optimizedPlan().toString() for d in (by_key, by_bucket)]
    assert "Join" not in text[0] and "Join" in text[1]
    assert _rows(by_key) == _rows(by_bucket)
    assert by_key.count() == df.where("key IS NOT NULL AND t IS NOT NULL").count() < 580
