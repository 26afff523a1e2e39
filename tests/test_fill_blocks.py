"""P23 on blocks equals the plain plan, and a hot city is spread over tasks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hourcast.operators import clean as cl

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "city string, timestamp timestamp_ntz, pos long, x double, y double"


def frame(spark, n=24 * 40, seed=1):
    r = random.Random(seed)
    rows = []
    for city in ("hot", "hot", "hot", "b", None):
        pass
    for city, m in (("hot", n), ("b", 30), (None, 50), ("empty", 60)):
        for i in range(m):
            gap = (i // 60) % 2  # long gaps over several days
            x = None if city == "empty" or gap or r.random() < 0.3 else float(i)
            rows.append((city, T0 + dt.timedelta(hours=i), 3600 * i, x, r.random() if i % 200 == 7 else None))
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bucket", ["day", "month", "hour"])
def test_blocks_equal_the_plain_plan(spark, bucket):
    df = frame(spark)
    by = F.date_trunc(bucket, F.col("timestamp"))
    for fill, kw in ((cl.forward_fill, {}), (cl.linear_fill, {"pos": "pos"})):
        plain = fill(df, ["x", "y"], blocks=False, **kw)
        cut = fill(df, ["x", "y"], blocks=True, bucket=by, **kw)
        assert cut.columns == df.columns and rows(cut) == rows(plain)
    assert cl.linear_fill(df.limit(0), ["x"], pos="pos", blocks=True).count() == 0


def test_a_hot_city_is_many_tasks(spark):
    df = frame(spark, 24 * 200).where("city = 'hot'").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = cl.linear_fill(df, ["x"], pos="pos", blocks=True)
        size = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(size) > 1 and max(size) < 0.6 * sum(size)


def test_counts_choose(spark, monkeypatch):
    from hourcast.operators import halo
    asked = []
    monkeypatch.setattr(halo, "is_hot", lambda *a, **k: asked.append(a) or (True, 10))
    df = frame(spark, 100)
    assert rows(cl.forward_fill(df, ["x"])) == rows(cl.forward_fill(df, ["x"], blocks=False)) and len(asked) == 1
