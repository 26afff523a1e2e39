"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every hourcast job relies on. Timestamps are stored as
# TIMESTAMP_NTZ and interpreted as UTC; AQE re-plans joins and coalesces
# small shuffle partitions at run time; the skew-join rule splits hot keys.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # wide feature frames (~190 aliased window columns) followed by NULL
    # filters make constraint propagation explode; inferred filters add
    # nothing to these plans
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "hourcast",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the hourcast settings applied.

    ``master`` defaults to whatever the launcher provides; when nothing is
    configured (plain ``python``) it falls back to ``local[*]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    elif not os.environ.get("SPARK_MASTER") and "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.master("local[*]")
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    # getOrCreate returns an existing session unchanged: apply the SQL
    # settings that are runtime-modifiable so behaviour does not depend on
    # who created the session first.
    for k, v in conf.items():
        if k.startswith("spark.sql.") and "arrow" not in k:
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf of an existing session
                pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared directory used to cut lineage.

    Read from ``spark.checkpoint.dir`` (set by the cluster); only a local
    session without one (tests) gets a private scratch directory.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return spark.sparkContext.getCheckpointDir() or d
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="hourcast-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint directory.

    Used where a plan is consumed by several jobs (e.g. a range-partitioned
    frame whose sampled bounds must stay fixed) so that a lost executor
    recomputes from the checkpoint rather than from a re-sampled plan.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
