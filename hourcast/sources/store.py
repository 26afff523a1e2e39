"""Parquet feature store, prediction log and model registry.

Layout of a group: ``data/version=<id>/date=YYYY-MM-DD/*.parquet``, which never
change once written, and ``_current/<n>.json``, which says for every date
which version holds it. An upsert writes the merged dates once, as a new
version, and then puts the next pointer in place by a rename; readers take the
newest pointer, so they see the group before or after an update and never in
between, and two writers cannot both take the same number. Reads with a time
range open only the dates they need and push the timestamp filter into the
scan.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.operators.align import keep_one
from hourcast.session import checkpoint_dir

PREDICTION_LOG = T.StructType([
    T.StructField("city", T.StringType()), T.StructField("target_date", T.DateType()),
    T.StructField("predicted_aqi", T.DoubleType()), T.StructField("model_used", T.StringType())])

REGISTRY = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("feature_names", T.ArrayType(T.StringType()))])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def files_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(files, bytes, newest modification time) under a path: changes when its
    data does."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    n = size = newest = 0
    while files.hasNext():
        f = files.next()
        n, size, newest = n + 1, size + f.getLen(), max(newest, f.getModificationTime())
    return n, size, newest


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder that this module wrote."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@dataclass(frozen=True)
class Pointer:
    """State ``n`` of a group: the version of each date, and the schema."""
    n: int
    dates: dict
    schema: T.StructType

    def text(self) -> str:
        return json.dumps({"dates": self.dates, "schema": json.loads(self.schema.json())})


class Overtaken(RuntimeError):
    """Another writer put its pointer in place first."""


NO_DATE = "__HIVE_DEFAULT_PARTITION__"


class FeatureStore:
    RETRIES = 5

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = ("timestamp", "city"),
                 ts: str = "timestamp"):
        self.spark, self.root, self.keys, self.ts = spark, root.rstrip("/"), list(keys), ts

    def path(self, group: str) -> str:
        return f"{self.root}/{group}"

    def exists(self, group: str) -> bool:
        return self.pointer(group) is not None

    # pointers
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self, group: str) -> list[int]:
        fs, p = self._fs(f"{self.path(group)}/_current")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def pointer(self, group: str, n: int | None = None) -> Pointer | None:
        """The newest state of a group, or state ``n``; None if there is none."""
        numbers = self._numbers(group)
        if not numbers:
            return None
        n = numbers[-1] if n is None else n
        fs, p = self._fs(f"{self.path(group)}/_current/{n:012d}.json")
        stream = fs.open(p)
        try:
            d = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Pointer(n, d["dates"], T.StructType.fromJson(d["schema"]))

    def _swap(self, group: str, new: Pointer) -> None:
        where = f"{self.path(group)}/_current"
        fs, tmp = self._fs(f"{where}/.{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(bytearray(new.text().encode()))
        out.close()
        _, to = self._fs(f"{where}/{new.n:012d}.json")
        if fs.exists(to) or not fs.rename(tmp, to):
            fs.delete(tmp, False)
            raise Overtaken(f"{group}: state {new.n} is there already")

    def _put(self, df: DataFrame, group: str) -> dict:
        """Write a frame with ``date`` as a new version; its dates."""
        version = uuid.uuid4().hex
        where = f"{self.path(group)}/data/version={version}"
        df.write.partitionBy("date").parquet(where)
        fs, p = self._fs(where)
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return {x[5:]: version for x in names if x.startswith("date=")}

    # frames
    def _open(self, group: str, at: Pointer, dates: Sequence[str]) -> DataFrame:
        """The rows of the given dates with their ``date``."""
        whole = T.StructType([*at.schema.fields, T.StructField("date", T.DateType())])
        paths = [f"{self.path(group)}/data/version={at.dates[d]}/date={d}" for d in dates]
        if not paths:
            return self.spark.createDataFrame([], whole)
        full = T.StructType([*whole.fields, T.StructField("version", T.StringType())])
        return self.spark.read.schema(full).option("basePath", f"{self.path(group)}/data").parquet(*paths).drop("version")

    def frame(self, group: str, n: int | None = None) -> DataFrame:
        """All rows with their ``date``, of the newest state or state ``n``."""
        at = self.pointer(group, n)
        if at is None:
            raise FileNotFoundError(self.path(group))
        return self._open(group, at, sorted(at.dates))

    def read(self, group: str, start=None, end=None, schema: T.StructType | None = None) -> DataFrame:
        """Inclusive time range; a missing group reads as empty."""
        at = self.pointer(group)
        if at is None:
            return self.spark.createDataFrame([], schema or T.StructType([]))
        lo, hi = (None if x is None else str(x)[:10] for x in (start, end))
        dates = [d for d in sorted(at.dates) if (lo is None and hi is None) or (
            d != NO_DATE and (lo is None or d >= lo) and (hi is None or d <= hi))]
        df = self._open(group, at, dates)
        if start is not None:
            df = df.where(F.col(self.ts) >= F.lit(start))
        if end is not None:
            df = df.where(F.col(self.ts) <= F.lit(end))
        return df.drop("date")

    def write(self, df: DataFrame, group: str) -> None:
        """Overwrite the whole group."""
        at = self.pointer(group)
        dates = self._put(df.withColumn("date", F.to_date(self.ts)), group)
        self._swap(group, Pointer(at.n + 1 if at else 0, dates, df.schema))

    def upsert(self, updates: DataFrame, group: str, keys: Sequence[str] | None = None,
               arrival: str | None = None) -> None:
        """Last write wins on ``keys`` (default (timestamp, city)), also
        among the rows of one update: by the ``arrival`` column, or else in
        the order of the frame's rows. One write; a writer that was overtaken
        merges again with what the other one left."""
        keys = list(keys or self.keys)
        came = F.col(arrival).cast("long") if arrival else F.monotonically_increasing_id()
        upd = updates.withColumn("_came", came)
        upd = keep_one(upd, keys, ["_came"], "last").select(*updates.columns).withColumn("date", F.to_date(self.ts))
        for _ in range(self.RETRIES):
            at = self.pointer(group)
            merged = upd
            if at and at.dates:
                # dates touched by the update: one small driver-side list
                touched = {NO_DATE if r[0] is None else str(r[0]) for r in upd.select("date").distinct().collect()}
                old = self._open(group, at, sorted(touched & set(at.dates))).withColumn("_version", F.lit(0))
                merged = keep_one(old.unionByName(upd.withColumn("_version", F.lit(1)), allowMissingColumns=True),
                                  keys, ["_version"], "last").drop("_version")
            dates = self._put(merged, group)
            fields = [f for f in merged.schema.fields if f.name != "date"]
            try:
                self._swap(group, Pointer(at.n + 1 if at else 0, {**(at.dates if at else {}), **dates}, T.StructType(fields)))
                return
            except Overtaken:
                continue
        raise Overtaken(f"{group}: overtaken {self.RETRIES} times")

    def vacuum(self, group: str, keep: int = 2) -> int:
        """Drop the pointers before the newest ``keep`` and the versions that no
        kept pointer names; the number of versions dropped. A reader of an
        older state must be done."""
        numbers = self._numbers(group)
        used = {v for n in numbers[-keep:] for v in self.pointer(group, n).dates.values()}
        for n in numbers[:-keep]:
            _delete(self.spark, f"{self.path(group)}/_current/{n:012d}.json")
        fs, p = self._fs(f"{self.path(group)}/data")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        old = [x for x in names if x.startswith("version=") and x[8:] not in used]
        for x in old:
            _delete(self.spark, f"{self.path(group)}/data/{x}")
        return len(old)

    def upsert_time_only(self, updates: DataFrame, group: str) -> None:
        """The local-store variant deduping on the timestamp alone."""
        self.upsert(updates, group, keys=[self.ts])


class ProgressLog:
    """Which (city, day) cells a backfill has done, as an append-only
    table. A reset is a row too: a city's progress is what was recorded after
    its last reset, so a restarted job resumes and a reset city starts anew."""

    SCHEMA = "city string, day date, records long, seq long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def _append(self, rows: DataFrame) -> None:
        newest = self._log().agg(F.max("seq")).first()[0]
        rows.select("city", "day", F.col("records").cast("long").alias("records"),
                    F.lit(0 if newest is None else newest + 1).cast("long").alias("seq")).write.mode("append").parquet(self.path)

    def record(self, done: DataFrame) -> None:
        """Append completed (city, day, records)."""
        self._append(done)

    def reset(self, *cities: str) -> None:
        self._append(self.spark.createDataFrame([(c, None, None) for c in cities], "city string, day date, records long"))

    def done(self) -> DataFrame:
        """(city, day, records) since each city's last reset; a day that was
        recorded again counts once, as recorded last."""
        log = self._log()
        last = log.where("day is null").groupBy("city").agg(F.max("seq").alias("reset"))
        live = log.where("day is not null").join(last, "city", "left").where("reset is null or seq > reset")
        return live.groupBy("city", "day").agg(F.max_by("records", "seq").alias("records"))


def feature_view(df: DataFrame, features: Sequence[str], labels: Sequence[str], keys: Sequence[str] = ("city", "timestamp")) -> DataFrame:
    """Keys, features and labels of a feature group; a column that is
    both, or neither, is an error and not a silent choice."""
    both = sorted(set(features) & set(labels))
    missing = sorted(({*features, *labels, *keys}) - set(df.columns))
    if both or missing:
        raise ValueError(f"features that are labels: {both}; missing columns: {missing}")
    return df.select(*keys, *features, *labels)


def train_test(view: DataFrame, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The view's earlier and later rows (Q15: split by time, not at random)."""
    from hourcast.operators.split import chrono_split
    from hourcast.session import cut_lineage
    parts = chrono_split(cut_lineage(view), test_size)
    return tuple(parts.where(F.col("split") == s).drop("split") for s in ("train", "test"))


def append_predictions(df: DataFrame, path: str) -> None:
    """Append-only prediction log partitioned by target date."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in PREDICTION_LOG.fields]) \
        .write.mode("append").partitionBy("target_date").parquet(path)


def first_nonempty(readers) -> DataFrame:
    """Try candidate readers in order; the first non-empty frame wins."""
    for r in readers:
        try:
            df = r()
        except FileNotFoundError:
            continue
        except AnalysisException as e:  # only a missing path or table leads to the next candidate
            if e.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
                raise
            continue
        if df is not None and not df.isEmpty():
            return df
    raise FileNotFoundError("no candidate source has data")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """S14."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_nested_json(df: DataFrame, path: str) -> None:
    """One JSON document per row (nested structs/arrays kept)."""
    df.write.mode("overwrite").json(path)


# Registry ---------------------------------------------------------------------
def registry_upsert(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """(model_name, version) is the key; the newer write wins."""
    if existing is None:
        return new
    return keep_one(existing.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1))),
                    ["model_name", "version"], ["_v"], "last").drop("_v")


def write_registry(df: DataFrame, root: str) -> None:
    """One metadata document per model and version, in a folder of its own."""
    df.withColumn("model", F.col("model_name")).withColumn("v", F.col("version")) \
        .repartition("model", "v").write.mode("append").partitionBy("model", "v").json(f"{root}/models")


def read_registry(spark: SparkSession, pattern: str) -> DataFrame:
    """Metadata documents (``models/*/*/*.json``), one or several to a file."""
    return spark.read.schema(REGISTRY).json(pattern)


def latest_versions(registry: DataFrame) -> DataFrame:
    """Newest version per model (versions are yyyyMMdd_HHmmss text)."""
    return keep_one(registry, ["model_name"], ["version"], "last")


def list_models(registry: DataFrame, allow: Sequence[str] | None = None) -> DataFrame:
    """Models with their versions, newest first; P26: only the names in
    ``allow`` (a filter applied before the window, so it prunes early)."""
    if allow is not None:
        registry = registry.where(F.col("model_name").isin(list(allow)))
    w = Window.partitionBy("model_name").orderBy(F.col("version").desc())
    return registry.select("model_name", "version", F.row_number().over(w).alias("recency"))


def lookback_rows(df: DataFrame, days: int = 7, keys: Sequence[str] = ("city",), ts: str = "timestamp",
                  city: str | None = None) -> DataFrame:
    """The last ``days`` of every key, relative to that key's newest row.

    With ``city`` given this is the single-city serving read: an equality
    filter plus a range filter on literals, both pushed to the scan. For all
    keys, the per-key newest timestamp is a grouped max (map-side combined,
    one row per key), which AQE broadcasts when its bytes are small."""
    if city is not None:
        one = df.where(F.col(keys[0]) == F.lit(city))
        newest = one.agg(F.max(ts)).first()[0]
        if newest is None:
            return one
        return one.where(F.col(ts) >= F.lit(newest) - F.expr(f"INTERVAL {int(days)} DAYS"))
    newest = df.groupBy(*keys).agg(F.max(ts).alias("_newest"))
    j = df.join(newest, list(keys))
    return j.where(F.col(ts) >= F.col("_newest") - F.expr(f"INTERVAL {int(days)} DAYS")).select(*df.columns)


def latest_rows(df: DataFrame, keys: Sequence[str] = ("city",), ts: str = "timestamp") -> DataFrame:
    """The most recent row of every key (grouped max over a struct led by
    the timestamp: combines map-side, no per-key sort)."""
    return keep_one(df, list(keys), [ts], "last")


def feature_group_rows(df: DataFrame, order: Sequence[str] = ("timestamp", "city"), id_col: str = "observation_id",
                       time_col: str = "timestamp") -> DataFrame:
    """Rows ready for a feature group keyed by a dense ``id_col``.

    Rows with any NULL or NaN (lag warm-up, missing targets) are dropped, the
    id is 0..n-1 in ``order`` (exact, no whole-frame window: ``dense_ids``),
    ``event_time`` copies ``time_col`` and booleans become 0/1 integers. The
    city column is kept: with several cities it is part of the row's identity.
    The frame is written before the filter, whose constraints the optimizer
    would else carry through every alias of a wide plan.
    """
    from hourcast.operators.clean import bools_to_int, drop_incomplete
    from hourcast.operators.split import dense_ids
    from hourcast.session import cut_lineage
    clean = bools_to_int(drop_incomplete(cut_lineage(df)))
    ided = dense_ids(clean, list(order), id_col)
    return ided.select(id_col, F.col(time_col).alias("event_time"), *clean.columns)
