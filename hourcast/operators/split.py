"""Chronological splits, expanding folds and sequence windows.

Positions are chronological over the whole frame: order by ``order`` then
``tiebreak``. A global row number with ``Window.orderBy`` would pull every row
into one task, so the cuts are turned into boundary timestamps first:

1. rows per timestamp (map-side combined), range-partitioned in order and
   checkpointed;
2. one total per partition (bounded by the partition count) tells the driver
   which partition holds each cut; only there a running sum, one window per
   partition, finds the timestamp that holds it;
3. rows are labelled by comparing their timestamp with those literals. Only
   the rows of a timestamp that a cut divides need a rank of their own.

The driver sees partition totals and one boundary per cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourcast.session import cut_lineage

@dataclass(frozen=True)
class Boundary:
    """The order values (as text) that hold a cut, and how many of their rows
    come before it."""
    values: tuple
    before: int


def boundaries(df: DataFrame, cuts: Callable[[int], Sequence[int]], order: Sequence[str]) -> list[Boundary]:
    """Where the positions ``cuts(rows)`` lie; those outside the frame's
    positions have no boundary (before it: at its first row)."""
    names = [f"_t{i}" for i in range(len(order))]
    per = cut_lineage(df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n")).orderBy(*order)
                      .withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), 33)
    totals = sorted((r[0], r[1]) for r in per.groupBy(pid).agg(F.sum("_n")).collect())   # one per partition
    n = sum(t for _, t in totals)
    wanted, at = [], 0
    todo = sorted(max(0, int(c)) for c in cuts(n))
    for part, total in totals:
        wanted += [(part, c - at, c) for c in todo if at <= c < at + total]
        at += total
    if not wanted:
        return []
    run = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    held = per.withColumn("_pid", pid).where(F.col("_pid").isin(sorted({p for p, _, _ in wanted}))) \
        .withColumn("_end", F.sum("_n").over(run)).withColumn("_start", F.col("_end") - F.col("_n"))
    hit = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(c).cast("long").alias("c")) for p, c, _ in wanted])
    held = held.select(*[F.col(o).cast("string").alias(t) for o, t in zip(order, names)], F.explode(F.filter(
        hit, lambda w: (w["p"] == F.col("_pid")) & (w["c"] >= F.col("_start")) & (w["c"] < F.col("_end")))).alias("_w"), "_start")
    rows = held.select(*names, (F.col("_w.c") - F.col("_start")).alias("_k")).collect()      # one per cut
    return [Boundary(tuple(r[t] for t in names), int(r["_k"])) for r in rows]


def segment_by_position(df: DataFrame, cuts: Callable[[int], Sequence[int]], order: Sequence[str] = ("timestamp",),
                        tiebreak: Sequence[str] = ("city",), col: str = "segment") -> DataFrame:
    """Add ``col`` = number of ``cuts(rows)`` <= the row's chronological
    position (0-based; NULL order values come first). Rows that a timestamp's
    cut divides are ranked by ``tiebreak`` among that timestamp's rows."""
    found = boundaries(df, cuts, order)
    types = dict(df.dtypes)
    here = F.struct(*[F.col(o).alias(o) for o in order])

    def place(b: Boundary) -> Column:
        return F.struct(*[F.lit(v).cast(types[o]).alias(o) for o, v in zip(order, b.values)])

    def total(terms: list[Column]) -> Column:
        return sum((t.cast("int") for t in terms), F.lit(0))

    split = [b for b in found if b.before]
    plain = df.withColumn(col, total([here > place(b) if b.before else here >= place(b) for b in found]))
    if not split:
        return plain
    divided = reduce(lambda x, y: x | y, [here == place(b) for b in split])
    rank = F.row_number().over(Window.partitionBy(*order).orderBy(*tiebreak)) - F.lit(1)
    parted = df.where(divided).withColumn("_rank", rank)
    parted = parted.withColumn(col, total([(here > place(b)) | ((here == place(b)) & (F.col("_rank") >= F.lit(b.before)))
                                           for b in found])).drop("_rank")
    return plain.where(~divided).unionByName(parted)


def chrono_split(df: DataFrame, test_size: float = 0.2, order: Sequence[str] = ("timestamp",),
                 tiebreak: Sequence[str] = ("city",), col: str = "split") -> DataFrame:
    """M2: first ``int(n * (1 - test_size))`` rows -> 'train', rest -> 'test'."""
    seg = segment_by_position(df, lambda n: [int(n * (1 - test_size))], order, tiebreak, "_seg")
    return seg.withColumn(col, F.when(F.col("_seg") == 0, F.lit("train")).otherwise(F.lit("test"))).drop("_seg")


def fold_cuts(n: int, n_splits: int = 3) -> list[int]:
    """W15 expanding-window folds: test block size n // (k + 1); fold i tests
    rows [n - (k - i) * size, n - (k - i - 1) * size)."""
    size = n // (n_splits + 1)
    return [n - (n_splits - i) * size for i in range(n_splits)]


def ts_folds(df: DataFrame, n_splits: int = 3, order: Sequence[str] = ("timestamp",),
             tiebreak: Sequence[str] = ("city",), col: str = "test_fold") -> DataFrame:
    """Add ``test_fold``: the fold whose test block holds the row (0..k-1), or
    -1 for rows only ever used for training. Fold i trains on test_fold < i."""
    seg = segment_by_position(df, lambda n: fold_cuts(n, n_splits), order, tiebreak, "_seg")
    return seg.withColumn(col, (F.col("_seg") - F.lit(1)).cast("int")).drop("_seg")


def contiguous_folds(df: DataFrame, k: int = 5, order: Sequence[str] = ("timestamp",),
                     tiebreak: Sequence[str] = ("city",), col: str = "test_fold") -> DataFrame:
    """M6/M7: ``col`` = 0..k-1, k consecutive runs of rows; the first n % k of
    them hold one row more."""
    def cuts(n: int) -> list[int]:
        return [i * (n // k) + min(i, n % k) for i in range(1, k)]
    return segment_by_position(df, cuts, order, tiebreak, col)


def fold_frame(folded: DataFrame, fold: int, col: str = "test_fold") -> tuple[DataFrame, DataFrame]:
    """(train, test) frames of one fold."""
    return folded.where(F.col(col) < fold), folded.where(F.col(col) == fold)


def sequences(df: DataFrame, features: Sequence[str], label: str, length: int,
              keys: Sequence[str] = ("city",), order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """At each row i >= length, the previous ``length`` feature rows as an
    array of structs plus label y[i]; rows without a full history are dropped."""
    from hourcast.operators.features import Series
    from hourcast.operators.halo import skew_safe

    def build(f: DataFrame, s: Series) -> DataFrame:
        seq = F.collect_list(F.struct(*[F.col(c) for c in features])).over(s.window().rowsBetween(-length, -1))
        return f.select(*keys, *order, "_core", seq.alias("sequence"), F.col(label).alias("label"))
    out = skew_safe(df, build, Series(tuple(keys), tuple(order)), length, 0, [F.date_trunc("day", F.col(order[0]))])
    return out.where(F.size("sequence") == length)


def dense_ids(df: DataFrame, order: Sequence[str], col: str = "row_id") -> DataFrame:
    """``col`` = 0..n-1 in ``order`` (a unique key), without a window
    over the whole frame.

    The frame is written once, so that a wide plan runs and is planned once,
    and only its key columns are sorted. A range-partitioned sort spreads the
    keys (a hot timestamp included, as the order is unique) over all
    partitions; ``monotonically_increasing_id`` right after the sort is
    (partition << 33) + position in partition. Per-partition counts (one row
    per partition, so bounded by the partition count) give each partition's
    offset. The sorted keys are checkpointed so that their sampled range
    bounds, and therefore the ids, survive recomputation after a lost
    executor. The ids come back to the rows by a join on the key.
    """
    df = cut_lineage(df)
    names = [f"_o{i}" for i in range(len(order))]
    keys = df.select(*[F.col(o).alias(n) for o, n in zip(order, names)])
    s = cut_lineage(keys.orderBy(*names).withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), 33)
    counts = s.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    offs = counts.select("_pid", (F.sum("_n").over(run) - F.col("_n")).alias("_off"))
    rid = F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid"), 33)
    ids = s.join(F.broadcast(offs), pid == F.col("_pid")).select(*names, rid.alias(col))
    same = reduce(lambda x, y: x & y, [F.col(o).eqNullSafe(F.col(n)) for o, n in zip(order, names)])
    return df.join(ids, same).select(*[F.col(c) for c in df.columns], col)
