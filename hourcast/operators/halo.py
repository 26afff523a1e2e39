"""Halo-blocked row windows for very long series (skewed keys, §4.3.2).

A window partitioned by ``city`` sends every row of a city to one task; if
one city holds a third of the data that task cannot finish. Here each series
is cut into blocks of ``block_rows`` consecutive rows, and each block also
receives copies of the ``back`` rows before it and the ``fwd`` rows after it
(the halo). Row-offset features (lags, leads, rolling frames up to
``back + 1`` rows, diffs) computed per (key, block) are then exact for the
block's own rows; halo copies are dropped afterwards. Forward fill (percent
change) needs a value that may lie further back than the halo, so each block
gets a carried-in last non-NULL value computed on the small per-block table.

Row positions come without a global sort: rows are counted per (key,
bucket) (map-side combined), a running sum over that small table gives each
bucket's first position, and a rank inside each (key, bucket) gives the
rest. The buckets must be ordered consistently with the series order (e.g.
the minute of the timestamp) and fine enough that one bucket of the hottest
key fits a task. Everything big is partitioned by (key, bucket) or
(key, block), so the work spreads evenly however skewed the keys are.

Small tables (bucket starts, block carries) carry no broadcast hint: AQE
broadcasts them when their measured bytes are small. Otherwise the join
shuffles on the key the next window needs anyway.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourcast.operators.features import CARRY, Series

MAX_BLOCK_ROWS = 1 << 20
MIN_HOT_ROWS = 1 << 16   # one task sorts so many rows in well under a second: no key below is split
HELPERS = ("_pos", "_block", "_core")


@dataclass(frozen=True)
class Layout:
    counts: DataFrame       # rows per (key, bucket)
    keys: int
    rows: int
    max_key_rows: int


def _bucketed(df: DataFrame, buckets: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_bk{i}" for i in range(len(buckets))]
    return df.select("*", *[b.alias(n) for b, n in zip(buckets, names)]), names


def layout(df: DataFrame, series: Series, buckets: Sequence[Column]) -> Layout:
    """Per-(key, bucket) row counts, not computed yet, and the sizes of the
    keys (one small action, a row per key and partition)."""
    keys = list(series.keys)
    d, names = _bucketed(df, buckets)
    counts = d.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    st = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("r"),
        F.coalesce(F.max("n"), F.lit(0)).alias("m")).first()
    return Layout(counts, int(st["k"]), int(st["r"]), int(st["m"]))


def auto_block_rows(lay: Layout, halo: int, parallelism: int) -> int:
    """Spread the largest key over every core, blocks of at least four halos
    (replication overhead <= 25%) and at most MAX_BLOCK_ROWS rows."""
    return block_rows_for(lay.max_key_rows, halo, parallelism)


def block_rows_for(max_key_rows: int, halo: int, parallelism: int) -> int:
    want = math.ceil(max_key_rows / max(1, parallelism))
    return int(min(MAX_BLOCK_ROWS, max(4 * halo, 1, want)))


def fair_share(rows: int, parallelism: int, floor: int = MIN_HOT_ROWS) -> int:
    """The largest key that one task may take."""
    return min(MAX_BLOCK_ROWS, max(math.ceil(rows / max(1, parallelism)), floor))


def positions(df: DataFrame, series: Series, buckets: Sequence[Column], lay: Layout,
              pos: str = "_pos", floor: int = MIN_HOT_ROWS) -> DataFrame:
    """Dense 0-based row position within each key, in series order; rows with
    a NULL key or bucket have none and are left out. While every key fits a
    fair task share it is a rank per key; the counts per bucket may be almost
    as many as the rows."""
    keys = list(series.keys)
    d, names = _bucketed(df, buckets)
    if lay.max_key_rows <= fair_share(lay.rows, df.sparkSession.sparkContext.defaultParallelism, floor):
        rank = F.row_number().over(series.window()) - F.lit(1)
        return d.select("*", rank.cast("long").alias(pos)).dropna(subset=[*keys, *names]).select(*df.columns, pos)
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = lay.counts.select(*keys, *names,
                               F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*series.order)) - F.lit(1)
    ranked = d.select("*", rank.alias("_rk"))
    return ranked.join(starts, [*keys, *names]) \
        .select(*df.columns, (F.col("_start") + F.col("_rk")).cast("long").alias(pos))


def _block_of(pos: str, block_rows: int) -> Column:
    return F.floor(F.col(pos) / F.lit(block_rows)).cast("long")


def with_halo(df: DataFrame, back: int, fwd: int, block_rows: int, pos: str = "_pos") -> DataFrame:
    """Assign ``_block`` and replicate halo rows (``_core`` = False)."""
    if back > block_rows or fwd > block_rows:
        raise ValueError("halo wider than a block")
    b = _block_of(pos, block_rows)
    off = F.col(pos) - b * F.lit(block_rows)
    copies = F.array(
        F.struct(b.alias("_block"), F.lit(True).alias("_core")),
        F.when(off >= F.lit(block_rows - back), F.struct((b + 1).alias("_block"), F.lit(False).alias("_core"))),
        F.when((off < F.lit(fwd)) & (b > 0), F.struct((b - 1).alias("_block"), F.lit(False).alias("_core"))))
    return df.select("*", F.explode(F.filter(copies, lambda x: x.isNotNull())).alias("_h")) \
        .select(*df.columns, "_h._block", "_h._core")


def carry_table(df: DataFrame, series: Series, cols: Sequence[str], back: int, block_rows: int,
                pos: str = "_pos") -> DataFrame:
    """Per (key, block b): for each column the last non-NULL value before
    block b's halo starts, i.e. before position ``b*block_rows - back``.

    That is the last non-NULL of block b-1 outside the rows it lends to b's
    halo, else the last non-NULL of any block before b-1. One aggregate over
    the rows (map-side combined) and a window over the per-block table."""
    keys = list(series.keys)
    b = _block_of(pos, block_rows)
    lent = (F.col(pos) - b * F.lit(block_rows)) >= F.lit(block_rows - back)
    aggs = []
    for c in cols:
        ok = F.col(c).isNotNull()
        aggs += [F.max_by(F.col(c), F.when(ok, F.col(pos))).alias(f"_a_{c}"),
                 F.max_by(F.col(c), F.when(ok & ~lent, F.col(pos))).alias(f"_p_{c}")]
    per_block = df.select(*keys, b.alias("_block"), pos, *cols).groupBy(*keys, "_block").agg(*aggs)
    w = Window.partitionBy(*keys).orderBy("_block")
    older = w.rowsBetween(Window.unboundedPreceding, -2)
    return per_block.select(*keys, "_block", *[
        F.coalesce(F.lag(f"_p_{c}", 1).over(w), F.last(f"_a_{c}", ignorenulls=True).over(older))
        .alias(CARRY.format(col=c)) for c in cols])


def blocked(df: DataFrame, build: Callable[[DataFrame, Series], DataFrame], series: Series, back: int, fwd: int,
            buckets: Sequence[Column], pad_cols: Sequence[str] = (), block_rows: int | None = None,
            lay: Layout | None = None) -> DataFrame:
    """Run ``build(frame, series)`` per (key, block) with halos and return the
    core rows only. ``build`` must keep the ``_core`` column of its input, or
    itself return just the rows where it is true; the keys of the series it receives are the original keys plus ``_block``.
    ``back`` >= every lag / diff period / rolling size - 1, ``fwd`` >= every
    lead."""
    keys = list(series.keys)
    lay = lay or layout(df, series, buckets)
    if block_rows is None:
        block_rows = auto_block_rows(lay, back + fwd, df.sparkSession.sparkContext.defaultParallelism)
    p = positions(df, series, buckets, lay)
    h = with_halo(p, back, fwd, block_rows)
    if pad_cols:
        carry = carry_table(p, series, pad_cols, back, block_rows)
        h = h.join(carry, [*keys, "_block"], "left") \
            .select(*h.columns, *[CARRY.format(col=c) for c in pad_cols])
    out = build(h, Series(keys=(*keys, "_block"), order=series.order))
    drop = [*HELPERS, *[CARRY.format(col=c) for c in pad_cols]]
    if "_core" in out.columns:
        out = out.where("_core")
    return out.drop(*[c for c in drop if c in out.columns])


def skew_safe(df: DataFrame, build: Callable[[DataFrame, Series], DataFrame], series: Series, back: int,
              fwd: int, buckets: Sequence[Column], pad_cols: Sequence[str] = (),
              block_rows: int | None = None, floor: int = MIN_HOT_ROWS) -> DataFrame:
    """Plain ``build`` when no key is larger than a fair task share (rows /
    parallelism, at least one block or ``floor`` rows, at most
    ``MAX_BLOCK_ROWS``): one window per key is then balanced. A key above it (a hot key, or a few keys holding
    everything) takes the blocked path. The decision reads only the
    per-(key, bucket) counts."""
    hot, rows = is_hot(df, series, back + fwd, block_rows, floor)
    if not hot:
        return build(df.withColumn("_core", F.lit(True)), series).drop("_core")
    return blocked(df, build, series, back, fwd, buckets, pad_cols, rows)


def is_hot(df: DataFrame, series: Series, halo: int, block_rows: int | None = None, floor: int = MIN_HOT_ROWS) -> tuple[bool, int]:
    """(whether a key is larger than a fair task share, the rows of a block).
    Per-key counts only: the scan reads just the key columns and the aggregate
    combines map-side to one row per key and partition."""
    st = df.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("r"), F.coalesce(F.max("n"), F.lit(0)).alias("m")).first()
    rows, max_key = int(st["r"]), int(st["m"])
    par = df.sparkSession.sparkContext.defaultParallelism
    if block_rows is None:
        block_rows = block_rows_for(max_key, halo, par)
    fair = math.ceil(rows / max(1, par))
    return max_key > min(MAX_BLOCK_ROWS, max(block_rows, fair, floor)), block_rows
