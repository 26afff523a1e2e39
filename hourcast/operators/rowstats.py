"""Lags and exact rolling statistics of very long frames (W1-W5), by Arrow batches.

The same columns as ``features.with_rolling`` with ``lag_columns`` on
fixed-point doubles. There a row costs some hundred evaluated expressions and
a decimal sum per column; here Spark deals the rows out by key and sorts them,
and a task computes each column for a batch of rows at once with numpy. What a
batch needs of the one before it are its last rows, as many as the longest
lag or window, so a task's memory does not grow with the length of a series.

Sums are differences of running integer sums. They are exact in 64 bits while
the window's do not pass them; a batch with larger values uses Python's
integers.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hourcast.operators.features import STATS, Series


def _by_batch(keys, cols, lags, windows, stats, min_periods, decimals, keep, names, back, only):
    """What a task does with its sorted rows. The helpers are inside, so that
    they travel with it."""
    def shifted(x: np.ndarray, k: int, fill) -> np.ndarray:
        out = np.full_like(x, fill)
        out[k:] = x[:max(0, len(x) - k)]
        return out

    def extremes(v: np.ndarray, off: np.ndarray, sizes: Sequence[int], pick, fill: float) -> dict:
        """Per window size the extreme of the last rows: two overlapping ranges
        whose length is a power of two."""
        level, n, out = v, 1, {}
        for size in sorted(sizes):
            while 2 * n <= size:
                level, n = pick(level, np.where(off >= n, shifted(level, n, fill), fill)), 2 * n
            out[size] = pick(level, np.where(off >= size - n, shifted(level, size - n, fill), fill)) if size > n else level
        return out

    def running(v: np.ndarray) -> np.ndarray:
        return np.concatenate([v[:1] * 0, np.cumsum(v)])

    def column(x: np.ndarray, ok: np.ndarray, off: np.ndarray, sizes: Sequence[int]) -> dict:
        """{(stat, size): (values, missing)} of one column."""
        scale = float(10 ** decimals)
        scaled = np.rint(np.where(ok, x, 0.0) * scale)
        top = float(np.abs(scaled).max(initial=0.0))
        if not top < 2.0 ** 63:
            raise OverflowError(f"value beyond 64 bits at {decimals} decimals")
        v = scaled.astype(np.int64)
        if top * max(sizes) >= 2.0 ** 31:   # n * sum of squares, and the squared sum, stay below (size * top) ** 2
            v = v.astype(object)
        at = np.arange(len(x))
        runs = [running(ok.astype(np.int64)), running(v), running(v * v) if "std" in stats else None]
        ends = {"min": extremes(np.where(ok, x, np.inf), off, sizes, np.minimum, np.inf) if "min" in stats else {},
                "max": extremes(np.where(ok, x, -np.inf), off, sizes, np.maximum, -np.inf) if "max" in stats else {}}
        out = {}
        for size in sizes:
            lo = at - np.minimum(off, size - 1)
            n, s, q = (None if r is None else r[1:] - r[lo] for r in runs)
            few = n < (size if min_periods is None else min_periods)
            d = np.maximum(n, 2).astype(np.float64)
            for stat in stats:
                if stat == "mean":
                    out[stat, size] = s.astype(np.float64) / (scale * np.maximum(n, 1)), few | (n < 1)
                elif stat == "std":
                    out[stat, size] = np.sqrt((n * q - s * s).astype(np.float64) / (scale * scale * d * (d - 1))), few | (n < 2)
                else:
                    out[stat, size] = ends[stat][size], few | (n < 1)
        return out

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        tail = None
        for b in batches:
            if not b.num_rows:
                continue
            own = b.select([*dict.fromkeys([*keys, *cols])])
            t = pa.Table.from_batches([own] if tail is None else [*tail, own]).combine_chunks()
            old, n = t.num_rows - b.num_rows, t.num_rows
            new = np.zeros(n, bool)
            new[0] = True
            for k in keys:   # two NULLs are the same key
                x = t.column(k).combine_chunks()
                null = np.asarray(x.is_null())
                differ = pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, n - 1)), False)
                new[1:] |= np.asarray(differ) | (null[1:] != null[:-1])
            at = np.arange(n)
            off = at - np.maximum.accumulate(np.where(new, at, 0))
            lagged, rolled = [], []
            for c in cols:
                x = t.column(c).combine_chunks()
                ok = np.asarray(x.is_valid())
                x = np.asarray(x.fill_null(0.0))
                for k in lags:
                    gone = ~shifted(ok, k, False) | (off < k)
                    lagged.append(pa.array(shifted(x, k, 0.0)[old:], mask=gone[old:]))
                got = column(x, ok, off, windows) if windows else {}
                rolled += [pa.array(v[old:], mask=gone[old:]) for w in windows for s in stats for v, gone in [got[s, w]]]
            out = pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *lagged, *rolled], names=[*keep, *names])
            yield out if only is None else out.filter(b.column(only))
            tail = t.slice(max(0, n - back)).to_batches() if back else None

    return run


def lags_and_rolling(df: DataFrame, series: Series, cols: Sequence[str], lags: Sequence[int], windows: Sequence[int],
                     stats: Sequence[str] = STATS, min_periods: int | None = 1, decimals: int = 2, keep: Sequence[str] = (),
                     only: str | None = None, lag_name: str = "{col}_lag_{k}h", name: str = "{col}_rolling_{stat}_{w}h") -> DataFrame:
    """``keep`` columns, lags and rolling statistics of ``cols`` (doubles of at
    most ``decimals`` decimals) over the rows of each key in order. With
    ``only`` (a boolean column) just its rows are returned: a projection of so
    many columns behind this one would cost more than all of them."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    other = [c for c in cols if kinds[c] != T.DoubleType()]
    if other:
        raise ValueError(f"not doubles: {other}")
    keys, back = list(series.keys), max(max(lags, default=0), max(windows, default=1) - 1)
    names = [lag_name.format(col=c, k=k) for c in cols for k in lags]
    names += [name.format(col=c, stat=s, w=w) for c in cols for w in windows for s in stats]
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(n, T.DoubleType()) for n in names]])
    src = df.select(*dict.fromkeys([*keys, *series.order, *keep, *cols, *([only] if only else [])]))
    rows = (src.repartition(*keys) if keys else src.repartition(1)).sortWithinPartitions(*keys, *series.order)

    return rows.mapInArrow(_by_batch(keys, cols, lags, windows, stats, min_periods, decimals, list(keep), names, back, only), schema)
