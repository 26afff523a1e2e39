"""Helpers shared by the operators: shipping the package to the workers,
Arrow slicing of text columns, and vectorised word / shingle hashing."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: text bytes that one numpy step works on, whatever the Arrow batch size
SLICE_BYTES = 2_000_000

U64 = np.uint64


def ship(spark: SparkSession) -> None:
    """Make ``hourcast`` importable on the executors (once per context).

    The package goes out through ``addPyFile``, so jobs do not depend on the
    workers' PYTHONPATH or on a folder shared with the driver.
    """
    sc = spark.sparkContext
    if getattr(sc, "_hourcast_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="hourcast-ship-"), "hourcast_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.join("hourcast", os.path.relpath(p, root)))
    sc.addPyFile(out)
    sc._hourcast_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``size`` text bytes (at
    least one row; a single longer text stays whole)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        nbytes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(nbytes)
        lo = 0
        while lo < n:
            base = end[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(end, base + size, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 row offsets (null = empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


# fixed odd multiplier and byte codes of the word hash (any values do; they
# only have to be the same everywhere)
_P = 0x9E3779B97F4A7C15
_RNG = np.random.Generator(np.random.PCG64(20240117))
_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POW = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.empty(m, U64)
        out[0] = 1
        k = 1
        while k < m:  # doubling: x^(k+i) = x^k * x^i
            out[k:2 * k] = out[:k] * U64(pow(base, k, 1 << 64))
            k *= 2
        _POW[base] = have = out
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser: a bijection, so distinct values stay distinct."""
    x = x ^ U64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTES = np.arange(256)
_IN_WORD = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
_IN_LETTERS = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))


class Words:
    """Words of a batch of texts: maximal runs without space and \\t..\\r.

    start/end: byte ranges in ``raw``; row: text of each word; bounds: n+1
    offsets of the texts' words.
    """

    def __init__(self, col, lower: bool = True, letters: bool = False):
        """letters: only letters, digits and bytes beyond ASCII make a word."""
        raw, off = text_bytes(col)
        if lower:
            raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        self.raw, self.off = raw, off
        inside = _IN_LETTERS[raw] if letters else _IN_WORD[raw]
        edge = np.empty(len(raw) + 1, bool)  # True where a word starts or ends
        if len(raw):
            edge[0] = inside[0]
            np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
            edge[-1] = inside[-1]
            # texts lie back to back: a word never crosses a text's start
            cut = off[1:-1]
            cut = cut[(cut > 0) & (cut < len(raw))]
            cut = np.unique(cut[inside[cut] & inside[cut - 1]])
        else:
            edge[:] = False
            cut = np.zeros(0, np.int64)
        pos = np.flatnonzero(edge)
        if len(cut):
            pos = np.sort(np.concatenate([pos, cut, cut]))
        self.start, self.end = pos[0::2], pos[1::2]
        self.bounds = np.searchsorted(self.start, off)
        self.n = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(off) - 1), self.n)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self.ranges(self.start, self.end)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each range."""
        if not len(start):
            return np.zeros(0, U64)
        raw = self.raw
        if not hasattr(self, "_acc"):
            acc = np.empty(len(raw) + 1, U64)
            acc[0] = 0
            np.cumsum(_CODE[raw] * _powers(_P, len(raw)), out=acc[1:])
            self._acc = acc
        inv = _powers(_inverse(_P), len(raw))
        # a range is at least one byte long, so start < len(raw)
        h = (self._acc[end] - self._acc[start]) * inv[start]
        return mix(h ^ ((end - start).astype(U64) << U64(40)))


def shingles(words: Words, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, hash) of every k-word window of each text, in order.

    A text with fewer than k words (and at least one) gives one shingle of
    all its words; one without words gives none.
    """
    h = words.hashes() if hashes is None else hashes
    n = words.n
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    total = int(count.sum())
    row = np.repeat(np.arange(len(n)), count)
    begin = np.cumsum(count) - count
    first = np.arange(total) - np.repeat(begin, count) + np.repeat(words.bounds[:-1], count)
    out = np.zeros(total, U64)
    full = n[row] >= k
    at = first[full]
    acc = np.zeros(len(at), U64)
    for j in range(k):
        acc = mix(acc + h[at + j], j + 1)
    out[full] = acc
    for i in np.flatnonzero(~full):
        acc = np.zeros(1, U64)
        lo, hi = words.bounds[row[i]], words.bounds[row[i] + 1]
        for j in range(hi - lo):
            acc = mix(acc + h[lo + j:lo + j + 1], j + 1)
        out[i] = mix(acc, 1000 + int(hi - lo))[0]
    return row, first, out


def distinct_per_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted by row then value; row must ascend."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return r[keep], v[keep]


def list_array(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
