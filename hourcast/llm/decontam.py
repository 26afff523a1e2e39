"""Benchmark decontamination (operator 4).

For every benchmark item, windows of the item's own length (in words) slide
over the documents. Window and item are compared by SimHash fingerprints of
their weighted 5-word shingles (weight: occurrences). The fingerprints are
cut into blocks; if two differ in at most RADIUS bits, at least one block
differs in at most RADIUS // BLOCKS bits, so looking up every block's small
Hamming ball finds all fingerprints within the radius. Candidates are then
verified by exact weighted Jaccard similarity of the shingles.

Every window that holds a shingle of any item of its length is fingerprinted;
one without has similarity zero to all of them. Which item a window may be is
for the blocks to say.

The benchmark is the query set: it is dealt into blocks of bounded size, and
each block is run against all documents in one pass without a shuffle.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hourcast.llm import common, wordcache

U64 = np.uint64
K = 5
MIN_SIM = (80, 100)
BITS = 256
#: at similarity 0.8 about 39 of 256 bits differ, with a deviation under 6
RADIUS = 64
BLOCKS = 22
#: benchmark bytes per pass
ITEM_BYTES = 16_000_000
#: windows fingerprinted at a time
WINDOWS = 1024
_LOOK_BITS = 20


def sign_bits(h: np.ndarray) -> np.ndarray:
    """(shingles, BITS) 0/1: each shingle's pseudo-random signs."""
    lanes = np.stack([common.mix(h, 200 + i) for i in range(BITS // 64)], 1)
    return np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1)


def simhash(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(windows, BITS) 0/1 fingerprints of h[start : start + length]."""
    end = np.cumsum(length)
    at = np.arange(end[-1]) + np.repeat(start - (end - length), length)
    ones = np.add.reduceat(sign_bits(h[at]), end - length, axis=0, dtype=np.uint32)
    return (2 * ones > length[:, None]).astype(np.uint8)


def _edges() -> list[tuple[int, int]]:
    cut = np.linspace(0, BITS, BLOCKS + 1).astype(int)
    return list(zip(cut[:-1].tolist(), cut[1:].tolist()))


def block_values(bits: np.ndarray) -> np.ndarray:
    """(windows, BLOCKS) integers."""
    return np.stack([bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a)) for a, b in _edges()], 1)


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` bits."""
    v = np.arange(1 << width)
    return v[np.array([bin(x).count("1") for x in v]) <= radius]


class SizeIndex:
    """The fingerprints of the items of one length, by block value."""

    def __init__(self, items: np.ndarray, bits: np.ndarray):
        self.items, self.bits = items, bits
        vals = block_values(bits)
        self.order = [np.argsort(vals[:, b], kind="stable") for b in range(BLOCKS)]
        self.count = [np.bincount(vals[:, b], minlength=1 << (e - a)) for b, (a, e) in enumerate(_edges())]
        self.start = [np.cumsum(c) - c for c in self.count]

    def within(self, bits: np.ndarray, balls: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within RADIUS."""
        vals = block_values(bits)
        found = []
        for b in range(BLOCKS):
            probe = vals[:, b][:, None] ^ balls[b][None, :]
            n = self.count[b][probe]
            w, j = np.nonzero(n)
            n, s = n[w, j], self.start[b][probe[w, j]]
            end = np.cumsum(n)
            if len(end):
                at = np.arange(end[-1]) + np.repeat(s - (end - n), n)
                found.append(np.repeat(w, n) * len(self.items) + self.order[b][at])
        if not found:
            return (np.zeros(0, np.int64),) * 3
        pair = np.unique(np.concatenate(found))
        w, i = pair // len(self.items), pair % len(self.items)
        dist = (bits[w] != self.bits[i]).sum(1)
        ok = dist <= RADIUS
        return w[ok], self.items[i[ok]], dist[ok]


class ItemIndex:
    """Shingles and fingerprints of one block of benchmark items."""

    def __init__(self, texts: list[str]):
        col = pa.array(texts, pa.large_string())
        w = common.Words(col)
        row, _, h = common.shingles(w, K)
        self.words = w.n
        self.m = np.bincount(row, minlength=len(texts))
        self.begin = np.cumsum(self.m) - self.m
        self.h = h
        # shingle -> (item, occurrences in it)
        order = np.lexsort((row, h))
        hs, rs = h[order], row[order]
        new = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])])) if len(h) else np.zeros(0, np.int64)
        self.item = rs[new]
        self.times = np.diff(np.append(new, len(hs)))
        self.keys, self.first, self.count = np.unique(hs[new], return_index=True, return_counts=True)
        self.look = np.zeros(1 << _LOOK_BITS, bool)
        self.look[(self.keys & U64((1 << _LOOK_BITS) - 1)).astype(np.int64)] = True
        self.sizes = {}
        for size in np.unique(self.words[self.m > 0]).tolist():
            at = np.flatnonzero(self.words == size)
            self.sizes[size] = SizeIndex(at, simhash(h, self.begin[at], self.m[at]))
        balls = {x: ball(x, RADIUS // BLOCKS) for x in {b - a for a, b in _edges()}}
        self.balls = [balls[b - a] for a, b in _edges()]

    def weights(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.h[self.begin[item]:self.begin[item] + self.m[item]], return_counts=True)


def similarity(a: np.ndarray, item: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """(sum of minima, sum of maxima) of two weighted shingle sets."""
    v, n = np.unique(a, return_counts=True)
    _, i, j = np.intersect1d(v, item[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], item[1][j]).sum())
    return both, int(n.sum() + item[1].sum() - both)


def search(col, ix: ItemIndex, num: int, den: int):
    """(row, item, first word, words, min sum, max sum, distance): the best
    window of every text for each item within the similarity."""
    w = common.Words(col)
    hashes = w.hashes()
    out: dict[tuple[int, int], tuple] = {}
    # items shorter than K words have one shingle of all their words
    for k in sorted({min(K, s) for s in ix.sizes}):
        row, first, h = common.shingles(w, k, hashes)
        if k < K:  # the same form as a whole short text
            full = w.n[row] >= k
            row, first, h = row[full], first[full], common.mix(h[full], 1000 + k)
        near = np.flatnonzero(ix.look[(h & U64((1 << _LOOK_BITS) - 1)).astype(np.int64)])
        at = np.searchsorted(ix.keys, h[near])
        at[at == len(ix.keys)] = 0
        real = ix.keys[at] == h[near]
        near, at = near[real], at[real]
        n = ix.count[at]
        end = np.cumsum(n)
        if not len(end):
            continue
        slot = np.arange(end[-1]) + np.repeat(ix.first[at] - (end - n), n)
        item, pos = ix.item[slot], np.repeat(near, n)
        fits = np.minimum(ix.words[item], K) == k
        item, pos = item[fits], pos[fits]
        base = np.zeros(len(w.n) + 1, np.int64)
        np.cumsum(np.bincount(row, minlength=len(w.n)), out=base[1:])
        length = ix.words[item]
        for words in np.unique(length).tolist():
            # windows of this length around the hits of its items, each once
            hit = np.unique(pos[length == words])
            r = row[hit]
            lo, hi = w.bounds[r], w.bounds[r + 1]
            size = np.minimum(words, hi - lo)
            span = size - k + 1  # shingles per window
            p = first[hit]
            a, b = np.maximum(lo, p - span + 1), np.minimum(p, hi - size) + 1
            mark = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(mark, a, 1)
            np.add.at(mark, b, -1)
            start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            rows = w.row[start]
            size = np.minimum(words, w.n[rows])
            span = size - k + 1
            shingle = base[rows] + start - w.bounds[rows]
            for lo in range(0, len(start), WINDOWS):
                c = slice(lo, lo + WINDOWS)
                bits = simhash(h, shingle[c], span[c])
                win, items, dist = ix.sizes[words].within(bits, ix.balls)
                for x, i, d in zip((win + lo).tolist(), items.tolist(), dist.tolist()):
                    both, all_ = similarity(h[shingle[x]:shingle[x] + span[x]], ix.weights(i))
                    if both * den >= num * all_:
                        place = (int(rows[x]), i)
                        got = (int(start[x] - w.bounds[rows[x]]), int(size[x]), both, all_, d)
                        old = out.get(place)
                        if old is None or (got[2] * old[3], -got[0]) > (old[2] * got[3], -old[0]):
                            out[place] = got
    return [(r, i, *v) for (r, i), v in sorted(out.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, num: int = MIN_SIM[0], den: int = MIN_SIM[1], id_col: str = "doc_id",
          text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item, start_word, n_words, similarity, hamming): for each row and
    each item it holds, the most similar window (ties: the first). Clean
    documents give no row.

    Null, empty or wordless texts and items match nothing. Repeated rows and
    items are reported each. A text shorter than an item is compared as one
    window. Other columns are not read.
    """
    common.ship(docs.sparkSession)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kinds = [src.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
    fields = f"id {kinds[0]}, item {kinds[1]}, start_word int, n_words int, similarity double, hamming int"
    out = None
    for shared in _blocks(benchmark, item_col):
        got = src.mapInArrow(_run(shared, num, den), fields)
        out = got if out is None else out.union(got)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def _blocks(benchmark: DataFrame, item_col: str) -> list:
    """The benchmark as broadcasts of about ITEM_BYTES of text each."""
    items = benchmark.select(benchmark[item_col].alias("item"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // ITEM_BYTES))
    out = []
    for part in range(passes):
        block = items.where(F.pmod(F.xxhash64("text", "item"), F.lit(passes)) == part).orderBy("item", "text").toArrow()
        out.append(benchmark.sparkSession.sparkContext.broadcast((block.column("item"), block.column("text").to_pylist(), uuid.uuid4().hex)))
    return out


def index_of(shared) -> ItemIndex:
    """The index of a broadcast block of items, made once per worker."""
    _, texts, mark = shared.value
    return wordcache.live(("items", mark), lambda: ItemIndex(texts))


def _run(shared, num, den):
    def run(batches):
        from hourcast.llm import common as c, decontam as d
        ids = shared.value[0]
        ix = d.index_of(shared)
        if not ix.sizes:
            return
        for b in c.slices(batches, "text"):
            got = d.search(pc.fill_null(b.column(1), ""), ix, num, den)
            if got:
                row, item, start, size, both, all_, dist = zip(*got)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), ids.combine_chunks().take(pa.array(item)), pa.array(start, pa.int32()),
                     pa.array(size, pa.int32()), pa.array(np.array(both) / np.array(all_)), pa.array(dist, pa.int32())],
                    names=["id", "item", "start_word", "n_words", "similarity", "hamming"])

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, num: int = MIN_SIM[0], den: int = MIN_SIM[1],
                  text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows, all columns unchanged, that hold no benchmark item. One pass
    per block of the benchmark, no shuffle; null texts stay."""
    common.ship(docs.sparkSession)
    place = docs.columns.index(text_col)
    for shared in _blocks(benchmark, item_col):
        docs = docs.mapInArrow(_clean(shared, num, den, text_col, place), docs.schema)
    return docs


def _clean(shared, num, den, text_col, place):
    def run(batches):
        from hourcast.llm import common as c, decontam as d
        ix = d.index_of(shared)
        for b in c.slices(batches, text_col):
            if ix.sizes:
                bad = {r for r, *_ in d.search(pc.fill_null(b.column(place), ""), ix, num, den)}
                if bad:
                    b = b.filter(pa.array([i not in bad for i in range(b.num_rows)]))
            yield b

    return run
