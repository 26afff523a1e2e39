"""Phrase collocations by Toivonen's sampling algorithm (operator 12).

1. A share of the rows is counted. Its phrases that reach a lowered threshold
   are the sample's proposal.
2. All rows are counted for the proposal and its negative border: every
   word, and every phrase both of whose parts one word shorter (all but the
   last word, all but the first) are in the proposal. Sums by a 64-bit hash
   come first: they are never below a phrase's own count, so they rule out
   what cannot be frequent; what is left is counted by the phrases themselves.
3. A border phrase that turns out frequent is a failure: it joins the
   proposal, and a further pass counts what its joining opens, and only that.
   Passes go on until none fails; then the frequent phrases are complete, as a
   phrase is never more frequent than its parts.

The proposal reaches the tasks as a bitmap of hashes, of bounded size
(``MAX_BITS``). Two phrases may share a bit; that opens more for counting and
drops nothing, since whether a phrase is counted in a pass depends on the
phrase alone and every count is over all rows.

Each slice of text is counted in arrays before Spark sums the rows, so a hot
phrase is one row of a slice. Joins with a hot part are salted, and the first
rows of a language are taken per salt first.

Defined cases: null text is empty; null lang is ``und``; the same row twice
counts twice; an empty table, or one without a frequent phrase, gives no rows;
only the language, the text and the sample's key are read, whatever the other
columns are called. A null key is a key like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hourcast.llm import common, wordcache
from hourcast.llm.common import mix
from hourcast.session import cut_lineage

#: bounds of a bitmap's bits, and bits per phrase between them; more phrases
#: than fit make it denser, which opens more for counting
MIN_BITS, MAX_BITS, BITS_EACH = 1 << 20, 1 << 28, 16
#: one row in SHARE is in the sample
SHARE = 4
#: copies of a phrase's parts in the score joins, and salts of the top rows
SALTS, TOP_SALTS = 4, 64
SLICE_BYTES = 3_000_000

# bytes: 0 in a word, 1 between words, 2 between pieces (fixed values)
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2


# one slice ---------------------------------------------------------------------
def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, first position of each code) of pairs of 64-bit hashes."""
    code, _ = pd.factorize(a)
    first = _first(code)
    if (b[first][code] != b).any():  # one key, two contents: by both
        code, _ = pd.factorize(pd.MultiIndex.from_arrays([a, b]))
        first = _first(code)
    return code, first


def _first(code: np.ndarray) -> np.ndarray:
    out = np.empty(int(code.max()) + 1 if len(code) else 0, np.int64)
    out[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return out


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all but its last word, and that word's."""
    return mix(h + np.uint64(0x9E3779B97F4A7C15), 3) ^ mix(word, 4)


def _keys(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, off = common.text_bytes(strings)
    return wordcache.piece_keys(raw, off[:-1], off[1:])


def _word_keys(raw, start, end, lang_a, lang_b):
    """Two hashes of each (language, word); not the same if the two change places."""
    a, b = wordcache.piece_keys(raw, start, end)
    return mix(a ^ mix(lang_a, 5), 1), mix(b + mix(lang_b, 6), 2)


class Slice:
    """Words of a batch of texts, and which of them follow each other in a piece."""

    def __init__(self, lang: pa.Array, text: pa.Array):
        raw, off = common.text_bytes(text)
        raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        self.raw = raw
        kind = _KIND[raw]
        white = kind > 0
        opens = np.ones(len(raw) + 1, bool)
        opens[1:len(raw)] = white[:-1]
        opens[off] = True
        opens[:len(raw)] &= ~white
        self.start = np.flatnonzero(opens[:len(raw)])
        stop = np.append(white, True)
        stop[off] = True
        stops = np.flatnonzero(stop)
        self.end = stops[np.searchsorted(stops, self.start, side="right")]
        self.row = np.searchsorted(off, self.start, side="right") - 1
        piece = np.cumsum(kind == 2)[self.start]
        self.follows = np.zeros(len(self.start), bool)  # the next word is in the same piece
        self.follows[:-1] = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])
        codes = lang.dictionary_encode()
        self.langs = codes.dictionary
        self.lang = codes.indices.to_numpy(zero_copy_only=False)[self.row] if len(self.row) else np.zeros(0, np.int64)
        la, lb = _keys(self.langs)
        self.a, b = _word_keys(raw, self.start, self.end, la[self.lang], lb[self.lang])
        self.code, self.first = _distinct(self.a, b)

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases of ``size`` words that begin with words ``at``."""
        src = np.append(self.raw, np.uint8(32))
        start = np.full((len(at), 2 * size - 1), len(self.raw), np.int64)
        length = np.ones((len(at), 2 * size - 1), np.int64)
        for j in range(size):
            start[:, 2 * j], length[:, 2 * j] = self.start[at + j], self.end[at + j] - self.start[at + j]
        data = wordcache.ragged_take(src, start.ravel(), length.ravel())
        ends = np.concatenate([[0], np.cumsum(length.sum(1))])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())

    def rows(self, at: np.ndarray, n: np.ndarray, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [self.langs.take(pa.array(self.lang[at])).cast(pa.string()), pa.array(np.full(len(at), size), pa.int32()),
             self.phrases(at, size), pa.array(n, pa.int64())], names=["lang", "size", "phrase", "n"])

    def counted(self, size: int, at: np.ndarray) -> pa.RecordBatch:
        """The distinct phrases of ``size`` words at words ``at``, counted."""
        code, _ = pd.factorize(self.code[at])
        for j in range(1, size):
            code, _ = pd.factorize(code * np.int64(len(self.first)) + self.code[at + j])
        return self.rows(at[_first(code)], np.bincount(code) if len(code) else code, size)


def count_slice(lang: pa.Array, text: pa.Array, max_words: int, open_: np.ndarray | None, before: np.ndarray | None = None,
                possible: np.ndarray | None = None, keys: bool = False):
    """Record batches of one slice: (lang, size, phrase, n), or with ``keys``
    (key, n) by the phrases' hashes.

    open_: the bitmap of the proposal (None: everything is counted); before:
    that of the pass before, whose phrases are left out; possible: a bitmap of
    hashes without which nothing is counted. The pass without ``before``
    counts words, and the words of each language (size 0).
    """
    s = Slice(lang, text)
    if not len(s.start):
        return
    valid, hash_ = np.ones(len(s.start), bool), s.a
    take = valid if before is None else ~valid
    if before is None and not keys:
        total = np.bincount(s.lang)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [s.langs.take(pa.array(used)).cast(pa.string()), pa.array(np.zeros(len(used)), pa.int32()),
             pa.array([""] * len(used), pa.string()), pa.array(total[used], pa.int64())], names=["lang", "size", "phrase", "n"])
    for size in range(1, max_words + 1):
        if size > 1:
            # parts of size - 1 words at each word, and at the next
            inside = valid & _in(open_, hash_) if open_ is not None else valid
            longer = np.zeros(len(valid), bool)
            longer[:-1] = s.follows[:-1] & valid[1:] & valid[:-1]
            take = longer.copy()
            take[:-1] &= inside[:-1] & inside[1:]
            if before is not None:
                old = valid & _in(before, hash_)
                take[:-1] &= ~(old[:-1] & old[1:])
            word = np.zeros(len(valid), np.uint64)
            word[:len(valid) - size + 1] = s.a[size - 1:]
            hash_, valid = _longer(hash_, word), longer
        at = np.flatnonzero(take)
        if possible is not None:
            at = at[_in(possible, hash_[at])]
        if not len(at):
            continue
        if keys:
            code, of = pd.factorize(hash_[at])
            yield pa.RecordBatch.from_arrays([pa.array(of.view(np.int64)), pa.array(np.bincount(code), pa.int64())], names=["key", "n"])
        else:
            yield s.counted(size, at)


def _in(bits: np.ndarray, hash_: np.ndarray) -> np.ndarray:
    cell = hash_ & np.uint64(8 * len(bits) - 1)
    return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def phrase_hashes(lang: pa.Array, phrase: pa.Array, size: int) -> np.ndarray:
    """The hashes that ``Slice`` gives phrases of ``size`` words."""
    raw, off = common.text_bytes(phrase)
    la, lb = _keys(lang)
    space = np.flatnonzero(raw == 32).reshape(len(lang), size - 1)
    edge = np.concatenate([off[:-1, None] - 1, space, off[1:, None]], 1)
    for j in range(size):
        a, _ = _word_keys(raw, edge[:, j] + 1, edge[:, j + 1], la, lb)
        out = a if j == 0 else _longer(out, a)
    return out


# passes ---------------------------------------------------------------------------
def _bits_for(n: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (BITS_EACH * max(n, 1) - 1).bit_length()))


def _marked(keys: DataFrame, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits of the column ``key``. The driver gets at most
    one row per 64 bits."""
    cell = F.col("key").bitwiseAND(F.lit(size - 1))
    words = keys.select(F.shiftright(cell, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63L AS int))").alias("bit")) \
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint8)


def _failures(phrases: DataFrame, max_words: int, open_) -> DataFrame:
    """(key): hashes of the frequent phrases that could open longer ones but
    are not in the proposal."""
    def run(batches):
        from hourcast.llm import collocations as m
        for b in batches:
            lang, size, phrase = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            for k in np.unique(size).tolist():
                of = pa.array(np.flatnonzero(size == k))
                h = m.phrase_hashes(lang.take(of), phrase.take(of), k)
                h = h[~m._in(open_.value, h)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["key"])

    return phrases.where(F.col("size").between(1, max_words - 1)).select("lang", "size", "phrase").mapInArrow(run, "key long")


def _count(src: DataFrame, fields: str, *args, **kwargs) -> DataFrame:
    def run(batches):
        from hourcast.llm import collocations as m, common as c
        for b in c.slices(batches, "text", m.SLICE_BYTES):
            yield from m.count_slice(b.column(0), b.column(1), args[0], *[a and a.value for a in args[1:]], **kwargs)

    return src.select("lang", "text").mapInArrow(run, fields)


def count_keys(src: DataFrame, max_words: int, open_=None) -> DataFrame:
    """(key, n): sums by the phrases' hashes over all rows of (lang, text)."""
    return _count(src, "key long, n long", max_words, open_, None, None, keys=True).groupBy("key").agg(F.sum("n").alias("n"))


def count_phrases(src: DataFrame, max_words: int, open_=None, before=None, possible=None) -> DataFrame:
    """(lang, size, phrase, n) over all rows of (lang, text); open_, before,
    possible: broadcasts of bitmaps, see ``count_slice``."""
    return _count(src, "lang string, size int, phrase string, n long", max_words, open_, before, possible) \
        .groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


@dataclass
class Mined:
    #: (lang, size, phrase, n): every frequent phrase with its exact count, and
    #: the number of all words of a language under size 0
    frequent: DataFrame
    #: rounds of counting, and the border failures found by each but the last
    passes: int
    failures: list[int]


def frequent_phrases(docs: DataFrame, min_count: int = 10, max_words: int = 3, share: int = SHARE,
                     lang_col: str = "lang", text_col: str = "text", key_col: str | None = "doc_id") -> Mined:
    """Every phrase of 1 to ``max_words`` words that occurs ``min_count``
    times or more in its language. ``key_col`` deals rows into the sample
    (None: the text does); it decides speed, never the result."""
    spark = docs.sparkSession
    common.ship(spark)
    src = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"),
                      F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
                      F.xxhash64(docs[key_col or text_col]).alias("key"))
    lowered = max(2, int(0.8 * min_count / share))
    send = spark.sparkContext.broadcast
    sample = src.where(F.pmod(F.col("key"), F.lit(share)) == 0)
    proposed = cut_lineage(count_keys(sample, max_words - 1).where(F.col("n") >= lowered))
    size = _bits_for(proposed.count())
    open_ = send(_marked(proposed, size))
    able = cut_lineage(count_keys(src, max_words, open_).where(F.col("n") >= min_count))
    possible = send(_marked(able, _bits_for(4 * able.count())))
    enough = (F.col("size") == 0) | (F.col("n") >= min_count)
    new = cut_lineage(count_phrases(src, max_words, open_, None, possible).where(enough))
    found, failures = new, []
    while True:
        missed = cut_lineage(_failures(new, max_words, open_))
        n = missed.count()
        if not n:
            return Mined(found, len(failures) + 1, failures)
        failures.append(n)
        before, open_ = open_, send(open_.value | _marked(missed, size))
        new = cut_lineage(count_phrases(src, max_words, open_, before).where(enough))
        found = found.unionByName(new)


# scores -----------------------------------------------------------------------------
def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def collocations(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the frequent phrases of two words or
    more that no longer one with at least half their count holds."""
    cand = frequent.where("size >= 2").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    size = F.size("w")
    part = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, size - F.col("k")).alias("right"),
        F.pmod(F.hash("phrase"), F.lit(SALTS)).alias("salt"))
    parts = _salted(frequent.where("size >= 1"))
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), "salt", F.col("n").alias(n)), ["lang", side, "salt"])

    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div "
                   "(CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # contiguous parts of two words or more, with the largest count above them
    inner = cand.where(size > 2).withColumn("m", F.explode(F.sequence(F.lit(2), size - 1))) \
        .withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1))) \
        .select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("above").isNull() | (100 * F.col("above") < 50 * F.col("a")))
    return kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def top(scored: DataFrame, frequent: DataFrame, limit: int = 2000) -> DataFrame:
    """Each language's first ``limit``, with rank and its number of words.
    The best of each salt first, so that no task holds a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = scored.withColumn("salt", F.pmod(F.hash("phrase", "lang"), F.lit(TOP_SALTS))) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= limit)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")) \
        .where(F.col("rank") <= limit)
    total = frequent.where("size = 0").select("lang", "n")
    return out.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, min_count: int = 10, max_words: int = 3, limit: int = 2000, **columns) -> DataFrame:
    found = frequent_phrases(docs, min_count, max_words, **columns).frequent
    return top(collocations(found), found, limit)
