"""Spelling variants by dense prefix-suffix tiling (operator 13).

Two words are near if one inserted, deleted or replaced code point parts them.
With K the length of the longer one, that is so when the lengths of their
common prefix and common suffix reach K - 1 together. Words stand as rows of
padded code-point matrices, flush left for prefixes and flush right for
suffixes, and blocks of rows are compared with blocks of rows.

Which blocks meet: the place of the edit in the longer word lies in its first
or its second half, so the words share a suffix or a prefix of about K / 2.
Each word goes to the blocks of both halves for K = its length (as the longer
or an equal) and K = its length + 1 (as the shorter). A block with more than
``BLOCK`` words is split by the place of the edit itself: its words then agree
in all but one place, so one such block holds at most one word per letter and
the one without it. A pair counts in the one block that has its common prefix's
end, so nothing needs to be made distinct, and no group is compared whole.

Defined cases: null text has no runs; a null id is written as the empty string
before the colon; the same row twice counts twice; words without a near word
have form null, n_near 0 and themselves as root; an empty table gives no rows;
only the id and the text are read, whatever the other columns are called.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hourcast.llm import collocations, common, wordcache
from hourcast.session import cut_lineage

#: most words of a half block; larger ones are split by place
BLOCK = 1500
#: most pairs of one tile, and code points of its pairs
TILE = 200_000
MATRIX = 4_000_000
#: a run whose hash is divisible by this loses a code point
DAMAGE = 31
MIN_LETTERS, MIN_COUNT, FORM_RATIO = 7, 2, 10

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


# words of texts -------------------------------------------------------------------
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


_CRC = _crc_table()


def _crc_after(state: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """zlib's crc32 of each range, from the crc of what stands before it."""
    state = state ^ np.uint32(0xFFFFFFFF)
    at, k = np.arange(len(start)), 0
    while len(at):
        state[at] = _CRC[(state[at] ^ raw[start[at] + k]) & np.uint32(0xFF)] ^ (state[at] >> np.uint32(8))
        k += 1
        at = at[size[at] > k]
    return state ^ np.uint32(0xFFFFFFFF)


def runs(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, text, start, end) of the maximal runs of ASCII
    letters and U+00C0..U+00FF, which are the lead byte C3 and one more."""
    raw, off = common.text_bytes(text)
    raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    inside = _LETTER[raw]
    lead = raw == 0xC3
    inside |= lead
    inside[1:] |= lead[:-1]
    opens = np.ones(len(raw) + 1, bool)
    opens[1:len(raw)] = ~inside[:-1]
    opens[off] = True
    opens[:len(raw)] &= inside
    start = np.flatnonzero(opens[:len(raw)])
    stop = np.append(~inside, True)
    stop[off] = True
    stops = np.flatnonzero(stop)
    return raw, np.searchsorted(off, start, side="right") - 1, start, stops[np.searchsorted(stops, start, side="right")]


def count_slice(ids: list, text: pa.Array, min_letters: int, damage: int) -> pa.RecordBatch:
    """(word, n): the distinct words of a slice of at least ``min_letters``."""
    raw, row, start, end = runs(text)
    letters = (end - start) - (np.concatenate([[0], np.cumsum(raw == 0xC3)])[end] - np.concatenate([[0], np.cumsum(raw == 0xC3)])[start])
    long = letters >= min_letters
    row, start, end, letters = row[long], start[long], end[long], letters[long]
    before = np.array([zlib.crc32((("" if i is None else str(i)) + ":").encode()) for i in ids], np.uint32)
    crc = _crc_after(before[row], raw, start, end - start)
    hit = np.flatnonzero(crc % np.uint32(damage) == 0)
    data, extra = raw.tobytes(), {}
    for i in hit[letters[hit] > min_letters].tolist():
        w = data[start[i]:end[i]].decode()
        at = int(crc[i]) % len(w)
        w = w[:at] + w[at + 1:]
        extra[w] = extra.get(w, 0) + 1
    whole = np.ones(len(start), bool)
    whole[hit] = False
    start, end = start[whole], end[whole]
    code, first = collocations._distinct(*wordcache.piece_keys(raw, start, end))
    size = (end - start)[first]
    ends = np.concatenate([[0], np.cumsum(size)])
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(wordcache.ragged_take(raw, start[first], size)))
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([words.cast(pa.string()), pa.array(list(extra), pa.string())]),
         pa.concat_arrays([pa.array(np.bincount(code, minlength=0), pa.int64()), pa.array(list(extra.values()), pa.int64())])],
        names=["word", "n"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS,
                min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): the words of all texts that occur ``min_count`` times or more."""
    common.ship(docs.sparkSession)
    src = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches):
        from hourcast.llm import common as c, spelling as m
        for b in c.slices(batches, "text"):
            yield m.count_slice(b.column(0).to_pylist(), b.column(1), min_letters, damage)

    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# blocks -----------------------------------------------------------------------------
#: a block: the length k of the longer word, the range lo..hi-1 of the edit's
#: place in it, and a hash of the prefix before and the suffix behind that range
KEY = ["k", "lo", "hi", "h"]


def _blocks_by(rows: DataFrame) -> DataFrame:
    """(k, lo, hi, h, word, n) of rows with word, n, k, lo and hi. Blocks whose
    hashes agree meet for nothing: a pair counts only if its words really
    share the prefix and the suffix."""
    tail = F.col("k") - F.col("hi")
    return rows.select("k", "lo", "hi", F.xxhash64(
        F.substring(F.col("word"), F.lit(1), F.col("lo")),
        F.when(tail > 0, F.substring(F.col("word"), F.char_length("word") - tail + 1, tail)).otherwise("")).alias("h"), "word", "n")


def _halves(words: DataFrame) -> DataFrame:
    size, mid = F.char_length("word"), F.floor(F.col("k") / 2).cast("int")
    lo = F.when(F.col("half") == 0, 0).otherwise(mid)
    hi = F.when(F.col("half") == 0, mid).otherwise(F.col("k"))
    out = words.withColumn("k", F.explode(F.array(size, size + 1))).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    return _blocks_by(out.withColumn("lo", lo).withColumn("hi", hi))


def _places(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("lo", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
    return _blocks_by(out.withColumn("hi", F.col("lo") + 1))


class Matrix:
    """Words as rows of code points, flush left and flush right."""

    def __init__(self, words: list[str], width: int):
        self.size = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        col = np.arange(len(points)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        row = np.repeat(np.arange(len(words)), self.size)
        self.left = np.zeros((len(words), width), np.uint32)
        self.left[row, col] = points
        self.right = np.zeros((len(words), width), np.uint32)
        self.right[row, self.size[row] - 1 - col] = points

    def near(self, i: np.ndarray, j: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether rows i and j (the longer: k code points) are a single edit
        apart whose place, the end of the common prefix, is in lo..hi-1."""
        short = np.minimum(self.size[i], self.size[j])  # padding agrees with padding
        prefix = np.minimum(_leading(self.left[i] == self.left[j]), short)
        suffix = np.minimum(_leading(self.right[i] == self.right[j]), short)
        return (prefix + suffix >= k - 1) & (prefix >= lo) & (prefix < hi) & (np.maximum(self.size[i], self.size[j]) == k)


def _leading(equal: np.ndarray) -> np.ndarray:
    """Number of True before the first False of each row."""
    first = np.argmin(equal, 1)
    return np.where(equal[np.arange(len(equal)), first], equal.shape[1], first)


def compare_blocks(words: list[str], k: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: np.ndarray):
    """Index arrays (i, j), i < j, of near words among rows ordered by block.
    A tile takes the next pairs of rows of equal blocks, as many as keep its
    matrices small, whatever the number or length of the words."""
    fan = np.searchsorted(block, block, side="right") - np.arange(len(block)) - 1  # partners behind each row
    done = np.cumsum(fan)
    at, total = 0, int(done[-1]) if len(done) else 0
    while at < total:
        first = int(np.searchsorted(done, at, side="right"))
        width = int(k[first])
        end = min(total, at + max(1, min(TILE, MATRIX // (width + 1))))
        last = int(np.searchsorted(done, end - 1, side="right"))
        much = np.flatnonzero(k[first:last + 1] > 2 * width)
        if len(much):  # longer words go into tiles of their own
            end = int(done[first + much[0] - 1])
        pair = np.arange(at, end)
        i = np.searchsorted(done, pair, side="right")
        j = i + 1 + pair - (done[i] - fan[i])
        rows, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        m = Matrix([words[r] for r in rows.tolist()], int(k[rows].max()) + 1)
        ok = m.near(place[:len(i)], place[len(i):], k[i], lo[i], hi[i])
        yield i[ok], j[ok]
        at = end


def _pairs_of(blocks: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways, of the near pairs in blocks; the
    rows of a block come to one partition, next to each other."""
    def run(batches):
        from hourcast.llm import spelling as m

        def compared(rows):
            key = [rows.column(c).to_numpy() for c in m.KEY]
            block = np.concatenate([[0], np.cumsum(np.any([c[1:] != c[:-1] for c in key], 0))])
            w, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
            for i, j in m.compare_blocks(w.to_pylist(), *key[:3], block):
                a, b = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
                yield pa.RecordBatch.from_arrays([w.take(a), n.take(a), w.take(b), n.take(b)], names=["word", "n", "other", "other_n"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held else rows
            key = [held.column(c).to_numpy() for c in m.KEY]
            cut = np.flatnonzero(np.any([c != c[-1] for c in key], 0))
            if len(cut):  # the last block may go on in the next batch
                yield from compared(held.slice(0, int(cut[-1]) + 1))
                held = held.slice(int(cut[-1]) + 1)
        if held:
            yield from compared(held)

    dealt = blocks.repartition(*KEY).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(run, "word string, n long, other string, other_n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways, of all near words of (word, n);
    words are distinct. A word has at most one near word per place and letter."""
    common.ship(words.sparkSession)
    rows = _halves(words)
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("members"))
    rows = rows.join(cut_lineage(sizes.where(F.col("members") > 1)), KEY)  # a word alone in its block has no pair there
    return _pairs_of(rows.where(F.col("members") <= BLOCK).drop("members").unionByName(
        _places(rows.where(F.col("members") > BLOCK).drop("members"))))


# groups -------------------------------------------------------------------------------
def variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all (word, n).

    The form is the near word of largest n (ties: the first in code-point
    order) if that is at least ``ratio`` times the word's n. Chains of forms
    grow by that factor each step, so they end and are short.
    """
    best = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    got = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                  F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best")).alias("best"))
    got = cut_lineage(got.select("word", "n", "n_near", F.col("best.w").alias("form"), (-F.col("best.m")).alias("form_n")))
    up = cut_lineage(got.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # pointer jumping: steps double
        nxt = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = up.join(nxt, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = cut_lineage(jumped)
        up = jumped.select("word", "root")
        if jumped.where("moved").limit(1).count() == 0:
            break
    return got.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
