"""Byte-level BPE encoding and decoding (operator 11).

A batch of texts is cut into pre-tokens with array operations. Tier one: a
minimal perfect hash over the vocabulary gives every pre-token one slot, and
its bytes are compared with the slot's token; equal ones are that token. Tier
two: the others are merged with a heap of pairs over a doubly linked list of
bytes, lowest rank first, leftmost among equals. Decoding is one gather of
token bytes by id.

Both tiers see every pre-token of every whole text. What tier two found is
remembered per worker, at most ``LIMIT`` distinct pre-tokens; a full memory
starts anew, which changes speed only.

Defined cases: null text is empty and has no ids; rows are kept as they come
(repeated and null ids included); an empty table gives no rows; columns other
than the id and the text are not read, whatever their names. A pre-token of
any length is merged in O(n log n).
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from hourcast.llm import common, wordcache
from hourcast.llm.common import mix

LIMIT = 500_000
#: bits of a level of the perfect hash per key that is left
GAMMA = 2.0

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 0


# the perfect hash --------------------------------------------------------------
class PerfectHash:
    """Distinct 64-bit keys -> 0..n-1, one slot each and no slot free.

    Level by level, keys that fall alone on a bit take it and the others go
    on to the next, smaller level; a key's slot is the number of set bits
    before its own. A key that was not in the set gets any slot or -1.
    """

    def __init__(self, keys: np.ndarray):
        bits, self.levels, at = [], [], 0
        rest = keys
        while len(rest):
            size = max(64, int(GAMMA * len(rest)))
            self.levels.append((at, size))
            place = self._place(rest, len(self.levels) - 1)
            alone = np.bincount(place, minlength=size) == 1
            bits.append(alone)
            rest = rest[~alone[place]]
            at += size
        set_ = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.slot = np.where(set_, np.cumsum(set_) - 1, -1).astype(np.int32)

    def _place(self, keys: np.ndarray, level: int) -> np.ndarray:
        return (mix(keys, 100 + level) % np.uint64(self.levels[level][1])).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for level, (at, _) in enumerate(self.levels):
            if not len(left):
                break
            got = self.slot[at + self._place(keys[left], level)]
            out[left] = got
            left = left[got < 0]
        return out


def _blocks(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number (zeros beyond the end)."""
    pad = np.zeros(len(raw) + 8, np.uint8)
    pad[:len(raw)] = raw
    return np.ndarray((len(raw) + 1,), np.uint64, pad, strides=(1,))


def _masked(block: np.ndarray, left: np.ndarray) -> np.ndarray:
    short = np.flatnonzero(left < 8)
    block[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
    return block


def range_keys(view: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes a step."""
    key = size.astype(np.uint64)
    at, k = np.arange(len(start)), 0
    while len(at):
        left = size[at] - 8 * k
        block = _masked(view[start[at] + 8 * k], left)
        if k == 0:
            key = mix(key ^ block, seed)
        else:
            key[at] = mix(key[at] ^ block, seed)
        at = at[left > 8]
        k += 1
    return key


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ranges of equal size hold equal bytes (a, b: block views)."""
    out = np.ones(len(size), bool)
    at, k = np.arange(len(size)), 0
    while len(at):
        left = size[at] - 8 * k
        ok = _masked(a[a_start[at] + 8 * k], left) == _masked(b[b_start[at] + 8 * k], left)
        out[at[~ok]] = False
        at = at[ok & (left > 8)]
        k += 1
    return out


# the vocabulary ------------------------------------------------------------------
def read_ranks(path: str) -> tuple[list[bytes], np.ndarray]:
    """Tokens and their ids from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    return [base64.b64decode(t) for t, _ in rows], np.array([int(r) for _, r in rows], np.int64)


class Vocabulary:
    """Tokens by slot of their perfect hash, by id, and ranks by bytes."""

    def __init__(self, path: str):
        tokens, ids = read_ranks(path)
        self.rank = dict(zip(tokens, ids.tolist()))
        size = np.array([len(t) for t in tokens], np.int64)
        self.longest = int(size.max(initial=0))
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        start = np.cumsum(size) - size
        view = _blocks(raw)
        for self.seed in range(1, 100):  # until no two tokens share a key
            keys = range_keys(view, start, size, self.seed)
            if len(np.unique(keys)) == len(keys):
                break
        else:
            raise ValueError("the vocabulary holds a token twice")
        self.hash = PerfectHash(keys)
        order = np.empty(len(keys), np.int64)
        order[self.hash.slots(keys)] = np.arange(len(keys))
        self.view, self.start, self.size, self.id = view, start[order], size[order], ids[order]
        self.n_ids = int(ids.max(initial=-1)) + 1
        # by id, for decoding
        self.raw = raw
        self.id_start, self.id_size = np.zeros(self.n_ids, np.int64), np.full(self.n_ids, -1, np.int64)
        self.id_start[ids], self.id_size[ids] = start, size

    def find(self, view: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Tier one: the id of every range that is a token, else -1."""
        slot = self.hash.slots(keys)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[self.size[slot[hit]] == size[hit]]
        s = slot[hit]
        hit = hit[same_bytes(view, start[hit], self.view, self.start[s], size[hit])]
        out = np.full(len(start), -1, np.int64)
        out[hit] = self.id[slot[hit]]
        return out

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all sequences, bytes of each); n: ids of each sequence."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n_ids or (self.id_size[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        size = self.id_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        cut = np.concatenate([[0], np.cumsum(n)])
        return wordcache.ragged_take(self.raw, self.id_start[ids], size), np.diff(ends[cut])


def heap_merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Tier two: ids of a pre-token. ``end[i]`` is where the symbol that
    starts at byte i ends (0: none starts there), ``before[i]`` where the one
    in front of it starts."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get(piece[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, m, e = heappop(heap)
        if end[i] != m or end[m] != e:
            continue  # one of the two has been merged with another since
        end[i], end[m] = e, 0
        if e < n:
            before[e] = i
            if (r := rank.get(piece[i:end[e]])) is not None:
                heappush(heap, (r, i, e, end[e]))
        if i:
            b = before[i]
            if (r := rank.get(piece[b:e])) is not None:
                heappush(heap, (r, b, i, e))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i:end[i]]])
        i = end[i]
    return out


# pre-tokens ------------------------------------------------------------------------
@lru_cache(1)
def char_classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point. Libraries
    carry different versions of Unicode; where two of them disagree, the
    answer of the tokenizer's own pattern counts: only behind a letter or a
    number is an ending cut off."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    points = np.array(points)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start():m.end()]] = kind
    here = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in text], np.uint8)
    odd = points[(here != out[points]) & (out[points] != SPACE)]
    if len(odd):
        import public_tokenizers
        import tiktoken
        probe = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                  mergeable_ranks={bytes([i]): i for i in range(256)} | {b"'s": 256})
        for c in odd.tolist():
            if 256 not in probe.encode_ordinary(chr(c) + "'s"):
                out[c] = OTHER
            elif out[c] == OTHER:
                out[c] = LETTER if unicodedata.category(chr(c))[0] == "L" else NUMBER
    return out


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, first byte) of every character of UTF-8 bytes."""
    if not (raw >= 128).any():
        return raw.astype(np.int32), np.arange(len(raw))
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    point = raw[at].astype(np.int32)
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        of = np.flatnonzero((point >= low) & (point < high) & (raw[at] >= low))
        if len(of):
            p = point[of] & mask
            for j in range(1, more + 1):
                p = p << 6 | (raw[at[of] + j] & 0x3F)
            point[of] = p
    return point, at


def pretokens(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First byte of every pre-token of texts that lie back to back (a
    pre-token ends where the next begins), as ``public_tokenizers.PATTERN``
    cuts them: runs of letters, numbers or others with one space in front,
    the short English endings after an apostrophe, and white space, whose last
    character stays apart when something follows."""
    point, at = code_points(raw)
    n = len(point)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[point]
    text = np.zeros(n + 1, bool)  # a text starts here
    text[np.searchsorted(at, off)] = True
    text[n] = True
    run = text.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    starts = run.copy()
    first = np.flatnonzero(run)
    white = np.flatnonzero(kind[first[:-1]] == SPACE)
    nxt = first[white + 1]
    inside = ~text[nxt]  # something follows in the same text
    nxt = nxt[inside]
    starts[nxt - 1] = True
    starts[nxt[point[nxt - 1] == 32]] = False
    # 's 't 'm 'd 're 've 'll, unless a space in front has taken the apostrophe
    p = np.flatnonzero((point == 39) & starts[:n])
    p = p[p + 1 < n]
    p = p[run[p] & run[p + 1] & ~text[p + 1]]
    a = point[p + 1]
    one = np.isin(a, [ord(c) for c in "stmd"])
    b = point[np.minimum(p + 2, n - 1)]
    two = (p + 2 < n) & ~run[np.minimum(p + 2, n)] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e")))
                                                       | ((a == ord("l")) & (b == ord("l"))))
    starts[p[one | two] + 1] = False
    starts[p[one] + 2] = True
    starts[p[two] + 3] = True
    return at[np.flatnonzero(starts[:n])]


# encoding ---------------------------------------------------------------------------
class Encoder:
    """Both tiers, and the memory of what tier two found."""

    def __init__(self, path: str, limit: int = LIMIT):
        self.vocabulary, self.limit = Vocabulary(path), limit
        # ids of a pre-token: a range of the pool, which opens with every id alone
        self.fixed = self.vocabulary.n_ids
        self.pool = np.concatenate([np.arange(self.fixed, dtype=np.int32), np.zeros(1 << 16, np.int32)])
        self.forget()

    def forget(self):
        self.known: dict[bytes, tuple[int, int]] = {}
        self.used = self.fixed

    def _merged(self, piece: bytes) -> tuple[int, int]:
        got = self.known.get(piece)
        if got is None:
            ids = heap_merge(piece, self.vocabulary.rank)
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), np.int32)])
            self.pool[self.used:self.used + len(ids)] = ids
            got = self.known[piece] = self.used, len(ids)
            self.used += len(ids)
        return got

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each)."""
        raw, off = common.text_bytes(col)
        start = pretokens(raw, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        if len(self.known) > self.limit:
            self.forget()
        view = _blocks(raw)
        size = np.diff(start, append=len(raw))
        v = self.vocabulary
        keys = np.zeros(len(start), np.uint64)
        short = np.flatnonzero(size <= v.longest)
        keys[short] = range_keys(view, start[short], size[short], v.seed)
        at = np.full(len(start), -1, np.int64)
        at[short] = v.find(view, start[short], size[short], keys[short])
        length = np.ones(len(start), np.int64)
        miss = short[at[short] < 0]
        if len(miss):
            # equal ones together; a range whose key lies goes alone
            code, _ = pd.factorize(keys[miss])
            head = np.empty(int(code.max()) + 1, np.int64)
            head[code[::-1]] = miss[::-1]
            true = size[head[code]] == size[miss]
            true[true] = same_bytes(view, start[head[code[true]]], view, start[miss[true]], size[miss[true]])
            data = raw.tobytes()
            got = np.array([self._merged(data[s:s + k]) for s, k in zip(start[head].tolist(), size[head].tolist())], np.int64)
            at[miss], length[miss] = got[code, 0], got[code, 1]
            miss = miss[~true]
        alone = np.concatenate([miss, np.flatnonzero(size > v.longest)])
        for i in alone.tolist():
            at[i], length[i] = self._merged(raw[start[i]:start[i] + size[i]].tobytes())
        ids = wordcache.ragged_take(self.pool, at, length)
        ends = np.concatenate([[0], np.cumsum(length)])
        cut = np.searchsorted(start, off)
        return ids, ends[cut[1:]] - ends[cut[:-1]]


def _encoder(path: str) -> Encoder:
    return wordcache.live(("byte_bpe", path), lambda: Encoder(path))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text, one row per row."""
    common.ship(docs.sparkSession)
    src = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        from hourcast.llm import byte_bpe as b, common as c
        enc = b._encoder(path)
        for s in c.slices(batches, "text"):
            ids, n = enc.encode(s.column(1))
            yield pa.RecordBatch.from_arrays([s.column(0), c.list_array(ids, np.concatenate([[0], np.cumsum(n)]), pa.int32())],
                                             names=["id", "ids"])

    return src.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """The frame with the bytes of its ids in ``bytes_col`` (ids in the middle
    of a character give bytes that are not UTF-8, so no text). Null ids give
    null; an id outside the vocabulary raises."""
    common.ship(encoded.sparkSession)
    cols = [c for c in encoded.columns if c != bytes_col]
    src = encoded.select(*cols)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)

    def run(batches):
        from hourcast.llm import byte_bpe as b
        v = b._encoder(path).vocabulary
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                s = batch.slice(lo, 500)
                col = s.column(s.schema.get_field_index(ids_col))
                n = np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                raw, size = v.decode(col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
                ends = np.concatenate([[0], np.cumsum(size)]).tolist()
                data = raw.tobytes()
                out = [data[i:j] if ok else None for i, j, ok in zip(ends, ends[1:], col.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(out, pa.binary())], names=[*s.schema.names, bytes_col])

    return src.mapInArrow(run, f"{fields}, `{bytes_col}` binary")


def digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of an encoded and decoded frame."""
    return encoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
