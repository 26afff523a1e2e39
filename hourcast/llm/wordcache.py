"""Encode the distinct pieces of a batch once and remember them per worker.

Tokenizers take a text apart before they merge, so its ids are the
concatenation of its pieces' ids, and each distinct piece is encoded once.
The memory is bounded by ``limit`` entries; a full one starts anew, which
changes speed only.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from hourcast.llm.common import mix, text_bytes

LIMIT = 700_000
#: chunks that one call to the tokenizer takes
JOINED = 500

#: what one worker process keeps; the objects of one operator at a time
_LIVE: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def live(key, make):
    """The worker's object for ``key``, made on first use; the one of another
    key is dropped, so that workers which serve several operators hold one."""
    if key not in _LIVE:
        _LIVE.clear()
        _LIVE[key] = make()
    return _LIVE[key]


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def tokenizer_cache(path: str, encoder):
    """(tokenizer, PieceIds) of a tokenizers file."""

    def make():
        tok = load_tokenizer(path)
        return tok, PieceIds(encoder(tok))

    return live(("ids", path), make)


def _split_joined(tok, chunks: list[str], glue: str, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per chunk): the chunks are encoded JOINED at a time, with a
    glue that becomes exactly one token, which no chunk holds."""
    texts = [glue.join(chunks[i:i + JOINED]) for i in range(0, len(chunks), JOINED)]
    got = [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    for i in range(len(got)):
        got[i] = np.append(got[i], np.uint32(mark))
    flat = np.concatenate(got)
    ends = np.flatnonzero(flat == mark)
    return flat[flat != mark], np.diff(ends, prepend=-1) - 1


def words_encoder(tok):
    """Chunks of a tokenizer that drops white space: a lone BEL between
    spaces is a token of its own."""
    mark = tok.encode("\x07", add_special_tokens=False).ids[0]

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, c in enumerate(chunks) if "\x07" in c]
        return _with_odd(tok, chunks, odd, lambda xs: _split_joined(tok, xs, " \x07 ", mark))

    return encode


def bytes_encoder(tok):
    """Chunks of a byte-level tokenizer, at most one white space character
    in a row: a line feed between chunks is a token of its own, and so is one
    at a chunk's start."""
    mark = tok.encode("\n", add_special_tokens=False).ids[0]

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        feed = np.array([c[:1] == "\n" for c in chunks], bool)
        body = [c[1:] if f else c for c, f in zip(chunks, feed)]
        odd = [i for i, c in enumerate(body) if not c or "\n" in c]
        flat, n = _with_odd(tok, body, odd, lambda xs: _split_joined(tok, xs, "\n", mark))
        at = (np.cumsum(n) - n)[feed]
        return np.insert(flat, at, np.uint32(mark)), n + feed

    return encode


def _with_odd(tok, chunks, odd, joined) -> tuple[np.ndarray, np.ndarray]:
    """The joined way for all chunks but the odd ones, which go one by one."""
    if not odd:
        return joined(chunks)
    skip = set(odd)
    rest = [c for i, c in enumerate(chunks) if i not in skip]
    n = np.zeros(len(chunks), np.int64)
    is_odd = np.zeros(len(chunks), bool)
    is_odd[odd] = True
    flat, lens = joined(rest) if rest else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    n[~is_odd] = lens
    alone = [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast([chunks[i] for i in odd], add_special_tokens=False)]
    n[is_odd] = [len(a) for a in alone]
    out = np.empty(int(n.sum()), np.uint32)
    of = np.repeat(is_odd, n)
    out[~of] = flat
    out[of] = np.concatenate(alone)
    return out, n


# classes of bytes: pre-token patterns always part letters, digits and
# symbols; an apostrophe may bind to letters, and bytes beyond ASCII may be
# of any class, so nothing is cut beside those
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[39] = 0
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_FEED = np.zeros(256, bool)
_FEED[[10, 32]] = True


def pieces(raw: np.ndarray, off: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the pieces of texts that lie back to back.

    words: runs without space and line feed. split: runs without ASCII white
    space, cut where letters, digits and symbols meet. bytes: the same cuts,
    but all bytes are kept: a space opens the piece that follows, any other
    white space is a piece.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = (_FEED if mode == "words" else _WHITE)[raw]
    open_ = np.zeros(n, bool)  # a piece starts here
    open_[off[:-1][off[:-1] < n]] = True
    if mode != "words":
        cls = _CLASS[raw]
        open_[1:] |= (cls[1:] != cls[:-1]) & (cls[1:] > 0) & (cls[:-1] > 0)
    if mode == "bytes":
        open_ |= white
        open_[1:] |= white[:-1] & (raw[:-1] != 32)
        start = np.flatnonzero(open_)
        return start, np.append(start[1:], n)
    open_[1:] |= white[:-1]
    open_ &= ~white
    start = np.flatnonzero(open_)
    stop = white.copy()
    stop[start] = True
    ends = np.append(np.flatnonzero(stop), n)
    return start, ends[np.searchsorted(ends, start, side="right")]


def piece_keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each piece, eight bytes a step."""
    pad = np.zeros(len(raw) + 8, np.uint8)
    pad[:len(raw)] = raw
    view = np.ndarray((len(raw) + 1,), np.uint64, pad, strides=(1,))
    size = end - start
    a, b = size.astype(np.uint64), mix(size.astype(np.uint64), 11)
    at = np.arange(len(start))
    k = 0
    while len(at):
        left = size[at] - 8 * k
        block = view[start[at] + 8 * k]
        short = np.flatnonzero(left < 8)
        block[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        if k == 0:
            a, b = mix(a ^ block, 21), mix(b + block, 22)
        else:
            a[at], b[at] = mix(a[at] ^ block, 21), mix(b[at] + block, 22)
        at = at[left > 8]
        k += 1
    return a, b


class PieceIds:
    """piece -> token ids, at most ``limit`` pieces. encode: pieces -> (ids,
    ids per piece). Pieces are known by two 64-bit hashes; the first finds,
    the second confirms."""

    def __init__(self, encode, limit: int = LIMIT):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self):
        self.key = np.zeros(0, np.uint64)  # ascending
        self.check = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _find(self, a, b):
        if not len(self.key):
            return np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        at = np.searchsorted(self.key, a)
        at[at == len(self.key)] = 0
        return (self.key[at] == a) & (self.check[at] == b), at

    def slots(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slot of every piece; new ones are encoded together."""
        if len(self.key) > self.limit:
            self.clear()
        a, b = piece_keys(raw, start, end)
        code, _ = pd.factorize(a)
        first = np.empty(int(code.max()) + 1 if len(code) else 0, np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        if len(first) and (b[first][code] != b).any():  # two pieces with one key: by both hashes
            code, _ = pd.factorize(pd.MultiIndex.from_arrays([a, b]))
            first = np.empty(int(code.max()) + 1, np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        ua, ub = a[first], b[first]
        known, at = self._find(ua, ub)
        out = np.zeros(len(first), np.int64)
        out[known] = self.slot[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            data = raw.tobytes()
            flat, lens = self.encode([data[s:e].decode() for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[:self.used], np.zeros(max(len(flat), self.used), np.uint32)])
            self.ids[self.used:self.used + len(flat)] = flat
            out[new] = len(self.start) + np.arange(len(new))
            self.start = np.append(self.start, self.used + np.cumsum(lens) - lens)
            self.length = np.append(self.length, lens)
            self.used += len(flat)
            order = new[np.argsort(ua[new], kind="stable")]
            # a key that is there with another check stays out: encoded each time
            fresh = np.concatenate([[True], ua[order][1:] != ua[order][:-1]])
            place = np.searchsorted(self.key, ua[order])
            if len(self.key):
                fresh &= self.key[np.minimum(place, len(self.key) - 1)] != ua[order]
            order, place = order[fresh], place[fresh]
            self.key = np.insert(self.key, place, ua[order])
            self.check = np.insert(self.check, place, ub[order])
            self.slot = np.insert(self.slot, place, out[order])
        return out[code]


def ragged_take(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of values[start[i] : start[i] + length[i]]."""
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    at = np.arange(total) + np.repeat(start - (end - length), length)
    return values[at]


def encode_texts(col: pa.Array, cache: PieceIds, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids per text), by the pieces of ``mode``."""
    raw, off = text_bytes(col)
    start, end = pieces(raw, off, mode)
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
    slot = cache.slots(raw, start, end)
    length = cache.length[slot]
    ids = ragged_take(cache.ids, cache.start[slot], length)
    ends = np.concatenate([[0], np.cumsum(length)])
    cut = np.searchsorted(start, off)
    return ids, ends[cut[1:]] - ends[cut[:-1]]


def encode_exact(col: pa.Array, cache: PieceIds, tok, mode: str, awkward: str) -> tuple[np.ndarray, np.ndarray]:
    """encode_texts for all texts but those that match the RE2 pattern
    ``awkward``, where pieces depend on their neighbours: these are encoded
    whole."""
    hard = pc.match_substring_regex(col, awkward).to_numpy(zero_copy_only=False)
    if not hard.any():
        return encode_texts(col, cache, mode)
    easy = np.flatnonzero(~hard)
    ids, n = encode_texts(col.take(pa.array(easy)), cache, mode) if len(easy) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    whole = [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(col.take(pa.array(np.flatnonzero(hard))).to_pylist(), add_special_tokens=False)]
    count = np.zeros(len(col), np.int64)
    count[easy] = n
    count[hard] = [len(w) for w in whole]
    out = np.empty(int(count.sum()), np.uint32)
    of = np.repeat(hard, count)
    out[~of] = ids
    out[of] = np.concatenate(whole)
    return out, count
