"""Token counts by rank-synchronous array merging (operator 5).

The tokenizer file is read as data: its vocabulary, merges, normalisation and
pre-token pattern. Distinct pre-tokens of a batch are held as one ragged
array of symbol ids. Each step looks up the rank of every adjacent pair,
finds each sequence's lowest rank and applies that pair everywhere in the
sequence at once (left to right where occurrences overlap); sequences with
no mergeable pair leave. The symbols that survive are the tokens. There is
one step per merge of the longest derivation, not one per merge of the batch.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from hourcast.llm import common, wordcache

NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files:
    printable bytes stand for themselves, the others take 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def _pattern(pre: dict) -> str:
    for p in pre.get("pretokenizers", [pre]):
        if p["type"] == "Split":
            return p["pattern"]["Regex"]
    raise ValueError("the file has no Split pre-tokenizer")


class RankMerger:
    """Merges batches of pre-tokens of one byte-level BPE file with word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = byte_symbols()
        self.plain = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        left, right, made = [], [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.rank = np.arange(len(key), dtype=np.int32)[order]
        self.made = np.array(made, np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.words = regex.compile(_pattern(spec["pre_tokenizer"]) + r"|\n")
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    def ranks(self, sym: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol but the last."""
        key = sym[:-1] << 32 | sym[1:]
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def merge(self, raw: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Surviving symbols of each pre-token; raw: their bytes, back to back."""
        out = np.zeros(len(length), np.int64)
        seq = np.repeat(np.arange(len(length)), length)
        sym = self.plain[raw]
        tail = np.cumsum(length)[length > 0] - 1
        sym[tail] = self.last[raw[tail]]
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            size = np.diff(np.append(start, len(seq)))
            rank = np.full(len(sym), NONE, np.int32)
            if len(sym) > 1:
                rank[:-1] = self.ranks(sym)
            rank[start + size - 1] = NONE  # a pair never crosses pre-tokens
            low = np.minimum.reduceat(rank, start)
            done = low == NONE
            out[seq[start[done]]] = size[done]
            if done.all():
                break
            hit = np.flatnonzero((rank != NONE) & (rank == np.repeat(low, size)))
            # in a run of overlapping occurrences every other one applies
            fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            run = np.cumsum(fresh) - 1
            hit = hit[((np.arange(len(hit)) - np.flatnonzero(fresh)[run]) & 1) == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.repeat(~done, size)
            keep[hit + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out

    def normal(self, s: str) -> str:
        if s.isascii():
            return s.lower() if self.lower else s
        if self.nfc:
            s = unicodedata.normalize("NFC", s)
        return "".join(c.lower() for c in s) if self.lower else s  # by character: no final sigma

    def count(self, chunks: list[str]) -> np.ndarray:
        """Tokens of every chunk (without line feeds inside)."""
        parts, owner, out = [], [], np.zeros(len(chunks), np.int64)
        for i, c in enumerate(chunks):
            if "<|" in c and self.cut.search(c):
                bits = self.cut.split(c)
                out[i] += len(bits) - 1  # each special string is one token
                parts += bits
                owner += [i] * len(bits)
            else:
                parts.append(c)
                owner.append(i)
        owner = np.array(owner, np.int64)
        plain = [p for p in parts if p.isascii()]
        if len(plain) == len(parts):
            text = self.normal("\n".join(parts))
        else:
            text = "\n".join([self.normal(p) for p in parts])
        found = self.words.findall(text)
        col = pa.array(found, pa.large_string())
        coded = col.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        raw, off = common.text_bytes(coded.dictionary)
        tokens = self.merge(raw, np.diff(off)) if len(raw) else np.zeros(len(off) - 1, np.int64)
        seps = np.array([w == "\n" for w in coded.dictionary.to_pylist()], bool)
        tokens[seps] = 0
        if len(code):
            part = np.cumsum(seps[code])  # every separator opens the next part
            per = np.bincount(part, weights=tokens[code], minlength=len(parts)).astype(np.int64)
        else:
            per = np.zeros(len(parts), np.int64)
        out += np.bincount(owner, weights=per, minlength=len(chunks)).astype(np.int64)
        return out


class CountCache:
    """chunk -> tokens, at most ``limit`` remembered."""

    def __init__(self, merger: RankMerger, limit: int = 300_000):
        self.merger, self.limit, self.at = merger, limit, {}

    def counts(self, chunks: list[str]) -> np.ndarray:
        if len(self.at) > self.limit:
            self.at = {}
        new = [c for c in chunks if c not in self.at]
        if new:
            self.at.update(zip(new, self.merger.count(new).tolist()))
        return np.fromiter((self.at[c] for c in chunks), np.int64, len(chunks))


def count_column(col: pa.Array, cache: CountCache) -> np.ndarray:
    parts = pc.split_pattern(pc.replace_substring(col, "\n", " "), " ")
    coded = parts.flatten().dictionary_encode()
    per = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    n = cache.counts(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    ends = np.concatenate([[0], np.cumsum(n)])
    last = np.cumsum(per)
    return ends[last] - ends[last - per]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, without a shuffle.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows and ids: one row
    each. Other columns, whatever their names, are not read.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        from hourcast.llm import common as c, token_counts as t, wordcache as w
        cache = w.live(("counts", path), lambda: t.CountCache(t.RankMerger(path)))
        for b in c.slices(batches, "text"):
            col = pc.fill_null(b.column(1), "")
            n = t.count_column(col, cache)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.binary_length(col).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["id", "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
