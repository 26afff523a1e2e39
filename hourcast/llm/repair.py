"""Token-id files with Re-Pair grammar compression (operator 6).

A shard holds the ids of consecutive documents. Frequent adjacent id pairs
are replaced by new symbols (nonterminals), again and again: each round
counts all pairs, gives the most frequent ones a symbol each, and replaces
them everywhere at once. It ends when no pair is frequent enough or the
16-bit code space is full. Pairs never cross documents, so a document is a
slice of the compressed sequence; the stored expansion lengths lead straight
to any token of it without expanding what lies before.

File format: Parquet, one row per shard (see ``SHARD_FIELDS``), written by
Spark's committer, so a lost executor leaves no half-written shard.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hourcast.llm import common, wordcache
from hourcast.session import checkpoint_dir

#: text bytes per shard, at least one document
SHARD_BYTES = 4_000_000
MIN_COUNT = 8
PAIRS_A_ROUND = 4096
CODES = 1 << 16

SHARD_FIELDS = (
    "part int, shard int, part_start long, n_tokens long, vocab int, "
    "doc_tokens array<int>, doc_symbols array<int>, "  # per document: ids, symbols in the sequence
    "rules binary, rule_lengths binary, round_ends array<int>, "  # uint16 pairs, uint32, rules made by each round's end
    "sequence binary"  # uint16
)

#: white space beside white space, at the end, or the start of a special
#: string: such texts are encoded whole, not by chunks
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
AWKWARD = _WS + _WS + "|" + _WS + r"\z|<\|"


def compress(ids: np.ndarray, doc_tokens: np.ndarray, vocab: int, min_count: int = MIN_COUNT) -> dict:
    """Grammar of one shard; ids < vocab <= 65536, as symbols take 16 bits
    (anything else raises)."""
    if vocab > 1 << 16 or (len(ids) and int(ids.max()) >= vocab):
        raise ValueError(f"ids up to {int(ids.max()) if len(ids) else 0} of {vocab} do not fit symbols of 16 bits")
    sym = ids.astype(np.uint32)
    last = np.zeros(len(sym), bool)  # a document's last symbol starts no pair
    ends = np.cumsum(doc_tokens)
    last[ends[doc_tokens > 0] - 1] = True
    rules, round_ends, code = [], [], vocab
    while len(sym) > 1 and code < CODES:
        key = sym[:-1] << np.uint32(16) | sym[1:]
        # counts by a hash first: only pairs of well filled cells are sorted
        cell = (key * np.uint32(2654435761)) >> np.uint32(14)
        cell[last[:-1]] = 0
        room = np.bincount(cell, minlength=1 << 18)
        top = min(PAIRS_A_ROUND, CODES - code)
        bar = max(min_count, int(np.partition(room, -top)[-top]))
        hot = room >= bar
        hot[0] = False
        at = np.flatnonzero(hot[cell])
        if not len(at):
            break
        pair, where, count = np.unique(key[at], return_inverse=True, return_counts=True)
        good = count >= min_count
        if good.sum() > top:
            order = np.lexsort((pair, -count))[:top]  # ties: the smaller pair
            good = np.zeros(len(pair), bool)
            good[order] = True
        if not good.any():
            break
        made = np.cumsum(good) - 1 + code
        use = good[where]
        at, to = at[use], made[where[use]]
        fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
        run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        take = ((np.arange(len(at)) - run) & 1) == 0  # overlapping places: every other one
        at, to = at[take], to[take]
        sym[at] = to
        last[at] = last[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, last = sym[keep], last[keep]
        rules.append(pair[good])
        code += int(good.sum())
        round_ends.append(code - vocab)
        if len(at) < len(sym) // 200:
            break  # a round that saves under half a percent is the last
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint32)
    left, right = (flat >> np.uint32(16)).astype(np.uint16), (flat & np.uint32(0xFFFF)).astype(np.uint16)
    lengths = np.ones(vocab + len(flat), np.uint32)
    lo = 0
    for hi in round_ends:
        lengths[vocab + lo:vocab + hi] = lengths[left[lo:hi]] + lengths[right[lo:hi]]
        lo = hi
    ended = np.flatnonzero(last)
    symbols = np.zeros(len(doc_tokens), np.int64)
    symbols[doc_tokens > 0] = np.diff(np.concatenate([[-1], ended]))
    return {"rules": np.stack([left, right], 1), "rule_lengths": lengths[vocab:], "round_ends": round_ends,
            "sequence": sym.astype(np.uint16), "doc_tokens": doc_tokens, "doc_symbols": symbols, "vocab": vocab}


def from_row(row: dict) -> dict:
    """The arrays of a stored shard row."""
    return {"rules": np.frombuffer(row["rules"], np.uint16).reshape(-1, 2),
            "rule_lengths": np.frombuffer(row["rule_lengths"], np.uint32), "round_ends": list(row["round_ends"]),
            "sequence": np.frombuffer(row["sequence"], np.uint16), "vocab": row["vocab"],
            "doc_tokens": np.asarray(row["doc_tokens"], np.int64), "doc_symbols": np.asarray(row["doc_symbols"], np.int64)}


def symbol_lengths(shard: dict) -> np.ndarray:
    return np.concatenate([np.ones(shard["vocab"], np.uint32), shard["rule_lengths"]]).astype(np.int64)


def expand(shard: dict, sequence: np.ndarray | None = None) -> np.ndarray:
    """All ids of a sequence of symbols (the shard's own by default)."""
    seq = (shard["sequence"] if sequence is None else sequence).astype(np.int64)
    length = symbol_lengths(shard)
    start = np.cumsum(length) - length
    table = np.empty(int(length.sum()), np.uint32)
    table[:shard["vocab"]] = np.arange(shard["vocab"])
    lo = 0
    for hi in shard["round_ends"]:  # a round's rules use earlier symbols only
        part = shard["rules"][lo:hi].astype(np.int64).ravel()
        out = wordcache.ragged_take(table, start[part], length[part])
        s = start[shard["vocab"] + lo]
        table[s:s + len(out)] = out
        lo = hi
    return wordcache.ragged_take(table, start[seq], length[seq])


def document(shard: dict, i: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Ids lo..hi of document i, expanding only the symbols that cover them."""
    begin = int(shard["doc_symbols"][:i].sum())
    seq = shard["sequence"][begin:begin + int(shard["doc_symbols"][i])]
    size = int(shard["doc_tokens"][i])
    hi = size if hi is None else min(hi, size)
    if lo >= hi:
        return np.zeros(0, np.uint32)
    ends = np.cumsum(symbol_lengths(shard)[seq])
    a, b = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(ends, hi, side="left"))
    skipped = int(ends[a - 1]) if a else 0
    todo, out = list(seq[a:b + 1][::-1].astype(int)), []
    while todo:  # a stack walks down the rules
        s = todo.pop()
        if s < shard["vocab"]:
            out.append(s)
        else:
            left, right = shard["rules"][s - shard["vocab"]]
            todo += [int(right), int(left)]
    return np.array(out[lo - skipped:hi - skipped], np.uint32)


def write(docs: DataFrame, out_dir: str, path: str, end_id: int = 2, vocab: int = 50_257,
          id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Write every document's ids (plus the end id), in ascending id order
    (rows of one id in reading order; null ids first), as shards under
    ``out_dir``. Null text is empty. Other columns are not read."""
    common.ship(docs.sparkSession)
    src = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    # the row number keeps a hot id from filling one range
    src = src.withColumn("rid", F.monotonically_increasing_id())
    dealt = src.repartitionByRange("id", "rid").sortWithinPartitions("id", "rid").select("id", "text")
    kind = src.schema["id"].dataType

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type
        from hourcast.llm import common as c, repair as r, wordcache as w
        tok, cache = w.tokenizer_cache(path, w.bytes_encoder)
        part, no, before = TaskContext.get().partitionId(), 0, 0
        for b in c.slices(batches, "text", shard_bytes):
            ids, n = w.encode_exact(b.column(1), cache, tok, "bytes", r.AWKWARD)
            ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
            s = r.compress(ids, n + 1, vocab)
            one = lambda v, t: pa.array([v], t)
            yield pa.RecordBatch.from_arrays(
                [one(b.column(0).to_pylist(), pa.list_(to_arrow_type(kind))), one(part, pa.int32()), one(no, pa.int32()),
                 one(before, pa.int64()), one(len(ids), pa.int64()), one(vocab, pa.int32()),
                 one(s["doc_tokens"], pa.list_(pa.int32())), one(s["doc_symbols"], pa.list_(pa.int32())),
                 one(s["rules"].tobytes(), pa.binary()), one(s["rule_lengths"].tobytes(), pa.binary()),
                 one(s["round_ends"], pa.list_(pa.int32())), one(s["sequence"].tobytes(), pa.binary())],
                names=["ids", *[f.split()[0] for f in SHARD_FIELDS.split(", ")]])
            no, before = no + 1, before + len(ids)

    dealt.mapInArrow(run, f"ids array<{kind.simpleString()}>, " + SHARD_FIELDS).write.parquet(out_dir)


def read(spark: SparkSession, out_dir: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every stored document, from the
    expanded files; start counts the ids of all documents before it."""
    common.ship(spark)
    shards = spark.read.parquet(out_dir)
    # a row per writing task, however many documents there are
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                                             F.lit(0)).alias("before"))
    rows = shards.join(F.broadcast(before), "part")
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        from hourcast.llm import repair as r
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                s = r.from_row(row)
                raw = memoryview(r.expand(s).astype("<u4").tobytes())
                n = s["doc_tokens"]
                end = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(end.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], b.schema.field("ids").type.value_type),
                     pa.array(end - n + row["before"] + row["part_start"], pa.int64()),
                     pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"])

    out = rows.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def new_dir(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
