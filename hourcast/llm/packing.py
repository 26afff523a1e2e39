"""Sum-of-squares packing (operator 9).

Each document's token ids plus an end id are cut into pieces of at most
``capacity``. A piece goes to the open sequence for which the sum over all
residual gaps of (open sequences with that gap) squared becomes smallest;
opening a new sequence competes on the same terms. The state is one count
per gap, so a step costs O(capacity) whatever the number of pieces.

Pieces are dealt at random over groups of about ``group_pieces`` and each
group is packed by itself, largest pieces first. That bounds a task's memory
and makes the result independent of retries; it costs at most the few
sequences that each group leaves open.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hourcast.llm import common, wordcache
from hourcast.session import cut_lineage

CAPACITY = 2048
GROUP_PIECES = 20_000


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece, taken in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences per residual gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            seq[i] = made
            made += 1
            continue
        # change of the sum of squares when a sequence of gap g takes s:
        # (N[g]-1)^2 - N[g]^2 + (N[g-s]+1)^2 - N[g-s]^2; gap 0 is closed
        gaps = np.flatnonzero(count[s:capacity]) + s
        best, g = 2 * int(count[capacity - s]) + 1, capacity
        if len(gaps):
            to = count[gaps - s]
            cost = 2 * (to - count[gaps]) + 2
            if gaps[0] == s:
                cost[0] = 1 - 2 * count[s]
            k = int(cost.argmin())  # ties: the smallest gap
            if cost[k] <= best or made == 0:
                best, g = int(cost[k]), int(gaps[k])
        if g == capacity:
            b, made = made, made + 1
        else:
            b = stacks[g].pop()
            count[g] -= 1
        seq[i], off[i] = b, capacity - g
        if g > s:
            stacks[g - s].append(b)
            count[g - s] += 1
    return seq, off


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document."""

    def run(batches):
        from hourcast.llm import common as c, packing as p, wordcache as w
        tok, cache = w.tokenizer_cache(path, w.words_encoder)
        for b in c.slices(batches, "text"):
            ids, n = w.encode_exact(pc.fill_null(b.column(1), ""), cache, tok, "split", r"<\|")
            cols = p.cut(ids, n, end_id, capacity)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def cut(ids: np.ndarray, n: np.ndarray, end_id: int, capacity: int):
    """Pieces of documents whose ids lie back to back; the end id is added."""
    out = np.insert(ids, np.cumsum(n), np.uint32(end_id)).astype("<u4")
    size = n + 1
    per = -(-size // capacity)
    row = np.repeat(np.arange(len(n)), per)
    no = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = no * capacity
    length = np.minimum(capacity, size[row] - start)
    at = (np.cumsum(size) - size)[row] + start
    raw = memoryview(out.tobytes())
    crc = np.fromiter((zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())), np.int64, len(row))
    return row, no, start, length, crc


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    Null or empty text: one piece with the end id alone. Repeated rows are
    packed once each. No documents: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    common.ship(spark)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    # written once: the row numbers below stay the same when a task is rerun
    cutup = cut_lineage(pieces(src, path, end_id, capacity))
    groups = max(1, -(-cutup.count() // group_pieces))
    rows = cutup.withColumn("rid", F.monotonically_increasing_id())
    dealt = rows.repartition(groups, "rid").sortWithinPartitions(F.desc("length"), "rid")

    def run(batches):
        from pyspark import TaskContext
        from hourcast.llm import packing as p
        got = list(batches)  # one group, bounded by group_pieces
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        seq, off = p.place(t["length"].to_numpy(), capacity)
        base = TaskContext.get().partitionId() << 40
        t = t.drop_columns(["rid"]).append_column("sequence_id", pa.array(seq + base, pa.int64()))
        yield from t.append_column("offset", pa.array(off, pa.int64())).to_batches(10_000)

    kind = src.schema["id"].dataType.simpleString()
    out = dealt.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
