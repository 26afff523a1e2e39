"""N-gram Jaccard join by multiple global orders (operator 3).

A document's tokens are its distinct k-word shingles. Two sets with
J >= t share l tokens among the first n - ceil(t n) + l of each under *every*
global order of the tokens, for every l up to ceil(t n). Three orders are used:
A and B put rare tokens first (by a frequency class, ties by two different
hashes), C is a plain hash order. Candidates must share up to three prefix
tokens under A, and one under B and C, before their exact overlap is counted.

Steps, each linear in its input:

1. Equal sets fold into one class (128-bit fingerprint); only one member
   goes on.
2. Occurrences per hash cell over the whole corpus give the frequency
   classes. The cells are a table of fixed size; collisions change the order
   for all documents alike, so they cost speed and no result.
3. Order A as a shuffle: members that share a prefix token and fit in size
   are a run. A short run gives its pairs, and of these go on those that meet
   in as many runs as links must (in a large corpus rare tokens are not told from
   others by the table, so unlike documents meet in one by chance, but hardly in
   three). The members of a long run are hung onto one of them (no pairs). The
   components of both are families; linked documents are always in one family.
4. The members of families are read again, with their whole sets, and each
   family is cut into blocks of bounded size; each pair of blocks is one
   group. Inside it candidates pass orders A, B and C and the size bound,
   and are verified by exact overlap. What leaves the task are the links that
   connect something new, and each member's number of links; where no numbers
   are asked for, pairs that are already connected are not verified.
5. Components of the links and sums of the numbers, widened to all members of
   the classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hourcast.llm import common
from hourcast.llm.components import components
from hourcast.session import cut_lineage

U64 = np.uint64
#: cells of the frequency table, 2^CELL_BITS bytes (32 MB) when broadcast. A
#: cell's count bounds the frequency of its tokens from above, so the more
#: cells, the rarer are the tokens in the prefixes and the smaller are the
#: families; the result does not depend on it
CELL_BITS = 25
CELL_BLOCK = 1 << 16
#: prefix tokens that must be common, where the sizes allow it
SHARED = 3
#: members of a run whose pairs are listed: twice what a cell holds on average
#: (a token of a prefix is hardly more frequent), within these bounds
RUN_MEMBERS = (16, 256)
#: bits of the filter that picks family members on the second read
FILTER_BITS = 1 << 24
#: set elements and members per block of a family
BLOCK_TOKENS = 2_000_000
BLOCK_MEMBERS = 4_000
SALTS = 8


def cell_of(h: np.ndarray) -> np.ndarray:
    return (common.mix(h, 50) >> U64(64 - CELL_BITS)).astype(np.int64)


def frequency_classes(texts: DataFrame, k: int) -> bytes:
    """A byte per cell: a quarter-octave class of the cell's occurrences."""

    def count(batches):
        from hourcast.llm import common as c, jaccard as j
        cells = np.zeros(1 << j.CELL_BITS, np.uint16)
        for b in c.slices(batches, "text"):
            _, _, h = c.shingles(c.Words(b.column(0)), k)
            at, n = np.unique(j.cell_of(h), return_counts=True)
            cells[at] = np.minimum(cells[at] + n, 65535)
        for i in range(len(cells) // j.CELL_BLOCK):
            part = cells[i * j.CELL_BLOCK:(i + 1) * j.CELL_BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                step = np.diff(at, prepend=0)  # small numbers, which compress
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([step.astype(np.uint8 if step.max() < 256 else np.uint16).tobytes()], pa.binary()),
                     pa.array([part[at].tobytes()], pa.binary())], names=["block", "step", "n"])

    def add(batches):
        from hourcast.llm import jaccard as j
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, step, n in zip(*(b.column(x).to_pylist() for x in range(3))):
                part = total.setdefault(i, np.zeros(j.CELL_BLOCK, np.int64))
                n = np.frombuffer(n, np.uint16)
                part[np.cumsum(np.frombuffer(step, np.uint8 if len(step) == len(n) else np.uint16), dtype=np.int64)] += n
        for i, part in total.items():
            cls = np.floor(4 * np.log2(np.maximum(part, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([cls.tobytes()], pa.binary())], names=["block", "cls"])

    got = (texts.mapInArrow(count, "block int, step binary, n binary").repartition(64, "block")
           .mapInArrow(add, "block int, cls binary").collect())
    table = bytearray(1 << CELL_BITS)  # fixed size, whatever the corpus
    for r in got:
        table[r["block"] * CELL_BLOCK:(r["block"] + 1) * CELL_BLOCK] = r["cls"]
    return bytes(table)


def token_sets(col, k: int, classes: np.ndarray):
    """(n, offsets, tokens, fp1, fp2): each text's distinct tokens, ascending
    in order A (class in the high byte, hash below)."""
    w = common.Words(col)
    row, _, h = common.shingles(w, k)
    tok = classes[cell_of(h)].astype(U64) << U64(56) | common.mix(h, 3) >> U64(8)
    row, tok = common.distinct_per_row(row, tok)
    n = np.bincount(row, minlength=len(w.n))
    off = np.concatenate([[0], np.cumsum(n)])
    sums = []
    for seed in (7, 8):
        acc = np.concatenate([np.zeros(1, U64), np.cumsum(common.mix(tok, seed))])
        sums.append((acc[off[1:]] - acc[off[:-1]]).view(np.int64))
    return n, off, tok, *sums


def order_key(tok: np.ndarray, order: int) -> np.ndarray:
    """Order B (1): the class as it is, another hash below it. Order C (2): a
    plain hash."""
    key = common.mix(tok, 4 + order)
    return key >> U64(8) | tok & U64(0xFF << 56) if order == 1 else key


def prefix_length(n, num: int, den: int):
    """Tokens that must hold a common one: n - ceil(t n) + 1 (none if empty)."""
    return np.where(n > 0, n - -(-num * n // den) + 1, 0)


def shared_tokens(n, num: int, den: int):
    """Tokens that the prefixes below have in common, if the smaller of two
    linked sets has n: up to SHARED, and one more than may differ at most."""
    least = -(-num * n // den)
    return np.minimum(np.minimum(SHARED, 1 + n - least), np.maximum(least, 1))


def shared_prefix(n, num: int, den: int):
    """Tokens that must hold ``shared_tokens`` common ones (none if empty)."""
    return np.where(n > 0, prefix_length(n, num, den) + shared_tokens(n, num, den) - 1, 0)


def run_members(table: bytes) -> int:
    """Members of a run whose pairs are listed, from the frequency classes."""
    count = sum(np.bincount(np.frombuffer(table, np.uint8, CELL_BLOCK, at), minlength=256)  # in parts: it widens what it counts
                for at in range(0, len(table), CELL_BLOCK))
    low, high = RUN_MEMBERS
    return int(np.clip(2 * (count @ 2 ** (np.arange(256) / 4)) / len(table), low, high))


def _meetings(num, den, most):
    """Rows (tok, n, rid) sorted by tok, n: (a, b, need) for the pairs of each
    run that fit in size, to be linked if they come ``need`` times, and need 0
    for (rid, first of its run) of runs of over ``most`` rows. A run ends where
    the token changes or sizes no longer fit."""

    def run(batches):
        from hourcast.llm import jaccard as j
        held, hub = None, None  # rows of the run that goes on; its first row, if it is a long one
        for b in j._and_end(batches):
            new = [np.zeros(0, np.int64)] * 3 if b is None else [b.column(i).to_numpy() for i in range(3)]
            tok, n, rid = new if held is None else (np.concatenate(x) for x in zip(held, new))
            if not len(tok):
                continue
            go = np.zeros(len(tok), bool)
            go[1:] = (tok[1:] == tok[:-1]) & (den * n[:-1] >= num * n[1:])
            start = np.flatnonzero(~go)
            size = np.diff(np.append(start, len(tok)))
            which = np.cumsum(~go) - 1
            long = size > most
            first = rid[start]
            if hub is not None:
                long[0], first[0] = True, hub
            end, hub = len(tok), None
            if b is not None:  # the last run may go on
                if long[-1]:
                    held, hub = (tok[-1:], n[-1:], rid[-1:]), first[-1]
                else:
                    end = start[-1]
                    held = tok[end:], n[end:], rid[end:]
            hung = np.flatnonzero(go & long[which])
            out = [(rid[hung], first[which[hung]], np.zeros(len(hung), np.int64))]
            x, gap = np.flatnonzero(~long[which[:end]]), 0
            while True:
                gap += 1
                x = x[x + gap < end]
                x = x[which[x + gap] == which[x]]
                if not len(x):
                    break
                fit = x[den * n[x] >= num * n[x + gap]]
                p, q = rid[fit], rid[fit + gap]
                out.append((np.maximum(p, q), np.minimum(p, q), j.shared_tokens(n[fit], num, den)))
            a, b_, need = (np.concatenate(c) for c in zip(*out))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_), pa.array(need.astype(np.int8))], names=["a", "b", "need"])

    return run


def _and_end(batches):
    yield from batches
    yield None


def linked(rid: np.ndarray, block: np.ndarray, sets: list[np.ndarray], num: int, den: int, cross: bool,
           size: np.ndarray | None = None):
    """Links that connect a group's members; sets ascend in order A. cross:
    only pairs of different blocks are compared. size: rows per member; with
    it every candidate is verified, and the result is (links, linked rows of
    each member)."""
    m = len(rid)
    n = np.array([len(s) for s in sets], np.int64)
    p = prefix_length(n, num, den)
    tok = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    begin = np.cumsum(n) - n
    seen, code = np.unique(tok, return_inverse=True)
    shared = np.bincount(code)[code] > 1
    place = np.arange(len(tok)) - begin[owner]

    def index(keep):  # code -> members
        c, o = code[keep], owner[keep]
        order = np.argsort(c, kind="stable")
        count = np.bincount(c, minlength=len(seen))
        start = np.cumsum(count) - count
        return o[order], start, count, np.searchsorted(o, np.arange(m + 1)), c

    orders = []
    for key in (None, order_key(tok, 1), order_key(tok, 2)):
        if key is None:
            keep = shared & (place < p[owner])  # order A: as stored
        else:
            at = np.lexsort((key, owner))
            rank = np.empty(len(tok), np.int64)
            rank[at] = np.arange(len(tok)) - begin[owner]
            keep = shared & (rank < p[owner])
        orders.append(index(keep))
    full = index(shared)

    def hits(ix, x):
        members, start, count, span, c = ix
        mine = c[span[x]:span[x + 1]]
        k = count[mine]
        end = np.cumsum(k)
        if not len(k):
            return np.zeros(m, np.int64)
        at = np.arange(end[-1]) + np.repeat(start[mine] - (end - k), k)
        return np.bincount(members[at], minlength=m)

    root = np.arange(m)  # component label of each member
    out, rows = [], np.zeros(m, np.int64)
    for x in range(m):
        cand = (root != root[x] if size is None else np.arange(m) > x) & (den * np.minimum(n, n[x]) >= num * np.maximum(n, n[x]))
        if cross:
            cand &= block != block[x]
        for ix in orders:
            if not cand.any():
                break
            cand &= hits(ix, x) > 0
        if not cand.any():
            continue
        both = hits(full, x)
        found = np.flatnonzero(cand & (den * both >= num * (n[x] + n - both)))
        if size is not None:
            rows[x] += size[found].sum()
            rows[found] += size[x]
        while len(found := found[root[found] != root[x]]):
            out.append((int(rid[x]), int(rid[found[0]])))
            root[root == root[found[0]]] = root[x]
    return out if size is None else (out, rows)


def _verify(num, den, count):
    """Rows (a, b, null) are links, rows (a, null, n) numbers of linked rows."""

    def run(batches):
        from hourcast.llm import jaccard as j
        key, group = None, []

        def flush():
            rid = np.array([g[0] for g in group], np.int64)
            blk = np.array([g[1] for g in group], np.int64)
            if len(group) < 2:
                return
            size = np.array([g[3] for g in group], np.int64) if count else None
            found = j.linked(rid, blk, [g[2] for g in group], num, den, key[1] != key[2], size)
            found, rows = found if count else (found, np.zeros(len(rid), np.int64))
            some = rows > 0
            if found or some.any():
                a, b = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*a, *rid[some].tolist()], pa.int64()), pa.array([*b, *[None] * int(some.sum())], pa.int64()),
                     pa.array([*[None] * len(a), *rows[some].tolist()], pa.int64())], names=["a", "b", "n"])

        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            rids, blks, toks, sizes = b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5), b.column(6).to_numpy()
            for i, k in enumerate(keys):
                if k != key:
                    if group:
                        yield from flush()
                    key, group = k, []
                if not group or group[-1][0] != rids[i]:  # a repeated row of one member
                    group.append((int(rids[i]), int(blks[i]), toks[i].values.to_numpy().view(U64), int(sizes[i])))
        if group:
            yield from flush()

    return run


def _may_be_in(df: DataFrame, key: list, keys: DataFrame, of: list) -> DataFrame:
    """The frame with ``_hit``: whether a row's key may be in the keys (always
    if it is). A bitmap of fixed size tells, so the other rows need no shuffle,
    whatever they carry; how full it gets decides how many rows that spares."""
    at = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS)) + 1
    bits = keys.select(at(of).alias("_p")).groupBy(F.expr("bitmap_bucket_number(_p)").alias("_bucket")) \
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_p))").alias("_bits"))
    byte = "cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_p) div 8 as int) + 1, 1)), 16, 10) as int)"
    return df.withColumn("_p", at(key)).withColumn("_bucket", F.expr("bitmap_bucket_number(_p)")) \
        .join(F.broadcast(bits), "_bucket", "left") \
        .withColumn("_hit", F.expr(f"coalesce(getbit({byte}, cast(bitmap_bit_position(_p) % 8 as int)) = 1, false)")) \
        .drop("_p", "_bucket", "_bits")


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id",
                       text_col: str = "text", count_links: bool = True, keepers: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, n_links) per row; component_id is the
    smallest id reachable over links num/den <= J, n_links the number of other
    rows that the row itself links with. Without ``count_links`` the column
    is left out, and only links that connect something new are looked for.

    Null, empty or wordless text: size 0, linked with nothing. Repeated rows
    are documents of their own (equal sets link). Null ids take part; a
    component's smallest id ignores them. Other columns are not read.

    ``keepers`` gives (id, text_key, kept) instead: the hash of the row's text,
    and whether the row, or one that equals it in id and text, is the first of
    its component (by id, null ids last, then by text_key).
    """
    spark = docs.sparkSession
    common.ship(spark)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    src = src.withColumn("text_key", F.xxhash64("text"))
    kind = src.schema["id"].dataType.simpleString()
    table = spark.sparkContext.broadcast(frequency_classes(src.select("text"), k))

    def sets(batches):
        from hourcast.llm import common as c, jaccard as j
        classes = np.frombuffer(table.value, np.uint8)
        for b in c.slices(batches, "text"):
            n, off, tok, f1, f2 = j.token_sets(b.column(1), k, classes)
            p = j.shared_prefix(n, num, den)
            at = np.arange(p.sum()) + np.repeat(off[:-1] - (np.cumsum(p) - p), p)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(f1), pa.array(f2),
                 c.list_array(tok[at].view(np.int64), np.concatenate([[0], np.cumsum(p)]), pa.int64())],
                names=["id", "text_key", "n", "f1", "f2", "prefix"])

    base = cut_lineage(src.mapInArrow(sets, f"id {kind}, text_key long, n long, f1 long, f2 long, prefix array<long>")) \
        .withColumn("rid", F.monotonically_increasing_id())  # fixed: the rows are on disk
    classes = base.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("rid").alias("rid"), F.min_by("id", "rid").alias("id"), F.count("*").alias("size"))
    # a class of one row is known without a shuffle of the prefixes
    finger = ["n", "f1", "f2"]
    hit = _may_be_in(base.where("n > 0").select(*finger, "rid", "prefix"), finger, classes.where("size > 1"), finger)
    one = ["n", "rid", "prefix"]
    rows = hit.where("not _hit").select(*one).union(hit.where("_hit").join(classes.select("rid"), "rid", "left_semi").select(*one)) \
        .select(F.explode("prefix").alias("tok"), "n", "rid")
    met = rows.repartition("tok").sortWithinPartitions("tok", "n", "rid") \
        .mapInArrow(_meetings(num, den, run_members(table.value)), "a long, b long, need byte")
    met = met.groupBy("a", "b").agg(F.count("*").alias("times"), F.min("need").alias("need")).where("times >= need")
    family = components(met.select("a", "b")).withColumnRenamed("node", "rid").withColumnRenamed("component", "family")
    members = cut_lineage(family.join(classes, "rid"))

    # whole sets of the members: a bitmap of fixed size picks the rows to hash
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1
    blocks = members.select(bit.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")) \
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    bitmap = bytearray(FILTER_BITS // 8)
    for r in blocks:
        at = (r["bucket"] - 1) * 4096
        bitmap[at:at + 4096] = r["bits"]
    wanted = spark.sparkContext.broadcast(bytes(bitmap))

    def again(batches):
        from hourcast.llm import common as c, jaccard as j
        classes = np.frombuffer(table.value, np.uint8)
        bits = np.frombuffer(wanted.value, np.uint8)

        def picked():
            for b in batches:
                p = b.column(2).to_numpy()
                yield b.filter(pa.array((bits[p >> 3] >> (p & 7)) & 1 == 1))

        for b in c.slices(picked(), "text"):
            n, off, tok, f1, f2 = j.token_sets(b.column(1), k, classes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(f1), pa.array(f2), c.list_array(tok.view(np.int64), off, pa.int64())],
                names=["id", "n", "f1", "f2", "tokens"])

    whole = src.select("id", "text", (bit - 1).alias("p")).mapInArrow(again, f"id {kind}, n long, f1 long, f2 long, tokens array<long>")
    cut = members.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)),
                                                   F.ceil(F.count("*") / F.lit(BLOCK_MEMBERS))).alias("blocks"))
    sized = members.join(cut, "family").withColumn("blk", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    full = whole.alias("w").join(sized.alias("s"), F.expr("w.id <=> s.id and w.n = s.n and w.f1 = s.f1 and w.f2 = s.f2")) \
        .select("family", "blocks", "blk", "rid", "tokens", "size")
    dealt = full.select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), "blk", "rid", "tokens", "size") \
        .select("family", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "rid", "blk", "tokens", "size") \
        .repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi", "rid")
    found = dealt.mapInArrow(_verify(num, den, count_links), "a long, b long, n long")
    found = cut_lineage(found) if count_links else found
    links = components(found.where("b is not null").select("a", "b"))

    keyed = base.select("id", "text_key", "n", "f1", "f2", "rid") \
        .join(classes.select("n", "f1", "f2", F.col("rid").alias("rep"), "size"), ["n", "f1", "f2"], "left") \
        .join(links.withColumnRenamed("node", "rep"), "rep", "left")
    extra = []
    if count_links:
        rows = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
        keyed = keyed.join(rows, "rep", "left")
        extra = [(F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))).alias("n_links")]  # copies link too
    # components of one row are their own; the others' first row comes back
    # salted, as a component may hold a large part of all rows
    keyed = keyed.select("id", "text_key", "n", F.coalesce("component", "rep", "rid").alias("component"),
                         F.pmod("rid", F.lit(SALTS)).alias("salt"), *extra)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("first")
    least = keyed.groupBy("component").agg(first, F.count("*").alias("rows")).where("rows > 1").drop("rows")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = keyed.join(least, ["component", "salt"], "left")
    if keepers:
        alone = F.col("first").isNull()
        same = F.col("id").eqNullSafe(F.col("first.id")) & F.col("text_key").eqNullSafe(F.col("first.text_key"))
        return keyed.select(F.col("id").alias(id_col), "text_key", (alone | same).alias("kept"))
    return keyed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
                        *["n_links"] * count_links)


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their near copies: of each component the row
    with the smallest id stays (null ids last; rows that share it: the one
    whose text has the smaller hash). A row is known by id and text, so another
    text under the id of a copy stays. Rows that repeat an id with the same
    text fold into one; documents without words stay."""
    found = cut_lineage(jaccard_components(docs, k, num, den, id_col, text_col, count_links=False, keepers=True))
    row = [F.col(id_col).alias("_id"), F.col("text_key").alias("_key")]
    gone = found.where("not kept").select(*row).distinct()
    again = found.where("kept").groupBy(*row).count().where("count > 1").select("_id", "_key")
    some = not again.isEmpty()
    # rows that neither go nor repeat are passed on where they are
    keyed = _may_be_in(docs.withColumn("_text_key", F.xxhash64(F.col(text_col).cast("string"))), [F.col(id_col), F.col("_text_key")],
                       gone.union(again) if some else gone, [F.col("_id"), F.col("_key")])
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    alone = keyed.where("not _hit").select(docs.columns)
    kept = keyed.where("_hit").join(gone, same, "left_anti")
    if not some:
        return alone.union(kept.select(docs.columns))
    return alone.union(kept.join(again, same, "left_anti").select(docs.columns)).union(
        kept.join(again, same, "left_semi").select(docs.columns).dropDuplicates([id_col, text_col]))
