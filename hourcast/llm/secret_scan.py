"""Secret scan with a recursive decoding worklist (operator 1).

Every text is layer 0. A worklist unwraps URL escapes, Unicode escapes,
base64 runs and compressed payloads from each layer into new layers, which
are scanned and unwrapped in turn until nothing new appears. Layers already
seen (same content at the same place) are skipped, so cycles, such as an
archive that unpacks to itself, end. Every layer knows which characters of
the original text its characters come from, and its findings are reported as
spans of the original text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hourcast.llm import common

KINDS = ("assign", "access", "hex")
_ANY = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
_KEYWORD = "|".join([_ANY("password"), _ANY("passwd"), _ANY("secret"), _ANY("token"), _ANY("api") + "_?" + _ANY("key")])
ASSIGN = re.compile(rf"({_KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more
_MAYBE = re.compile(_KEYWORD)

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}"
                     r"|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
#: 16 base64 characters hold 12 bytes, the shortest secret ("token=abcdef")
BASE64 = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")
BASE64_URL = re.compile(r"[A-Za-z0-9_-]{16,}={0,2}")
#: lines of base64 (MIME, PEM, base64 -w): full ones of one length, then the
#: rest; the breaks are no part of the payload
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}[\x20\t]*\r?\n[\x20\t]*)+[A-Za-z0-9+/_-]+={0,2}")
_BREAK = re.compile(r"[\x20\t]*\r?\n[\x20\t]*")
PACKED = re.compile("\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY|\xfd7zXZ\x00|\\(\xb5/\xfd")
MAGIC = (b"\x1f\x8b\x08", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")

#: unpacked payloads are scanned in windows of so many bytes, each with the
#: last OVERLAP bytes of the one before, so memory stays bounded
WINDOW = 4_000_000
OVERLAP = 65_536

#: the shortest secret, in bytes
LEAST = 12

#: RE2 forms for whole columns: a text that matches none has no finding
ROUGH = (r"(?i)passw|secret|token|api_?key|AKIA|%[0-9a-f]{2}|\\[ux]|&#[0-9x]|[A-Za-z0-9+/_-]{16}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the plain patterns, leftmost and without overlap
    per kind."""
    out = []
    if _MAYBE.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


class Layer:
    """A decoded text. lo/hi: original range of each character (None: the
    identity); fresh: which characters were decoded in this layer."""

    __slots__ = ("text", "lo", "hi", "fresh", "depth", "whole")

    def __init__(self, text, lo=None, hi=None, fresh=None, depth=0, whole=None):
        self.text, self.lo, self.hi, self.fresh, self.depth, self.whole = text, lo, hi, fresh, depth, whole

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        if self.lo is None:
            return start, end
        return int(self.lo[start]), int(self.hi[end - 1])


def _in_place(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of the pattern replaced by its decoding."""
    parts, lo, hi, fresh, at, changed = [], [], [], [], 0, False

    def plain(a, b):
        if b > a:
            parts.append(layer.text[a:b])
            fresh.append(np.zeros(b - a, bool))
            if not layer.whole:
                lo.append(np.arange(a, b) if layer.lo is None else layer.lo[a:b])
                hi.append(np.arange(a + 1, b + 1) if layer.hi is None else layer.hi[a:b])

    for m in pattern.finditer(layer.text):
        got = decode(m[0])  # (text, start of each character's source, end)
        if got is None:
            continue
        plain(at, m.start())
        text, s, e = got
        parts.append(text)
        fresh.append(np.ones(len(text), bool))
        if not layer.whole:
            s, e = np.asarray(s, np.int64) + m.start(), np.asarray(e, np.int64) + m.start()
            lo.append(s if layer.lo is None else layer.lo[s])
            hi.append(e if layer.hi is None else layer.hi[e - 1])
        at, changed = m.end(), True
    if not changed:
        return None
    plain(at, len(layer.text))
    cat = lambda xs: np.concatenate(xs) if xs else None
    return Layer("".join(parts), cat(lo), cat(hi), cat(fresh), layer.depth + 1, layer.whole)


def _url(run: str):
    raw = bytes.fromhex(run.replace("%", ""))
    text, s, e, i = [], [], [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4 if raw[i] >> 3 == 30 else 1
        try:
            c = raw[i:i + n].decode("utf-8")
        except UnicodeDecodeError:
            c, n = chr(raw[i]), 1  # a byte of something packed
        text.append(c)
        s.append(3 * i)
        e.append(3 * (i + n))
        i += n
    return "".join(text), s, e


def _unicode(run: str):
    text, s, e = [], [], []
    for m in _ONE.finditer(run):
        n = int(m[3]) if m[3] else int(m[1] or m[2] or m[4], 16)
        if 0xDC00 <= n < 0xE000 and text and 0xD800 <= ord(text[-1]) < 0xDC00:  # second half of a pair
            text[-1] = chr(0x10000 + (ord(text[-1]) - 0xD800 << 10) + n - 0xDC00)
            e[-1] = m.end()
            continue
        text.append(chr(n) if n < 0x110000 else "\ufffd")
        s.append(m.start())
        e.append(m.end())
    return "".join(text), s, e


def _decompressor(raw: bytes):
    """A decompressor for what the bytes open, or None."""
    if raw[:3] == MAGIC[0]:
        return zlib.decompressobj(31)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == MAGIC[6]:
        return lzma.LZMADecompressor()
    if raw[:4] == MAGIC[7]:
        import zstandard
        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    if raw[:2] in MAGIC[1:5]:
        return zlib.decompressobj()
    return None


def _unpack(raw: bytes, d=None):
    """Windows of a compressed payload's content, one at a time; none if it
    is not one. Streams that follow one another (gzip members and the like)
    are one content."""
    tail, data, d = b"", raw, d or _decompressor(raw)
    while d is not None:
        try:
            if hasattr(d, "decompress"):
                got = d.decompress(data, WINDOW)
                data = getattr(d, "unconsumed_tail", b"")
            else:
                got = d.read(WINDOW)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):  # damaged: what came before stays
            return
        except Exception as ex:  # zstandard.ZstdError has no common base
            if type(ex).__name__ != "ZstdError":
                raise
            return
        if got:
            yield tail + got
            tail = (tail + got)[-OVERLAP:]
        if getattr(d, "eof", False):
            data = d.unused_data
            d = _decompressor(data)
        elif not got:
            return


def _deflated(raw: bytes) -> bool:
    """Whether the bytes are a whole deflate stream without a header."""
    if raw[0] & 6 == 6:
        return False
    d, data, n = zlib.decompressobj(-15), raw, 0
    try:
        while not d.eof:
            got = d.decompress(data, WINDOW)
            data, n = d.unconsumed_tail, n + len(got)
            if not got and not data:
                return False  # it breaks off
    except zlib.error:
        return False
    return not d.unused_data and n >= LEAST


def _texts(raw: bytes):
    """What a payload says: unpacked windows, or the bytes themselves."""
    found = False
    if raw.startswith(MAGIC):
        for w in _unpack(raw):
            found = True
            yield from _read(w)
    elif not _plain(raw) and _deflated(raw):
        for w in _unpack(raw, zlib.decompressobj(-15)):
            yield from _read(w)
    if not found:
        yield from _read(raw)


def _read(raw: bytes):
    """The bytes as text: as UTF-8, or else byte by byte; and as UTF-16 where
    that has zero bytes to show."""
    try:
        yield raw.decode("utf-8")
    except UnicodeDecodeError:
        yield raw.decode("latin-1")
    if raw.count(0) * 8 >= len(raw) or raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        for kind in ("utf-16-le", "utf-16-be"):
            for at in (0, 1):  # a window may cut a character
                yield raw[at:].decode(kind, "replace")


def _plain(raw: bytes) -> bool:
    """Whether a decoded run is plainly text, so that runs inside it are no
    other payloads."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    odd = sum(1 for c in text[:4096] if not (c.isprintable() or c in "\n\r\t"))
    return odd * 20 <= len(text[:4096])


def _base64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _unwrapped(layer: Layer):
    """Layers one decoding step below."""
    t = layer.text
    if "%" in t and (got := _in_place(layer, URL, _url)):
        yield got
    if ("\\" in t or "&#" in t) and (got := _in_place(layer, UNICODE, _unicode)):
        yield got
    runs = {(m.start(), m.end()) for p in (BASE64, BASE64_URL) for m in p.finditer(t)}
    if "\n" in t:
        runs |= {r for m in WRAPPED.finditer(t) for r in _blocks(t, m.start(), m.end())}
    read = -1  # a run inside one that could be read is not another
    for s, e in sorted(runs, key=lambda r: (r[0], -r[1])):
        body = _BREAK.sub("", t[s:e]) if e > read else ""
        raw = _base64(body) if body else None
        if raw and not (_plain(raw) or raw.startswith(MAGIC)):
            # characters in front that belong to something else
            for skip in (1, 2, 3):
                late = _base64(body[skip:])
                if late and len(late) >= LEAST and (_plain(late) or late.startswith(MAGIC)):
                    for text in _texts(late):
                        yield Layer(text, depth=layer.depth + 1, whole=layer.span(s, e))
        if raw:
            # lines that only look like a block may still be runs of their own
            if "\n" not in t[s:e] and (_plain(raw) or raw.startswith(MAGIC)):
                read = max(read, e)
            for text in _texts(raw):
                yield Layer(text, depth=layer.depth + 1, whole=layer.span(s, e))
    if layer.depth:
        for m in PACKED.finditer(t):
            end = m.start()
            n = re.compile("[\x00-\xff]+").match(t, m.start())
            end = n.end()
            for w in _unpack(t[m.start():end].encode("latin-1")):
                for text in _read(w):
                    yield Layer(text, depth=layer.depth + 1, whole=layer.span(m.start(), end))


def _blocks(t: str, start: int, end: int):
    """(start, end) of the wrapped payloads in lines of base64 characters: a
    block's lines are as long as its first one, but for a shorter last line."""
    lines, at = [], start
    for m in [*_BREAK.finditer(t, start, end), None]:
        lines.append((at, m.start() if m else end))
        at = m.end() if m else end
    i = 0
    while i < len(lines):
        j, size = i, lines[i][1] - lines[i][0]
        while j + 1 < len(lines) and t[lines[j][1] - 1] != "=" and lines[j][1] - lines[j][0] == size and lines[j + 1][1] - lines[j + 1][0] <= size:
            j += 1
        if j > i:
            yield lines[i][0], lines[j][1]
        i = j + 1


def scan(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, depth) of all findings, by start and kind; depth 0
    are the plain ones, and a span found at several depths has the least.

    The worklist is a stack of the layers' children, which are made one at a
    time: it holds one window of each payload that is open, however much the
    payloads unpack to.
    """
    found: dict[tuple[int, int, int], int] = {}
    work, seen = [iter((Layer(text),))], {}
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.whole,
                None if layer.lo is None else (int(layer.lo[0]), int(layer.hi[-1])) if len(layer.lo) else ())
        if seen.get(mark, layer.depth + 1) <= layer.depth:
            continue
        seen[mark] = layer.depth
        for s, e, k in base_spans(layer.text):
            # what holds no decoded character was found in the layer above
            if layer.fresh is None or layer.fresh[s:e].any():
                span = (*layer.span(s, e), k)
                found[span] = min(found.get(span, layer.depth), layer.depth)
        work.append(_unwrapped(layer))
    return sorted(((s, e, k, d) for (s, e, k), d in found.items()), key=lambda x: (x[0], x[2], x[1]))


def redact(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """The text with every found span (merged where they overlap) replaced."""
    out, at = [], 0
    for s, e, *_ in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def _rough(col: pa.Array) -> np.ndarray:
    return pc.or_(pc.match_substring_regex(col, ROUGH), pc.match_substring_regex(col, "[0-9a-f]{24}")).to_numpy(zero_copy_only=False)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, depth>>) per row; null text
    is empty; a text without secrets gives an empty array. No shuffle; other
    columns are not read."""
    common.ship(docs.sparkSession)

    def run(batches):
        from hourcast.llm import common as c, secret_scan as x
        for b in c.slices(batches, "text"):
            col = pc.fill_null(b.column(1), "")
            out = [[] for _ in range(len(col))]
            for i in np.flatnonzero(x._rough(col)).tolist():
                out[i] = [{"kind": x.KINDS[k], "start": s, "end": e, "depth": d} for s, e, k, d in x.scan(col[i].as_py())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(x.SPAN))], names=["id", "spans"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long,depth:int>>")
    return out.withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_documents(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """The same rows with every secret of ``text_col`` replaced (null stays
    null); ``length_col`` takes the new length of the changed texts."""
    common.ship(docs.sparkSession)
    place = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col else -1

    def run(batches):
        from hourcast.llm import common as c, secret_scan as x
        for b in c.slices(batches, text_col):
            cols = b.columns
            at = np.flatnonzero(x._rough(pc.fill_null(cols[place], "")))
            if len(at):
                texts = cols[place].to_pylist()
                sizes = cols[length].to_pylist() if length_col else []
                for i in at.tolist():
                    spans = x.scan(texts[i])
                    if spans:
                        texts[i] = x.redact(texts[i], spans, mark)
                        if length_col:
                            sizes[i] = len(texts[i])
                cols[place] = pa.array(texts, cols[place].type)
                if length_col:
                    cols[length] = pa.array(sizes, cols[length].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
