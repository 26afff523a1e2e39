"""Quality rules with tokeniser fertility (operator 8).

Base rules count words, symbols, repeated lines and repeated 5-word windows.
The method measures how two public vocabularies take a text's words apart:
characters per token and the entropy of the token distribution under both,
and the share of byte-fallback tokens under the one that has them. Where a
measure should lie follows from the corpus: its median per language over all
documents, and the spread around it for a text of that many tokens, since
short texts scatter more. A text outside any fence is rejected.

Steps: the measures of every row in one pass (written once), two aggregates
of bounded size that give the fences, and one pass over the measures.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hourcast.llm import common, wordcache
from hourcast.session import checkpoint_dir, cut_lineage

#: outer limits, which hold whatever the corpus says and alone where it says
#: too little: (low, high) per measure and language; a text outside is
#: rejected. "*" is for every other language and for measures that a language
#: leaves out.
#: entropy_ratio: token entropy over the most that so many tokens can reach,
#: so that short texts are not punished.
BANDS = {
    "*": {"chars_per_token": (1.2, 6.0), "fallback_share": (0.0, 0.2), "entropy_ratio": (0.4, 1.0)},
    "en": {"chars_per_token": (1.4, 6.0), "fallback_share": (0.0, 0.1)},
    "fr": {"chars_per_token": (1.4, 6.0), "fallback_share": (0.0, 0.1)},
    "de": {"chars_per_token": (1.25, 6.0), "fallback_share": (0.0, 0.1)},
    "es": {"chars_per_token": (1.25, 6.0), "fallback_share": (0.0, 0.1)},
}
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: texts with fewer tokens are not judged by the bands: the measures of a few
#: tokens say nothing
MIN_TOKENS = 20
#: rows of the table of centres up to which it is broadcast
MAX_BROADCAST = 50_000
#: the second vocabulary
SECOND = "word_bpe_49k.json"
#: measures with a fence: (name, its number of tokens, scaled, least spread).
#: scaled: the spread falls with the square root of the tokens, and there is
#: one centre per language; the others have a centre and a spread per half
#: octave of tokens. The least spread is a part of the centre, plus an
#: absolute one for shares, which are mostly zero.
FENCED = (("chars_per_token", "n_tokens", True, 0.3, 0.0), ("chars_per_token_2", "n_tokens_2", True, 0.3, 0.0),
          ("entropy_ratio", "n_tokens", False, 0.015, 0.0), ("entropy_ratio_2", "n_tokens_2", False, 0.015, 0.0),
          ("fallback_share", "n_tokens", False, 0.0, 0.02))
#: a fence lies so many spreads (of a normal distribution) from the centre
WIDTH = 5.0
#: different texts that a group must have for fences of its own; below, those
#: of all languages hold
MIN_DOCS = 50
#: steps of the counted measures, and their largest value: they bound the
#: state of the aggregates
STEPS, LARGEST = 1000, 64

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def piece_cache(path: str):
    """(chunk ids cache, is-byte-piece flags) of a sentencepiece model."""

    def make():
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())], bool)

        def encode(chunks):
            got = sp.encode(chunks, num_threads=1)
            n = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter((i for ids in got for i in ids), np.uint32, int(n.sum())), n

        return wordcache.PieceIds(encode), byte

    return wordcache.live(("pieces", path), make)


def vocabularies(path: str, second: str):
    """(piece cache, is-byte-piece flags, word tokenizer, its cache, its size)."""

    def make():
        cache, byte = piece_cache(path)
        tok = wordcache.load_tokenizer(second)
        half = wordcache.LIMIT // 2  # two caches in the room of one
        return (wordcache.PieceIds(cache.encode, half), byte, tok, wordcache.PieceIds(wordcache.words_encoder(tok), half),
                tok.get_vocab_size())

    return wordcache.live(("vocabularies", path, second), make)


def _per_row(mask_at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a 0/1 array over each text's range."""
    acc = np.concatenate([[0], np.cumsum(mask_at, dtype=np.int64)])
    return acc[off[1:]] - acc[off[:-1]]


def base_counts(col: pa.Array) -> tuple[common.Words, dict]:
    w = common.Words(col, lower=False)
    raw, off, rows = w.raw, w.off, len(w.n)
    out = {"n_words": w.n.astype(np.int64), "word_chars": _per_row(common._IN_WORD[raw] & ((raw & 0xC0) != 0x80), off),
           "n_symbols": _per_row(_IS_SYMBOL[raw], off)}
    # lines: ranges between line feeds and text ends, compared by hash
    feeds = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([off[:-1], feeds + 1]))
    end = np.sort(np.concatenate([feeds, off[1:]]))
    row = np.searchsorted(off[1:], feeds, side="right")
    row = np.sort(np.concatenate([np.arange(rows), row]))
    wordy = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, row = start[wordy], end[wordy], row[wordy]
    kept, _ = common.distinct_per_row(row, w.ranges(start, end))
    out["n_dup_lines"] = np.bincount(row, minlength=rows) - np.bincount(kept, minlength=rows)
    # 5-word windows found twice or more
    r, first, h = common.shingles(w, 5)
    full = w.n[r] >= 5
    r, first, h = r[full], first[full], h[full]
    order = np.lexsort((h, r))
    same = (r[order][1:] == r[order][:-1]) & (h[order][1:] == h[order][:-1])
    twice = np.zeros(len(r), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + 5, -1)
    covered = np.cumsum(cover)[:-1] > 0
    out["n_repeat_words"] = np.bincount(w.row[covered], minlength=rows).astype(np.int64)
    return w, out


def _entropy(ids: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Token entropy of each text, and its share of the most that so many
    tokens of a vocabulary of that size can reach."""
    row = np.repeat(np.arange(len(n)), n)
    key = np.sort(row.astype(np.int64) << 32 | ids.astype(np.int64))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    at = key[new] >> 32 if len(key) else new
    p = count / np.maximum(n, 1)[at]
    entropy = np.bincount(at, weights=-p * np.log2(p), minlength=len(n))
    return entropy, np.where(n > 1, entropy / np.log2(np.clip(n, 2, size)), 0.0)


def fertility(col: pa.Array, path: str, second: str, word_chars: np.ndarray) -> dict:
    """Measures over the words of each text (0 tokens: all zero)."""
    cache, byte, tok, cache2, size2 = vocabularies(path, second)
    ids, n = wordcache.encode_texts(col, cache, "words")
    fall = np.bincount(np.repeat(np.arange(len(n)), n), weights=byte[ids], minlength=len(n))
    entropy, ratio = _entropy(ids, n, len(byte))
    ids, n2 = wordcache.encode_exact(col, cache2, tok, "split", r"<\|")
    return {"n_tokens": n, "chars_per_token": word_chars / np.maximum(n, 1), "fallback_share": fall / np.maximum(n, 1),
            "token_entropy": entropy, "entropy_ratio": ratio, "n_tokens_2": n2, "chars_per_token_2": word_chars / np.maximum(n2, 1),
            "entropy_ratio_2": _entropy(ids, n2, size2)[1]}


def judge(lang: list, got: dict, bands: dict, min_tokens: int, fences: dict) -> np.ndarray:
    """True where every measure lies within the language's limits and fences."""
    ok = np.ones(len(lang), bool)
    keys = np.array([x if x in bands else "*" for x in lang], object)
    for k in set(keys.tolist()):
        rows = keys == k
        for name, (lo, hi) in {**bands["*"], **bands[k]}.items():
            v = got[name][rows]
            ok[rows] &= (v >= lo) & (v <= hi)
    for name, tokens, scaled, *_ in FENCED:
        n = np.maximum(got[tokens], 1)
        cell = np.zeros(len(lang), np.int64) if scaled else _cell(n)
        of = [fences.get((name, x or "*", c)) or fences.get((name, "*", c)) or (0.0, np.inf) for x, c in zip(lang, cell.tolist())]
        centre, reach = np.array(of, float).reshape(-1, 2).T
        ok &= np.abs(got[name] - centre) * (np.sqrt(n) if scaled else 1) <= reach
    return ok | (got["n_tokens"] < min_tokens)


def _cell(n: np.ndarray) -> np.ndarray:
    """Half octaves of the number of tokens."""
    return np.floor(2 * np.log2(n)).astype(np.int64)


def fences_of(measured: DataFrame) -> dict:
    """(measure, language or "*", cell) -> (centre, reach): the median, and
    WIDTH times the spread by the median deviation, over the rows that pass
    the base rules. Rows with the same measures (copies) count once.

    The values are counted in steps, so a group's state is bounded whatever
    its rows, and the result does not depend on how the rows are dealt.
    """
    names = [x[0] for x in FENCED]
    rows = measured.where(f"not base_failed and n_tokens >= {MIN_TOKENS} and n_tokens_2 >= 1") \
        .select(F.coalesce("lang", F.lit("*")).alias("lang"), "n_tokens", "n_tokens_2", *names).distinct()
    step = lambda c: F.round(F.least(c, F.lit(float(LARGEST))) * STEPS).cast("long")
    long = rows.select(F.explode(F.array_distinct(F.array("lang", F.lit("*")))).alias("lang"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(name).alias("v"),
                 F.sqrt(tokens) if scaled else F.lit(1.0),
                 F.lit(0).cast("long") if scaled else F.floor(2 * F.log2(tokens)).cast("long")).cast(
                     "struct<name:string,v:double,w:double,cell:long>")
        for name, tokens, scaled, *_ in FENCED])).alias("m")).select("lang", "m.*")
    key = ["name", "lang", "cell"]
    centres = long.groupBy(key).agg((F.percentile(step(F.col("v")), 0.5) / STEPS).alias("centre"), F.count("*").alias("n")) \
        .where(f"n >= {MIN_DOCS}").drop("n")
    # a row per measure, language and length class: few, but languages are free text
    centres = cut_lineage(centres)
    spreads = long.join(F.broadcast(centres) if centres.count() <= MAX_BROADCAST else centres, key).groupBy(*key, "centre").agg(
        (F.percentile(step(F.abs(F.col("v") - F.col("centre")) * F.col("w")), 0.5) / STEPS).alias("off"))
    least = {x[0]: x[3:] for x in FENCED}
    out = {}
    for r in spreads.collect():
        part, plus = least[r["name"]]
        out[r["name"], r["lang"], r["cell"]] = (r["centre"], WIDTH * max(1.4826 * r["off"], part * r["centre"] + plus))
    return out


def measures(col: pa.Array, path: str, second: str) -> dict:
    """All counts and measures of a batch of texts."""
    col = pc.fill_null(col, "")
    _, got = base_counts(col)
    got |= fertility(col, path, second, got["word_chars"])
    got["base_failed"] = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
    return got


MEASURED = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
            "n_tokens long, chars_per_token double, fallback_share double, token_entropy double, entropy_ratio double, "
            "n_tokens_2 long, chars_per_token_2 double, entropy_ratio_2 double")
COLUMNS = MEASURED.replace("n_tokens long", "kept boolean, n_tokens long", 1)
TYPES = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _measured(docs: DataFrame, names: list[str], path: str, second: str, text_col: str, lang_col: str) -> DataFrame:
    """The named columns as k0, k1, ..., the language, and every row's measures."""
    common.ship(docs.sparkSession)
    src = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(names)], docs[lang_col].cast("string").alias("lang"),
                      docs[text_col].cast("string").alias("text"))
    kinds = [f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(names))]

    def run(batches):
        from hourcast.llm import common as c, fertility as f
        cols = [x.split() for x in f.MEASURED.split(", ")]
        for b in c.slices(batches, "text"):
            got = f.measures(b.column(len(names) + 1), path, second)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names) + 1)] + [pa.array(got[n], f.TYPES[t]) for n, t in cols],
                                             names=[f"k{i}" for i in range(len(names))] + ["lang"] + [n for n, _ in cols])

    return src.mapInArrow(run, ", ".join([*kinds, "lang string", MEASURED]))


def _judged(measured: DataFrame, bands: dict) -> DataFrame:
    """The measured rows with the verdict."""
    fences = measured.sparkSession.sparkContext.broadcast(fences_of(measured))

    def run(batches):
        from hourcast.llm import fertility as f
        for b in batches:
            got = {n: b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in (x.split()[0] for x in f.MEASURED.split(", "))}
            lang = b.column(b.schema.get_field_index("lang")).to_pylist()
            kept = ~got["base_failed"].astype(bool) & f.judge(lang, got, bands, f.MIN_TOKENS, fences.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept, pa.bool_())], names=[*b.schema.names, "kept"])

    return measured.mapInArrow(run, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in measured.schema) + ", kept boolean")


def rate(docs: DataFrame, path: str, bands: dict | None = None, id_col: str = "doc_id", text_col: str = "text",
         lang_col: str = "lang", keep: list[str] | None = None, second: str | None = None) -> DataFrame:
    """One row per document: base counts, measures and the verdict.

    Null text counts as empty: no words, base_failed. Null language, and one
    with too few texts: the fences of all languages. Repeated rows are rated
    each. ``keep`` names input columns to carry along under the same names as
    prefix columns; ``second`` is the second vocabulary's file.
    """
    names = keep or [id_col]
    measured = cut_lineage(_measured(docs, names, path, second or wordcache.tokenizer_path(SECOND), text_col, lang_col))
    out = _judged(measured, bands or BANDS)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], *[x.split()[0] for x in COLUMNS.split(", ")])


def keep_good(docs: DataFrame, path: str, bands: dict | None = None, text_col: str = "text", lang_col: str = "lang",
              second: str | None = None) -> DataFrame:
    """The rows, all columns unchanged, that ``rate`` would keep. The rows
    are written once with their measures (compressed) and read again."""
    spark, names = docs.sparkSession, docs.columns
    where = f"{checkpoint_dir(spark)}/measured-{uuid.uuid4().hex}"
    _measured(docs, names, path, second or wordcache.tokenizer_path(SECOND), text_col, lang_col).write.parquet(where)
    out = _judged(spark.read.parquet(where), bands or BANDS).where("kept")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])
