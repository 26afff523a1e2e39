"""Operators 11 to 13 against the library, brute force and edge rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hourcast.llm import byte_bpe, collocations, queries, spelling
from tests.llm.test_operators import LOWER, SCHEMA, SF, docs, edges, none, path  # noqa: F401

CLASH = "doc_id long, text string, lang string, id string, n string, ids string, decoded string, word string, phrase string, key string, size string"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path(queries.BYTE_RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, g, "a", "b", "c", "d", "e", "f", "g", "h") for i, t, g in rows], CLASH)


# 11 -------------------------------------------------------------------------------
def split(ids, n):
    return [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])]


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 30_000).astype(np.uint64))
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    other = h.slots(keys ^ np.uint64(1 << 63))
    assert other.min() >= -1 and other.max() < len(keys)
    assert byte_bpe.PerfectHash(keys[:0]).slots(keys[:5]).tolist() == [-1] * 5


def test_bpe_equals_the_library(library):
    enc = byte_bpe.Encoder(path(queries.BYTE_RANKS), limit=50)
    r = random.Random(5)
    parts = [*"  \n\t'strevmldRSabc12.,!?é  漢😀́\x1c\x85٣  ", "'s", "'ll", "'re", " '", "\r\n", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(20_000)]
    texts += [None, "", "a" * 50_000, "ab" * 20_000 + " " * 999 + "x", "é" * 9_000, "!" * 5_000, "'" * 30 + "s"]
    for lo in range(0, len(texts), 4_000):  # the small memory starts anew in between
        part = texts[lo:lo + 4_000]
        ids, n = enc.encode(pa.array(part, pa.string()))
        assert split(ids, n) == [library.encode_ordinary(t or "") for t in part]
        raw, size = enc.vocabulary.decode(ids.astype(np.int64), n)
        assert raw.tobytes() == "".join(t or "" for t in part).encode()
        assert size.tolist() == [len((t or "").encode()) for t in part]


def test_every_code_point_is_cut_as_the_library_does(library):
    enc = byte_bpe.Encoder(path(queries.BYTE_RANKS))
    texts = [f"a{c}1 {c}{c}'s" for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)])]
    for lo in range(0, len(texts), 50_000):
        part = texts[lo:lo + 50_000]
        assert split(*enc.encode(pa.array(part))) == library.encode_ordinary_batch(part, num_threads=2)


def test_heap_merge_is_lowest_rank_leftmost_first():
    rank = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"bc": 299, b"aa": 301, b"aaa": 302, b"abab": 400}
    assert byte_bpe.heap_merge(b"abc", rank) == [97, 299]
    assert byte_bpe.heap_merge(b"aaaaa", rank) == [301, 302]
    assert byte_bpe.heap_merge(b"ababab", rank) == [400, 300]
    assert byte_bpe.heap_merge(b"", rank) == []


def test_op11_rows(spark, docs, library):  # noqa: F811
    got = {r.doc_id: r for r in queries.op11(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert tuple(got[r.doc_id]) == (r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                        hashlib.sha256((r.text or "").encode()).hexdigest())


def test_op11_edges(spark, edges, none, library):  # noqa: F811
    for frame in (edges, clashing(spark, [(1, "x y", None), (1, "x y", None), (None, None, None)])):
        p = path(queries.BYTE_RANKS)
        got = byte_bpe.decode_documents(byte_bpe.encode_documents(frame, p), p).collect()
        want = [(r.doc_id, library.encode_ordinary(r.text or ""), bytearray((r.text or "").encode())) for r in frame.collect()]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.encode_documents(none, path(queries.BYTE_RANKS)).count() == 0
    bad = spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode_documents(bad, path(queries.BYTE_RANKS)).collect()


# 12 -------------------------------------------------------------------------------
def brute_collocations(rows, min_count=10, longest=3, limit=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        rows_ = []
        for p, a in cand.items():
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not inside:
                rows_.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


WORDS = ["a", "of", "the", "Łódź", "b c", "<x>", "zz", "q"]


def noise(seed, n, langs):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(WORDS[:5] if r.random() < 0.8 else WORDS) + r.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b", " A "])
                           for _ in range(r.randrange(60)))
    return [(i, text(), r.choice(langs)) for i in range(n)]


@pytest.mark.parametrize("min_count,longest,limit", [(10, 3, 2000), (3, 4, 7), (2, 2, 50), (10**6, 3, 10)])
def test_collocations(spark, min_count, longest, limit):
    rows = noise(min_count, 120, ["en", None, "und", "", "es"]) + [(None, None, "en"), (1, "", None), (2, " ,. ", "en"), (3, "q q q q", "en"), (3, "q q q q", "en")]
    got = collocations.mine(clashing(spark, rows), min_count, longest, limit)
    assert sorted(map(tuple, got.collect())) == brute_collocations([(g, t) for _, t, g in rows], min_count, longest, limit)


def test_languages_and_words_do_not_mix(spark):
    rows = [(i, "en es en es", g) for i in range(20) for g in ("en", "es")] + [(90 + i, "es es", "en") for i in range(20)]
    got = collocations.mine(clashing(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_collocations([(g, t) for _, t, g in rows])


def test_border_failures_open_further_passes(spark):
    """Nothing frequent is in the sample (its key share is empty): every word
    is a border failure, then every pair, then the triples."""
    rows = [(i, "one two three four", "en") for i in range(30)]
    frame = clashing(spark, rows).selectExpr("'k' AS one_key", "text", "lang")
    for share in (2, 3, 5, 7):
        m = collocations.frequent_phrases(frame, key_col="one_key", share=share)
        if m.passes > 1:
            break
    assert m.passes == 3 and m.failures[0] > 0 and m.failures[1] > 0
    got = {r.phrase: r.n for r in m.frequent.where("size = 3").collect()}
    assert got == {"one two three": 30, "two three four": 30}
    whole = collocations.frequent_phrases(frame, key_col="one_key", share=1)
    assert whole.passes == 1 and whole.failures == [] and sorted(map(tuple, whole.frequent.collect())) == sorted(map(tuple, m.frequent.collect()))


def test_phrase_hashes_are_those_of_the_scan():
    lang, text = pa.array(["en", "de"]), pa.array(["one two three", "x  yy. z zz\tzzz"])
    s = collocations.Slice(lang, text)
    assert s.phrases(np.array([0, 5]), 3).to_pylist() == ["one two three", "z zz zzz"]
    h = collocations._longer(collocations._longer(s.a[[0, 5]], s.a[[1, 6]]), s.a[[2, 7]])
    assert (collocations.phrase_hashes(lang, pa.array(["one two three", "z zz zzz"]), 3) == h).all()


def test_scores_beyond_64_bits(spark):
    n = 4_000_000_000_000
    f = spark.createDataFrame([("en", 2, "a b", n), ("en", 1, "a", n + 1), ("en", 1, "b", n + 7), ("en", 0, "", 2 * n + 8)],
                              "lang string, size int, phrase string, n long")
    (r,) = collocations.collocations(f).collect()
    assert r.score == 1_000_000 * n * n // ((n + 1) * (n + 7)) == 999_999


def test_op12_equals_its_sql(spark):
    from tools.oracle_check import compare, duck
    assert compare(spark, duck(SF), "op12_collocations", queries.op12, queries.OP12_SQL, SF, verbose=False)


def test_collocations_of_nothing(spark, none):  # noqa: F811
    assert collocations.mine(none).count() == 0


# 13 -------------------------------------------------------------------------------
def brute_words(rows, least=7, count=2):
    c = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w] += 1
    return {w: n for w, n in c.items() if len(w) >= least and n >= count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a != b and (a[p:] == b[p + 1:] or len(a) == len(b) and a[p + 1:] == b[p + 1:])


def brute_variants(words, ratio=10):
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= ratio * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w
    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def random_words(seed, n=400):
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(r.randrange(7, 12))) for _ in range(n // 4)]
    out = set(base)
    for w in base * 3:
        i = r.randrange(len(w) + 1)
        out.add(r.choice([w[:i] + r.choice("abc") + w[i:], w[:i] + w[i + 1:], w[:i] + "x" + w[i + 1:]]))
    return {w: 10 ** r.randrange(4) * r.randrange(1, 4) for w in out if w}


@pytest.mark.parametrize("block,matrix", [(1500, 4_000_000), (1, 4_000_000), (8, 50)])
def test_variants(spark, monkeypatch, block, matrix):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "MATRIX", matrix)
    words = random_words(block)
    words |= {"z" * 30_000: 5, "z" * 30_001: 80, "z" * 29_999 + "y": 2}  # long ones have tiles of their own
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert set(map(tuple, got.collect())) == brute_variants(words)


def test_chains_of_forms_end_at_their_root(spark):
    words = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10_000, "aabbbbb": 100_000}
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aabbbbb") and got["aabbbbb"] == (None, "aabbbbb")


def test_a_tie_goes_to_the_first_word(spark):
    words = {"kitten s".replace(" ", ""): 1, "kittenz": 30, "kittena": 30, "bittens": 30}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert (got["kittens"].form, got["kittens"].n_near, got["kittens"].form_n) == ("bittens", 3, 30)


def test_word_counts(spark, docs, edges, none):  # noqa: F811
    odd = [(i, "Straße straßen ÀÉÎÕÜÝÞ×÷ÿ xÿŸabcdefg naïveté's naïveté " * 9 + "École" * 40 + "Āabcdefgh", None) for i in range(60)] \
        + [(None, "nullnull nullnull", None)] * 2 + [(5, None, None), (5, "", None)]
    for frame in (docs, edges, clashing(spark, odd)):
        got = {r.word: r.n for r in spelling.word_counts(frame).collect()}
        assert got == brute_words([(r.doc_id, r.text) for r in frame.collect()])
    assert spelling.word_counts(none).count() == 0
    assert spelling.variants(spelling.word_counts(none)).count() == 0


def test_op13_rows(spark, docs):  # noqa: F811
    words = brute_words([(r.doc_id, r.text) for r in docs.collect()])
    by_size = defaultdict(dict)
    for w, n in words.items():
        by_size[len(w)][w] = n
    got = {r.word: tuple(r) for r in queries.op13(spark, SF).collect()}
    assert len(got) == len(words)
    for w in sorted(words)[::7]:  # each of these against all words
        near = [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 10 * words[w] else None
        assert got[w][:2] == (w, form) and got[w][3:] == (words[w], len(near), words[form] if form else None)
