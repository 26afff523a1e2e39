"""The registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hourcast.llm import (byte_bpe, chat, collocations, common, decontam, fertility, jaccard, packing, repair, secret_scan, spelling, token_counts,
                          toxicity, url_filter, wordcache)
from hourcast.session import cut_lineage

WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_documents(common.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["depth"] == 0)
    count = lambda kind: F.size(F.filter("spans", lambda s: (s["depth"] == 0) & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: s["depth"] > 0)).cast("long").alias("n_decoded"))


TRAP = "\\### Assistant: </turn> ok"


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, coalesce(lag(role) OVER w, 'start') AS before, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n,
    length(replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>')) AS escaped,
    length('### ') + length(role) + length(': ') + length('</turn>') + 1 AS frame
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + frame)::BIGINT AS formatted_chars,
  count(*) FILTER (NOT (before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user'))) AS n_out_of_order,
  bool_or(rn = n AND role = 'assistant') AS complete
FROM marked GROUP BY conv_id
"""


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(common.table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), wordcache.tokenizer_path(WORD_BPE))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = repair.new_dir(spark)
    repair.write(common.table(spark, sf_dir, "documents"), where, wordcache.tokenizer_path(BYTE_BPE), end_id=2)
    return repair.read(spark, where)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.rate(common.table(spark, sf_dir, "documents"), wordcache.tokenizer_path(PIECE_BPE))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), wordcache.tokenizer_path(WORD_BPE))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(common.table(spark, sf_dir, "pages"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = wordcache.tokenizer_path(BYTE_RANKS)
    encoded = byte_bpe.encode_documents(common.table(spark, sf_dir, "documents"), path)
    return byte_bpe.digest(byte_bpe.decode_documents(encoded, path))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(common.table(spark, sf_dir, "documents"), min_count=10, max_words=3, limit=2000)


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS i
  FROM (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)),
runs AS (SELECT lang, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY id ORDER BY i)),
occurrences AS (
  SELECT lang, 1 AS size, w AS phrase FROM runs
  UNION ALL SELECT lang, 2, w || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS n FROM occurrences GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
firsts AS MATERIALIZED (SELECT c.*, f.n AS l FROM cuts c JOIN f ON f.lang = c.lang AND f.phrase = c.x),
scored AS (
  SELECT c.*, f.n AS r, (1000000 * a::HUGEINT * a) // (l::HUGEINT * f.n) AS score
  FROM firsts c JOIN f ON f.lang = c.lang AND f.phrase = c.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
above AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM cand WHERE size = 3
    UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM cand WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN above u ON u.lang = b.lang AND u.phrase = b.phrase WHERE u.a IS NULL OR 100 * u.a < 50 * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank,
  k.phrase, k.a, k.l, k.r, t.n, k.score::BIGINT AS score
FROM kept k JOIN total t ON t.lang = k.lang QUALIFY rank <= 2000
"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(cut_lineage(spelling.word_counts(common.table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_secret_scan": op1, "op2_chat_format": op2, "op3_ngram_jaccard": op3, "op4_decontamination": op4,
    "op5_token_counts": op5, "op6_repair_output": op6, "op7_toxicity": op7, "op8_quality_fertility": op8,
    "op9_packing": op9, "op10_url_filter": op10, "op11_byte_bpe": op11,
    "op12_collocations": op12, "op13_spelling": op13,
}
ORACLE = {"op2_chat_format": OP2_SQL, "op12_collocations": OP12_SQL}
