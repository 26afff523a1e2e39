"""Toxicity by weak supervision (operator 7).

Voters: every lexicon word and word-start pattern that goes along with the
toxic label in the training fold casts a vote where it occurs. A generative
model holds, for each class, the rate at which each voter fires; expectation
maximisation estimates these rates without trusting any single label (the
given label is one more, noisy voter), and voters that fire together beyond
what the classes explain share their weight. Its posterior labels train a
linear classifier on the words and patterns, which scores every text.

Fitting uses at most ``max_train`` labelled rows, chosen by a hash of the
id; scoring is one pass over all rows without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hourcast.llm import common
from hourcast.session import cut_lineage

U64 = np.uint64
#: bound of the labelled rows that the models are fitted on
MAX_TRAIN = 16_000
#: bytes of a word's start that make a pattern
PATTERN_BYTES = 7
MAX_VOTERS = 400
MAX_FEATURES = 8000
MIN_DOCS = 4
#: how far beyond chance (in deviations) a voter goes along with the label
MIN_Z = 5.0
FEATURE_Z = 3.0
#: P(given label is toxic) for clean and toxic rows, before seeing any
LABEL_RATES = (0.03, 0.9)


def features(col) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature): lower-cased words and word starts, hashed."""
    w = common.Words(col, letters=True)
    words = common.mix(w.hashes(), 1)
    long = (w.end - w.start) > PATTERN_BYTES
    starts = common.mix(w.ranges(w.start[long], w.start[long] + PATTERN_BYTES), 2)
    row = np.concatenate([w.row, w.row[long]])
    return common.distinct_per_row(row, np.concatenate([words, starts]))


@dataclass
class Model:
    keys: np.ndarray  # features, ascending
    weight: np.ndarray
    bias: float

    def score(self, row: np.ndarray, feat: np.ndarray, rows: int) -> np.ndarray:
        if not len(self.keys):
            return np.full(rows, _sigmoid(self.bias))
        at = np.searchsorted(self.keys, feat)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == feat
        return _sigmoid(self.bias + np.bincount(row[hit], weights=self.weight[at[hit]], minlength=rows))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """(posterior of class 1 per row, estimates). votes: rows x voters, 0/1,
    where 0 abstains; two more voters: whether no voter fired, and the given
    label, whose rates are held near LABEL_RATES by a prior of a tenth of
    the rows, so that the classes keep their meaning."""
    silent = (votes.sum(1) == 0).astype(np.float64)
    v = np.concatenate([votes, silent[:, None]], 1).astype(np.float64)
    post = np.where(label == 1, 0.95, 0.05)
    share, anchor = np.ones(v.shape[1]), 0.1 * len(v)
    for r in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        rate = [(w @ v + 0.5) / (w.sum() + 1.0) for w in (1 - post, post)]
        given = [(w @ label + anchor * a) / (w.sum() + anchor) for w, a in zip((1 - post, post), LABEL_RATES)]
        if r in (1, 5, 10):
            # correlations that the classes leave: residual of each voter,
            # given the row's class probabilities
            res = v - np.outer(1 - post, rate[0]) - np.outer(post, rate[1])
            sd = np.sqrt((res ** 2).mean(0)) + 1e-9
            corr = (res.T @ res) / len(v) / np.outer(sd, sd)
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + np.clip(corr, 0, 1).sum(1))
        logit = np.log(prior / (1 - prior)) + v @ (share * np.log(rate[1] / rate[0]))
        logit += np.where(label == 1, np.log(given[1] / given[0]), np.log((1 - given[1]) / (1 - given[0])))
        post = _sigmoid(logit)
    return post, {"prior": prior, "rate": rate, "share": share, "label_rates": given}


def _rates(row, feat, label):
    keys, code = np.unique(feat, return_inverse=True)
    pos = np.bincount(code, weights=label[row], minlength=len(keys))
    return keys, code, pos, np.bincount(code, minlength=len(keys)) - pos


def fit(row: np.ndarray, feat: np.ndarray, label: np.ndarray) -> Model:
    """Voters, label model and classifier from distinct (row, feature)."""
    rows, ones = len(label), float(label.sum())
    if not rows or ones in (0.0, float(rows)):
        # nothing to tell apart: the share of toxic rows, or no toxicity known
        share = (ones + 0.5) / (rows + 1) if rows else 0.05
        return Model(np.zeros(0, U64), np.zeros(0), float(np.log(share / (1 - share))))
    keys, code, pos, neg = _rates(row, feat, label)
    lift = np.log((pos + 0.5) / (ones + 1)) - np.log((neg + 0.5) / (rows - ones + 1))
    n, base = pos + neg, ones / rows
    beyond = (pos - n * base) / np.sqrt(n * base * (1 - base))
    strong = np.flatnonzero((n >= MIN_DOCS) & (lift > 1.0) & (beyond >= MIN_Z))
    strong = strong[np.lexsort((keys[strong], -lift[strong] * np.sqrt(pos[strong])))][:MAX_VOTERS]
    at = np.full(len(keys), -1)
    at[strong] = np.arange(len(strong))
    votes = np.zeros((rows, len(strong)), np.uint8)
    on = at[code] >= 0
    votes[row[on], at[code[on]]] = 1
    post, _ = label_model(votes, label)
    # the classifier sees the features that the posterior labels tell apart
    ppos = np.bincount(code, weights=post[row], minlength=len(keys))
    z = (ppos - n * post.mean()) / np.sqrt(n * post.mean() * (1 - post.mean()) + 1e-9)
    use = np.flatnonzero((n >= MIN_DOCS) & (np.abs(z) >= FEATURE_Z))
    use = use[np.lexsort((keys[use], -np.abs(z[use])))][:MAX_FEATURES]
    col = np.full(len(keys), -1)
    use = np.sort(use)
    col[use] = np.arange(len(use))
    on = col[code] >= 0
    w, b = logistic(row[on], col[code[on]], post, rows, len(use))
    return Model(keys[use], w, b)


def logistic(row, col, target, rows, cols, l2: float = 0.5, steps: int = 500, rate: float = 0.1):
    """L2-penalised logistic regression on 0/1 features by Adam."""
    w, b = np.zeros(cols + 1), 0.0
    m, s = np.zeros(cols + 1), np.zeros(cols + 1)
    w[-1] = np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6))
    for i in range(1, steps + 1):
        p = _sigmoid(w[-1] + np.bincount(row, weights=w[col], minlength=rows))
        err = p - target
        g = np.empty(cols + 1)
        g[:-1] = np.bincount(col, weights=err[row], minlength=cols) + l2 * w[:-1]
        g[-1] = err.sum()
        g /= rows
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** i)) / (np.sqrt(s / (1 - 0.999 ** i)) + 1e-8)
    return w[:-1], float(w[-1])


def held_out(id_col):
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``max_train`` labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    common.ship(spark)
    lab = labels.where("toxic is not null").select(labels[id_col].alias("id"), F.col("toxic").cast("int").alias("toxic")) \
        .where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    lab = lab.groupBy("id").agg(F.max("toxic").alias("toxic"))  # repeated labels: toxic if any says so
    lab = cut_lineage(lab.orderBy(F.xxhash64("id"), "id").limit(max_train))
    # bounded by max_train rows
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(lab), "id") \
        .select("id", "text", "toxic")
    # a document id may come more often than its label: the bound holds for rows too
    src = src.limit(2 * max_train) if max_train else src

    def run(batches):
        from hourcast.llm import common as c, toxicity as t
        for b in c.slices(batches, "text"):
            row, feat = t.features(b.column(1))
            n = np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), c.list_array(feat.view(np.int64), np.concatenate([[0], np.cumsum(n)]), pa.int64())],
                names=["id", "toxic", "f"])

    kind = src.schema["id"].dataType.simpleString()
    got = src.mapInArrow(run, f"id {kind}, toxic int, f array<long>").toArrow()
    got = got.sort_by("id").combine_chunks()  # the same order whatever the partitions
    n = pc.list_value_length(got["f"]).to_numpy()
    row = np.repeat(np.arange(len(got)), n)
    flat = pc.list_flatten(got["f"]).to_numpy().view(U64)
    return fit(row, flat, got["toxic"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per row. Null or empty text: the
    score of a text without words. Repeated rows are scored each. Other
    columns are not read."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)  # at most MAX_FEATURES weights
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        from hourcast.llm import common as c, toxicity as t
        for b in c.slices(batches, "text"):
            row, feat = t.features(b.column(1))
            p = shared.value.score(row, feat, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, score double, predicted int")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", "predicted")
