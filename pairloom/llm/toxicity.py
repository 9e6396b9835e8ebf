"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of hashed words (those whose texts are positive more often than not, as the prior-corrected counts
of distinct sample texts have it) learns from confirmed toxic texts and from unlabelled ones; negative labels are
never used.  Its risk is corrected by the class prior: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).  It is
fitted in numpy on a bounded sample (POSITIVES and UNLABELLED distinct texts, by hash order) and scores every whole text in its task.

Defined results: null and empty texts have no words and get the score of the bias alone; repeated rows repeat their results; without a
confirmed toxic text every score is 0; a null doc_id counts as held out; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import U64, mix, table, text_bytes, word_hashes

POSITIVES, UNLABELLED = 6_000, 10_000
FEATURES = 1 << 20
#: A feature must stand in so many of the positive texts, and in such a share of them.
LEAST_TEXTS, LEAST_SHARE = 3, 0.01
FOLDS = 5


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def word_features(data: bytes) -> np.ndarray:
    """Distinct hashed words of a text."""
    return np.unique(word_hashes(data) & U64(FEATURES - 1)).astype(np.int64)


def sampled_features(docs: DataFrame, ids: DataFrame) -> list[np.ndarray]:
    """Features of the distinct texts of a bounded set of ids."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"words": [word_features(text_bytes(t)).astype(np.int32) for t in batch["text"]]})

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").mapInPandas(read, "words array<int>")
    return [np.asarray(w, np.int64) for w in rows.distinct().orderBy(F.xxhash64("words"), F.col("words")).toPandas()["words"]]


def unlike(rows: list[np.ndarray], sketches: int = 16) -> list[np.ndarray]:
    """The texts without those that share most of their words with an earlier one: copies would make rare words look telling."""
    kept, marks = [], np.zeros((len(rows), sketches), np.uint32)
    seeds = mix(np.arange(1, sketches + 1, dtype=U64))
    for row in rows:
        if not len(row):
            continue
        mark = (mix(row.astype(U64)[:, None] ^ seeds[None, :]).min(axis=0) >> U64(8)).astype(np.uint32)
        if not ((marks[: len(kept)] == mark).sum(axis=1) > sketches * 0.5).any():
            marks[len(kept)] = mark
            kept.append(row)
    return kept


class NonNegativeClassifier:
    """Logistic model trained on the non-negative risk by full-batch Adam."""

    def __init__(self, prior: float, steps: int = 400, rate: float = 0.05, penalty: float = 2e-4):
        self.prior, self.steps, self.rate, self.penalty = prior, steps, rate, penalty

    def fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> NonNegativeClassifier:
        positive, unlabelled = unlike(positive), unlike(unlabelled) or unlabelled
        count = lambda rows: np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=FEATURES)
        ours, all_ = count(positive), count(unlabelled)
        likely = self.prior * ours / max(1, len(positive)) >= 0.5 * all_ / max(1, len(unlabelled))
        kept = np.flatnonzero((ours >= min(max(LEAST_TEXTS, LEAST_SHARE * len(positive)), max(1, len(positive)))) & likely)
        column = np.full(FEATURES, -1, np.int64)
        column[kept] = np.arange(len(kept))
        self.matrices = []
        for rows in (positive, unlabelled):
            own = [column[r][column[r] >= 0] for r in rows]
            self.matrices.append((np.repeat(np.arange(len(own)), [len(o) for o in own]), np.concatenate([*own, np.zeros(0, np.int64)]), len(own)))
        w, b = np.zeros(len(kept)), float(np.log(self.prior / (1 - self.prior)))
        m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
        for step in range(1, self.steps + 1):
            gradient = self._gradient(w, b) + np.append(self.penalty * w, 0)
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            move = self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        self.weights = np.zeros(FEATURES, np.float32)
        self.weights[kept] = w
        self.bias = float(b)
        del self.matrices
        return self

    def _gradient(self, w: np.ndarray, b: float) -> np.ndarray:
        (pr, pc, pn), (ur, uc, un) = self.matrices
        pn, un = max(pn, 1), max(un, 1)
        score = lambda rows, cols, n: np.bincount(rows, w[cols], n) + b
        sp, su = 1 / (1 + np.exp(-score(pr, pc, pn))), 1 / (1 + np.exp(-score(ur, uc, un)))
        soft = lambda p: -np.log(np.maximum(1 - p, 1e-12))
        negative = soft(su).mean() - self.prior * soft(sp).mean()
        gp = self.prior * (sp - 1) / pn  # of the positives' risk of being called negative
        gu = np.zeros(un)
        if negative >= 0:
            gu, gp = su / un, gp - self.prior * sp / pn
        else:
            # The unlabelled risk fits less than nothing: step back from it, as the non-negative estimator asks.
            gu, gp = -su / un, self.prior * sp / pn
        return np.append(np.bincount(pc, gp[pr], len(w)) + np.bincount(uc, gu[ur], len(w)), gp.sum() + gu.sum())


def trained(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> NonNegativeClassifier | None:
    """Learns from rows that are not held out; None if none of them is confirmed as toxic."""
    own = labels.where(~held_out() & F.col("doc_id").isNotNull())
    marked = own.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counted = marked.agg(F.avg("toxic").alias("prior"), F.sum("toxic").alias("n")).first()
    if not counted.n:
        return None
    prior = min(max(counted.prior, 0.01), 0.5)
    drawn = lambda ids, n: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    known = drawn(marked.where("toxic = 1").select("doc_id"), positives)
    free = drawn(docs.where(~held_out()).select("doc_id"), unlabelled)
    p, u = sampled_features(docs, known), sampled_features(docs, free)
    return NonNegativeClassifier(prior).fit(p, u) if p and u else None


def scored(docs: DataFrame, model: NonNegativeClassifier | None) -> DataFrame:
    """(doc_id, held_out, score) for every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias) if model else None)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if shared.value is None:
                values = np.zeros(len(batch))
            else:
                weights, bias = shared.value
                margin = np.array([weights[word_features(text_bytes(t))].sum() + bias for t in batch["text"]], float)
                values = 1 / (1 + np.exp(-margin))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": values})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInPandas(
        score, "doc_id long, held_out boolean, score double")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = trained(docs, table(spark, folder, "labels"))
    return scored(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
