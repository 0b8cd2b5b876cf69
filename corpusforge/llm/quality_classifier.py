"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), where the pair term is, by the sum-of-squares
identity, half of sum_f ((sum v_if x_i)**2 - sum v_if**2 x_i**2): linear in the features of a text. Words of the whole text are
hashed; statistics and the text's length are cut into steps, each step a feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import Words, arrow_task, fit_sample, fold, sums_between, table

WORD_DIMS, STEPS = 1 << 15, 24
_CLASSES = ["#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "|", ".,;:?", "\n"]
N_STATISTICS = len(_CLASSES) + 6
DIMS = WORD_DIMS + N_STATISTICS * STEPS


def _distinct(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    """Distinct hashes of each document; doc is ascending."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return np.bincount(d[new], minlength=n_docs)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids and values of a batch of texts with the offsets of each text (as in a CSR matrix)."""
    words = Words(texts, lower=False)
    n = words.n_docs
    chars = np.maximum(np.diff(words.offsets), 1).astype(float)
    n_words = np.diff(words.first).astype(float)
    some = np.maximum(n_words, 1)
    counts = []
    for c in _CLASSES:
        mark = np.zeros(256, np.uint8)
        mark[[ord(x) for x in c]] = 1
        counts.append(sums_between(mark[words.data], words.offsets))
    line_separators = np.zeros(256, bool)
    line_separators[10] = True
    lines = Words(texts, lower=False, separators=line_separators)
    n_lines = np.maximum(np.diff(lines.first), 1)
    bucket = (words.hashes() % np.uint64(WORD_DIMS)).astype(np.int64)
    pairs, times = np.unique(words.doc * WORD_DIMS + bucket, return_counts=True)
    doc, feature = pairs // WORD_DIMS, pairs % WORD_DIMS
    distinct = np.bincount(doc, minlength=n)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(doc, value * value, n))
    value = value / np.maximum(norm[doc], 1e-9)
    rates = [x / chars for x in counts[:-1]] + [counts[-1] / some]
    repeated = 1 - np.minimum(1, _distinct(lines.doc, lines.hashes(), n) / n_lines)
    shape = [repeated, distinct / some, (sums_between(words.end - words.start, words.first) / some) / 40, np.log1p(n_words) / 14, some / n_lines / 2000, np.log1p(chars) / 18]
    columns = np.array([np.sqrt(np.clip(x, 0, 1)) for x in rates + shape])
    step = np.minimum((columns * STEPS).astype(np.int64), STEPS - 1)
    own = (WORD_DIMS + np.arange(N_STATISTICS)[:, None] * STEPS + step).T
    all_doc = np.concatenate([doc, np.repeat(np.arange(n), N_STATISTICS)])
    order = np.argsort(all_doc, kind="stable")
    ids = np.concatenate([feature, own.ravel()])[order]
    values = np.concatenate([value, np.full(n * N_STATISTICS, 0.5)])[order]
    return ids, values, np.concatenate([[0], np.cumsum(np.bincount(all_doc, minlength=n))])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, ids: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of factors that gradients need."""
        v = self.factors[ids] * values[:, None]
        sums = np.stack([sums_between(v[:, k], offsets) for k in range(v.shape[1])], 1)
        squares = sums_between((v * v).sum(1), offsets)
        return self.bias + sums_between(self.linear[ids] * values, offsets) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, ids: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(ids, values, offsets)[0], -30, 30)))


def train(ids: np.ndarray, values: np.ndarray, offsets: np.ndarray, labels: np.ndarray, rank: int = 6, epochs: int = 8, rate: float = 0.08, decay: float = 1e-5, batch: int = 128, seed: int = 3) -> FactorisationMachine:
    """Logistic loss by adaptive gradient steps; without rows of both classes the score is the share of label 1."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    share = float(np.clip(labels.mean() if n else 0.5, 0.01, 0.99))
    model = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(DIMS), rng.normal(0, 0.02, (DIMS, rank)))
    if n == 0 or labels.min() == labels.max():
        model.factors[:] = 0
        return model
    g_linear, g_factors, g_bias = np.full(DIMS, 1e-3), np.full((DIMS, rank), 1e-3), 1e-3
    sizes = np.diff(offsets)
    for _ in range(max(epochs, min(60, 400 * batch // n))):  # a small sample is gone over more often
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            take = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows])
            i, x, cut = ids[take], values[take], np.concatenate([[0], np.cumsum(sizes[rows])])
            margin, sums = model.margin(i, x, cut)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            e = np.repeat(error, sizes[rows])
            unique, place = np.unique(i, return_inverse=True)
            d_linear = np.bincount(place, e * x, len(unique)) + decay * model.linear[unique]
            d = (e * x)[:, None] * (np.repeat(sums, sizes[rows], axis=0) - model.factors[i] * x[:, None])
            d_factors = np.stack([np.bincount(place, d[:, k], len(unique)) for k in range(rank)], 1) + decay * model.factors[unique]
            g_linear[unique] += d_linear**2
            g_factors[unique] += d_factors**2
            g_bias += error.sum() ** 2
            model.linear[unique] -= rate * d_linear / np.sqrt(g_linear[unique])
            model.factors[unique] -= 0.5 * rate * d_factors / np.sqrt(g_factors[unique])
            model.bias -= rate * error.sum() / np.sqrt(g_bias)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_fit_rows: int = 6000) -> FactorisationMachine:
    """Fitted on the driver from the features of a bounded sample of labelled rows (max_fit_rows, by a hash of the id); a text
    gives at most WORD_DIMS + N_STATISTICS features, so the sample takes at most about 0.4 MB a row, and 0.02 MB as a rule.

    Held-out rows never enter. Null texts count as empty; null labels, and labels of unknown and null ids, are left out; a
    doc_id with several labels stands once for each.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                ids, values, offsets = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.float32()))], ["doc_id", "label", "ids", "values"])

    sample = fit_sample(docs.select("doc_id", "text"), labels, label, max_fit_rows).select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    rows = sample.mapInArrow(arrow_task(extract), "doc_id bigint, label int, ids array<int>, values array<float>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks()
    if not len(rows):
        return train(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64), np.zeros(0))
    ids, values = rows.column("ids").combine_chunks(), rows.column("values").combine_chunks()
    return train(ids.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(float), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]), rows.column("label").to_numpy().astype(float))


def score_quality(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text); null texts count as empty, repeated rows score alike."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorisationMachine(*shared.value)
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(machine.score(*features(part.column("text"))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(arrow_task(score), "doc_id bigint, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, null and empty texts included; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
