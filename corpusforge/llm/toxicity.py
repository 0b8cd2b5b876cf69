"""Toxicity by weak supervision.

Voters are noisy: groups of lexicon entries (whole words, or beginnings of words, which catch inflected forms) that stand more
in toxic than in other labelled texts that aren't held out, right in most cases; each group votes where it stands at all
and again where it stands often, and patterns vote over all of them. A generative label model estimates each voter's rates and
the correlations of voters from the votes alone (expectation maximisation, with the votes of correlated voters discounted), and
its posterior labels train a linear classifier, which scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.common import _IS_ASCII_NON_ALNUM, Words, arrow_task, fit_sample, fold, free_name, mix, saved, table

#: General insults in four languages, one voter together.
SEEDS = [
    "idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumbass", "bastard", "asshole", "retard",
    "arschloch", "dummkopf", "trottel", "abschaum", "schwachkopf", "versager", "connard", "salaud", "crétin", "abruti", "ordure", "imbécile",
    "gilipollas", "cabrón", "estúpido", "imbécil", "escoria", "asqueroso", "basura",
]
#: Bytes of a word's beginning that an entry may consist of; 0 stands for the whole word.
LENGTHS = [4, 5, 6, 8, 0]


def entry_hashes(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of LENGTHS, the words long enough for it and the hashes of entries."""
    out = []
    size = words.end - words.start
    for k in LENGTHS:
        mine = np.flatnonzero(size >= max(k, 3))
        stop = words.end if k == 0 else np.minimum(words.start + k, words.end)
        out.append((mine, mix(words.hashes(stop)[mine] + np.uint64(k + 1))))
    return out


def _seed_hashes() -> np.ndarray:
    seeds = Words(pa.array(SEEDS), separators=_IS_ASCII_NON_ALNUM)
    return np.unique(entry_hashes(seeds)[-1][1])


@dataclass
class Lexicon:
    """entries: ascending hashes; voter: the voter of each entry; voters are numbered from 0, the last is the seeds'."""

    entries: np.ndarray
    voter: np.ndarray
    n_voters: int

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hits of each voter by text (n x n_voters), and each text's words."""
        words = Words(texts, separators=_IS_ASCII_NON_ALNUM)
        out = np.zeros((words.n_docs, self.n_voters), np.int32)
        if len(self.entries):
            for mine, h in entry_hashes(words):
                at = np.minimum(np.searchsorted(self.entries, h), len(self.entries) - 1)
                found = self.entries[at] == h
                np.add.at(out, (words.doc[mine[found]], self.voter[at[found]]), 1)
        return out, np.diff(words.first)


def votes(hits: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """0/1 votes for toxic: each voter of the lexicon where it stands, and where it stands often (twice, in 200 words once); then
    patterns: two voters, three, one hit in 100 words, in 20."""
    any_ = hits > 0
    often = (hits > 1) & (hits >= 0.005 * np.maximum(n_words, 1)[:, None])
    kinds, most = any_.sum(1), hits.max(1) if hits.shape[1] else np.zeros(len(hits))
    rate = most / np.maximum(n_words, 1)
    return np.column_stack([any_, often, kinds >= 2, kinds >= 3, (rate >= 0.01) & (most > 1), (rate >= 0.05) & (most > 1)]).astype(float)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class LabelModel:
    """y is toxic or not. Voter j votes toxic with probability hit[j] if y, false_hit[j] if not; where it doesn't, it abstains and
    says nothing, unless all do: none has the probabilities of that, if not y and if y. weight discounts voters by what they
    share with others beside y; bias holds the prior. Without voters posteriors are the
    prior; a fit needs rows."""

    bias: float = 0.0
    hit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    false_hit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    none: tuple[float, float] = (0.9, 0.1)

    def margin(self, v: np.ndarray) -> np.ndarray:
        silent = np.where(v.any(1), 0, np.log(self.none[1] / self.none[0]))
        return v @ (np.log(self.hit / self.false_hit) * self.weight) + silent

    def posterior(self, v: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(v) + self.bias)

    @classmethod
    def fit(cls, v: np.ndarray, prior: float, known: np.ndarray | None = None, anchor: float = 0.5, rounds: int = 25) -> LabelModel:
        """From votes; the prior is the share of toxic texts, which the posteriors keep to. Where labels are known they have the
        part `anchor` in what rates are estimated from, so that classes can't drift to what else makes voters agree, such as a
        language. Starts from a precision of 0.8 of every voter."""
        n = len(v)
        model = cls()
        silent = ~v.any(1)
        q = np.where(silent, 0.01, 0.8)
        for _ in range(rounds):
            if known is not None:
                q = (1 - anchor) * q + anchor * known
            pos, neg = q.sum() + 1e-9, (1 - q).sum() + 1e-9
            model.hit = np.clip((q @ v + 0.1) / (pos + 1), 1e-5, 0.999)
            model.false_hit = np.clip(((1 - q) @ v + 0.1) / (neg + 1), 1e-5, 0.99)
            model.none = (float(((1 - q) @ silent + 0.1) / (neg + 1)), float((q @ silent + 0.1) / (pos + 1)))
            rest = v - q[:, None] * model.hit - (1 - q)[:, None] * model.false_hit  # what y doesn't explain
            scale = np.sqrt((rest * rest).mean(0)) + 1e-6
            correlation = np.abs((rest / scale).T @ (rest / scale) / max(n, 1))
            np.fill_diagonal(correlation, 0)
            model.weight = 1 / (1 + np.where(correlation > 0.5, correlation, 0).sum(1))
            margin = model.margin(v)
            low, high = -60.0, 60.0
            for _ in range(50):  # the bias at which posteriors have the prior's mean
                model.bias = (low + high) / 2
                low, high = (model.bias, high) if _sigmoid(margin + model.bias).mean() < prior else (low, model.bias)
            q = _sigmoid(margin + model.bias)
        return model


def linear_inputs(hits: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    v = votes(hits, n_words)
    total = hits.max(1) if hits.shape[1] else np.zeros(len(hits))
    rate = hits.sum(1) / np.maximum(n_words, 1)
    return np.column_stack([v, np.log1p(total), np.minimum(rate, 0.1) * 10, np.ones(len(v))])


def fit_linear(x: np.ndarray, q: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on posterior labels q by Newton's steps."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - q) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid(linear_inputs(*self.lexicon.hits(texts)) @ self.weights)


def _batches(batch: pa.RecordBatch, size: int = 1024):
    for lo in range(0, len(batch), size):
        yield batch.slice(lo, size)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_fit_rows: int = 20_000, max_voters: int = 64, min_precision: float = 0.85, min_evidence: float = 20.0) -> ToxicityModel:
    """Fitted from a bounded sample of labelled rows (max_fit_rows, by a hash of the id); held-out rows never enter.

    An entry is taken up if at least two toxic texts have it, at least min_precision of the texts that have it are toxic, and
    the log-likelihood ratio of its rates (up to five places a text) reaches min_evidence; so there are fewer entries than the
    toxic texts of the sample have words. Entries that stand in much the same texts make one voter; all entries that would
    need more than max_voters share one. Null texts count as empty; a doc_id with several labels stands once for
    each; rows without a label, and labels without a text, don't enter. Where the sample has no toxic text, only the seeds vote; where it is
    empty, a text with a seed is toxic.
    """
    sample = fit_sample(docs.select("doc_id", "text"), labels, label, max_fit_rows).select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    sample = saved(sample, "labelled")
    totals = {r["label"] == 1: (r["rows"], r["size"]) for r in sample.groupBy((F.col("label") == 1).cast("int").alias("label")).agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("size")).collect()}
    (n_toxic, toxic_size), (n_clean, clean_size) = totals.get(True, (0, 0)), totals.get(False, (0, 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch):
                toxic = part.column("label").to_numpy(zero_copy_only=False) == 1
                words = Words(part.column("text"), separators=_IS_ASCII_NON_ALNUM)
                for mine, h in entry_hashes(words):
                    d = words.doc[mine]
                    order = np.lexsort((d, h))
                    h, d = h[order], d[order]
                    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, np.int64)
                    places = np.minimum(np.diff(np.append(first, len(h))), 5)
                    h, d = h[first], d[first]
                    keys, first = np.unique(h, return_index=True)
                    sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[np.append(first, len(h))]) for x in (toxic[d], ~toxic[d], places * toxic[d], places * ~toxic[d])]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[pa.array(x, pa.int64()) for x in sums]], ["entry", "p", "n", "cp", "cn"])

    names = ["p", "n", "cp", "cn"]
    counted = sample.mapInArrow(arrow_task(count), "entry bigint, p bigint, n bigint, cp bigint, cn bigint").groupBy("entry").agg(*[F.sum(c).alias(c) for c in names])
    share = float(toxic_size) / max(1, toxic_size + clean_size)
    both = F.col("cp") + F.col("cn")
    part = lambda c, e: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * F.lit(max(e, 1e-9))))).otherwise(0)
    evidence = 2 * (part("cp", share) + part("cn", 1 - share))
    fit = (F.col("p") >= 2) & (F.col("p") >= min_precision * (F.col("p") + F.col("n"))) & (F.col("cp") > both * share)
    top = counted.filter(fit).select("entry", evidence.alias("evidence")).filter(F.col("evidence") >= min_evidence).collect()
    seeds = _seed_hashes()
    strength = {int(np.int64(r["entry"]).view(np.uint64)): r["evidence"] for r in top}
    entries = np.array(sorted(strength), np.uint64)
    candidate = Lexicon(entries, np.arange(len(entries)), len(entries))

    def collect_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch, 256):
                hits, _ = candidate.hits(part.column("text"))
                row, voter = np.nonzero(hits)
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32()), pa.array(voter, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), found], ["doc_id", "found"])

    # which entries stand in which texts of the sample, as places
    rows = sample.mapInArrow(arrow_task(collect_hits), "doc_id bigint, found array<int>").filter(F.size("found") > 0).toArrow().sort_by("doc_id").column("found").combine_chunks()
    present = np.zeros((len(entries), len(rows)), bool)
    present[rows.flatten().to_numpy(), np.repeat(np.arange(len(rows)), np.asarray(rows.value_lengths()))] = True
    sizes = present.sum(1)
    # entries that stand in much the same texts make one voter: that with most evidence first, others join it or open their own
    chosen: list[int] = []
    voter = np.zeros(len(entries), np.int64)
    for j in np.argsort([-strength[int(e)] for e in entries], kind="stable").tolist():
        shared = (present[chosen] & present[j]).sum(1) if chosen else np.zeros(0, np.int64)
        if len(shared) and shared.max() >= 0.8 * max(1, sizes[j]):
            voter[j] = int(shared.argmax())
        elif len(chosen) < max_voters - 2:
            voter[j] = len(chosen)
            chosen.append(j)
        else:
            voter[j] = -1
    n_voters = len(chosen) + 2  # the entries beyond have one voter, the seeds another
    voter[voter < 0] = n_voters - 2
    new = np.setdiff1d(seeds, entries)
    hashes, voters = np.concatenate([entries, new]), np.concatenate([voter, np.full(len(new), n_voters - 1)]).astype(np.int64)
    order = np.argsort(hashes)
    lexicon = Lexicon(hashes[order], voters[order], n_voters)

    def collect_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch):
                hits, n_words = lexicon.hits(part.column("text"))
                row, at = np.nonzero(hits)
                offsets = pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(hits[row, at], pa.int32()))], ["doc_id", "label", "n_words", "at", "hits"])

    voted = sample.mapInArrow(arrow_task(collect_votes), "doc_id bigint, label int, n_words bigint, at array<int>, hits array<int>").toArrow().sort_by([("doc_id", "ascending"), ("n_words", "ascending")])
    at, found = (voted.column(c).combine_chunks() for c in ("at", "hits"))
    hits = np.zeros((len(voted), lexicon.n_voters), np.int32)
    hits[np.repeat(np.arange(len(voted)), np.asarray(at.value_lengths())), at.flatten().to_numpy()] = found.flatten().to_numpy()
    n_words = voted.column("n_words").to_numpy()
    v = votes(hits, n_words)
    prior = float(np.clip(n_toxic / max(1, n_toxic + n_clean) if n_toxic else 0.1, 0.005, 0.5))
    known = (voted.column("label").to_numpy() == 1).astype(float)
    if not len(v):  # nothing to learn from: a text is as toxic as the prior says, more so with a seed
        weights = np.zeros(linear_inputs(np.zeros((1, lexicon.n_voters), np.int32), np.ones(1)).shape[1])
        weights[-1], weights[lexicon.n_voters - 1] = np.log(prior / (1 - prior)), 2.5
        return ToxicityModel(lexicon, weights)
    posterior = LabelModel.fit(v, prior, known).posterior(v)
    return ToxicityModel(lexicon, fit_linear(linear_inputs(hits, n_words), posterior))


def score_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """docs with a column of scores (0 to 1; replaced if there is one). Null texts score as empty ones, repeated rows alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(part.column("text")), pa.float64())], [*part.schema.names, name])

    schema = docs.schema
    schema = type(schema)([*schema.fields]).add(name, "double")
    return docs.mapInArrow(arrow_task(score), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs less the rows that score at least threshold, with their columns as they are, in one pass without a shuffle."""
    name = free_name("toxicity", docs.columns)
    scored = score_toxicity(docs, fit_toxicity(docs.select("doc_id", "text"), labels), name)
    return scored.filter(F.col(name) < threshold).drop(name)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, null and empty texts included; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model).select("doc_id", F.col("toxicity").alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
