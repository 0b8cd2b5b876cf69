import itertools

import numpy as np

from corpusforge.llm.toxicity import LabelModel, drop_toxic, fit_toxicity, op6_toxicity, score_toxicity


def test_label_model_finds_the_class_without_labels():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    accuracy = [(0.6, 0.01), (0.5, 0.005), (0.4, 0.01), (0.4, 0.01)]
    votes = np.column_stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in accuracy]).astype(float)
    votes[:, 3] = votes[:, 2]  # fully correlated voters count less
    model = LabelModel.fit(votes, 0.2)
    q = model.posterior(votes) > 0.5
    assert (q == (votes.sum(1) > 0)).mean() > 0.97
    assert model.weight[3] < model.weight[0]


def test_posteriors_against_enumeration():
    """Independent voters whose rates are known: every pattern of votes, weighed by all it can come from."""
    hit, false_hit, prior = np.array([0.7, 0.5, 0.4, 0.6]), np.array([0.02, 0.05, 0.01, 0.1]), 0.15
    patterns = np.array(list(itertools.product([0, 1], repeat=4)), float)
    joint = [np.prod(np.where(patterns == 1, r, 1 - r), 1) * p for r, p in ((hit, prior), (false_hit, 1 - prior))]
    rng = np.random.default_rng(2)
    v = patterns[rng.choice(len(patterns), 60_000, p=(joint[0] + joint[1]) / (joint[0] + joint[1]).sum())]
    model = LabelModel.fit(v, prior)
    assert np.abs(model.hit - hit).max() < 0.15 and np.abs(model.false_hit - false_hit).max() < 0.05
    exact = joint[0] / (joint[0] + joint[1])
    weight = joint[0] + joint[1]
    assert weight @ np.abs((model.posterior(patterns) > 0.5) != (exact > 0.5)) < 0.05
    # by the model's own account: what voted, what abstained says nothing, silence of all counts
    say = np.where(patterns == 1, model.hit / model.false_hit, 1) ** model.weight
    odds = say.prod(1) * np.where(patterns.any(1), 1, model.none[1] / model.none[0]) * np.exp(model.bias)
    assert np.allclose(model.posterior(patterns), odds / (1 + odds))


def test_known_labels_anchor_the_classes():
    rng = np.random.default_rng(3)
    y = rng.random(3000) < 0.1
    group = ~y & (rng.random(3000) < 0.3)  # what makes weak voters agree isn't the class
    weak = [np.where(group, rng.random(3000) < 0.5, rng.random(3000) < 0.02) for _ in range(8)]
    v = np.column_stack([np.where(y, rng.random(3000) < 0.9, False), *weak]).astype(float)
    q = LabelModel.fit(v, 0.1, y.astype(float)).posterior(v)
    assert q[y].mean() > 0.7 and q[~y].mean() < 0.05


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in op6_toxicity(spark, folder).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic, clean = ([r["predicted"] for r in rows if labels[r["doc_id"]] == k] for k in (1, 0))
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.02  # in all languages
    texts = spark.read.parquet(f"{folder}/documents.parquet")
    other = {r["doc_id"] for r in texts.filter("lang != 'en'").select("doc_id").collect()}
    found = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1 and r["doc_id"] in other]
    assert sum(found) / len(found) > 0.9


def test_odd_rows(odd_docs, no_docs, labels):
    model = fit_toxicity(odd_docs, labels)
    rows = score_toxicity(odd_docs, model).collect()
    assert len(rows) == 15 and all(0 <= r["toxicity"] <= 1 for r in rows)
    assert score_toxicity(no_docs, fit_toxicity(no_docs, labels)).count() == 0
    kept = drop_toxic(odd_docs, labels.limit(0))
    assert kept.schema == odd_docs.schema and kept.count() == 15 and drop_toxic(no_docs, labels).count() == 0
