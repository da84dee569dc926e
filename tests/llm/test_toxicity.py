"""The ordinal fit against numerical derivatives and a search, and held-out error on the driver's tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from histora.llm import toxicity

SF = "/root/testdata/sf0.1"


def loss(x, grades, w, cuts, l2, prior):
    """The penalised loss, grade by grade, as the model is written down."""
    out = 0.0
    for row, g in zip(x, grades):
        below = lambda k: 0.0 if k < 0 else 1.0 if k >= len(cuts) else 1 / (1 + np.exp(row @ w - cuts[k]))
        out -= np.log(below(g) - below(g - 1))
    return out / len(grades) + l2 / 2 * ((w - prior) ** 2).sum()


def sample(seed, n=160, features=4):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, size=(n, features)).astype(float)
    latent = x @ rng.normal(0.8, 0.5, features) + rng.logistic(size=n)
    return x, np.digitize(latent, np.quantile(latent, [0.5, 0.8]))


@pytest.mark.parametrize("seed", range(4))
def test_fit_is_at_a_minimum_with_ordered_thresholds(seed):
    x, grades = sample(seed)
    rows, columns = np.nonzero(x)
    w, cuts = toxicity.fit_ordinal(rows, columns, x[rows, columns], grades, x.shape[1], l2=0.05, prior=0.5, steps=4_000)
    assert (np.diff(cuts) > 0).all()
    best = loss(x, grades, w, cuts, 0.05, 0.5)
    for i in range(len(w) + len(cuts)):
        for step in (-1e-3, 1e-3):
            a, b = w.copy(), cuts.copy()
            (a if i < len(w) else b)[i if i < len(w) else i - len(w)] += step
            slope = (loss(x, grades, a, b, 0.05, 0.5) - best) / 1e-3
            assert slope > -2e-3
    # no other weights found by a rough search do better
    rng = np.random.default_rng(9)
    for _ in range(300):
        a, b = w + rng.normal(0, 0.3, len(w)), np.sort(cuts + rng.normal(0, 0.3, len(cuts)))
        assert loss(x, grades, a, b, 0.05, 0.5) > best - 1e-6


def test_expected_severity_is_the_mean_of_the_grades():
    model = toxicity.Model(["a"], np.array([1.0]), np.array([0.5, 2.0]))
    expected, grade = model.score(np.array([-3.0, 0.5, 1.2, 4.0]))
    for x, e, g in zip((-3.0, 0.5, 1.2, 4.0), expected, grade):
        below = [1 / (1 + np.exp(x - c)) for c in (0.5, 2.0)]
        p = [below[0], below[1] - below[0], 1 - below[1]]
        assert e == pytest.approx(p[1] + 2 * p[2]) and p[g] == max(p)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_error(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    half = F.xxhash64("doc_id") % 2 == 0
    model = toxicity.fit(docs, labels.where(half))
    found = toxicity.severity(docs, model).withColumnRenamed("toxic", "said").join(labels.where(~half), "doc_id").groupBy("toxic", "said").count().collect()
    n = {(r.toxic, r.said): r["count"] for r in found}
    caught = n.get((1, True), 0) / (n.get((1, True), 0) + n.get((1, False), 0))
    clean = n.get((0, False), 0) / (n.get((0, True), 0) + n.get((0, False), 0))
    # 0.85 of 226 and more than 0.97 of the others when this was written: half of so few labels misses rare words
    assert caught >= 0.8 and clean >= 0.97
