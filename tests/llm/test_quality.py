import random

import numpy as np

from attestry.llm.quality import LABELLERS, learn, score, weak_labels


def test_weak_labels_find_the_bad_class():
    rng = np.random.default_rng(1)
    bad = rng.random(5000) < 0.15
    kind = rng.integers(0, 4, 5000)
    cast = np.full((5000, len(LABELLERS)), 2, np.int8)
    for k in range(4):
        cast[bad & (kind == k), k] = 0
    patterns, at, n = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    posterior, _ = weak_labels(patterns, n.astype(float))
    assert np.mean((posterior[at.ravel()] < 0.5) == bad) > 0.99


def test_scores(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    clean = lambda: ". ".join(" ".join(word() for _ in range(12)) for _ in range(8)) + "."
    rows = [(i, clean()) for i in range(300)]
    rows += [(1000 + i, clean().replace(" ", "### ")) for i in range(30)] + [(2000 + i, "for " * 200) for i in range(30)]
    rows += [(5000, None), (5001, ""), (None, clean()), (5002, clean() * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as keep")
    found = {r.id: r for r in score(df, learn(df)).collect()}
    assert len(found) == len(rows)
    assert np.mean([found[i].keep for i in range(300)]) > 0.97
    assert np.mean([found[i].keep for i in [*range(1000, 1030), *range(2000, 2030)]]) < 0.05
    assert score(df.limit(0), learn(df.limit(0))).count() == 0


def test_posteriors_against_brute_force():
    """The maximisation of the table's likelihood: no step of the estimate from counted patterns differs from one over all rows."""
    rng = np.random.default_rng(5)
    cast = rng.choice(3, (400, len(LABELLERS)), p=(0.1, 0.3, 0.6)).astype(np.int8)
    patterns, at, n = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    counted, chances = weak_labels(patterns, n.astype(float), 20)
    each, same = weak_labels(cast, np.ones(len(cast)), 20)
    assert np.allclose(counted[at.ravel()], each) and np.allclose(chances, same)
    prior = np.clip((counted * n).sum() / n.sum(), 0.01, 0.99)
    for row in range(0, 400, 37):  # Bayes' rule, vote by vote
        good, bad = prior, 1 - prior
        for k, vote in enumerate(cast[row]):
            good *= chances[k, 1, vote]
            bad *= chances[k, 0, vote]
        assert abs(good / (good + bad) - counted[at.ravel()[row]]) < 0.02


def test_repeated_rows_and_names(spark):
    df = spark.createDataFrame([(1, "Some words stand here. " * 9)] * 3 + [(2, "### $$$ " * 40)], "doc_id long, text string").selectExpr("*", "1 as row", "2 as label", "3 as features")
    found = sorted((r.id, r.score) for r in score(df, learn(df)).collect())
    assert len(found) == 4 and len({s for i, s in found if i == 1}) == 1
