import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from attestry.llm import lm_scoring
from attestry.llm.lm_scoring import FALSE_SHARE, STRENGTH, filter_block, level_of, levels, probes_for, score


def test_against_exact_counts(spark):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    rows = [(i, " ".join(words[k : k + n])) for i, (k, n) in enumerate((rng.randrange(3900), rng.randrange(60)) for _ in range(120))]
    rows += [(500, None), (501, "  \n"), (502, "Neu Wörter Ω"), (502, "Neu Wörter Ω"), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as token", "2 as score")
    training = df.where("doc_id % 7 <> 2 or doc_id is null")
    tokens = {k: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split(), None] for k, (_, t) in enumerate(rows)}
    learned = [tokens[k] for k, (i, _) in enumerate(rows) if i is None or i % 7 != 2]
    c, pairs = Counter(w for t in learned for w in t), Counter(p for t in learned for p in zip([None, *t[:-1]], t, strict=True))
    n, v = sum(c.values()), len(c)
    keep = lm_scoring.HEAD_TOKENS
    try:
        lm_scoring.HEAD_TOKENS = 20  # so that most tokens take the way through the join
        found = sorted(score(df, training).collect(), key=lambda r: (-1 if r.id is None else r.id, r.n_tokens, r.base_score))
    finally:
        lm_scoring.HEAD_TOKENS = keep
    expected = []
    for k, (i, _) in enumerate(rows):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[k])
        model = 0.0
        for h, w in zip([None, *tokens[k][:-1]], tokens[k], strict=True):
            seen = pairs[h, w]
            seen = 2 ** ((int(level_of(np.array([seen]))[0]) - 1) / 2) if seen else 0
            model += math.log10((seen + STRENGTH * (c[w] + 1) / (n + v + 1)) / (c[h] + STRENGTH * (1 + FALSE_SHARE)))
        expected.append((-1 if i is None else i, len(tokens[k]), base, model, sum(c[w] > 0 for w in tokens[k])))
    expected.sort(key=lambda r: r[:3])
    assert len(found) == len(rows)
    for r, e in zip(found, expected, strict=True):
        assert (-1 if r.id is None else r.id, r.n_tokens, r.n_known, r.train_tokens) == (e[0], e[1], e[4], n)
        assert math.isclose(r.base_score, e[2], rel_tol=1e-9)
        assert math.isclose(r.score, e[3], rel_tol=1e-3)  # a sum of floats, and rarely an absent pair taken for a present one
    assert score(df.limit(0), training).count() == 0


def test_every_pair_is_kept():
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 1 << 63, 300_000, dtype=np.uint64))
    counts = rng.integers(1, 4, len(pairs))
    for probes in (4, 14):
        block = filter_block(pairs, counts, probes)
        assert (levels(block, pairs, probes) >= level_of(counts)).all()
        absent = rng.integers(1 << 63, (1 << 64) - 1, 100_000, dtype=np.uint64)
        assert (levels(block, absent, probes) > 0).mean() < 0.4**probes + 0.0002


def test_probabilities_sum_to_one_at_most():
    """All P(w | h) for many h, of 20,000 distinct tokens whose pairs fill one block."""
    rng = np.random.default_rng(8)
    v, n = 20_000, 200_000
    text = (rng.pareto(0.8, n) * 20).astype(np.int64) % v
    c = np.bincount(text, minlength=v)
    pair = text[:-1] * v + text[1:]
    values, counts = np.unique(pair, return_counts=True)
    key = lambda x: lm_scoring.mix(np.asarray(x).astype(np.uint64) + np.uint64(77)) >> np.uint64(8)
    probes = probes_for(v)
    block = filter_block(key(values), counts, probes)
    unigram = (c + 1) / (n + v + 1)
    sums = []
    for h in [*np.argsort(-c)[:30], *rng.integers(0, v, 170)]:
        level = levels(block, key(h * v + np.arange(v)), probes).astype(float)
        seen = np.where(level > 0, 2 ** ((level - 1) / 2), 0)
        sums.append(((seen + STRENGTH * unigram) / (c[h] + STRENGTH * (1 + FALSE_SHARE))).sum())
    assert max(sums) <= 1 and min(sums) > 0.7


def test_pairs_beyond_a_fixed_filter(spark):
    """Several blocks; a learned text of pairs that come once scores as its exact counts say."""
    keep = lm_scoring.BLOCK_TOKENS
    df = spark.createDataFrame([(i, " ".join(f"w{(i * 997 + k * (2 * i + 1)) % 5003}" for k in range(500))) for i in range(400)], "doc_id long, text string").repartition(5)
    try:
        whole = {r.id: r.score for r in score(df, df).collect()}
        lm_scoring.BLOCK_TOKENS = 3_000
        cut = {r.id: r.score for r in score(df, F.lit(True)).collect()}
    finally:
        lm_scoring.BLOCK_TOKENS = keep
    assert len(cut) == 400
    assert all(math.isclose(cut[i], whole[i], rel_tol=2e-3) for i in whole)
