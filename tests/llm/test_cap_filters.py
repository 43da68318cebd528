import math

import numpy as np

from attestry.llm.cap_filters import near_duplicates


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((200, 24))
    near = np.concatenate([base[k] + s * rng.standard_normal((40, 24)) for k, s in ((0, 0.05), (1, 0.3), (2, 0.4))])
    x = np.concatenate((base, near, base[:30], 2 * base[5:6])).astype(np.float32)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [math.nan] * 24), (9005, [None, *[1.0] * 23]), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as n_links", "2 as rep")
    found = {r.id: r for r in near_duplicates(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    name = np.arange(len(x))
    while True:
        new = np.array([min(name[i], *name[links[i]], name[i]) for i in range(len(x))])
        if (new == name).all():
            break
        name = new
    got = np.array([found[i].n_links for i in range(len(x))])
    assert (got == links.sum(axis=1)).all()  # all links of brute force
    assert all(found[i].component == name[i] for i in range(len(x)))
    assert all(found[i].kept == (found[i].component == i) for i in range(len(x)))
    assert all((found[i].n_links, found[i].component, found[i].kept) == (0, i, True) for i in range(9001, 9006))
    assert (found[9006].n_links, found[9007].component) == (1, 9006)
    assert (found[None].n_links, found[None].component, found[None].kept) == (0, None, False)
    assert near_duplicates(df.limit(0)).count() == 0


def test_pairs_at_the_least_cosine(spark):
    """2,000 pairs at cosine 0.9 to 0.901, the hardest: all are found among 6,000 vectors."""
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(rng.standard_normal((2000, 64)))
    r = rng.standard_normal((2000, 64))
    r = unit(r - (r * a).sum(axis=1, keepdims=True) * a)
    c = rng.uniform(0.9001, 0.901, (2000, 1))
    b = c * a + np.sqrt(1 - c * c) * r
    x = np.concatenate((a, b, rng.standard_normal((2000, 64))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.id: r.n_links for r in near_duplicates(df).collect()}
    assert sum(found[i] >= 1 for i in range(4000)) == 4000


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])] * 3 + [(2, [1.0, 2.1])], "vec_id long, embedding array<double>")
    assert sorted((r.id, r.n_links, r.component) for r in near_duplicates(df).collect()) == [(1, 3, 1)] * 3 + [(2, 3, 1)]


def test_filters_are_sent_small(spark):
    """A vector goes to each of its filters with their numbers, which are ints until a number needs more."""
    from attestry.llm import cap_filters

    classes = spark.createDataFrame([(1, [1.0, 0.5]), (2, [0.5, 1.0])], "rep long, vector array<double>")
    assert cap_filters._met(classes, 8, 2).schema["filters"].dataType.simpleString() == "array<int>"
    assert cap_filters._met(classes, 1 << 15, 2).schema["filters"].dataType.simpleString() == "array<bigint>"
