import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from attestry.llm import queries, ranked_search
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, query long, item string, score int, rank int"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counts = [Counter(words(t)) for _, t in docs]
    number, total = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    frequency = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c in zip(docs, counts, strict=True):
            share = 25 + (75 * sum(c.values()) * number) // total if total else 25
            score = sum(n * math.floor(1000 * math.log((2 * number + 2) / (2 * frequency[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * share)) for t, n in Counter(words(text)).items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def drawn(seed, docs=400, vocabulary=60):
    random.seed(seed)
    pool = [f"w{int(random.paretovariate(0.6)) % vocabulary}" for _ in range(2000)] + ["É", "ǆ_x", "UPPER", "İ"]
    some = lambda n: random.choice([" ", ", ", "\x00", "_"]).join(random.choices(pool, k=random.randrange(n)))
    return [(i, some(40)) for i in range(docs)]


def frames(spark, docs, items):
    return spark.createDataFrame([(k, t, 1, "x", 2, 3) for k, t in docs], SCHEMA).repartition(3), spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 64)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 100)  # several passes
    docs = drawn(1) + [(900, None), (901, ""), (902, "w1 " * 30_000), (None, "w1 w2 É"), (None, "w1 w2 É"), (7, "w3 w3"), (7, "w3 w3"), (903, "w1 w2 É")]
    items = drawn(2, 30) + [(50, None), (51, "..."), (52, "unheard"), (53, "w1 w1 w2"), (None, "É w3"), (53, "w2 w1 w1")]
    found = ranked_search.search(*frames(spark, docs, items), k=7)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items, 7)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)]
    found = ranked_search.search(*frames(spark, docs, [(1, "words")])).orderBy("rank").collect()
    assert [r.id for r in found] == list(range(1, 11)) and [r.rank for r in found] == list(range(1, 11))


def test_empty_tables(spark):
    some, none = [(1, "a b")], []
    for docs, items in ((some, none), (none, some), (none, none), ([(1, None)], some)):
        assert ranked_search.search(*frames(spark, docs, items)).count() == 0


def test_stops_before_the_lists_end():
    """One document far above all others is found without looking all documents up, and no better one is missed."""
    texts = pa.array(["rare rare rare gold"] * 12 + ["rare " + "filler " * (20 + i % 50) for i in range(3000)])
    terms = pa.array(["gold", "rare"])
    shard, read = ranked_search.Shard(texts, terms, 3012, 200_000), []
    place, score = ranked_search.best_positions(shard, np.arange(2), np.array([5000, 100]), 10, np.zeros(0, np.int64), read)
    assert read[0] < 1000 and set(place[np.argsort(-score)][:10]) <= set(range(12))
    # scores of other shards let it stop at once
    _, _ = ranked_search.best_positions(shard, np.arange(2), np.array([5000, 100]), 10, np.full(10, 10**12), read)
    assert read[1] <= 2 * ranked_search.FIRST_READ


def test_equals_sql(spark):
    assert compare(spark, connect(FOLDER), FOLDER, queries.op11_ranked_search, queries.ORACLE_SQL["op11_ranked_search"]) is None
