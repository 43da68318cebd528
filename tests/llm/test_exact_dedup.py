import hashlib
import random
import re

import pytest

from attestry.llm import exact_dedup, queries
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ID string, grp int, digit string, rest string, n int"


def brute(rows):
    groups = {}
    normal = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, (_, t) in enumerate(rows)}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(normal[i], []).append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        own = groups[normal[i]]
        keep = min((x for x in own if x is not None), default=None)
        out.append((key, keep, len(own), keep == key, hashlib.sha256(normal[i].encode()).hexdigest()))
    return sorted(out, key=str)


def texts():
    random.seed(7)
    long = "".join(random.choice("ab é\n") for _ in range(70_000))
    found = ["", None, " ", "\t\n", "a", "a ", " a", "a\x0b\x0cb", "a b", "a\xa0b", "x" * 64, "x" * 63, "x" * 65, "x" * 576, "x" * 577, long, long + "!", long, "z" + long]
    found += [long[: 64 * 8**k] for k in range(3)] * 2 + ["hot copy " * 50] * 3000 + ["hot copy " * 49 + f"end {i % 700}" for i in range(1400)]
    return [(random.choice([i, i // 2, None]) if i % 50 == 0 else i, t) for i, t in enumerate(found)]


@pytest.mark.parametrize("broadcast", [exact_dedup.BROADCAST_BYTES, 500])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", broadcast)
    if broadcast == 500:  # hot groups by broadcast, the others by a shuffle
        monkeypatch.setattr(exact_dedup, "HOT_ROWS", 10)
    rows = texts()
    docs = spark.createDataFrame([(k, t, "x", 1, "y", "z", 3) for k, t in rows], SCHEMA).repartition(5)
    found = [tuple(r) for r in exact_dedup.equal_texts(docs).collect()]
    assert sorted(found, key=str) == brute(rows)


def test_drop_equal_keeps_one_row(spark):
    rows = [(3, "a  b"), (1, "a b"), (1, "a\nb"), (1, "c"), (None, "d"), (None, "d"), (5, None), (4, "")]
    docs = spark.createDataFrame([(k, t, "x", 1, "y", "z", 3) for k, t in rows], SCHEMA)
    kept = exact_dedup.drop_equal(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, re.sub(r"\s+", " ", r.text or "")) for r in kept.collect()), key=str) == sorted([(1, "a b"), (1, "c"), (4, ""), (None, "d")], key=str)


def test_empty_table(spark):
    assert exact_dedup.equal_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    assert exact_dedup.drop_equal(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equals_sql(spark):
    assert compare(spark, connect(FOLDER), FOLDER, queries.op13_exact_dedup, queries.ORACLE_SQL["op13_exact_dedup"]) is None
