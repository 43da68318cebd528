import itertools
import math
import random
import re
import time

import numpy as np
import pytest

from attestry.llm.secret_scan import Chain, Field, base_spans, find, forward_backward, learn, scan
from tests.conftest import DATA


def test_base_against_the_definition():
    rng = random.Random(1)
    parts = ["token", "API_KEY", "secret", "=", ": ", '"', "'", "abcdef12", "ab", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, " ", "\n", "é", "."]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        wanted = [(m.start(), 0, m.end()) for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
        wanted += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        wanted += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        assert [(s, ["assign", "access", "hex"].index(k), e) for s, e, k, *_ in base_spans(text)] == sorted(wanted)


def test_decoding_against_all_paths():
    rng = np.random.default_rng(2)
    for n in (1, 2, 4):
        names = {f"f{i}": i for i in range(n)}
        field = Field(names, rng.standard_normal((n, 3)) * 2, rng.standard_normal((3, 3)))
        chain = Chain([(i, i + 1) for i in range(n)], [[f"f{i}"] for i in range(n)])
        scores = field.scores(chain)
        weigh = lambda p: sum(scores[i, t] for i, t in enumerate(p)) + sum(field.steps[a, b] for a, b in zip((0, *p), (*p, 0), strict=True))  # noqa: B023, E731
        paths = list(itertools.product(range(3), repeat=n))
        total = sum(math.exp(weigh(p)) for p in paths)
        chance = forward_backward(scores[None], field.steps)[0][0]
        for i in range(n):
            for t in range(3):
                assert math.isclose(chance[i, t], sum(math.exp(weigh(p)) for p in paths if p[i] == t) / total, rel_tol=1e-9)
        best = max(paths, key=weigh)
        assert [a for a, *_ in field.decode(chain)] == [i for i, t in enumerate(best) if t == 1]


def test_scan(spark):
    rng = random.Random(5)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(i, f'some words here token = "{h}" and more') for i, h in enumerate(hexes)] + [(100 + i, "only plain words in this text 12 times") for i in range(60)]
    rows += [(300, None), (301, ""), (None, f"x {hexes[0]} y"), (302, "word " * 30000 + "AKIA" + "A1" * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as secrets", "2 as id")
    found = {r.id: [(s.kind, s.text) for s in r.secrets] for r in scan(df, learn(df)).collect()}
    assert all([k for k, _ in found[i]] == ["assign", "hex"] and found[i][1][1] == h for i, h in enumerate(hexes))
    assert not any(found[100 + i] for i in range(60)) and found[300] == [] and found[301] == []
    assert found[None] == [("hex", hexes[0])] and found[302] == [("access", "AKIA" + "A1" * 10)]
    assert scan(df.limit(0), learn(df.limit(0))).count() == 0


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@pytest.fixture(scope="module")
def field(spark):
    return learn(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))


def test_field_adds_secrets_in_unseen_forms(field):
    """Forms that no pattern has: most are found whole, and harmless long pieces aren't."""
    rng = random.Random(11)
    draw = lambda n, alphabet=LETTERS: "".join(rng.choice(alphabet) for _ in range(n))
    forms = [("Authorization: Bearer {}", LETTERS, 40), ("my credential is {} so keep it", LETTERS, 32), ("export PRIVATE={};", LETTERS + "+/", 44), ('{{"pwd": "{}"}}', LETTERS + "-_", 24), ("key {} was revoked", "0123456789ABCDEF", 40)]
    hits = 0
    for form, alphabet, n in forms * 40:
        value = draw(n, alphabet)
        text = f"Some words. {form.format(value)} and more words."
        spans = find(text, field, True, True)
        hits += any(k == "field" and text[a:b].strip("-_+/=") == value.strip("-_+/=") for k, a, b in spans)
    assert hits >= 0.9 * 200
    harmless = ["see https://www.example.com/en/7817?utm_source=feed&page=2", "id 550e8400-e29b-41d4-a716-446655440000 ok", "at 2024-01-31T12:33:10Z sharp", "getElementByIdAndClassName(x)", "report_final_2024_v2.pdf", "call +49-170-1234567", "mail.34@mail7.example.com", "ISBN 978-3-16-148410-0", "version 1.20.3-beta2"]
    assert not [t for t in harmless if find(t, field, True, True)]


def test_added_spans_leave_base_ones(field):
    rng = random.Random(3)
    value = "".join(rng.choice(LETTERS) for _ in range(40))
    text = f'token = "{value}" then Bearer {value} and AKIA{"A1" * 10}'
    spans = find(text, field, True, True)
    assert [k for k, *_ in spans] == ["assign", "field", "access"]
    assert all(a >= b for (_, a, _), (_, _, b) in zip(spans[1:], spans[:-1], strict=True))


def test_long_text_without_white_space(field):
    """Work grows with the length: 0.2 MB of one chain takes seconds, not hours."""
    rng = random.Random(4)
    text = "".join(rng.choice(LETTERS + '{}[],:"') for _ in range(200_000))
    began = time.time()
    find(text, field, True, True)
    assert time.time() - began < 60


def test_repeated_rows_ties_and_names(spark, field):
    df = spark.createDataFrame([(1, "AKIA" + "A1" * 10), (1, "AKIA" + "A1" * 10), (2, None)], "doc_id long, text string").selectExpr("*", "'x' as secrets", "3 as row", "4 as has")
    assert sorted((r.id, len(r.secrets)) for r in scan(df, field).collect()) == [(1, 1), (1, 1), (2, 0)]
    learn(df)
