import random
import re
from collections import Counter

from attestry.llm import phrases, queries
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "text string, lang string, block long, slots int, n string, word string, name int"


def brute(rows, least, longest):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {key: a for key, a in counts.items() if a >= least}
    out = []
    for (lang, words), a in frequent.items():
        k = len(words)
        if k == 1:
            continue
        inside = any(l == lang and len(w) > k and f >= a and any(w[i : i + k] == words for i in range(len(w) - k + 1)) for (l, w), f in frequent.items())
        if not inside:
            cuts = []
            for i in range(1, k):
                left, right = counts[lang, words[:i]], counts[lang, words[i:]]
                cuts.append((1000 * a * totals[lang] // (left * right), i, left, right))
            score, _, left, right = min(cuts)
            out.append((lang, " ".join(words), a, left, right, totals[lang], score))
    return sorted(out)


def drawn():
    random.seed(3)
    pool = ["new", "york", "City", "of", "the", "\xa0odd", "Ünder", "a\x1cb"] + [f"w{i}" for i in range(12)]
    rows = []
    for i in range(300):
        words = random.choices(pool, k=random.randrange(60))
        for _ in range(4):
            words.insert(random.randrange(len(words) + 1), random.choice(["new york city", "one two three four five six", "a a a a", "x.y", "tail,", "\n"]))
        rows.append((random.choice([" ", "  ", "\t"]).join(words), random.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" . ,", "fr"), ("loop " * 5000, "fr"), ("loop " * 5000, "fr")]


def frame(spark, rows):
    return spark.createDataFrame([(t, l, 1, 2, "x", "y", 3) for t, l in rows], SCHEMA).repartition(4)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 2000)  # many blocks
    monkeypatch.setattr(phrases, "PART_BYTES", 1000)  # and parts
    rows = drawn()
    for least, longest in ((12, 5), (40, 3)):
        found = phrases.collocations(frame(spark, rows), least, longest)
        assert sorted(tuple(r) for r in found.collect()) == brute(rows, least, longest)


def test_ranks_of_each_language(spark):
    found = spark.createDataFrame([("en", p, a, 1, 1, 9, s) for p, a, s in (("b", 2, 5), ("é", 3, 5), ("a", 2, 5), ("z", 1, 9))] + [("de", "q", 1, 1, 1, 9, 1)], "lang string, phrase string, a long, l long, r long, n long, score long")
    assert sorted((r.lang, r.rank, r.phrase) for r in phrases.best_of_each(found, 3).collect()) == [("de", 1, "q"), ("en", 1, "z"), ("en", 2, "é"), ("en", 3, "a")]


def test_scores_beyond_64_bits(spark):
    big = 10**12
    rows = spark.createDataFrame([("en", "a b c", big, 10**17, [3 * big, 2 * big, big], [5 * big, 2 * big, big])], "lang string, phrase string, a long, total long, firsts array<long>, lasts array<long>")
    row = phrases._score(rows).first()
    assert row.score == 1000 * big * 10**17 // (2 * big * 5 * big) and (row.l, row.r) == (2 * big, 5 * big)


def test_empty_and_rare(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [("a b", "en"), (None, None)])).count() == 0
    assert phrases.collocations(frame(spark, [("a. " * 200, "en")])).count() == 0


def test_equals_sql(spark):
    assert compare(spark, connect(FOLDER), FOLDER, queries.op12_phrases, queries.ORACLE_SQL["op12_phrases"]) is None
