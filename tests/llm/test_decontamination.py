import random

from attestry.llm.decontamination import contaminated, decontaminate, similarity


def test_passages_are_found_and_clean_texts_stay(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(15, 50)))) for i in range(30)] + [(100, "one two three"), (101, None), (102, " ,.")]
    rows, wanted = [], {}
    for i in range(80):
        words = text(rng.randrange(1, 300))
        if i % 4 == 0:
            item = items[i // 4 % 30]
            passage = item[1].split()
            if i % 8 == 0:  # one word more at an end leaves most shingles
                passage = [*passage[:-1], word()]
            at = rng.randrange(len(words) + 1)
            words = words[:at] + [p.upper() + "!" for p in passage] + words[at:]
            wanted[i] = item[0]
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "x ONE two, three y"), (302, "clean"), (None, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item", "2 as fp")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as id")
    found = {(r.id, r.item): r for r in contaminated(docs, bench).collect()}
    assert set(found) == {*wanted.items(), (302, 100), (None, 0)}
    assert all(r.similarity >= 0.8 for r in found.values())
    kept = [(r.doc_id, r.text) for r in decontaminate(docs, bench).collect()]
    assert sorted(str(k) for k in kept) == sorted(str((i, t)) for i, t in rows if i not in wanted and i is not None and t != "x ONE two, three y")
    assert decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert contaminated(docs.limit(0), bench).count() == 0


def test_similarity():
    import numpy as np

    a = np.array([1, 1, 2, 3])
    assert similarity(a, a) == 1.0
    assert similarity(a, np.array([1, 2, 3, 4])) == 3 / 5


def test_recall_at_the_edge_of_similarity(spark):
    """Passages whose five-word shingles are just 0.8 similar or more, by words replaced at an end, against brute force."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    items, rows, wanted = [], [], set()
    for k in range(240):
        n = rng.choice((25, 50, 100, 200))
        item = [word() for _ in range(n)]
        items.append((k, " ".join(item)))
        # of n - 4 shingles `gone` differ on either side: (n - 4 - gone) / (n - 4 + gone) >= 0.8
        gone = int((n - 4) / 9)
        passage = [*item[:-gone], *(word() for _ in range(gone))] if k % 2 else [*(word() for _ in range(gone)), *item[gone:]]
        rows.append((k, " ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(40))])))
        wanted.add((k, k))
        cut = [*item[: n // 2], *(word() for _ in range(n - n // 2))]  # half of an item is not similar
        rows.append((1000 + k, " ".join(cut)))
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(5)
    found = [(r.id, r.item) for r in contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert len(found) == len(set(found)) and set(found) <= wanted
    assert len(found) >= 0.99 * len(wanted)


def test_ties_long_texts_and_names(spark):
    passage = "one two three four five six seven eight nine ten"
    rows = [(1, f"{passage} x {passage}"), (1, f"{passage} x {passage}"), (2, "word " * 50_000 + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bad_id", "2 as bad_key", "3 as key2", "4 as n_words")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string").selectExpr("*", "1 as shingles")
    assert sorted((r.id, r.start, r.size) for r in contaminated(docs, bench).collect()) == [(1, 0, 10), (2, 50_000, 10)]
    assert decontaminate(docs, bench).count() == 0
    assert sorted(r.doc_id for r in decontaminate(docs, bench.limit(0)).collect()) == [1, 1, 2]
