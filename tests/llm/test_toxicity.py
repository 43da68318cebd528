import random

from attestry.llm.toxicity import LexiconTrie, Model, Scorer, edits_allowed, forms, learn, reject_toxic, score


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_against_edit_distance():
    rng = random.Random(1)
    terms = ["badword", "awfulness", "vile", "nasty", "meh"]
    trie = LexiconTrie(terms)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "x", "a"])
        word = "".join(word)
        near = min(((d, t) for t in terms if (d := distance(word, t)) <= edits_allowed(t)), default=None)
        assert trie.match(word) == (None if near is None else (near[1], near[0])), word
        assert near is None or any(p in word for p in trie.parts)


def test_forms_and_context():
    assert forms("St*pid!!") == ["st*pid"] and forms("1d10t,") == ["idiot"] and forms("--") == []
    tokens = "he said the word nasty was old".split()
    plain = "you are a nasty one".split()
    assert Scorer.context(tokens, 4, {4}) < 1 < Scorer.context(plain, 3, {3})
    assert Scorer.context(['the', '"nasty"', 'thing'], 1, {1}) < 1


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zwarble", "quonkish", "xyloth"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as label", "2 as score")
    marked = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = learn(docs.where("doc_id < 600"), marked)
    assert set(model.terms) == {"zwarble", "quonkish", "xyloth"}
    found = {r.id: r for r in score(docs, model).collect()}
    wrong = [i for i, toxic in labels if i >= 600 and found[i].predicted != toxic]
    assert not wrong
    extra = spark.createDataFrame([(1, "ba zwarbl3 ba"), (2, None), (3, ""), (None, "quonkishh"), (4, "ba " * 5000 + "xyloth")], "doc_id long, text string")
    assert {r.id: r.predicted for r in score(extra, model).collect()} == {1: 1, 2: 0, 3: 0, None: 1, 4: 1}
    assert {r.doc_id for r in reject_toxic(extra, model).collect()} == {2, 3}
    assert score(extra.limit(0), model).count() == 0
    assert learn(docs, marked.limit(0)) == Model()


def test_words_under_a_stem_are_met_misspelled(spark):
    """Terms that share a stem: the stem meets all of them, and the trie their misspellings."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    forms_of = [f"zquarb{e}" for e in ("ling", "led", "ler", "lers", "lish", "lier")]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(forms_of))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    model = learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(t.endswith("*") for t in model.terms) and {*forms_of} & {*model.terms}
    texts = ["ba zqarbling ba", "ba zquuarblers ba", "ba zwuarbled ba", "ba zquarbel ba", "ba be bi"]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    found = sorted((r.id, r.predicted) for r in score(asked, model).collect())
    assert found == [(0, 1), (0, 1), (1, 1), (2, 1), (3, 1), (4, 0)]
