import random

import numpy as np
import xxhash

from attestry.llm.simhash_dedup import band_keys, band_parts, keep_first, near_duplicates


def brute(rows):
    """Fingerprints from the definition, and components by comparing all pairs."""
    prints = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
    name = [r[0] for r in rows]
    while True:
        new = [min(name[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(rows))]
        if new == name:
            return prints, name
        name = new


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 60, 200]))]
        rows.append((i, " ".join(text)))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 * rng.randrange(1, 9) + len(rows), "\t".join(text).upper()))
    rows += [(7000, None), (7001, ""), (7002, " \x0b\n"), (7003, "x " * 30000), (7003, "x " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component", "3 as id")
    found = {(r.id, r.fp & (1 << 64) - 1, r.component) for r in near_duplicates(df).collect()}
    prints, name = brute(rows)
    assert found == {(r[0], p, n) for r, p, n in zip(rows, prints, name, strict=True)}
    assert near_duplicates(df).count() == len(rows)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (2, "d")], "doc_id long, text string")
    assert {(r.id, r.component) for r in near_duplicates(df).collect()} == {(None, 3), (3, 3), (2, 2)}
    assert near_duplicates(df.limit(0)).count() == 0


def test_keep_first_against_brute_force(spark):
    """One row of each group: all pairs by the similarity of five-word shingles; ties, repeated rows and clashing names."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.choice([1, 3, 30, 150, 600]))]
        rows.append((i, " ".join(text)))
        for _ in range(rng.randrange(4)):
            text = list(text)
            if rng.random() < 0.7:
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((100 + len(rows), " ".join(text)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (902, "x y"), (902, "x y"), (902, "y x"), (903, "long words here " * 20000)]
    clash = ["1 as fp", "2 as first_id", "3 as __id", "4 as __key", "5 as text_hash", "6 as grp", "7 as a"]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *clash)
    shingles = []
    for _, text in rows:
        own = (text or "").split()
        shingles.append({" ".join(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set())
    name = list(range(len(rows)))
    link = lambda i, j: len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])
    while True:
        new = [min(name[j] for j in range(len(rows)) if link(i, j)) for i in range(len(rows))]
        if new == name:
            break
        name = new
    groups = {}
    for k, n in enumerate(name):
        groups.setdefault(n, []).append(rows[k][0])
    out = keep_first(df)
    assert out.columns == df.columns
    kept = sorted((r.doc_id for r in out.collect()), key=str)
    assert kept == sorted((min((i for i in own if i is not None), default=None) for own in groups.values()), key=str)
    assert keep_first(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.85, by words changed at random places, by a changed run and by a longer text: 0.9 of each."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, kinds = [], {}
    own = lambda text: {tuple(text[k : k + 5]) for k in range(len(text) - 4)}
    for n in (60, 300, 1000):
        for kind in ("places", "run", "longer"):
            while len(kinds.setdefault((n, kind), [])) < 60:
                text = [word() for _ in range(n)]
                near = list(text)
                if kind == "places":
                    for _ in range(max(1, n // 45)):
                        near[rng.randrange(n)] = word()
                elif kind == "run":
                    size, at = rng.randrange(n // 20, n // 9), rng.randrange(n - n // 9)
                    near[at : at + size] = [word() for _ in range(size)]
                else:
                    near += [word() for _ in range(rng.randrange(n // 6, n // 4))]
                x, y = own(text), own(near)
                if 0.8 <= len(x & y) / len(x | y) <= 0.87:
                    kinds[n, kind].append(len(rows))
                    rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(near))]
    kept = {r.doc_id for r in keep_first(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    recall = {kind: sum(k + 1 not in kept for k in own) / len(own) for kind, own in kinds.items()}
    assert min(recall.values()) >= 0.9, recall
    assert all(k in kept for own in kinds.values() for k in own)


def test_large_group_of_near_copies(spark):
    """900 near copies of one text and 300 texts that share half of it: the first become one, the others stay."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(900):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join([*base[:100], *(f"y{rng.randrange(10**6)}" for _ in range(100))])) for i in range(300)]
    kept = {r.doc_id for r in keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert kept == {0, *range(1000, 1300)}


def test_band_parts_hold_a_common_one():
    """Sets of similarity 0.8 and more that share a band key have a part of it in common, at any size."""
    rng, met = np.random.default_rng(4), 0
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        own = rng.integers(1, 1 << 62, n).astype(np.uint64)
        less = int(rng.integers(0, n // 9 + 1))
        a, b = np.unique(own), np.unique(np.concatenate((own[less:], rng.integers(1, 1 << 62, less).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        if common < 0.8 * (len(a) + len(b) - common):
            continue
        keys = [band_keys([x])[0].view(np.int64).tolist() for x in (a, b)]
        first, second = (dict(band_parts(x, {*keys[0], *keys[1]}, 0.8)) for x in (a, b))
        for key in set(first) & set(second):
            met += 1
            assert np.isin(first[key], second[key]).any(), (n, less)
    assert met > 1000
