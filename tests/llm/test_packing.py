import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from attestry.llm.packing import IdEncoder, first_fit_decreasing, pack
from tests.conftest import DATA


def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers():
    rng = random.Random(1)
    texts = ["".join(rng.choice(" a1.'s\n\té  xYñ漢") for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["", " ", "a" * 5000, " " * 5000 + "x", "<|endoftext|> it's", "\n \n  x"]
    found = IdEncoder(public_tokenizers.path("byte_bpe_50k.json"))(pa.array(texts))
    tokenizer = plain()
    assert all(list(a) == tokenizer.encode(t, add_special_tokens=False).ids for a, t in zip(found, texts, strict=True))


def test_ids_of_a_whole_table(spark):
    """Every document of a table, against the tokenizer alone."""
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("text").collect()]
    found = IdEncoder(public_tokenizers.path("byte_bpe_50k.json"))(pa.array(texts))
    wanted = plain().encode_batch(texts, add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(found, wanted, strict=True))


def test_another_kind_of_file():
    """A file with a normalizer and word ends isn't merged by rank."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, texts = IdEncoder(path), ["Some Words, here", "", "<|endoftext|> x"]
    assert encode.fast is None
    assert [x.tolist() for x in encode(pa.array(texts))] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_first_fit_decreasing_against_plain_search():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 300):
        sizes = rng.integers(1, 101, n)
        room, expected = [], [0] * n
        for i in sorted(range(n), key=lambda k: (-sizes[k], k)):
            bin_ = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if bin_ == len(room):
                room.append(100)
            room[bin_] -= sizes[i]
            expected[i] = bin_
        assert first_fit_decreasing(sizes, 100).tolist() == expected


def test_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "γάμμα", "Delta's", "\n"]) for _ in range(rng.choice([0, 3, 40, 700])))) for i in range(60)]
    rows += [(None, None), (7, ""), (7, ""), (8, "long " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'x' as sequence_id")
    out = pack(df, length=256, group_size=16).collect()
    tokenizer, wanted = plain(), []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 256):
            part = ids[at : at + 256]
            wanted.append((i, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out), key=key) == sorted(wanted, key=key)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 256
    assert pack(df.limit(0)).count() == 0
