"""Quality of documents without gold labels: a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing. Expectation-maximisation over the counts of vote patterns (of which
there are at most 3 to the number of labellers, whatever the number of documents) estimates how accurate each is,
and gives each pattern a posterior chance of being good. The posteriors of a bounded sample of documents train a
logistic scorer over hashed features, which scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.base import Words, chunked

#: Documents that the scorer is trained on, at most: those whose rows hash lowest (repeated rows are one).
SAMPLE_ROWS = 20_000
#: Features of one document that train the scorer, at most (a text of very many kinds of words has more).
SAMPLE_FEATURES = 2_000
HASH_BITS = 16
ROUNDS = 200
EPOCHS, STEP, RIDGE = 60, 0.3, 1e-4
THRESHOLD = 0.5
#: A bad vote is wrong about at most so large a share of good documents, and a labeller finds a share of bad ones between
#: these: bad documents are bad in different ways, so most labellers call any of them good.
MOST_FALSE, LEAST_FOUND, MOST_FOUND = 0.002, 0.1, 0.5
_TEXT_BYTES = 8 << 20

#: Labellers: a statistic with the bounds of a bad and of a good vote. Bad lies above the first and good below the second,
#: or the other way round where the first is the smaller one. Fixed values.
LABELLERS = (
    ("top_word", 0.20, 0.12),
    ("same_as_before", 0.05, 0.01),
    ("symbols", 0.02, 0.004),
    ("capitals", 0.5, 0.15),
    ("shouts", 0.10, 0.01),
    ("word_length", 11.0, 8.0),
    ("digits", 0.15, 0.03),
    ("line_repeats", 0.30, 0.05),
    ("words", 5.0, 25.0),
    ("ended_lines", 0.3, 0.6),
)
NAMES = tuple(name for name, _, _ in LABELLERS)
_SYMBOLS = r"[#$%&*|~^<>{}\\@=_+]"


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(float)


def statistics(texts: pa.Array, words: Words) -> dict[str, np.ndarray]:
    """What the labellers look at, of each text."""
    n = np.diff(words.starts).astype(float)
    some = np.maximum(n, 1)
    rows = words.rows()
    sizes = pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False) if len(words.distinct) else np.empty(0)
    chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float), 1)
    letters = np.maximum(_count(texts, r"\pL"), 1)
    same = np.zeros(len(words.codes), bool)
    same[1:] = (words.codes[1:] == words.codes[:-1]) & (rows[1:] == rows[:-1])
    top = np.zeros(len(n))
    if len(words.codes):
        pairs, counts = np.unique(rows * len(words.distinct) + words.codes, return_counts=True)
        np.maximum.at(top, pairs // len(words.distinct), counts)
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts.to_pylist()]
    return {
        "top_word": np.where(n >= 15, top / some, 0.0),
        "same_as_before": np.bincount(rows, same, len(n)) / some,
        "symbols": _count(texts, _SYMBOLS) / chars,
        "capitals": _count(texts, r"\p{Lu}") / letters,
        "shouts": _count(texts, r"[!?]{2,}") / some,
        "word_length": np.bincount(rows, sizes[words.codes], len(n)) / some if len(words.codes) else np.zeros(len(n)),
        "digits": _count(texts, r"[0-9]") / chars,
        "line_repeats": np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines]),
        "words": n,
        "ended_lines": np.array([sum(x.rstrip()[-1] in ".!?…:;\"”»" for x in t) / len(t) if t else 0.0 for t in lines]),
    }


def votes(values: dict[str, np.ndarray]) -> np.ndarray:
    """A column per labeller: 0 bad, 1 nothing, 2 good."""
    out = []
    for name, bad, good in LABELLERS:
        x = values[name] if bad > good else -values[name]
        low, high = (good, bad) if bad > good else (-good, -bad)
        out.append(np.where(x > high, 0, np.where(x < low, 2, 1)))
    return np.stack(out, axis=1).astype(np.int8)


def weak_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior chance of good of each vote pattern, and each labeller's chances of votes by class (bad, good).

    Votes are taken as independent given the class. The start trusts every labeller somewhat.
    """
    if not len(patterns):
        return np.zeros(0), np.full((len(LABELLERS), 2, 3), 1 / 3)
    seen = np.eye(3)[patterns]
    lean = (patterns == 2).sum(axis=1) - 3.0 * (patterns == 0).sum(axis=1)
    posterior = 1 / (1 + np.exp(-(lean - 1.0)))
    weight = counts / counts.sum()
    for _ in range(rounds):
        share = np.stack(((1 - posterior) * weight, posterior * weight))
        prior = np.clip(share.sum(axis=1), 0.01, 0.99)
        chance = np.einsum("cp,plv->lcv", share, seen) + 1e-4 * np.array([[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]])
        chance /= chance.sum(axis=2, keepdims=True)
        chance[:, 1, 0] = np.minimum(chance[:, 1, 0], MOST_FALSE)
        chance[:, 0, 0] = np.clip(chance[:, 0, 0], LEAST_FOUND, MOST_FOUND)
        chance[:, :, 1:] *= ((1 - chance[:, :, 0]) / chance[:, :, 1:].sum(axis=2))[:, :, None]
        logs = np.log(prior)[None] + np.einsum("plv,lcv->pc", seen, np.log(chance))
        posterior = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
    return posterior, chance


def _shape(word: str) -> str:
    """The kinds of characters in a word, each run once, with what ends it."""
    out = ""
    for c in word[:24]:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "s" if c in "#$%&*|~^<>{}\\@=_+" else c if c in ".,;:!?'\"-()" else "x"
        if kind != out[-1:]:
            out += kind
    return out


class Hasher:
    """Hashed features: shares of word shapes and of shapes that follow each other, and ranges of the statistics."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def shape(self, word: str) -> int:
        shape = _shape(word)
        if shape not in self.known:
            self.known[shape] = xxhash.xxh32_intdigest(shape) & ((1 << HASH_BITS) - 1)
        return self.known[shape]

    def __call__(self, words: Words, values: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, features and weights of all entries that aren't zero."""
        mask, n = (1 << HASH_BITS) - 1, len(words.starts) - 1
        shapes = np.fromiter((self.shape(w) for w in words.distinct.to_pylist()), np.int64, len(words.distinct))
        rows = words.rows()
        ids = shapes[words.codes] if len(shapes) else np.empty(0, np.int64)
        pairs = (ids[:-1] * 31 + ids[1:] + 7) & mask
        inside = rows[1:] == rows[:-1]
        keys, k = np.unique(np.concatenate((rows * (mask + 1) + ids, rows[1:][inside] * (mask + 1) + pairs[inside])), return_counts=True)
        row, feature = keys >> HASH_BITS, keys & mask
        weight = k / np.maximum(np.diff(words.starts), 1)[row]
        extra_rows, extra = [row], [feature]
        for i, (name, bad, good) in enumerate(LABELLERS):
            step = np.clip(np.floor(values[name] / max(abs(bad - good), 1e-9) * 2), 0, 15).astype(np.int64)
            extra_rows.append(np.arange(n))
            extra.append((i * 1009 + step * 31 + 13) & mask)
        every = np.concatenate(extra)
        return np.concatenate(extra_rows), every, np.concatenate((np.sqrt(weight), np.ones(len(every) - len(weight))))


def _features(batch: pa.RecordBatch, hasher: Hasher) -> tuple:
    texts = pc.fill_null(batch.column("text"), "")
    words = Words(texts, as_is=True)
    values = statistics(texts, words)
    return values, hasher(words, values)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights of the scorer (the intercept last). All documents vote; at most `rows` of them train the scorer."""
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", _TEXT_BYTES):
            cast = votes(statistics(batch.column("text"), Words(batch.column("text"), as_is=True)))
            patterns, n = np.unique(cast, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, p)) for p in patterns]), pa.array(n)], ["pattern", "n"])

    counted = texts.select("text").mapInArrow(vote, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns = np.array([[int(c) for c in r.pattern] for r in counted], int).reshape(-1, len(LABELLERS))
    posterior, _ = weak_labels(patterns, np.array([r.n for r in counted], float))
    label = {r.pattern: float(p) for r, p in zip(counted, posterior, strict=True)}

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in chunked(batches, "text", _TEXT_BYTES):
            values, (row, feature, weight) = _features(batch, hasher)
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(1, batch.num_rows))
            lists = [np.split(x[order], cuts) for x in (feature, weight)]
            wanted = [label["".join(map(str, v))] for v in votes(values)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(list(lists[0]), pa.list_(pa.int64())), pa.array(list(lists[1]), pa.list_(pa.float64())), pa.array(wanted, pa.float64())], ["row", "features", "weights", "label"])

    # hashes of rows are chosen first, so that no text moves; the bound is the last of them
    hashed = texts.select(F.xxhash64("id", "text").alias("row"))
    last = hashed.distinct().orderBy("row").limit(rows).agg(F.max("row")).first()[0]
    if last is None:
        return np.zeros((1 << HASH_BITS) + 1)
    examples = texts.withColumn("row", F.xxhash64("id", "text")).where(F.col("row") <= last).mapInArrow(example, "row long, features array<long>, weights array<double>, label double")
    cut = [F.slice(c, 1, SAMPLE_FEATURES).alias(c) for c in ("features", "weights")]
    sample = examples.select("row", *cut, "label").groupBy("row").agg(F.first("features").alias("features"), F.first("weights").alias("weights"), F.first("label").alias("label")).orderBy("row").collect()
    w, seen = np.zeros((1 << HASH_BITS) + 1), np.full((1 << HASH_BITS) + 1, 1e-8)
    size = np.array([len(r.features) for r in sample])
    row, feature = np.repeat(np.arange(len(sample)), size), np.concatenate([r.features for r in sample]).astype(int)
    weight, wanted = np.concatenate([r.weights for r in sample]), np.array([r.label for r in sample])
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-(np.bincount(row, weight * w[feature], len(sample)) + w[-1])))
        slope = np.bincount(feature, weight * (p - wanted)[row], len(w)) / len(sample) + RIDGE * w
        slope[-1] = (p - wanted).mean()
        seen += slope**2
        w -= STEP * slope / np.sqrt(seen)
    return w


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, keep) for each row: score from 0 to 1 (higher: good likelier), keep from THRESHOLD on.

    A null text is an empty one. Null ids and repeated rows come back as they are; other columns are ignored; an empty
    table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in chunked(batches, "text", _TEXT_BYTES):
            _, (row, feature, weight) = _features(batch, hasher)
            w = held.value
            p = 1 / (1 + np.exp(-(np.bincount(row, weight * w[feature], batch.num_rows) + w[-1])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p)], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumn("keep", (F.col("score") >= THRESHOLD).cast("int"))
