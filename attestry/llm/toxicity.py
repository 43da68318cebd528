"""Toxicity: a learned lexicon, matched through Levenshtein automata, with scores from context windows.

The lexicon comes from labelled rows: words, and stems (written with a star) that many words begin with. Each
distinct word of a text becomes a Levenshtein automaton which is run along the trie of the words, so misspelled terms
are found in one walk; stems are met exactly, and the words seen under them stand in the trie as well, so their
misspellings are found too. A hit counts less inside a quotation or after
a word of reporting, and more beside other hits, an address or an exclamation. A logistic curve over the hits, fitted
on the labelled rows, gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.base import Words, chunked, cut_lineage, mix, table

#: Labelled rows that the lexicon and the curve are learned from, at most: those whose ids hash lowest.
SAMPLE_ROWS = 20_000
#: Largest chance, over all words together, that a harmless word enters the lexicon.
FALSE_TERM_CHANCE = 0.01
STEM_LENGTHS = range(3, 9)
#: Words on either side of a hit that its context consists of.
WINDOW = 5
THRESHOLD = 0.3
_SKETCHES = 4
_TEXT_BYTES = 8 << 20
#: Words whose match a worker remembers; it forgets all when there are more.
_REMEMBERED = 2_000_000

# Signs read as letters, marks of quotation, words of reporting and of address.
SIGN_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
QUOTES_OPEN = "\"'“‘«„"
QUOTES_CLOSE = "\"'”’»“"
REPORTING = frozenset("said says say called calls quote quoted quotes wrote writes word term slur phrase dit dice sagte nannte mot wort palabra".split())
ADDRESS = frozenset("you your you're youre u ur tu te vous du dich dein usted eres".split())


def edits_allowed(term: str) -> int:
    """Longer terms bear more misspelling."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class LexiconTrie:
    """Terms as a trie; match() runs a word's Levenshtein automaton along it."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.lengths = {n for t in terms for n in range(len(t) - edits_allowed(t), len(t) + edits_allowed(t) + 1)}
        self.most = max(map(edits_allowed, terms), default=0)
        for term in terms:
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term
        cut = {(t, k, edits_allowed(t) + 1) for t in terms for k in range(edits_allowed(t) + 1)}
        #: A word within the allowed edits of a term has one of these in it: a term's parts are one more than its edits.
        self.parts = sorted({t[k * len(t) // n : (k + 1) * len(t) // n] for t, k, n in cut})

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits (ties: the first in order), and its distance."""
        if len(word) not in self.lengths:
            return None
        places: dict[str, int] = {}
        for i, letter in enumerate(word):
            places[letter] = places.get(letter, 0) | 1 << i
        full, best = 1 << len(word), None
        # bit i of states[e]: i letters of the word are read with e edits
        stack = [(self.root, [(2 << e) - 1 for e in range(self.most + 1)])]
        while stack:
            node, states = stack.pop()
            for letter, below in node.items():
                if not letter:
                    cost = next((e for e, s in enumerate(states) if s & full), None)
                    if cost is not None and cost <= edits_allowed(below) and (best is None or (cost, below) < best):
                        best = (cost, below)
                    continue
                here, after = places.get(letter, 0), []
                for e, s in enumerate(states):
                    to = (s & here) << 1
                    if e:
                        to |= states[e - 1] | states[e - 1] << 1 | after[-1] << 1
                    after.append(to)
                if after[-1]:
                    stack.append((below, after))
        return (best[1], best[0]) if best else None


_SPLIT = re.compile(r"[^\w@$!|*]+|_+")
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\d\W_]")


def forms(token: str) -> list[str]:
    """The words that a token without white space may stand for, in lower case."""
    out = []
    for part in _SPLIT.split(token.lower()):
        bare = _ENDS.sub("", part)
        if bare:
            out.append("".join(SIGN_LETTERS.get(c, c) for c in bare) if _INNER.search(bare) else bare)
    return out


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    #: Share of an exact hit that a misspelling is worth: by the word itself, else by the term it is near to.
    worth: dict[str, float] = field(default_factory=dict)
    misspelled: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, float, float] = (-4.0, 0.0, 0.0)


class Scorer:
    """Hits of texts and their context scores."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.words, self.stems = {t for t in model.terms if t[-1] != "*"}, {t[:-1] for t in model.terms if t[-1] == "*"}
        # terms whose near misses, seen or not, are worth nothing are met as they stand only
        self.trie = LexiconTrie(sorted(t for t in self.words if model.misspelled.get(t, 0.0) > 0))
        known = [w for w, worth in model.worth.items() if worth > 0]
        # what no term can be near to: no part of one, and no sign or digit among its letters
        self.may_hit = "|".join([*map(re.escape, [*self.trie.parts, *sorted({*self.words, *self.stems, *known})]), r"\pL[^\pL]+\pL", "[0-9]"])

    def hit(self, token: str) -> tuple[float, str, int] | None:
        """Worth, matched word and edits of a token's best hit."""
        if token not in self.known:
            if len(self.known) > _REMEMBERED:
                self.known.clear()
            found = None
            for word in forms(token):
                if word in self.words or self.stems and any(word[:n] in self.stems for n in STEM_LENGTHS):
                    found = (1.0, word, 0)
                    continue
                match = None if word in self.model.worth else self.trie.match(word)
                worth = self.model.misspelled[match[0]] if match else self.model.worth.get(word, 0.0)
                if worth > 0:
                    found = max(found or (0.0, "", 0), (worth, word, match[1] if match else 1))
            self.known[token] = found
        return self.known[token]

    @staticmethod
    def context(tokens: list[str], at: int, hits: set[int]) -> float:
        """How much a hit counts where it stands: below 1 in a quotation or report, above 1 in an attack."""
        low = max(0, at - WINDOW)
        window = tokens[low : at + WINDOW + 1]
        opened = any(t[:1] and t[0] in QUOTES_OPEN for t in tokens[low : at + 1])
        closed = any(t.rstrip(".,;:!?")[-1:] and t.rstrip(".,;:!?")[-1] in QUOTES_CLOSE for t in tokens[at : at + WINDOW + 1])
        reported = any(t.strip(".,:;\"'") in REPORTING for t in tokens[low:at])
        score = 0.25 if opened and closed else 1.0
        score *= 0.5 if reported else 1.0
        score *= 1.0 + 0.25 * any(i in hits for i in range(low, at + WINDOW + 1) if i != at)
        score *= 1.0 + 0.25 * any(t.strip(".,:;!?\"'") in ADDRESS for t in window)
        return score * (1.0 + 0.1 * any(t.endswith("!") for t in tokens[at : at + 3]))

    def features(self, texts: pa.Array) -> np.ndarray:
        """Of each text: the strongest hit and the logarithm of their sum."""
        words = Words(texts)
        out = np.zeros((len(words.starts) - 1, 2))
        if not self.model.terms:
            return out
        may = np.flatnonzero(pc.match_substring_regex(pc.utf8_lower(words.distinct), self.may_hit).to_numpy(zero_copy_only=False))
        hits = {c: found for c, w in zip(may.tolist(), words.distinct.take(pa.array(may)).to_pylist(), strict=True) if (found := self.hit(w))}
        hit = np.zeros(len(words.distinct), bool)
        hit[list(hits)] = True
        places = np.flatnonzero(hit[words.codes])
        rows = np.searchsorted(words.starts, places, "right") - 1
        each, first = np.unique(rows, return_index=True)
        for row, own in zip(each.tolist(), np.split(places, first[1:]), strict=True) if len(each) else ():
            start, stop = int(words.starts[row]), int(words.starts[row + 1])
            tokens = words.distinct.take(pa.array(words.codes[start:stop])).to_pylist()
            at = set((own - start).tolist())
            scores = [hits[int(words.codes[start + i])][0] * self.context(tokens, i, at) for i in at]
            out[row] = max(scores), math.log1p(sum(scores))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge-penalised logistic curve with intercept, by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w, keep = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _tail(k: int, n: int, p: float) -> float:
    """Chance of k or more among n."""
    if k <= 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    return sum(map(math.exp, logs))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, text, label): at most `rows` labelled rows, one of each group of near copies.

    Four minimum hashes stand for a text; a row stays if it is the first with each of its four.
    """
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = marked.where("id is not null").orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = texts.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", _TEXT_BYTES):
            words = Words(batch.column("text"))
            hashes = words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)
            pairs = mix(hashes[:-1] * np.uint64(31) + hashes[1:]) if len(hashes) > 1 else np.empty(0, np.uint64)
            out = []
            for a, b in zip(words.starts[:-1], words.starts[1:], strict=True):
                own = pairs[a : b - 1] if b - a > 1 else hashes[a:b]
                out.append([int(mix(own ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))).min().view(np.int64)) if len(own) else k for k in range(_SKETCHES)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], ["id", "text", "label", "sketch"])

    sketched = cut_lineage(sample.mapInArrow(sketch, "id long, text string, label int, sketch array<long>"))
    each = sketched.select("id", F.posexplode("sketch").alias("k", "s"))
    first = each.groupBy("k", "s").agg(F.min("id").alias("first"))
    copies = each.join(first, ["k", "s"]).where("id > first").select("id").distinct()
    return sketched.drop("sketch").join(copies, "id", "left_anti")


def _word_rows(sample: DataFrame) -> DataFrame:
    """(word, label) once for each text and word form or stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", _TEXT_BYTES):
            words = Words(batch.column("text"))
            distinct, labels = [forms(w) for w in words.distinct.to_pylist()], batch.column("label").to_pylist()
            for row, label in enumerate(labels):
                codes = np.unique(words.codes[words.starts[row] : words.starts[row + 1]])
                own = {f for c in codes for f in distinct[c] if len(f) >= 3}
                own = sorted(own | {f"{f[:n]}*" for f in own for n in STEM_LENGTHS if n <= len(f)})
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([label] * len(own), pa.int32())], ["word", "label"])

    return sample.select("text", "label").mapInArrow(run, "word string, label int")


def choose_terms(likely: list[tuple[str, int, int]], base: float, tried: int) -> list[str]:
    """The lexicon from (word or stem, texts, toxic texts): what chance doesn't explain, the most certain first.

    A stem must be more than one of its words, and no stem is taken beside a stem that covers it. Likely words under
    a chosen stem are taken with it, for their misspellings.
    """
    words = {w: k for w, _, k in likely if w[-1] != "*"}
    widest: dict[str, int] = {}
    for word, k in words.items():
        for n in STEM_LENGTHS:
            if n <= len(word):
                widest[word[:n]] = max(widest.get(word[:n], 0), k)
    ranked = sorted((_tail(k, n, base), w[-1] == "*", -len(w), w, k) for w, n, k in likely)
    stems: dict[str, int] = {}
    chosen = []
    for chance, is_stem, _, word, k in ranked:
        bare = word.rstrip("*")
        if chance * tried >= FALSE_TERM_CHANCE or any(bare[:n] in stems for n in STEM_LENGTHS):
            continue
        if is_stem:
            if 2 * widest.get(bare, 0) > k or any(q.startswith(bare) and 2 * least >= k for q, least in stems.items()):
                continue
            stems[bare] = k
        chosen.append(word)
    return sorted({*chosen, *(w for w in words if any(w[:n] in stems for n in STEM_LENGTHS))})


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labelled rows. Without labels of both kinds it has no terms and scores everything alike."""
    sample = cut_lineage(training_sample(docs, labels, id_col, text_col, label_col, rows))
    size = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < size[1] < size[0]:
        return Model()
    base = size[1] / size[0]
    counts = _word_rows(sample).groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    vocabulary = counts.count()
    likely = counts.where("k >= 3 and 2 * k > n").collect()  # words of a bounded sample
    terms = choose_terms([(r.word, r.n, r.k) for r in likely], base, vocabulary)
    model = Model(terms)
    if not terms:
        model.weights = (math.log(base / (1 - base)), 0.0, 0.0)
        return model
    trie = LexiconTrie([t for t in terms if t[-1] != "*"])
    near = counts.where(~F.col("word").endswith("*") & F.length("word").isin(sorted(trie.lengths)))

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool((m := trie.match(w)) and m[1]) for w in batch.column("word").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    seen = near.select("word", "n", "k").mapInArrow(variants, "word string, n long, k long").collect()
    met = {t: [0, 0] for t in terms if t[-1] != "*"}
    for r in seen:
        term = trie.match(r.word)[0]
        met[term][0] += r.n
        met[term][1] += r.k
    # an unseen near miss is as likely meant as those of its term that were seen; where none was, it most likely is
    rates = {t: (k + 1.9) / (n + 2) for t, (n, k) in met.items()}
    # what is met in harmless texts more often than in toxic ones is another word, not a misspelling
    worth = lambda rate: (rate - base) / (1 - base) if rate >= 0.5 else 0.0
    model.misspelled = {t: worth(rate) for t, rate in rates.items()}
    model.worth = {r.word: worth((r.k + 2 * rates[trie.match(r.word)[0]]) / (r.n + 2)) for r in seen}
    fitted = features(sample, model, "id", "text", keep=("label",)).select("strongest", "total", "label").toPandas()
    model.weights = tuple(_logistic(fitted[["strongest", "total"]].to_numpy(), fitted["label"].to_numpy()))
    return model


def features(docs: DataFrame, model: Model, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, strongest, total) of each row, with the columns to keep."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in chunked(batches, "text", _TEXT_BYTES):
            found = scorer.features(pc.fill_null(batch.column("text"), ""))
            others = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(found[:, 0]), pa.array(found[:, 1])], [*names, "strongest", "total"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kept}, strongest double, total double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row: score from 0 to 1, predicted 1 from THRESHOLD on.

    A null text scores as an empty one, which has no hits. Null ids and repeated rows come back as they are;
    other columns are ignored; an empty table gives an empty result.
    """
    a, b, c = (float(w) for w in model.weights)
    value = 1 / (1 + F.exp(-(F.lit(a) + b * F.col("strongest") + c * F.col("total"))))
    scored = features(docs, model, id_col, text_col).select("id", value.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text isn't predicted toxic, with the columns of docs, whatever their names.

    A null or empty text has no hits and stays, as far as the model's intercept is below THRESHOLD; rows that are
    repeated and rows with null ids are judged each; an empty table gives an empty table.
    """
    a, b, c = (float(w) for w in model.weights)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in chunked(batches, text_col, _TEXT_BYTES):
            found = scorer.features(pc.fill_null(batch.column(text_col), ""))
            yield batch.filter(pa.array(1 / (1 + np.exp(-(a + found @ np.array([b, c])))) < THRESHOLD))

    return docs.mapInArrow(run, schema)


def labelled(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")
