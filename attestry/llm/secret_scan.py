"""Secrets in text: patterns, and a linear-chain conditional random field that adds what they miss.

Text is cut into pieces (runs of letters, digits and + / _ -, and other characters one by one). Pieces that touch
form a chain. A piece is a candidate if it is long and mixed enough for a secret; in chains without one every piece is
fixed to be outside, so only the others need decoding, and the field falls apart between them exactly. Pieces are
tagged begin, inside or outside by Viterbi from their shape, the words around them and what kind of file it is.

The field is trained on a bounded sample in which the patterns' values are the secrets. So that it finds what the
patterns can't, it must not learn the patterns' words: the words and signs before a value are masked in half of the
examples, and in as many more the value is drawn anew from another alphabet. Harmless long pieces of usual forms (ids,
times, names of files, functions and hosts) are put into the sample's own words as examples of what is outside.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.base import Words, chunked, cut_lineage

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "field")
_MAY_HAVE_BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
# Alphabets that secrets are drawn from, what may stand before one, and harmless long pieces
# (0 is a digit, x a hex digit, a and A letters, w and W words; other signs are themselves).
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
PREFIXES = ("", "", "", "", "key=", "auth: ", 'bearer "', "credential = '", '"pwd": "', "(", '"', "'", "sk_", "pk_live_", "ghp_", "xoxb-")
HARMLESS = ("xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxxxxxx", "0000-00-00T00:00:00Z", "0000-00-00", "w_w_0000", "w-w-w-0.0.0", "wWWWw", "wWWWWW0", "https://w.w.com/w/00000/w-w-w-w", "w00@w0.w.com", "/w/w/w0/w_w.w", "w0000w.pdf", "W-0000-000000", "+00-000-0000000", "0000000000000000", "w_w_w_w_w_00", "vw0.00.000-w00", "WWWW_W_000", "0000x0000px")

#: Texts that the field is trained on, at most: so many with a base match and so many without, whose rows hash lowest.
SAMPLE_TEXTS = 2_000
#: Chains of these texts, of each kind, that the driver takes in at most, and the pieces of one chain that train together.
SAMPLE_CHAINS, CHAIN_PIECES = 4_000, 64
#: Examples with drawn values of each kind (secret and harmless).
DRAWN = 1_500
_SEED = 20240229
#: Epochs and step of training (AdaGrad), and the penalty of large weights.
EPOCHS, STEP, RIDGE = 120, 0.2, 0.02
#: An added span has at least so many characters, and the field gives it at least so much probability.
LEAST_ADDED, LEAST_CHANCE = 12, 0.8
#: Features that fewer pieces of the sample have are left out.
LEAST_SUPPORT = 3

_PIECE = re.compile(r"[A-Za-z0-9+/_\-]+|[^\sA-Za-z0-9+/_\-]")
_GLUED = re.compile(r"\S+")
_LONG = r"[A-Za-z0-9+/_\-]{8,}"
_LETTERS = re.compile(r"[A-Za-z][a-z]*")
_HEX_DIGITS = set("0123456789abcdef")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, value start, value end) of the base patterns, by start and kind."""
    found = [(m.start(), m.end(), "assign", m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), m.end(), "access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def is_candidate(piece: str) -> bool:
    """Long enough for a secret, and no ordinary word: digits among letters, or capitals inside."""
    if len(piece) < 8:
        return False
    digits, letters = sum(c.isdigit() for c in piece), sum(c.isalpha() for c in piece)
    inner = piece[1:]
    mixed = any(c.isupper() for c in inner) and any(c.islower() for c in inner)
    return digits > 0 and letters > 0 or mixed and len(piece) >= 16


def _entropy(piece: str) -> float:
    n = len(piece)
    return -sum(k / n * math.log2(k / n) for k in Counter(piece).values())


def _shape(piece: str) -> str:
    kinds = {"0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c if c in "+/_-" else "*" for c in piece}
    return "".join(sorted(kinds))


def file_features(text: str) -> list[str]:
    """What kind of file the text is."""
    head = text[:1]
    lines = text.count("\n") + 1
    code = text.count("{") + text.count(";") + text.count("=")
    return [f"file.code={min(3, int(math.log2(1 + 4 * code / lines)))}", f"file.first={head if head in '{[<#-' else 'x'}"]


def chain_features(before: list[str], pieces: list[str], after: str, file: list[str]) -> list[list[str]]:
    """Features of the pieces of a chain; before holds the words that come earlier, after the next chain's first piece.

    The work is linear in the pieces and their letters.
    """
    shapes, out, words = [_shape(p) for p in pieces], [], before
    for i, piece in enumerate(pieces):
        previous = "^" if not i else pieces[i - 1] if len(pieces[i - 1]) == 1 else shapes[i - 1]
        following = "$" if i + 1 == len(pieces) else pieces[i + 1] if len(pieces[i + 1]) == 1 else shapes[i + 1]
        size = min(9, int(2 * math.log2(len(piece))))
        digits = sum(map(piece.count, "0123456789")) / len(piece)
        turns = sum(a.isdigit() != b.isdigit() or (b.isupper() and not a.isupper()) for a, b in zip(piece, piece[1:], strict=False)) / len(piece)
        longest = max(map(len, _LETTERS.findall(piece)), default=0)
        own = ["bias", f"shape={shapes[i]}", f"size={size}", f"entropy={int(2 * _entropy(piece))}.{size}", f"digits={int(5 * digits)}", f"turns={int(8 * turns)}.{len(piece) >= 16}", f"letters={min(longest, 12)}"]
        own += [f"hex={not set(piece.lower()) - _HEX_DIGITS}.{size}", f"candidate={is_candidate(piece)}", f"joints={min(4, piece.count('-') + piece.count('_') + piece.count('/'))}"]
        own += [f"previous={previous}", f"following={following}", *(f"word={w}" for w in words if len(w) <= 20)]
        own += [f"head={piece[:4]}" if len(piece) >= 12 else f"short={len(piece)}", f"after={after[:1]}"]
        out.append(own + file)
        if len(piece) > 1:
            words = [*words, piece.lower()][-2:]
    return out


#: Features that tell where a piece stands: training masks them.
_PLACE = ("word=", "previous=", "following=", "after=", "head=")


@dataclass
class Chain:
    """Touching pieces with a candidate among them: places in the text, and features."""

    spans: list[tuple[int, int]]
    features: list[list[str]]


def chains(text: str) -> list[Chain]:
    out, before, file = [], [], None
    glued = list(_GLUED.finditer(text))
    for k, chunk in enumerate(glued):
        word = chunk[0]
        cut = list(_PIECE.finditer(word))
        pieces = [p[0] for p in cut]
        if any(map(is_candidate, pieces)):
            file = file or file_features(text)
            after = glued[k + 1][0] if k + 1 < len(glued) else ""
            at = chunk.start()
            out.append(Chain([(at + p.start(), at + p.end()) for p in cut], chain_features(before, pieces, after, file)))
        words = [p.lower() for p in pieces if len(p) > 1]
        before = (before + words)[-2:] if words else before
    return out


@dataclass
class Field:
    """A conditional random field: weights of features by tag, and of tags by the tag before."""

    names: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray

    def scores(self, chain: Chain) -> np.ndarray:
        return np.array([self.weights[[self.names[f] for f in fs if f in self.names]].sum(axis=0) for fs in chain.features])

    def decode(self, chain: Chain) -> list[tuple[int, int, float]]:
        """(first piece, last piece, chance) of the secrets on the best path."""
        scores = self.scores(chain)
        n = len(scores)
        best, back = scores[0] + self.steps[OUTSIDE], np.zeros((n, 3), int)
        for i in range(1, n):
            ways = best[:, None] + self.steps
            back[i] = ways.argmax(axis=0)
            best = ways.max(axis=0) + scores[i]
        tag = int((best + self.steps[:, OUTSIDE]).argmax())
        tags = [tag]
        for i in range(n - 1, 0, -1):
            tag = int(back[i, tag])
            tags.append(tag)
        tags.reverse()
        if not any(tags):
            return []
        chance = forward_backward(scores[None], self.steps)[0][0]
        out, i = [], 0
        while i < n:
            if tags[i] == BEGIN:
                j = i
                while j + 1 < n and tags[j + 1] == INSIDE:
                    j += 1
                out.append((i, j, float(chance[i, BEGIN])))
                i = j
            i += 1
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward_backward(scores: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of tags, and summed chances of steps, for chains of one length: scores[chain, piece, tag].

    What lies before and after a chain is outside.
    """
    m, n, _ = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + steps[OUTSIDE]
    for i in range(1, n):
        ahead[:, i] = scores[:, i] + _log_sum(ahead[:, i - 1, :, None] + steps, 1)
    behind[:, n - 1] = steps[:, OUTSIDE]
    for i in range(n - 2, -1, -1):
        behind[:, i] = _log_sum(steps + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
    total = _log_sum(ahead[:, n - 1] + steps[:, OUTSIDE], 1)
    chance = np.exp(ahead + behind - total[:, None, None])
    moves = np.zeros((3, 3))
    moves[OUTSIDE] += chance[:, 0].sum(axis=0)
    moves[:, OUTSIDE] += chance[:, n - 1].sum(axis=0)
    for i in range(1, n):
        each = ahead[:, i - 1, :, None] + steps + (scores[:, i] + behind[:, i])[:, None, :] - total[:, None, None]
        moves += np.exp(each).sum(axis=0)
    return chance, moves


def train(examples: list[tuple[Chain, list[int]]]) -> Field:
    """The field that makes these tags likely, with penalised weights."""
    support = Counter(f for chain, _ in examples for fs in chain.features for f in set(fs))
    names = {f: i for i, f in enumerate(sorted(f for f, k in support.items() if k >= LEAST_SUPPORT))}
    weights, steps = np.zeros((len(names), 3)), np.zeros((3, 3))
    steps[OUTSIDE, INSIDE] = -20.0  # a secret begins before it goes on
    field = Field(names, weights, steps)
    if not examples:
        return field
    grouped = []
    by_size: dict[int, list] = {}
    for chain, tags in examples:
        by_size.setdefault(len(tags), []).append((chain, tags))
    for size, group in sorted(by_size.items()):
        rows, columns = [], []
        for k, (chain, _) in enumerate(group):
            for i, fs in enumerate(chain.features):
                own = [names[f] for f in set(fs) if f in names]
                rows += [k * size + i] * len(own)
                columns += own
        grouped.append((size, np.array(rows, int), np.array(columns, int), np.array([t for _, t in group])))
    pieces = sum(len(t) for _, t in examples)
    seen_w, seen_s = np.full_like(weights, 1e-8), np.full_like(steps, 1e-8)
    for _ in range(EPOCHS):
        to_w, to_s = -RIDGE * weights, -RIDGE * steps
        for size, rows, columns, tags in grouped:
            scores = np.zeros((tags.size, 3))
            np.add.at(scores, rows, weights[columns])
            chance, moves = forward_backward(scores.reshape(len(tags), size, 3), steps)
            wrong = np.eye(3)[tags.ravel()] - chance.reshape(-1, 3)
            np.add.at(to_w, columns, wrong[rows])
            framed = np.pad(tags, ((0, 0), (1, 1)))
            held = np.zeros((3, 3))
            np.add.at(held, (framed[:, :-1].ravel(), framed[:, 1:].ravel()), 1)
            to_s += held - moves
        to_w, to_s = to_w / pieces, to_s / pieces
        seen_w += to_w**2
        seen_s += to_s**2
        weights += STEP * to_w / np.sqrt(seen_w)
        steps += STEP * to_s / np.sqrt(seen_s)
        steps[OUTSIDE, INSIDE] = -20.0
    return field


def tagged(text: str) -> list[tuple[Chain, list[int]]]:
    """Chains of a text with the tags that the base patterns' values give."""
    return with_tags(text, sorted({(a, b) for _, _, _, a, b in base_spans(text)}))


def with_tags(text: str, values: list[tuple[int, int]]) -> list[tuple[Chain, list[int]]]:
    """Chains of a text, tagged by where its secrets lie (in order of their starts)."""
    out, k = [], 0
    for chain in chains(text):
        tags, within = [], None
        for start, end in chain.spans:
            while k < len(values) and values[k][1] <= start:
                k += 1
            at = values[k] if k < len(values) and values[k][0] < end else None
            tags.append(OUTSIDE if at is None else INSIDE if at == within else BEGIN)
            within = at
        out.append((chain, tags))
    return out


def _drawn(rng: random.Random, words: list[str]) -> tuple[str, int, int]:
    """Words of the corpus around a value drawn from some alphabet, and where the value lies."""
    alphabet, prefix = rng.choice(ALPHABETS), rng.choice(PREFIXES)
    value = "".join(rng.choice(alphabet) for _ in range(rng.choice((20, 24, 28, 32, 36, 40, 44, 64))))
    glued = prefix if prefix.endswith(("_", "-")) else ""
    head = " ".join([*rng.choices(words, k=4), prefix])
    closing = prefix[-1] if prefix[-1:] in ("'", '"') else ")" if prefix == "(" else rng.choice(("", "", ",", ".", ";"))
    start = len(head) - len(glued)
    return f"{head}{value}{closing} {' '.join(rng.choices(words, k=2))}", start, len(head) + len(value)


def _harmless(rng: random.Random, words: list[str]) -> str:
    """Words of the corpus around a harmless long piece."""
    plain = [w for w in (re.sub(r"\W|\d|_", "", x) for x in rng.choices(words, k=12)) if w] or ["name"]
    made = {"0": lambda: rng.choice("0123456789"), "x": lambda: rng.choice("0123456789abcdef"), "w": lambda: rng.choice(plain).lower()[:10], "W": lambda: rng.choice(plain).capitalize()[:10]}
    form = rng.choice(HARMLESS)
    piece = "".join(made[c]() if c in made else c for c in form)
    return f"{' '.join(rng.choices(words, k=4))} {rng.choice(('', '', 'id ', 'id=', 'ref: ', 'version ', 'see ', 'url=', 'commit ', chr(34)))}{piece} {' '.join(rng.choices(words, k=2))}"


def examples_of(sampled: list[tuple[Chain, list[int]]], words: list[str]) -> list[tuple[Chain, list[int]]]:
    """The training examples: sampled chains, the same with their places masked, and drawn values in the corpus's words."""
    rng = random.Random(_SEED)
    out = list(sampled)
    masked = lambda chain: Chain(chain.spans, [[f for f in fs if not f.startswith(_PLACE)] for fs in chain.features])
    out += [(masked(chain), tags) for chain, tags in sampled]
    for _ in range(DRAWN if words else 0):
        text, start, end = _drawn(rng, words)
        found = with_tags(text, [(start, end)])
        found += [(chain, [OUTSIDE] * len(chain.spans)) for chain in chains(_harmless(rng, words))]
        out += [(masked(chain) if rng.random() < 0.5 else chain, tags) for chain, tags in found]
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: int = SAMPLE_TEXTS) -> Field:
    """A field trained on at most `texts` texts with base matches and as many without.

    First the hashes of rows are chosen, then the texts themselves are looked up where they lie.
    """
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("row"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pc.match_substring_regex(batch.column("text"), _MAY_HAVE_BASE)], ["row", "has"])

    marked = cut_lineage(rows.mapInArrow(mark, "row long, has boolean"))
    chosen = [r.row for has in (True, False) for r in marked.where(F.col("has") == has).select("row").distinct().orderBy("row").limit(texts).collect()]
    schema = "place long, has boolean, features array<array<string>>, tags array<int>, words array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            found = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text[:2000].split()[:24]
                found.append((row, None, [], [], [w for w in words if 2 <= len(w) <= 20 and not is_candidate(w)][:12]))
                for k, (chain, tags) in enumerate(tagged(text)):
                    for at in range(0, len(tags), CHAIN_PIECES):
                        found.append((hash((row, k, at)), any(tags[at : at + CHAIN_PIECES]), chain.features[at : at + CHAIN_PIECES], tags[at : at + CHAIN_PIECES], []))
            columns = list(zip(*found, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.bool_(), pa.list_(pa.list_(pa.string())), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["place", "has", "features", "tags", "words"])

    found = cut_lineage(rows.join(F.broadcast(docs.sparkSession.createDataFrame([(r,) for r in chosen], "row long")), "row").mapInArrow(run, schema))
    sampled = [r for has in (True, False) for r in found.where(F.col("has") == has).orderBy("place").limit(SAMPLE_CHAINS).collect()]
    words = [w for r in found.where("has is null").select("place", "words").orderBy("place").limit(2 * texts).collect() for w in r.words]
    return train(examples_of([(Chain([], r.features), list(r.tags)) for r in sampled], words))


def find(text: str, field: Field, may_have_base: bool, may_have_chain: bool) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in a text, by start and kind. Added spans don't overlap base ones."""
    found = base_spans(text) if may_have_base else []
    out = [(kind, start, end) for start, end, kind, _, _ in found]
    if may_have_chain:
        # base spans by start, with the furthest end so far: one of them overlaps if the last that starts before ends after
        starts = [s for s, *_ in found]
        ends = np.maximum.accumulate([e for _, e, *_ in found]) if found else []
        for chain in chains(text):
            for first, last, chance in field.decode(chain):
                start, end = chain.spans[first][0], chain.spans[last][1]
                k = bisect_right(starts, end - 1)
                if end - start >= LEAST_ADDED and chance >= LEAST_CHANCE and not (k and ends[k - 1] > start):
                    out.append(("field", start, end))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, secrets) for each row: secrets holds kind, start, end and text, in order; places count code points.

    A null text is empty and has none. Null ids and repeated rows come back as they are. Other columns are ignored;
    an empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            texts = batch.column("text")
            base = pc.match_substring_regex(texts, _MAY_HAVE_BASE).to_numpy(zero_copy_only=False)
            words = Words(texts)
            # A-Z are in lower case in these words, so capitals are looked for in whole texts
            long = pc.match_substring_regex(words.distinct, _LONG)
            digits = pc.match_substring_regex(words.distinct, "[0-9]")
            capitals = pc.match_substring_regex(texts, r"[A-Za-z0-9+/_\-]{15,}").to_numpy(zero_copy_only=False) & pc.match_substring_regex(texts, r"[a-z0-9+/_\-][A-Z][A-Za-z0-9+/_\-]*[a-z]|[a-z][A-Za-z0-9+/_\-]*[A-Z]").to_numpy(zero_copy_only=False)
            of_word = pc.and_(long, digits).to_numpy(zero_copy_only=False)
            hits = np.flatnonzero(of_word[words.codes]) if len(of_word) else np.empty(0, int)
            chained = capitals.copy()
            chained[np.searchsorted(words.starts, hits, "right") - 1] = True
            out = []
            for text, b, c in zip(texts.to_pylist(), base, chained, strict=True):
                spans = find(text, field, bool(b), bool(c)) if b or c else []
                out.append([{"kind": k, "start": s, "end": e, "text": text[s:e]} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind)], ["id", "secrets"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, secrets array<struct<kind: string, start: bigint, end: bigint, text: string>>")
