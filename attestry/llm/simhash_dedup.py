"""SimHash near-duplicates, found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in at
most two bits, then for some segment i the two agree in segment i and differ in at most one bit in
the next segment (round robin): of (2,0,0), (1,1,0) and their rotations each has such an i. The next
segment is read as a 23-bit word of the perfect binary Golay code. Words that differ in one bit share
a codeword which is the nearest (within 3 bits) of the one and within 4 bits of the other; a word has
one or six codewords within 4 bits. Segment i and such a codeword index are therefore join keys which
miss no pair within radius 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.base import chunked, cut_lineage, join_hot, mix, unused
from attestry.llm.blocks import BROADCAST_KEYS, checked, linked_groups
from attestry.llm.graph import components

#: Generator polynomial of the binary Golay code of length 23 and distance 7 (a fixed value).
GOLAY_POLYNOMIAL = 0b101011100011
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_BIT_CHUNK = 1 << 16
#: Band keys of a set, and the minima that each is made of.
BANDS, BAND_ROWS = 16, 5


def word_shingles(text: bytes, size: int) -> list[bytes]:
    """The space-joined runs of size words; all words where there are fewer, nothing where there are none."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The XXH64 of each shingle of a text, repeats included."""
    shingles = word_shingles(text, size)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BIT_CHUNK):
        part = hashes[at : at + _BIT_CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: bytes, size: int = 3) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 have it; 0 for a text without words."""
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, text_key, fp) for each row: text_key is the text's XXH64, fp the fingerprint as a signed long.

    A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            values = np.fromiter((simhash(t, size) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(values)], ["id", "text_key", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(run, "id long, text_key long, fp long")


class Golay:
    """Codewords near a 23-bit word, by its syndrome."""

    def __init__(self) -> None:
        def remainder(word: int) -> int:
            for bit in range(22, 10, -1):
                if word >> bit & 1:
                    word ^= GOLAY_POLYNOMIAL << (bit - 11)
            return word

        units = [remainder(1 << i) for i in range(23)]
        self.high = np.zeros(1 << 12, np.int64)
        for i in range(12):
            self.high[1 << i : 2 << i] = self.high[: 1 << i] ^ units[11 + i]
        errors: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):  # light patterns first: the first of a syndrome leads to the nearest codeword
            for places in combinations(range(23), weight):
                syndrome = 0
                for i in places:
                    syndrome ^= units[i]
                errors[syndrome].append(sum(1 << i for i in places))
        self.number = np.array([len(e) for e in errors])
        self.patterns = np.array([e + [0] * (6 - len(e)) for e in errors], np.int64)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, codeword indices (12 bits) and whether each is the nearest: all within 4 bits."""
        syndromes = self.high[words >> 11] ^ (words & 0x7FF)
        number = self.number[syndromes]
        rows = np.repeat(np.arange(len(words)), number)
        turn = np.arange(len(rows)) - np.repeat(np.cumsum(number) - number, number)
        return rows, (words[rows] ^ self.patterns[syndromes[rows], turn]) >> 11, turn == 0


def golay_keys(fps: DataFrame) -> DataFrame:
    """(fp, key, nearest) for each fingerprint of fps(fp): up to 18 join keys each, see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [(fp.view(np.uint64) >> np.uint64(s)).astype(np.int64) & ((1 << n) - 1) for s, n in SEGMENTS]
            for i in range(3):
                rows, code, nearest = golay.keys(parts[(i + 1) % 3])
                key = (i << 34) | (parts[i][rows] << 12) | code
                yield pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array(key), pa.array(nearest.astype(np.int8))], ["fp", "key", "nearest"])

    return fps.select("fp").mapInArrow(run, "fp long, key long, nearest byte")


def linked(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fps(fp), which connect what links at 2 or fewer differing bits.

    Fingerprints which share a Golay key with another one are the candidates. They are verified without
    forming pairs: two lie within 2 bits exactly if some point lies within 1 bit of both, so every candidate
    goes to its 65 points, and all that meet in a point (65 at most) are linked to the smallest one there.
    """
    keys = golay_keys(fps)
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("nearest").alias("near")).where("n > 1 and near = 1")
    candidates = keys.join(shared.select("key"), "key", "left_semi").select("fp").distinct()
    points = candidates.select("fp", F.explode(F.expr("transform(sequence(0, 64), i -> if(i = 64, fp, fp ^ shiftleft(1L, i)))")).alias("point"))
    met = points.groupBy("point").agg(F.collect_set("fp").alias("all")).where("size(all) > 1")
    return met.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a <> b").distinct()


#: Factors and summands of the bands' hash functions.
_FACTORS = mix(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64)).reshape(2, BANDS, BAND_ROWS)


def _band_hashes(flat: np.ndarray, band: int, row: int) -> np.ndarray:
    return flat * (_FACTORS[0, band, row] | np.uint64(1)) + _FACTORS[1, band, row]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set of hashes, none of them empty: each mixes the minima of BAND_ROWS hash functions."""
    flat = np.concatenate(sets)
    starts, keys = np.cumsum([0] + [len(s) for s in sets[:-1]]), []
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for row in range(BAND_ROWS):
            key = mix(key ^ np.minimum.reduceat(_band_hashes(flat, band, row), starts))
        keys.append(key)
    return np.stack(keys, axis=1)


def band_parts(shingles: np.ndarray, wanted: set[int], least: float) -> list[tuple[int, np.ndarray]]:
    """(key, parts) for those band keys of a set that are wanted: its smallest shingles but for the key's own minima.

    Sets of similarity `least` have all shingles but a share of 1 - least in common, and so, beside the minima, one of
    the smallest ones; sets too small for that keep the minima.
    """
    order, keys, found = np.sort(mix(shingles)), band_keys([shingles])[0].view(np.int64), []
    spare = int((1 - least) * len(shingles) + 1e-9) + BAND_ROWS + 1
    for band in range(BANDS):
        if int(keys[band]) in wanted:
            own = mix(shingles[[int(_band_hashes(shingles, band, row).argmin()) for row in range(BAND_ROWS)]])
            first = order[:spare]
            found.append((int(keys[band]), (first[~np.isin(first, own)] if least * len(shingles) > 2 * BAND_ROWS else first).view(np.int64)))
    return found


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, text_key, cls, fp, n, keys) for each row, by the set of its text's shingles: a hash of all of it, which names
    texts of equal sets, its SimHash, its size and its band keys. The empty set has no keys. A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            sets = [np.unique(shingle_hashes(t, size)) for t in pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()]
            cls = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
            fp = np.fromiter(map(majority, sets), np.uint64, len(sets)).view(np.int64)
            n = np.array([len(s) for s in sets], np.int64)
            filled = [s for s in sets if len(s)]
            keys = band_keys(filled).view(np.int64).ravel() if filled else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
            columns = [batch.column("id"), batch.column("text_key"), pa.array(cls), pa.array(fp), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "cls", "fp", "n", "keys"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(run, "id long, text_key long, cls long, fp long, n long, keys array<long>")


def _hashed(texts: DataFrame, size: int) -> DataFrame:
    """(cls, shingles) of texts(cls, text): the distinct hashes of a text's shingles, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            own = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(own, pa.list_(pa.int64()))], ["cls", "shingles"])

    return texts.mapInArrow(run, "cls long, shingles array<long>")


def _sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, size: int) -> DataFrame:
    """(cls, shingles) of the wanted(cls); classes(cls, first) names a row of each."""
    wanted = cut_lineage(wanted.join(classes.select("cls", "first.*"), "cls"))
    wanted = checked(wanted.select("cls", F.col("id").alias("first_id"), F.col("text_key").alias("first_key")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    texts = rows.join(wanted, rows.id.eqNullSafe(wanted.first_id) & (rows.key == wanted.first_key)).select("cls", "text")
    return cut_lineage(_hashed(texts, size).dropDuplicates(["cls"]))


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, size: int, least: float) -> DataFrame:
    """Those of pairs(a, b) whose texts' shingles have a Jaccard similarity of `least`; classes(cls, first) names a row of each."""
    pairs = cut_lineage(pairs)
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), docs, id_col, text_col, classes, size)
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= F.lit(least) * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def _parts(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, size: int, least: float) -> DataFrame:
    """(line, key, part) of rows(line, key) of classes and their band keys, by band_parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, shingles, own in zip(batch.column("line").to_pylist(), batch.column("shingles"), batch.column("own").to_pylist(), strict=True):
                for key, found in band_parts(shingles.values.to_numpy().view(np.uint64), set(own), least):
                    yield pa.RecordBatch.from_arrays([pa.array([line] * len(found), pa.int64()), pa.array([key] * len(found), pa.int64()), pa.array(found)], ["line", "key", "part"])

    own = rows.groupBy("line").agg(F.collect_set("key").alias("own"))
    sets = _sets(own.select(F.col("line").alias("cls")), docs, id_col, text_col, classes, size)
    return own.join(sets.withColumnRenamed("cls", "line"), "line").mapInArrow(run, "line long, key long, part long")


def golay_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes(cls, fp) whose fingerprints differ in two bits at most, as stars."""
    hubs = cut_lineage(classes.groupBy("fp").agg(F.min("cls").alias("hub"), F.count("*").alias("n")))
    equal = join_hot(classes.select("fp", "cls"), hubs, "fp", classes.count()).where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    a, b = (hubs.select(F.col("fp").alias(x), F.col("hub").alias(f"{x}_hub")) for x in "ab")
    near = linked(hubs).join(a, "a").join(b, "b").select(F.col("a_hub").alias("a"), F.col("b_hub").alias("b"))
    both = equal.unionByName(near)
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp, component) for each row: component is the smallest id reachable by fingerprint links.

    Null texts count as empty, and all texts without words link with each other (fingerprint 0). Repeated
    rows each come back. Null ids never name a component unless nothing else is in it. Columns besides the
    two named ones are ignored; an empty table gives an empty result.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, size))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    found = cut_lineage(components(linked(classes)))
    named = classes.join(found, classes.fp == found.node).groupBy("component").agg(F.min("least").alias("name"), F.count("*").alias("n"))
    renamed = join_hot(found, named, "component", found.count()).select(F.col("node").alias("fp"), "name")
    names = classes.join(renamed, "fp", "left").select("fp", "n", F.coalesce("name", "least").alias("component"))
    return join_hot(rows, names, "fp", rows.count()).select("id", "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """One row of docs of each group of near duplicates, with its columns (of any names): that with the smallest id.

    Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 are near duplicates; texts without words are
    too. Equal sets are one. Golay keys find the sets whose SimHashes differ in two bits at most. At similarity 0.8 they
    differ in 10 of 64, which no Golay key outlives, so band keys, each of the minima of five hash functions, find the
    others: one of 16 is common to 99.8 % of pairs at 0.8, and to more above. All candidates are verified exactly.

    Null texts count as empty. Null ids come last, ties go to the smaller hash of the text, and of rows repeated entirely
    one stays. An empty table gives an empty table.
    """
    rows = cut_lineage(shingle_sets(docs, id_col, text_col, size))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    own = [F.first(c).alias(c) for c in ("fp", "n", "keys")]
    classes = cut_lineage(rows.groupBy("cls").agg(F.min(place).alias("first"), *own))
    each = classes.select(F.col("cls").alias("line"), "n", "fp", F.explode("keys").alias("key"))
    shared = checked(cut_lineage(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")), BROADCAST_KEYS)
    keyed = cut_lineage(each.join(shared, "key", "left_semi"))
    verify = lambda pairs: verified(pairs, docs, id_col, text_col, classes, size, least)
    parts = lambda dense: _parts(dense, docs, id_col, text_col, classes, size, least)
    groups = cut_lineage(linked_groups(keyed, verify, least, parts, golay_pairs(classes.where("n > 0"))))
    named = classes.join(groups, classes.cls == groups.line, "left").select(F.coalesce("grp", "cls").alias("grp"), "first")
    first = cut_lineage(named.groupBy("grp").agg(F.min("first").alias("first")))
    names = [unused(docs, n) for n in ("first_id", "first_key", "text_hash")]
    chosen = first.select(F.col("first.id"), F.col("first.text_key")).toDF(*names[:2])
    marked = docs.withColumn(names[2], F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = marked.join(chosen, F.col(id_col).cast("long").eqNullSafe(F.col(names[0])) & (F.col(names[2]) == F.col(names[1])), "left_semi").drop(names[2])
    times = rows.groupBy("id", "text_key").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    return kept if times.isEmpty() else kept.dropDuplicates([id_col, text_col])
