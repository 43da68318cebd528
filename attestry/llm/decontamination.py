"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A passage whose five-word shingles are 0.8 similar to an item's shares shingles with it, so windows are laid
only where a document has an item's shingle: each such place says where an item of that length would begin.
A window's SimHash over its words is cut into four blocks of 16 bits. Fingerprints within RADIUS bits lie within NEAR bits
in one of them, so an item is entered under all values within NEAR bits of its blocks, a window is looked up under its own,
and no fingerprint within the radius is missed. Pairs within it are verified by the weighted Jaccard similarity of
their shingles, each weighted by how often it occurs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.base import Words, chunked, cut_lineage, mix, unused

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Largest Hamming distance between the SimHashes of a window and an item. The farthest windows at similarity 0.8 have a
#: tenth of their words replaced at an end, which moves 9 bits on average; this is more than three deviations beyond.
RADIUS = 19
BLOCKS = 4
NEAR = RADIUS // BLOCKS
#: Item shingles that one pass over the documents carries to the workers (16 bytes each); more items take more passes.
PASS_SHINGLES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 24

def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` word hashes."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        out = out * _BASE + hashes[i : i + len(out)]
    return mix(out + np.uint64(size))


def _simhash(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64)[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets: their common weight by their joint weight."""
    if not len(a) and not len(b):
        return 1.0
    values, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


_ITEM = "item long, n_words int, fp long, shingles array<long>"


def item_features(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fingerprint and shingles of each item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            words = Words(batch.column("text"), fold=True)
            hashes, ids = mix(words.hashes()[words.codes]) if len(words.codes) else np.empty(0, np.uint64), batch.column("item").to_pylist()
            rows = []
            for item, a, b in zip(ids, words.starts[:-1], words.starts[1:], strict=True):
                if b > a:
                    own = hashes[a:b]
                    rows.append((item, int(b - a), _simhash(own), _runs(own, min(SHINGLE_WORDS, len(own))).view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["item", "n_words", "fp", "shingles"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _ITEM)


class Places:
    """Where the shingles of some items stand: which (item length, offset) a shingle begins at."""

    def __init__(self, items: list):
        found: dict[int, set[tuple[int, int]]] = defaultdict(set)
        self.sizes = set()
        for row in items:
            self.sizes.add(min(SHINGLE_WORDS, row.n_words))
            for offset, shingle in enumerate(row.shingles):
                found[shingle].add((row.n_words, offset))
        signed = sorted(found)
        order = np.argsort(np.array(signed, np.int64).view(np.uint64), kind="stable")
        self.shingles = np.array(signed, np.int64).view(np.uint64)[order]
        self.at = [sorted(found[signed[i]]) for i in order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.shingles >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in runs of known shingles, and which shingle each is."""
        may = np.flatnonzero(self.filter[runs >> np.uint64(64 - _FILTER_BITS)])
        at = np.searchsorted(self.shingles, runs[may])
        at[at == len(self.shingles)] = 0
        same = self.shingles[at] == runs[may]
        return may[same], at[same]


_WINDOW = "id long, text_key long, start long, size int, n_words int, fp long, shingles array<long>"


def _windows(docs: DataFrame, places) -> DataFrame:
    """Item-sized windows of the documents wherever an item could begin. places: a broadcast of Places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Places = places.value
        for batch in chunked(batches, "text"):
            words = Words(batch.column("text"), fold=True)
            if not len(words.codes):
                continue
            hashes = mix(words.hashes()[words.codes])
            wanted = set()
            for size in known.sizes:
                runs = _runs(hashes, size)
                at, which = known.hits(runs)
                row = np.searchsorted(words.starts, at, "right") - 1
                inside = at + size <= words.starts[row + 1]
                for p, w, r in zip(at[inside].tolist(), which[inside].tolist(), row[inside].tolist(), strict=True):
                    first, last = int(words.starts[r]), int(words.starts[r + 1])
                    for length, offset in known.at[w]:
                        if min(SHINGLE_WORDS, length) == size:
                            taken = min(length, last - first)
                            wanted.add((r, min(max(p - offset, first), last - taken), taken, length))
            ids, keys, rows = batch.column("id").to_pylist(), batch.column("text_key").to_pylist(), []
            for r, start, taken, length in sorted(wanted):
                own = hashes[start : start + taken]
                rows.append((ids[r], keys[r], start - int(words.starts[r]), taken, length, _simhash(own), _runs(own, min(SHINGLE_WORDS, taken)).view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            names = ["id", "text_key", "start", "size", "n_words", "fp", "shingles"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return docs.mapInArrow(run, _WINDOW)


def _block(fp, k: int):
    return F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int")


def _blocks(df: DataFrame) -> DataFrame:
    """df, once for each block of its fingerprint."""
    return df.select("*", F.posexplode(F.array(*(_block(F.col("fp"), k) for k in range(BLOCKS)))).alias("block", "bits"))


def _entered(items: DataFrame) -> DataFrame:
    """(item, n_words, item_fp, block, bits): items under all values within NEAR bits of each of their blocks."""
    masks = F.expr(f"filter(sequence(0, 65535), m -> bit_count(m) <= {NEAR})")
    each = _blocks(items.select("item", "n_words", "fp")).withColumn("mask", F.explode(masks))
    return each.select("item", "n_words", F.col("fp").alias("item_fp"), "block", F.col("bits").bitwiseXOR(F.col("mask")).alias("bits"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = SIMILARITY,
) -> DataFrame:
    """(id, text_key, item, start, size, similarity): for each text and item in it the most similar window.

    Words are compared in lower case and without punctuation at their ends, and start and size count them; ties go to the first and shortest window; text_key is the text's XXH64, which
    tells rows of one id apart. Null and empty texts and items match nothing; rows repeated entirely count once;
    an item with fewer than five words is one shingle. Other columns are ignored; empty tables give no rows.
    """
    items = cut_lineage(item_features(benchmark, item_col, item_text_col))
    total = items.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    passes = max(1, -(-total // PASS_SHINGLES))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    windows = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).select("n_words", "shingles").collect()
        if part:
            found = _windows(rows, docs.sparkSession.sparkContext.broadcast(Places(part)))
            windows = found if windows is None else windows.unionByName(found)
    if windows is None:
        return docs.sparkSession.createDataFrame([], "id long, text_key long, item long, start long, size int, similarity double")
    windows = cut_lineage(windows.withColumn("window", F.monotonically_increasing_id()))
    looked = _blocks(windows.select("window", "n_words", "fp"))
    near = looked.join(_entered(items).hint("merge"), ["n_words", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = windows.drop("n_words", "fp").join(near.select("window", "item").distinct(), "window")
    texts = items.select("item", F.col("shingles").alias("item_shingles"))
    near = near.join(F.broadcast(texts) if total <= PASS_SHINGLES else texts, "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("shingles"), batch.column("item_shingles"), strict=True)
            found = [similarity(a.values.to_numpy(), b.values.to_numpy()) for a, b in both]
            columns = [batch.column(n) for n in ("id", "text_key", "item", "start", "size")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], ["id", "text_key", "item", "start", "size", "similarity"])

    schema = "id long, text_key long, item long, start long, size int, similarity double"
    verified = near.select("id", "text_key", "item", "start", "size", "shingles", "item_shingles").mapInArrow(verify, schema)
    best = verified.where(F.col("similarity") >= least).groupBy("id", "text_key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("size")).alias("n"))).alias("best"))
    return best.select("id", "text_key", "item", (-F.col("best.s")).alias("start"), (-F.col("best.n")).alias("size"), F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs without a benchmark passage, with the columns of docs (of any names). Null ids count as one id.

    Rows with null or empty texts stay; rows repeated entirely stay or go alike; without items all rows stay.
    """
    found = contaminated(docs, benchmark, id_col, text_col, item_col, item_text_col)
    names = [unused(docs, n) for n in ("bad_id", "bad_key", "text_hash")]
    bad = found.select("id", "text_key").distinct().toDF(*names[:2])
    marked = docs.withColumn(names[2], F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return marked.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(names[0])) & (F.col(names[2]) == F.col(names[1])), "left_anti").drop(names[2])
