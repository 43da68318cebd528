"""Embedding near-duplicates by spherical-cap filters.

Filters are directions from a structured random product code: a rotated vector's two halves each have a code book of
random unit vectors, and a pair of code words is a filter. A vector meets all filters whose inner product with it
exceeds its threshold, which is set so that FILTERS_MET exceed it (with one threshold for all vectors, some regions meet
no filter: half of the links of a test table were lost). They are list-decoded: the k best sums of two halves lie among
the k best of either half. Vectors which share a filter are candidates; a sketch of signs sorts out distant ones before
vectors are moved, and the cosine in double precision decides. The number of filters follows from the number of vectors.

Of 3,000 random pairs at cosine 0.9 exactly, 99.9 in 100 share a filter of one code among 50,000 vectors, and 98.7 among
a million. Several codes with rotations of their own, each with all these filters, leave less: their number grows with
the vectors, so that by these figures about one pair in a million at cosine 0.9 exactly shares none, and closer pairs less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from attestry.llm.base import cut_lineage
from attestry.llm.graph import components

LEAST_COSINE = 0.9
#: Random vectors beyond the threshold that the number of filters is planned for, and filters that a pair at the least
#: cosine would share at it on average.
FILTER_LOAD = 16
EXPECTED_SHARED = 9.0
FILTERS_MET = 32
#: Hamming distance of 64 sign bits; at cosine 0.9 they differ in 9.2 bits on average, 22 is 4.6 deviations more.
SKETCH_RADIUS = 22
#: Vectors of one filter that are compared with each other in one step; a fuller filter is dealt out in such chunks.
CHUNK = 1024
_SEED = 20240229


def _upper(t: float) -> float:
    """Chance of a standard normal above t."""
    return math.erfc(t / math.sqrt(2)) / 2


def _both(t: float, cosine: float) -> float:
    """Chance that two standard normals with this correlation both exceed t."""
    x = np.linspace(t, t + 8, 4001)
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    other = np.array([_upper((t - cosine * v) / math.sqrt(1 - cosine * cosine)) for v in x])
    return float(np.trapezoid(density * other, x))


def code_words(vectors: int, cosine: float) -> int:
    """The words of each half's code book for so many vectors; a filter is a pair of words."""
    low, high = 1.0, 6.0
    for _ in range(60):
        t = (low + high) / 2
        low, high = (t, high) if vectors * _upper(t) > FILTER_LOAD else (low, t)
    return max(8, math.ceil(math.sqrt(EXPECTED_SHARED / _both(t, cosine))))


def codes_for(vectors: int) -> int:
    """How many codes so many vectors need."""
    return 2 + (vectors > 50_000) + (vectors > 2_000_000) + (vectors > 100_000_000)


class Filters:
    """The filters of one code for vectors of one length."""

    def __init__(self, dims: int, words: int, code: int = 0):
        rng = np.random.default_rng([_SEED, dims, code])
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        self.half, self.words = max(1, dims // 2), words
        self.books = []
        for width in (self.half, dims - self.half):
            book = rng.standard_normal((words, width)) if width else np.zeros((words, 0))
            self.books.append(book / np.maximum(np.linalg.norm(book, axis=1, keepdims=True), 1e-300))
        self.planes = rng.standard_normal((dims, 64))

    def keys(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors: the numbers of the filters each meets, in order, and the sketches of signs."""
        turned, k = unit @ self.rotation, min(FILTERS_MET, self.words)
        first, second = turned[:, : self.half] @ self.books[0].T, turned[:, self.half :] @ self.books[1].T
        i, j = np.argpartition(-first, k - 1, axis=1)[:, :k], np.argpartition(-second, k - 1, axis=1)[:, :k]
        sums = np.take_along_axis(first, i, 1)[:, :, None] + np.take_along_axis(second, j, 1)[:, None, :]
        best = np.argpartition(-sums.reshape(len(unit), -1), k - 1, axis=1)[:, :k]
        met = np.take_along_axis(i, best // k, 1) * self.words + np.take_along_axis(j, best % k, 1)
        return np.sort(met, axis=1), np.packbits(unit @ self.planes > 0, axis=1, bitorder="little").view(np.int64).ravel()


def _unit(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors in double precision, by length of vector."""
    offsets = lists.offsets.to_numpy()
    flat, sizes = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(offsets)
    out = []
    for dims in np.unique(sizes):
        rows = np.flatnonzero(sizes == dims)
        x = flat[offsets[rows, None] + np.arange(dims)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((rows, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def _met(classes: DataFrame, words: int, codes: int) -> DataFrame:
    """(rep, dims, sketch, filters) of classes(rep, vector); filters are ints as long as their numbers are."""
    wide = codes * words * words >= 1 << 31

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list[Filters]] = {}
        for batch in batches:
            rep, lists = batch.column("rep").to_numpy(zero_copy_only=False), batch.column("vector")
            for rows, unit in _unit(lists):
                dims = unit.shape[1]
                if dims not in made:
                    made[dims] = [Filters(dims, words, code) for code in range(codes)]
                for at in range(0, len(rows), 2048):
                    each = [f.keys(unit[at : at + 2048]) for f in made[dims]]
                    keys = np.concatenate([own + code * words * words for code, (own, _) in enumerate(each)], axis=1)
                    sketch = each[0][1]
                    part = rows[at : at + 2048]
                    yield pa.RecordBatch.from_arrays([pa.array(rep[part]), pa.array([dims] * len(part), pa.int32()), pa.array(sketch), pa.array(list(keys), pa.list_(pa.int64() if wide else pa.int32()))], ["rep", "dims", "sketch", "filters"])

    return classes.select("rep", "vector").mapInArrow(run, f"rep long, dims int, sketch long, filters array<{'long' if wide else 'int'}>")


def _verify(rows: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, root) from rows(key, low, high, chunk, rep, n, vector, filters), sorted by (key, low, high).

    filters are those before the row's own, in order.
    links is the weight of a vector's links that are counted here: a pair counts in its smallest common filter only.
    root is a vector that rep is connected with by links found here.
    """

    def block(chunk: np.ndarray, low: int, high: int, rep: np.ndarray, n: np.ndarray, x: np.ndarray, filters: list) -> tuple:
        close = x @ x.T >= cosine
        np.fill_diagonal(close, False)
        if low != high:  # pairs within a chunk are another step's
            close &= chunk[:, None] != chunk[None, :]
        i, j = np.nonzero(np.triu(close))
        counts = np.zeros(len(rep), np.int64)
        if len(i):
            width = max(map(len, filters))
            before = np.full((len(rep), width), -1, np.int64)
            for k, f in enumerate(filters):
                before[k, : len(f)] = f
            shared = np.zeros(len(i), bool)
            for at in range(0, len(i), 4096):
                a, b = before[i[at : at + 4096]], before[j[at : at + 4096]]
                for c in range(width):
                    column = a[:, c : c + 1]
                    shared[at : at + 4096] |= ((column == b) & (column >= 0)).any(axis=1)
            np.add.at(counts, i[~shared], n[j[~shared]])
            np.add.at(counts, j[~shared], n[i[~shared]])
        label, linked = np.arange(len(rep)), close.any(axis=1)
        while True:
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            new = new[new]
            if (new == label).all():
                break
            label = new
        return rep[linked], counts[linked], rep[label][linked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "links", "root"]

        def steps(table: pa.Table) -> Iterator[pa.RecordBatch]:
            group = np.stack([table.column(c).to_numpy() for c in ("key", "low", "high")], axis=1)
            starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
            chunk, rep, n = (table.column(c).to_numpy() for c in ("chunk", "rep", "n"))
            vectors = table.column("vector").combine_chunks()
            unit: list = [None] * len(rep)
            for rows, x in _unit(vectors):
                for r, v in zip(rows, x, strict=True):
                    unit[r] = v
            lists = table.column("filters").combine_chunks()
            values, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            found: list = [[], [], []]
            for a, b in zip(starts, np.r_[starts[1:], len(rep)], strict=True):
                if b - a > 1:
                    filters = [values[edges[k] : edges[k + 1]] for k in range(a, b)]
                    _, low, high = group[a]
                    for column, part in zip(found, block(chunk[a:b], low, high, rep[a:b], n[a:b], np.array(unit[a:b]), filters), strict=True):
                        column.append(part)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in found], names)

        held: pa.Table | None = None
        for batch in batches:
            table = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            last = [table.column(c)[-1].as_py() for c in ("key", "low", "high")]
            same = np.all([table.column(c).to_numpy() == v for c, v in zip(("key", "low", "high"), last, strict=True)], axis=0)
            cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                yield from steps(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from steps(held)

    return rows.mapInArrow(run, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = LEAST_COSINE) -> DataFrame:
    """(id, n_links, component, kept) for each row.

    n_links counts the other rows linked directly, component is the smallest id reachable by links, and kept says
    whether that is the row's own. A vector that is null, empty or zero, or has null or non-finite components, links
    with nothing, nor does a row with a null id (its component is null, and it isn't kept). Vectors of different
    lengths never link. Equal vectors are one class whose links are counted by its size; repeated rows count each.
    Other columns are ignored, and an empty table gives an empty result.
    """
    wide = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    marked = wide.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = marked.where("usable").select("id", "vector")
    classes = cut_lineage(good.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    count = classes.count()
    met = cut_lineage(_met(classes, code_words(max(2, count), cosine), codes_for(count)))
    # vectors of another length have filters of their own
    keys = met.select("rep", "sketch", F.explode("filters").alias("filter"), "dims").withColumn("key", F.shiftleft(F.col("dims").cast("long"), 48).bitwiseOR(F.col("filter"))).select("rep", "sketch", "key")
    other = keys.select(F.col("rep").alias("rep2"), F.col("sketch").alias("sketch2"), F.col("key").alias("key2"))
    near = (F.col("key") == F.col("key2")) & (F.col("rep") != F.col("rep2")) & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("sketch2"))) <= SKETCH_RADIUS)
    candidates = cut_lineage(keys.join(other, near, "left_semi").select("rep", "key"))
    full = candidates.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = candidates.join(full, "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    steps = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = steps.select("key", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), "chunk", "rep")
    # a vector goes to each of its filters, so in the type it came in, and with the filters before that one only
    given = vectors.schema[vector_col].dataType
    slim = F.col("vector").cast("array<float>") if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else F.col("vector")
    own = classes.join(met.select("rep", "filters"), "rep").select("rep", "n", slim.alias("vector"), "filters")
    before = F.filter("filters", lambda f: f < F.col("key").bitwiseAND(F.lit((1 << 48) - 1)))
    rows = placed.join(own, "rep").select("key", "low", "high", "chunk", "rep", "n", "vector", before.alias("filters"))
    sorted_ = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = cut_lineage(_verify(sorted_, cosine))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "rep", "left").join(groups, classes.rep == groups.node, "left")
    result = named.select("vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = good.join(result, "vector").select("id", "n_links", "component", (F.col("id") == F.col("component")).alias("kept"))
    alone = marked.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.col("id").isNotNull().alias("kept"))
    return linked.unionByName(alone)
