"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are cut into shards within their partitions, so no posting is shuffled. A shard has for each term of the queries
a list of its documents by falling impact (what the term adds to a document's score, by the statistics of all documents).
A query reads its lists side by side; each document met is looked up in all its lists at once, which gives its score
and marks its position in each of them. A list's best position is the end of its run of seen positions from the top: no
unseen document can add more than the impact there. When the sum of these impacts is strictly below the k-th score, no
unseen document can reach or tie it, and the query stops. A task takes the best scores of its earlier shards along, so
later shards stop sooner, and sends k rows a query at most.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.base import Words, chunked, translated

#: Bytes that part terms become spaces; A-Z become lower case; all others, and so all of other letters, belong to terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Documents of a shard, and what a shard's documents times a query's terms may be (larger queries get smaller shards).
SHARD_DOCS, SHARD_CELLS = 4096, 1 << 22
#: Queries are taken in blocks of so many terms; each block is a pass over the documents.
BLOCK_TERMS = 200_000
#: Positions read in each list at first; twice as many each time.
FIRST_READ = 16


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _frequencies(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of terms; the sorted keys (term's place in terms) * texts + text of those met, and how often each is."""
    words = Words(translated(texts, _TABLE), as_is=True)
    place = pc.fill_null(pc.index_in(words.distinct, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    met = place[words.codes]
    keys, times = np.unique((met * len(texts) + words.rows())[met >= 0], return_counts=True)
    return np.diff(words.starts), keys, times.astype(np.int64)


def _statistics(docs: DataFrame, terms: pa.Array) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms of all documents, and how many documents each of terms is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, documents, tokens = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for part in chunked([batch], "text"):
                sizes, keys, _ = _frequencies(part.column("text"), terms)
                found += np.bincount(keys // part.num_rows, minlength=len(terms))
                documents, tokens = documents + int((sizes > 0).sum()), tokens + int(sizes.sum())
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, (-1, -2))), pa.array(np.append(found[at], (documents, tokens)))], ["term", "n"])

    summed = dict(docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    frequency = np.zeros(len(terms), np.int64)
    for term, n in summed.items():
        if term >= 0:
            frequency[term] = n
    return summed.get(-1, 0), summed.get(-2, 0), frequency


class Shard:
    """Impact lists of some documents: of term t, docs[starts[t]:starts[t + 1]] by falling impact, ties by place."""

    def __init__(self, texts: pa.Array, terms: pa.Array, documents: int, tokens: int):
        sizes, keys, times = _frequencies(texts, terms)
        self.size = len(texts)
        term, doc = np.divmod(keys, self.size)
        share = 100 - 75 + (75 * sizes * documents) // tokens if tokens else np.full(self.size, 25)
        impact = (1_000_000_000 * times) // (1000 * times + 8 * share[doc])
        order = np.lexsort((doc, -impact, term))
        self.docs, self.impacts = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(terms) + 1))


def best_positions(shard: Shard, terms: np.ndarray, weights: np.ndarray, k: int, scores: np.ndarray, read: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the shard (by place) and their scores: all that can be among the k best, given scores found elsewhere.

    weights are of the terms, repeats included. scores are the k best of other shards, falling. To read, if given, the
    number of documents looked up is appended.
    """
    begin, length = shard.starts[terms], shard.starts[terms + 1] - shard.starts[terms]
    terms, weights, begin, length = terms[length > 0], weights[length > 0], begin[length > 0], length[length > 0]
    longest = int(length.max(initial=0))
    position = np.full((len(terms), shard.size), longest, np.int32)  # the column `longest` takes marks of documents not in a list
    impact, lists = np.zeros((len(terms), shard.size), np.int64), np.zeros((len(terms), longest + 1), np.int64)
    for t, (b, n) in enumerate(zip(begin, length, strict=True)):
        docs = shard.docs[b : b + n]
        position[t, docs] = np.arange(n)
        lists[t, :n] = shard.impacts[b : b + n] * weights[t]
        impact[t, docs] = lists[t, :n]
    seen, marked = np.zeros(shard.size, bool), np.zeros((len(terms), longest + 1), bool)
    rows, best = np.arange(len(terms)), np.asarray(scores)
    found, values, depth, step = [], [], 0, FIRST_READ
    while depth < longest:
        for t in np.flatnonzero(length > depth):
            seen[shard.docs[begin[t] + depth : begin[t] + min(depth + step, length[t])]] = True
        depth, step = depth + step, step * 2
        met = np.flatnonzero(seen) if not found else np.flatnonzero(seen & ~known)
        known = seen.copy()
        marked[rows[:, None], position[:, met]] = True
        marked[:, longest] = False
        score = impact[:, met].sum(axis=0)
        found.append(met)
        values.append(score)
        best = -np.sort(-np.concatenate((best, score[score > 0])))[:k]
        run = np.argmin(marked, axis=1)  # positions seen from the top on
        bound = np.where(run < length, lists[rows, np.maximum(run - 1, 0)], 0).sum()
        if len(best) == k and bound < best[-1]:
            break
    if read is not None:
        read.append(int(seen.sum()))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, values = np.concatenate(found), np.concatenate(values)
    good = (values > 0) & (values >= (best[-1] if len(best) == k else 1))
    return found[good], values[good]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """The queries' ids and terms, in blocks."""
    block, size = [], 0
    for item, text in items.toLocalIterator():
        found = Counter(terms_of(text))
        if found:
            block.append((item, found))
            size += len(found)
        if size >= BLOCK_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _block(docs: DataFrame, block: list[tuple[int | None, Counter]], first: int, k: int) -> DataFrame:
    names = sorted({term for _, found in block for term in found})
    terms, place = pa.array([n.decode() for n in names], pa.string()), {n: i for i, n in enumerate(names)}
    documents, tokens, frequency = _statistics(docs, terms)
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)
    queries = []
    for item, found in block:
        at = np.array([place[t] for t in found])
        queries.append((item, at, weight[at] * np.array(list(found.values()))))
    largest = max(len(at) for _, at, _ in queries)
    most = max(64, min(SHARD_DOCS, SHARD_CELLS // largest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = [empty] * len(queries)
        for part in chunked(batches, "text"):
            for start in range(0, part.num_rows, most):
                piece = part.slice(start, most)
                shard = Shard(piece.column("text"), terms, documents, tokens)
                none = pc.is_null(piece.column("id")).to_numpy(zero_copy_only=False)
                ids = pc.fill_null(piece.column("id"), 0).to_numpy(zero_copy_only=False)
                for q, (_, at, weights) in enumerate(queries):
                    own, own_none, scores = best[q]
                    place, score = best_positions(shard, at, weights, k, scores)
                    if len(place):
                        own, own_none, scores = np.append(own, ids[place]), np.append(own_none, none[place]), np.append(scores, score)
                        order = np.lexsort((own, own_none, -scores))[:k]
                        best[q] = own[order], own_none[order], scores[order]
        for q, (item, _, _) in enumerate(queries):
            own, own_none, scores = best[q]
            if len(own):
                columns = [pa.array([first + q] * len(own), pa.int64()), pa.array([item] * len(own), pa.int64()), pa.array(own, pa.int64(), mask=own_none), pa.array(scores, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["query", "item", "id", "score"])

    return docs.mapInArrow(run, "query long, item long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the k documents with the highest score above 0 for each row of items, equal scores by id.

    Each row of items is a query of its own, also where ids repeat; items with no term, or none that a document has, give
    no rows. Null texts have no terms. Each row of docs is a document, so repeated rows take a rank each; null ids come
    after all others of a score. Other columns are ignored. Empty tables give an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    items = items.select(F.col(item_col).cast("long"), F.col(item_text).cast("string"))
    found, first = None, 0
    for block in _blocks(items):
        part = _block(docs, block, first, k)
        found, first = part if found is None else found.unionByName(part), first + len(block)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item long, rank int, id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item", "rank", "id", "score")
