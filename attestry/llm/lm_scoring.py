"""Language-model scoring with a log-frequency Bloom filter.

Training texts give exact counts of tokens and a filter of token pairs. A pair that occurs c times has the level
1 + floor(2 log2 c) and is stored in the filter at each level up to its own, so its level is read by asking level
after level until one is missing; level q stands for 2 ** ((q - 1) / 2) occurrences. The filter is cut into blocks by
the pair's hash. The number of blocks follows the number of tokens and a block's size the entries counted in it, so
every pair is kept at any size. Blocks are never gathered: the pairs of the texts to score are sent to their block,
and the levels come back to the texts, packed by chunks of text. The probability of a token after another is
Dirichlet-smoothed:

    P(w | h) = (c(h, w) + STRENGTH * P(w)) / (c(h) + STRENGTH * (1 + FALSE_SHARE)),   P(w) = (c(w) + 1) / (N + V + 1)

Levels never stand for more than was counted, and the number of probes follows the number of distinct tokens V, so that
the pairs which only seem present weigh at most FALSE_SHARE * STRENGTH for any h. P(w | h) therefore sums to 1 at most.

Token counts stay exact at any size: the counts of the most frequent tokens (at most a fixed number, by a threshold of
their counts) are broadcast, and occurrences of others are joined with the table of counts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.base import Words, chunked, cut_lineage, mix, shared_folder

#: Tokens of the training texts for each block of the filter.
BLOCK_TOKENS = 500_000
#: Probes, at least. A block has two bits for each probe of each entry (pairs times levels), so at most 40 in 100 of its
#: bits are set, and each probe lets at most so many absent pairs through.
LEAST_PROBES = 4
PROBE_PASSES = 0.4
#: What all pairs after one token that only seem present may weigh, as a share of STRENGTH.
FALSE_SHARE = 0.01
#: A block has 65,536 bits at least.
LEAST_BITS = 16
STRENGTH = 100.0
#: Tokens whose counts are broadcast (16 bytes each).
HEAD_TOKENS = 1 << 18
_TEXT_BYTES = 6 << 20
_SCORE_BYTES = 6 << 20
_MAX_LEVEL = 96

#: What stands for the end of a text, and for what comes before it.
_END = mix(np.array([0x656E64], np.uint64))[0]


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes, the code of each token (an end after each text), and where each text starts."""
    words = Words(batch.column("text"))
    texts = len(words.starts) - 1
    distinct = np.append(words.hashes(), _END)
    codes = np.full(len(words.codes) + texts, len(distinct) - 1, np.int64)
    at = np.arange(len(words.codes)) + words.rows()
    codes[at] = words.codes
    return distinct, codes, words.starts + np.arange(texts + 1)


def _pairs(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of 56 bits of each token with the one before it; the end stands before a text's first token."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[starts[:-1]] = _END
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes) >> np.uint64(8)


def probes_for(distinct: int, strength: float = STRENGTH) -> int:
    """Probes with which so many distinct absent tokens weigh FALSE_SHARE of the strength at most."""
    return max(LEAST_PROBES, math.ceil(math.log(max(1.0, distinct / (FALSE_SHARE * strength))) / -math.log(PROBE_PASSES)))


def _bits(pairs: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of each pair at a level begin in a block of size bits (a power of two), and how far each steps."""
    x = mix(pairs + np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64)))
    return x & np.uint64(size - 1), mix(x) | np.uint64(1)


def level_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(2 * np.log2(count) + 1e-9).astype(np.int64)


def levels(block: np.ndarray, pairs: np.ndarray, probes: int) -> np.ndarray:
    """The level of each pair as its block (bytes) has it; 0 where it seems absent."""
    out = np.zeros(len(pairs), np.uint8)
    left, mask = np.arange(len(pairs)), np.uint64(8 * len(block) - 1)
    for level in range(1, _MAX_LEVEL):
        bits, step = _bits(pairs[left], level, 8 * len(block))
        for _ in range(probes):
            there = (block[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left, bits, step = left[there], bits[there], step[there]
            bits = (bits + step) & mask
        if not len(left):
            break
        out[left] = level
    return out


def filter_block(pairs: np.ndarray, counts: np.ndarray, probes: int) -> np.ndarray:
    """The bytes of a block that holds all of the distinct pairs."""
    level = level_of(counts)
    size = 1 << max(LEAST_BITS, int(2 * probes * level.sum() - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        at, step = _bits(pairs[level >= q], q, size)
        for _ in range(probes):
            bits[at] = 1
            at = (at + step) & np.uint64(size - 1)
    return np.packbits(bits, bitorder="little")


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) of the texts(text): token is the hash, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", _TEXT_BYTES):
            distinct, codes, _ = _tokens(batch)
            n = np.bincount(codes, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n)], ["token", "n"])

    return texts.select("text").mapInArrow(run, "token long, n long").where("n > 0").groupBy("token").agg(F.sum("n").alias("c"))


def head_threshold(counts: DataFrame) -> float:
    """The least count of a power of 2 ** (1 / 4) that at most HEAD_TOKENS of the counts(c) reach."""
    step = F.floor(4 * F.log2("c")).cast("int")
    reached, least = 0, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        reached += row.n
        if reached > HEAD_TOKENS:
            break
        least = row.step
    return 2.0 ** (least / 4) * (1 - 1e-12) if least is not None else math.inf


def _rows_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Each value of the key with its rows; the rows come in the order of the key."""
    rows = (dict(zip(batch.schema.names, row, strict=True)) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, lambda row: row[key])


def _by_block(pairs: np.ndarray, blocks: int) -> np.ndarray:
    """Where each block starts in sorted pairs, and the end. blocks is a power of two from 2."""
    return np.searchsorted(pairs >> np.uint64(57 - blocks.bit_length()), np.arange(blocks + 1, dtype=np.uint64))


def _written(pairs: np.ndarray) -> bytes:
    """Sorted pairs as the steps from one to the next, all first bytes, then all second bytes and so on, as high bytes are mostly 0."""
    return np.diff(pairs, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()


def _read(data: bytes) -> np.ndarray:
    steps = np.zeros((len(data) // 7, 8), np.uint8)
    steps[:, :7] = np.frombuffer(data, np.uint8).reshape(7, -1).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _sent(pairs: np.ndarray, counts: np.ndarray, chunk: int, blocks: int) -> pa.RecordBatch:
    """Sorted pairs of a chunk, a row for each block that has any."""
    edges = _by_block(pairs, blocks)
    own = np.flatnonzero(np.diff(edges))
    spans = [slice(edges[k], edges[k + 1]) for k in own]
    data = [_written(pairs[x]) for x in spans]
    n = [counts[x].astype(np.int32).tobytes() for x in spans]
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([chunk] * len(own), pa.int64()), pa.array(data, pa.binary()), pa.array(n, pa.binary())], ["block", "chunk", "pairs", "n"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Chunks of the batches, numbered through all tasks."""
    first = TaskContext.get().partitionId() << 32
    return ((first + k, batch) for k, batch in enumerate(chunked(batches, "text", _SCORE_BYTES)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, data) of rows: a chunk's rows as an Arrow stream."""
    for chunk, batch in _numbered(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "data"])


def _unpacked(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as rows:
        return rows.read_next_batch()


def chunk_levels(texts: DataFrame | None, chunks: DataFrame, blocks: int, probes: int) -> DataFrame:
    """(chunk, block, data): the levels of each chunk's distinct pairs that lie in a block, in order, a byte each.

    texts(text), if any, and the texts of chunks that have learn are learned from. Each block of the filter is built and asked in one task and then dropped.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", _TEXT_BYTES):
            distinct, codes, starts = _tokens(batch)
            yield _sent(*np.unique(_pairs(distinct[codes], starts), return_counts=True), -1, blocks)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                batch = _unpacked(data.as_py())
                distinct, codes, starts = _tokens(batch)
                pairs, at = np.unique(_pairs(distinct[codes], starts), return_inverse=True)
                learn = np.repeat(batch.column("learn").to_numpy(zero_copy_only=False), np.diff(starts))
                yield _sent(pairs, np.bincount(at, learn, len(pairs)), chunk, blocks)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _rows_of(batches, "block"):
            learned, counts, asked, numbers = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [], []
            for row in rows:
                pairs = _read(row["pairs"])
                n = np.frombuffer(row["n"], np.int32)
                learned.append(pairs[n > 0])
                counts.append(n[n > 0])
                if row["chunk"] >= 0:
                    asked.append(pairs)
                    numbers.append(row["chunk"])
            if not asked:
                continue
            values, at = np.unique(np.concatenate(learned), return_inverse=True)
            own = filter_block(values, np.bincount(at, np.concatenate(counts), len(values)), probes)
            values, at = np.unique(np.concatenate(asked), return_inverse=True)
            found = levels(own, values, probes)[at]
            ends = np.cumsum([len(x) for x in asked])
            data = [x.tobytes() for x in np.split(found, ends[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([block] * len(data), pa.int32()), pa.array(data, pa.binary())], ["chunk", "block", "data"])

    schema = "block int, chunk long, pairs binary, n binary"
    sent = chunks.mapInArrow(ask, schema)
    if texts is not None:
        sent = sent.unionByName(texts.select("text").mapInArrow(emit, schema))
    return sent.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(answer, "chunk long, block int, data binary")


def score(
    docs: DataFrame,
    training: DataFrame | Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    strength: float = STRENGTH,
) -> DataFrame:
    """One row per row of docs: id, n_tokens, n_known, train_tokens, base_score, score.

    training(text_col) holds the texts to learn from; where they are rows of docs it is their condition, and pairs are
    sent once for both. A null text is an empty one, which is its end alone. Rows of
    one id and text are scored once and come back as often as they came. Null ids are kept. Other columns are
    ignored. Without training texts every token is unknown (N and V are 0); an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    within = isinstance(training, Column)
    learned = docs.where(training).select(text) if within else training.select(text)
    learn = (F.coalesce(training, F.lit(False)) if within else F.lit(False)).alias("learn")
    counts = cut_lineage(token_counts(learned))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total.n), int(total.v)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text, learn).withColumn("text_key", F.xxhash64("text"))
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    rows.mapInArrow(_packed, "chunk long, data binary").write.parquet(folder)  # written, so that chunks keep their numbers
    chunks = spark.read.schema("chunk long, data binary").parquet(folder)
    found = chunk_levels(None if within else learned, chunks, 1 << max(1, (n // BLOCK_TOKENS).bit_length()), probes_for(v, strength))
    top = counts.where(F.col("c") >= head_threshold(counts)).toPandas().sort_values("token")
    known = spark.sparkContext.broadcast((top["token"].to_numpy(np.int64), top["c"].to_numpy(np.float64)))
    floor, least = float(np.log10(n + v + 1)), strength * (1 + FALSE_SHARE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "text_key", "rare", "token", "level", "times", "tokens", "n_known", "base_score", "score"]
        types = (pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        tokens_of_head, counts_of_head = known.value
        for _, group in _rows_of(batches, "chunk"):
            batch = _unpacked(next(group)["data"])
            distinct, codes, starts = _tokens(batch)
            texts = len(starts) - 1
            pairs, of_pair = np.unique(_pairs(distinct[codes], starts), return_inverse=True)
            own = np.frombuffer(b"".join(row["data"] for row in group), np.uint8)
            if len(own) != len(pairs):
                raise ValueError(f"{len(own)} levels for {len(pairs)} pairs")
            level = own[of_pair].astype(np.int64)
            seen = np.where(level > 0, 2.0 ** ((level - 1) / 2), 0.0)
            signed = distinct.view(np.int64)
            at = np.searchsorted(tokens_of_head, signed)
            at[at == len(tokens_of_head)] = 0
            inside = tokens_of_head[at] == signed if len(tokens_of_head) else np.zeros(len(signed), bool)
            count = np.where(inside, counts_of_head[at], 0.0) if len(counts_of_head) else np.zeros(len(signed))
            row = np.repeat(np.arange(texts), np.diff(starts))
            in_head, c = inside[codes], count[codes]
            base = np.log10(c + 1) - floor
            # each token comes once after another and once before another: the end comes before the first
            value = np.log10(seen + strength * 10**base) - np.log10(c + least)
            ids, keys = batch.column("id"), batch.column("text_key")
            own = (np.zeros(texts, bool), np.arange(texts), *np.zeros((2, texts), int), np.diff(starts), *(np.bincount(row, np.where(in_head, x, 0), texts) for x in (1, base, value)))
            yield pa.RecordBatch.from_arrays([ids, keys, *(pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip(own, types, strict=True))], names)
            rare = np.flatnonzero(~in_head)
            if len(rare):
                each, times = np.unique((row[rare] * len(distinct) + codes[rare]) * 128 + level[rare], return_counts=True)
                of, code = each // 128 // len(distinct), each // 128 % len(distinct)
                k, where = len(each), pa.array(of)
                own = (np.ones(k, bool), signed[code], each % 128, times, *np.zeros((4, k)))
                yield pa.RecordBatch.from_arrays([ids.take(where), keys.take(where), *(pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip(own, types, strict=True))], names)

    whole = chunks.select("chunk", F.lit(-1).alias("block"), "data").unionByName(found)
    rows = whole.repartition(max(1, chunks.count()), "chunk").sortWithinPartitions("chunk", "block")
    schema = "id long, text_key long, rare boolean, token long, level int, times int, tokens long, n_known long, base_score double, score double"
    parts = rows.mapInArrow(run, schema)
    joined = parts.join(counts, "token", "left")
    c, is_rare = F.coalesce("c", F.lit(0)), F.col("rare")
    base = F.log10(c + 1) - floor
    seen = F.when(F.col("level") > 0, F.pow(F.lit(2.0), (F.col("level") - 1) / 2)).otherwise(0.0)
    value = F.log10(seen + strength * F.pow(F.lit(10.0), base)) - F.log10(c + F.lit(least))
    summed = joined.groupBy("id", "text_key").agg(
        F.sum("tokens").alias("tokens"),
        F.sum(F.when(is_rare & (c > 0), F.col("times")).otherwise(F.col("n_known"))).alias("known"),
        F.sum(F.when(is_rare, F.col("times") * base).otherwise(F.col("base_score"))).alias("base"),
        F.sum(F.when(is_rare, F.col("times") * value).otherwise(F.col("score"))).alias("value"),
        F.sum((~is_rare).cast("long")).alias("copies"),
    )
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "id",
        F.expr("tokens div copies").alias("n_tokens"),
        F.expr("known div copies").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("value") / F.col("copies")).alias("score"),
    )
