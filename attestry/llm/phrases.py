"""Phrases that stand together, mined as relations of occurrences (SETM).

R1 holds the words' occurrences, sorted by piece and position; Rk those of phrases of k words. Rk is the merge-join of
R(k-1) with itself at adjacent positions of a piece, is counted by phrase, and loses the occurrences of phrases that are
too rare by a semi-join before it is extended. All relations are persisted in blocks of documents: a row holds a block's
occurrences in order, with a slot for each word and one without a word between pieces, so that the merge-join of a block is
a shift by one slot. Counting goes over the blocks' distinct phrases, which are dealt into parts by their hash: a row holds
a block's phrases of one part, sorted and packed, and a part, of bounded size, adds up and names its frequent phrases and
answers each block with the places of its own. A phrase has one entry a block, so no phrase, however frequent, is a hot
key; nothing is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.base import chunked, mix, shared_folder, translated

#: Bytes that end a piece become line feeds, tabs spaces, A-Z lower case.
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Text of a block (a longer document is a block of its own). Blocks are numbered by 20 bits of the partition and 12 within.
BLOCK_BYTES = 6 << 20
_BLOCKS, _KEYS = 12, 32
#: The text whose phrases make a part, so that a task that counts holds some two million entries.
PART_BYTES = 32 << 20
#: A relation has a row of slots for each block and, with slots null, a row for the block's phrases of each part, the first of
#: which has the place `start`.
_ROWS = pa.schema([("block", pa.int64()), ("slots", pa.binary()), ("part", pa.int32()), ("start", pa.int32()), ("keys", pa.binary()), ("words", pa.binary())])
_RELATION = "block long, slots binary, part int, start int, keys binary, words binary"
#: A part's answers (block, part, places), its frequent phrases (name, ...) and, of words, how many each language has (lang, n).
_ANSWERS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("places", pa.binary()), ("name", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of as many whole numbers each, by the places of their bytes, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns))


def _unpack(packed: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in planes]


def _rows(block: int, slots: np.ndarray, parts: np.ndarray, packed: Callable[[slice], tuple]) -> Iterator[pa.RecordBatch]:
    """The rows of a block: its slots, and its phrases, which are sorted by part; packed gives keys and words of some."""
    cuts = [*np.flatnonzero(np.diff(parts, prepend=-1)).tolist(), len(parts)]
    found = [(block, _pack(slots), None, None, None, None)]
    found += [(block, None, int(parts[start]), start, *packed(slice(start, end))) for start, end in zip(cuts, cuts[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _ROWS)], schema=_ROWS)
    pa.default_memory_pool().release_unused()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for part in chunked(batches, "text", BLOCK_BYTES):
        own = part.column("text").nbytes
        if held and size + own > BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield pa.Table.from_batches(held)


def _words(texts: pa.Array, langs: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words of all texts in a row, with a line feed after each piece, and the language of each."""
    ended = pc.replace_substring(pc.binary_join_element_wise(translated(texts, _TABLE), "\n", ""), "\n", " \n ")
    lists = pc.split_pattern(ended, " ")
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    lang = np.repeat(langs.astype(np.int32), np.diff(lists.offsets.to_numpy()))[full.to_numpy(zero_copy_only=False)]
    return lang, flat.filter(full).dictionary_encode()


def _first(docs: DataFrame, parts: int) -> DataFrame:
    """R1 of docs(lang, text): a block's slots hold 1 + the place of a word among the block's words, or 0 at a piece's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, table in enumerate(_blocks(batches)):
            if number >> _BLOCKS or task >> 20:
                raise ValueError("more blocks or partitions than their numbers hold: use more, or fewer, partitions")
            langs = table.column("lang").combine_chunks().dictionary_encode()
            lang, words = _words(table.column("text").combine_chunks(), langs.indices.to_numpy(zero_copy_only=False))
            codes, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary
            real = pc.not_equal(names, "\n").to_numpy(zero_copy_only=False)[codes]
            keys, places, times = np.unique(lang[real].astype(np.int64) * len(names) + codes[real], return_inverse=True, return_counts=True)
            # a word has no space, so the last one ends the language
            text = pc.binary_join_element_wise(langs.dictionary.take(pa.array(keys // max(1, len(names)))), names.take(pa.array(keys % max(1, len(names)))), " ")
            part = np.fromiter((xxhash.xxh64_intdigest(x) % parts for x in text.to_pylist()), np.int64, len(text))
            order = pc.sort_indices(text).to_numpy()
            order = order[np.argsort(part[order], kind="stable")]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(1, len(order) + 1)
            slots = np.zeros(len(codes), np.int64)
            slots[real] = place[places]
            text, times = text.take(pa.array(order)), times[order]

            def packed(some: slice) -> tuple[bytes, bytes]:
                own = text[some]
                return _pack(pc.binary_length(own).to_numpy(zero_copy_only=False), times[some]), zstandard.compress("".join(own.to_pylist()).encode())

            yield from _rows(task << _BLOCKS | number, slots, part[order], packed)

    return docs.mapInArrow(run, _RELATION)


def _next(blocks: DataFrame, parts: int) -> DataFrame:
    """The merge-join of blocks(block, slots, kept) at adjacent slots; kept has the parts' answers, what stays and its names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed_slots, kept in zip(*(batch.column(c) for c in ("block", "slots", "kept"))):
                slots = _unpack(packed_slots.as_py(), 1)[0]
                answers = [(x["part"], *_unpack(x["places"], 2)) for x in kept.as_py()]
                places, names = np.concatenate([a[1] for a in answers]), np.concatenate([(a[0] << _KEYS) + a[2] for a in answers])
                rank = np.zeros(max(int(slots.max(initial=0)), int(places.max(initial=0)) + 1) + 1, np.int64)
                rank[places + 1] = np.arange(1, len(places) + 1)
                known = rank[slots]
                at = np.flatnonzero((known[:-1] > 0) & (known[1:] > 0))
                keys, of, times = np.unique((known[at] - 1) * len(names) + known[at + 1] - 1, return_inverse=True, return_counts=True)
                head, tail = names[keys // max(1, len(names))], names[keys % max(1, len(names))]
                part = (mix(mix(head.view(np.uint64)) ^ tail.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((tail, head, part))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(1, len(order) + 1)
                longer = np.zeros(len(slots), np.int64)
                longer[at] = place[of]
                head, tail, times = head[order], tail[order], times[order]
                # heads are in order: their steps are small
                yield from _rows(block.as_py(), longer, part[order], lambda some: (_pack(np.diff(head[some], prepend=0), tail[some], times[some]), None))

    return blocks.select("block", "slots", "kept").mapInArrow(run, _RELATION)


def _numbered(entries: list[list[np.ndarray]], words: list[bytes | None]) -> tuple[np.ndarray, pa.Table]:
    """The number of each entry's phrase, and the phrases by number: (lang, word) of words, (head, tail) of longer ones."""
    if words[0] is not None:
        offsets = [np.concatenate(([0], np.cumsum(x[0]))).astype(np.int64) for x in entries]
        text = [pa.LargeStringArray.from_buffers(len(o) - 1, pa.py_buffer(o), pa.py_buffer(zstandard.decompress(w))) for o, w in zip(offsets, words)]
        encoded = pa.concat_arrays(text).dictionary_encode()
        both = pc.split_pattern(encoded.dictionary.cast(pa.string()), " ", max_splits=1, reverse=True)
        return encoded.indices.to_numpy(zero_copy_only=False), pa.table({"lang": pc.list_element(both, 0), "word": pc.list_element(both, 1)})
    head, tail = np.concatenate([np.cumsum(x[0]) for x in entries]), np.concatenate([x[1] for x in entries])
    order = np.lexsort((tail, head))
    head, tail = head[order], tail[order]
    new = np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids, pa.table({"head": head[new], "tail": tail[new]})


def _frequent(relation: DataFrame, least: int) -> DataFrame:
    """What the parts of a relation answer: phrases that occur `least` times over all blocks, and where the blocks have them."""

    def filled(**columns: pa.Array) -> pa.Table:
        n = len(next(iter(columns.values())))
        return pa.table([pa.chunked_array([], f.type) if not n else columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ANSWERS], schema=_ANSWERS)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, words = key[0].as_py(), table["words"].to_pylist()
        entries = [_unpack(x, 3 if words[0] is None else 2) for x in table["keys"].to_pylist()]
        ids, phrases = _numbered(entries, words)
        times = np.concatenate([x[-1] for x in entries])
        sums = np.zeros(len(phrases), np.int64)
        np.add.at(sums, ids, times)
        often = np.flatnonzero(sums >= least)
        number = np.full(len(phrases), -1, np.int64)
        number[often] = np.arange(len(often))
        own, end, answers = number[ids], 0, []
        for block, start, entry in zip(table["block"].to_pylist(), table["start"].to_pylist(), entries):
            numbers = own[end : end + len(entry[0])]
            end += len(entry[0])
            at = np.flatnonzero(numbers >= 0)
            if len(at):
                answers.append((block, _pack(start + at, numbers[at])))
        found = phrases.take(pa.array(often))
        named = filled(name=pa.array((part << _KEYS) + number[often]), n=pa.array(sums[often]), **{c: found[c] for c in found.column_names})
        told = filled(block=pa.array([b for b, _ in answers], pa.int64()), part=pa.array([part] * len(answers), pa.int32()), places=pa.array([x for _, x in answers], pa.binary()))
        if words[0] is None:
            return pa.concat_tables([told, named])
        lang = phrases["lang"].combine_chunks().dictionary_encode()
        totals = np.zeros(len(lang.dictionary), np.int64)
        np.add.at(totals, lang.indices.to_numpy(zero_copy_only=False), sums)
        return pa.concat_tables([told, named, filled(lang=lang.dictionary, n=pa.array(totals))])

    schema = "block long, part int, places binary, name long, head long, tail long, lang string, word string, n long"
    return relation.where("slots is null").groupBy("part").applyInArrow(run, schema)


def _score(rows: DataFrame) -> DataFrame:
    """The cut with the lowest score of rows(a, total, firsts, lasts), where firsts[i] counts the first i + 1 words."""
    # exact in 38 digits: counts below 10^15, totals below 10^18
    number = lambda c: c.cast("decimal(18,0)")

    def cut(i: Column) -> Column:
        first, rest = F.get("firsts", i - 1), F.get("lasts", F.size("firsts") - i - 1)
        return F.struct(first.alias("l"), rest.alias("r"), i.alias("i"))

    cuts = rows.withColumn("cut", F.explode(F.transform(F.sequence(F.lit(1), F.size("firsts") - 1), cut)))
    top = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * number(F.col("total"))
    scored = cuts.withColumn("top", top).withColumn("bottom", number(F.col("cut.l")) * number(F.col("cut.r"))).withColumn("score", F.expr("top div bottom"))
    lowest = F.min(F.struct("score", F.col("cut.i").alias("i"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"))).alias("low")
    return scored.groupBy("lang", "phrase", "a", "total").agg(lowest).select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("total").alias("n"), F.col("low.score").alias("score"))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of 2 to `longest` words that occur `least` times in a language.

    a is the phrase's count, n that of all words, l and r those of the two parts at the cut with the lowest score
    floor(1000 * a * n / (l * r)), the first of several. Phrases that lie in a longer one with the same count are left out.
    Pieces end at `.,;:!?` and line ends; words are runs without spaces and tabs, A-Z in lower case. Null texts are empty
    and a null language is `und`. Repeated rows count each; other columns are ignored; an empty table gives an empty result.
    """
    spark, folder = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/phrases-{uuid.uuid4().hex}"
    text, lang = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))

    def persisted(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    parts = max(16, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // PART_BYTES))
    occurrences = persisted(_first(docs.select(lang.alias("lang"), text.alias("text")), parts), "1")
    stay = persisted(_frequent(occurrences, least), "1-frequent")
    totals = stay.where("block is null and name is null").groupBy("lang").agg(F.sum("n").alias("total"))
    known = stay.where("name is not null").select("name", "lang", F.col("word").alias("phrase"), F.col("n").alias("a"), F.array("n").alias("firsts"), F.array("n").alias("lasts"))
    found = None
    for k in range(2, longest + 1):
        kept = stay.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", "places")).alias("kept"))
        blocks = occurrences.where("slots is not null").select("block", "slots").join(kept, "block")
        occurrences = persisted(_next(blocks, parts), str(k))
        stay = persisted(_frequent(occurrences, least), f"{k}-frequent")
        new = stay.where("name is not null").select("name", "head", "tail", F.col("n").alias("a"))
        if new.isEmpty():
            break
        heads = known.select(F.col("name").alias("head"), "lang", F.col("phrase").alias("begin"), "firsts")
        tails = known.select(F.col("name").alias("tail"), F.substring_index("phrase", " ", -1).alias("end"), "lasts")
        longer = new.join(heads, "head").join(tails, "tail").select(
            "name", "head", "tail", "lang", F.concat_ws(" ", "begin", "end").alias("phrase"), "a",
            # a head or tail that occurs no oftener than the longer phrase always lies in it
            F.when(F.element_at("firsts", -1) == F.col("a"), F.col("head")).alias("inside"), F.when(F.element_at("lasts", -1) == F.col("a"), F.col("tail")).alias("inside_too"),
            F.array_append("firsts", F.col("a")).alias("firsts"), F.array_append("lasts", F.col("a")).alias("lasts"),
        )
        known = persisted(longer, f"{k}-known")
        found = known if found is None else found.unionByName(known)
    if found is None:
        return spark.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long")
    # names are unique among the phrases of one length
    found = found.withColumn("words", F.size("firsts"))
    dropped = found.select((F.col("words") - 1).alias("words"), F.explode(F.array("inside", "inside_too")).alias("name")).where("name is not null").distinct()
    return _score(found.join(dropped, ["words", "name"], "left_anti").join(totals, "lang"))


def best_of_each(found: DataFrame, most: int = 2000) -> DataFrame:
    """found with rank: the first `most` of each language by score, count, and the phrase's bytes."""
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("long"))
