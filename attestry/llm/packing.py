"""Packing of documents into sequences: first-fit decreasing in randomised groups.

A document's ids are cut into whole sequences and a rest. Whole sequences stand for themselves. The rests
are dealt at random into groups of about GROUP_SIZE, and each group is packed on its own by first-fit
decreasing; a tournament tree over the bins' free room finds the first bin that fits in logarithmic time.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.base import chunked, cut_lineage

SEQUENCE_LENGTH = 2048
END_ID = 1
#: Rests in a group, on average. Larger groups pad less; a group is packed by one task.
GROUP_SIZE = 1024
_LONG_SPACE = r"\s{500}"
_TEXT_BYTES = 4 << 20

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, {}"


def _byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte: itself where it prints, else 256 and up."""
    printed = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


#: What must hold of a tokenizer's file for merging by rank: bytes split by public_tokenizers.PATTERN, and nothing else.
_PLAIN = {"normalizer": None, "truncation": None, "padding": None}
_PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}


class IdEncoder:
    """The ids of texts by a tokenizer file, as its encode(text, add_special_tokens=False) gives them.

    Where the file is a plain byte-level one and the vocabulary's ids follow the order of its merges, merging by rank
    gives the tokenizer's own ids in a quarter of the time, so tiktoken does it with the same vocabulary. Other files,
    texts that contain an added token, and texts with very long runs of white space go through the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        file = json.loads(Path(tokenizer_path).read_text(encoding="utf-8"))
        model, split = file["model"], file.get("pre_tokenizer") or {}
        plain = all(file.get(k) == v for k, v in _PLAIN.items()) and all(split.get(k) == v for k, v in _PLAIN_SPLIT.items()) and all(model.get(k) == v for k, v in _PLAIN_MODEL.items())
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]] if plain else []
        in_order = plain and all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))
        letters, size = _byte_letters(), 256 + len(pairs)
        ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if i < size} if in_order else {}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order and len(ranks) == size else None
        added = [re.escape(t["content"]) for t in file.get("added_tokens", ()) if t["content"]]
        self.slow = "|".join([_LONG_SPACE, *added])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        slow = pc.match_substring_regex(texts, self.slow).to_pylist()
        out = []
        for text, by_itself in zip(texts.to_pylist(), slow, strict=True):
            if self.fast and not by_itself:
                out.append(np.frombuffer(self.fast._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32))
            else:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
        return out


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, length: int, end_id: int) -> DataFrame:
    """The pieces of each row's ids, cut at multiples of length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = IdEncoder(tokenizer_path)
        names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in chunked(batches, "text", _TEXT_BYTES):
            rows, starts, sizes, sums, totals = [], [], [], [], []
            for i, ids in enumerate(encode(batch.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    rows.append(i)
                    starts.append(start)
                    sizes.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
                    totals.append(len(ids))
            columns = [batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums, totals))]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES.format("").rstrip(", "))


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size. Larger sizes come first (ties in the given order), each into the first bin with room.

    Leaves of the tree are bins, an inner node has the largest room below it.
    """
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            node += room[node] < size
        bins[i] = node - leaves
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    length: int = SEQUENCE_LENGTH,
    end_id: int = END_ID,
    group_size: int = GROUP_SIZE,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each row lies in exactly one piece; a sequence has at most `length` ids, its pieces follow
    each other from offset 0. A null or empty text is the end id alone. Repeated rows and null ids are packed
    like any others, other columns are ignored, and an empty table gives an empty result. The order of the
    input decides which rows share a group, never which ids are packed.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    groups = max(1, docs.count() // group_size)
    cut = cut_lineage(pieces(docs, id_col, text_col, path, length, end_id).withColumn("row", F.monotonically_increasing_id()))
    # ids of whole sequences are negative, those of packed ones are not, so the two never meet
    whole = cut.where(F.col("length") == length).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    rests = cut.where(F.col("length") < length).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        bins = first_fit_decreasing(rows["length"].to_numpy(), length)
        before = rows["length"].groupby(bins).cumsum() - rows["length"]
        return rows.assign(sequence_id=rows["bucket"] * (1 << 32) + bins, offset=before)

    packed = rests.groupBy("bucket").applyInPandas(fit, PIECES.format("row long, bucket long, sequence_id long, offset long"))
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return whole.select(columns).unionByName(packed.select(columns))
