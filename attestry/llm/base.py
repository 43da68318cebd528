"""What the operators of this subpackage share: tables, checkpoints, batches of text and their words."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one step of a Python task holds at once (a longer single text is held whole).
CHUNK_BYTES = 8 << 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’‚…–—¿¡·•"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for written stages, which all executors share: the session's spark.checkpoint.dir.

    Where that is unset, local mode takes a temporary folder and a cluster a folder in the warehouse.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and context.getCheckpointDir():
        folder = context.getCheckpointDir()
    if not folder:
        local = context.master.startswith("local") and not context.master.startswith("local-cluster")
        folder = tempfile.mkdtemp(prefix="attestry-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys that hold more rows than this, and more than one in HOT_KEYS of all, are joined by broadcast; HOT_KEYS bounds how many.
HOT_ROWS, HOT_KEYS = 1_000, 100_000


def join_hot(rows: DataFrame, small: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with small(key, n, ...), a row for each key, where n says how many of all `total` rows have it.

    Rows of hot keys stay where they are; the others meet by a shuffle, so that no task holds a hot key. There are at
    most HOT_KEYS hot keys, as each has more than a HOT_KEYS-th of all rows. n isn't in the result.
    """
    hot = F.broadcast(small.where(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).drop("n"))
    cold = small.where(F.col("n") <= max(HOT_ROWS, total // HOT_KEYS)).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def remainder(id_column: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def chunked(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds at most max_bytes in the column, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """The texts with each byte replaced by table's; table must keep bytes of 128 and more, so that it stays UTF-8."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
    own = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().translate(table) if data else b""
    found = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(own))
    return found if not texts.null_count else pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), found)


class Words:
    """The words of some texts: codes into distinct, all texts in a row; text i has codes[starts[i]:starts[i + 1]].

    Words are runs of other characters than ASCII white space, A-Z in lower case. Null is the empty text.
    With fold, all letters are in lower case and punctuation at a word's ends is left out, and with it
    words of nothing else. With as_is, letters keep their case.
    """

    def __init__(self, texts: pa.Array, fold: bool = False, as_is: bool = False):
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(texts if as_is else pc.utf8_lower(texts) if fold else pc.ascii_lower(texts))
        flat = lists.flatten()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if not full.all():  # white space at either end of a text leaves an empty word there
            offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
            flat = flat.filter(pa.array(full))
        encoded = flat.dictionary_encode()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct: pa.Array = encoded.dictionary
        self.starts = offsets
        if fold:
            merged = pc.utf8_trim(self.distinct, PUNCTUATION).dictionary_encode()
            codes = merged.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.codes]
            self.distinct = merged.dictionary
            full = pc.greater(pc.binary_length(self.distinct), 0).to_numpy(zero_copy_only=False)[codes]
            self.starts, self.codes = np.concatenate(([0], np.cumsum(full)))[offsets], codes[full]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """XXH64 of each distinct word."""
        digest = xxhash.xxh64_intdigest
        words = self.distinct.cast(pa.binary()).to_pylist()
        return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))

    def rows(self) -> np.ndarray:
        """The text number of each code."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64) of each value."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
