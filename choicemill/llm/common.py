"""What the operators share: written stages, text slices and vectorised word fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from choicemill.session import checkpoint_root

SLICE_BYTES = 2 << 20  # text that one vectorised step holds; longer single texts form a step alone
LAST = (1 << 63) - 1  # a null id sorts after every other


def stage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from its files.

    What was shuffled for it is no longer needed then. Spark deletes such files once the driver's
    collector has found them unused, which is asked for here, as it may otherwise take half an hour.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_id(name: str = "doc_id") -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, o (id that is never null), two fingerprints of the text, text."""
    return docs.select("doc_id", order_id().alias("o"), F.xxhash64("text").alias("k1"),
                       F.xxhash64(F.lit(1), "text").alias("k2"), "text")


def held_out(name: str = "doc_id") -> Column:
    """Rows that no label may be learned from (null id: held out)."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def drawn(share: float | Column, *columns: str) -> Column:
    """Rows of a hash sample with this share of all, over 2^62 steps: no share of a large table rounds to nothing."""
    least = F.lit(share) * F.lit(float(1 << 62)) if not isinstance(share, Column) else share * F.lit(float(1 << 62))
    return F.shiftrightunsigned(F.xxhash64(*columns), 2).cast("double") <= least


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text or list elements, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.list_value_length if pa.types.is_list(batch.column(column).type) else pc.binary_length
        size = pc.fill_null(length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Join small record batches until they hold about ``limit`` bytes of a text column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers from start to stop of each row, one row after the other."""
    length = stop - start
    if not len(length):
        return np.zeros(0, np.int64)
    return np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the n + 1 offsets (null: empty)."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1]
    offs = offs.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]: offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * step) | np.uint64(1)


def byte_class(members: str) -> np.ndarray:
    """A table over bytes, true for the given ASCII characters."""
    table = np.zeros(256, bool)
    table[list(members.encode("ascii"))] = True
    return table


BLANK = byte_class(" \t\n\x0b\x0c\r")
SYMBOL = stream(256, 1)
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def span_hashes(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of consecutive spans of the given lengths."""
    if not len(length):
        return np.zeros(0, np.uint64)
    at = np.cumsum(length) - length
    place = np.arange(len(data)) - np.repeat(at, length)
    value = SYMBOL[data] * stream(int(length.max()), 2)[place]
    return mixed(np.add.reduceat(value, at) + length.astype(np.uint64))


class Words:
    """Words of a slice of texts: byte spans, text bounds and 64-bit fingerprints.

    ``bounds[i] : bounds[i + 1]`` are the words of text i.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, blank: np.ndarray = BLANK):
        data, offs = bytes_of(texts)
        self.data = LOWERED[data] if lower else data
        self.offs = offs
        inside = ~blank[self.data]
        first = np.ones(len(data) + 1, bool)  # a word may start here, whatever stands before
        first[1:-1] = ~inside[:-1]
        first[offs] = True
        self.starts = np.flatnonzero(inside & first[:-1])
        self.ends = np.flatnonzero(inside & (first[1:] | np.append(~inside[1:], True))) + 1
        self.bounds = np.searchsorted(self.starts, offs)
        self.inside = self.data[inside]  # the bytes of all words in a row

    def __len__(self) -> int:
        return len(self.starts)

    @cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.inside, self.ends - self.starts)

    @cached_property
    def owner(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def runs(self, length: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint of the run of ``length`` words from each word on, and whether the run lies
        within one text; both have a value for each word."""
        n = len(self)
        whole = np.zeros(n, bool)
        out = np.zeros(n, np.uint64)
        m = n - length + 1
        if m <= 0:
            return out, whole
        owner = self.owner
        whole[:m] = owner[:m] == owner[length - 1:]
        for j, factor in enumerate(stream(length, seed)):
            out[:m] += self.hashes[j: j + m] * factor
        out[:m] = mixed(out[:m])
        return out, whole

    def words(self, text: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in
                zip(self.starts[self.bounds[text]: self.bounds[text + 1]],
                    self.ends[self.bounds[text]: self.bounds[text + 1]], strict=True)]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def flat_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and the length of each list (null: empty)."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), counts
