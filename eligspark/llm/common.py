"""What several training-data operators share: Arrow batches, hashing, bounded collects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids are broadcast up to this many rows (8 bytes each); beyond it the join shuffles.
BROADCAST_ID_ROWS = 2_000_000


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def arrow_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A record batch with the columns in schema order."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class WordHash(dict):
    """word -> 64-bit hash, remembered up to `most` words so that memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def word_shingles(text: bytes, size: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `size`-word shingles of `text`.

    Letters A-Z are lower-cased and words are runs without ASCII white space.  A text of
    fewer words has its whole sequence as one shingle; a text without words has none.
    """
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(size, n)
    out = h[: n - width + 1].copy()
    for k in range(1, width):
        out = mix64(out * ODD + h[k : n - width + 1 + k])
    if n < size:
        out = mix64(out + np.uint64(n))
    return np.unique(out)


def as_signed(x: np.ndarray) -> np.ndarray:
    """uint64 bits as Spark longs."""
    return x.view(np.int64)


def keep_ids(df: DataFrame, ids: DataFrame, on: str, most: int = BROADCAST_ID_ROWS) -> DataFrame:
    """Rows of `df` whose `on` is in `ids` (distinct): a broadcast where `ids` is proven small, else a shuffle join."""
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids, on, "left_semi")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that only few texts at once are also Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fenced(column: Column) -> Column:
    """The same values, but not deterministic in the optimizer's eyes.

    A filter on a deterministic column is pushed below the projections that made it, and every reference is
    replaced by the whole expression, which multiplies long expressions (and their cost) many times over.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def grouped_rows(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `keys`; holds one open group and one batch."""
    open_part: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        same = np.ones(batch.num_rows - 1, bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            same &= values[1:] == values[:-1]
        starts = [0, *(np.flatnonzero(~same) + 1).tolist()]
        if open_part:
            last = open_part[-1]
            joined = all(last.column(k)[last.num_rows - 1] == batch.column(k)[0] for k in keys)
            if not joined:
                yield pa.Table.from_batches(open_part)
                open_part = []
        for a, b in zip(starts, starts[1:]):
            open_part.append(batch.slice(a, b - a))
            yield pa.Table.from_batches(open_part)
            open_part = []
        open_part.append(batch.slice(starts[-1]))
    if open_part:
        yield pa.Table.from_batches(open_part)
