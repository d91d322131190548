"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A test string is a window of ten consecutive words of a benchmark item (or all words of a
shorter item).  Texts and test strings are sequences of words; blocks are two
neighbouring words.  For each group of test strings of a like length the search keeps

* a shift table: for a block, how far the search may move on without missing an occurrence
  of any test string (blocks in none of them: the most), and
* suffix buckets: the test strings by a hash of their last block (within the shortest length) and their
  first one; those of a bucket are compared word by word.

Shift tables are dictionaries of the few blocks that test strings have; test strings, their
hashes and the items that have them are packed arrays.  A benchmark of any size is searched in passes of a fixed number
of windows; a pass's tables are broadcast and its hits are combined with those of the passes before, row by row.
Passes run behind one another in a task, `CHAINED` at most; then the rows are a table in the shared folder.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligspark.llm.common import text_bytes
from eligspark.storage import materialize

#: Fixed value: words are runs of digits, letters a-z and bytes of non-ASCII characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Windows of the benchmark that one pass searches for; further ones go in further passes.
BLOCK_WINDOWS = 200_000
#: Passes of one job, each with a worker process of its own in every task.
CHAINED = 8
ODD, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


@dataclass
class Group:
    """The test strings of one length: shifts by block, and buckets: sorted hashes, each with a test string's number.

    `patterns` has the strings' word numbers one after the other; the items of string k are
    `owners[first_owner[k] : first_owner[k + 1]]`.
    """

    length: int
    shift: dict[int, int]
    hashes: array
    strings: array
    patterns: array
    first_owner: array
    owners: array


def packed(code: str, values: np.ndarray) -> array:
    out = array(code)
    out.frombytes(np.ascontiguousarray(values, dtype=np.dtype(code)).tobytes())
    return out


class WuManber:
    """Search for word sequences; `numbers` maps words of test strings to positive numbers, other words are 0."""

    def __init__(self, numbers: dict[bytes, int], items: list[str]):
        self.numbers, self.items = numbers, items
        self.groups: list[Group] = []

    @classmethod
    def of_items(cls, items: list[tuple[str, bytes]], window: int = WINDOW) -> WuManber:
        """Tables for the windows of (item id, text) rows."""
        return cls.of_words(((item, words_of(text)) for item, text in items), window)

    @classmethod
    def of_words(cls, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> WuManber:
        """Tables for the windows of (item id, words) rows."""
        numbers: dict[bytes, int] = {}
        names: dict[str, int] = {}
        strings: dict[int, list] = {}
        for item, words in items:
            if words:
                ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.uint32)
                rows = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
                strings.setdefault(rows.shape[1], []).append((rows, np.full(len(rows), names.setdefault(item, len(names)), np.uint32)))
        out = cls(numbers, list(names))
        # one group per length, so that a short test string doesn't shorten the shifts of long ones
        for _, parts in sorted(strings.items()):
            out._add(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return out

    def _add(self, rows: np.ndarray, items: np.ndarray) -> None:
        length = rows.shape[1]
        size = min(2, length)  # words of a block
        rows, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel().astype(np.int64), items.astype(np.int64)]), axis=1)
        block = lambda end: rows[:, end - 1].astype(np.uint64) | (rows[:, end - 2].astype(np.uint64) << np.uint64(32) if size == 2 else np.uint64(0))
        shift: dict[int, int] = {}
        for end in range(size, length + 1):  # later blocks have smaller shifts
            shift.update(dict.fromkeys(np.unique(block(end)).tolist(), length - end))
        hashes = block(length) * np.uint64(ODD) + block(size)
        order = np.argsort(hashes, kind="stable")
        first = np.searchsorted(pairs[0], np.arange(len(rows) + 1))
        self.groups.append(Group(length, shift, packed("Q", hashes[order]), packed("I", order), packed("I", rows), packed("I", first), packed("I", pairs[1])))

    def search(self, ids: list[int]) -> Iterator[tuple[int, int, frozenset]]:
        """(start, end, items) of every occurrence of every test string."""
        n, packed_ids = len(ids), None
        for g in self.groups:
            length, shift, hashes = g.length, g.shift, g.hashes
            size = min(2, length)
            most = length - size + 1
            at = length
            while at <= n:
                # `at` is where a test string might end
                block = (ids[at - 2] << 32) | ids[at - 1] if size == 2 else ids[at - 1]
                move = shift.get(block, most)
                if move:
                    at += move
                    continue
                start = at - length
                first = (ids[start] << 32) | ids[start + 1] if size == 2 else ids[start]
                wanted = (block * ODD + first) & MASK
                k = bisect_left(hashes, wanted)
                while k < len(hashes) and hashes[k] == wanted:
                    if packed_ids is None:
                        packed_ids = array("I", ids)
                    s = g.strings[k]
                    if packed_ids[start:at] == g.patterns[s * length : (s + 1) * length]:
                        yield start, at, frozenset(self.items[o] for o in g.owners[g.first_owner[s] : g.first_owner[s + 1]])
                    k += 1
                at += 1

    def numbered(self, words: list[bytes]) -> list[int]:
        get = self.numbers.get
        return [get(w, 0) for w in words]


def item_blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """(item id, words) rows in blocks of at most `most` windows, fetched part by part; longer items go in overlapping pieces."""
    block, held = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), text_bytes().alias("text"))
    for row in rows.toLocalIterator():
        words = words_of(bytes(row.text))
        at, windows = 0, max(1, len(words) - window + 1)
        while at < windows:
            take = min(most - held, windows - at)
            block.append((row.item, words[at : at + take + window - 1]))
            held, at = held + take, at + take
            if held >= most:
                yield block
                block, held = [], 0
    if block:
        yield block


OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per row of `documents`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; items without words have no window; a null
    item id counts under the name null; items that share an id are one item; null document ids
    stay null; repeated rows stay repeated; empty tables give no rows or no hits; other columns
    are not read; very long texts are searched whole.  More than `block_windows` windows are searched for in several passes
    whose hits travel with the rows.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"))
    blocks = item_blocks(benchmark, window, block_windows)
    block, passes = next(blocks, []), 0
    while True:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(WuManber.of_words(block, window))
        if following is None:
            return rows.mapInArrow(lambda it, s=shared: finished(it, s.value), OUT)
        rows = rows.mapInArrow(lambda it, s=shared: searched(it, s.value), "doc_id long, text binary, hits binary, items array<string>")
        block, passes = following, passes + 1
        if passes % CHAINED == 0:
            rows = materialize(rows, "decontaminate")


def hit_words(search: WuManber, words: list[bytes], earlier: bytes | None, items: list[str]) -> tuple[np.ndarray, set[str]]:
    """Which words are hit, and the items that occur, with what earlier passes found."""
    hit = np.zeros(len(words), bool) if earlier is None else np.unpackbits(np.frombuffer(earlier, np.uint8), count=len(words)).astype(bool)
    found = set(items)
    for start, end, owners in search.search(search.numbered(words)):
        hit[start:end] = True
        found |= owners
    return hit, found


def searched(batches: Iterator[pa.RecordBatch], search: WuManber) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        results = [hit_words(search, words_of(t), h, i) for t, h, i in zip(*(batch.column(c).to_pylist() for c in ("text", "hits", "items")))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), pa.array([np.packbits(h).tobytes() for h, _ in results], pa.binary()), pa.array([sorted(f) for _, f in results], pa.list_(pa.string()))], names=["doc_id", "text", "hits", "items"]
        )


def finished(batches: Iterator[pa.RecordBatch], search: WuManber) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"n_words": [], "n_hit": [], "n_items": [], "items_sha256": []}
        for text, earlier, items in zip(*(batch.column(c).to_pylist() for c in ("text", "hits", "items"))):
            words = words_of(text)
            hit, found = hit_words(search, words, earlier, items)
            out["n_words"].append(len(words))
            out["n_hit"].append(int(hit.sum()))
            out["n_items"].append(len(found))
            out["items_sha256"].append(hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
        columns = [pa.array(out[c], pa.int64()) for c in ("n_words", "n_hit", "n_items")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns, pa.array(out["items_sha256"], pa.string()), pa.array([h > 0 for h in out["n_hit"]], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        )


def decontamination_sql(window: int = WINDOW) -> str:
    """DuckDB SQL for the rows of `decontaminate` over documents and benchmark."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+')"
    return f"""
with docs as (select row_number() over () as rid, doc_id, {words} as w from documents),
items as (select coalesce(cast(item_id as varchar), 'null') as item, {words} as w from benchmark),
item_windows as (
  select item, least(len(w), {window}) as width, array_to_string(w[k : k + least(len(w), {window}) - 1], ' ') as s
  from items, unnest(range(1, len(w) - least(len(w), {window}) + 2)) as u(k) where len(w) > 0),
widths as (select distinct width from item_windows),
doc_windows as (
  select rid, k, width, array_to_string(w[k : k + width - 1], ' ') as s
  from docs, widths, unnest(range(1, greatest(len(w) - width + 2, 1))) as u(k)),
found as (select d.rid, d.k, d.width, i.item from doc_windows d join item_windows i on d.width = i.width and d.s = i.s),
hit as (select rid, count(distinct p) as n from (select rid, unnest(range(k, k + width)) as p from found) group by rid),
named as (select rid, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct rid, item from found) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(named.n, 0) as n_items,
       sha256(coalesce(named.s, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from docs left join hit using (rid) left join named using (rid)"""


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of `documents` without any hit, all columns as they are; each pass over the benchmark filters what is left.

    Null and empty texts have no hits and stay, as do repeated rows and null ids; an empty table gives no rows, an
    empty benchmark all; columns of any name are carried along.
    """
    columns = documents.columns
    rows = documents.select(F.struct("*").alias("row"), text_bytes().alias("text"))
    for passes, block in enumerate(item_blocks(benchmark, window, block_windows), 1):
        shared = documents.sparkSession.sparkContext.broadcast(WuManber.of_words(block, window))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                search = shared.value
                kept = [next(search.search(search.numbered(words_of(t))), None) is None for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(kept, pa.bool_()))

        rows = rows.mapInArrow(clean, rows.schema)
        if passes % CHAINED == 0:
            rows = materialize(rows, "decontaminate")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])
