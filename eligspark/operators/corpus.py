"""Corpus analytics: fill rates, coverage, phrases, duplicates, distinctive terms, page sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eligspark.functions.text import bm25_tokens, fenced, phrase_norm, stems
from eligspark.operators.sampling import global_rank
from eligspark.storage import materialize

#: Slots of phrases that may be frequent are broadcast as a bitmap of 2 to the power of so many bits (128 KB to 128 MB; at least one
#: byte for each of the 1,024 buckets).
LEAST_BITS, MOST_BITS = 20, 30
#: Phrases are first counted by so many upper bits of their hashes: the bucket that they are counted in, and a value in it.
SLOT_BITS, VALUE_BITS = 36, 26
#: Phrases that a task holds before it sends them off.
PACKED_SLOTS = 1 << 22
#: Bytes of texts that are cut into words at a time.
RUN_BYTES = 1 << 20

# Words that carry no information in a phrase.
BOILERPLATE = "the of to and a in for be is or by on with should must shall applicant from as an not any at are has have been this under scheme will who which that his her their its it per was were".split()


def fill_rates(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, filled, n, rate): how often each expression is true."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f) for f, c in fields.items()])
    return row.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])).alias("x")).select("x.field", "x.filled", "n", F.round(F.try_divide(F.col("x.filled").cast("double"), F.col("n")), 6).alias("rate"))


def flag_counts(df: DataFrame, flags: str) -> DataFrame:
    """(flag, n) over rows' flag lists."""
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def shortest(df: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """The n rows of shortest text, ties by key."""
    return df.select(key, F.length(text).alias("len")).orderBy("len", key).limit(n)


def binding_report(df: DataFrame, bound: Column, level: str, category: str) -> DataFrame:
    """Bindings per record in buckets 0, 1, 2, 3+, cumulative shares and the mean: overall, by category and by level in one pass."""
    rows = df.select(level, category, bound.cast("long").alias("b"))
    rows.createOrReplaceTempView("__binding_rows")
    at = lambda k: f"round(count_if(b >= {k}) / count(*), 6) as share_{k}"
    bucket = lambda k: f"count_if({'b >= 3' if k == 3 else f'b = {k}'}) as n_{k}"
    sql = f"""select coalesce({category}, '*') as category, coalesce({level}, '*') as level, count(*) as n, {', '.join(map(bucket, range(4)))}, {', '.join(map(at, (1, 2, 3)))},
              round(avg(b), 6) as mean from __binding_rows group by grouping sets ((), ({category}), ({level}))"""
    return df.sparkSession.sql(sql)


def ngrams(words: Column, n: int) -> Column:
    """All n-word sequences of a word array."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def is_informative(gram: Column, least: int = 2) -> Column:
    """at least two words that aren't boilerplate."""
    return F.size(F.filter(F.split(gram, " "), lambda w: ~w.isin(*BOILERPLATE))) >= least


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each number once (np.unique hashes, which takes longer)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of normalised texts (one space between words) by place in their bytes, and their sequences by 64-bit hashes."""

    #: The first bytes of the words of 1 to 8 bytes, as `eight` has them.
    MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    #: Longer words are hashed by so many first bytes; their sequences may share a hash.
    HASHED_BYTES = 256

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = int(ends[-1] - ends[0])
        self.bytes = np.zeros((size // 8 + 3) * 8, np.uint8)
        self.bytes[:size] = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.eights = self.bytes.view("<u8")
        space, cut = self.bytes[:size] == 32, np.zeros(size + 1, bool)
        cut[ends - ends[0]] = True
        self.starts = np.flatnonzero(~space & (np.r_[True, space[:-1]] | cut[:-1])) if size else np.empty(0, np.int64)
        self.ends = np.flatnonzero(~space & (np.r_[space[1:], True] | cut[1:])) + 1 if size else np.empty(0, np.int64)
        self.text = np.searchsorted(ends - ends[0], self.starts, side="right") - 1

    def eight(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The 8 bytes at each place as one number, without those beyond the `left` that the word has."""
        k, bits = at >> 3, (at.astype(np.uint64) & np.uint64(7)) * np.uint64(8)
        both = (self.eights[k] >> bits) | ((self.eights[k + 1] << np.uint64(1)) << (np.uint64(63) - bits))
        return both & self.MASKS[np.minimum(left, 8)]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its hash, and whether it is no boilerplate (by its bytes, as a hash may be shared)."""
        size = self.ends - self.starts
        first = self.eight(self.starts, size)
        out = mixed(first ^ size.astype(np.uint64))
        more, at = np.flatnonzero(size > 8), 8
        while len(more) and at < self.HASHED_BYTES:
            out[more] = mixed(out[more] ^ self.eight(self.starts[more] + at, size[more] - at))
            at += 8
            more = more[size[more] > at]
        telling = np.ones(len(size), bool)
        for n in {len(w.encode()) for w in BOILERPLATE}:
            same = [w.encode() for w in BOILERPLATE if len(w.encode()) == n]
            places = np.flatnonzero(size == n)
            if n <= 8:
                telling[places[np.isin(first[places], np.array([int.from_bytes(w, "little") for w in same], np.uint64))]] = False
            else:
                telling[[k for k in places.tolist() if self.bytes[self.starts[k] : self.ends[k]].tobytes() in same]] = False
        return out, telling

    def sequences(self, sizes: tuple[int, ...], least: int = 2) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, first words, hashes) of the sequences within a text with at least `least` words that aren't boilerplate."""
        h, telling = self.hashes()
        before = np.r_[0, np.cumsum(telling)]
        out = np.zeros(len(h), np.uint64)
        for n in range(1, max(sizes) + 1):
            if len(h) < n:
                break
            out = mixed(out[: len(h) - n + 1] ^ h[n - 1 :])
            if n in sizes:
                at = np.flatnonzero((before[n:] - before[:-n] >= least) & (self.text[n - 1 :] == self.text[: len(h) - n + 1]))
                yield n, at, mixed(out[at])

    def strings(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The sequences from the first to the last words, as strings."""
        parts = []
        for k in range(0, max(len(first), 1), 1 << 17):
            starts, size = self.starts[first[k : k + (1 << 17)]], self.ends[last[k : k + (1 << 17)]] - self.starts[first[k : k + (1 << 17)]]
            ends = np.cumsum(size)
            data = self.bytes[np.arange(int(size.sum())) + np.repeat(starts - (ends - size), size)]
            parts.append(pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data)))
        return pa.concat_arrays(parts)


def in_runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[Words]:
    """Texts by runs of at most so many bytes, a longer text alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield Words(texts.slice(at, upto - at))
        at = upto


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers as their differences in 16 bits; 65535 stands for itself and goes on, so any difference can be written."""
    step = np.diff(values.astype(np.int64), prepend=0)
    more = step // 65535
    ends = np.cumsum(more + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 65535, np.uint16)
    out[ends - 1] = step - more * 65535
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16)
    return np.cumsum(steps, dtype=np.uint64)[steps != 65535]


def bucketed(slots: np.ndarray) -> pa.RecordBatch:
    """(bucket, slots): the slots' values by bucket, packed."""
    slots = np.sort(slots)
    buckets = slots >> np.uint64(VALUE_BITS)
    cuts = np.r_[np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]), len(slots)]
    values = slots & np.uint64((1 << VALUE_BITS) - 1)
    parts = [packed(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(buckets[cuts[:-1]].astype(np.int64)), pa.array(parts, pa.binary())], names=["bucket", "slots"])


def marks(slots: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each slot in a bitmap of 2 ** bits: both in its bucket's part (for values, in the bucket's own)."""
    low = bits - SLOT_BITS + VALUE_BITS
    values, part = slots & np.uint64((1 << VALUE_BITS) - 1), (slots >> np.uint64(VALUE_BITS)) << np.uint64(low)
    return part | (values >> np.uint64(VALUE_BITS - low)), part | (mixed(mixed(values + np.uint64(1))) >> np.uint64(64 - low))


def marked_in(bitmap: np.ndarray, slots: np.ndarray, bits: int) -> np.ndarray:
    """Places of the slots both of whose bits are set."""
    is_set = lambda at: (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
    hit = np.flatnonzero(is_set(marks(slots, bits)[0]))
    return hit[is_set(marks(slots[hit], bits)[1])]


def phrase_counts(documents: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (4, 5, 6), support: int = 5) -> DataFrame:
    """(gram, n): informative phrases by the number of records that have them; each record counts a phrase once.

    Boilerplate goes before anything is shuffled.  Phrases are first counted by the upper SLOT_BITS of their 64-bit hashes, each
    record's distinct ones, which travel packed (`packed`); strings are made only for those that may have the support, and
    counted again as strings, so slots that phrases share do no harm.  The slots that may are broadcast as a bitmap with two
    bits set for each: 16 to 32 bits a slot up to 2 ** MOST_BITS bits, beyond that fewer, down to 8; then in parts, one pass over
    the texts each.
    """
    texts = documents.select(phrase_norm(F.col(text)).alias("t"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for words in (w for batch in batches for w in in_runs(batch.column("t"))):
            # a text's number above the slot: each text's distinct ones are kept
            slots = [(words.text[at].astype(np.uint64) << np.uint64(SLOT_BITS)) | (h >> np.uint64(64 - SLOT_BITS)) for _, at, h in words.sequences(sizes)]
            held.append(distinct(np.concatenate(slots or [np.empty(0, np.uint64)])) & np.uint64((1 << SLOT_BITS) - 1))
            n += len(held[-1])
            if n >= PACKED_SLOTS:
                yield bucketed(np.concatenate(held))
                held, n = [], 0
        if n:
            yield bucketed(np.concatenate(held))

    def counted(rows: pa.Table) -> pa.Table:
        slots = np.sort(np.concatenate([unpacked(b.as_py()) for b in rows.column("slots")]))
        firsts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        often = slots[firsts[np.diff(np.r_[firsts, len(slots)]) >= support]]
        return pa.table({"bucket": rows.column("bucket").slice(0, 1), "n": pa.array([len(often)], pa.int64()), "often": pa.array([packed(often)], pa.binary())})

    counts = texts.mapInArrow(hashed, "bucket long, slots binary").groupBy("bucket").applyInArrow(counted, "bucket long, n long, often binary")
    often = materialize(counts, "phrases")
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0].n
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * total).bit_length()))
    passes = max(1, -(-8 * total // (1 << MOST_BITS)))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, slots in zip(batch.column("bucket").to_pylist(), batch.column("often"), strict=True):
                own = np.zeros(1 << (bits - SLOT_BITS + VALUE_BITS), bool)
                for places in marks(unpacked(slots.as_py()), bits):
                    own[places] = True
                yield pa.RecordBatch.from_pydict({"bucket": [bucket], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    def grams(part: np.ndarray) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            for words in (w for batch in batches for w in in_runs(batch.column("t"))):
                found = [(at[hit], at[hit] + n - 1) for n, at, h in words.sequences(sizes) for hit in [marked_in(wanted, h >> np.uint64(64 - SLOT_BITS), bits)]]
                if not found:
                    continue
                first, last = (np.concatenate(x) for x in zip(*found, strict=True))
                each = words.strings(first, last).dictionary_encode()
                codes = distinct(words.text[first] * np.int64(len(each.dictionary)) + each.indices.to_numpy()) % max(1, len(each.dictionary))
                own = pa.RecordBatch.from_arrays([each.dictionary, pa.array(np.bincount(codes, minlength=len(each.dictionary)))], names=["gram", "n"])
                for at in range(0, own.num_rows, 1 << 16):
                    some = own.slice(at, 1 << 16)
                    yield pa.RecordBatch.from_arrays([some.column("gram").cast(pa.string()), some.column("n")], names=["gram", "n"])

        return texts.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= support)

    whole = None
    for k in range(passes):
        # a phrase's bucket is part of its bit's place, so it is found in one pass only
        part = np.zeros((1 << bits) // 8, np.uint8)
        width = len(part) >> (SLOT_BITS - VALUE_BITS)
        for r in often.filter((F.pmod("bucket", F.lit(passes)) == k) & (F.col("n") > 0)).mapInArrow(marked, "bucket long, bits binary").collect():
            part[r.bucket * width : (r.bucket + 1) * width] = np.frombuffer(r.bits, np.uint8)
        got = grams(part)
        whole = got if whole is None else whole.unionByName(got)
    return whole


def top_phrases(counts: DataFrame, keep: int = 25, overlap: float = 0.75, page: int = 500) -> list[tuple[str, int]]:
    """Greedy choice of phrases by records, then length, then text: one goes if its content words overlap a kept one's too much.

    The counts are made once.  The first 16 pages of `page` phrases are their best, without a sort of the others; only where
    the last choice isn't among them are all ranked, once over ranges, and the driver reads on, 16 pages at a time.  It holds
    these and at most `keep` word sets.
    """
    order, width = ["__n", "__len", "gram"], 16 * page
    rows = materialize(counts, "phrases-counted").withColumns({"__n": -F.col("n"), "__len": -F.length("gram")})
    kept: list[tuple[str, int, set]] = []

    def choose(found: list) -> bool:
        """Whether to read on."""
        for r in found:
            words = {w for w in r["gram"].split(" ") if w not in BOILERPLATE}
            if len(kept) < keep and all(len(words & k) / max(1, min(len(words), len(k))) < overlap for _, _, k in kept):
                kept.append((r["gram"], r["n"], words))
        return len(kept) < keep and len(found) == width

    if choose(rows.orderBy(*order).limit(width).select("gram", "n").collect()):
        ranked, at = materialize(global_rank(rows, order, "__rank").select("gram", "n", "__rank"), "phrases-ranked"), width
        while choose(sorted(ranked.filter((F.col("__rank") > at) & (F.col("__rank") <= at + width)).collect(), key=lambda r: r["__rank"])):
            at += width
    return [(g, n) for g, n, _ in kept]


def duplicate_census(df: DataFrame, text: str) -> DataFrame:
    """One row: texts that occur more than once, rows in them, redundant rows, rows in the largest group."""
    groups = df.groupBy(F.md5(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("repeated"), F.coalesce(F.sum("n"), F.lit(0)).alias("involved"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def body_groups(df: DataFrame, key: str, body: Column, label: str) -> DataFrame:
    """Groups of equal bodies: smallest key, rows, distinct labels, whether labels conflict.  No list of members is built."""
    groups = df.groupBy(F.md5(F.coalesce(body, F.lit(""))).alias("h")).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(label)).alias("labels"))
    return groups.filter("n > 1").select("first_key", "n", "labels", (F.col("labels") > 1).alias("conflict"))


def records_with(rows: DataFrame, key: str, texts: str) -> DataFrame:
    """(text, n_records): in how many records each text of the lists `texts` occurs, once for each record."""
    items = rows.select(key, F.explode(F.array_distinct(texts)).alias("text")).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return items.groupBy("text").agg(F.count_distinct(key).alias("n_records"))


def class_distribution(df: DataFrame, label: str, small: int = 25) -> DataFrame:
    """(label, n, percent, small)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(label, "n", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 4).alias("percent"), (F.col("n") < small).alias("small"))


def log_odds(documents: DataFrame, text: str, label: str, top: int = 20, prior: float = 0.01) -> DataFrame:
    """Z-scores of terms per class by log-odds ratios with an informative Dirichlet prior; the best `top` of each class."""
    terms = documents.select(label, F.explode(bm25_tokens(F.col(text))).alias("term")).groupBy(label, "term").agg(F.count(F.lit(1)).alias("y"))
    overall = terms.groupBy("term").agg(F.sum("y").alias("total"))
    sizes = terms.groupBy(label).agg(F.sum("y").alias("n_class"))  # one row per class
    whole = overall.agg(F.sum("total").alias("n_all"), F.sum(F.col("total") + prior).alias("alpha0"))
    rows = terms.join(overall, "term").join(F.broadcast(sizes), label).crossJoin(F.broadcast(whole))  # one row
    a = F.col("total") + prior
    yi, yj, ni, nj = F.col("y"), F.col("total") - F.col("y"), F.col("n_class"), F.col("n_all") - F.col("n_class")
    delta = F.log((yi + a) / (ni + F.col("alpha0") - yi - a)) - F.log((yj + a) / (nj + F.col("alpha0") - yj - a))
    z = F.round(delta / F.sqrt(1 / (yi + a) + 1 / (yj + a)), 6)
    order = W.partitionBy(label).orderBy(F.desc("z"), "term")
    return rows.select(label, "term", "y", z.alias("z")).withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= top)


def literal_overlap(df: DataFrame, text: str, own: str, names: list[str]) -> DataFrame:
    """One row: share of texts with a word that starts like one of the own category's name, and of any category's."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), F.lit(0))
    has = lambda s: F.exists(words, lambda w: F.exists(s, lambda x: F.startswith(w, x)))
    every = F.flatten(F.array(*[stems(F.lit(n)) for n in names]))
    return df.agg(F.round(F.avg(has(stems(F.col(own))).cast("double")), 6).alias("own"), F.round(F.avg(has(every).cast("double")), 6).alias("any"))


def monotone_sections(matches: DataFrame, doc: str, position: str, index: str) -> DataFrame:
    """Headings kept in a forward walk: the first must be number 0, and each later one exceed all before; with where each section ends."""
    order = W.partitionBy(doc).orderBy(position)
    highest = F.max(index).over(order.rowsBetween(W.unboundedPreceding, -1))
    first = F.min(F.when(F.col(index) == 0, F.col(position))).over(W.partitionBy(doc))
    rows = matches.withColumn("__first", first).filter(F.col(position) >= F.col("__first")).withColumn("__high", highest)
    kept = rows.filter(F.col("__high").isNull() | (F.col(index) > F.col("__high"))).drop("__first", "__high")
    return kept.withColumn("section_end", F.lead(position).over(order))


def first_pages(pages: DataFrame, doc: str, text: str, page: str) -> DataFrame:
    """Of pages of a document with equal text only the first."""
    order = W.partitionBy(doc, "__h").orderBy(page)
    return pages.withColumn("__h", F.md5(F.coalesce(F.col(text), F.lit("")))).withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__h", "__k")


def changed_binding(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both tables whose value differs, with both values."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return a.join(b, key).filter("before <> after")


#: Passages' anchors are broadcast up to this many rows; passages of under three pieces are searched for in blocks of so many.
BROADCAST_ANCHORS, SHORT_PASSAGES = 1_000_000, 1_000


def runs_of(hashes: Column, n: int) -> Column:
    """Hashes of all runs of n neighbours, from the hashes of single pieces."""
    places = F.when(F.size(hashes) >= n, F.sequence(F.lit(0), F.size(hashes) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)], F.lit(n)))


def containing(texts: DataFrame, passages: DataFrame, key: str, passage: str, text: str = "text", longest: int = 4) -> DataFrame:
    """(passage, key) of the texts that contain a passage whole, character by character.  Both sides have the column `text`.

    Between its first and last space a passage consists of pieces that stand in the text as they are.  The hash of up to
    `longest` of them, its anchor, meets the distinct hashes of the texts' runs in an equi-join that carries keys only;
    texts come back by key for those that met, and are compared character by character.  Passages without an inner piece
    are searched for in every text, in blocks.  A row whose text contains a passage is one row, repeated keys and null
    keys too; null and empty passages are in nothing.
    """
    pieces = F.split(F.col(text), " ")
    inner = F.when(F.size(pieces) > 2, F.slice(pieces, F.lit(2), F.size(pieces) - 2)).otherwise(F.array().cast("array<string>"))
    wanted = passages.filter(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(passage).alias("__id"), F.col(text).alias("__passage"), fenced(F.transform(inner, lambda w: F.xxhash64(w))).alias("__i"))
    anchor = F.coalesce(*[F.when(F.size("__i") >= n, runs_of(F.slice("__i", F.lit(1), F.lit(n)), n)[0]) for n in range(longest, 0, -1)])
    wanted = materialize(wanted.select("__id", "__passage", F.least(F.size("__i"), F.lit(longest)).alias("__n"), anchor.alias("__h")), "passages")
    anchors, short = wanted.filter("__n > 0"), wanted.filter("__n = 0").select("__id", "__passage")
    lengths = {r["__n"]: r["count"] for r in wanted.groupBy("__n").count().collect()}  # at most `longest` and 0
    n_short, n_anchors = lengths.pop(0, 0), sum(lengths.values())
    out = []
    if lengths:
        rows = texts.select(F.col(key).alias("__k"), fenced(F.transform(pieces, lambda w: F.xxhash64(w))).alias("__w"))
        met = rows.select("__k", F.explode(F.array_distinct(F.flatten(F.array(*[runs_of(F.col("__w"), n) for n in lengths])))).alias("__h"))
        few = n_anchors <= BROADCAST_ANCHORS
        ids = anchors.select("__id", "__h")
        met = materialize(met.join(F.broadcast(ids) if few else ids, "__h").select("__id", "__k").distinct(), "passages-met")
        found = texts.select(key, F.col(text).alias("__t")).join(met, F.col(key).eqNullSafe(F.col("__k")))
        own = anchors.select(F.col("__id").alias("__id2"), "__passage")
        found = found.join(F.broadcast(own) if few else own, F.col("__id").eqNullSafe(F.col("__id2"))).filter(F.contains("__t", F.col("__passage")))
        out.append(found.select(F.col("__id").alias(passage), key))
    if n_short:
        numbered = global_rank(short, ["__passage"], "__n")
        rows = texts.select(key, F.col(text).alias("__t"))
        for at in range(0, n_short, SHORT_PASSAGES):
            block = numbered.filter((F.col("__n") > at) & (F.col("__n") <= at + SHORT_PASSAGES)).select("__id", "__passage")
            out.append(rows.join(F.broadcast(block), F.contains("__t", F.col("__passage"))).select(F.col("__id").alias(passage), key))
    if not out:
        return passages.select(passage).limit(0).crossJoin(texts.select(key).limit(0))  # two empty sides
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
