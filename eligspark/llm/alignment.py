"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids meet there.

A text is cut at single spaces between two other characters, where both tokenizers start a new token; the segments
repeat, so each process aligns a segment once and remembers it.  Within a segment the B tokens are a static interval
index (sorted starts and ends); every A token is a stabbing query answered by two bisections, and a gap between A
tokens that no B token spans ends a group.

The links of a document are kept as packed distinct id pairs with their counts.  Document counts of pairs are added up
per task, then by Spark; the pair table is broadcast in slices of A ids of a bounded number of pairs, one pass over
the packed links each.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligspark.llm.common import slices
from eligspark.storage import materialize

#: Pairs of ids in one broadcast (13 bytes each).
MOST_PAIRS = 5_000_000
#: Segments that a process remembers, and the longest that it does (characters).
MOST_SEGMENTS, LONGEST_REMEMBERED = 400_000, 64
#: Texts worked on at once, in characters.
SLICE_CHARACTERS = 2_000_000

#: A space between two characters that aren't white space.
SEAM = re.compile(r"(?<=\S) (?=\S)")
ODD_SPACE = re.compile(r"\s\s|\s\Z")
#: Characters whose class (letter, number, other) may differ between the Unicode versions of two libraries.
EXOTIC = re.compile("[^\t-\u024f\u2010-\u2027\u20ac]")

PIECES = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def byte_of_char() -> dict[str, int]:
    """The byte that a printable stand-in of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Aligner:
    """Aligns segments by tokenizers A (a tokenizers JSON) and B (a sentencepiece model)."""

    def __init__(self, definition_a: str, model_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        vocabulary, back = self.a.get_vocab(with_added_tokens=True), byte_of_char()
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, k in vocabulary.items():
            self.bytes_a[k] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes((int(p[3:5], 16),)) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.n_b = len(pieces)
        # a piece that spans a space ahead of which there is something else would make the seams unsafe
        self.seams = not any("▁" in p.lstrip("▁") for p in pieces)
        self.ranks = self.as_ranks(json.loads(definition_a))
        top = max(len(self.bytes_a), self.n_b)
        self.shown = np.array([f"{k}{mark}" for mark in ",|;" for k in range(top)], object)
        self.top = top
        self.known: dict[str, int] = {}
        self._empty()

    def as_ranks(self, definition: dict):
        """The same tokenizer as a table of ranks, which is faster, where its merges make ids in order; else None."""
        import tiktoken

        special = {t["content"] for t in definition["added_tokens"]}
        ranks = {x: k for k, x in enumerate(self.bytes_a) if x and x.decode(errors="replace") not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in definition["model"]["merges"]]
        vocabulary = definition["model"]["vocab"]
        in_order = definition["normalizer"] is None and len(ranks) == 256 + len(merges) and all(vocabulary[x + y] == 256 + k for k, (x, y) in enumerate(merges))
        plain = definition["pre_tokenizer"]
        if not in_order or plain["type"] != "ByteLevel" or not plain["use_regex"] or plain["add_prefix_space"]:
            return None
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _empty(self) -> None:
        self.known.clear()
        self.text: list[str | None] = []
        self.counts = np.zeros((1 << 14, 4), np.int64)
        self.start = np.zeros((1 << 14) + 1, np.int64)
        self.pairs, self.times = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)

    def _keep(self, counts: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, times: np.ndarray, shown: list) -> int:
        """Append the results of segments to the growing arrays; the number of the first."""
        k, n = len(self.text), len(shown)
        while k + n > len(self.counts):
            self.counts, self.start = np.resize(self.counts, (2 * len(self.counts), 4)), np.resize(self.start, 2 * len(self.counts) + 1)
        at = self.start[k]
        while at + len(pairs) > len(self.pairs):
            self.pairs, self.times = np.resize(self.pairs, 2 * len(self.pairs)), np.resize(self.times, 2 * len(self.times))
        self.counts[k : k + n], self.start[k + 1 : k + n + 1] = counts, at + np.cumsum(sizes)
        self.pairs[at : at + len(pairs)], self.times[at : at + len(pairs)] = pairs, times
        self.text.extend(shown)
        return k

    def segments(self, text: str) -> list[str]:
        """Segments of space + text, each without the space it starts with."""
        whole = " " + text
        if not self.seams:
            return [text]
        if ODD_SPACE.search(whole) is None:
            return whole.split(" ")[1:]
        return [s[1:] for s in SEAM.sub("\0 ", whole).split("\0")] if "\0" not in whole and whole[1:2].strip() else [text]

    def add(self, segments: list[str]) -> dict[str, int]:
        """Encode, align and store segments; their numbers."""
        joined = [s for s in segments if s and EXOTIC.search(s) is None and not s[0].isspace() and not s[-1].isspace()] if self.seams and self.ranks else []
        some = set(joined)
        rest = [s for s in segments if s not in some]
        chunks, ids_a, ids_b = [joined[k : k + 256] for k in range(0, len(joined), 256)], [], []
        if chunks:
            texts = [" ".join(c) for c in chunks]
            ids_a = np.concatenate([self.ranks.encode_to_numpy(" " + t) for t in texts]).astype(np.int64)
            ids_b = np.array([k for ids in self.b.encode(texts, num_threads=1) for k in ids], np.int64)
            if not self.same(ids_a, ids_b, "".join(" " + t for t in texts)):
                rest, joined = segments, []
        out: dict[str, int] = {}
        if joined:
            out |= self.kept(joined, ids_a, ids_b)
        if rest:
            encoded_a = [e.ids for e in self.a.encode_batch([" " + s for s in rest], add_special_tokens=False)]
            encoded_b = self.b.encode(rest, num_threads=1)
            good = [bool(s) and self.same(x, y, " " + s) for s, x, y in zip(rest, encoded_a, encoded_b)]
            fine = [k for k, ok in enumerate(good) if ok]
            if fine:
                flat = lambda encoded: np.array([i for k in fine for i in encoded[k]], np.int64)
                out |= self.kept([rest[k] for k in fine], flat(encoded_a), flat(encoded_b))
            bad = [s for s, ok in zip(rest, good) if not ok]
            if bad:
                none = np.empty(0, np.uint32)
                at = self._keep(np.zeros((len(bad), 4), np.int64), np.zeros(len(bad), np.int64), none, none, [None if s else "" for s in bad])
                out |= {s: at + k for k, s in enumerate(bad)}
        return out

    def same(self, a, b, text: str) -> bool:
        """Whether the tokens of A and of B join to the text's bytes."""
        want = text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want

    def kept(self, segments: list[str], a: np.ndarray, b: np.ndarray) -> dict[str, int]:
        """Align segments whose tokens of A and B follow each other in `a` and `b`, and store what each links.

        B's sorted starts and ends are the index.  An A token's overlapping B tokens run from the first that ends behind
        its start to the last that starts before its end, found by bisection; a gap between A tokens is spanned if the
        last of the one reaches the first of the next, and ends a group if not.  Segments end groups by themselves.
        """
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        starts_a, starts_b = ends_a - self.length_a[a], ends_b - self.length_b[b]
        first = np.searchsorted(ends_b, starts_a, "right")
        last = np.searchsorted(starts_b, ends_a, "left") - 1
        free = np.flatnonzero(last[:-1] < first[1:]) + 1
        from_a, from_b = np.r_[0, free, len(a)], np.r_[0, first[free], len(b)]
        size_a, size_b = np.diff(from_a), np.diff(from_b)
        ends = np.cumsum([len(s.encode()) + 1 for s in segments])
        seg_a, seg_b = (np.r_[0, np.searchsorted(x, ends, "right")] for x in (ends_a, ends_b))
        seg_group = np.searchsorted(from_a, seg_a)
        links = np.r_[0, np.cumsum(size_a * size_b)]
        counts = np.column_stack([np.diff(seg_a), np.diff(seg_b), np.diff(seg_group), np.diff(links[seg_group])])
        pairs, times, held = self.linked(a, b, from_a, from_b)
        sizes = np.diff(np.r_[0, np.cumsum(held)][seg_group])
        # the groups' text: tokens of A, then of B, group by group, each with the mark that follows it
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[from_a[1:] - 1], mark_b[from_b[1:] - 1] = self.top, 2 * self.top
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(from_b[:-1], size_a)] = a + mark_a
        order[np.arange(len(b)) + np.repeat(from_a[1:], size_b)] = b + mark_b
        words, edges = self.shown[order].tolist(), (seg_a + seg_b).tolist()
        at = self._keep(counts, sizes, pairs, times, ["".join(words[p:q]) for p, q in zip(edges, edges[1:])])
        return {s: at + k for k, s in enumerate(segments)}

    def linked(self, a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, times, pairs a group) of all groups; a group of very many links gives its distinct pairs only."""
        size_a, size_b = np.diff(from_a), np.diff(from_b)
        held = size_a * size_b
        large = np.flatnonzero(held > 4096)
        wide = np.repeat(np.where(held > 4096, 0, size_b), size_a)
        within = np.arange(int(wide.sum())) - np.repeat(np.r_[0, np.cumsum(wide)[:-1]], wide)
        pairs = np.repeat(a, wide) * self.n_b + b[np.repeat(np.repeat(from_b[:-1], size_a), wide) + within]
        times = np.ones(len(pairs), np.int64)
        if len(large):
            held[large] = 0
            parts, cut, before = [], 0, np.r_[0, np.cumsum(held)]
            for g in large.tolist():
                u, m = np.unique(a[from_a[g] : from_a[g + 1]], return_counts=True)
                v, n = np.unique(b[from_b[g] : from_b[g + 1]], return_counts=True)
                parts += [(pairs[cut : before[g]], times[cut : before[g]]), ((u[:, None] * self.n_b + v).ravel(), np.outer(m, n).ravel())]
                cut, held[g] = before[g], len(u) * len(v)
            parts.append((pairs[cut:], times[cut:]))
            pairs, times = (np.concatenate(x) for x in zip(*parts))
        return pairs.astype(np.uint32), times.astype(np.uint32), held

    def numbers(self, texts: list[list[str]]) -> list[list[int]]:
        """Numbers of the segments of each text; new ones are encoded together."""
        if len(self.text) > MOST_SEGMENTS:
            self._empty()
        known = self.known
        new = list(dict.fromkeys(s for t in texts for s in t if s not in known))
        made = self.add(new) if new else {}
        out = [[made[s] if s in made else known[s] for s in t] for t in texts]
        known.update((s, k) for s, k in made.items() if len(s) <= LONGEST_REMEMBERED)
        return out

    def texts(self, texts: list[str]) -> list[tuple]:
        """For each text: (n_a, n_b, n_groups, n_links, groups_sha256, packed pairs, packed times)."""
        split = self.numbers([self.segments(t) if t else [] for t in texts])
        sizes = np.array([len(s) for s in split])
        flat = np.fromiter((k for s in split for k in s), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        totals = np.column_stack([np.bincount(owner, weights=self.counts[flat, k], minlength=len(texts)) for k in range(4)]).astype(np.int64)
        n = self.start[flat + 1] - self.start[flat]
        at = np.repeat(self.start[flat] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
        keys = (np.repeat(owner, n) << 32) | self.pairs[at].astype(np.int64)
        times = self.times[at].astype(np.int64)
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        times = np.add.reduceat(times, first) if len(first) else times
        keys = keys[first]
        edges = np.searchsorted(keys >> 32, np.arange(len(texts) + 1))
        pairs, times = (keys & 0xFFFFFFFF).astype("<u4"), times.astype("<u4")
        out = []
        for k, numbers in enumerate(split):
            shown = [self.text[i] for i in numbers]
            if None in shown or not numbers:
                out.append((0, 0, 0, 0, "", b"", b""))
                continue
            digest = hashlib.sha256("".join(shown)[:-1].encode()).hexdigest()
            part = slice(edges[k], edges[k + 1])
            out.append((*totals[k].tolist(), digest, pairs[part].tobytes(), times[part].tobytes()))
        return out


@lru_cache(maxsize=1)
def aligner_of(definition: str, model: bytes) -> Aligner:
    """One aligner per worker process, so that later tasks find segments that are aligned already."""
    return Aligner(definition, model)


def linked_pairs(documents: DataFrame, definition_a: str, model_b: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of `documents`: its counts, its groups' digest and its packed links (sorted distinct A * size of B + B, and how often)."""
    shared = documents.sparkSession.sparkContext.broadcast((definition_a, model_b))
    names = [part.split()[0] for part in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(*shared.value)
        for batch in slices(batches, 500):
            texts, at = [t or "" for t in batch.column("text").to_pylist()], 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= SLICE_CHARACTERS:
                    size += len(texts[end])
                    end += 1
                rows = list(zip(*aligner.texts(texts[at:end])))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds))], names=names)
                at = end

    rows = documents.select(F.monotonically_increasing_id().alias("rid"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, PIECES)


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """a, pair, count, best: in how many rows of `links` a pair occurs, and whether its A id has no pair with more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, held = np.empty(0, np.uint32), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.empty(0, np.uint32), np.empty(0, np.int64))
            both, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            return both, np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].astype(np.int64)), pa.array(counts[at : at + 100_000])], names=["pair", "count"])

        for batch in batches:
            part = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), "<u4")
            waiting.append(part)
            held += len(part)
            if held > 4_000_000:
                keys, counts = merged()
                waiting, held = [], 0
                if len(keys) > 4_000_000:
                    yield from rows()
                    keys, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        keys, counts = merged()
        yield from rows()

    added = links.select("pairs").mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    added = materialize(added.withColumn("a", F.floor(F.col("pair") / n_b).cast("int")), "alignment-pairs")
    top = added.groupBy("a").agg(F.max("count").alias("top"))  # at most the size of A's vocabulary
    return added.join(F.broadcast(top), "a").select("a", "pair", "count", (F.col("count") == F.col("top")).alias("best"))


def slices_of_a(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of A ids that hold at most `most` pairs each (one id's pairs stay together: at most B's vocabulary)."""
    out, begin, held = [], 0, 0
    for a, n in sorted(tuple(r) for r in counts.groupBy("a").count().collect()):
        if held and held + n > most:
            out.append((begin, a))
            begin, held = a, 0
        held += n
    return [*out, (begin, 1 << 31)]


def with_counts(links: DataFrame, counts: DataFrame, span: tuple[int, int], n_b: int, keep: list[str]) -> DataFrame:
    """`keep` of links, with n_best and count_sum over the links whose A id is in the span."""
    table = counts.filter((F.col("a") >= span[0]) & (F.col("a") < span[1])).select("pair", "count", "best").toArrow()
    pair, n, best = (table.column(k).to_numpy() for k in ("pair", "count", "best"))
    order = np.argsort(pair)
    shared = links.sparkSession.sparkContext.broadcast((pair[order].astype(np.uint32), n[order], best[order]))
    low, high = span[0] * n_b, min(span[1] * n_b, 1 << 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in slices(batches, 2000):
            packed = batch.column("pairs").to_pylist()
            sizes = np.array([len(p) // 4 for p in packed])
            keys, times = np.frombuffer(b"".join(packed), "<u4"), np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
            owner = np.repeat(np.arange(len(packed)), sizes)
            mine = (keys >= low) & (keys < high) if low or high < 1 << 32 else np.ones(len(keys), bool)
            keys, times, owner = keys[mine], times[mine], owner[mine]
            place = np.searchsorted(pair, keys)
            edges = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(packed)))]
            sums = [np.r_[0, np.cumsum(x)] for x in (np.where(best[place], times, 0), n[place] * times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(np.diff(x[edges])) for x in sums)], names=[*keep, "n_best", "count_sum"])

    kinds = {part.split()[0]: part for part in PIECES.split(", ")}
    return links.select(*keep, "pairs", "times").mapInArrow(run, ", ".join([*(kinds[k] for k in keep), "n_best long", "count_sum long"]))


def align(documents: DataFrame, definition_a: str, model_b: bytes, most_pairs: int = MOST_PAIRS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `documents`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Space + text is encoded by both tokenizers without special tokens.  Null and empty texts, and those whose tokens of A
    or B don't join to space + text again, have no tokens: zeros and an empty digest.  Every row counts as a document of
    its own, repeated ones too; null ids stay null; of pairs with equal counts all are best; very long texts are aligned
    whole, segment by segment; an empty table gives no rows; other columns are not read.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_proto=model_b).get_piece_size()
    links = materialize(linked_pairs(documents, definition_a, model_b, id_column, text_column), "alignment-links")
    counts = materialize(pair_counts(links, n_b), "alignment-counts")
    spans = slices_of_a(counts, most_pairs)
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if len(spans) == 1:
        return with_counts(links, counts, spans[0], n_b, kept)
    parts = [materialize(with_counts(links, counts, span, n_b, ["rid"]), "alignment-part") for span in spans]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    sums = whole.groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return links.select("rid", *kept).join(sums, "rid").drop("rid")
