"""Repeated byte passages by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller
id.  The work is dealt out by content: in each window of 50 bytes the 24-byte piece of the
smallest hash is its anchor, so equal windows have equal anchors wherever they stand.

1. Anchors are counted over all texts; only those in two or more different texts matter.
2. Consecutive windows with one anchor form a fragment.  Fragments with a repeated anchor go to
   that anchor's group (equal ones combined before they travel, so that a passage of very many
   documents doesn't meet in one task), in order of document id, where equal fragments are
   recognised as they stream by.
3. The different fragments of many groups are joined into one text.  Its suffixes are sorted by
   their first 56 bytes, and intervals of the Burrows-Wheeler transform are expanded backwards,
   breadth first: step l finds every boundary between neighbouring suffixes whose common
   prefix has exactly l bytes.  After step 49 the boundaries that are not set separate nothing:
   the windows between two set boundaries are one string of 50 bytes, and the smallest
   document of each such class decides.
4. Byte ranges meet by document and are cut out of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligspark.llm.common import MIX_A, MIX_B, ODD, mix64, slices, text_bytes
from eligspark.storage import materialize

MIX_C = np.uint64(0xD6E8FEB86659FD93)
LEAST = 50
PIECE = 24
SPAN = LEAST - PIECE + 1
CHUNK_BYTES = 2 << 20
FLUSH = 1 << 20
#: Repeated anchors (8 bytes each) and byte ranges are broadcast up to these bounds; beyond them joins shuffle.
BROADCAST_ANCHORS = 8_000_000
BROADCAST_BYTES = 48 << 20
#: Fragments of anchors that so many texts have are combined before they travel.
COMMON = 16
#: Bytes of fragments in one transform.
TRANSFORM_BYTES = 1 << 20


def anchored_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, anchor hash, first window, last window) of every run of windows with one anchor; offsets within texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    n = int(lengths.sum())
    none = np.empty(0, np.int64)
    if n < LEAST:
        return none, none.astype(np.uint64), none, none
    data = b"".join(texts) + bytes(PIECE)
    loads = np.ndarray((n + PIECE - 7,), "<u8", data, strides=(1,))
    m = n - PIECE + 1
    h = loads[:m] * ODD
    h ^= loads[8 : m + 8] * MIX_A
    h += loads[16 : m + 16] * MIX_C
    h ^= h >> np.uint64(29)
    h *= MIX_B
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if SPAN > width:
        key = np.minimum(key[: len(key) - (SPAN - width)], key[SPAN - width :])
    whole = np.zeros(n + 1, np.int32)
    long = lengths >= LEAST
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, (starts + lengths - LEAST + 1)[long], -1)
    windows = np.flatnonzero(np.cumsum(whole[:-1]))
    anchor = (key[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(windows)] - 1
    a = windows[first]
    owner = np.searchsorted(starts, a, side="right") - 1
    # empty texts share a start with the text after them; the search takes the last, which has the windows
    at = anchor[first]
    name = np.zeros(len(at), np.uint64)
    for k in range(0, PIECE, 8):
        name = mix64(name + np.ascontiguousarray(loads[at + k]))
    return owner, name, a - starts[owner], windows[last] - starts[owner]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) in chunks of about CHUNK_BYTES, whole texts each."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK_BYTES):
            held += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def split_name(name: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and 32-bit hash of anchors (names that agree in both count as the same, which can only add work)."""
    return ((name & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64), (name >> np.uint64(32)).astype(np.uint32)


def joint_name(part: np.ndarray, short: np.ndarray) -> np.ndarray:
    return (short.astype(np.uint64) << np.uint64(32)) | part.astype(np.uint64)


def anchor_lists(texts: DataFrame, parts: int) -> DataFrame:
    """(part, handles, counts, hashes): the distinct anchors of different texts, packed by part."""

    def packed(names: list, handles: list) -> pa.RecordBatch:
        part, short = split_name(np.concatenate(names), parts)
        handle = np.concatenate(handles)
        order = np.lexsort((short, handle, part))
        part, short, handle = part[order], short[order], handle[order]
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (handle[1:] != handle[:-1]) | (short[1:] != short[:-1])
        part, short, handle = part[new], short[new], handle[new]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts + 1)).tolist()
        rows = []
        for a, b in zip(edges, edges[1:]):
            starts = np.flatnonzero(np.r_[True, handle[a + 1 : b] != handle[a : b - 1]])
            rows.append((int(part[a]), handle[a:b][starts].tobytes(), np.diff(np.r_[starts, b - a]).astype(np.uint32).tobytes(), short[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.binary()) for k in range(4)], names=["part", "handles", "counts", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names, handles, held = [], [], 0
        for batch in slices(batches):
            fresh = []
            for handle, text in zip(batch.column("handle").to_pylist(), batch.column("text").to_pylist()):
                if len(text) >= LEAST and handle not in seen:
                    seen.add(handle)
                    fresh.append((handle, text))
            for at, some in chunks([t for _, t in fresh]):
                owner, name, _, _ = anchored_runs(some)
                own = np.array([h for h, _ in fresh[at : at + len(some)]], np.int64)
                names.append(name)
                handles.append(own[owner])
                held += len(name)
                if held > FLUSH:
                    yield packed(names, handles)
                    names, handles, held = [], [], 0
        if held:
            yield packed(names, handles)

    return texts.select("handle", "text").mapInArrow(run, "part int, handles binary, counts binary, hashes binary")


def expanded(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, handle, repeated) of one part's anchors, sorted by hash; repeated: in two or more texts."""
    short = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["hashes"]])
    handle = np.concatenate([np.repeat(np.frombuffer(h, np.int64), np.frombuffer(c, np.uint32)) for h, c in zip(pdf["handles"], pdf["counts"])])
    order = np.argsort(short, kind="stable")
    short, handle = short[order], handle[order]
    starts = np.flatnonzero(np.r_[True, short[1:] != short[:-1]])
    low, high = np.minimum.reduceat(handle, starts), np.maximum.reduceat(handle, starts)
    return short, handle, np.repeat(low != high, np.diff(np.r_[starts, len(short)]))


def repeated_anchors(lists: DataFrame) -> DataFrame:
    """(part, hashes, common, n): the anchors of each part that two or more different texts have, and which of them COMMON texts have."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        short, _, repeated = expanded(pdf)
        kept, texts = np.unique(short[repeated], return_counts=True)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "hashes": [kept.tobytes()], "common": [(texts >= COMMON).tobytes()], "n": [len(kept)]})

    return lists.groupBy("part").applyInPandas(run, "part int, hashes binary, common binary, n long")


def repeated_by_text(lists: DataFrame) -> DataFrame:
    """(handle, repeated): each text's repeated anchors, packed; for corpora whose repeated anchors are too many to broadcast."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        short, handle, repeated = expanded(pdf)
        short, handle = short[repeated], handle[repeated]
        order = np.argsort(handle, kind="stable")
        short, handle = short[order], handle[order]
        starts = np.flatnonzero(np.r_[True, handle[1:] != handle[:-1]]) if len(handle) else np.empty(0, np.int64)
        names = joint_name(np.full(len(short), pdf["part"].iloc[0]), short)
        return pd.DataFrame({"handle": handle[starts], "names": [x.tobytes() for x in np.split(names, starts[1:])] if len(starts) else []})

    rows = lists.groupBy("part").applyInPandas(run, "handle long, names binary")
    return rows.groupBy("handle").agg(F.array_join(F.transform(F.collect_list("names"), lambda x: F.hex(x)), "").alias("repeated")).select("handle", F.unhex("repeated").alias("repeated"))


FRAGMENTS = "anchor long, doc_id long, handle long, start long, fragment binary, spans binary"
NAMES = ["anchor", "doc_id", "handle", "start", "fragment", "spans"]


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal disjoint ranges of (first, past) rows."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.r_[new[1:] - 1, len(spans) - 1]]], axis=1)


class RangeTable:
    """Byte ranges of texts (doc_id, handle), merged and packed when the table is emptied."""

    def __init__(self):
        self.held: dict[tuple[int, int], list[int]] = {}
        self.size = 0

    def add(self, doc: int, handle: int, first: int, past: int) -> None:
        known = self.held.get((doc, handle))
        if known is None:
            self.held[doc, handle] = [first, past]
        elif known[-2] <= first <= known[-1]:  # as they come in order, most ranges only lengthen the last
            known[-1] = max(known[-1], past)
            return
        else:
            known += (first, past)
        self.size += 1

    def empty(self) -> tuple[list[int], list[int], list[bytes]]:
        """(documents, handles, packed spans)."""
        docs, handles = [k[0] for k in self.held], [k[1] for k in self.held]
        spans = [merged(np.array(v, np.int64).reshape(-1, 2)).tobytes() for v in self.held.values()]
        self.held, self.size = {}, 0
        return docs, handles, spans


class Combiner:
    """Combines equal fragments before they travel: of each only the occurrences in its smallest document so far are kept;
    any other occurrence is known to go at once, whatever further documents hold.  Full tables are emptied into rows."""

    def __init__(self, most: int = 100_000):
        self.most, self.held, self.gone = most, {}, RangeTable()

    def add(self, name: int, doc: int, handle: int, start: int, piece: bytes) -> None:
        known = self.held.get(piece)
        if known is None:
            self.held[piece] = (name, doc, [(handle, start)])
        elif known[1] == doc:
            known[2].append((handle, start))
        elif known[1] < doc:
            self.gone.add(doc, handle, start, start + len(piece))
        else:
            for h, s in known[2]:
                self.gone.add(known[1], h, s, s + len(piece))
            self.held[piece] = (name, doc, [(handle, start)])

    def full(self) -> bool:
        return len(self.held) + self.gone.size > self.most

    def empty(self) -> pa.RecordBatch:
        rows = [(name, doc, h, s, piece, None) for piece, (name, doc, places) in self.held.items() for h, s in places]
        # ranges have no fragment and are dealt by their own text
        rows += [(handle, doc, handle, None, None, spans) for doc, handle, spans in zip(*self.gone.empty())]
        self.held = {}
        kinds = (*[pa.int64()] * 4, pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=NAMES)


def fragments(texts: DataFrame, parts: int, shared) -> DataFrame:
    """Fragments with a repeated anchor; `shared` has the sorted names of all and which are common, or is None where rows
    have their own names (then all are combined)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, common = shared.value if shared is not None else (None, None)
        best: dict[int, int] = {}
        combiner = Combiner()
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "handle", "text")]
            own = batch.column("repeated").to_pylist() if known is None else [None] * batch.num_rows
            rows = []
            for doc, handle, text, mine in zip(*columns, own):
                # of equal texts only the smallest id matters here: the others go as a whole
                if doc is not None and len(text) >= LEAST and best.get(handle, doc + 1) > doc and (known is not None or mine):
                    best[handle] = doc
                    rows.append((doc, handle, text, mine))
            for at, some in chunks([r[2] for r in rows]):
                owner, name, first, last = anchored_runs(some)
                names = joint_name(*split_name(name, parts))
                if known is not None:
                    place = np.searchsorted(known, names)
                    place[place == len(known)] = 0
                    kept = np.flatnonzero(known[place] == names) if len(known) else np.empty(0, np.int64)
                    often = common[place[kept]] if len(kept) else np.empty(0, bool)
                else:
                    edges = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
                    kept = [a + np.flatnonzero(np.isin(names[a:b], np.frombuffer(rows[at + owner[a]][3], np.uint64))) for a, b in zip(edges, [*edges[1:], len(owner)])]
                    kept = np.concatenate(kept) if kept else np.empty(0, np.int64)
                    often = np.ones(len(kept), bool)
                if not len(kept):
                    continue
                docs, handles = np.array([r[0] for r in rows[at : at + len(some)]], np.int64), np.array([r[1] for r in rows[at : at + len(some)]], np.int64)
                rare, kept = kept[~often], kept[often]
                pieces = [some[k][i : j + LEAST] for k, i, j in zip(owner[rare].tolist(), first[rare].tolist(), last[rare].tolist())]
                if pieces:
                    columns = [pa.array(name[rare].view(np.int64)), pa.array(docs[owner[rare]]), pa.array(handles[owner[rare]]), pa.array(first[rare]), pa.array(pieces, pa.binary()), pa.nulls(len(rare), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=NAMES)
                for n, k, i, j in zip(name[kept].view(np.int64).tolist(), owner[kept].tolist(), first[kept].tolist(), last[kept].tolist()):
                    combiner.add(n, rows[at + k][0], rows[at + k][1], i, some[k][i : j + LEAST])
                if combiner.full():
                    yield combiner.empty()
        yield combiner.empty()

    return texts.mapInArrow(run, FRAGMENTS)


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by the first 56 symbols; `symbols` are below 512, and the text counts as followed by zeros."""
    n = len(symbols)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = symbols
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : n + k]
    depth = 7
    while True:
        order = np.argsort(key)
        ordered = key[order]
        if depth >= 56:
            return order
        ranks = np.empty(n, np.uint64)
        ranks[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]]).astype(np.uint64)
        key = ranks * np.uint64(n + 1)
        key[: n - depth if n > depth else 0] += ranks[depth:]
        depth *= 2


def bounded_classes(symbols: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, class starts): True where a suffix shares fewer than `least` symbols with the one before it.

    Zero is the separator; boundaries between suffixes that start with a separator, or that have one among
    their first `least` symbols, mean nothing.
    """
    n = len(symbols)
    order = sorted_suffixes(symbols)
    before = symbols[order - 1]  # the transform; the symbol before the text's first is its last, a separator
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    after = np.full(n, n, np.int64)  # the next row with the same symbol
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    bound = np.zeros(n + 1, bool)
    bound[0] = bound[n] = True
    ends = np.array([n - 1])
    for level in range(least):
        # rows that end a symbol's occurrences inside their interval lead to the ends of the extended intervals
        edges = np.flatnonzero(bound)
        at = np.searchsorted(edges, ends, side="right")
        starts = edges[at - 1]
        sizes = ends - starts + 1
        total = int(sizes.sum())
        if 3 * total > n:
            interval_end = np.full(n, -1, np.int64)
            interval_end[ends] = ends
            span = np.repeat(edges[1:] - 1, np.diff(edges))
            rows = np.flatnonzero((interval_end[span] >= 0) & (after > span))
        else:
            rows = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(total)
            rows = rows[after[rows] > np.repeat(ends, sizes)]
        if level:
            rows = rows[before[rows] != 0]
        found = step[rows]
        found = np.unique(found[~bound[found + 1]])
        if not len(found):
            break
        bound[found + 1] = True
        ends = found
    return order, bound[:n]


def covered_windows(pieces: list[bytes], owners: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """For each piece the starts of its windows that also stand in a piece with a smaller owner."""
    lengths = np.array([len(p) + 1 for p in pieces], np.int64)
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    symbols = raw.astype(np.int16) + 1
    symbols[starts + lengths - 1] = 0
    order, new = bounded_classes(symbols, least)
    piece = np.repeat(np.arange(len(pieces)), lengths)
    left = np.repeat(starts + lengths - 1, lengths) - np.arange(len(symbols))
    owner = np.where(left >= least, owners[piece], np.iinfo(np.int64).max)
    ordered = owner[order]
    first = np.flatnonzero(new)
    least_owner = np.minimum.reduceat(ordered, first)[np.cumsum(new) - 1]
    covered = np.zeros(len(symbols), bool)
    covered[order] = least_owner < ordered
    covered &= left >= least
    hits = np.flatnonzero(covered)
    bounds = np.searchsorted(hits, np.r_[starts, len(symbols)])
    return [hits[a:b] - s for a, b, s in zip(bounds, bounds[1:], starts)]


PACKED = "bucket int, ranges binary"


def merged_rows(rows: np.ndarray) -> np.ndarray:
    """(document, handle, first, past) rows with the ranges of each text maximal and disjoint, in order."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    text = np.cumsum(np.r_[0, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])
    base = text * (int(rows[:, 3].max()) + 2)  # keeps the texts apart on one line
    reach = np.maximum.accumulate(rows[:, 3] + base)
    new = np.flatnonzero(np.r_[True, (rows[1:, 2] + base[1:]) > reach[:-1]])
    out = rows[new]
    out[:, 3] = (reach - base)[np.r_[new[1:] - 1, len(rows) - 1]]
    return out


def removed_ranges(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ranges): packed rows of merged_rows, dealt by document, from fragments."""

    def resolve(pending: list, out: list) -> None:
        """pending: (fragment, smallest document, its occurrences) of different fragments of whole groups."""
        found = covered_windows([p[0] for p in pending], np.array([p[1] for p in pending], np.int64))
        for (_, doc, places), windows in zip(pending, found):
            if len(windows):
                cut = np.flatnonzero(np.diff(windows) > 1)
                spans = list(zip(windows[np.r_[0, cut + 1]].tolist(), windows[np.r_[cut, len(windows) - 1]].tolist()))
                for handle, at in places:
                    for a, b in spans:
                        out += (doc, handle, at + a, at + b + LEAST)

    def differ(group: dict) -> bool:
        """Whether different fragments of the group come from different documents."""
        return len(group) > 1 and len({d for d, _ in group.values()}) > 1

    def packed(out: list, ready: list[np.ndarray]) -> pa.RecordBatch:
        found = merged_rows(np.concatenate([np.array(out, np.int64).reshape(-1, 4), *ready]))
        bucket = (mix64(found[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, bucket = found[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets + 1)).tolist()
        parts = [(int(bucket[a]), found[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts], pa.int32()), pa.array([x[1] for x in parts], pa.binary())], names=["bucket", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, group, pending, held = None, {}, [], 0
        out: list[int] = []
        ready: list[np.ndarray] = []
        for batch in batches:
            known = batch.filter(pc.is_valid(batch.column("spans")))
            if known.num_rows:
                for doc, handle, spans in zip(*(known.column(c).to_pylist() for c in ("doc_id", "handle", "spans"))):
                    pairs = np.frombuffer(spans, np.int64).reshape(-1, 2)
                    ready.append(np.c_[np.full(len(pairs), doc), np.full(len(pairs), handle), pairs])
                batch = batch.filter(pc.is_null(batch.column("spans")))
            for name, doc, handle, start, piece in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "handle", "start", "fragment"))):
                if name != anchor:
                    if differ(group):
                        pending += [(p, d, places) for p, (d, places) in group.items()]
                        held += sum(map(len, group))
                        if held > TRANSFORM_BYTES:
                            resolve(pending, out)
                            pending, held = [], 0
                    anchor, group = name, {}
                same = group.get(piece)
                if same is None:
                    group[piece] = (doc, [(handle, start)])
                elif same[0] < doc:
                    out += (doc, handle, start, start + len(piece))
                else:
                    same[1].append((handle, start))
            if len(out) > 2_000_000:
                yield packed(out, ready)
                out, ready = [], []
        if differ(group):
            pending += [(p, d, places) for p, (d, places) in group.items()]
        if pending:
            resolve(pending, out)
        yield packed(out, ready)

    return rows.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(run, PACKED)


def merged_ranges(rows: DataFrame) -> DataFrame:
    """(doc_id, handle, spans): one row per text, its ranges maximal and disjoint."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = merged_rows(np.frombuffer(b"".join(pdf["ranges"]), np.int64).reshape(-1, 4))
        starts = np.flatnonzero(np.r_[True, (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1])])
        spans = [np.ascontiguousarray(x).tobytes() for x in np.split(found[:, 2:], starts[1:])]
        return pd.DataFrame({"doc_id": found[starts, 0], "handle": found[starts, 1], "spans": spans})

    return rows.groupBy("bucket").applyInPandas(run, "doc_id long, handle long, spans binary")


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_texts(texts: DataFrame, schema: str, with_text: bool) -> DataFrame:
    """Apply packed spans; with the kept bytes as text_kept, or with their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, results = [], [], [], []
            for text, packed, whole in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "whole"))):
                spans = np.array([[0, len(text)]], np.int64) if whole else np.frombuffer(packed or b"", np.int64).reshape(-1, 2)
                kept, at = [], 0
                for a, b in spans.tolist():
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                sizes.append(len(text))
                removed.append(len(text) - len(kept))
                counts.append(len(spans))
                results.append(kept if with_text else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(results, pa.binary() if with_text else pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if with_text else "kept_sha256"]
            )

    return texts.mapInArrow(run, schema)


def remove_repeats(documents: DataFrame, parts: int | None = None, with_text: bool = False, most_anchors: int = BROADCAST_ANCHORS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of `documents` (doc_id, text): doc_id, n_bytes, n_removed, n_spans and kept_sha256 (or the kept bytes).

    Null and empty texts and those under 50 bytes lose nothing.  Of equal texts all but those
    with the smallest id go as a whole.  Rows with a null id have no smaller or larger
    neighbours: they lose nothing and take nothing.  Rows that share an id never cost each other
    bytes; repeated rows give equal rows; an empty table gives no rows; other columns are not read.
    """
    spark = documents.sparkSession
    parts = min(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 31)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("handle"), text_bytes().alias("text"))
    lists = anchor_lists(texts.filter(F.col("doc_id").isNotNull()), parts)
    repeated = materialize(repeated_anchors(lists), "bwt-anchors")
    if (repeated.agg(F.sum("n")).first()[0] or 0) <= most_anchors:
        names, common = [np.empty(0, np.uint64)], [np.empty(0, bool)]
        for r in repeated.toLocalIterator():
            names.append(joint_name(np.full(r["n"], r["part"]), np.frombuffer(bytes(r["hashes"]), np.uint32)))
            common.append(np.frombuffer(bytes(r["common"]), bool))
        names, common = np.concatenate(names), np.concatenate(common)
        order = np.argsort(names)
        shared = spark.sparkContext.broadcast((names[order], common[order]))
        candidates = texts
    else:
        shared = None
        candidates = texts.join(materialize(repeated_by_text(lists), "bwt-by-text"), "handle")
    ranges = materialize(merged_ranges(removed_ranges(fragments(candidates, parts, shared), parts)), "bwt-ranges")

    slim = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("handle"), F.crc32(text_bytes()).alias("crc"), F.octet_length(F.coalesce(F.col("text"), F.lit(""))).alias("n")
    ).filter(F.col("doc_id").isNotNull() & (F.col("n") >= LEAST))
    slim = materialize(slim, "bwt-slim")
    first = slim.groupBy("handle", "crc", "n").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").drop("last_id")
    copies = slim.join(first, ["handle", "crc", "n"]).filter("doc_id > first_id").select("doc_id", "handle", F.lit(True).alias("whole"), F.lit(None).cast("binary").alias("spans"))
    marks = copies.union(ranges.select("doc_id", "handle", F.lit(False), "spans")).groupBy("doc_id", "handle").agg(F.max("whole").alias("whole"), F.max("spans").alias("spans"))
    marks = materialize(marks.withColumn("spans", F.when(~F.col("whole"), F.col("spans"))), "bwt-marks")
    size = marks.agg(F.sum(F.lit(40) + F.coalesce(F.octet_length("spans"), F.lit(0)))).first()[0] or 0
    marked = texts.join(F.broadcast(marks) if size <= most_bytes else marks, ["doc_id", "handle"], "left")
    schema = OUT.replace("kept_sha256 string", "kept binary") if with_text else OUT
    return cut_texts(marked.select("doc_id", "text", "spans", F.coalesce("whole", F.lit(False)).alias("whole")), schema, with_text)
