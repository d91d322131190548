"""N-gram Jaccard join: prefix cells, a count-vector R-tree in each, exact verification.

Two texts can only reach the threshold if their shingle sets share one of the first
``n - ceil(t * n) + 1`` shingles in any fixed order, so every text is listed under those
(its prefix) and only texts that share a list, a *cell*, are compared.  The order puts
shingles that many texts have last; how frequent they are is read from a sketch of
fixed size over all texts, which can only affect speed.

Inside a cell the sets' shingles are hashed into groups and the group counts are indexed as
points of an R-tree.  The overlap of two sets is at most the sum of the coordinate minima,
and for a node the same sum with its largest coordinates, so whole nodes are skipped.
Cells are first screened so: only texts with a possible partner go on, and only then
do whole sets travel.  Pairs that survive are verified on the sets.  Pairs already connected are passed over,
so a cell gives a spanning forest of its links, never all pairs.

Cells with the same members are one cell, and cells that overlap (those of a family of near copies, say)
form a cluster.  A cluster of at most 1,024 texts is compared as a whole.  In a larger one every member is first
compared with the representative of one of its cells, in blocks of about 512, which links a family of any size in
rows that grow with its members; only cells whose members are still in several components are then compared, those
outside the cell's largest component with all others, in pairs of blocks.  So each unit of comparison has a
bounded size, and no pair of a cell is left out unless links connect it already.

Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligspark.llm.common import BROADCAST_ID_ROWS, WordHash, as_signed, grouped_rows, keep_ids, mix64, text_bytes, word_shingles
from eligspark.storage import materialize

SKETCH_BITS, SLICES = 20, 64
#: Groups of the R-tree's points, and shingles per group of a set's own, finer point.
GROUPS, PER_GROUP = 64, 8
FANOUT = 16
BLOCK = 512
FLUSH = 1 << 21
#: Prefix entries (16 bytes each) of one part, about.
PART_ENTRIES = 4_000_000


def distinct_texts(texts: list[bytes], size: int, hashes: WordHash) -> Iterator[tuple[int, np.ndarray]]:
    """(index, shingles) of each text; equal texts of a batch are hashed once."""
    known: dict[bytes, np.ndarray] = {}
    for k, text in enumerate(texts):
        found = known.get(text)
        if found is None:
            found = known[text] = word_shingles(text, size, hashes)
        yield k, found


def frequency_classes(documents: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """The number of shingles of all texts, and a rank for each sketch cell that grows with its count: in steps of a quarter of the noise, then by logarithm.

    Every task counts the distinct shingles of all its texts in one array of fixed size; the
    arrays are summed slice by slice.  What comes to the driver has 2**SKETCH_BITS counters.
    """
    cells = 1 << SKETCH_BITS
    width = cells // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total, rows = WordHash(), np.zeros(cells, np.int64), 0
        for batch in batches:
            found = [s for _, s in distinct_texts(batch.column("text").to_pylist(), size, hashes)]
            rows += len(found)
            if found:
                total += np.bincount((np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells)
        if rows:
            data = [zlib.compress(total[k * width : (k + 1) * width].astype(np.uint32).tobytes(), 1) for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(data, pa.binary()), pa.array([rows] * SLICES, pa.int64())], names=["slice", "data", "rows"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for data in pdf["data"]:
            total += np.frombuffer(zlib.decompress(data), np.uint32)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "data": [total.tobytes()], "rows": [int(pdf["rows"].sum())]})

    partial = documents.select(text_bytes().alias("text")).mapInArrow(run, "slice int, data binary, rows long")
    slices = partial.groupBy("slice").applyInPandas(add, "slice int, data binary, rows long").collect()  # SLICES rows
    if not slices:
        return np.zeros(cells, np.uint8), 0
    total = np.concatenate([np.frombuffer(r["data"], np.int64) for r in sorted(slices, key=lambda r: r["slice"])])
    z = (total - total.mean()) / max(1.0, total.mean()) ** 0.5
    low = np.clip(np.round(4 * (z + 4)), 0, 32)
    return np.where(z < 4, low, np.clip(32 + 8 * np.log2(np.maximum(z, 4) / 4), 32, 255)).astype(np.uint8), int(total.sum())


def prefix(shingles: np.ndarray, percent: int, classes: np.ndarray) -> np.ndarray:
    """The shingles under which a set is listed: those of the rarest sketch cells, then by hash."""
    n = len(shingles)
    length = n - -(-percent * n // 100) + 1
    rank = classes[shingles >> np.uint64(64 - SKETCH_BITS)]
    return shingles[np.argsort(rank, kind="stable")[:length]]


SIGNATURES = "doc_id long, n long, node long, points binary, part int, keys binary, nodes binary"


def signatures(documents: DataFrame, size: int, percent: int, classes: np.ndarray, parts: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n, node, points) for each text, node being its set's hash (null if empty) and
    points its group counts (once in a task), and (part, keys, nodes): packed prefix keys of one part with the
    sets that have them."""
    shared = documents.sparkSession.sparkContext.broadcast(classes)

    def packed(keys: list, nodes: list) -> Iterator[tuple]:
        k, v = np.concatenate(keys), np.concatenate(nodes)
        part = (k % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        k, v, part = k[order], v[order], part[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts + 1))
        for a, b in zip(edges, edges[1:]):
            yield int(part[a]), k[a:b].tobytes(), v[a:b].tobytes()

    def rows(arrays: list[tuple]) -> pa.RecordBatch:
        m = len(arrays)
        empty = pa.nulls(m, pa.int64())
        return pa.RecordBatch.from_arrays([empty, empty, empty, pa.nulls(m, pa.binary()), pa.array([a[0] for a in arrays], pa.int32()), pa.array([a[1] for a in arrays], pa.binary()), pa.array([a[2] for a in arrays], pa.binary())], names=["doc_id", "n", "node", "points", "part", "keys", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, classes_, listed = WordHash(), shared.value, set()
        keys, nodes, held = [], [], 0
        for batch in batches:
            counts, handles, points = [], [], []
            for _, s in distinct_texts(batch.column("text").to_pylist(), size, hashes):
                node = xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else None
                counts.append(len(s))
                handles.append(None if node is None else node - (1 << 64) * (node >> 63))
                points.append(None)
                if node is not None and node not in listed:
                    listed.add(node)
                    points[-1] = packed_point(group_counts(s))
                    keys.append(prefix(s, percent, classes_))
                    nodes.append(np.full(len(keys[-1]), node, np.uint64))
                    held += len(keys[-1])
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(handles, pa.int64()), pa.array(points, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=["doc_id", "n", "node", "points", "part", "keys", "nodes"]
            )
            if held > FLUSH:
                yield rows(list(packed(keys, nodes)))
                keys, nodes, held = [], [], 0
        if keys:
            yield rows(list(packed(keys, nodes)))

    return documents.select("doc_id", text_bytes().alias("text")).mapInArrow(run, SIGNATURES)


CELLS = "cell_a long, cell_b long, cell_size long, node long"


def cells_of_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """Members of the cells of one part with two or more sets; a cell is named by its members, so equal cells are one."""
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k in pdf["keys"]])
    nodes = np.concatenate([np.frombuffer(k, np.uint64) for k in pdf["nodes"]])
    order = np.argsort(keys, kind="stable")
    keys, nodes = keys[order], nodes[order]
    twice = np.zeros(len(keys), bool)
    same = keys[1:] == keys[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    keys, nodes = keys[twice], nodes[twice]
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    if not len(keys):
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("cell_a", "cell_b", "cell_size", "node")})
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    names_a = np.bitwise_xor.reduceat(mix64(nodes), starts)
    names_b = np.add.reduceat(mix64(nodes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
    first = np.zeros(len(starts), bool)
    first[np.unique(np.stack([names_a, names_b]), axis=1, return_index=True)[1]] = True
    kept = np.repeat(first & (sizes > 1), sizes)
    columns = {"cell_a": np.repeat(names_a, sizes), "cell_b": np.repeat(names_b, sizes), "cell_size": np.repeat(sizes, sizes), "node": nodes}
    return pd.DataFrame({k: v[kept].view(np.int64) for k, v in columns.items()})


def blocks_of(size: Column) -> Column:
    """Blocks for so many members: one for up to 2 * BLOCK."""
    return F.when(size <= 2 * BLOCK, 1).otherwise(F.ceil(size / BLOCK)).cast("int")


def open_units(rows: DataFrame, cells: DataFrame, *carried: str) -> DataFrame:
    """(cell_a, cell_b, block_a, block_b, node, *carried): pairs of blocks in which every open member of a cell meets all others.

    rows: (cell_a, cell_b, node, is_open, *carried); cells: (cell_a, cell_b, size, n_open) of cells with open members.
    A cell of bounded size is one unit.  In others blocks 0, 1, ... have the open members, the following ones the settled,
    which don't meet each other.
    """
    rows = joined_by_size(rows, cells, ["cell_a", "cell_b"], "size")
    rows = rows.withColumns({"first": blocks_of(F.col("n_open")), "rest": F.when(F.col("size") > F.col("n_open"), blocks_of(F.col("size") - F.col("n_open"))).otherwise(0)})
    rows = rows.withColumn("own", F.when(F.col("is_open"), F.pmod(F.xxhash64("node"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int"))
    last = F.when(F.col("is_open"), F.col("first") + F.col("rest") - 1).otherwise(F.col("first") - 1)
    one = (F.col("size") <= 2 * BLOCK) | (F.col("first") + F.col("rest") == 1)
    others = F.when(one, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), last), lambda x: x != F.col("own")))
    rows = rows.withColumn("own", F.when(one, 0).otherwise(F.col("own"))).withColumn("other", F.explode(others))
    return rows.select("cell_a", "cell_b", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), "node", *carried)


UNIT = ["cell_a", "cell_b", "block_a", "block_b"]


def with_possible_partner(members: DataFrame, percent: int) -> DataFrame:
    """(cell_a, cell_b, node): the members of each unit (with points) that have a partner there by the R-tree's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"cell_a": [], "cell_b": [], "node": []}
        held = 0
        for group in grouped_rows(batches, UNIT):
            nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)
            if len(nodes) > 1:
                blob = group.column("points").combine_chunks()
                nodes = nodes[with_partner([unpacked_point(blob[k].as_py()) for k in first.tolist()], percent)]
                if len(nodes):
                    for name in ("cell_a", "cell_b"):
                        out[name].append(np.full(len(nodes), group.column(name)[0].as_py(), np.int64))
                    out["node"].append(nodes)
                    held += len(nodes)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], names=list(out))
                out, held = {k: [] for k in out}, 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], names=list(out))

    dealt = members.repartition(*UNIT).sortWithinPartitions(*UNIT, "node")
    return dealt.mapInArrow(run, "cell_a long, cell_b long, node long").distinct()


def screened(cells: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(cell_a, cell_b, node): the members of cells (cell_a, cell_b, cell_size, node) that have a partner in them by the
    R-tree's bound.  In cells over the bounded size a member looks for one in its own block first, then in all others."""
    own = F.pmod(F.xxhash64("node"), blocks_of(F.col("cell_size"))).cast("int")
    units = cells.select("cell_a", "cell_b", own.alias("block_a"), own.alias("block_b"), "node")
    found = materialize(with_possible_partner(units.join(points, "node"), percent), "jaccard-screened")
    large = cells.filter(F.col("cell_size") > 2 * BLOCK).select("cell_a", "cell_b", "node")
    if not large.limit(1).count():
        return found
    keys = ["cell_a", "cell_b", "node"]
    marked = materialize(large.join(found.withColumn("found", F.lit(True)), keys, "left").select(*keys, F.col("found").isNull().alias("is_open")), "jaccard-marked")
    sizes = marked.groupBy("cell_a", "cell_b").agg(F.count(F.lit(1)).alias("size"), F.count_if("is_open").alias("n_open")).filter("n_open > 0")
    units = open_units(marked, materialize(sizes, "jaccard-open"))
    return materialize(found.union(with_possible_partner(units.join(points, "node"), percent)).distinct(), "jaccard-screened")


def with_partner(points: list[np.ndarray], percent: int) -> np.ndarray:
    """Which points have another one that they may reach the threshold with."""
    sizes = np.array([int(p.sum()) for p in points])
    reach = lambda k, j: (100 + percent) * bound(points[k], points[j]) >= percent * int(sizes[k] + sizes[j])
    if len(points) == 2:
        return np.full(2, 100 * min(sizes) >= percent * max(sizes) and reach(0, 1))
    tree = CountTree(np.stack([folded(p, GROUPS) for p in points]), sizes, percent)
    out = np.zeros(len(points), bool)
    for k in range(len(points)):
        if not out[k]:
            for j in tree.partners(k).tolist():
                if j != k and reach(k, j):
                    out[k] = out[j] = True
                    break
    return out


def joined_by_size(rows: DataFrame, table: DataFrame, keys: list[str], size: str) -> DataFrame:
    """`rows` joined with `table` (one row per key; `size`: about how many rows have it): the few keys of many rows are
    broadcast (their number is checked), so that none of them meets in one task, the others are shuffled."""
    large = table.filter(F.col(size) > 2 * BLOCK)
    if large.limit(BROADCAST_ID_ROWS + 1).count() > BROADCAST_ID_ROWS:
        return rows.join(table, keys)  # over a billion rows; adaptive execution splits what is skewed
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(large), keys).unionByName(rest.join(table.filter(F.col(size) <= 2 * BLOCK), keys))


@dataclass
class Plan:
    """What is compared: `units` first (cell_a, cell_b, block_a, block_b, node), then the cells of `large` clusters
    (cell_a, cell_b, cell_size, node) that still have members in several components."""

    units: DataFrame
    large: DataFrame


def comparison_plan(cells: DataFrame) -> Plan:
    """Whole clusters of bounded size, and stars of the larger ones: members in blocks, each with the representative (least
    member) of one of its cells, the least of them."""
    leaders = cells.groupBy("cell_a", "cell_b").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("cell_size"))
    marked = materialize(joined_by_size(cells, leaders, ["cell_a", "cell_b"], "cell_size"), "jaccard-marked")
    clusters = connected(marked.select(F.col("node").alias("a"), F.col("leader").alias("b")), "jaccard-clusters")
    large_roots = materialize(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * BLOCK), "jaccard-large")
    zero = F.lit(0).cast("long")
    whole = [zero.alias("cell_b"), F.lit(0).alias("block_a"), F.lit(0).alias("block_b"), "node"]
    if not large_roots.limit(1).count():
        return Plan(clusters.select(F.col("root").alias("cell_a"), *whole), marked.select("cell_a", "cell_b", "cell_size", "node").limit(0))
    few = large_roots.limit(BROADCAST_ID_ROWS + 1).count() <= BROADCAST_ID_ROWS
    roots = F.broadcast(large_roots) if few else large_roots
    small = clusters.join(roots, "root", "left_anti").select(F.col("root").alias("cell_a"), *whole)
    inside = materialize(clusters.join(roots, "root", "left_semi").select("node"), "jaccard-inside")
    large = materialize(marked.join(inside, "node", "left_semi"), "jaccard-large-cells")
    nearest = large.groupBy("node").agg(F.min("leader").alias("leader")).select("leader", "node")  # one star for each member
    arms = materialize(nearest.union(nearest.select("leader", F.col("leader").alias("node"))).distinct(), "jaccard-arms")
    stars = joined_by_size(arms, arms.groupBy("leader").agg(F.count(F.lit(1)).alias("size")), ["leader"], "size")
    stars = stars.withColumn("blocks", blocks_of(F.col("size")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    places = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    stars = stars.withColumn("block_a", F.explode(places)).select(F.col("leader").alias("cell_a"), F.lit(1).cast("long").alias("cell_b"), "block_a", F.col("block_a").alias("block_b"), "node")
    return Plan(materialize(small.union(stars), "jaccard-units"), large.select("cell_a", "cell_b", "cell_size", "node"))


def unsettled_units(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(cell_a, cell_b, block_a, block_b, node, known): pairs of blocks of the cells whose members are in several components.

    `known` names the component.  Members of the cell's largest component (settled) meet all others, not each other.
    """
    known = large.join(roots, "node", "left").select("cell_a", "cell_b", "cell_size", "node", F.coalesce("root", "node").alias("known"))
    known = materialize(known, "jaccard-known")
    parts = known.groupBy("cell_a", "cell_b", "known").agg(F.count(F.lit(1)).alias("n"))
    cells = parts.groupBy("cell_a", "cell_b").agg(F.max(F.struct("n", "known")).alias("most"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"))
    mixed = materialize(cells.filter("parts > 1").select("cell_a", "cell_b", "size", F.col("most.known").alias("main"), (F.col("size") - F.col("most.n")).alias("n_open")), "jaccard-mixed")
    rows = joined_by_size(known, mixed.select("cell_a", "cell_b", "main", "size"), ["cell_a", "cell_b"], "size")
    rows = materialize(rows.select("cell_a", "cell_b", "node", "known", (F.col("known") != F.col("main")).alias("is_open")), "jaccard-mixed-members")
    return open_units(rows, mixed.drop("main"), "known")


def group_counts(shingles: np.ndarray) -> np.ndarray:
    """The point of a set: how many of its shingles fall into each hash group.

    Large sets have more groups (a power of two times GROUPS, about PER_GROUP shingles in each), because the bound of
    random sets comes close to their size where groups are full.
    """
    groups = GROUPS
    while groups * PER_GROUP < len(shingles):
        groups *= 2
    return np.bincount(((shingles >> np.uint64(7)) % np.uint64(groups)).astype(np.int64), minlength=groups)


def packed_point(point: np.ndarray) -> bytes:
    """A point as bytes: one byte for each count where all fit, else four."""
    return b"1" + point.astype(np.uint8).tobytes() if point.max(initial=0) < 256 else b"4" + point.astype(np.uint32).tobytes()


def unpacked_point(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if data[:1] == b"1" else np.uint32, offset=1).astype(np.int32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The point with fewer groups (the counts of hashes that agree modulo the smaller number add up)."""
    return point.reshape(-1, groups).sum(0)


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """Summed coordinate minima of two points, at the finer common resolution."""
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


SETS = "node long, shingles binary"


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of (node, text) rows whose text has the set that node names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            kept = []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                s = word_shingles(text, size, hashes)
                if xxhash.xxh3_64_intdigest(s.tobytes()) == node % (1 << 64):
                    kept.append((node, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(run, SETS)


def all_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the sets of all texts that have one (once in a batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            found = {xxhash.xxh3_64_intdigest(s.tobytes()): s.tobytes() for _, s in distinct_texts(batch.column("text").to_pylist(), size, hashes) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array([n - (1 << 64) * (n >> 63) for n in found], pa.int64()), pa.array(list(found.values()), pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(run, SETS)


class CountTree:
    """R-tree over count points, packed bottom-up: each node has its largest coordinates and its range of set sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.points, self.sizes, self.percent = points, sizes, percent
        self.order = self._tile(np.arange(len(points)))
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(top, low, high)]
        while len(top) > 1:
            at = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def _tile(self, rows: np.ndarray) -> np.ndarray:
        """Sort-tile order: by size into slabs, each by its most spread coordinate, recursively."""
        if len(rows) <= FANOUT:
            return rows
        slabs = max(2, int(np.ceil((len(rows) / FANOUT) ** 0.5)))
        values = self.sizes[rows]
        if values.max() - values.min() <= values.max() // 50:
            p = self.points[rows]
            values = p[:, p.var(0).argmax()]
        rows = rows[np.argsort(values, kind="stable")]
        width = -(-len(rows) // slabs)
        width += -width % FANOUT
        if width >= len(rows):
            return rows
        return np.concatenate([self._tile(rows[k : k + width]) for k in range(0, len(rows), width)])

    def partners(self, k: int) -> np.ndarray:
        """Indices whose set may reach the threshold with set k by size and summed coordinate minima, best first."""
        point, n, t = self.points[k], int(self.sizes[k]), self.percent
        least, most = -(-t * n // 100), 100 * n // t
        rows = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[level]
            most_shared = np.minimum(top[rows], point).sum(1)
            size = np.maximum(low[rows], least)
            fits = (high[rows] >= least) & (low[rows] <= most) & ((100 + t) * most_shared >= t * (n + size))
            rows, most_shared = rows[fits], most_shared[fits]
            if level:
                rows = (rows[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                rows = rows[rows < len(self.levels[level - 1][0])]
        return self.order[rows[np.argsort(-most_shared, kind="stable")]]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def forest(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that, with the components `known` before, connect exactly what all links of these sets connect."""
    sizes = np.array([len(s) for s in sets])
    points = [group_counts(s) for s in sets]
    tree = CountTree(np.stack([folded(p, GROUPS) for p in points]), sizes, percent)
    root = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    links = []
    for k in range(len(sets)):
        others = tree.partners(k)
        others = others[root[others] != root[k]]
        while len(others):
            j = int(others[0])
            possible = (100 + percent) * bound(points[k], points[j]) >= percent * int(sizes[k] + sizes[j])
            both = overlap(sets[k], sets[j]) if possible else 0
            if 100 * both >= percent * (sizes[k] + sizes[j] - both):
                links.append((k, j))
                root[root == root[j]] = root[k]
                others = others[root[others] != root[k]]
            else:
                others = others[1:]
    return links


def links_of_cells(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes from the members of units with their sets (and known components); units are streamed in sorted order."""
    has_known = "known" in members.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in grouped_rows(batches, UNIT):
            nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)
            if len(nodes) > 1:
                shingles = group.column("shingles")
                sets = [np.frombuffer(shingles[k].as_py(), np.uint64) for k in first.tolist()]
                known = group.column("known").to_numpy()[first] if has_known else None
                found += [(int(nodes[a]), int(nodes[b])) for a, b in forest(sets, percent, known)]
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])
                found = []
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    dealt = members.repartition(*UNIT).sortWithinPartitions(*UNIT, "node")
    return dealt.mapInArrow(run, "a long, b long")


def connected(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node of an edge.

    Alternating large-star and small-star steps; each step's edges are a table in the shared
    folder, so nothing but counts comes to the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, tag)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), tag)
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def jaccard_components(documents: DataFrame, size: int = 4, percent: int = 85, parts: int | None = None) -> DataFrame:
    """One row per row of `documents` (doc_id, text): doc_id, n_shingles, component_id.

    Texts link when 100 * intersection >= percent * union of their `size`-word shingle sets;
    component_id is the smallest doc_id reached by links.  Null and empty texts have no
    shingles and no links; very long texts are one set as any other.  Rows that share a doc_id are one document: its
    texts' components are reported row by row.  Rows with a null id link others but have component_id null
    unless they reach an id.  Repeated rows stay repeated, ties have no influence; an empty table gives no rows;
    columns besides doc_id and text are not read.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    classes, total = frequency_classes(documents, size)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * (100 - percent) // 100 // PART_ENTRIES + 1)
    rows = materialize(signatures(documents, size, percent, classes, parts), "jaccard-signatures")
    ids = rows.filter(F.col("part").isNull()).select("doc_id", "n", "node")
    arrays = rows.filter(F.col("part").isNotNull()).select("part", "keys", "nodes")
    cells = materialize(arrays.groupBy("part").applyInPandas(cells_of_part, CELLS).distinct(), "jaccard-cells")
    points = rows.filter(F.col("points").isNotNull()).select("node", "points").dropDuplicates(["node"])
    plan = comparison_plan(screened(cells, points, percent))
    least = materialize(ids.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "jaccard-least")
    links = links_of_cells(plan.units.join(sets_of(documents, least, plan.units.select("node").distinct(), size), "node"), percent)
    roots = connected(links, "jaccard-components")
    if plan.large.limit(1).count():
        units = materialize(unsettled_units(plan.large, roots), "jaccard-unsettled")
        if units.limit(1).count():
            more = links_of_cells(units.join(sets_of(documents, least, units.select("node").distinct(), size), "node"), percent)
            roots = connected(more.union(roots.select("node", "root")), "jaccard-components")
    named = roots.join(least, "node").groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    component = joined_by_size(roots, materialize(named, "jaccard-named"), ["root"], "size").select("node", "component_id")
    reached = F.col("component_id").isNotNull()
    known = least.join(component, "node", "left").select("node", F.when(reached, F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"), "copies")
    linked = joined_by_size(ids.filter(F.col("node").isNotNull()), materialize(known, "jaccard-components"), ["node"], "copies")
    alone = ids.filter(F.col("node").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def sets_of(documents: DataFrame, least: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of distinct `nodes`, one text of each: that of its smallest id, or any where no row has an id."""
    wanted = materialize(least.select("node", F.col("first_id").alias("doc_id")).join(nodes, "node", "left_semi"), "jaccard-wanted")
    named = wanted.filter(F.col("doc_id").isNotNull())
    texts = keep_ids(documents, named.select("doc_id").distinct(), "doc_id")
    few = named.limit(BROADCAST_ID_ROWS + 1).count() <= BROADCAST_ID_ROWS
    sets = shingle_sets(texts.join(F.broadcast(named) if few else named, "doc_id").select("node", text_bytes().alias("text")), size)
    if wanted.filter(F.col("doc_id").isNull()).limit(1).count():
        nameless = documents.filter(F.col("doc_id").isNull()).select(text_bytes().alias("text"))
        found = all_sets(nameless, size).join(wanted.filter(F.col("doc_id").isNull()).select("node"), "node", "left_semi")
        sets = sets.union(found.dropDuplicates(["node"]))
    return sets


def one_of_each_component(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `documents` that stand for their component (its smallest doc_id), all columns as they are.

    Rows without an id stay, since nothing tells them apart; of rows that share a kept id one stays.  Null and empty
    texts link with nothing, so their rows stay; an empty table gives no rows; columns of any name are carried along.
    """
    components = materialize(jaccard_components(documents, size, percent), "jaccard-result")
    kept = materialize(components.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "jaccard-kept")
    few = kept.limit(BROADCAST_ID_ROWS + 1).count() <= BROADCAST_ID_ROWS
    ids = kept.select(F.col("doc_id").alias("__kept"))
    out = documents.join(F.broadcast(ids) if few else ids, F.col("doc_id").cast("long") == F.col("__kept"), "left_semi")
    if kept.filter("rows > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id"])
    return out.union(documents.filter(F.col("doc_id").isNull()))


def jaccard_sql(size: int = 4, percent: int = 85) -> str:
    """DuckDB SQL for the rows of `jaccard_components` over documents (ids as they are in the test tables: present and distinct)."""
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
d as (select doc_id, case when len(w) >= {size} then list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda k: array_to_string(w[k : k + {size - 1}], ' ')))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end as sh from w),
s as (select doc_id, unnest(sh) as x from d),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from p join d x on x.doc_id = a join d y on y.doc_id = b where 100 * i >= {percent} * (len(x.sh) + len(y.sh) - i)),
e as (select a as u, b as v from l union all select b, a from l),
r(node, reach) as (select doc_id, doc_id from d union select r.node, e.v from r join e on e.u = r.reach)
select d.doc_id, cast(len(any_value(sh)) as bigint) as n_shingles, min(reach) as component_id from d join r on r.node = d.doc_id group by d.doc_id"""
