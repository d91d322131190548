"""Minimax contiguous partition: ordered atomic groups of rows into shards of near-equal bytes.

Rows with equal texts are one atomic group.  Groups are ordered by their *place*, the leading 60 bits of
the text's MD5.  The smallest capacity for which the ordered groups fit into the shards is found exactly,
though the groups never come to the driver: it holds *atoms*, runs of neighbouring groups with their total and
largest group.  Walking from the end with cuts anywhere inside an atom needs at most as much capacity as the groups do,
with cuts at the edges of atoms at least as much; binary search gives the smallest of either kind.  While they differ,
the atoms in which a cut of some capacity between them may fall are opened: replaced by their parts of
a finer range of places, down to single groups.  There are at most `CELLS` atoms at first, and few are opened, at
any input size.  The cuts then lie near equal shares of the rest, within that capacity.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eligspark.storage import materialize

#: Bits of a place, of the first atoms' numbers, and by which an opened atom is split.
PLACE_BITS, CELL_BITS, SPLIT_BITS = 60, 17, 8
CELLS = 1 << CELL_BITS
#: Blocks of each shard for numbering: a bound that doesn't grow with the input.
BLOCKS = 1 << 10


@dataclass(frozen=True)
class Atom:
    """Groups with places in [start, start + 2**bits): their bytes, the bytes of the largest, how many they are."""

    start: int
    bits: int
    total: int
    largest: int
    groups: int


def walk(edges: list[int], open_: list[bool], shards: int, capacity: int, anywhere: bool) -> list[int]:
    """Byte positions of the cuts, from the end: each as early as the capacity allows; reaches 0 if all fits.

    `edges` are the byte positions of the atoms' edges.  With `anywhere` a cut may lie inside an atom
    that is `open_` (has several groups), else only on edges.  An atom over the capacity stops the walk.
    """
    at, out = edges[-1], []
    for _ in range(shards):
        target = at - capacity
        if target <= 0:
            out.append(0)
            break
        k = bisect_left(edges, target)
        cut = target if anywhere and edges[k] != target and open_[k - 1] else edges[k]
        if cut >= at:
            break
        out.append(cut)
        at = cut
    return out


def smallest(fits: Callable[[int], bool], low: int, high: int) -> int:
    """The least number in [low, high] that fits; `high` does."""
    while low < high:
        middle = (low + high) // 2
        if fits(middle):
            high = middle
        else:
            low = middle + 1
    return low


def capacity_bounds(atoms: list[Atom], shards: int) -> tuple[int, int]:
    """The smallest capacity with cuts anywhere in atoms of several groups, and with cuts on edges only."""
    edges, open_ = [0, *accumulate(a.total for a in atoms)], [a.groups > 1 for a in atoms]
    total = edges[-1]
    fits = lambda anywhere: lambda c: walk(edges, open_, shards, c, anywhere)[-1:] == [0]
    low = smallest(fits(True), max([1, -(-total // shards), *(a.largest for a in atoms)]), max(1, total))
    return low, smallest(fits(False), low, max(1, total))


def undecided(atoms: list[Atom], shards: int, low: int, high: int) -> list[int]:
    """Indices of the atoms of several groups in which a cut may fall for some capacity in [low, high]."""
    edges, open_ = [0, *accumulate(a.total for a in atoms)], [a.groups > 1 for a in atoms]
    if large := [k for k, a in enumerate(atoms) if open_[k] and a.total > low]:  # fewer than `shards`; they stop a walk
        return large
    early, late = walk(edges, open_, shards, high, True), walk(edges, open_, shards, low, False)
    out = set()
    for a, b in zip(early, late):
        out.update(k for k in range(max(0, bisect_right(edges, a) - 1), min(len(atoms), bisect_left(edges, b))) if open_[k])
    return sorted(out)


def exact_atoms(atoms: list[Atom], shards: int, opened: Callable[[list[Atom]], list[Atom]]) -> list[Atom]:
    """The atoms, opened where the smallest capacity needs it, and wholly where there are too few for every shard to have one."""
    while True:
        low, high = capacity_bounds(atoms, shards)
        chosen = [k for k, a in enumerate(atoms) if a.groups > 1] if len(atoms) < 4 * shards else undecided(atoms, shards, low, high) if low < high else []
        chosen = [k for k in chosen if atoms[k].bits]
        if not chosen:
            return atoms
        gone = set(chosen)
        parts = opened([atoms[k] for k in chosen])
        atoms = sorted([a for k, a in enumerate(atoms) if k not in gone] + parts, key=lambda a: a.start)


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which the ordered sizes fit into `shards` contiguous shards."""
    return capacity_bounds([Atom(k, 0, n, n, 1) for k, n in enumerate(sizes)], shards)[1] if sizes else 0


def cuts(sizes: list[int], shards: int) -> list[int]:
    """Index of the first entry of each shard after the first, none of which is over the smallest capacity.

    A shard ends at the edge nearest to an equal share of the rest among those that leave no later shard over
    the capacity, and leaves each of the later ones an entry; only with fewer entries than shards some stay empty.
    """
    n, capacity = len(sizes), smallest_capacity(sizes, shards)
    if n <= shards:
        return list(range(1, n))
    edges = [0, *accumulate(sizes)]
    earliest = walk(edges, [False] * n, shards, capacity, False)  # of the last shard, the one before it, ...
    out, at = [], 0
    for left in range(shards, 1, -1):
        least = max(at + 1, bisect_left(edges, earliest[left - 2]) if left - 2 < len(earliest) else 0)
        most = min(n - left + 1, bisect_right(edges, edges[at] + capacity) - 1)
        goal = edges[at] + (edges[-1] - edges[at]) / left
        k = bisect_left(edges, goal)
        near = k if edges[k] - goal <= goal - edges[k - 1] else k - 1
        at = min(max(near, least), most)
        out.append(at)
    return out


def groups_as_atoms(groups: DataFrame) -> list[Atom]:
    """The first atoms of (place, total) rows: one for each of `CELLS` equal ranges that has groups."""
    bits = PLACE_BITS - CELL_BITS
    cells = groups.groupBy(F.shiftright("place", bits).alias("cell")).agg(F.sum("total").alias("total"), F.max("total").alias("largest"), F.count(F.lit(1)).alias("n"))
    return sorted((Atom(r.cell << bits, bits, r.total, r.largest, r.n) for r in cells.collect()), key=lambda a: a.start)  # at most CELLS rows


def parts_of(groups: DataFrame, chosen: list[Atom]) -> list[Atom]:
    """The parts of the chosen atoms (few, see `undecided`), each at most 2**SPLIT_BITS."""
    out = []
    for bits in sorted({a.bits for a in chosen}):
        names = [(a.start >> bits,) for a in chosen if a.bits == bits]
        finer = max(0, bits - SPLIT_BITS)
        wanted = groups.sparkSession.createDataFrame(names, "cell long")
        inside = groups.withColumn("cell", F.shiftright("place", bits)).join(F.broadcast(wanted), "cell", "left_semi")
        parts = inside.groupBy(F.shiftright("place", finer).alias("cell")).agg(F.sum("total").alias("total"), F.max("total").alias("largest"), F.count(F.lit(1)).alias("n"))
        out += [Atom(r.cell << finer, finer, r.total, r.largest, r.n) for r in parts.collect()]
    return out


def shard_documents(documents: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `documents`: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes plus 1; equal texts (null counts as empty) share a shard; slots number the
    rows of each shard without gaps from 0.  The largest shard is as small as contiguous shards of whole
    groups, in the order of their places, can be (texts whose places tie, 60 bits of MD5, go together).  Null ids
    are kept; repeated rows get slots of their own; an empty table gives no rows; very long texts are a size as any other;
    columns besides id and text are not read.  A hot group of copies is added up before it is shuffled,
    and is numbered in blocks of hashed ids.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("long").alias("place"),
    )
    rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BLOCKS)).cast("int")), "shard-sizes")
    groups = materialize(rows.groupBy("place").agg(F.sum("size").alias("total")), "shard-groups")
    atoms = exact_atoms(groups_as_atoms(groups), shards, lambda chosen: parts_of(groups, chosen))
    starts = [atoms[k].start for k in cuts([a.total for a in atoms], shards)]
    placed = rows.withColumn("shard", shard_of(F.col("place"), starts))
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))  # at most shards x BLOCKS rows
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = placed.join(F.broadcast(offsets), ["shard", "block"])
    within = W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_of(place: Column, starts: list[int]) -> Column:
    """Number of shard starts at or before the place."""
    out = F.lit(0)
    for start in starts:
        out = out + F.when(place >= start, 1).otherwise(0)
    return out.cast("int")
