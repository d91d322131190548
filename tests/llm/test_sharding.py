"""Minimax partition against exhaustive search; the law's invariants on frames."""

import hashlib
import itertools
import random
import zlib

from eligspark.llm import sharding as S
from eligspark.llm.sharding import cuts, shard_documents, smallest_capacity
from tests.llm.fixtures import documents, frame


def exhaustive(sizes, shards):
    best = sum(sizes)
    for edges in itertools.combinations(range(1, len(sizes)), min(shards, len(sizes)) - 1):
        parts = [sizes[a:b] for a, b in zip((0, *edges), (*edges, len(sizes)))]
        best = min(best, max(map(sum, parts)))
    return best


def test_capacity_is_smallest():
    rnd = random.Random(3)
    for _ in range(150):
        sizes = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        shards = rnd.randint(1, 4)
        capacity = smallest_capacity(sizes, shards)
        assert capacity == exhaustive(sizes, shards)
        edges = [0, *cuts(sizes, shards), len(sizes)]
        assert len(edges) - 1 <= shards and max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])) <= capacity


def test_frame(spark):
    rows = documents()
    got = shard_documents(frame(spark, rows), shards=4).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    place = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4
        assert place.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    groups = {}
    for r in got:
        groups[r.text_crc32] = groups.get(r.text_crc32, 0) + r.size
    assert max(sizes) <= sum(sizes) / 4 + max(groups.values())
    assert shard_documents(frame(spark, rows).limit(0)).count() == 0


def test_one_group_of_copies(spark):
    got = shard_documents(frame(spark, [(k, "same") for k in range(50)]), shards=3).collect()
    assert {r.shard for r in got} == {0} and sorted(r.slot for r in got) == list(range(50))


def test_no_shard_is_empty_without_need():
    rnd = random.Random(4)
    for _ in range(300):
        sizes, shards = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 40))], rnd.randint(1, 8)
        sizes[rnd.randrange(len(sizes))] *= rnd.choice([1, 20])
        edges = [0, *cuts(sizes, shards), len(sizes)]
        assert len(edges) - 1 == min(shards, len(sizes)) and all(a < b for a, b in zip(edges, edges[1:]))
        assert max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])) <= smallest_capacity(sizes, shards)
    sizes = [1] * 1000
    sizes[500] = 493  # a third of all bytes
    edges = [0, *cuts(sizes, 16), len(sizes)]
    parts = [sum(sizes[a:b]) for a, b in zip(edges, edges[1:])]
    assert len(parts) == 16 and sorted(parts)[-2] <= sum(sizes) / 16 + 1


def as_atoms(sizes, bits, width):
    """Groups at places 0, 1, ... as atoms of 2**width places, and what opens them."""

    def of(groups, width):
        parts = {}
        for place, n in groups:
            parts.setdefault(place >> width, []).append(n)
        return [S.Atom(k << width, width, sum(v), max(v), len(v)) for k, v in sorted(parts.items())]

    places = list(enumerate(sizes))
    opened = lambda chosen: [p for a in chosen for p in of([x for x in places if a.start <= x[0] < a.start + (1 << a.bits)], max(0, a.bits - bits))]
    return of(places, width), opened


def test_opened_atoms_give_the_capacity_of_the_groups():
    rnd = random.Random(5)
    for k in range(400):
        sizes, shards = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 300))], rnd.randint(1, 9)
        for _ in range(k % 3):
            sizes[rnd.randrange(len(sizes))] *= rnd.choice([20, 500])
        atoms, opened = as_atoms(sizes, rnd.randint(1, 3), rnd.randint(0, 6))
        atoms = S.exact_atoms(atoms, shards, opened)
        totals = [a.total for a in atoms]
        edges = [0, *cuts(totals, shards), len(totals)]
        capacity = smallest_capacity(sizes, shards)
        assert S.capacity_bounds(atoms, shards) == (capacity, capacity)
        assert max(sum(totals[a:b]) for a, b in zip(edges, edges[1:])) <= capacity
        assert sum(totals) == sum(sizes) and len(edges) - 1 == min(shards, len(sizes))


def test_frame_is_minimax_over_the_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_BITS", 2)  # every first atom has many groups
    monkeypatch.setattr(S, "SPLIT_BITS", 2)
    rnd = random.Random(8)
    rows = [(k, "t" * rnd.choice([1, 5, 30]) + str(rnd.randrange(90))) for k in range(400)] + [(k, "hot " * 40) for k in range(400, 430)]
    for shards in (3, 16):
        got = shard_documents(frame(spark, rows), shards=shards).collect()
        groups = {}
        for _, text in rows:
            place = hashlib.md5(text.encode()).hexdigest()
            groups[place] = groups.get(place, 0) + len(text) + 1
        capacity = smallest_capacity([groups[p] for p in sorted(groups)], shards)
        sizes = [sum(r.size for r in got if r.shard == s) for s in range(shards)]
        assert max(sizes) <= capacity and min(sizes) > 0
