"""Components of the Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from eligspark.llm import jaccard as J
from eligspark.llm.common import WordHash, word_shingles
from tests.llm.fixtures import documents, frame, key


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def brute(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(rows)) if find(j) == find(k) and sets[j][0] is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return sorted(out, key=key)


@pytest.mark.parametrize(("size", "percent", "block"), [(4, 85, 512), (5, 80, 2)])
def test_components(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = documents(seed=3)
    got = J.jaccard_components(frame(spark, rows), size, percent)
    assert sorted((tuple(r) for r in got.collect()), key=key) == brute(rows, size, percent)


def test_empty_table(spark):
    assert J.jaccard_components(frame(spark, documents()).limit(0)).count() == 0


def test_one_of_each(spark):
    rows = [(i, t) for i, t in documents(seed=3)]
    kept = sorted(r.doc_id for r in J.one_of_each_component(frame(spark, rows)).collect() if r.doc_id is not None)
    assert kept == sorted({i for i, _, c in brute(rows, 5, 80) if i is not None and i == c})


def test_tree_misses_no_partner():
    rnd = random.Random(5)
    base = [rnd.randrange(1 << 60) for _ in range(400)]
    sets = []
    for k in range(120):
        s = set(base[: rnd.choice([20, 60, 400])])
        for _ in range(rnd.randint(0, 12)):
            s.discard(rnd.choice(base))
            s.add(rnd.randrange(1 << 60))
        sets.append(np.array(sorted(s), np.uint64))
    points = [J.group_counts(s) for s in sets]
    sizes = np.array([len(s) for s in sets])
    tree = J.CountTree(np.stack([J.folded(p, J.GROUPS) for p in points]), sizes, 80)
    for k in range(len(sets)):
        near = set(tree.partners(k).tolist())
        for j in range(len(sets)):
            both = len(np.intersect1d(sets[k], sets[j]))
            assert J.bound(points[k], points[j]) >= both
            if 100 * both >= 80 * (len(sets[k]) + len(sets[j]) - both):
                assert j in near


def test_shingles_of_short_texts():
    h = WordHash()
    assert len(word_shingles(b"", 4, h)) == 0
    assert (word_shingles(b"A b", 4, h) == word_shingles(b"a  B\n", 4, h)).all()
    assert word_shingles(b"a b c d", 4, h)[0] != word_shingles(b"a b c", 4, h)[0]


def test_rows_without_an_id_link_others(spark):
    words = [f"w{k}" for k in range(60)]
    change = lambda at: " ".join(["zz" if k in at else w for k, w in enumerate(words)])
    a, b, between = change([2]), change([57]), change([])
    rows = [(1, a), (2, b), (None, between), (None, between), (None, "alone " * 9)]
    linked = brute(rows, 4, 85)
    assert [r for r in linked if r[0] == 2] == [(2, 57, 1)]  # a and b are too far apart without the bridge
    assert brute(rows[:2], 4, 85)[1][2] == 2
    got = J.jaccard_components(frame(spark, rows), 4, 85)
    assert sorted((tuple(r) for r in got.collect()), key=key) == linked


def families(seed, sizes, length=40):
    """Families of near copies (each a chain of small changes of its first text), with strangers that share a passage."""
    rnd = random.Random(seed)
    rows = []
    for size in sizes:
        text = [f"v{rnd.randrange(500)}" for _ in range(length)]
        for _ in range(size):
            rows.append(" ".join(text))
            text[rnd.randrange(length)] = f"c{rnd.randrange(10**6)}"
    passage = " ".join(f"p{k}" for k in range(12))
    rows += [passage + " " + " ".join(f"s{rnd.randrange(10**6)}" for _ in range(rnd.choice([2, 8]))) for _ in range(30)]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [2, 5])
def test_large_families_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = families(block, [40, 25, 12, 3])
    got = J.jaccard_components(frame(spark, rows), 4, 80)
    assert sorted((tuple(r) for r in got.collect()), key=key) == brute(rows, 4, 80)


def test_units_of_a_family_grow_with_its_members(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)
    n = 400
    cells = spark.createDataFrame([(1, 2, k) for k in range(n)], "cell_a long, cell_b long, node long")
    plan = J.comparison_plan(cells)
    assert plan.units.count() == n - 1 + n // 4  # every member once, the representative in every block
    roots = spark.createDataFrame([(k, 0) for k in range(n)], "node long, root long")
    assert J.unsettled_units(plan.large, roots).count() == 0
    roots = spark.createDataFrame([(k, 0 if k < n - 1 else k) for k in range(n)], "node long, root long")
    units = J.unsettled_units(plan.large, roots)
    assert units.count() < 2 * n and {r.node for r in units.filter("block_a = 0").collect()} == set(range(n))


def test_open_members_meet_everybody(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    rnd = random.Random(2)
    for size, share in ((5, 0.5), (40, 0.1), (40, 0.6), (40, 1.0)):
        rows = [(1, 1, k, k == 0 or rnd.random() < share) for k in range(size)]
        cells = spark.createDataFrame([(1, 1, size, sum(r[3] for r in rows))], "cell_a long, cell_b long, size long, n_open long")
        units = {}
        for r in J.open_units(spark.createDataFrame(rows, "cell_a long, cell_b long, node long, is_open boolean"), cells).collect():
            units.setdefault((r.block_a, r.block_b), set()).add(r.node)
        for _, _, k, is_open in rows:
            if is_open:
                assert {x for u in units.values() if k in u for x in u} == set(range(size))
