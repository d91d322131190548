"""Wu-Manber search against naive search."""

import hashlib
import pickle
import random
import re

from eligspark.llm import decontaminate as D
from eligspark.llm.decontaminate import WuManber, decontaminate, without_contaminated
from tests.llm.fixtures import documents, frame, key

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, items, window=10):
    patterns = []
    for item, text in items:
        w = WORD.findall(lower(text))
        width = min(window, len(w))
        patterns += [(str(item) if item is not None else "null", w[k : k + width]) for k in range(len(w) - width + 1) if width]
    out = []
    for i, text in rows:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for item, p in patterns:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=key)


def test_search_equals_naive():
    rnd = random.Random(4)
    for _ in range(60):
        items = [(k, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6)))) for k in range(4)]
        search = WuManber.of_items([(str(i), t.encode()) for i, t in items], window=3)
        words = [rnd.choice("abcd").encode() for _ in range(40)]
        got = {(a, b, o) for a, b, owners in search.search(search.numbered(words)) for o in owners}
        want = set()
        for i, t in items:
            w = [x.encode() for x in t.split()]
            width = min(3, len(w))
            for k in range(len(w) - width + 1):
                want |= {(s, s + width, str(i)) for s in range(len(words) - width + 1) if width and words[s : s + width] == w[k : k + width]}
        assert got == want


def test_frame(spark, monkeypatch):
    monkeypatch.setattr(D, "CHAINED", 2)
    rows = documents()
    text = dict(rows[:60])
    items = [(1, text[7]), (2, (text[5] or "") + " zz"), (10, "one"), (11, None), (12, ""), (None, text[8]), (2, "two three"), (3, "Ünq wörd")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, hits int")
    want = brute(rows, items)
    for size in (1 << 20, 60):
        assert sorted((tuple(r) for r in decontaminate(frame(spark, rows), bench, block_windows=size).collect()), key=key) == want
    kept = without_contaminated(frame(spark, rows), bench)
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == sorted(kept_row for kept_row, w in zip(sorted_rows(rows), flags(rows, items)) if not w)
    assert decontaminate(frame(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate(frame(spark, rows).limit(0), bench).count() == 0


def sorted_rows(rows):
    return sorted(((i, t) for i, t in rows if i is not None and t is not None), key=lambda r: (r[0], r[1])) + [(i, t) for i, t in rows if i is not None and t is None]


def flags(rows, items):
    return [brute([r], items)[0][5] for r in sorted_rows(rows)]


def test_tables_are_small():
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(30_000)]
    items = [(str(k), " ".join(rnd.choice(words) for _ in range(60)).encode()) for k in range(1000)]
    search = WuManber.of_items(items)
    assert sum(len(g.strings) for g in search.groups) == 51_000
    assert len(pickle.dumps(search)) < 8 << 20  # at most 160 bytes a window
    ids = search.numbered(items[7][1].split())
    assert {(a, o) for a, _, owners in search.search([0, *ids, 0]) for o in owners} == {(k + 1, "7") for k in range(51)}
