"""Repeated byte passages against a direct search."""

import hashlib
import random

import numpy as np

from eligspark.llm import bwt_dedup as B
from eligspark.llm.bwt_dedup import bounded_classes, covered_windows, remove_repeats
from tests.llm.fixtures import documents, frame, key


def brute(rows, least=50):
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in data:
        if i is not None:
            for k in range(len(t) - least + 1):
                s = t[k : k + least]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        if i is not None:
            for k in range(len(t) - least + 1):
                if first[t[k : k + least]] < i:
                    gone[k : k + least] = b"\1" * least
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def test_frame(spark):
    rows = documents(seed=2)
    want = brute(rows)
    for limits in ({}, {"most_anchors": 0, "most_bytes": 0}):
        got = remove_repeats(frame(spark, rows), **limits)
        assert sorted((tuple(r) for r in got.collect()), key=key) == want
    kept = remove_repeats(frame(spark, rows), with_text=True).collect()
    assert sorted(hashlib.sha256(bytes(r.kept)).hexdigest() for r in kept) == sorted(w[4] for w in want)
    assert remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_small_tables_and_chunks(monkeypatch):
    """Combining and chunking only change how work is cut, also where tables overflow all the time."""
    rows = [(i, t) for i, t in documents(seed=8) if i is not None]
    texts = [(t or "").encode() for _, t in rows]

    def ranges(most):
        combiner, batches = B.Combiner(most), []
        for at, some in B.chunks(texts):
            owner, name, first, last = B.anchored_runs(some)
            for n, k, i, j in zip(name.view(np.int64).tolist(), owner.tolist(), first.tolist(), last.tolist()):
                combiner.add(n, rows[at + k][0], at + k, i, some[k][i : j + 50])
                if combiner.full():
                    batches.append(combiner.empty())
        batches.append(combiner.empty())
        kept, gone = {}, set()
        fragments = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["fragment"] is None, r["doc_id"]))
        for r in fragments:
            spans = [] if r["spans"] is None else np.frombuffer(r["spans"], np.int64).reshape(-1, 2).tolist()
            if r["spans"] is None and kept.setdefault(r["fragment"], r["doc_id"]) < r["doc_id"]:
                spans = [(r["start"], r["start"] + len(r["fragment"]))]
            gone |= {(r["doc_id"], k) for a, b in spans for k in range(a, b)}
        return gone

    want = ranges(1 << 20)
    assert want and ranges(2) == want
    monkeypatch.setattr(B, "CHUNK_BYTES", 300)
    assert ranges(5) == want


def test_classes_of_small_alphabets():
    rnd = random.Random(7)
    for _ in range(80):
        least = rnd.randint(2, 12)
        pieces = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(least, 40))) for _ in range(rnd.randint(1, 6))]
        owners = np.array([rnd.randrange(4) for _ in pieces])
        got = covered_windows(pieces, owners, least)
        first = {}
        for p, o in zip(pieces, owners.tolist()):
            for k in range(len(p) - least + 1):
                first[p[k : k + least]] = min(first.get(p[k : k + least], 9), o)
        for p, o, g in zip(pieces, owners.tolist(), got):
            assert g.tolist() == [k for k in range(len(p) - least + 1) if first[p[k : k + least]] < o]


def test_boundaries_are_those_of_short_prefixes():
    text = np.array([2, 1, 2, 1, 2, 1, 3, 0], np.int16)
    order, new = bounded_classes(text, 2)
    suffixes = [tuple(text[k:].tolist()) for k in order]
    for k in range(1, len(order)):
        a, b = suffixes[k - 1], suffixes[k]
        if 0 not in a[:2] and 0 not in b[:2]:
            assert new[k] == (a[:2] != b[:2])
