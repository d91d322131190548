"""Base scores against a plain count, both paths, normalisation, and a gain on held-out text."""

import math
import zlib
from collections import Counter

import numpy as np

from eligspark.llm import lm
from tests.llm.fixtures import documents, frame


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_scores(spark):
    rows = documents()
    counts = Counter(t for i, text in rows if not held_out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    order = lambda r: (str(r[0]), r[1], round(r[2], 6))
    want = sorted(((i, len(tokens(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), held_out(i), sum(counts[w] > 0 for w in tokens(t))) for i, t in rows), key=order)
    results = []
    for most in (lm.BROADCAST_TOKENS, 5):
        got = sorted(((r.doc_id, r.n_tokens, r.base_score, r.held_out, r.n_known, r.train_tokens, r.score) for r in lm.score_documents(frame(spark, rows), most_broadcast=most).collect()), key=order)
        for g, w in zip(got, want, strict=True):
            assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-9) and g[3:5] == w[3:] and g[5] == n
        results.append(got)
    assert all(math.isclose(a[6], b[6], rel_tol=1e-6) for a, b in zip(*results))


def test_degenerate_tables(spark):
    assert lm.score_documents(frame(spark, documents()).limit(0)).count() == 0
    only_held = [(i, "a b") for i in range(60) if held_out(i)]
    got = lm.score_documents(frame(spark, only_held)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    k = lm.CLASSES
    # each class is followed by its successor, nearly always
    walk = np.cumsum(np.r_[0, np.where(rng.random(60_000) < 0.9, 1, rng.integers(0, k, 60_000))]) % k
    triples = np.bincount((walk[:-2] * k + walk[1:-1]) * k + walk[2:], minlength=k**3)
    table = lm.train(triples).log10_table()
    assert np.allclose((10.0**table).sum(1), 1, atol=1e-3)
    learned = table.ravel()[(walk[:-2] * k + walk[1:-1]) * k + walk[2:]].mean()
    assert learned > math.log10(1 / k) + 0.8


def test_class_shares_add_up():
    scorer = lm.Scorer(np.zeros((1, 1)), [], np.array([7] + [0] * (lm.TAILS - 1)), np.array([3] + [0] * (lm.TAILS - 1)), 10, 3)
    shares = 10 ** scorer.within_class(np.full(4, 1 + lm.HEAD), np.array([4, 2, 1, 0]))
    assert math.isclose(shares.sum(), 1)


def test_classes_grow_with_the_vocabulary(spark):
    """40 words of one ending in a fixed order, all less frequent than 79 others: in a class that they share, their order can't tell."""
    rng = np.random.default_rng(0)
    word = [f"w{k}zz" for k in range(40)]
    others = [" ".join(f"other{k}" for k in rng.permutation(79)) for _ in range(400)]
    rare = [" ".join(f"r{k}" for k in range(a, a + 400)) for a in range(0, 40_000, 400)]
    ids = [k for k in range(1000) if held_out(k)]
    windows = [word[k : k + 5] for k in range(36)]
    pairs = [" ".join(w[::o]) for w in windows for o in (1, -1)]
    rows = [(None, t) for t in [*[" ".join(word * 20)] * 10, *others, *rare]] + list(zip(ids, pairs))
    got = {r.doc_id: r.score for r in lm.score_documents(frame(spark, rows)).filter("doc_id is not null").collect()}
    told = [got[ids[2 * k]] > got[ids[2 * k + 1]] + 0.5 for k in range(len(windows))]
    assert sum(told) >= 0.9 * len(windows)
    assert lm.class_sizes(0) == (lm.HEAD, lm.TAILS) and sum(lm.class_sizes(10**8)) > 20 * lm.CLASSES


def test_all_triples_are_counted_and_trained_on(spark):
    rows = documents()
    training = frame(spark, rows).select(lm.text_bytes().alias("text"))
    n, head = lm.CLASSES, []
    packed = lm.class_triples(training, head, lm.HEAD, lm.TAILS, 5)
    classes = lm.WordClass(head, lm.HEAD, lm.TAILS)
    want = Counter(c for _, t in rows for c in lm.codes(np.array([*(classes[w] for w in tokens(t)[:-1]), 0]), n).tolist())
    got = Counter()
    for r in packed.collect():
        code, count = lm.unpack(bytes(r["steps"]), bytes(r["counts"]))
        got.update(dict(zip(code.tolist(), count.tolist())))
    assert got == want
    model = lm.trained(lm.class_triples(training, head, lm.HEAD, lm.TAILS, 1), n)
    code = np.array(sorted(want))
    score = lambda m: float(np.average(m.log10_table().ravel()[code], weights=[want[c] for c in code.tolist()]))
    untrained, _ = lm.new_model(np.bincount(code % n, [want[c] for c in code.tolist()], n))
    assert score(model) > score(untrained) + 0.1
    assert np.isfinite(lm.trained(packed, n).vector()).all()
    assert np.allclose(lm.context_sums(model, spark, 3).ravel(), model.log_sums(*np.divmod(np.arange(n * n), n)), atol=1e-4)
