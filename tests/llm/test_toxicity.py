"""Toxicity: held-out accuracy, and the models' probabilities against their definition."""

import os
import random
import zlib

import numpy as np
import pytest

from eligspark.llm import toxicity
from tests.llm.fixtures import frame, prose

BAD = ["grunk", "vilbor", "snarfel"]


def corpus(n=500, seed=2):
    """(doc_id, text, toxic): toxic rows have two to four bad words, one in three as a stem with a new ending."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        words = prose(rnd, rnd.choice([12, 40, 150])).split(" ")
        toxic = int(k % 6 == 0)
        for _ in range(rnd.randint(2, 4) * toxic):
            bad = rnd.choice(BAD)
            words[rnd.randrange(len(words))] = bad + rnd.choice(["", "", rnd.choice(["ing", "ell", "que", "ß"])])
        rows.append((k, " ".join(words), toxic))
    return rows


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def run(spark, rows, labels, **kw):
    labels = spark.createDataFrame([(i, t, 1, "x") for i, t in labels], "doc_id long, toxic int, score int, text string")
    return toxicity.score_toxicity(frame(spark, rows), labels, **kw)


def test_held_out_accuracy(spark):
    rows = corpus()
    got = run(spark, [r[:2] for r in rows], [(i, t) for i, _, t in rows]).collect()
    truth = {i: t for i, _, t in rows}
    rest = [r for r in got if r.held_out]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == is_held_out(r.doc_id) for r in got)
    hit = sum(r.predicted and truth[r.doc_id] for r in rest)
    assert hit >= 0.95 * sum(truth[r.doc_id] for r in rest)
    assert hit >= 0.95 * sum(r.predicted for r in rest)


def test_labels_of_held_out_rows_and_other_columns_do_not_count(spark):
    rows = corpus(200)
    labels = [(i, t) for i, _, t in rows]
    other = [(i, 1 - t if is_held_out(i) else t) for i, t in labels]
    first, second = ([tuple(r) for r in run(spark, [r[:2] for r in rows], x).orderBy("doc_id").collect()] for x in (labels, other))
    assert first == second


def test_odd_rows(spark):
    rows = [r[:2] for r in corpus(150)] + [(900, None), (901, ""), (902, " \n "), (903, "grunk vilbor grunk vilbor " * 20_000), (None, "grunk vilbor"), (None, None), (3, "again"), (3, "again"), (904, "«GRUNK» “vilbor”")]
    got = run(spark, rows, [(i, t) for i, _, t in corpus(150)] + [(None, 1), (1, None), (0, 1), (0, 0), (7777, 1)]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score == by[902].score < 0.3
    assert by[903].predicted == by[904].predicted == 1
    assert [r.score for r in got if r.doc_id is None][0] > 0.3
    assert len({r.score for r in got if r.doc_id == 3}) == 2


@pytest.mark.parametrize("labels", [[], [(k, 0) for k in range(60)], [(k, 1) for k in range(60)]])
def test_without_both_classes(spark, labels):
    got = run(spark, [r[:2] for r in corpus(60)], labels).collect()
    assert len(got) == 60 and len({r.score for r in got}) == 1
    assert got[0].predicted == int(bool(labels) and labels[0][1] == 1)


def test_empty(spark):
    assert run(spark, [], [(1, 1)]).count() == 0


def test_bound_on_words(spark):
    rows = corpus(200)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    part = toxicity.learn(frame(spark, [r[:2] for r in rows]), labels, most_words=3000)
    whole = toxicity.learn(frame(spark, [r[:2] for r in rows]), labels)
    assert len(part.models.word) < len(whole.models.word)


def test_models_are_distributions():
    """Over known words, and behind any word, each class's probabilities come to 1 at most, and nearly so."""
    texts = [t.split() for t in ("a b a b c", "a b c c d", "x y a b", "stemone stemtwo a", "x y x y z", "stemthree x y")]
    names: dict = {}
    texts = [np.array([names.setdefault(w.encode(), len(names)) for w in t]) for t in texts]
    hashes, stems = toxicity.word_hashes(list(names)), toxicity.stem_hashes(list(names))
    models = toxicity.learned(texts, np.array([0, 0, 0, 0, 1, 1]), hashes, stems)
    p = models.words(hashes, stems)
    assert ((p > 0) & (p < 1)).all()
    assert (p.sum(axis=2) <= 1 + 1e-9).all()
    for before in [*hashes, toxicity.START]:
        place = toxicity.place_of(models.pair, toxicity.bigram(np.full(len(hashes), before), hashes))
        upper = np.column_stack([models.upper, np.zeros(2)])[:, place].sum(axis=1)
        weight = models.context[:, -1] if before == toxicity.START else models.behind_word(np.array([before]))[:, 0]
        assert (np.abs(upper + weight - 1) < 1e-9).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_rows_of_the_tables(spark):
    """Labels there are noisy: of 180 held-out toxic rows some have no expression that marks one."""
    from eligspark.llm.queries import op11_toxicity

    scores = op11_toxicity(spark, "/root/testdata/sf0.1")
    rows = scores.filter("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    positive, negative = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    ranks = np.argsort(np.argsort(positive + negative))
    area = (ranks[: len(positive)].sum() - len(positive) * (len(positive) - 1) / 2) / (len(positive) * len(negative))
    assert area > 0.88
    assert sum(s >= 0.3 for s in negative) < 0.03 * len(negative)
