"""Statistics against plain counting, learned lists on planted junk, and clean rows kept."""

import os
import re
from collections import Counter

import pytest

from eligspark.llm import quality as Q
from tests.llm.fixtures import documents, frame, key


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), repeated, len(covered)


def test_statistics(spark):
    rows = [*documents(), (500, "a b c d e " * 30), (501, "x\ny\nx\n\n \nx"), (502, "a b c d e f a b c d e g"), (503, "#|<> $%&* a" * 5), (504, "\x1c\x85   word"), (505, "é\n" * 7)]
    got = Q.text_statistics(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, *(r[c] for c in Q.STATISTICS)) for r in got), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert Q.text_statistics(frame(spark, rows).limit(0)).count() == 0


def test_learned_list_on_planted_junk(spark):
    clean = [(k, " ".join(f"w{j}{k}" for j in range(30))) for k in range(60)]
    junk = [(100 + k, " ".join(f"w{j}{k}###" for j in range(30))) for k in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk] + [(None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, clean + junk)
    rules = Q.learn_rules(Q.labelled_statistics(docs, labels))
    assert rules and all(r.label == 0 for r in rules)
    kept = {r.doc_id for r in Q.judge(docs, rules).collect() if r.kept}
    assert kept == {i for i, _ in clean}
    assert sorted(r.doc_id for r in Q.keep_good(docs, rules).collect()) == sorted(kept)
    assert Q.keep_good(docs, rules).columns == docs.columns


def test_verdict_is_the_list(spark):
    rules = [Q.Rule((("n_words", 1, 20.0), ("symbol_share", 1, 0.5)), 0), Q.Rule((("mean_word", -1, 2.0),), 0)]
    rows = documents()
    got = {(r.doc_id, r.n_words, r.word_chars): r.kept for r in Q.judge(frame(spark, rows), rules).collect()}
    for i, t in rows:
        n, chars, symbols, _, repeated = brute(t)
        values = {"n_words": n, "mean_word": chars / max(n, 1), "symbol_share": symbols / max(chars, 1), "dup_line_share": 0, "repeat_share": 0}
        bad = n < 10 or 100 * repeated > 20 * n or any(r.holds(values) for r in rules)
        assert got[i, n, chars] == (not bad)


def test_no_labels_keep_what_the_base_keeps(spark):
    docs = frame(spark, documents())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.learn_rules(Q.labelled_statistics(docs, labels)) == []
    assert Q.judge(docs, []).filter("kept = base_failed").count() == 0


def test_rules_hold_on_rows_that_they_were_not_learned_from(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    rows = Q.labelled_statistics(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    scores = Q.held_out_scores(rows)
    assert scores["n"] > 50 and scores["recall"] >= 0.9 and scores["others_left_alone"] >= 0.98
    assert Q.held_out_scores([]) == {"n": 0, "recall": 1.0, "precision": 1.0, "others_left_alone": 1.0}
