"""Verdicts and reasons as one plan, stored indexes, containment, ranks and the scratch folder, each on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from eligspark import storage
from eligspark.operators import corpus, evaluation, sampling, search, serving
from eligspark.operators import postprocess as P
from eligspark.plans import fixtures, rules

DATA = "/root/testdata/sf0.001"


def test_finalize_only_lowers_what_the_matcher_made(spark):
    rows = rules.finalized(spark, DATA).select("status", "final_status", "final_reason", "caveats").collect()
    order = {"eligible": 0, "needs_checking": 1, "not_eligible": 2}
    assert {r.status for r in rows} == set(order)
    assert all(r.final_status == r.status or (r.status, r.final_status) == ("eligible", "needs_checking") for r in rows)
    assert any(r.final_status != r.status for r in rows) and all(r.final_reason for r in rows)
    assert all(r.caveats == [] for r in rows if r.status == "not_eligible")


def test_answers_of_the_serving_plan(spark):
    pairs = fixtures.matching_pairs(spark, DATA).filter("query_id <= 20").withColumns({"c_residuals": F.array(F.lit("must own a cow"), F.lit(P.DEPENDENT_NOTE)), "lang": F.lit("te")})
    chunks = spark.createDataFrame([(1, 7, "Own a cow.", "eligibility"), (2, 7, "Overview.", "overview")], "chunk_id long, slug long, raw_text string, section string")
    schemes = pairs.select("slug", F.lit("One must own a cow to apply").alias("eligibility_text"), F.lit("Aadhaar card\nPassbook").alias("documents_text")).distinct()
    rows = serving.answers(pairs, chunks, schemes=schemes).collect()
    assert len(rows) == pairs.count() and all(r.documents == ["Aadhaar card", "Passbook"] for r in rows)
    live = [r for r in rows if r.status != "not_eligible"]
    assert live and all(r.caveats == ["must own a cow"] and r.caveats_verbatim == [True] for r in live)
    assert all(r.requires_dependent_note and r.unverified == ["must own a cow"] for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r.query_id, []).append(r.place)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


def test_stored_indexes_refuse_other_sources(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"alpha beta{k % 3} gamma{k}") for k in range(40)], "doc_id long, text string")
    index = search.LexicalIndex.build(docs, str(tmp_path / "lexical"))
    asked = spark.createDataFrame([(1, "gamma7 beta1"), (2, "beta2"), (3, "nothing here")], "item_id long, text string")
    want = sorted((r.item_id, r.doc_id, round(r.score, 9), r.rnk) for r in search.search_bm25(asked, docs, 5).collect())
    loaded = search.LexicalIndex.load(spark, index.path, docs)
    assert sorted((r.item_id, r.doc_id, round(r.score, 9), r.rnk) for r in loaded.search(asked, 5).collect()) == want and want
    with pytest.raises(ValueError):
        search.LexicalIndex.load(spark, index.path, docs.filter("doc_id > 0"))
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "vec_id long, embedding array<float>")
    near = search.VectorIndex.build(vectors, str(tmp_path / "vectors")).search(vectors.withColumnRenamed("vec_id", "item_id"), 1)
    assert sorted((r.item_id, r.vec_id) for r in near.collect()) == [(0, 0), (1, 1)]
    with pytest.raises(ValueError):
        search.VectorIndex.load(spark, str(tmp_path / "vectors"), vectors.limit(1))
    with pytest.raises(ValueError):
        search.VectorIndex.build(vectors.withColumn("embedding", F.array(F.lit(2.0))), str(tmp_path / "bad"))


def test_containment_is_exact(spark):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice(["ab", "a", " ", "  ", "b.", "é"]) for _ in range(n))
    docs = [(k, text(60)) for k in range(40)] + [(50, None), (51, "")]
    passages = [(k, docs[k][1][5 : 5 + n]) for k, n in enumerate([1, 3, 8, 15, 20, 30, 50] * 4)] + [(90, "zz zz zz"), (91, None), (92, "")]
    got = corpus.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string"), "doc_id", "item_id")
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, d) for i, p in passages for d, t in docs if p and t and p in t)
    assert corpus.containing(spark.createDataFrame(docs, "doc_id long, text string").limit(0), spark.createDataFrame(passages, "item_id long, text string"), "doc_id", "item_id").count() == 0


def test_ranks_in_slices(spark):
    import hashlib

    rows = [(k, "hot" if k % 4 else None if k % 8 else "cold") for k in range(500)]
    df = spark.createDataFrame(rows, "k long, g string")
    want, seen = {}, {}
    for k, g in sorted(rows, key=lambda r: (hashlib.md5(f"s{r[0]}".encode()).hexdigest(), r[0])):
        seen[g] = seen.get(g, 0) + 1
        want[k] = seen[g]
    assert {r.k: r.place for r in sampling.hashed_rank(df, "g", "k", "s", "place").collect()} == want
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert [r.k for r in sampling.global_rank(df, ["g", "k"], "place").orderBy("place").collect()] == [k for k, _ in order]


def test_the_test_split_is_refused(spark):
    gold = spark.createDataFrame([(1, "dev", None), (2, "test", None), (3, "dev", True)], "id int, split string, skip_scoring boolean")
    assert [r.id for r in evaluation.gold_rows(gold, "dev").collect()] == [1]
    assert [r.id for r in evaluation.gold_rows(gold, "test", final=True).collect()] == [2]
    for rows, split in ((gold, "test"), (gold.withColumn("split", F.lit(None).cast("string")), "dev")):
        with pytest.raises(ValueError):
            evaluation.gold_rows(rows, split)


def test_scratch_is_the_applications_own(spark):
    root = storage.scratch_root(spark)
    assert spark.sparkContext.applicationId in root and storage.scratch_path(spark, "x").startswith(root)
