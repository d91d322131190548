"""The pipeline's stages on a small corpus, each held against its operator's brute force."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.fixtures import prose  # noqa: E402
from tests.llm.test_jaccard import shingles  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    clean = [(k, prose(rnd, 60)) for k in range(80)]
    passage = prose(rnd, 30)
    rows = [*clean, (100, clean[5][1]), (101, clean[6][1] + " tail"), (102, "too short"), (103, clean[7][1][:200] + " " + passage + " " + prose(rnd, 30)), (None, prose(rnd, 60)), (104, None)]
    rows += [(200 + k, " ".join(w + "###" for w in prose(rnd, 40).split())) for k in range(20)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i is not None and (i < 80 or i >= 200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    assert ids["quality_rules"] == {*range(80), 100, 101, 103, None}
    assert ids["near_duplicates"] == ids["quality_rules"] - {100, 101}
    texts = [r.text for r in seen["near_duplicates"]]
    for a in range(len(texts)):
        for b in range(a):
            x, y = shingles(texts[a], 5), shingles(texts[b], 5)
            assert 100 * len(x & y) < 80 * len(x | y)
    assert ids["decontamination"] == ids["near_duplicates"] - {103}
    assert ids["mixing"] <= ids["decontamination"]
    assert len(seen["sharding"]) == len(seen["mixing"]) and {r.shard for r in seen["sharding"]} <= set(range(16))


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def tables(spark, path, documents, labels=(), items=()):
    names = "doc_id long, text string, lang string, source string, n_chars long, rate double, law string, __row string, n_copies int"
    spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 0.5, "law", "row", 3) for i, t in documents], names).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_clashing_columns_repeated_rows_and_long_texts(spark, tmp_path):
    rnd = random.Random(3)
    long = prose(rnd, 9000)
    rows = [*((k, prose(rnd, 40)) for k in range(12)), (1, None), (None, ""), (20, long), (21, long), (3, "x"), (None, None)]
    rows += [rows[4], rows[4]]
    path = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        got = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in got) == [*range(12), 20]
        if name == "mixing":
            read = len(got)
    assert len(got) == read and {r.doc_id for r in got} <= {*range(12), 20}


def test_empty_tables(spark, tmp_path):
    path = tables(spark, tmp_path, [])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0
