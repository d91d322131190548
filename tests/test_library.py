"""Sources, sinks, sampling, streams, providers and components on small inputs; the library without its training-data part."""

import os
import random
from datetime import datetime, timedelta
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eligspark.operators import corpus, dedup, evaluation, ml, names, providers, sampling
from eligspark.operators.chunking import chunks
from eligspark.sources import records
from eligspark.streaming import state

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_redownloads(spark):
    names = spark.createDataFrame([("a",), ("a(1)",), ("b(2)",), ("c (3)",), ("c",)], "name string")
    assert sorted(r.name for r in records.without_redownloads(names).collect()) == ["a", "b(2)", "c"]


def test_tolerant_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"slug": "a",\n "n": 1}')
    (tmp_path / "b.json").write_text('{"slug": "b", "n": ')
    (tmp_path / "c.json").write_text('{"n": 3}')
    schema = spark.createDataFrame([], "slug string, n int").schema
    assert [tuple(r) for r in records.read_record_folder(spark, str(tmp_path), schema, ("slug",)).collect()] == [("a", 1)]


def test_csv_and_json_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,label,text\n1,good,"a\nb"\n2, ,c\n3,,d\n')
    assert [r.id for r in records.read_labelled_csv(spark, str(tmp_path / "x.csv"), "label").collect()] == ["1"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert records.read_json_lines(spark, str(tmp_path / "x.jsonl")).filter("a is not null").count() == 2


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "d.bin").write_bytes(b"one\x0ctwo")
    got = records.read_pages(spark, str(tmp_path), lambda c: c.decode().split("\x0c"), "*.bin").collect()
    assert [(r.page, r.text) for r in got] == [(0, "one"), (1, "two")]


def test_shards_resume_and_guard(spark, tmp_path):
    path, calls = str(tmp_path / "index"), []

    def compute(df):
        calls.append(sorted(r.shard for r in df.select("shard").distinct().collect()))
        return df

    rows = spark.range(1200).withColumnRenamed("id", "pos")
    records.write_missing_shards(rows.filter("pos < 600"), path, "pos", compute, "v1")
    records.write_missing_shards(rows, path, "pos", compute, "v1")
    assert calls == [[0, 1], [2]]
    with pytest.raises(ValueError):
        records.write_missing_shards(rows, path, "pos", compute, "v2")
    records.write_missing_shards(rows, path, "pos", compute, "v2", fresh=True)
    assert spark.read.parquet(f"{path}/shards").count() == 1200


def test_manifest_guard(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("x")
    spark.range(3).write.parquet(str(tmp_path / "index"))
    records.write_manifest(spark, str(tmp_path / "m"), {"source_sha256": records.content_digest(spark, str(tmp_path / "src"))})
    args = (spark, str(tmp_path / "index"), str(tmp_path / "m"), str(tmp_path / "src"))
    assert records.guarded(*args).count() == 3
    (tmp_path / "src" / "a.txt").write_text("y")
    with pytest.raises(ValueError):
        records.guarded(*args)


def test_cache_inventory_pending(spark, tmp_path):
    path = str(tmp_path / "cache")
    for seq, value in ((1, "a"), (2, "b")):
        records.append_cache(spark.createDataFrame([("k", seq, value)], "key string, seq int, value string"), path)
    assert [tuple(r) for r in records.last_written(spark.read.parquet(path)).collect()] == [("k", 2, "b")]
    a, b = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "k int, s int"), spark.createDataFrame([(1, 5), (2, 6), (4, 5)], "k int, s int")
    assert {(r.k, r.status) for r in records.inventory(a, b, "k", "s").collect()} == {(1, "same"), (2, "wrong_size"), (3, "missing"), (4, "extra")}
    assert [r.k for r in records.pending(a, b, "k").collect()] == [3]
    assert records.pending(a, b, "k", force=True).count() == 3


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(0, 20), min_size=1, max_size=6), st.integers(0, 60))
def test_allocation(sizes, n):
    given_ = sampling.allocate(n, sizes)
    assert sum(given_.values()) == min(n, sum(sizes.values()))
    assert all(given_[s] <= sizes[s] for s in sizes)
    open_ = [given_[s] for s in sizes if given_[s] < sizes[s]]
    assert not open_ or max(open_) - min(open_) <= len(sizes)


def test_group_folds_and_least(spark):
    rows = spark.createDataFrame([(k, f"g{k % 11}", "a" if k % 3 else "b", "state" if k % 4 else "central") for k in range(60)], "k int, g string, s string, level string")
    folded = sampling.group_folds(rows, "g")
    assert folded.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0 and folded.count() == 60
    sample = rows.filter("level = 'state'").limit(12)
    out = sampling.with_least(sample, rows, "level", "k", "s", {"central": 3})
    assert out.count() == 12 and out.filter("level = 'central'").count() >= 3
    assert sampling.spread_by_length(rows, "k", "k", 5).count() == 5


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 130)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e}


@pytest.mark.parametrize("block", [7, 8192])
def test_vector_pairs(spark, block):
    rnd = random.Random(3)
    vectors = [(k, [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(6)]) for k in range(40)]
    want = {(a, b) for a, u in vectors for b, v in vectors if a < b and sum(x * y for x, y in zip(u, v)) >= 3}
    got = dedup.near_duplicate_pairs(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), 3.0, block=block)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)


def test_chunks(spark):
    from eligspark.schemas import SCHEME, over_null_template

    rows = spark.createDataFrame([("s", " My  Scheme ", "About it", "The applicant must be a resident of the state of Goa. The applicant should be aged eighteen years or more.")], "slug string, scheme_name string, description string, eligibility_text string")
    got = chunks(over_null_template(rows, SCHEME), spark.createDataFrame([("s", "c")], "slug string, category string")).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == ["s::eligibility::000", "s::eligibility::001", "s::overview"]
    assert got[2].text == "My Scheme. About it" and got[0].text.startswith("My Scheme — eligibility: The applicant")
    with pytest.raises(ValueError):
        chunks(over_null_template(rows, SCHEME), spark.createDataFrame([("t", "c")], "slug string, category string"))


def test_keys_and_retries(spark):
    pool = providers.KeyPool(["a", "b"])
    for _ in range(3):
        pool.report("a", "minute", 100.0)
    assert pool.pick(110.0) == "b" and pool.pick(161.0) == "a"
    pool.report("b", "daily", 0)
    assert pool.pick(110.0) is None
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(6)], "key long, prompt string")
    flaky = lambda df: providers.generate(df, lambda p: (p.upper(), "ok") if p != "p3" else (None, "minute"))
    got = {r.key: (r.status, r.attempt) for r in providers.with_retries(prompts, flaky).collect()}
    assert got[3] == ("minute", 3) and got[1] == ("ok", 1) and len(got) == 6
    assert providers.generate(prompts).filter("reply is not null").count() == 0
    assert records.keys_from_environment("K", {"K": "x", "K_3": "y", "K_4": " "}) == ["x", "y"]


def test_names_and_numbers(spark):
    a = spark.createDataFrame([(1, ["kissan", "samman"]), (2, ["other"])], "id long, tokens array<string>")
    b = spark.createDataFrame([(7, ["kisan", "saman", "nidhi"])], "id2 long, tokens2 array<string>")
    assert [tuple(r) for r in names.matching_names(a, b).collect()] == [(1, 7)]


def test_extraction_checks(spark):
    row = spark.range(1)
    errors = providers.profile_errors({"age": F.lit(200), "gender": F.lit("female")}, {"age": F.lit("200"), "gender": F.lit("her daughter")}, F.lit("I am 200 and her daughter"))
    assert row.select(errors.alias("e")).first().e == ["age: out of bounds", "age: not said of oneself", "gender: not said of oneself"]
    assert row.select(providers.translation_errors(F.lit("मेरे पास 2 नहीं"), F.lit("I have 3")).alias("e")).first().e == ["number added", "number lost", "negation lost"]
    kept = providers.without_covered(F.array(F.lit("must be poor"), F.lit("must own land")), F.array(F.lit("must be poor people")))
    assert row.select(kept.alias("k")).first().k == ["must own land"]


def test_stream_of_key_runs_equals_batch(spark, tmp_path):
    """Runs of failures over replayed batches are those of the batch form, and each rest that ends in event time is told."""
    rnd = random.Random(8)
    start = datetime(2024, 1, 1)
    events = [(k, start + timedelta(seconds=11 * k), rnd.randrange(3), rnd.choice(["error", "error", "error", "click"]), 1.0) for k in range(160)]
    events += [(900, start + timedelta(seconds=5000), 7, "click", 1.0), (901, None, 7, "error", 1.0), (902, start + timedelta(seconds=5001), None, "error", 1.0)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for k, part in enumerate([events[:50], events[50:51], events[51:120], events[120:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"e{k}"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = tmp_path / "in"
        folder.mkdir()
        stream = spark.readStream.schema(schema).parquet(str(folder))
        q = state.key_runs(stream).writeStream.outputMode("update").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c")).start()
        for k in range(4):
            for f in (tmp_path / f"e{k}").glob("*.parquet"):
                f.rename(folder / f"{k}-{f.name}")
            q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    rows = spark.sql("select * from runs").collect()
    last = {}
    for r in rows:
        if r.kind == "run" and r.failures > last.get((r.user_id, r["first"]), (0,))[0]:
            last[r.user_id, r["first"]] = (r.failures, r["last"], r.rests_until)
    batch = state.error_runs(spark.createDataFrame([e for e in events if e[1] and e[2] is not None], schema)).collect()
    assert last == {(r.user_id, r["first"]): (r.failures, r["last"], r.rests_until) for r in batch} and len(batch) > 5
    rested = [(r.user_id, r.rests_until) for r in rows if r.kind == "rested"]
    assert rested and set(rested) <= {(u, v[2]) for (u, _), v in last.items()} | {(r.user_id, r.rests_until) for r in rows if r.kind == "run"}


def test_monte_carlo(spark):
    """Near the normal interval of the closed form, alike however rows are dealt, nothing without strata."""
    strata = [("a", 5000, 200, 120), ("b", 3000, 150, 30), ("c", 2000, 100, 90), ("d", 500, 0, 0), ("e", 0, 10, 5)]
    df = spark.createDataFrame(strata, "stratum string, population long, sampled long, hits long")
    got = evaluation.jeffreys_interval(df).first()
    closed = evaluation.post_stratified(df).first()
    assert abs(got.low - closed.normal_low) < 0.005 and abs(got.high - closed.normal_high) < 0.005 and got.draws == 40_000
    assert evaluation.jeffreys_interval(df.repartition(7, "hits")).first() == got
    assert evaluation.jeffreys_interval(df, draws=4_500).first().draws == 4_500
    assert evaluation.jeffreys_interval(df.limit(0)).first().low is None


def test_greedy_phrases_page_by_page(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "rho", "the", "of", "must", "pi"]
    counts = sorted({" ".join(rnd.choices(words, k=4)): rnd.randint(5, 9) for _ in range(300)}.items())
    df = spark.createDataFrame(counts, "gram string, n long")
    kept = []
    for gram, n in sorted(counts, key=lambda x: (-x[1], -len(x[0]), x[0])):
        own = {w for w in gram.split() if w not in corpus.BOILERPLATE}
        if len(kept) < 25 and all(len(own & k) / max(1, min(len(own), len(k))) < 0.75 for _, _, k in kept):
            kept.append((gram, n, own))
    for page in (7, 500):
        assert corpus.top_phrases(df, page=page) == [(g, n) for g, n, _ in kept]
    assert corpus.top_phrases(df.limit(0)) == []


def test_greedy_phrases_rank_all_only_if_they_must(spark, monkeypatch):
    """The counts are made once, and ranked only where the last choice is beyond the first pages."""
    made, ranked, whole = spark.sparkContext.accumulator(0), [], corpus.global_rank
    monkeypatch.setattr(corpus, "global_rank", lambda *a: ranked.append(1) or whole(*a))

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(f"crop loan {'x' * (9 - k % 10)}{k:03d}", 1000 - k) for k in range(100)] + [(f"a{k} b{k}", 100 - k) for k in range(30)]
    df = spark.createDataFrame(rows, "gram string, n long").repartition(3).mapInArrow(counted, "gram string, n long")
    want = [rows[0], *rows[100:124]]
    assert corpus.top_phrases(df, overlap=0.6) == want and not ranked and made.value == len(rows)
    assert corpus.top_phrases(df, overlap=0.6, page=1) == want and len(ranked) == 1 and made.value == 2 * len(rows)


def test_language_swaps(spark):
    rows = [(k, ["en", "en", "en", "de", "fr", None][k % 6], k % 2) for k in range(60)] + [(None, "es", 1), (100, "es", 1), (101, "it", 0)]
    df = spark.createDataFrame(rows, "k long, lang string, good int").withColumn("split", F.when(F.col("lang").isin("en") & (F.col("k") < 12), "dev").otherwise("test"))
    got = {r.k: r.split for r in sampling.language_swaps(df, "k", "lang", F.col("good") == 1).collect() if r.k is not None}
    before = {r.k: r.split for r in df.collect() if r.k is not None}
    lang = {k: x for k, x, _ in rows}
    good = {k for k, _, g in rows if g == 1}
    moved_in, moved_out = ({k for k in got if got[k] != before[k] and got[k] == s} for s in ("dev", "test"))
    lacking = {x for k, x in lang.items() if k in good and x} - {lang[k] for k in good if before.get(k) == "dev"}
    assert sorted(lang[k] for k in moved_in) == sorted(lacking)[: len(moved_out)] and moved_in <= good
    assert all(lang[k] == "en" and k in good for k in moved_out) and len(moved_in) == len(moved_out) > 0
    assert sampling.language_swaps(df.limit(0), "k", "lang", F.col("good") == 1).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(4)
    events = [(k, k, rnd.randrange(3), rnd.choice(["error", "error", "click"]), 1.0) for k in range(90)]
    schema = "event_id long, ts long, user_id long, event_type string, value double"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    q = state.cooldowns(stream).writeStream.outputMode("update").format("memory").queryName("cool").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {}
    for u in range(3):
        strikes = rests = 0
        for e in events:
            if e[2] == u:
                strikes = strikes + 1 if e[3] == "error" else 0
                if strikes == 3:
                    rests, strikes = rests + 1, 0
        want[u] = (rests, strikes)
    assert {r.user_id: (r.cooldowns, r.strikes) for r in spark.sql("select * from cool").collect()} == want
    q = state.append_to_cache(stream.withColumn("key", F.col("user_id")), str(tmp_path / "cache"), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 3
    hours = stream.withColumn("ts", F.timestamp_seconds("ts"))
    q = state.windowed_counts(hours).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) as n from hours").first().n == 90


def test_estimators(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(k, [rnd.gauss(2.0 * (k % 2), 0.5), rnd.gauss(0, 1)], k % 2) for k in range(80)]
    df = ml.vector_features(spark.createDataFrame(rows, "key long, embedding array<double>, label int"))
    folded = sampling.folds(df, "label", "key").cache()
    for name in ("lr", "svc", "rf"):
        got = ml.fold_predictions(folded, name, folds=2 if name == "svc" else 5, trees=5) if name != "svc" else ml.fold_predictions(folded.withColumn("fold", F.col("fold") % 2), name, folds=2)
        assert got.filter("predicted = y").count() / got.count() > 0.9
    balanced = ml.class_weights(df.filter("key < 60 or label = 0"), "label").groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert abs(balanced[0].w - balanced[1].w) < 1e-9
    model = ml.refit_and_save(df, "lr", 1.0, str(tmp_path / "model"))
    assert model.numClasses == 2
    points, explained = ml.principal_components(df, "key")
    assert points.count() == 80 and explained[0] >= explained[1]
    assert ml.widened_grid(lambda grid: {c: c for c in grid})[0] == 10000.0
    assert ml.widened_grid(lambda grid: {c: -abs(c - 1) for c in grid})[0] == 1.0
    assert ml.one_hot(["label"]).fit(df).transform(df).columns[-1] == "label_v"


def test_works_without_the_training_data_part(tmp_path):
    """Imports of the entry module where the subpackage and the pipeline are gone."""
    code = "import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('eligspark.llm') or name == 'corpus_pipeline':\n            raise ImportError(name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert 'search_bm25' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()\nprint(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
