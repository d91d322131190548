"""What large tables meet: work that grows with the tables, and no faster."""

import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eligspark.functions import rules as rules_of
from eligspark.operators import chunking, corpus, dedup, matcher, ml, postprocess, search
from eligspark.plans import fixtures, matching, rules

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_ranked_lists_are_bounded_by_the_rests(spark, tmp_path):
    """Profiles of one rest share a list, and records of one residue beyond the first k never join."""
    one = lambda name, key, keys: spark.read.parquet(f"{DATA}/{name}.parquet").limit(1).drop(key).crossJoin(spark.createDataFrame([(k,) for k in keys], f"{key} long")).write.parquet(f"{tmp_path}/{name}.parquet")
    prime = fixtures.PRIME
    queries = [1, 2, 7, 1 + prime, 1 + 2 * prime, 2 + 60 * prime]
    slugs = [3 + prime * i for i in range(40)] + [11, 500, 9000] + [4000 + 5 * prime]
    one("customer", "c_custkey", queries)
    one("part", "p_partkey", slugs)
    want = set()
    for q in queries:
        ranked = sorted(slugs, key=lambda s: ((s * fixtures.STEP + q * fixtures.SHIFT) % prime, s))
        want |= {(q, s, n) for n, s in enumerate(ranked[:10], 1)}
    assert {tuple(r) for r in fixtures.candidates(spark, str(tmp_path)).collect()} == want
    assert fixtures.ranked_lists(spark, str(tmp_path)).count() == 3 * 10
    pairs = fixtures.matching_pairs(spark, str(tmp_path))
    assert {(r.query_id, r.slug, r.rnk) for r in pairs.select("query_id", "slug", "rnk").collect()} == want


def test_sentence_breaks_look_for_the_stop_first(spark):
    """The same breaks as when what stands before is looked at first, in a fraction of the time."""
    stays = "".join(chunking.STAYS.values())
    plain = rf"(?:[!?]|{stays}\.)['\")\]]?{chunking.NEXT}|(?<=[.:;]\s?)(?<!(?:^|[^\p{{L}}\p{{N}}_])[A-Za-z]\.\s?)(?={chunking.ITEM})|(?<=[a-z]{{2}})(?=(?:{chunking.GLUED}){chunking.WORD_END})"
    regex = spark.sparkContext._jvm.java.util.regex.Pattern
    rnd = random.Random(7)
    words = ["The", "applicant", "Rs.", "e.g.", "B.Tech.", "No.", "1.", "2)", "(a)", "iv.", "x.", "end.", "end.\"", "what?", "•", "textThe", "textIf", ":", ";", "Über.", "é", " ", "  ", "."]
    texts = ["".join(rnd.choice(words) + rnd.choice(["", " ", " "]) for _ in range(30)) for _ in range(400)]
    split = lambda pattern, text: regex.compile(pattern).matcher(text).replaceAll("$0|")
    assert [split(chunking.BREAK, t) for t in texts] == [split(plain, t) for t in texts]
    long = "abcdefgh ijklm, nopqrstuvw " * 20_000
    took = []
    for pattern in (chunking.BREAK, plain):
        split(pattern, long[:50_000])
        start = time.perf_counter()
        split(pattern, long)
        took.append(time.perf_counter() - start)
    assert 2 * took[0] < took[1]


def test_verdicts_build_no_records_and_read_texts_once_a_record(spark):
    """A verdict needs results only, no JSON of constraints and values; what a record's text admits is read below the pairs."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    rows = matching.evaluated(spark, DATA)
    assert "StructsToJson" not in plan(rows.select("query_id", "slug", "status", "reason"))
    assert "StructsToJson" not in plan(matcher.condition_rows(rows, ("query_id", "slug"), details=False))
    assert "StructsToJson" in plan(matcher.condition_rows(rows, ("query_id", "slug")))
    above, below = plan(rules.match_every_condition(spark, DATA)).split("Join", 1)
    assert "regexp_extract_all" not in above and "regexp_extract_all" in below


def test_best_of_rows_sorts_what_may_be_among_the_best():
    """As a full sort by score and key gives them, ties and NaN included."""
    rng = np.random.default_rng(5)
    keys = rng.permutation(300)
    scores = np.round(rng.random((40, 300)), 2)
    scores[3, :], scores[5, 10:290] = 0.5, np.nan
    for k in (1, 7, 299, 300, 400):
        x, y = search.best_of_rows(scores, keys, k)
        for r in range(len(scores)):
            want = sorted(range(300), key=lambda c: (np.isnan(scores[r, c]), -scores[r, c] if not np.isnan(scores[r, c]) else 0, keys[c]))[:k]
            assert y[x == r].tolist() == want


def test_bounds_read_a_text_once(spark):
    """Each pattern of a bound is searched for once a group, however often the parts are used."""
    rows = spark.createDataFrame([("must be at least 1,000 rupees",), ("between 18 and 40 years",), ("of any age",), (None,)], "t string").select(rules_of.stated_bound(F.col("t"), "age").alias("b"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 7
    assert [r.b and (r.b.low, r.b.high) for r in rows.collect()] == [None, (18.0, 40.0), None, None]


def test_reasons_parse_json_once(spark):
    """A record's and a profile's JSON is made below the pairs; a sentence parses each part once."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan(matcher.condition_rows(matching.evaluated(spark, DATA), ("query_id", "slug"))).split("Join", 1)
    assert "max_annual_inr" not in above and "max_annual_inr" in below
    sentence = plan(spark.range(1).select(postprocess.failed_reason(F.from_json(F.lit("[]"), "array<struct<field:string,result:string,decisive:boolean,constraint:string,profile_value:string>>"), F.lit("en")).alias("r")))
    assert sentence.count("$.min,") <= 1 and sentence.count("$.max_annual_inr") <= 1


def test_verdicts_are_made_once_where_many_steps_read_them(spark):
    """Flags and end-to-end rates read the verdicts several times, and make them once."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    for query in (rules.flagged_down, rules.end_to_end):
        assert matcher.DECIDING not in query(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_scored_where_they_are_read(spark, monkeypatch):
    """The best of each query as from all pairs' scores, of which none is shuffled; documents go on over any bounds of batches and tiles."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(f"é{i}" if i % 3 else f"z{i}", " ".join(rnd.choice(words[: 5 + i % 55]) for _ in range(i % 40))) for i in range(300)]
    asked = [(i, " ".join(rnd.choice(words) for _ in range(8))) for i in range(25)] + [(99, "absent")]
    documents, queries = spark.createDataFrame(docs, "doc_id string, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string")
    rows = lambda df: sorted((r.item_id, r.doc_id, round(r.score, 6), r.rnk) for r in df.collect())
    found = search.search_bm25(queries, documents, 7)
    assert rows(found) == rows(search.top_k(search.bm25_scores(queries, documents), "item_id", "doc_id", 7))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 1
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 20 * 9, 120))
    weights = search.Weights(pairs // 9, pairs % 9, rng.random(len(pairs)), 9, 12.0)
    doc, term, length = np.sort(rng.integers(0, 30, 500)), rng.integers(0, 20, 500), np.full(500, 10)
    whole = weights.scores(doc, term, length, np.ones(500, int), 30)
    monkeypatch.setattr(search, "TILE", 7)
    assert np.allclose(weights.scores(doc, term, length, np.ones(500, int), 30), whole)
    tf = np.zeros((30, 20))
    np.add.at(tf, (doc, term), 1)
    table = np.zeros((20, 9))
    table[np.repeat(np.arange(len(weights.first) - 1), np.diff(weights.first)), weights.queries] = weights.values
    assert np.allclose(whole, (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 10 / 12.0))) @ table)


def test_phrases_travel_packed(spark):
    """Counts as from the strings themselves; numbers survive packing, whatever lies between them, at two bytes where they are dense."""
    rng = np.random.default_rng(2)
    for values in (np.empty(0, np.uint64), np.array([0, 0, 65534, 65535, 131070, 131071, (1 << 26) - 1], np.uint64), np.sort(rng.integers(0, 1 << 26, 16_000).astype(np.uint64))):
        assert corpus.unpacked(corpus.packed(values)).tolist() == values.tolist()
    assert len(corpus.packed(values)) < 2.2 * len(values)
    slots = np.sort(rng.integers(0, 1 << corpus.SLOT_BITS, 5000).astype(np.uint64))
    batch = corpus.bucketed(rng.permutation(slots))
    back = [corpus.unpacked(v.as_py()) + np.uint64(b.as_py() << corpus.VALUE_BITS) for b, v in zip(batch.column("bucket"), batch.column("slots"), strict=True)]
    assert np.concatenate(back).tolist() == slots.tolist()
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["crop", "the", "loan", "of", "farm"]) for _ in range(rnd.randrange(40))) for _ in range(60)]
    want = {}
    for t in texts:
        w = t.split()
        for g in {" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}:
            if sum(x not in corpus.BOILERPLATE for x in g.split()) >= 2:
                want[g] = want.get(g, 0) + 1
    rows = corpus.phrase_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", (2, 3), 4)
    assert {r.gram: r.n for r in rows.collect()} == {g: n for g, n in want.items() if n >= 4}


def test_phrases_are_cut_out_of_bytes(spark, monkeypatch):
    """Words, sequences and their strings as from split texts, whatever the runs, the length of words and the number of passes."""
    rnd = random.Random(8)
    long = "ä" * 200
    words = ["crop", "the", "applicant", "applicants", "applican", "eightlet", "ninelette", "é", "ö_1", "௧௨", "under", "underthe", long + "x", long + "y"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(30))) for _ in range(900)] + ["", "crop", "crop loan"]
    table = corpus.Words(pa.array(["off", *texts, "off"]).slice(1, len(texts)))
    raw = [table.bytes[a:b].tobytes().decode() for a, b in zip(table.starts, table.ends, strict=True)]
    assert raw == [w for t in texts for w in t.split()] and table.text.tolist() == [k for k, t in enumerate(texts) for _ in t.split()]
    assert table.hashes()[1].tolist() == [w not in corpus.BOILERPLATE for w in raw]
    seen = {}
    for n, at, h in table.sequences((1, 2, 3), 1):
        got = table.strings(at, at + n - 1).to_pylist()
        assert sorted(got) == sorted(" ".join(w[i : i + n]) for t in texts for w in [t.split()] for i in range(len(w) - n + 1) if any(x not in corpus.BOILERPLATE for x in w[i : i + n]))
        seen |= {(n, g, int(x)): 1 for g, x in zip(got, h, strict=True)}
    # one hash a string; only words that differ after their first bytes share one
    assert len(seen) == len({g for _, g, _ in seen}) and len({h for _, _, h in seen}) == len({g.replace("y", "x") for _, g, _ in seen})
    want = {}
    for t in texts:
        w = t.split()
        for g in {" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}:
            if sum(x not in corpus.BOILERPLATE for x in g.split()) >= 2:
                want[g] = want.get(g, 0) + 1
    df = spark.createDataFrame([(k, t.replace(" ", " -\t")) for k, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(corpus, "LEAST_BITS", 13)
    assert sum(n >= 2 for n in want.values()) > 2048  # three passes where there are 8,192 bits
    for most in (30, 13):
        monkeypatch.setattr(corpus, "MOST_BITS", most)
        rows = corpus.phrase_counts(df, "doc_id", "text", (2, 3), 2).collect()
        assert len(rows) == len({r.gram for r in rows}) and {r.gram: r.n for r in rows} == {g: n for g, n in want.items() if n >= 2}
    assert [len(w.starts) for w in corpus.in_runs(pa.array(["a b", "c", "d e f g h", "", "i"]), 4)] == [3, 5, 1]
    slots = corpus.distinct(np.random.default_rng(1).integers(0, 1 << corpus.SLOT_BITS, 5000).astype(np.uint64))
    for bits in (13, 17, 30):
        both = corpus.marks(slots, bits)
        assert all(((p >> np.uint64(bits - 10)) == (slots >> np.uint64(corpus.VALUE_BITS))).all() for p in both)
        bitmap = np.zeros((1 << bits) // 8, np.uint8)
        for p in both:
            np.bitwise_or.at(bitmap, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        assert len(corpus.marked_in(bitmap, slots, bits)) == len(slots)


def test_terms_are_counted_where_texts_are_read(spark, tmp_path):
    """Postings and lengths of vectors as from exploded terms, without a shuffle; an index gives many queries what a search does."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(50)] + ["die", "the"]
    documents = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(i % 30))) for i in range(1300)] + [(5000, None)], "doc_id long, text string").coalesce(1)
    counted = search.counted_terms(documents)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(counted)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(counted.select("doc_id", "term", "tf")) == rows(search.postings(documents))
    assert rows(counted.select("doc_id", "len").distinct()) == rows(search.lengths(documents).filter("len > 0"))
    weights = ml.tfidf_terms(documents, "doc_id", "text", 2, 1.0)
    assert "Aggregate" not in plan(weights) and "Window" not in plan(weights)
    norms = {}
    for r in weights.collect():
        norms[r.doc_id] = norms.get(r.doc_id, 0.0) + r.weight**2
    assert len(norms) == search.lengths(documents).filter("len > 0").count() and all(abs(v - 1) < 1e-4 for v in norms.values())
    queries = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(6))) for i in range(search.FEW_QUERIES + 8)], "item_id long, text string")
    found = search.LexicalIndex.build(documents, str(tmp_path / "lexical")).search(queries, 6)
    assert "Aggregate" not in plan(found)
    best = lambda df: sorted((r.item_id, r.doc_id, round(r.score, 6), r.rnk) for r in df.collect())
    assert best(found) == best(search.search_bm25(queries, documents, 6))


def test_whole_documents_are_cut_between_documents():
    import pyarrow as pa

    keys = np.repeat([3, 1, 4, 1, 5, 9], [1, 70, 2, 2, 40, 1])
    table = pa.table({"key": keys, "at": np.arange(len(keys))})
    for size, most in ((1, 5), (7, 5), (7, 60), (200, 1), (3, 1000)):
        parts = list(search.whole_documents(iter(table.to_batches(max_chunksize=size)), most))
        assert pa.concat_tables(parts).column("at").to_pylist() == list(range(len(keys)))
        assert all(a.column("key")[-1] != b.column("key")[0] for a, b in zip(parts[:-1], parts[1:], strict=True))


def test_only_wanted_conditions_are_listed(spark):
    """Conditions of other fields are neither made nor listed, and the verdict is that of all."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    pairs = fixtures.matching_pairs(spark, DATA).limit(300)
    pairs = spark.createDataFrame(pairs.collect(), pairs.schema)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole, part = matcher.evaluate(pairs), matcher.evaluate(pairs, fields=("land",))
    keys = ("query_id", "slug")
    listed = lambda df: matcher.condition_rows(df, keys, details=False)
    assert rows(listed(part)) == rows(listed(whole).filter("field = 'land'")) != []
    assert rows(part.select(*keys, "status", "reason")) == rows(whole.select(*keys, "status", "reason"))


def test_near_pairs_go_out_tile_by_tile(spark, monkeypatch):
    """A task of the near-duplicate search holds one tile of scores and its pairs; together they are those of brute force."""
    import pyarrow as pa
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    taken, whole = [], PandasGroupedOpsMixin.applyInArrow
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", lambda self, run, schema: taken.append(run) or whole(self, run, schema))
    rng = np.random.default_rng(4)
    points = rng.normal(size=(90, 8))
    points /= np.linalg.norm(points, axis=1)[:, None]
    found = dedup.near_duplicate_pairs(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>"), 0.4, block=40)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if points[i] @ points[j] >= 0.4}
    assert {(r.a, r.b) for r in found.collect()} == want
    monkeypatch.setattr(dedup, "TILE", 200)
    table = pa.table({"k": np.arange(90), "v": points.tolist(), "own": pa.array(np.arange(90) % 2, pa.int32())})
    parts = [list(taken[0]((pa.scalar(i), pa.scalar(j)), iter(table.to_batches(max_chunksize=7)))) for i, j in ((0, 0), (0, 1), (1, 1))]
    assert all(len(p) >= 10 for p in parts)
    pairs = [(a, b) for p in parts for batch in p for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
    assert sorted(pairs) == sorted(want)
