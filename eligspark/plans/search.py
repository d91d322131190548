"""Queries of the retrieval side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligspark.functions.text import STOP_WORDS, bm25_tokens, dot, is_unit
from eligspark.operators import search as S
from eligspark.operators.evaluation import false_inclusion, retrieval_metrics, scored_positive, upper_median
from eligspark.plans.fixtures import GOLD, gold
from eligspark.storage import materialize, scratch_path
from eligspark.tables import table

STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
TOKENS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: not list_contains({STOPS}, w))"
INDEX = f"""d as (select doc_id, {TOKENS} as w from documents),
post as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from d) group by all),
st as (select count(*) as n_docs, avg(len(w)) as avgdl from d),
df as (select term, count(*) as df, ln(max(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from post, st group by term),
idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from df) else raw end as idf from df)"""
BM25 = f"""{INDEX},
q as (select item_id, term, count(*) as qtf from (select item_id, unnest({TOKENS}) as term from benchmark) group by all),
sc as (select q.item_id, p.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.w) / avgdl))) as score
  from q join idf using (term) join post p using (term) join d on d.doc_id = p.doc_id, st group by all),
lex as (select item_id, doc_id, score, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as rnk from sc where score > 0)"""
DENSE = """qv as (select item_id, embedding::double[] as v from benchmark join embeddings on vec_id = item_id),
dv as (select vec_id, embedding::double[] as v from embeddings),
den as (select item_id, vec_id, score, row_number() over (partition by item_id order by round(score, 6) desc, vec_id) as rnk
  from (select item_id, vec_id, list_dot_product(qv.v, dv.v) as score from qv, dv))"""
FUSED = f"""{BM25}, {DENSE},
hits as (select item_id, vec_id as doc_id, rnk as dr, null as br from den where rnk <= 50 union all select item_id, doc_id, null, rnk from lex where rnk <= 50),
fu as (select item_id, doc_id, sum(coalesce(1.0::double / (60 + dr), 0) + coalesce(1.0::double / (60 + br), 0)) as score, max(dr) as dense_rank, max(br) as bm25_rank from hits group by all),
hyb as (select *, row_number() over (partition by item_id order by round(score, 9) desc, coalesce(dense_rank, 1000 + bm25_rank), doc_id) as rnk from fu)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


def ranked(rows: DataFrame, key: str = "doc_id", digits: int = 6) -> DataFrame:
    return rows.select("item_id", key, F.round("score", digits).alias("score"), F.col("rnk").cast("long").alias("rnk"))


def tokens_per_doc(spark, sf_dir):
    return S.lengths(docs(spark, sf_dir)).select("doc_id", F.col("len").alias("n_tokens"))


def postings_df(spark, sf_dir):
    posted = S.postings(docs(spark, sf_dir))
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def bm25_stats(spark, sf_dir):
    stats = S.corpus_stats(docs(spark, sf_dir))
    idf = S.idf_table(S.postings(docs(spark, sf_dir)), stats)
    mean = idf.agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.avg("idf"), 6).alias("mean_idf"), F.round(F.min("idf"), 6).alias("least_idf"))
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl")).crossJoin(mean)  # one row each


def bm25(spark, sf_dir, k=10):
    return S.search_bm25(items(spark, sf_dir), docs(spark, sf_dir), k)


def query_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return items(spark, sf_dir).select("item_id").join(vectors.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")


def dense(spark, sf_dir, k=10):
    return S.search_dense(query_vectors(spark, sf_dir), table(spark, sf_dir, "embeddings"), k)


def hybrid(spark, sf_dir, k=10):
    near = dense(spark, sf_dir, S.CANDIDATES).withColumnRenamed("vec_id", "doc_id")
    return S.fuse(near, bm25(spark, sf_dir, S.CANDIDATES)).filter(F.col("rnk") <= k)


def search_hybrid(spark, sf_dir):
    rows = hybrid(spark, sf_dir)
    return rows.select("item_id", "doc_id", F.round("score", 8).alias("score"), F.col("dense_rank").cast("long").alias("dense_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"), F.col("rnk").cast("long").alias("rnk"))


def rollup_best_per_source(spark, sf_dir):
    hits = bm25(spark, sf_dir, S.CANDIDATES).join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    rolled = S.roll_up(hits, "source", k=10)
    return rolled.select("item_id", "source", "doc_id", F.round("score", 6).alias("score"), F.col("group_rnk").cast("long").alias("rnk"))


def by_mode(spark, sf_dir):
    """Hits of the three modes with their mode."""
    lexical = materialize(bm25(spark, sf_dir, S.CANDIDATES), "by-mode")
    near = materialize(dense(spark, sf_dir, S.CANDIDATES).withColumnRenamed("vec_id", "doc_id"), "by-mode")
    lists = {"bm25": lexical, "dense": near, "hybrid": S.fuse(near, lexical)}
    parts = [rows.filter("rnk <= 10").select("item_id", "doc_id", "rnk", F.lit(mode).alias("mode")) for mode, rows in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def recall_mrr_by_mode(spark, sf_dir):
    hits, truth = by_mode(spark, sf_dir), gold(spark, sf_dir)
    scored = None
    for mode in S.MODES:
        part = scored_positive(hits.filter(F.col("mode") == mode), truth).withColumn("mode", F.lit(mode))
        scored = part if scored is None else scored.unionByName(part)
    return retrieval_metrics(scored)


def recall_by_lang_grouping_sets(spark, sf_dir):
    """Overall and by language in one pass."""
    truth = gold(spark, sf_dir)
    scored = scored_positive(bm25(spark, sf_dir), truth)
    lang = truth.join(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id").groupBy("item_id").agg(F.min("lang").alias("lang"))
    rows = scored.join(lang, "item_id").withColumn("hit", (F.coalesce("first", F.lit(99)) <= 5).cast("long"))
    out = rows.rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits_5"))
    return out.select(F.coalesce("lang", F.lit("*")).alias("lang"), "n", "hits_5")


def false_inclusion_rate(spark, sf_dir):
    excluded = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return false_inclusion(bm25(spark, sf_dir), excluded)


def latency_upper_median(spark, sf_dir):
    return upper_median(table(spark, sf_dir, "events"), "event_type", "value")


def evidence_coverage(spark, sf_dir):
    """Share of each passage's tokens that its best document has."""
    best = bm25(spark, sf_dir, 1).select("item_id", "doc_id")
    a = items(spark, sf_dir).select("item_id", F.array_distinct(bm25_tokens(F.col("text"))).alias("q"))
    b = docs(spark, sf_dir).select("doc_id", F.array_distinct(bm25_tokens(F.col("text"))).alias("d"))
    rows = best.join(a, "item_id").join(b, "doc_id")
    return rows.select("item_id", "doc_id", F.size("q").cast("long").alias("n_query"), F.size(F.array_intersect("q", "d")).cast("long").alias("n_shared"))


def search_stored_index(spark, sf_dir):
    """A lexical index of the documents is written, opened again with its manifest's guard, and searched."""
    path = scratch_path(spark, "lexical-index")
    S.LexicalIndex.build(docs(spark, sf_dir), path)
    return ranked(S.LexicalIndex.load(spark, path, docs(spark, sf_dir)).search(items(spark, sf_dir)))


def dense_stored_index(spark, sf_dir):
    path = scratch_path(spark, "vector-index")
    vectors = table(spark, sf_dir, "embeddings")
    S.VectorIndex.build(vectors, path)
    return ranked(S.VectorIndex.load(spark, path, vectors).search(query_vectors(spark, sf_dir)), "vec_id")


def hashed_embeddings(spark, sf_dir):
    """The offline encoder's vectors have length 1 (or 0, without tokens)."""
    vector = S.hashed_embedding(F.col("text"), 16)
    rows = docs(spark, sf_dir).select("doc_id", vector.alias("v"))
    return rows.select("doc_id", F.size("v").cast("long").alias("width"), F.round(F.sqrt(dot(F.col("v"), F.col("v"))), 6).alias("norm"), (is_unit(F.col("v")) | F.forall("v", lambda x: x == 0)).alias("fits"))


QUERIES = {
    "search_stored_index": search_stored_index,
    "dense_stored_index": dense_stored_index,
    "hashed_embeddings": hashed_embeddings,
    "tokens_per_doc": tokens_per_doc,
    "postings_df": postings_df,
    "bm25_stats": bm25_stats,
    "search_bm25": lambda s, d: ranked(bm25(s, d)),
    "search_dense": lambda s, d: ranked(dense(s, d), "vec_id"),
    "search_hybrid": search_hybrid,
    "rollup_best_per_source": rollup_best_per_source,
    "recall_mrr_by_mode": recall_mrr_by_mode,
    "recall_by_lang_grouping_sets": recall_by_lang_grouping_sets,
    "false_inclusion_rate": false_inclusion_rate,
    "latency_upper_median": latency_upper_median,
    "evidence_coverage": evidence_coverage,
}

METRICS = "count(*) as n, round(avg(case when f <= 5 then 1.0 else 0.0 end), 4) as recall_5, round(avg(case when f <= 10 then 1.0 else 0.0 end), 4) as recall_10, round(avg(case when f <= 10 then 1.0 / f else 0.0 end), 4) as mrr_10"
ORACLES = {
    "tokens_per_doc": f"select doc_id, cast(len({TOKENS}) as bigint) as n_tokens from documents",
    "postings_df": f"with {INDEX} select term, count(*) as df, cast(sum(tf) as bigint) as cf from post group by term",
    "bm25_stats": f"with {INDEX} select n_docs, round(avgdl, 6) as avgdl, (select count(*) from idf) as n_terms, (select round(avg(idf), 6) from idf) as mean_idf, (select round(min(idf), 6) from idf) as least_idf from st",
    "search_bm25": f"with {BM25} select item_id, doc_id, round(score, 6) as score, rnk from lex where rnk <= 10",
    "search_dense": f"with {DENSE} select item_id, vec_id, round(score, 6) as score, rnk from den where rnk <= 10",
    "search_hybrid": f"with {FUSED} select item_id, doc_id, round(score, 8) as score, dense_rank, bm25_rank, rnk from hyb where rnk <= 10",
    "rollup_best_per_source": f"""with {BM25}, h as (select l.*, source, row_number() over (partition by item_id, source order by rnk) as k from lex l join documents using (doc_id) where rnk <= 50)
select item_id, source, doc_id, round(score, 6) as score, g as rnk from (select *, row_number() over (partition by item_id order by rnk) as g from h where k = 1) where g <= 10""",
    "recall_mrr_by_mode": f"""with {FUSED}, {GOLD},
m as (select 'bm25' as mode, item_id, doc_id, rnk from lex where rnk <= 10 union all select 'dense', item_id, vec_id, rnk from den where rnk <= 10 union all select 'hybrid', item_id, doc_id, rnk from hyb where rnk <= 10),
g as (select distinct item_id, mode from gold_fx, (select distinct mode from m)),
f as (select g.mode, g.item_id, min(m.rnk) as f from g left join (select m.* from m join gold_fx using (item_id, doc_id)) m using (mode, item_id) group by all)
select mode, {METRICS} from f group by mode""",
    "recall_by_lang_grouping_sets": f"""with {BM25}, {GOLD}, r as (select item_id, min(rnk) as f from (select * from lex where rnk <= 10) join gold_fx using (item_id, doc_id) group by item_id),
l as (select item_id, min(lang) as lang from gold_fx join documents using (doc_id) group by item_id)
select coalesce(lang, '*') as lang, count(*) as n, cast(sum(case when coalesce(f, 99) <= 5 then 1 else 0 end) as bigint) as hits_5 from l left join r using (item_id) group by grouping sets ((lang), ())""",
    "false_inclusion_rate": f"""with {BM25}, t as (select * from lex where rnk <= 10), b as (select distinct item_id from t join labels using (doc_id) where toxic = 1)
select n_queries, n_with_excluded, round(n_with_excluded / n_queries, 4) as rate from (select (select count(distinct item_id) from t) as n_queries, (select count(*) from b) as n_with_excluded)""",
    "latency_upper_median": "select event_type, count(*) as n, list_sort(list(value))[cast(floor(count(*) / 2) as int) + 1] as upper_median from events where value is not null group by event_type",
    "evidence_coverage": f"""with {BM25}, q2 as (select item_id, list_distinct({TOKENS}) as q from benchmark), d2 as (select doc_id, list_distinct(w) as dd from d)
select item_id, doc_id, cast(len(q) as bigint) as n_query, cast(len(list_intersect(q, dd)) as bigint) as n_shared from lex join q2 using (item_id) join d2 using (doc_id) where rnk = 1""",
}

ORACLES["search_stored_index"] = ORACLES["search_bm25"]
ORACLES["dense_stored_index"] = ORACLES["search_dense"]
ORACLES["hashed_embeddings"] = f"select doc_id, cast(16 as bigint) as width, case when len({TOKENS}) > 0 then 1.0::double else 0.0::double end as norm, true as fits from documents"
