"""Queries of the serving side."""

from __future__ import annotations

from pyspark.sql import functions as F

from eligspark.operators import serving as V
from eligspark.plans.fixtures import CONSTRAINTS, MATCHING, PROFILES, candidates, constraints, profiles
from eligspark.plans.matching import STATUS, evaluated
from eligspark.plans.names import COVERED, RATIO
from eligspark.plans.search import BM25, FUSED
from eligspark.tables import table


def person_facts(spark, sf_dir):
    rows = profiles(spark, sf_dir).select("query_id", "p_occupation", "p_state", "p_age", "p_annual_income_inr", "p_applying_for")
    return V.person_facts(rows)


def status_counts(spark, sf_dir):
    return V.status_counts(evaluated(spark, sf_dir))


def explain_top5(spark, sf_dir):
    return V.to_explain(evaluated(spark, sf_dir)).select("query_id", "slug", F.col("place").cast("long").alias("place"))


def as_chunks(spark, sf_dir):
    """Documents as chunks of schemes numbered by their source."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("slug"), "text", F.when(F.col("doc_id") % 3 == 0, "overview").when(F.col("doc_id") % 3 == 1, "eligibility").otherwise("exclusions").alias("section"))


def first_clause_lookup(spark, sf_dir):
    rows = as_chunks(spark, sf_dir).withColumnRenamed("text", "raw_text")
    return V.first_clause(rows).select("slug", "chunk_id", "section")


def serve_match(spark, sf_dir):
    """Passages as queries, every 25th customer as the person asking, parts as constraint records: the whole online plan."""
    queries = table(spark, sf_dir, "benchmark").select(((F.col("item_id") + 1) * 25).alias("query_id"), "text")
    rows = V.match(queries, as_chunks(spark, sf_dir), profiles(spark, sf_dir), constraints(spark, sf_dir))
    return rows.select("query_id", "slug", F.col("evidence_id").alias("doc_id"), F.col("rnk").cast("long").alias("rnk"))


def serve_verdicts(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(((F.col("item_id") + 1) * 25).alias("query_id"), "text")
    rows = V.match(queries, as_chunks(spark, sf_dir), profiles(spark, sf_dir), constraints(spark, sf_dir))
    return rows.select("query_id", "slug", "final_status", "matcher_reason", F.col("place").cast("long").alias("place"))


def serve_full(spark, sf_dir):
    """K10 with everything but meanings: hybrid retrieval, three languages, explanations for some records, document lists, and
    notices of names that nobody knows."""
    bench, parts, vectors = (table(spark, sf_dir, n) for n in ("benchmark", "part", "embeddings"))
    item, query = F.col("item_id"), ((F.col("item_id") + 1) * 25).alias("query_id")
    queries = bench.select(query, "text", F.when(item % 3 == 0, "hi").when(item % 3 == 1, "te").otherwise("en").alias("lang"))
    asked = bench.select("item_id").join(vectors.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id").select(query, "embedding")
    explained = bench.select(query, F.explode(F.array(*[F.lit(k).cast("long") for k in range(1, 20, 4)])).alias("slug"), F.lit("needs_checking").alias("status"), F.lit("explained").alias("reason"), F.array(F.struct(F.lit("c").alias("chunk_id"), F.lit("q").alias("quote"))).alias("citations"))
    schemes = parts.select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("eligibility_text"), F.concat_ws("\n", F.lit("Documents required:"), "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))).alias("documents_text"))
    at = item % 5 + 1
    short = F.transform(F.split(F.lower("p_name"), " "), lambda w: F.concat(F.left(w, at), F.substr(w, at + 2)))
    named = bench.select("item_id").join(parts, item == F.col("p_partkey")).select(query, F.col("p_name").alias("name"), short.alias("tokens"))
    known = parts.filter("p_size <= 10").select(F.col("p_partkey").alias("id2"), F.split(F.lower("p_name"), " ").alias("tokens2"))
    rows = V.match(queries, as_chunks(spark, sf_dir), profiles(spark, sf_dir), constraints(spark, sf_dir), vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), asked, explanations=explained, schemes=schemes, named=named, known=known)
    return rows.select("query_id", "slug", F.col("evidence_id").alias("doc_id"), "final_status", (F.col("reason") == "explained").alias("explained"), F.size("documents").cast("long").alias("n_documents"), F.array_join("unknown_names", "|").alias("unknown"), F.col("place").cast("long").alias("place"))


def serve_meanings(spark, sf_dir):
    """Occupations are compared and facts touch residuals inside the serving plan, by vectors made from the keys."""
    pairs = evaluated_pairs(spark, sf_dir)
    vector = lambda k: F.array(F.when(k % 2 == 0, 1.0).otherwise(0.0), F.when(k % 2 == 0, 0.0).otherwise(1.0))
    mine = pairs.select(F.col("p_occupation").alias("text"), vector(F.length("p_occupation")).alias("vector"))
    listed = pairs.select(F.explode("c_occupation").alias("text")).select("text", vector(F.length("text")).alias("vector"))
    facts = pairs.select(F.explode("p_facts").alias("text")).select("text", vector(F.length("text")).alias("vector"))
    residuals = pairs.select(F.explode("c_residuals").alias("text")).select("text", vector(F.length("text")).alias("vector"))
    meanings = mine.union(listed).union(facts).union(residuals).distinct()
    rows = V.with_meanings(pairs, meanings)
    return rows.select("query_id", "slug", F.round("p_occupation_similarity", 4).alias("similarity"), F.coalesce("c_touches", F.lit(0)).cast("long").alias("touches"))


def evaluated_pairs(spark, sf_dir):
    """Candidates with an occupation, facts and residuals whose lengths the keys decide."""
    q, s = F.col("query_id"), F.col("slug")
    word = lambda name, k: F.concat(F.lit(name), F.when(k % 2 == 0, "e").otherwise("od"))
    return candidates(spark, sf_dir).select("query_id", "slug", word("weav", q).alias("p_occupation"), F.when(s % 3 > 0, F.array(word("farm", s))).alias("c_occupation"), F.array(word("fact", q)).alias("p_facts"), F.when(s % 4 == 1, F.array(word("rest", s), F.lit("odd"))).alias("c_residuals"))


QUERIES = {"person_facts": person_facts, "status_counts": status_counts, "explain_top5": explain_top5, "first_clause_lookup": first_clause_lookup, "serve_match": serve_match, "serve_verdicts": serve_verdicts, "serve_full": serve_full, "serve_meanings": serve_meanings}
ORACLES = {
    "person_facts": f"""with {PROFILES}, f as (select query_id, 1 as k, 'occupation' as field, occupation as text from profiles_fx union all select query_id, 2, 'state', state::varchar from profiles_fx union all select query_id, 3, 'age', age::varchar from profiles_fx
union all select query_id, 4, 'annual_income_inr', income::varchar from profiles_fx union all select query_id, 5, 'applying_for', case when on_behalf then 'child' end from profiles_fx)
select query_id, 'F' || row_number() over (partition by query_id order by k) as fact_id, field, text from f where text is not null""",
    "status_counts": f"with {STATUS} select query_id, count(*) filter (status = 'eligible') as eligible, count(*) filter (status = 'needs_checking') as needs_checking, count(*) filter (status = 'not_eligible') as not_eligible from st group by query_id",
    "explain_top5": f"with {STATUS}, e as (select query_id, slug, row_number() over (partition by query_id order by rnk) as place from st where status <> 'not_eligible') select * from e where place <= 5",
    "first_clause_lookup": """with c as (select cast(regexp_extract(source, '(\\d+)', 1) as bigint) as slug, doc_id as chunk_id, case doc_id % 3 when 0 then 'overview' when 1 then 'eligibility' else 'exclusions' end as section from documents),
r as (select *, row_number() over (partition by slug order by section = 'overview', section = 'exclusions', chunk_id) as k from c) select slug, chunk_id, section from r where k = 1""",
    "serve_match": f"""with {BM25}, h as (select l.*, cast(regexp_extract(source, '(\\d+)', 1) as bigint) as slug from lex l join documents using (doc_id) where rnk <= 50), b as (select *, row_number() over (partition by item_id, slug order by rnk) as k from h)
select (item_id + 1) * 25 as query_id, slug, doc_id, g as rnk from (select *, row_number() over (partition by item_id order by rnk) as g from b where k = 1) where g <= 10""",
}
# lengths: weave 5, weavod 6, farme 5, farmod 6, facte 5, factod 6, reste 5, restod 6, odd 3; vectors agree where lengths are both even or both odd
ORACLES["serve_meanings"] = f"""with {MATCHING} select query_id, slug, case when slug % 3 > 0 then case when query_id % 2 = slug % 2 then 1.0::double else 0.0::double end end as similarity,
  cast(case when slug % 4 = 1 then 1 else 0 end as bigint) as touches from cands_fx"""
SERVED = ORACLES["serve_match"]
VERDICTS = (
    STATUS.replace(MATCHING, f"{PROFILES}, {CONSTRAINTS}, cands_fx as (select query_id, slug, rnk from served)")
    .replace("from cands_fx c join profiles_fx p using (query_id)", "from cands_fx c left join profiles_fx p using (query_id)")
    .replace("p.conf in ('high', 'medium') as ok", "coalesce(p.conf in ('high', 'medium'), false) as ok")
    .replace("\nst as (select query_id", "\nstt as (select query_id")
)
ORACLES["serve_verdicts"] = f"""{SERVED.rsplit("select (item_id", 1)[0].rstrip()}, served as (select (item_id{SERVED.rsplit("select (item_id", 1)[1]}), {VERDICTS},
al as (select query_id, slug, rnk, status, reason, personal from stt union all select query_id, slug, rnk, 'needs_checking', 'no constraint record', 0 from served where slug not in (select slug from constraints_fx))
select query_id, slug, status as final_status, reason as matcher_reason, row_number() over (partition by query_id order by case status when 'eligible' then 0 when 'needs_checking' then 1 else 2 end, 1 - personal, rnk) as place from al"""
ORACLES["serve_full"] = f"""with {FUSED}, h as (select l.*, cast(regexp_extract(source, '(\\d+)', 1) as bigint) as slug from hyb l join documents using (doc_id)),
b as (select *, row_number() over (partition by item_id, slug order by rnk) as k from h),
served as (select (item_id + 1) * 25 as query_id, slug, doc_id, g as rnk from (select *, row_number() over (partition by item_id order by rnk) as g from b where k = 1) where g <= 10), {VERDICTS},
every as (select query_id, slug, rnk, status, personal from stt union all select query_id, slug, rnk, 'needs_checking', 0 from served where slug not in (select slug from constraints_fx)),
ex as (select a.query_id, a.slug, a.rnk, personal, case when a.slug % 4 = 1 and a.slug < 20 then 'needs_checking' else status end as status from every a),
nx as (select (item_id + 1) * 25 as query_id, p_name, list_sort(list_distinct(list_transform(string_split(lower(p_name), ' '), lambda w: left(w, item_id % 5 + 1) || substr(w, item_id % 5 + 3)))) as w from benchmark join part on p_partkey = item_id),
ny as (select distinct list_sort(list_distinct(string_split(lower(p_name), ' '))) as w2 from part where p_size <= 10),
tp as (select distinct t, u from (select distinct unnest(w) as t from nx), (select distinct unnest(w2) as u from ny)), {RATIO}, {COVERED}
select e.query_id, e.slug, s.doc_id, e.status as final_status, e.slug % 4 = 1 and e.slug < 20 as explained, cast(1 + coalesce((p_size % 2 = 0)::int, 0) as bigint) as n_documents, coalesce(x.p_name, '') as unknown,
row_number() over (partition by e.query_id order by case e.status when 'eligible' then 0 when 'needs_checking' then 1 else 2 end, 1 - personal, e.rnk) as place
from ex e join served s on s.query_id = e.query_id and s.slug = e.slug left join part on p_partkey = e.slug left join (select * from nx where w not in (select w from cov)) x on x.query_id = e.query_id"""
