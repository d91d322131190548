"""Queries of sampling, agreement, classification, caches and provider accounting."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eligspark.functions.text import cache_key, error_class
from eligspark.operators import evaluation as E
from eligspark.operators import ml
from eligspark.operators import sampling as R
from eligspark.operators.postprocess import citation_errors
from eligspark.operators.names import matching_names
from eligspark.operators.providers import reconcile
from eligspark.operators.search import search_dense
from eligspark.plans.fixtures import PROFILES, profiles
from eligspark.sources.records import last_written
from eligspark.storage import materialize
from eligspark.streaming.state import error_runs
from eligspark.tables import table

# Keyword rules of the strata, first match wins.
STRATA = [("steel", ("steel",)), ("tin", ("tin",)), ("copper", ("copper", "brass")), ("promo", ("promo",)), ("large", ("large", "medium")), ("small", ("small",))]


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", "source", "lang"), "doc_id")


def parts_with_stratum(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("stratum", R.bucket(F.split("p_type", " "), STRATA))


def strata_assign(spark, sf_dir):
    return parts_with_stratum(spark, sf_dir).select("p_partkey", "stratum")


def stratified_sample_md5(spark, sf_dir):
    return R.stratified_sample(parts_with_stratum(spark, sf_dir), "stratum", "p_partkey", 60).select("p_partkey", "stratum", F.col("pick").cast("long").alias("pick"))


def largest_remainder_split(spark, sf_dir):
    return R.largest_remainder(docs(spark, sf_dir), "lang", 50)


def dev_test_split(spark, sf_dir):
    return R.dev_test_split(docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id", 50).filter("split = 'dev'").select("doc_id", "lang")


def kfold_stratified(spark, sf_dir):
    rows = R.folds(table(spark, sf_dir, "labels"), "quality", "doc_id")
    return rows.groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


def fold_support(spark, sf_dir):
    rows = R.fold_support(R.folds(table(spark, sf_dir, "labels"), "quality", "doc_id"), "quality")
    return rows.select("quality", "n", "least", "most", "balanced")


def sampling_weights(spark, sf_dir):
    return R.sampling_weights(docs(spark, sf_dir), labelled(spark, sf_dir), "source")


def agreement_by_confidence(spark, sf_dir):
    """Quality and the absence of toxicity as two raters; the language stands for the confidence."""
    rows = labelled(spark, sf_dir).withColumn("other", 1 - F.col("toxic"))
    return E.agreement(rows, ("lang",), "quality", "other")


def disagreement_matrix(spark, sf_dir):
    return E.disagreements(labelled(spark, sf_dir).withColumn("other", 1 - F.col("toxic")), "quality", "other")


def wilson_interval(spark, sf_dir):
    rows = labelled(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("quality").cast("double")).alias("p"))
    low, high = E.wilson(F.col("p"), F.col("n"))
    return rows.select("source", "n", F.round("p", 6).alias("p"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def strata_of_sources(spark, sf_dir):
    population = docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("population"))
    sampled = labelled(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("sampled"), F.sum("quality").alias("hits"))
    return population.join(sampled, "source", "left").na.fill(0).withColumnRenamed("source", "stratum")


def post_stratified_kish(spark, sf_dir):
    return E.post_stratified(strata_of_sources(spark, sf_dir))


def exclude_one_stratum(spark, sf_dir):
    return E.without_each_stratum(strata_of_sources(spark, sf_dir))


def jeffreys_monte_carlo(spark, sf_dir):
    return E.jeffreys_interval(strata_of_sources(spark, sf_dir))


def nearest_labels(spark, sf_dir):
    """Each vector's label and that of its nearest other vector (ties by id)."""
    vectors = table(spark, sf_dir, "embeddings")
    near = search_dense(vectors.withColumnRenamed("vec_id", "item_id"), vectors, 2).filter("item_id <> vec_id")
    first = near.withColumn("k", F.row_number().over(W.partitionBy("item_id").orderBy("rnk"))).filter("k = 1")
    names = vectors.select(F.col("vec_id").alias("item_id"), F.col("label").alias("truth")), vectors.select("vec_id", F.col("label").alias("predicted"))
    return first.select("item_id", "vec_id").join(names[0], "item_id").join(names[1], "vec_id")


def confusion_matrix_norm(spark, sf_dir):
    return E.confusion(nearest_labels(spark, sf_dir), "truth", "predicted")


def prf_per_class(spark, sf_dir):
    return E.class_scores(materialize(nearest_labels(spark, sf_dir), "nearest"), "truth", "predicted")  # read twice


def summary_scores(spark, sf_dir):
    return E.summary_scores(materialize(nearest_labels(spark, sf_dir), "nearest"), "truth", "predicted")  # read three times


def perturbed(spark, sf_dir):
    q = F.col("query_id")
    p = profiles(spark, sf_dir)
    return p.select(
        F.col("p_age").alias("e_age"), F.when(q % 10 != 0, F.coalesce(F.col("p_age") + F.when(q % 4 == 0, 1).otherwise(0), F.when(q % 3 == 0, 30))).alias("g_age"),
        F.col("p_annual_income_inr").alias("e_annual_income_inr"), (F.col("p_annual_income_inr") * F.when(q % 3 == 0, 1.005).otherwise(1.05)).alias("g_annual_income_inr"),
        F.col("p_land_acres").alias("e_land_acres"), (F.col("p_land_acres") + F.when(q % 2 == 0, 0.04).otherwise(0.5)).alias("g_land_acres"),
        F.col("p_occupation").alias("e_occupation"), F.when(q % 2 == 0, F.concat(F.lower("p_occupation"), F.lit(" worker"))).otherwise("teacher").alias("g_occupation"),
    )


def profile_field_accuracy(spark, sf_dir):
    return E.profile_accuracy(perturbed(spark, sf_dir), ("age", "annual_income_inr", "land_acres", "occupation"))


def citations(spark, sf_dir):
    """Passages quoted from documents of the same number: whole passages and cut ones, over two attempts."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    chunk = docs(spark, sf_dir).select(F.col("doc_id").alias("item_id"), F.col("text").alias("chunk"))
    quote = F.when(F.col("item_id") % 3 == 0, F.substring("chunk", 1, 40)).when(F.col("item_id") % 3 == 1, F.substring("chunk", 2, 5)).otherwise(F.col("text"))
    rows = items.join(chunk, "item_id").select("item_id", (F.col("item_id") % 2 + 1).alias("attempt"), F.array_join(citation_errors(quote, F.col("chunk"), F.col("item_id") % 7 != 0), "; ").alias("errors"))
    return rows.select("item_id", "attempt", "errors", (F.col("errors") == "").alias("valid"), F.when(F.col("item_id") % 5 == 0, "fallback").otherwise("llm").alias("source"))


def citation_validity(spark, sf_dir):
    return citations(spark, sf_dir).select("item_id", "errors")


def citation_rates(spark, sf_dir):
    return E.citation_report(citations(spark, sf_dir))


def cache_last_write_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(cache_key(F.col("user_id"), F.col("event_type")).alias("key"), F.col("event_id").alias("seq"), "value")
    return last_written(events).select("key", "seq", "value")


def key_cooldown_islands(spark, sf_dir):
    return error_runs(table(spark, sf_dir, "events"))


def error_classes(spark, sf_dir):
    """Z03 over messages made from events."""
    k = F.col("event_id") % 5
    text = F.when(k == 0, "429 rate limit reached").when(k == 1, "quota exceeded: 200000 tokens per day").when(k == 2, "503 unavailable").when(k == 3, "invalid api key").otherwise("request timeout")
    return table(spark, sf_dir, "events").select("event_type", error_class(text).alias("kind")).groupBy("event_type", "kind").agg(F.count(F.lit(1)).alias("n"))


def usage_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id") % 10, "event_type", F.get_json_object("props", "$.k").cast("long").alias("tokens")).toDF("provider", "event_type", "tokens")
    return rows.groupBy("provider", "event_type").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def unknown_name_notice(spark, sf_dir):
    """Part names each of whose words is like some word of a brand-mate's name that isn't the same part."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("tokens"))
    asked = parts.select(F.col("p_partkey").alias("id"), "tokens")
    return matching_names(asked, parts.select(F.col("p_partkey").alias("id2"), F.col("tokens").alias("tokens2"))).filter("id <> id2")


def batch_reconcile(spark, sf_dir):
    asked = docs(spark, sf_dir).select(F.col("doc_id").alias("slug"))
    given = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("slug"), F.when(F.col("doc_id") % 9 == 0, "junk").when(F.col("quality") == 1, "good").otherwise("bad").alias("category"))
    return reconcile(asked, given, ("good", "bad"))


def tfidf_top_terms(spark, sf_dir):
    rows = ml.tfidf_terms(docs(spark, sf_dir), "doc_id", "text")
    order = W.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    return rows.withColumn("k", F.row_number().over(order)).filter("k <= 3").select("doc_id", "term", "weight", F.col("k").cast("long").alias("rnk"))


def vectors_in_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("key", F.col("vec_id"))
    return R.folds(ml.vector_features(rows), "label", "key")


def majority_baseline(spark, sf_dir):
    return ml.majority_by_fold(R.folds(table(spark, sf_dir, "embeddings"), "label", "vec_id"), "label")


def lr_embeddings_cv(spark, sf_dir):
    rows = materialize(vectors_in_folds(spark, sf_dir), "folds")
    return E.summary_scores(ml.fold_predictions(rows, "lr", c=1.0), "y", "predicted")


def pca2(spark, sf_dir):
    rows, _ = ml.principal_components(vectors_in_folds(spark, sf_dir), "key")
    return rows.select("key", F.round("x1", 4).alias("x1"), F.round("x2", 4).alias("x2"))


QUERIES = {
    "strata_assign": strata_assign,
    "stratified_sample_md5": stratified_sample_md5,
    "largest_remainder_split": largest_remainder_split,
    "dev_test_split": dev_test_split,
    "kfold_stratified": kfold_stratified,
    "fold_support": fold_support,
    "sampling_weights": sampling_weights,
    "agreement_by_confidence": agreement_by_confidence,
    "disagreement_matrix": disagreement_matrix,
    "wilson_interval": wilson_interval,
    "post_stratified_kish": post_stratified_kish,
    "exclude_one_stratum": exclude_one_stratum,
    "jeffreys_monte_carlo": jeffreys_monte_carlo,
    "confusion_matrix_norm": confusion_matrix_norm,
    "prf_per_class": prf_per_class,
    "summary_scores": summary_scores,
    "profile_field_accuracy": profile_field_accuracy,
    "citation_validity": citation_validity,
    "citation_rates": citation_rates,
    "cache_last_write_wins": cache_last_write_wins,
    "key_cooldown_islands": key_cooldown_islands,
    "error_class": error_classes,
    "usage_rollup": usage_rollup,
    "unknown_name_notice": unknown_name_notice,
    "batch_reconcile": batch_reconcile,
    "tfidf_top_terms": tfidf_top_terms,
    "majority_baseline": majority_baseline,
    "lr_embeddings_cv": lr_embeddings_cv,
    "pca2": pca2,
}

STRATUM = "case " + " ".join("when " + " or ".join(f"contains(lower(p_type), '{w}')" for w in ws) + f" then '{n}'" for n, ws in STRATA) + " else 'Other' end"
LABELLED = "lab as (select l.*, d.source, d.lang from labels l join documents d using (doc_id))"
FOLDED = "fo as (select *, (row_number() over (partition by quality order by md5('42' || doc_id), doc_id) - 1) % 5 as fold from labels)"
STRATA_SQL = f"{LABELLED}, sa as (select d.source as stratum, d.n as population, coalesce(l.n, 0) as sampled, coalesce(l.h, 0) as hits from (select source, count(*) as n from documents group by source) d left join (select source, count(*) as n, sum(quality) as h from lab group by source) l using (source))"
NEAREST = """nn as (select i as item_id, v as vec_id from (select a.vec_id as i, b.vec_id as v, row_number() over (partition by a.vec_id order by round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) desc, b.vec_id) as k
  from embeddings a join embeddings b on a.vec_id <> b.vec_id) where k = 1),
nl as (select a.label as truth, b.label as predicted from nn join embeddings a on a.vec_id = item_id join embeddings b on b.vec_id = nn.vec_id)"""
PRF = f"""{NEAREST}, cl as (select coalesce(s.label, n.label) as label, coalesce(support, 0) as support, coalesce(hits, 0) as hits, coalesce(named, 0) as named
  from (select truth as label, count(*) as support, count(*) filter (truth = predicted) as hits from nl group by truth) s full join (select predicted as label, count(*) as named from nl group by predicted) n using (label)),
pr as (select label, support, coalesce(hits / nullif(named, 0), 0) as p, coalesce(hits / nullif(support, 0), 0) as r from cl)"""
CUT = "case when b.item_id % 3 = 0 then substr(d.text, 1, 40) when b.item_id % 3 = 1 then substr(d.text, 2, 5) else b.text end"
CITED = f"""ci as (select b.item_id, b.item_id % 2 + 1 as attempt, concat_ws('; ', case when b.item_id % 7 = 0 then 'chunk of another scheme' end, case when {CUT} = '' or not contains(d.text, {CUT}) then 'not a part of the chunk' end,
  case when length({CUT}) < least(12, length(d.text)) then 'too short' end) as errors from benchmark b join documents d on d.doc_id = b.item_id)"""
ZZ = 1.95996
ORACLES = {
    "strata_assign": f"select p_partkey, {STRATUM} as stratum from part",
    "stratified_sample_md5": f"""with recursive p as (select p_partkey, {STRATUM} as stratum from part), s as (select stratum, count(*) as size, row_number() over (order by stratum) as pos from p group by stratum),
al(round, stratum, size, pos, given, left_) as (
  select 0, stratum, size, pos, cast(0 as bigint), least(60, (select sum(size) from s))::bigint from s
  union all
  select round + 1, stratum, size, pos, given + add_, left_ - sum(add_) over () from (
    select *, case when given < size then least(size - given, left_ // open_ + case when rank_ <= left_ % open_ then 1 else 0 end) else 0 end as add_
    from (select *, count(*) filter (given < size) over () as open_, count(*) filter (given < size) over (order by pos) as rank_ from al) where left_ > 0)),
fin as (select stratum, max(given) as given from al group by stratum),
r as (select *, row_number() over (partition by stratum order by md5('42' || p_partkey), p_partkey) as pick from p)
select p_partkey, stratum, pick from r join fin using (stratum) where pick <= given""",
    "largest_remainder_split": """with c as (select lang, count(*) as n from documents group by lang), e as (select lang, n, 50 * n / sum(n) over () as x from c), r as (select lang, n, floor(x) as whole, round(x - floor(x), 9) as rest from e),
k as (select *, row_number() over (order by rest desc, lang) as k, 50 - sum(whole) over () as left_ from r) select lang, n, cast(whole + case when k <= left_ then 1 else 0 end as bigint) as places from k""",
    "kfold_stratified": f"with {FOLDED} select quality, cast(fold as int) as fold, count(*) as n, cast(sum(doc_id) as bigint) as id_sum from fo group by quality, fold",
    "fold_support": f"with {FOLDED}, q as (select distinct quality from labels), v as (select unnest(range(5)) as f), c as (select q.quality, v.f as fold, (select count(*) from fo where fo.quality = q.quality and fo.fold = v.f) as n from q, v) select quality, cast(sum(n) as bigint) as n, min(n) as least, max(n) as most, min(n) > 0 and bool_and(abs(n - t / 5) <= 1) as balanced from (select *, sum(n) over (partition by quality) as t from c) group by quality",
    "sampling_weights": f"with {LABELLED} select source, d.n as population, coalesce(l.n, 0) as sampled, round((d.n / sum(d.n) over ()) / nullif(coalesce(l.n, 0) / sum(coalesce(l.n, 0)) over (), 0), 6) as weight from (select source, count(*) as n from documents group by source) d left join (select source, count(*) as n from lab group by source) l using (source)",
    "agreement_by_confidence": f"with {LABELLED} select lang, count(*) as n, count(*) filter (quality = 1 - toxic) as agree, round(count(*) filter (quality = 1 - toxic) / count(*), 6) as agreement from lab group by lang",
    "disagreement_matrix": "select quality, 1 - toxic as other, count(*) as n from labels where quality <> 1 - toxic group by all",
    "wilson_interval": f"""with {LABELLED}, p as (select source, count(*) as n, avg(quality) as p from lab group by source), w as (select *, {ZZ * ZZ!r}::double as z2 from p)
select source, n, round(p, 6) as p, round((p + z2 / (2 * n)) / (1 + z2 / n) - {ZZ}::double * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 6) as low, round((p + z2 / (2 * n)) / (1 + z2 / n) + {ZZ}::double * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 6) as high from w""",
    "post_stratified_kish": f"""with {STRATA_SQL}, u as (select population, sampled, hits / sampled as p, population / sum(population) over () as share, (population / sum(population) over ()) / (sampled / sum(sampled) over ()) as w from sa where sampled > 0 and population > 0),
e as (select sum(share * p) as est, sqrt(sum(case when sampled > 1 then share * share * (1 - sampled / population) * p * (1 - p) / (sampled - 1) else 0 end)) as se, pow(sum(w * sampled), 2) / sum(w * w * sampled) as ne, {ZZ * ZZ!r}::double as z2 from u)
select round(est, 6) as estimate, round(se, 6) as se, round(est - {ZZ}::double * se, 6) as normal_low, round(est + {ZZ}::double * se, 6) as normal_high, round(ne, 6) as n_eff,
  round((est + z2 / (2 * ne)) / (1 + z2 / ne) - {ZZ}::double * sqrt(est * (1 - est) / ne + z2 / (4 * ne * ne)) / (1 + z2 / ne), 6) as wilson_low, round((est + z2 / (2 * ne)) / (1 + z2 / ne) + {ZZ}::double * sqrt(est * (1 - est) / ne + z2 / (4 * ne * ne)) / (1 + z2 / ne), 6) as wilson_high from e""",
    "exclude_one_stratum": f"with {STRATA_SQL} select a.stratum, (select round(sum(b.population * b.hits / b.sampled) / sum(b.population), 6) from sa b where b.sampled > 0 and b.stratum <> a.stratum) as estimate_without from sa a where a.sampled > 0",
    "confusion_matrix_norm": f"with {NEAREST} select truth, predicted, count(*) as n, round(count(*) / sum(count(*)) over (partition by truth), 6) as share from nl group by truth, predicted",
    "prf_per_class": f"with {PRF} select label, support, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from pr",
    "summary_scores": f"with {PRF}, f as (select support, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from pr) select round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1, (select round(avg(case when truth = predicted then 1.0::double else 0 end), 6) from nl) as accuracy from f",
    "profile_field_accuracy": f"""with {PROFILES}, x as (
  select 'age' as field, age is not null as stated, (case when query_id % 10 <> 0 then coalesce(age + case when query_id % 4 = 0 then 1 else 0 end, case when query_id % 3 = 0 then 30 end) end) as g, age = (case when query_id % 10 <> 0 then age + case when query_id % 4 = 0 then 1 else 0 end end) as ok from profiles_fx
  union all select 'annual_income_inr', income is not null, income, query_id % 3 = 0 or income = 0 from profiles_fx
  union all select 'land_acres', land_acres is not null, land_acres, query_id % 2 = 0 or 0.5 <= land_acres * 0.02 from profiles_fx
  union all select 'occupation', occupation is not null, 1, query_id % 2 = 0 from profiles_fx),
c as (select field, count(*) filter (stated) as stated, count(*) filter (stated and coalesce(ok, false)) as "right", count(*) filter (not stated) as blank, count(*) filter (not stated and g is not null) as false_fill from x group by field)
select field, stated, "right", blank, false_fill, round("right" / nullif(stated, 0), 4) as accuracy, round(false_fill / nullif(blank, 0), 4) as false_fill_rate from c""",
    "citation_validity": f"with {CITED} select item_id, errors from ci",
    "citation_rates": f"with {CITED} select count(*) as citations, count(*) filter (errors = '') as valid, round(count(*) filter (errors = '' and attempt = 1) / nullif(count(*) filter (attempt = 1), 0), 4) as first_attempt_rate, round(count(*) filter (errors = '') / count(*), 4) as overall_rate, round(count(*) filter (item_id % 5 = 0) / count(*), 4) as fallback_rate from ci",
    "cache_last_write_wins": """with k as (select sha256('["' || user_id || '","' || event_type || '"]') as key, event_id, value from events) select key, max(event_id) as seq, arg_max(value, event_id) as value from k group by key""",
    "key_cooldown_islands": """with n as (select *, row_number() over (partition by user_id order by ts, event_id) as n from events), i as (select *, n - row_number() over (partition by user_id order by ts, event_id) as g from n where event_type = 'error')
select user_id, count(*) as failures, min(ts) as first, max(ts) as last, max(ts) + interval 60 second as rests_until from i group by user_id, g having count(*) >= 3""",
    "error_class": "select event_type, case event_id % 5 when 0 then 'minute' when 1 then 'daily' when 3 then 'fatal' else 'retryable' end as kind, count(*) as n from events group by all",
    "usage_rollup": "select user_id % 10 as provider, event_type, count(*) as calls, cast(coalesce(sum(cast(json_extract_string(props, '$.k') as bigint)), 0) as bigint) as tokens from events group by all",
    "batch_reconcile": """with a as (select distinct doc_id as slug from documents), g as (select doc_id as slug, min(case when doc_id % 9 = 0 then 'junk' when quality = 1 then 'good' else 'bad' end) as c from labels group by doc_id)
select slug, case when c in ('good', 'bad') then c end as category, case when c is null then 'missing' when c not in ('good', 'bad') then 'invalid' end as error from a left join g using (slug)""",
    "majority_baseline": """with f as (select *, cast((row_number() over (partition by label order by md5('42' || vec_id), vec_id) - 1) % 5 as int) as fold from embeddings), c as (select fold, label, count(*) as n from f group by all),
t as (select o.fold, l.label, (select coalesce(sum(n), 0) from c where c.label = l.label and c.fold <> o.fold) as train from (select distinct fold from f) o, (select distinct label from f) l),
b as (select fold, label from (select *, row_number() over (partition by fold order by train desc, label) as k from t) where k = 1)
select b.fold, b.label as predicted, round(coalesce((select n from c where c.fold = b.fold and c.label = b.label), 0) / (select sum(n) from c where c.fold = b.fold), 6) as accuracy from b""",
}
from eligspark.plans.search import INDEX  # noqa: E402

ORACLES["tfidf_top_terms"] = f"""with {INDEX}, k as (select term, count(*) as df from post group by term), w as (select doc_id, term, (1 + ln(tf)) * (ln((1 + n_docs) / (1 + df)) + 1) as raw from post join k using (term), st where df >= 2 and df <= 0.95 * n_docs),
z as (select doc_id, term, round(raw / sqrt(sum(raw * raw) over (partition by doc_id)), 6) as weight from w), r as (select *, row_number() over (partition by doc_id order by weight desc, term) as rnk from z) select doc_id, term, weight, rnk from r where rnk <= 3"""
ORACLES["dev_test_split"] = f"""with pl as ({ORACLES['largest_remainder_split']}), r as (select doc_id, lang, row_number() over (partition by lang order by md5('20260922' || doc_id), doc_id) as k from documents) select doc_id, lang from r join pl using (lang) where k <= places"""
