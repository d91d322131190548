"""Queries of nearly equal names, of the split's language swaps and of the paged greedy choice, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from eligspark.operators import names as N
from eligspark.operators import sampling as R
from eligspark.tables import table


def misspelt_names(spark, sf_dir):
    """Parts of whose names, each word short of a letter, none of the supplied brands has a like: notices."""
    parts = table(spark, sf_dir, "part")
    at = F.col("p_partkey") % 5 + 1
    short = F.transform(F.split(F.lower("p_name"), " "), lambda w: F.concat(F.left(w, at), F.substr(w, at + 2)))
    named = parts.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("name"), short.alias("tokens"))
    known = parts.filter("p_size <= 10").select(F.col("p_partkey").alias("id2"), F.split(F.lower("p_name"), " ").alias("tokens2"))
    return N.notices(named, known)


def language_swaps(spark, sf_dir):
    """A small dev split by quality, then one positive dev row in every language."""
    rows = table(spark, sf_dir, "labels").dropDuplicates(["doc_id"]).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    split = R.dev_test_split(rows, "quality", "doc_id", 5)
    return R.language_swaps(split, "doc_id", "lang", F.col("quality") == 1).select("doc_id", "lang", "split")


QUERIES = {"misspelt_names": misspelt_names, "language_swaps": language_swaps}

#: Ratio of matching blocks of all pairs (t, u) of a table `tp`: the longest common piece (first in t, then in u), then both sides of it.
RATIO = """alike as (with recursive seg as (select t, u, t as a, u as b, 0 as m from tp union all
 select t, u, x.a, x.b, x.m from (select t, u, unnest([{'a': left(a, i - 1), 'b': left(b, j - 1), 'm': 0}, {'a': substr(a, i + n), 'b': substr(b, j + n), 'm': n}]) as x
  from (select t, u, a, b, best[1] as n, -best[2] as i, -best[3] as j from (select t, u, a, b, list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(b) + 1),
   lambda j: [len(list_filter(range(1, least(length(a) - i, length(b) - j) + 2), lambda n: substr(a, i, n) = substr(b, j, n))), -i, -j])))) as best from seg where a <> '' and b <> '') where best[1] > 0)))
 select t, u from seg group by t, u having 2.0::double * sum(m) / (length(t) + length(u)) >= 0.82)"""
COVERED = """ts as (select distinct w from nx), ts2 as (select distinct w2 from ny),
alist as (select coalesce(list(t || '|' || u), []) as l from alike),
cov as (select ts.w, ts2.w2 from ts, ts2, alist where len(list_filter(ts.w, lambda t: len(list_filter(ts2.w2, lambda u: list_contains(alist.l, t || '|' || u))) = 0)) = 0)"""
ORACLES = {
    "misspelt_names": f"""with nx as (select p_partkey, p_name, list_sort(list_distinct(list_transform(string_split(lower(p_name), ' '), lambda w: left(w, p_partkey % 5 + 1) || substr(w, p_partkey % 5 + 3)))) as w from part),
ny as (select distinct list_sort(list_distinct(string_split(lower(p_name), ' '))) as w2 from part where p_size <= 10),
tp as (select distinct t, u from (select distinct unnest(w) as t from nx), (select distinct unnest(w2) as u from ny)), {RATIO}, {COVERED}
select p_partkey as query_id, p_name as name from nx where w not in (select w from cov)""",
    "unknown_name_notice": f"""with nx as (select p_partkey as id, list_sort(list_distinct(string_split(lower(p_name), ' '))) as w from part), ny as (select id as id2, w as w2 from nx),
tp as (select distinct t, u from (select distinct unnest(w) as t from nx), (select distinct unnest(w2) as u from ny)), {RATIO}, {COVERED}
select id, id2 from nx join cov using (w) join ny using (w2) where id <> id2""",
    "language_swaps": """with r as (select doc_id, lang, min(quality) as quality from (select distinct doc_id, quality from labels) join documents using (doc_id) group by all), z as (select quality, count(*) as n, 5.0::double * count(*) / sum(count(*)) over () as exact from r group by quality),
pl as (select quality, floor(exact) + (row_number() over (order by round(exact - floor(exact), 9) desc, quality) <= 5 - sum(floor(exact)) over ())::int as places from z),
d as (select doc_id, lang, quality, md5('20260922' || doc_id) as h, case when row_number() over (partition by quality order by md5('20260922' || doc_id), doc_id) <= places then 'dev' else 'test' end as split from r join pl using (quality)),
lack as (select lang, arg_min(doc_id, h) filter (split = 'test') as incoming from d where quality = 1 group by lang having max((split = 'dev')::int) = 0),
i as (select incoming, row_number() over (order by lang) as n from lack), o as (select doc_id as outgoing, row_number() over (order by h, doc_id) as n from d where quality = 1 and split = 'dev' and lang = 'en'),
sw as (select incoming, outgoing from i join o using (n))
select doc_id, lang, case when doc_id in (select incoming from sw) then 'dev' when doc_id in (select outgoing from sw) then 'test' else split end as split from d""",
}
