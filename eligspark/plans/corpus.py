"""Queries of ingest, chunking, corpus analytics and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eligspark.functions.rules import in_range
from eligspark.functions.text import document_list, truncate, visible_text
from eligspark.operators import corpus as C
from eligspark.operators.chunking import clause_rows
from eligspark.operators.dedup import components, keep_first, near_duplicate_pairs
from eligspark.operators.evaluation import exclusive_quartiles, nearest_rank
from eligspark.plans.fixtures import CONSTRAINTS, constraints
from eligspark.sources.records import inventory, url_parts
from eligspark.tables import table

COSINE = 0.40


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def page_text_extract(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.md5(visible_text(F.col("html"))).alias("text_md5"), F.length(visible_text(F.col("html"))).cast("long").alias("n_chars"))


def page_dedupe_first(spark, sf_dir):
    rows = pages(spark, sf_dir).withColumn("host", url_parts(F.col("url"))["host"])
    return C.first_pages(rows, "host", "html", "page_id").select("host", "page_id")


def redownload_antijoin(spark, sf_dir):
    """Pages whose address has a query or fragment though the bare address is there too go."""
    rows = pages(spark, sf_dir).select("page_id", "url", url_parts(F.col("url"))["base"].alias("base"))
    bare = rows.filter("url = base").select("base").distinct()
    copies = rows.filter("url <> base").join(bare, "base", "left_semi").select("page_id")
    return rows.join(copies, "page_id", "left_anti").select("page_id", "base")


def url_parts_query(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", *[c.alias(n) for n, c in url_parts(F.col("url")).items()])


# Headings of the page sections, in their canonical order.
HEADINGS = ("h1", "h2", "p", "footer")


def sections_running_max(spark, sf_dir):
    tags = F.transform(F.regexp_extract_all("html", F.lit(r"<(h1|h2|p|footer)[ >]"), F.lit(1)), lambda t: F.array_position(F.array(*map(F.lit, HEADINGS)), t).cast("int") - 1)
    rows = pages(spark, sf_dir).select("page_id", F.posexplode(tags).alias("pos", "idx"))
    kept = C.monotone_sections(rows, "page_id", "pos", "idx")
    return kept.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("idx").cast("long").alias("idx"), F.col("section_end").cast("long").alias("section_end"))


def clause_split_simple(spark, sf_dir):
    """X13 (subset): pieces after a sentence end and before a capital, counted, with their longest."""
    parts = F.split("text", r"(?<=[.!?])[ \n]+(?=[A-Z])")
    return docs(spark, sf_dir).select("doc_id", F.size(parts).cast("long").alias("n_clauses"), F.array_max(F.transform(parts, lambda x: F.length(x))).cast("long").alias("longest"))


def clause_chunks_full(spark, sf_dir):
    return clause_rows(docs(spark, sf_dir), "doc_id", "text")


def chunk_length_quantiles(spark, sf_dir):
    return nearest_rank(docs(spark, sf_dir), "n_chars")


def duplicate_text_census(spark, sf_dir):
    return C.duplicate_census(docs(spark, sf_dir), "text")


def same_body_groups(spark, sf_dir):
    body = F.regexp_replace("text", r"^[^\n]*\n?", "")
    return C.body_groups(docs(spark, sf_dir).filter(F.contains("text", F.lit("\n"))), "doc_id", body, "lang")


def near_dup_pairs(spark, sf_dir):
    return near_duplicate_pairs(table(spark, sf_dir, "embeddings"), COSINE)


def near_dup_components(spark, sf_dir):
    return components(near_dup_pairs(spark, sf_dir))


def drop_near_dups_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return keep_first(rows, near_dup_components(spark, sf_dir), "vec_id")


def phrase_df(spark, sf_dir):
    return C.phrase_counts(docs(spark, sf_dir), "doc_id", "text", support=5)


def phrase_top25_greedy(spark, sf_dir):
    return spark.createDataFrame(C.top_phrases(phrase_df(spark, sf_dir)) or [("", 0)], "gram string, n long").filter("n > 0")


def log_odds_terms(spark, sf_dir):
    rows = C.log_odds(docs(spark, sf_dir), "text", "lang", top=10)
    return rows.select("lang", "term", "y", "z", F.col("rnk").cast("long").alias("rnk"))


def field_fill_rates(spark, sf_dir):
    fields = {"age": F.col("c_age_min").isNotNull() | F.col("c_age_max").isNotNull(), "income": F.col("c_income_cap").isNotNull(), "land": F.col("c_land_min").isNotNull() | F.col("c_land_max").isNotNull(), "residuals": F.coalesce(F.size("c_residuals") > 0, F.lit(False))}
    return C.fill_rates(constraints(spark, sf_dir), fields)


def bindings():
    return F.coalesce(F.col("c_age_min"), F.col("c_age_max")).isNotNull().cast("int") + F.col("c_income_cap").isNotNull().cast("int") + F.coalesce(F.col("c_land_min"), F.col("c_land_max")).isNotNull().cast("int")


def binding_buckets_grouping_sets(spark, sf_dir):
    return C.binding_report(constraints(spark, sf_dir), bindings(), "c_level", "category").withColumnRenamed("c_level", "level")


def before_after_binding(spark, sf_dir):
    rows = constraints(spark, sf_dir).withColumn("n", bindings())
    after = rows.withColumn("n", F.when(F.col("slug") % 4 == 0, F.col("n") - 1).otherwise(F.col("n")))
    return C.changed_binding(rows, after, "slug", "n").select("slug", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"))


def describe_exclusive_quartiles(spark, sf_dir):
    return exclusive_quartiles(docs(spark, sf_dir), "lang", "n_chars")


def inventory_full_outer(spark, sf_dir):
    """Documents against labels by id (every third document under another one); sizes are made from the ids."""
    name = F.when(F.col("doc_id") % 3 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    left = docs(spark, sf_dir).select(name.alias("doc_id"), (F.col("doc_id") % 10).alias("size"))
    right = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 10 + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("size"))
    return inventory(left, right, "doc_id", "size").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def doc_list_split(spark, sf_dir):
    """X30 over line lists: items of three characters or more of each document, first of equal items."""
    return docs(spark, sf_dir).select("doc_id", F.size(document_list(F.col("text"))).cast("long").alias("n_items"))


def length_band_counts(spark, sf_dir):
    """F04 over documents with open-ended bands."""
    bands = spark.createDataFrame([("short", None, 500), ("middle", 501, 4000), ("long", 4001, None)], "band string, low long, high long")
    rows = docs(spark, sf_dir).select("n_chars").crossJoin(F.broadcast(bands)).filter(in_range(F.col("n_chars"), F.col("low"), F.col("high")))  # three bands
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def truncated_sheet(spark, sf_dir):
    """The blind sheet's text column."""
    return docs(spark, sf_dir).select("doc_id", F.md5(truncate(F.col("text"), 400)).alias("head_md5"))


QUERIES = {
    "page_text_extract": page_text_extract,
    "page_dedupe_first": page_dedupe_first,
    "redownload_antijoin": redownload_antijoin,
    "url_parts": url_parts_query,
    "sections_running_max": sections_running_max,
    "clause_split_simple": clause_split_simple,
    "clause_chunks_full": clause_chunks_full,
    "chunk_length_quantiles": chunk_length_quantiles,
    "duplicate_text_census": duplicate_text_census,
    "same_body_groups": same_body_groups,
    "near_dup_pairs": near_dup_pairs,
    "near_dup_components": near_dup_components,
    "drop_near_dups_keep_first": drop_near_dups_keep_first,
    "phrase_df": phrase_df,
    "phrase_top25_greedy": phrase_top25_greedy,
    "log_odds_terms": log_odds_terms,
    "field_fill_rates": field_fill_rates,
    "binding_buckets_grouping_sets": binding_buckets_grouping_sets,
    "before_after_binding": before_after_binding,
    "describe_exclusive_quartiles": describe_exclusive_quartiles,
    "inventory_full_outer": inventory_full_outer,
    "doc_list_split": doc_list_split,
    "length_band_counts": length_band_counts,
    "truncated_sheet": truncated_sheet,
}

BASE = "regexp_replace(url, '[?#].*$', '')"
VISIBLE = "html"
for _n in ("script", "style", "nav", "footer"):
    VISIBLE = f"regexp_replace({VISIBLE}, '<{_n}[^>]*>.*?</{_n}>', ' ', 'gis')"
VISIBLE = f"regexp_replace({VISIBLE}, '<div class=\"ad\">.*?</div>', ' ', 'gis')"
VISIBLE = f"regexp_replace(regexp_replace({VISIBLE}, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"
for _a, _b in (("&middot;", " "), ("&copy;", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    VISIBLE = f"replace({VISIBLE}, '{_a}', '{_b}')"
VISIBLE = f"trim(regexp_replace({VISIBLE}, '\\s+', ' ', 'g'))"
PAIRS = f"pr as (select a.vec_id as a, b.vec_id as b, list_dot_product(a.embedding::double[], b.embedding::double[]) as c from embeddings a join embeddings b on a.vec_id < b.vec_id where list_dot_product(a.embedding::double[], b.embedding::double[]) >= {COSINE})"
WALK = f"""with recursive {PAIRS}, e as (select a as u, b as v from pr union select b, a from pr), r(node, reach) as (select u, u from e union select r.node, e.v from r join e on e.u = r.reach), comp as (select node, min(reach) as component from r group by node)"""
BOUND = "(case when age_min is not null or age_max is not null then 1 else 0 end + case when income_cap is not null then 1 else 0 end + case when land_min is not null or land_max is not null then 1 else 0 end)"
STOPPED = "[" + ", ".join(f"'{w}'" for w in C.BOILERPLATE) + "]"
LINES = "string_split(text, chr(10))"
ORACLES = {
    "page_text_extract": f"select page_id, md5({VISIBLE}) as text_md5, length({VISIBLE}) as n_chars from pages",
    "page_dedupe_first": f"with p as (select regexp_extract({BASE}, '^[a-z]+://([^/:]+)', 1) as host, html, page_id from pages) select host, min(page_id) as page_id from p group by host, md5(coalesce(html, ''))",
    "redownload_antijoin": f"with p as (select page_id, url, {BASE} as base from pages) select page_id, base from p where url = base or base not in (select base from p where url = base)",
    "url_parts": f"with p as (select page_id, {BASE} as base from pages) select page_id, regexp_extract(base, '^([a-z]+)://', 1) as scheme, regexp_extract(base, '^[a-z]+://([^/:]+)', 1) as host, regexp_extract(base, '^[a-z]+://[^/]*(/.*)?$', 1) as path, base from p",
    "sections_running_max": """with m as (select page_id, regexp_extract_all(html, '<(h1|h2|p|footer)[ >]', 1) as t from pages),
r as (select page_id, k - 1 as pos, list_position(['h1', 'h2', 'p', 'footer'], t[k]) - 1 as idx from m, unnest(range(1, len(t) + 1)) as u(k)),
f as (select *, min(case when idx = 0 then pos end) over (partition by page_id) as first from r),
h as (select *, max(idx) over (partition by page_id order by pos rows between unbounded preceding and 1 preceding) as high from f where pos >= first)
select page_id, pos, cast(idx as bigint) as idx, lead(pos) over (partition by page_id order by pos) as section_end from h where high is null or idx > high""",
    "clause_split_simple": """with s as (select doc_id, string_split(regexp_replace(text, '([.!?])[ \\n]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as p from documents)
select doc_id, cast(len(p) as bigint) as n_clauses, list_max(list_transform(p, lambda x: length(x))) as longest from s""",
    "chunk_length_quantiles": """with r as (select n_chars, row_number() over (order by n_chars) - 1 as k, count(*) over () as n from documents where n_chars is not null)
select """ + ", ".join(f"max(n_chars) filter (k = cast(round_even({p} * (n - 1), 0) as bigint)) as p{round(p * 100)}" for p in (0.1, 0.5, 0.9, 0.99)) + ", count(*) as n, min(n_chars) as min, max(n_chars) as max, round(avg(n_chars), 4) as mean from r",
    "duplicate_text_census": "with g as (select count(*) as n from documents group by lower(text) having count(*) > 1) select count(*) as repeated, cast(coalesce(sum(n), 0) as bigint) as involved, cast(coalesce(sum(n - 1), 0) as bigint) as redundant, coalesce(max(n), 0) as largest from g",
    "same_body_groups": "select min(doc_id) as first_key, count(*) as n, count(distinct lang) as labels, count(distinct lang) > 1 as conflict from documents where contains(text, chr(10)) group by regexp_replace(text, '^[^\\n]*\\n?', '') having count(*) > 1",
    "near_dup_pairs": f"with {PAIRS} select a, b, round(c, 6) as cosine from pr",
    "near_dup_components": f"{WALK} select node, component from comp",
    "drop_near_dups_keep_first": f"{WALK} select vec_id, label from embeddings where vec_id not in (select node from comp where node <> component)",
    "phrase_df": f"""with w as (select doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') as w from documents),
g as (select distinct doc_id, array_to_string(w[k : k + n - 1], ' ') as gram from w, (select unnest([4, 5, 6]) as n), unnest(range(1, greatest(len(w) - n + 2, 1))) as u(k))
select gram, count(*) as n from g group by gram having count(*) >= 5 and len(list_filter(string_split(gram, ' '), lambda x: not list_contains({STOPPED}, x))) >= 2""",
    "log_odds_terms": None,
    "field_fill_rates": f"""with {CONSTRAINTS}, f as (select 'age' as field, age_min is not null or age_max is not null as x from constraints_fx union all select 'income', income_cap is not null from constraints_fx
union all select 'land', land_min is not null or land_max is not null from constraints_fx union all select 'residuals', has_residual from constraints_fx)
select field, count(*) filter (x) as filled, count(*) as n, round(count(*) filter (x) / count(*), 6) as rate from f group by field""",
    "binding_buckets_grouping_sets": f"""with {CONSTRAINTS}, b as (select level, category, {BOUND} as b from constraints_fx)
select coalesce(category, '*') as category, coalesce(level, '*') as level, count(*) as n, count(*) filter (b = 0) as n_0, count(*) filter (b = 1) as n_1, count(*) filter (b = 2) as n_2, count(*) filter (b >= 3) as n_3,
  round(count(*) filter (b >= 1) / count(*), 6) as share_1, round(count(*) filter (b >= 2) / count(*), 6) as share_2, round(count(*) filter (b >= 3) / count(*), 6) as share_3, round(avg(b), 6) as mean from b group by grouping sets ((), (category), (level))""",
    "before_after_binding": f"with {CONSTRAINTS} select slug, cast({BOUND} as bigint) as before, cast({BOUND} - 1 as bigint) as after from constraints_fx where slug % 4 = 0",
    "describe_exclusive_quartiles": """with r as (select lang, cast(n_chars as double) as v, row_number() over (partition by lang order by n_chars) as k, count(*) over (partition by lang) as n from documents where n_chars is not null),
q as (select lang, v, k, n, p, least(greatest((n + 1) * p, 1.0), n) as place from r, (select unnest([0.25, 0.5, 0.75]) as p)),
w as (select lang, n, p, sum(v * case when k = floor(place) then 1 - (place - floor(place)) when k = floor(place) + 1 then place - floor(place) end) as x from q group by all)
select r.lang, count(*) as n, min(v) as min, round(any_value(a.x), 6) as q1, round(any_value(b.x), 6) as median, round(any_value(c.x), 6) as q3, max(v) as max, round(avg(v), 1) as mean
from r join w a on a.lang = r.lang and a.p = 0.25 join w b on b.lang = r.lang and b.p = 0.5 join w c on c.lang = r.lang and c.p = 0.75 group by r.lang having count(*) >= 2""",
    "inventory_full_outer": """with l as (select case when doc_id % 3 = 0 then -1 - doc_id else doc_id end as doc_id, doc_id % 10 as s from documents), r as (select doc_id, doc_id % 10 + case when doc_id % 7 = 0 then 1 else 0 end as s from labels)
select status, count(*) as n from (select case when r.s is null then 'missing' when l.s is null then 'extra' when l.s <> r.s then 'wrong_size' else 'same' end as status from l full join r using (doc_id)) group by status""",
    "length_band_counts": "select band, count(*) as n from (select case when n_chars <= 500 then 'short' when n_chars <= 4000 then 'middle' else 'long' end as band from documents where n_chars is not null) group by band",
    "truncated_sheet": "select doc_id, md5(left(coalesce(text, ''), 400)) as head_md5 from documents",
}
from eligspark.plans.search import INDEX  # noqa: E402

ORACLES["log_odds_terms"] = f"""with {INDEX}, t as (select lang, term, cast(sum(tf) as bigint) as y from post join documents using (doc_id) group by all), o as (select term, sum(y) as total from t group by term),
c as (select lang, sum(y) as nc from t group by lang), a as (select sum(total) as n_all, sum(total + 0.01::double) as alpha0 from o),
z as (select lang, term, y, total + 0.01::double as al, y as yi, total - y as yj, nc as ni, n_all - nc as nj, alpha0 from t join o using (term) join c using (lang), a),
s as (select lang, term, y, round((ln((yi + al) / (ni + alpha0 - yi - al)) - ln((yj + al) / (nj + alpha0 - yj - al))) / sqrt(1 / (yi + al) + 1 / (yj + al)), 6) as z from z),
r as (select *, row_number() over (partition by lang order by z desc, term) as rnk from s) select lang, term, y, z, rnk from r where rnk <= 10"""
