"""Queries of the rule matcher and what follows it."""

from __future__ import annotations

from pyspark.sql import functions as F

from eligspark.functions.rules import satisfies, stated_bound
from eligspark.functions.text import conversion_ratios, derivable, digit_numbers, indian_grouping, is_priority, is_requirement, plain_norm
from eligspark.operators import matcher as M
from eligspark.operators.corpus import containing
from eligspark.operators.evaluation import first_change
from eligspark.operators.postprocess import also_noted, clarified_text, display_order
from eligspark.operators.providers import constraint_errors
from eligspark.plans.fixtures import MATCHING, matching_pairs
from eligspark.schemas import RULES
from eligspark.tables import table

#: The conditions of the fixture pairs, long, as SQL: pos, field, result, ask_field, ask_kind.
CONDITIONS = f"""{MATCHING},
pairs as (select c.query_id, c.slug, c.rnk, p.*exclude (query_id, state, income_basis), p.state as p_state, p.income_basis as p_basis,
  k.age_min, k.age_max, k.income_cap, k.income_basis as k_basis, k.land_min, k.land_max, k.level, k.state as k_state, k.multi_branch, k.has_residual, p.conf in ('high', 'medium') as ok
  from cands_fx c join profiles_fx p using (query_id) join constraints_fx k using (slug)),
conds as (
  select query_id, slug, rnk, 1 as pos, 'age' as field,
    case when age is null or not ok then 'unknown' when on_behalf then 'unknown' when (age_min is null or age >= age_min) and (age_max is null or age <= age_max) then 'pass' else 'fail' end as result,
    case when age is null or not ok then 'age' end as ask_field, case when age is null or not ok then 'missing' end as ask_kind
  from pairs where age_min is not null or age_max is not null
  union all
  select query_id, slug, rnk, 2, 'income',
    case when income is null or not ok then 'unknown'
         when income <= income_cap then case when p_basis = 'family' or p_basis is not distinct from k_basis then 'pass' else 'unknown' end
         when k_basis is not null and p_basis is not null and (p_basis = k_basis or (p_basis = 'individual' and k_basis = 'family')) then 'fail' else 'unknown' end as result,
    case when income is null or not ok or (p_basis is null and not (income <= income_cap and k_basis is null)) then 'annual_income_inr' end,
    case when income is null or not ok then 'missing' when p_basis is null and not (income <= income_cap and k_basis is null) then 'refine' end
  from pairs where income_cap is not null
  union all
  select query_id, slug, rnk, 3, 'land', r, case when r = 'unknown' then 'land_acres' end, case when r = 'unknown' then case when land_acres is null or not ok then 'missing' else 'refine' end end
  from (select *, case when land_acres is null or not ok then 'unknown'
      when inside and coalesce(land_basis <> 'leased', true) then 'pass' when not inside and land_basis = 'owned' then 'fail' else 'unknown' end as r
    from (select *, (land_min is null or land_acres >= land_min) and (land_max is null or land_acres <= land_max) as inside from pairs where land_min is not null or land_max is not null))
  union all
  select query_id, slug, rnk, 10, 'state', case when level = 'central' then 'pass' when not ok then 'unknown' when p_state = k_state then 'pass' else 'fail' end,
    case when level <> 'central' and not ok then 'state' end, case when level <> 'central' and not ok then 'missing' end from pairs)"""
STATUS = f"""{CONDITIONS},
st as (select query_id, slug, rnk, case when bool_or(result = 'fail') then 'not_eligible' when bool_or(result = 'unknown') then 'needs_checking'
    when not bool_or(result = 'pass' and field <> 'state') then 'needs_checking' else 'eligible' end as status,
  case when bool_or(result = 'fail') then 'a condition fails: ' || string_agg(field, ', ' order by pos) filter (result = 'fail')
       when bool_or(result = 'unknown') then 'could not check: ' || string_agg(field, ', ' order by pos) filter (result = 'unknown')
       when not bool_or(result = 'pass' and field <> 'state') then 'nothing about you could be checked automatically' else 'every checked condition passes' end as reason,
  count(*) as n_conditions, max(case when result = 'pass' and field <> 'state' then 1 else 0 end) as personal from conds group by all)"""


def evaluated(spark, sf_dir, rules=RULES):
    return M.evaluate(matching_pairs(spark, sf_dir), rules)


def match_conditions(spark, sf_dir):
    return M.condition_rows(evaluated(spark, sf_dir), ("query_id", "slug", "rnk"), details=False).select("query_id", "slug", F.col("rnk").cast("long").alias("rnk"), "field", "result", "ask_field", "ask_kind")


def match_status(spark, sf_dir):
    return evaluated(spark, sf_dir).select("query_id", "slug", F.col("rnk").cast("long").alias("rnk"), "status", "reason", F.col("typed_condition_count").cast("long").alias("n_conditions"))


def match_category_disjunction(spark, sf_dir):
    """M07 over profiles with a caste, minority and disability made from keys, and records that list two categories."""
    pairs = matching_pairs(spark, sf_dir)
    q, s = F.col("query_id"), F.col("slug")
    pairs = pairs.select(
        "query_id", "slug", "rnk", "c_multi_branch",
        F.when(q % 4 == 0, "SC").when(q % 4 == 1, "OBC").when(q % 4 == 2, "General").alias("p_caste_category"),
        F.when(q % 3 > 0, q % 3 == 1).alias("p_is_minority"),
        F.when(q % 5 > 0, (q % 5 * 15).cast("double")).alias("p_disability_percent"),
        F.when(s % 4 == 0, F.array(F.lit("SC"), F.lit("PwD"))).when(s % 4 == 1, F.array(F.lit("OBC"))).when(s % 4 == 2, F.array(F.lit("Minority"), F.lit("ST"))).alias("c_category"),
    )
    rows = M.condition_rows(M.evaluate(pairs, fields=("category",)), ("query_id", "slug"), details=False)
    return rows.select("query_id", "slug", "result", "ask_field")


STEPS = [tuple(RULES[:k]) for k in range(len(RULES) + 1)]


def rule_toggle_attribution(spark, sf_dir):
    """Each pair's verdict under growing sets of rules: the step of its first change, and its path."""
    pairs, out = matching_pairs(spark, sf_dir), None
    for k, rules in enumerate(STEPS):
        part = M.evaluate(pairs, rules).select("query_id", "slug", "status", F.lit(k).cast("long").alias("step"))
        out = part if out is None else out.unionByName(part)
    return first_change(out, ("query_id", "slug"))


def clarify_field(spark, sf_dir):
    return M.clarifying_field(evaluated(spark, sf_dir))


def display_rank(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = evaluated(spark, sf_dir)
    order = W.partitionBy("query_id").orderBy(*display_order(rows))
    return rows.select("query_id", "slug", "status", F.row_number().over(order).cast("long").alias("place"))


def preferences_split(spark, sf_dir):
    """Parts whose name or type has priority language (a word of the test corpus stands for it)."""
    text = F.concat_ws(" ", F.when(F.col("p_partkey") % 7 == 0, "priority to"), F.when(F.col("p_partkey") % 11 == 0, "Preferential"), "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", is_priority(text).alias("is_preference"))


def bound_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    q, k = F.floor("l_quantity").cast("int"), F.col("l_orderkey") % 6
    text = F.when(k == 0, F.concat(F.lit("must be at least "), q, F.lit(" years"))).when(k == 1, F.concat(F.lit("below "), q, F.lit(" years"))).when(k == 2, F.concat(F.lit("between "), q, F.lit(" and "), q + 20, F.lit(" years")))
    text = text.when(k == 3, F.concat(F.lit("not more than "), q, F.lit(" years"))).when(k == 4, F.concat(q, F.lit(" or above"))).otherwise("of any age")
    return rows.select("l_orderkey", "l_linenumber", text.alias("text"), (F.col("l_orderkey") % 70).cast("double").alias("v"))


def stricter_bound_parse(spark, sf_dir):
    rows = bound_texts(spark, sf_dir).withColumn("b", stated_bound(F.col("text"), "age"))
    return rows.select("l_orderkey", "l_linenumber", F.col("b.low").alias("low"), F.col("b.low_inclusive").alias("low_inclusive"), F.col("b.high").alias("high"), F.col("b.high_inclusive").alias("high_inclusive"), F.when(F.col("b").isNotNull(), satisfies(F.col("v"), F.col("b"))).alias("met"))


def requirement_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(is_requirement(F.col("text"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def restatement_match(spark, sf_dir):
    """Documents one of whose lines is, normalised, a line of a benchmark passage."""
    lines = lambda name, key: table(spark, sf_dir, name).select(key, F.explode(F.split("text", "\n")).alias("line")).select(key, plain_norm(F.col("line")).alias("norm")).filter("norm <> ''").distinct()
    return lines("documents", "doc_id").join(lines("benchmark", "item_id"), "norm").groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"))


def grounded_quotes(spark, sf_dir):
    """Benchmark passages that stand in documents once white space is collapsed."""
    one = F.regexp_replace("text", r"\s+", " ")
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.trim(F.rtrim(one, F.lit("…"))).alias("text"))
    return containing(table(spark, sf_dir, "documents").select("doc_id", one.alias("text")), quotes, "doc_id", "item_id")


def caveats_minus_shown(spark, sf_dir):
    """Distinct words of a conversation's user turns that no assistant turn has, in order of first use, counted."""
    turns = table(spark, sf_dir, "conversations")
    words = turns.select("conv_id", "role", F.explode(F.split(F.lower("text"), " ")).alias("w")).filter("w <> ''")
    sides = words.groupBy("conv_id").agg(F.collect_set(F.when(F.col("role") == "user", F.col("w"))).alias("mine"), F.collect_set(F.when(F.col("role") == "assistant", F.col("w"))).alias("shown"))
    return sides.select("conv_id", F.size(also_noted(F.col("mine"), F.col("shown"))).cast("long").alias("n_noted"))


def clarification_concat(spark, sf_dir):
    rows = clarified_text(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", F.md5("query").alias("query_md5"), "n_turns")


def indian_grouping_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", indian_grouping(F.floor(F.col("o_totalprice") * 10)).alias("amount"))


def evidence_number_derivable(spark, sf_dir):
    """Whether a document's length can be derived from digits that its text states, by the allowed ratios."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", digit_numbers(F.substring("text", 1, 1 << 30)).alias("numbers"), conversion_ratios(F.col("text")).alias("ratios"))
    return rows.select("doc_id", F.size("numbers").cast("long").alias("n_numbers"), derivable(F.col("n_chars").cast("double"), F.col("numbers"), (1.0, 1e3, 1e5)).alias("derivable"))


def constraint_validation_errors(spark, sf_dir):
    """Records with injected faults and what is wrong with them."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", F.col("p_size").alias("age_min"), F.when(k % 10 == 0, F.col("p_size") - 1).otherwise(F.col("p_size") + 5).alias("age_max"), F.when(k % 15 == 0, F.lit(-1)).otherwise(100).alias("income_cap"), F.when(k % 21 == 0, "household").otherwise("family").alias("income_basis"), F.when(k % 33 == 0, "district").otherwise("state").alias("level"))
    c = {n: F.col(n) for n in ("age_min", "age_max", "income_cap", "income_basis", "level")}
    span = F.when(k % 6 == 0, F.concat(F.lit("x"), F.col("p_type"))).otherwise(F.left("p_type", F.lit(4)))
    return rows.select("p_partkey", F.array_join(constraint_errors(c, {"occupation": span}, F.col("p_type")), "; ").alias("errors")).filter("errors <> ''")


QUERIES = {
    "match_conditions": match_conditions,
    "match_status": match_status,
    "match_category_disjunction": match_category_disjunction,
    "rule_toggle_attribution": rule_toggle_attribution,
    "clarify_field": clarify_field,
    "display_order": display_rank,
    "preferences_split": preferences_split,
    "stricter_bound_parse": stricter_bound_parse,
    "requirement_filter": requirement_filter,
    "restatement_match": restatement_match,
    "grounded_quotes": grounded_quotes,
    "caveats_minus_shown": caveats_minus_shown,
    "clarification_concat": clarification_concat,
    "indian_grouping": indian_grouping_query,
    "evidence_number_derivable": evidence_number_derivable,
    "constraint_validation_errors": constraint_validation_errors,
}

REQ = r"\b(?:must|should|shall|required|only|cannot|excluded|at least|minimum|maximum|not more than|not less than|up to|ineligible|not eligible|will not|shall not)\b"
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '\\s+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'))"
STEP_SQL = "\nunion all ".join(
    f"""select query_id, slug, {k} as step, case when bool_or(r = 'fail') then 'not_eligible' when bool_or(r = 'unknown') then 'needs_checking'
  when {'true' if k >= 5 else 'false'} and not bool_or(r = 'pass' and field <> 'state') then 'needs_checking' else 'eligible' end as status
  from (select c.*, case when {'false' if k >= 1 else 'true'} and field = 'age' and p.on_behalf and p.age is not null and p.conf in ('high', 'medium')
    then case when (k.age_min is null or p.age >= k.age_min) and (k.age_max is null or p.age <= k.age_max) then 'pass' else 'fail' end else result end as r
    from conds c join profiles_fx p using (query_id) join constraints_fx k using (slug)) group by query_id, slug"""
    for k in range(len(RULES) + 1)
)
ORACLES = {
    "match_conditions": f"with {CONDITIONS} select query_id, slug, rnk, field, result, ask_field, ask_kind from conds".replace("case when income is null or not ok or (p_basis is null and not (income <= income_cap and k_basis is null)) then 'annual_income_inr' end", "case when income is null or not ok or (p_basis is null and not (income <= income_cap and k_basis is null)) then 'annual_income_inr' end"),
    "match_status": f"with {STATUS} select query_id, slug, rnk, status, reason, n_conditions from st",
    "match_category_disjunction": f"""with {MATCHING},
p as (select query_id, slug, multi_branch, case query_id % 4 when 0 then 'SC' when 1 then 'OBC' when 2 then 'General' end as caste, case when query_id % 3 > 0 then query_id % 3 = 1 end as minority,
  case when query_id % 5 > 0 then query_id % 5 * 15 >= 40 end as pwd, slug % 4 as kind from cands_fx join constraints_fx using (slug)),
k as (select *, case kind when 0 then [caste = 'SC', pwd] when 1 then [caste = 'OBC'] else [minority, caste = 'ST'] end as known,
  case kind when 0 then ['caste_category', 'disability_percent'] when 1 then ['caste_category'] else ['is_minority', 'caste_category'] end as asks from p where kind < 3),
o as (select *, list_contains(known, true) as hit, list_filter(list_zip(known, asks), lambda z: z[1] is null) as todo from k)
select query_id, slug, case when hit then 'pass' when len(todo) > 0 or multi_branch then 'unknown' else 'fail' end as result, case when not hit and len(todo) > 0 then todo[1][2] end as ask_field from o""",
    "rule_toggle_attribution": f"""with {CONDITIONS}, steps as ({STEP_SQL}),
l as (select *, lag(status) over (partition by query_id, slug order by step) as b from steps)
select query_id, slug, cast(min(step) filter (b is not null and b <> status) as bigint) as first_change, string_agg(status, '>' order by step) filter (b is null or b <> status) as path from l group by query_id, slug""",
    "clarify_field": f"""with {STATUS}, b as (select distinct c.query_id, c.slug, c.rnk, ask_field, first_value(ask_kind) over (partition by c.query_id, c.slug, ask_field order by pos) as kind
  from conds c join st using (query_id, slug) where result = 'unknown' and ask_field is not null and status <> 'not_eligible'),
s as (select query_id, ask_field, sum(1.0::double / rnk) as score, bool_or(kind = 'refine') as refine, string_agg(slug, ',' order by rnk) as blocks from b group by all),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, ask_field) as n from s)
select query_id, case when round(score, 9) >= 0.5 then ask_field end as field, case when refine then 'refine' else 'missing' end as kind, round(score, 4) as score, blocks from r where n = 1""",
    "display_order": f"with {STATUS} select query_id, slug, status, row_number() over (partition by query_id order by case status when 'eligible' then 0 when 'needs_checking' then 1 else 2 end, 1 - personal, rnk) as place from st",
    "preferences_split": """select p_partkey, regexp_matches(concat_ws(' ', case when p_partkey % 7 = 0 then 'priority to' end, case when p_partkey % 11 = 0 then 'Preferential' end, p_name, p_type),
  '\\bprior(?:ity|ities|itis\\w*|itiz\\w*)\\b|\\bprefer(?:ence|ences|ential|red)\\b|\\breservation\\b|first be assigned', 'i') as is_preference from part""",
    "stricter_bound_parse": """with t as (select l_orderkey, l_linenumber, cast(floor(l_quantity) as int) as q, l_orderkey % 6 as k, cast(l_orderkey % 70 as double) as v from lineitem),
b as (select l_orderkey, l_linenumber, v, case when k in (0, 2, 4) and q >= 1 then cast(q as double) end as low, case when k in (1, 3) then cast(q as double) when k = 2 then cast(q + 20 as double) end as high, k from t)
select l_orderkey, l_linenumber, low, case when k < 5 then low is not null end as low_inclusive, high, case when k < 5 then k in (2, 3) end as high_inclusive,
  case when k < 5 then (low is null or v >= low) and (high is null or case when k = 1 then v < high else v <= high end) end as met from b""",
    "requirement_filter": f"select lang, count(*) as n from documents where regexp_matches(regexp_replace(text, '\\b(?:is|are|shall be|will be)\\s+also\\s+eligible\\b', ' ', 'gi'), '{REQ}', 'i') group by lang",
    "restatement_match": f"""with d as (select distinct doc_id, {NORM.format('line')} as norm from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)),
b as (select distinct item_id, {NORM.format('line')} as norm from (select item_id, unnest(string_split(text, chr(10))) as line from benchmark))
select item_id, count(distinct doc_id) as n_docs from d join b using (norm) where norm <> '' group by item_id""",
    "grounded_quotes": "select item_id, doc_id from documents d join benchmark b on contains(regexp_replace(d.text, '\\s+', ' ', 'g'), trim(regexp_replace(b.text, '\\s+', ' ', 'g')))",
    "caveats_minus_shown": """with w as (select conv_id, role, unnest(string_split(lower(text), ' ')) as w from conversations),
m as (select distinct conv_id, w from w where role = 'user' and w <> ''), a as (select distinct conv_id, w from w where role = 'assistant')
select c.conv_id, count(m.w) as n_noted from (select distinct conv_id from conversations) c left join (select * from m where not exists (select 1 from a where a.conv_id = m.conv_id and a.w = m.w)) m using (conv_id) group by c.conv_id""",
    "clarification_concat": "select conv_id, md5(string_agg(text, ' ' order by turn, text)) as query_md5, count(*) as n_turns from conversations where role = 'user' group by conv_id",
    "indian_grouping": """with o as (select o_orderkey, cast(cast(floor(o_totalprice * 10) as bigint) as varchar) as s from orders)
select o_orderkey, case when length(s) <= 3 then s when length(s) <= 5 then left(s, length(s) - 3) || ',' || right(s, 3) when length(s) <= 7 then left(s, length(s) - 5) || ',' || substr(s, length(s) - 4, 2) || ',' || right(s, 3)
  else left(s, length(s) - 7) || ',' || substr(s, length(s) - 6, 2) || ',' || substr(s, length(s) - 4, 2) || ',' || right(s, 3) end as amount from o""",
    "evidence_number_derivable": """with n as (select doc_id, cast(n_chars as double) as v, list_transform(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'), lambda x: try_cast(case when regexp_full_match(x, '[0-9]{1,3}(?:,[0-9]{2,3})+(?:\\.[0-9]+)?') then replace(x, ',', '') else replace(x, ',', '.') end as double)) as raw from documents),
m as (select doc_id, v, list_filter(raw, lambda x: x is not null) as xs from n)
select doc_id, cast(len(xs) as bigint) as n_numbers, len(list_filter(xs, lambda x: abs(x - v) <= greatest(abs(v) * 0.02, 0.011) or abs(x * 1e3 - v) <= greatest(abs(v) * 0.02, 0.011) or abs(x * 1e5 - v) <= greatest(abs(v) * 0.02, 0.011))) > 0 as derivable from m""",
    "constraint_validation_errors": """with e as (select p_partkey, concat_ws('; ', case when p_partkey % 10 = 0 then 'age: min above max' end, case when p_partkey % 15 = 0 then 'income: negative cap' end, case when p_partkey % 21 = 0 then 'income: unknown basis' end,
  case when p_partkey % 33 = 0 then 'level: unknown' end, case when p_partkey % 6 = 0 and p_type is not null then 'occupation: span is not in the text' end) as errors from part) select * from e where errors <> ''""",
}
