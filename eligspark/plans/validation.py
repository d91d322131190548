"""Queries of number words and of answers against closed schemas; the answers are JSON made from the tables, faults included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligspark.functions.numbers import NUMBER_WORDS, number_words
from eligspark.operators import validation as V
from eligspark.tables import table

SPOKEN = tuple(NUMBER_WORDS)


def spoken_documents(spark, sf_dir):
    """X16 over whole documents, two of three of whose words a rule turns into number words: how many numbers, and their sum."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    names = F.array(*map(F.lit, SPOKEN))
    said = F.transform(words, lambda w: F.coalesce(F.get(names, (F.length(w) * 7 + F.ascii(w)) % 60), w))
    rows = table(spark, sf_dir, "documents").select("doc_id", number_words(F.array_join(said, " ")).alias("numbers"))
    total = F.aggregate("numbers", F.lit(0.0), lambda a, n: a + n)
    return rows.select("doc_id", F.size("numbers").cast("long").alias("n_numbers"), F.round(total, 2).alias("total"), F.round(F.coalesce(F.get("numbers", F.size("numbers") - 1), F.lit(-1.0)), 2).alias("last"))


def replies(spark, sf_dir) -> DataFrame:
    """A description and a reply for every part: what each says follows from the part's columns, and some of it is wrong."""
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.floor("p_retailprice")
    child = (size % 9 + 1).cast("string")
    text = F.concat(F.lit("I am "), size.cast("string"), F.lit(" years old. I earn "), price.cast("string"), F.lit(" thousand a month. My son is "), child, F.lit(". I like "), F.col("p_name"), F.lit("."))
    other = [f.name for f in V.PROFILE_FIELDS if f.name not in ("age", "annual_income_inr", "occupation", "is_minority")]
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pair = lambda name, v: F.concat(F.lit(f'"{name}": '), v)
    obj = lambda *parts: F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    profile = obj(
        pair("age", F.when(k % 5 == 0, size + 3).when(k % 17 == 0, size + 100).otherwise(size).cast("string")),
        pair("annual_income_inr", F.when(k % 3 == 0, price * 7).otherwise(price * 12000).cast("string")),
        pair("occupation", quoted(F.concat(F.lit("  "), F.upper(F.split("p_name", " ")[0])))),
        pair("is_minority", F.when(k % 13 == 0, F.lit('"yes"')).otherwise(F.lit("true"))),
        *[pair(name, F.lit("null")) for name in other],
        F.when(size > 1, F.lit('"other_facts": []')),
    )
    confidence = obj(pair("age", quoted(F.when(size % 10 == 0, "sure").otherwise("high"))), pair("annual_income_inr", quoted(F.lit("medium"))), pair("occupation", quoted(F.lit("low"))), pair("is_minority", quoted(F.lit("high"))), F.when(k % 19 == 0, F.lit('"state": "high"')))
    evidence = obj(
        pair("age", quoted(F.when(k % 7 == 0, F.concat(F.lit("My son is "), child)).otherwise(F.concat(F.lit("I am "), size.cast("string"), F.lit(" years"))))),
        pair("annual_income_inr", quoted(F.concat(F.lit("EARN  "), price.cast("string"), F.lit(" thousand a month!")))),
        pair("occupation", F.concat(F.lit("["), quoted(F.when(k % 11 == 0, F.reverse("p_name")).otherwise(F.col("p_name"))), F.lit("]"))),
        pair("is_minority", quoted(F.lit("I am"))),
    )
    reply = obj(pair("profile", profile), pair("confidence", confidence), pair("evidence", evidence), pair("clarifying_question", F.when(k % 2 == 0, F.lit("null")).otherwise(F.lit('"Which state?"'))), F.when(size == 2, F.lit('"more": 1')))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), F.lit("en").alias("lang"), F.when(k % 23 == 0, F.concat(reply, F.lit("}"))).otherwise(F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).alias("reply"))


def profile_validation(spark, sf_dir):
    """Errors of three kinds and what stays of each answer."""
    rows = V.validated_profiles(replies(spark, sf_dir))
    joined = lambda c: F.array_join(c, "; ")
    return rows.select("p_partkey", joined("errors").alias("errors"), joined("field_errors").alias("field_errors"), joined("question_errors").alias("question_errors"), F.col("profile.age").cast("long").alias("age"), F.col("profile.annual_income_inr").alias("income"), F.col("profile.occupation").alias("occupation"), F.col("profile.is_minority").alias("is_minority"), "question")


def record_validation(spark, sf_dir):
    """Constraint records against the closed schema and their sources, every fault with its path."""
    k, size = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    source = F.concat(F.lit("Persons of "), s(size), F.lit(" to "), s(size + 5), F.lit(" years who own a "), F.col("p_name"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    age = F.concat(F.lit('"age": {"min": '), s(F.when(k % 6 == 0, size + 9).otherwise(size)), F.lit(', "max": '), F.when(k % 10 == 0, quoted(s(size + 5))).otherwise(s(size + 5)), F.when(size % 8 == 0, F.lit(', "mean": 1}')).otherwise(F.lit("}")))
    gender = F.concat(F.lit('"gender": '), F.when(size % 3 == 0, F.lit("null")).otherwise(quoted(F.when(size % 3 == 1, "any").otherwise(F.lower("p_brand")))))
    category = F.when(size % 4 == 0, F.concat(F.lit('"category": ["SC", '), quoted(F.when(k % 4 == 0, "Other").otherwise("ST")), F.lit("]")))
    poor = F.when(size % 5 == 0, F.concat(F.lit('"bpl_household": '), F.when(k % 2 == 0, "false").otherwise("true")))
    residual = F.when(size % 7 > 0, F.concat(F.lit('"residual_conditions": ['), quoted(F.concat(F.lit("owns a "), F.col("p_name"))), F.lit("]")))
    constraints = F.concat_ws(", ", age, gender, category, poor, residual, F.when(k % 31 == 0, F.lit('"shoe": 1')))
    spans = F.concat_ws(
        ", ", F.concat(F.lit('"age": '), F.when(k % 9 == 0, F.concat(F.lit('["of '), s(size + 1), F.lit('"]'))).otherwise(F.concat(F.lit('{"x": "'), s(size), F.lit(' to"}')))), F.when(size % 3 == 0, F.lit('"gender": "who own"')),
        F.when((size % 4 == 0) & (k % 3 > 0), F.concat(F.lit('"category": '), quoted(F.split("p_name", " ")[1]))), F.when(size % 5 == 0, F.lit('"bpl_household": " "')),
    )
    reply = F.concat(F.lit('{"constraints": {'), constraints, F.lit('}, "provenance": {'), spans, F.lit("}}"))
    rows = V.validated_constraints(table(spark, sf_dir, "part").select("p_partkey", source.alias("eligibility_text"), reply.alias("reply")))
    return rows.select("p_partkey", F.array_join("errors", "; ").alias("errors"), F.col("constraints.age.min").cast("long").alias("age_min"), F.size("provenance").cast("long").alias("n_spans"))


def residual_removal(spark, sf_dir):
    """Residuals leave only if the spans of the fields that repeat them cover their words and they state nothing more."""
    k, name = F.col("p_partkey"), F.col("p_name")
    residuals = F.array(F.concat(F.lit("Owns: "), name), F.col("p_type"))
    item = lambda text, more: F.struct(text.alias("text"), F.array(F.lit("card"), F.lit("board")).alias("fields"), more.alias("also_states"))
    nothing = F.array().cast("array<string>")
    removals = F.array(item(residuals[0], F.when(k % 4 == 0, F.array(F.lit("more"))).otherwise(nothing)), item(residuals[1], nothing))
    spans = F.create_map(F.lit("card"), F.array(F.concat(F.lit("owns "), F.left(name, F.lit(8) + k % 40))), F.lit("board"), F.array(F.substr(F.col("p_type"), 1 + k % 9), F.lit("x")))
    got = V.guarded_removal(residuals, removals, spans)
    rows = table(spark, sf_dir, "part").select("p_partkey", got.alias("g"))
    return rows.select("p_partkey", *[F.array_join(f"g.{c}", "|").alias(c) for c in ("kept", "removed", "uncovered", "states_more")])


QUERIES = {"spoken_documents": spoken_documents, "profile_validation": profile_validation, "record_validation": record_validation, "residual_removal": residual_removal}

VALUES = "map {" + ", ".join(f"'{w}': {v}::double" for w, v in NUMBER_WORDS.items()) + "}"
NAMES = "[" + ", ".join(f"'{w}'" for w in SPOKEN) + "]"
COVER = "(len(list_filter({0}, lambda w: list_contains({1}, w)))::double / len({0}) >= 0.85)"
ORACLES = {
    "spoken_documents": f"""with w as (select doc_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: coalesce(({NAMES})[(length(w) * 7 + ascii(w)) % 60 + 1], w)) as w from documents),
v as (select doc_id, i, ({VALUES})[x] as v from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w)),
n as (select doc_id, i, v, lag(v) over p as b, lead(v) over p as a from v window p as (partition by doc_id order by i)),
m as (select doc_id, i, case when v between 1 and 9 and b in (20, 30, 40, 50, 60, 70, 80, 90) then null when v in (20, 30, 40, 50, 60, 70, 80, 90) and a between 1 and 9 then v + a else v end as v from n)
select d.doc_id, count(v) as n_numbers, round(coalesce(sum(v), 0), 2) as total, round(coalesce(arg_max(v, i) filter (v is not null), -1), 2) as last from documents d left join m using (doc_id) group by d.doc_id""",
    "profile_validation": """with a as (select *, floor(p_retailprice)::bigint as price, case when p_partkey % 5 = 0 then p_size + 3 when p_partkey % 17 = 0 then p_size + 100 else p_size end as age from part),
e as (select *, case when p_partkey % 23 = 0 then 'not JSON' else concat_ws('; ', case when p_size = 2 then 'more: unknown key' end, case when p_size = 1 then 'other_facts: missing field' end) end as errors,
 case when p_size % 10 = 0 then 'age: no valid confidence' when p_partkey % 7 = 0 then 'age: not said of oneself' when age > 119 then 'age: out of bounds' when abs(age - p_size) > greatest(p_size * 0.02, 0.011) then 'age: doesn''t follow from its evidence' end as e1,
 case when not list_has_any(list_transform([1, 1000, 12, 12000], lambda r: abs(case when p_partkey % 3 = 0 then price * 7 else price * 12000 end - price * r) <= greatest(price * r * 0.02, 0.011)), [true]) then 'annual_income_inr: doesn''t follow from its evidence' end as e2,
 case when p_partkey % 11 = 0 and not contains('I am ' || p_size || ' years old. I earn ' || price || ' thousand a month. My son is ' || (p_size % 9 + 1) || '. I like ' || p_name || '.', reverse(p_name)) then 'occupation: evidence is not in the text' end as e3,
 case when p_partkey % 13 = 0 then 'is_minority: must be true or false' end as e4, case when p_partkey % 19 = 0 then 'state: null, but with confidence or evidence' end as e5 from a),
s as (select *, e1 is null as f1, e2 is null as f2, e3 is null as f3, e4 is null as f4, errors = '' as fine, p_partkey % 23 > 0 as read from e)
select p_partkey, errors, case when read then concat_ws('; ', e3, e5, e1, e2, e4) else '' end as field_errors, case when read and p_partkey % 2 = 1 and f1::int + f2::int + f3::int + f4::int >= 2 then 'question: the profile isn''t nearly empty' else '' end as question_errors,
case when fine and f1 then age::bigint end as age, case when fine and f2 then (case when p_partkey % 3 = 0 then price * 7 else price * 12000 end) end as income, case when fine and f3 then lower(split_part(p_name, ' ', 1)) end as occupation, case when fine and f4 then true end as is_minority,
case when fine and p_partkey % 2 = 1 and f1::int + f2::int + f3::int + f4::int < 2 then 'Which state?' end as question from s""",
    "record_validation": """with e as (select p_partkey, p_size, concat_ws('; ', case when p_partkey % 31 = 0 then 'shoe: unknown key' end, case when p_size % 8 = 0 then 'age.mean: unknown key' end, case when p_partkey % 10 = 0 then 'age.max: must be a number' end,
  case when p_partkey % 6 = 0 and p_size + 9 > p_size + 5 then 'age: min above max' end, case when p_size % 3 = 2 then 'gender: not in the closed set' end, case when p_size % 4 = 0 and p_partkey % 4 = 0 then 'category: not in the closed set' end,
  case when p_size % 5 = 0 and p_partkey % 2 = 0 then 'bpl_household: must be true or null' end, case when p_size % 7 = 0 then 'residual_conditions: missing' end,
  case when p_partkey % 9 = 0 and not contains('Persons of ' || p_size || ' to ' || (p_size + 5) || ' years who own a ' || p_name, 'of ' || (p_size + 1)) then 'age: span is not in the text' end,
  case when p_size % 3 = 0 then 'gender: provenance of nothing' when p_size % 3 = 2 then 'gender: no provenance' end, case when p_size % 4 = 0 and p_partkey % 3 = 0 then 'category: no provenance' end, case when p_size % 5 = 0 then 'bpl_household: empty span' end) as errors from part)
select p_partkey, errors, case when errors = '' then (case when p_partkey % 6 = 0 then p_size + 9 else p_size end)::bigint end as age_min, case when errors = '' then (1 + (p_size % 3 = 0)::int + (p_size % 4 = 0 and p_partkey % 3 > 0)::int + (p_size % 5 = 0)::int)::bigint end as n_spans from e""",
    "residual_removal": f"""with w as (select p_partkey, 'Owns: ' || p_name as r1, p_type as r2, regexp_extract_all(lower('owns ' || p_name), '[a-z0-9_]+') as w1, regexp_extract_all(lower(p_type), '[a-z0-9_]+') as w2,
  regexp_extract_all(lower('owns ' || left(p_name, 8 + p_partkey % 40)), '[a-z0-9_]+') || regexp_extract_all(lower(substr(p_type, 1 + p_partkey % 9)), '[a-z0-9_]+') || ['x'] as s from part),
j as (select *, case when p_partkey % 4 = 0 then 'm' when {COVER.format('w1', 's')} then 'r' else 'u' end as v1, case when {COVER.format('w2', 's')} then 'r' else 'u' end as v2 from w)
select p_partkey, concat_ws('|', case when v1 <> 'r' then r1 end, case when v2 <> 'r' then r2 end) as kept, concat_ws('|', case when v1 = 'r' then r1 end, case when v2 = 'r' then r2 end) as removed, concat_ws('|', case when v1 = 'u' then r1 end, case when v2 = 'u' then r2 end) as uncovered, concat_ws('|', case when v1 = 'm' then r1 end) as states_more from j""",
}
