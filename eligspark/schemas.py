"""Record types as schema strings: schemes, chunks, constraints, profiles, conditions, gold rows (with their closed value sets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME = (
    "slug string, scheme_name string, state string, level string, tags array<string>, description string, benefits_text string, eligibility_text string, "
    "application_process_text string, documents_text string, faq_text string, last_updated date, source_url string, parse_flags array<string>"
)
CHUNK = ("chunk_id string, slug string, scheme_name string, section string, text string, raw_text string, state string, level string, category string")
CONSTRAINTS = (
    "age struct<min:int,max:int>, income struct<max_annual_inr:bigint,basis:string>, gender string, category array<string>, occupation array<string>, "
    "land struct<max_acres:double,min_acres:double>, education struct<stage:string,min_class:int,max_class:int>, state string, residence string, marital_status string, "
    "family struct<requires_dependent:boolean,notes:string>, citizen_of_india boolean, bpl_household boolean, requires_bocw_registration boolean, "
    "not_availing_other_scheme boolean, residual_conditions array<string>"
)
PROFILE = (
    "occupation string, state string, age int, gender string, annual_income_inr bigint, land_acres double, caste_category string, family string, education_class int, "
    "education_stage string, residence string, marital_status string, disability_percent double, is_minority boolean, bpl_household boolean, "
    "registered_construction_worker boolean, prior_benefit_schemes array<string>, applying_for string"
)
GOLD = (
    "id string, description string, language string, expected_schemes array<string>, excluded_schemes array<string>, test_type string, notes string, skip_scoring boolean, split string"
)
CHECK = "struct<pos:int,field:string,result:string,decisive:boolean,ask_field:string,ask_kind:string,gate:boolean>"
CONDITION = (
    f"{CHECK[:-1]},note:string,"
    "constraint:string,profile_value:string,confidence:string,source_span:string>"
)

# Closed sets of the data model.
STATUSES = ("eligible", "needs_checking", "not_eligible")
CONFIDENT = ("high", "medium")
CASTES = ("SC", "ST", "OBC", "EWS", "General")
ON_BEHALF = ("child", "spouse", "parent", "other")
LANGUAGES = ("en", "hi", "te", "ta", "bn")
SECTIONS = ("overview", "eligibility", "exclusions")
RULES = ("applying_for", "priority", "multi_branch", "bocw_occupation", "person_level_pass", "bocw_gate", "residual_touch")


def over_null_template(df: DataFrame, schema: str) -> DataFrame:
    """Every field of `schema`, null where `df` lacks it, cast to its type; further columns are dropped."""
    have = set(df.columns)
    fields = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def as_list(column: Column) -> Column:
    """A JSON string, list of strings or object (its values, in order, lists among them flattened) as a list without blank entries."""
    inner = F.map_values(F.from_json(column, "map<string,string>"))
    flat = F.flatten(F.transform(inner, lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))))
    single = F.array(F.get_json_object(F.concat(F.lit('{"v":'), column, F.lit("}")), "$.v"))
    start = F.left(F.ltrim(column), F.lit(1))
    parsed = F.when(start == "[", F.from_json(column, "array<string>")).when(start == "{", flat).otherwise(single)
    return F.filter(parsed, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
