"""Hand goldens of the rule algebra, ranking, chunking and text functions."""

import itertools

import pytest
from pyspark.sql import functions as F

from eligspark.functions import rules as R
from eligspark.functions import text as X
from eligspark.operators import chunking, postprocess
from eligspark.operators import matcher as M
from eligspark.operators.search import fuse
from eligspark.schemas import CONDITION, RULES


def one(spark, expression, **columns):
    """The value of an expression over one row of typed columns (value, type)."""
    row = spark.range(1).select(*[F.lit(v).cast(t).alias(k) for k, (v, t) in columns.items()]) if columns else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


def pairs(spark, **columns):
    row = spark.range(1)
    for k, (v, t) in columns.items():
        row = row.withColumn(k, (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(t))
    return row


def condition(spark, field, rules=RULES, **columns):
    got = M.evaluate(pairs(spark, **columns), rules).select("conditions", "status", "reason").first()
    return next(((c.result, c.ask_field, c.ask_kind) for c in got.conditions if c.field == field), None), got.status


INCOME = [
    (100, 200, None, None, "pass", None), (100, 200, "family", "individual", "pass", None), (300, 200, "individual", "family", "fail", None), (300, 200, "family", "individual", "unknown", None),
    (300, 200, "family", "family", "fail", None), (100, 200, "individual", "family", "unknown", None), (100, 200, None, "family", "unknown", "refine"), (300, 200, None, "family", "unknown", "refine"), (300, 200, "family", None, "unknown", None),
]


@pytest.mark.parametrize(("value", "cap", "basis", "scheme", "result", "kind"), INCOME)
def test_income(spark, value, cap, basis, scheme, result, kind):
    got, _ = condition(spark, "income", p_annual_income_inr=(value, "bigint"), c_income_cap=(cap, "bigint"), p_income_basis=(basis, "string"), c_income_basis=(scheme, "string"))
    assert got == (result, "annual_income_inr" if kind else None, kind)


@pytest.mark.parametrize(("value", "basis", "expected"), [(2.0, "leased", ("unknown", "land_acres", "refine")), (9.0, None, ("unknown", "land_acres", "refine")), (9.0, "owned", ("fail", None, None)), (2.0, None, ("pass", None, None)), (None, None, ("unknown", "land_acres", "missing"))])
def test_land(spark, value, basis, expected):
    got, _ = condition(spark, "land", p_land_acres=(value, "double"), p_land_basis=(basis, "string"), c_land_min=(1.0, "double"), c_land_max=(5.0, "double"))
    assert got == expected


def test_category(spark):
    base = {"p_caste_category": ("OBC", "string")}
    assert condition(spark, "category", c_category=(["SC", "PwD"], "array<string>"), p_disability_percent=(45.0, "double"), **base)[0][0] == "pass"
    assert condition(spark, "category", c_category=(["SC"], "array<string>"), c_multi_branch=(True, "boolean"), p_caste_category=("General", "string"))[0] == ("unknown", None, None)
    assert condition(spark, "category", c_category=(["SC"], "array<string>"), **base)[0][0] == "fail"
    assert condition(spark, "category", c_category=(["SC", "Minority"], "array<string>"), **base)[0] == ("unknown", "is_minority", "missing")
    assert condition(spark, "category", c_category=(["PwD"], "array<string>"), p_disability_percent=(45.0, "double"), p_applying_for=("child", "string"))[0] == ("unknown", "disability_percent", "missing")


def test_age_confidence_and_empty_record(spark):
    got, _ = condition(spark, "age", p_age=(70, "int"), p_age_conf=("low", "string"), c_age_max=(60, "int"))
    assert got == ("unknown", "age", "missing")
    got, status = condition(spark, "age", p_age=(70, "int"), c_age_max=(60, "int"))
    assert got == ("fail", None, None) and status == "not_eligible"
    assert condition(spark, "age", p_age=(70, "int"), p_applying_for=("parent", "string"), c_age_max=(60, "int"))[0] == ("unknown", None, None)
    assert condition(spark, "age")[1] == "needs_checking"
    with pytest.raises(ValueError):
        M.evaluate(pairs(spark), ("no_such_rule",))


def test_stage_marital_state_occupation(spark):
    assert condition(spark, "education_stage", c_stage=("Post-graduation", "string"), p_education_stage=("undergraduate", "string"))[0] == ("unknown", "education_stage", "refine")
    assert condition(spark, "education_stage", c_stage=("school", "string"), p_education_class=(9, "int"))[0][0] == "pass"
    assert condition(spark, "marital_status", c_marital_status=("widow or divorced women", "string"), p_marital_status=("divorced", "string"))[0][0] == "pass"
    assert condition(spark, "marital_status", c_marital_status=("destitute", "string"), p_marital_status=("divorced", "string"))[0] == ("unknown", None, None)
    assert condition(spark, "marital_status", c_marital_status=("any", "string"))[0] is None
    assert condition(spark, "state", c_level=("central", "string"))[0][0] == "pass"
    assert condition(spark, "state", c_state=("Kerala", "string"), p_state=("Goa", "string"))[1] == "not_eligible"
    assert condition(spark, "occupation", c_occupation=(["farmer"], "array<string>"), p_occupation=("grower", "string"), p_occupation_similarity=(0.86, "double"))[0][0] == "pass"
    assert condition(spark, "occupation", c_occupation=(["farmer"], "array<string>"), p_occupation=("clerk", "string"), p_occupation_similarity=(0.5, "double"))[0] == ("unknown", "occupation", "refine")


def test_gate_and_priority(spark):
    gate = {"c_requires_bocw": (True, "boolean"), "p_registered_construction_worker": (True, "boolean"), "c_residuals": (["extra"], "array<string>")}
    assert condition(spark, "registered_construction_worker", **gate)[1] == "needs_checking"
    assert condition(spark, "registered_construction_worker", rules=(), **gate)[1] == "eligible"
    listed = {"c_category": (["SC"], "array<string>"), "c_category_span": ("preference to SC", "string"), "p_caste_category": ("OBC", "string")}
    assert condition(spark, "category", **listed)[0] is None
    assert condition(spark, "category", rules=(), **listed)[0][0] == "fail"


def test_dropping_a_value_never_makes_a_fail(spark):
    profile = {"p_age": (30, "int"), "p_annual_income_inr": (100, "bigint"), "p_land_acres": (2.0, "double"), "p_state": ("Goa", "string"), "p_caste_category": ("SC", "string"), "p_gender": ("female", "string"), "p_income_basis": ("family", "string"), "p_land_basis": ("owned", "string")}
    record = {"c_age_max": (60, "int"), "c_income_cap": (200, "bigint"), "c_land_max": (5.0, "double"), "c_state": ("Goa", "string"), "c_category": (["SC"], "array<string>"), "c_gender": ("female", "string")}
    assert M.evaluate(pairs(spark, **profile, **record)).first().status == "eligible"
    for k in (1, 2):
        for gone in itertools.combinations(profile, k):
            row = {n: (None, t) if n in gone else (v, t) for n, (v, t) in profile.items()}
            assert M.evaluate(pairs(spark, **row, **record)).first().status != "not_eligible"


def test_clarifying_field(spark):
    rows = spark.createDataFrame([(1, 10, 1, "state"), (1, 11, 2, "age"), (1, 12, 3, "state")], "query_id int, slug int, rnk int, f string")
    c = F.struct(F.lit(1).alias("pos"), F.col("f").alias("field"), F.lit("unknown").alias("result"), F.lit(True).alias("decisive"), F.col("f").alias("ask_field"), F.lit("missing").alias("ask_kind"), F.lit(False).alias("gate"), F.lit(None).cast("string").alias("note"))
    got = M.clarifying_field(rows.withColumn("conditions", F.array(c)).withColumn("status", F.lit("needs_checking"))).first()
    assert (got.field, got.score, got.blocks, got.kind) == ("state", 1.3333, "10,12", "missing")


def test_fusion(spark):
    dense = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "item_id int, doc_id int, rnk int")
    lexical = spark.createDataFrame([(1, 7, 1), (1, 6, 2), (1, 5, 3)], "item_id int, doc_id int, rnk int")
    got = {r.doc_id: (round(r.score, 12), r.rnk) for r in fuse(dense, lexical).collect()}
    assert got == {5: (round(1 / 61 + 1 / 63, 12), 1), 6: (round(2 / 62, 12), 2), 7: (round(1 / 61, 12), 3)}


BOUNDS = [
    ("more than 80%", "disability_percent", (80.0, False, None, False)), ("at least 18 years", "age", (18.0, True, None, False)), ("not more than 60 years", "age", (None, False, 60.0, True)), ("below 60 years", "age", (None, False, 60.0, False)),
    ("18 to 60 years", "age", (18.0, True, 60.0, True)), ("40 or more", "age", (40.0, True, None, False)), ("not exceeding Rs. 2,50,000", "annual_income_inr", (None, False, 250000.0, True)), ("no number", "age", None), ("at least 500 years", "age", None), ("not less than 21", "age", (21.0, True, None, False)),
]


@pytest.mark.parametrize(("text", "key", "expected"), BOUNDS)
def test_bounds(spark, text, key, expected):
    got = one(spark, R.stated_bound(F.lit(text), key))
    assert (tuple(got) if got else None) == expected


def test_quirks_of_bounds_are_kept_on_request(spark):
    assert tuple(one(spark, R.stated_bound(F.lit("not more than 60 years"), "age", fixed=False))) == (60.0, False, 60.0, True)
    assert one(spark, R.stated_bound(F.lit("up to Rs 2,50,000"), "annual_income_inr", fixed=False)) is None


def test_text_functions(spark):
    assert one(spark, X.indian_grouping(F.lit(120000))) == "1,20,000"
    assert one(spark, X.indian_grouping(F.lit(-12345678))) == "-1,23,45,678"
    assert one(spark, X.indian_grouping(F.lit(999))) == "999"
    assert one(spark, X.collapse(F.lit(" a  b\n"))) == "a b"
    assert one(spark, X.digit_numbers(F.lit("१,८०,००० and 2.5 or 2,5"))) == [180000.0, 2.5, 2.5]
    assert one(spark, X.tag_chips(F.lit("StudentLoanSCWomen"))) == ["Student", "Loan", "SC", "Women"]
    assert one(spark, X.listed(F.array(*map(F.lit, "abc")))) == "a, b and c"
    assert str(one(spark, X.day_first_date(F.lit("on 05/03/2024")))) == "2024-03-05"
    assert one(spark, X.day_first_date(F.lit("99/99/2024"))) is None
    assert one(spark, X.without_fences(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, X.is_requirement(F.lit("Dwarfs are also eligible"))) is False
    assert one(spark, X.is_requirement(F.lit("The applicant must apply"))) is True
    assert one(spark, X.quotable(F.lit("Note 2: - the applicant"))) == "the applicant"
    assert one(spark, X.fuzzy_words_match(F.lit("small farmer"), F.lit("farmer"))) is True
    assert one(spark, X.word_coverage(F.lit("a b b c"), F.lit("b c"))) == 0.75
    assert one(spark, X.derivable(F.lit(240000.0), F.array(F.lit(20000.0)))) is True
    assert one(spark, X.claims(F.lit("You are eligible for this."))) is True
    assert one(spark, X.claims(F.lit("You may be eligible."))) is False
    assert one(spark, X.denies(F.lit("you are not eligible"))) is True
    assert one(spark, X.is_grounded(F.lit("a  b…"), F.lit("x a b y"))) is True
    assert one(spark, X.mend(F.lit("Ã©tude"))) == "étude"
    assert one(spark, X.acronyms(F.lit("Scheme (PMEGP) (new)"), F.lit("pmegp"))) == ["PMEGP"]
    assert one(spark, X.named_things(F.lit("the Old Age Pension Scheme and old age pension scheme")))[0].endswith("Old Age Pension Scheme")
    assert one(spark, X.document_list(F.lit("Aadhaar card\n2. Bank passbook\nAadhaar card"))) == ["Aadhaar card", "Bank passbook"]
    assert one(spark, X.error_class(F.lit("429 rate limit"))) == "minute"


def test_chunking(spark):
    scraps = lambda *parts: one(spark, chunking.without_scraps(F.array(*map(F.lit, parts))))
    assert scraps("short", "x" * 50, "tail") == ["short " + "x" * 50 + " tail"]
    assert scraps("a", "b") == ["a b"] and scraps("x" * 40, "y" * 40, "z") == ["x" * 40, "y" * 40 + " z"] and scraps("a", "x" * 39, "y" * 45) == ["a " + "x" * 39, "y" * 45]
    split = lambda text: one(spark, chunking.sentences(F.lit(text)))
    assert split("Pay Rs. 500 now. The next one.") == ["Pay Rs. 500 now.", "The next one."]
    assert split("B.Sc. Agriculture holders • Second item") == ["B.Sc. Agriculture holders", "Second item"]
    assert split("They hold an M.Sc. The rest too.") == ["They hold an M.Sc.", "The rest too."]
    assert split("Either: 1. First thing 2) Second; 3. Third") == ["Either:", "1. First thing 2) Second;", "3. Third"]
    assert split("The scheme is discontinuedIn case of need e.g. PMEGP (see Dr. Rao)!") == ["The scheme is discontinued", "In case of need e.g. PMEGP (see Dr. Rao)!"]
    pieces = one(spark, chunking.within_length(F.lit(("word, " * 300).strip())))
    assert all(len(p) <= chunking.LONG for p in pieces) and " ".join(pieces) == ("word, " * 300).strip()
    assert [len(p) for p in one(spark, chunking.within_length(F.lit("x" * 900)))] == [400, 400, 100]
    assert one(spark, chunking.within_length(F.lit("y" * 150 + ", " + "z " * 160))) == ["y" * 150 + ", " + ("z " * 124).strip(), ("z " * 36).strip()]
    long = ["a" * 60, "b" * 60]
    found = lambda text: one(spark, chunking.clauses(F.lit(text).cast("string")))
    assert [c["section"] for c in found(f"{long[0]}. Exclusions: X{long[1]}.")] == ["eligibility", "exclusions"]
    assert found("NA") == [] and found(None) == [] and found("") == []


def residual(spark, text):
    c = "array(named_struct('field','age','result','pass','decisive',true,'constraint','{\"min\":18}','source_span','Must be 18 years | of age'))"
    return tuple(one(spark, postprocess.classify_residual(F.lit(text), F.expr(c))))


def test_residuals(spark):
    assert residual(spark, "must be 18 YEARS") == ("restatement", "age")
    assert residual(spark, "age at least 21") == ("stricter", "age")
    assert residual(spark, "age at least 18") == ("other", None)
    assert residual(spark, "must own a cow") == ("other", None)


@pytest.mark.parametrize(("age", "status"), [(25, "eligible"), (19, "needs_checking"), (None, "needs_checking")])
def test_finalize_only_lowers(spark, age, status):
    c = F.from_json(F.lit('[{"field":"age","result":"pass","decisive":true,"constraint":"{\\"min\\":18}","source_span":"x"}]'), f"array<{CONDITION}>")
    for before in ("eligible", "needs_checking", "not_eligible"):
        df = spark.range(1).select(F.lit(before).alias("status"), F.lit("why").alias("reason"), F.array(F.lit("age must be at least 21 years")).alias("unverified"), c.alias("conditions"), F.lit(age).cast("int").alias("age"))
        got = postprocess.finalize(df, {"age": F.col("age")}, {"age": F.lit("high")}, F.lit("the age must be at least 21 years here")).first()
        assert got.final_status == (status if before == "eligible" else before)
        assert (got.caveats == []) == (before == "not_eligible" or age == 25)
