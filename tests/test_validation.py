"""Number words, closed schemas, evidence, and guarded removal of residuals, case by case."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from eligspark.functions import numbers as N
from eligspark.operators import validation as V


def plain_words(text):
    """X16 in plain Python: a full ten takes the one to nine right behind it."""
    values = [N.NUMBER_WORDS.get(w) for w in re.findall("[a-z]+", (text or "").lower())]
    out, skip = [], False
    for v, after in zip(values, [*values[1:], None]):
        if skip or v is None:
            skip = False
            continue
        skip = v in range(20, 100, 10) and after is not None and 1 <= after <= 9
        out.append(v + after if skip else v)
    return out


def test_number_words(spark):
    rnd = random.Random(4)
    words = [*N.NUMBER_WORDS, "acres", "and", "the", "Twenty", "SIX", "12", "seventy-five", "two-hundred"]
    texts = [None, "", "no numbers", "one", "Seventy five", "seventy  five six", "twenty twenty one", "twenty first", "half an acre", "thirty and two", *(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", N.number_words(F.col("t")).alias("n"), N.stated_numbers(F.concat(F.lit("१,८०,००० "), F.col("t"))).alias("all"))
    for r in rows.collect():
        assert r.n == plain_words(texts[r.k])
        assert texts[r.k] is None or r["all"][0] == 180000.0


@pytest.mark.parametrize(
    ("text", "want"),
    [("seventy five and two hundred", [75, 200]), ("two hundred and five", [205]), ("two and a half acres", [2.5]), ("one lakh twenty thousand", [1, 20]), (None, []), ("ninety nine six", [99, 6]), ("three, four", [3, 4]), ("a hundred", [100])],
)
def test_spoken_numbers(spark, text, want):
    assert spark.range(1).select(N.spoken_numbers(F.lit(text).cast("string"))).first()[0] == want


def test_units(spark):
    of = lambda text, key: sorted(spark.range(1).select(N.unit_ratios(F.lit(text), key)).first()[0])
    assert of("2 लाख", "annual_income_inr") == [1, 1e5]
    assert of("1.5 lakh per month", "annual_income_inr") == [1, 12, 1e5, 12e5]
    assert of("2 lakh", "age") == [1]
    assert of("3 hectares", "land_acres") == [1, 2.471]


ALL = [f.name for f in V.PROFILE_FIELDS]


def answer(profile=None, confidence=None, evidence=None, question=None, facts=(), **more):
    return json.dumps({"profile": {**dict.fromkeys(ALL), "other_facts": list(facts), **(profile or {})}, "confidence": confidence or {}, "evidence": evidence or {}, "clarifying_question": question, **more}, ensure_ascii=False)


TEXT = "I am 34 years old, a farmer with two and 2.5 hectares. We earn 1.5 lakh a month. My daughter is 7. I am a widow. I got PM Kisan in Bihar."
CASES = {
    "fine": (TEXT, "en", answer({"age": 34, "occupation": " Farmer ", "state": "bihar"}, {"age": "high", "occupation": "low", "state": "medium"}, {"age": "I am 34 years old", "occupation": ["a farmer"], "state": "Bihar."}), [], [], [], {"age": 34, "occupation": "farmer", "state": "Bihar"}),
    "fenced": (TEXT, "en", "```json\n" + answer() + "\n```", [], [], [], {}),
    "not json": (TEXT, "en", "no {", ["not JSON"], [], [], None),
    "null": (TEXT, "en", None, ["not JSON"], [], [], None),
    "a list": (TEXT, "en", "[1]", ["not a JSON object"], [], [], None),
    "keys": (TEXT, "en", json.dumps({"profile": {"shoe": 1}, "confidence": 3, "extra": 1, "evidence": {}}), ["extra: unknown key", "clarifying_question: missing key", "confidence: must be an object", "shoe: unknown field", *sorted(f"{f}: missing field" for f in [*ALL, "other_facts"])], None, None, None),
    "somebody else's age": (TEXT, "en", answer({"age": 7}, {"age": "high"}, {"age": "My daughter is 7"}), [], ["age: not said of oneself"], [], {"age": None}),
    "no first person": (TEXT, "en", answer({"age": 34}, {"age": "high"}, {"age": "34 years old"}), [], ["age: not said of oneself"], [], {"age": None}),
    "bounds": ("I am 200", "en", answer({"age": 200}, {"age": "high"}, {"age": "I am 200"}), [], ["age: out of bounds"], [], {"age": None}),
    "wrong number": (TEXT, "en", answer({"age": 43}, {"age": "high"}, {"age": "I am 34 years old"}), [], ["age: doesn't follow from its evidence"], [], {"age": None}),
    "no number": (TEXT, "en", answer({"annual_income_inr": 5}, {"annual_income_inr": "high"}, {"annual_income_inr": "a farmer"}), [], ["annual_income_inr: evidence states no number"], [], {}),
    "monthly lakhs": (TEXT, "en", answer({"annual_income_inr": 1800000.0}, {"annual_income_inr": "high"}, {"annual_income_inr": "1.5 lakh a month"}), [], [], [], {"annual_income_inr": 1800000}),
    "hectares": (TEXT, "en", answer({"land_acres": 6.18}, {"land_acres": "high"}, {"land_acres": "2.5 hectares"}), [], [], [], {"land_acres": 6.18}),
    "number in words": (TEXT, "en", answer({"land_acres": 2}, {"land_acres": "high"}, {"land_acres": "with two"}), [], [], [], {"land_acres": 2.0}),
    "kinds": (TEXT, "en", answer({"is_minority": "yes", "age": "34", "gender": "woman", "family": 3}, dict.fromkeys(["is_minority", "age", "gender", "family"], "high"), {"is_minority": "Bihar", "age": "I am 34", "gender": "I am a widow", "family": "Bihar"}), [], ["age: must be a number", "gender: not in the closed set", "family: must be text", "is_minority: must be true or false"], [], {}),
    "gender": (TEXT, "en", answer({"gender": "Female", "marital_status": "widow"}, {"gender": "high", "marital_status": "high"}, {"gender": "I am a widow", "marital_status": "I am a widow"}), [], [], [], {"gender": "female", "marital_status": "widowed"}),
    "no confidence": (TEXT, "en", answer({"state": "Bihar"}, {"state": "sure"}, {"state": "Bihar"}), [], ["state: no valid confidence"], [], {"state": None}),
    "ungrounded": (TEXT, "en", answer({"state": "Goa"}, {"state": "high"}, {"state": "Goa"}), [], ["state: evidence is not in the text"], [], {"state": None}),
    "null with evidence": (TEXT, "en", answer({}, {"age": "high"}, {"shoes": "x"}), [], ["age: null, but with confidence or evidence", "evidence: unknown key shoes"], [], {}),
    "schemes": (TEXT, "en", answer({"prior_benefit_schemes": ["PM  Kisan"]}, {"prior_benefit_schemes": "high"}, {"prior_benefit_schemes": "I got PM Kisan"}), [], [], [], {"prior_benefit_schemes": ["PM Kisan"]}),
    "strange scheme": (TEXT, "en", answer({"prior_benefit_schemes": ["Other"]}, {"prior_benefit_schemes": "high"}, {"prior_benefit_schemes": "I got PM Kisan"}), [], ["prior_benefit_schemes: not named in the text"], [], {}),
    "facts": (TEXT, "en", answer(facts=[{"original": "My daughter is 7", "en": "x"}, {"original": "nothing", "en": "x"}, 3]), [], ["other_facts: not in the text", "other_facts: must be pairs"], [], {}),
    "question": (TEXT, "en", answer(question="Where? When?"), [], [], ["question: must be one short question"], {}),
    "question too many fields": (TEXT, "en", answer({"state": "Bihar", "occupation": "farmer"}, {"state": "high", "occupation": "high"}, {"state": "Bihar", "occupation": "farmer"}, question="Where?"), [], [], ["question: the profile isn't nearly empty"], {}),
    "translated": ("मैं 34 साल का हूँ", "hi", answer({"age": 34}, {"age": "high"}, {"age": {"original": "मैं 34 साल का हूँ", "en": "I am 34 years old"}}, search_query_en="I am 34 years old."), [], [], [], {"age": 34}),
    "pair missing": ("मैं 34 साल का हूँ", "hi", answer({"age": 34}, {"age": "high"}, {"age": "मैं 34 साल का हूँ"}, search_query_en="I am 34 years old."), [], ["age: evidence must be a pair"], [], {}),
    "bad translation": ("मैं 34 साल का नहीं हूँ। मेरे पास जमीन है। घर है।", "hi", answer(search_query_en="The person is 35 in Kerala"), ["translation: number lost", "translation: number added", "translation: negation lost", "translation: sentences merged", "translation: a summary", "translation: names Kerala"], [], [], None),
    "no translation": ("मैं", "hi", answer(), ["search_query_en: missing key", "translation: missing"], [], [], None),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = spark.createDataFrame([(name, *case[:3], 7, "x") for name, case in CASES.items()], "name string, text string, lang string, reply string, score int, extra string")
    return {r["name"]: r for r in V.validated_profiles(rows).collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_profiles(judged, name):
    row, (_, _, _, errors, fields, question, profile) = judged[name], CASES[name]
    assert row["errors"] == errors
    for want, got in ((fields, row["field_errors"]), (question, row["question_errors"])):
        assert want is None or got == want
    if errors:
        assert row["profile"] is None and row["facts"] is None
    else:
        assert all(row["profile"][k] == v for k, v in profile.items())
        assert set(row["confidence"]) == set(row["evidence"]) == {k for k in ALL if row["profile"][k] is not None}
    assert (row["score"], row["extra"]) == (7, "x")


def test_empty_table(spark):
    assert V.validated_profiles(spark.createDataFrame([], "text string, lang string, reply string")).count() == 0
    assert V.validated_constraints(spark.createDataFrame([], "eligibility_text string, reply string")).count() == 0


SOURCE = "Applicants must be women of 18 to 40 years with a card of the board."
GOOD = {"age": {"min": 18, "max": 40}, "gender": "female", "residence": "any", "residual_conditions": ["with a card"]}
SPANS = {"age": "18 to 40 years", "gender": ["women"]}
RECORDS = {
    "fine": (GOOD, SPANS, []),
    "nested span": (GOOD, {**SPANS, "age": {"min": "18", "max": "40 years"}}, []),
    "unknown": ({**GOOD, "shoe": 1, "age": {"min": 18, "max": 40, "mean": 30}}, SPANS, ["shoe: unknown key", "age.mean: unknown key"]),
    "no residuals": ({k: v for k, v in GOOD.items() if k != "residual_conditions"}, SPANS, ["residual_conditions: missing"]),
    "min above max": ({**GOOD, "age": {"min": 50, "max": 40}}, SPANS, ["age: min above max"]),
    "kinds": ({**GOOD, "age": {"min": 18.5, "max": "40"}, "income": [], "land": {"min_acres": True}, "category": ["SC", ""], "state": 3}, {**SPANS, "land": "card", "category": "card", "state": "card"}, ["age.min: must be a whole number", "age.max: must be a number", "income: must be an object", "category: must be a list of texts", "land.min_acres: must be a number", "state: must be text"]),
    "sets": ({**GOOD, "gender": "woman", "category": ["SC", "XX"], "income": {"basis": "household"}}, {**SPANS, "category": "card", "income": "card"}, ["income.basis: not in the closed set", "gender: not in the closed set", "category: not in the closed set"]),
    "false": ({**GOOD, "bpl_household": False}, {**SPANS, "bpl_household": "card"}, ["bpl_household: must be true or null"]),
    "provenance": ({**GOOD, "state": "Goa"}, {"age": "19 to 40", "gender": "", "land": "card", "shoe": "card"}, ["shoe: unknown key of provenance", "age: span is not in the text", "gender: empty span", "land: provenance of nothing", "state: no provenance"]),
}


def test_constraints(spark):
    rows = [(n, SOURCE, json.dumps({"constraints": c, "provenance": p})) for n, (c, p, _) in RECORDS.items()]
    rows += [("null", SOURCE, None), ("text", SOURCE, "x"), ("list", SOURCE, "[]"), ("none", SOURCE, '{"provenance": {}}'), ("no provenance", SOURCE, '{"constraints": {}}')]
    got = {r["name"]: r for r in V.validated_constraints(spark.createDataFrame(rows, "name string, eligibility_text string, reply string")).collect()}
    for name, (_, _, errors) in RECORDS.items():
        assert got[name]["errors"] == errors, name
        assert (got[name]["constraints"] is None) == bool(errors)
    assert got["fine"]["constraints"]["age"] == (18, 40) and sorted(got["nested span"]["provenance"]["age"]) == ["18", "40 years"]
    assert [got[n]["errors"] for n in ("null", "text", "list", "none", "no provenance")] == [["not JSON"], ["not JSON"], ["not a JSON object"], ["constraints: must be an object"], ["provenance: must be an object"]]


def test_guarded_removal(spark):
    residuals = ["must be registered with the board", "must own a cow", "must be registered and poor", "own a cow"]
    removals = [(residuals[0], ["board"], []), (residuals[1], ["board"], []), (residuals[2], ["board"], ["poor"]), (residuals[3], [], [])]
    spans = {"board": ["He must be REGISTERED with", "the welfare board"]}
    df = spark.createDataFrame([(residuals, removals, spans), (residuals, None, {})], "r array<string>, x array<struct<text:string,fields:array<string>,also_states:array<string>>>, s map<string,array<string>>")
    first, second = (r[0] for r in df.select(V.guarded_removal(F.col("r"), F.col("x"), F.col("s"))).collect())
    assert first == (residuals[1:], residuals[:1], [residuals[1], residuals[3]], [residuals[2]])
    assert second == (residuals, [], [], [])
